"""Roll-ups of buildings to sites and properties, panel dispositions and parameter sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.operators import quantiles


def ordered_reasons(order: Column, reason: Column) -> Column:
    """An aggregate: distinct reasons in the order in which they came first."""
    pairs = F.array_sort(F.collect_list(F.when(reason.isNotNull(), F.struct(order.alias("o"), reason.alias("r")))))
    return F.array_distinct(F.transform(pairs, lambda p: p["r"]))


def site_rollup(buildings: DataFrame, site: str, kw: str, raw_kw: str, modules: str, area: str, kind: str, counted: str, review: str) -> DataFrame:
    """Totals over counted buildings, what is left uncounted, and any review flag."""
    on = lambda c: F.coalesce(F.sum(F.when(F.col(counted), F.col(c))), F.lit(0))
    return buildings.groupBy(site).agg(
        F.count("*").alias("buildings"), on(kw).alias("dc_kw"), on(raw_kw).alias("raw_kw"), on(modules).alias("module_count"), on(area).alias("roof_area_m2"),
        F.coalesce(F.sum(F.when(F.col(counted) & (F.col(kind) == "carport_or_garage"), F.col(kw))), F.lit(0.0)).alias("carport_kw"),
        F.coalesce(F.sum(F.when(~F.col(counted), F.col(kw))), F.lit(0.0)).alias("uncounted_buildings_kw"),
        F.bool_or(review).alias("needs_review"),
    )


def raised_extra_kw(buildings: DataFrame, site: str, extra: str, kw: str, modules: str, counted: str) -> DataFrame:
    """kW that raised racking would add on counted buildings, at each one's own kW a module (0 without modules)."""
    more = F.col(extra) * F.coalesce(F.try_divide(F.col(kw), F.col(modules)), F.lit(0.0))
    return buildings.groupBy(site).agg(F.coalesce(F.sum(F.when(F.col(counted), more)), F.lit(0.0)).alias("raised_extra_kw"))


def property_rollup(rows: DataFrame, group: str, site: str, building: str, kw: str, counted: str, review: str, order: str) -> DataFrame:
    """Per group each building once, as its first occurrence has it."""
    first = rows.withColumn("x_place", F.row_number().over(Window.partitionBy(group, building).orderBy(order)))
    one = F.col("x_place") == 1
    return first.groupBy(group).agg(
        F.countDistinct(site).alias("sites"), F.sum(one.cast("int")).alias("buildings"),
        F.coalesce(F.sum(F.when(one & F.col(counted), F.col(kw))), F.lit(0.0)).alias("dc_kw"), F.bool_or(review).alias("needs_review"),
    )


def scaled_to_units(groups: DataFrame, rows: DataFrame, key: str, units: str, homes: str, kw: str, min_sample: int, most_per_home: float = 20.0) -> DataFrame:
    """Sampled rows scaled by units / homes where the sample is fit for it; else unscaled."""
    w = Window.partitionBy(key)
    ranked = rows.withColumn("x_n", F.count("*").over(w)).withColumn("x_place", F.row_number().over(w.orderBy(F.col(kw) / F.col(homes))) - 1)
    stats = ranked.groupBy(key).agg(
        F.sum(homes).alias("homes"), F.sum(kw).alias("kw"), F.max("x_n").alias("sampled"), F.max(F.col(kw) / F.col(homes)).alias("most"),
        F.max(F.when(F.col("x_place") == F.floor(F.col("x_n") / 4), F.col(kw) / F.col(homes))).alias("lower_quartile"),
    ).withColumnRenamed("homes", "sampled_homes").withColumnRenamed("kw", "sampled_kw")
    joined = groups.join(stats, key)
    fit = (F.col("sampled_homes") < F.col(units)) & (F.col("sampled") >= min_sample) & (F.col("sampled_kw") / F.col("sampled_homes") <= most_per_home) & (F.col("most") <= 3 * F.greatest("lower_quartile", F.lit(0.1)))
    return joined.withColumn("factor", F.when(fit, F.col(units) / F.col("sampled_homes")).otherwise(F.lit(1.0))).withColumn("scaled_kw", F.col("sampled_kw") * F.col("factor"))


def disposition(setback: Column, zone_share: Column, poleward: Column, energy_ratio: Column, least_share: float = 0.95, least_energy: float = 0.6) -> Column:
    """Why a panel is left out, in order; 'kept' if nothing speaks against it."""
    return F.when(setback, "setback").when(zone_share < least_share, "outside_zone").when(poleward, "poleward").when(energy_ratio < least_energy, "low_yield").otherwise("kept")


def disposition_kw(panels: DataFrame, building: str, label: str, area: str, module_area: float, watts: float) -> DataFrame:
    """Modules and kW per building and disposition, by floor division of the summed area."""
    sums = panels.groupBy(building, label).agg(F.sum(area).alias("area"))
    modules = F.floor(F.round(F.col("area"), 6) / module_area)
    return sums.select(building, label, modules.alias("modules"), (modules * watts / 1000).alias("kw"))


def best_design(predictions: DataFrame, designs: DataFrame, key: str, predicted: str, known: str, order: str) -> DataFrame:
    """The design closest to each prediction (the first of equals), and the error against it."""
    pairs = predictions.join(designs.where(F.col(known) > 0), key).withColumn("err", (F.col(predicted) - F.col(known)) / F.col(known))
    best = F.min_by(F.struct(known, "err"), F.struct(F.abs("err").alias("e"), F.col(order).alias("o")))
    return pairs.groupBy(key, predicted).agg(best.alias("x")).select(key, predicted, f"x.{known}", "x.err")


def sweep(samples: DataFrame, scenarios: DataFrame, predicted: str, true: str, tolerance: float = 0.10) -> DataFrame:
    """Per scenario (name, factor; a short list): hits, median errors and floors below -10 %."""
    rows = samples.crossJoin(F.broadcast(scenarios)).withColumn("err", (F.col(predicted) * F.col("factor") - F.col(true)) / F.col(true))
    base = rows.groupBy("scenario").agg(F.count("*").alias("n"), F.sum((F.abs("err") <= tolerance).cast("int")).alias("hits"), F.sum((F.col("err") < -0.1).cast("int")).alias("floors"))
    found = quantiles.with_medians(base, rows.withColumn("abs", F.abs("err")), ["scenario"], {"median_abs": "abs", "median_err": "err"}, few=True)
    return found.select("scenario", "n", "hits", "median_abs", "median_err", "floors")
