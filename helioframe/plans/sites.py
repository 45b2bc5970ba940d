"""From address points and footprints to site rows: match, size, roll up, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.functions import geometry, solar
from helioframe.operators import ordered, packing, rollup, spatial
from helioframe.plans import review

# The default module and layout.
LENGTH_M, WIDTH_M, WATTS = 2.278, 1.134, 550
GAP_M, TILT_DEG, COVERAGE = 0.02, 10.0, 0.90
SEARCH_M = 40.0
NON_ROOF = ["carport", "garage", "garages", "shed", "roof", "parking", "kiosk", "hut"]


def structure_kind(mapped: Column, area: Column, short: Column, long: Column) -> Column:
    """carport_or_garage for mapped, tiny or long narrow structures; else building."""
    narrow = (short < 8.0) & (long / F.greatest(short, F.lit(1e-6)) > 3.5)
    return F.when(F.coalesce(mapped.isin(NON_ROOF), F.lit(False)) | (area < 100.0) | narrow, "carport_or_garage").otherwise("building")


def sized(footprints: DataFrame) -> DataFrame:
    """footprints (bid, ring in metres, class) with area, axes, structure, and a flat-roof layout.

    The layout is a rectangle of the principal axes scaled to the footprint's area, cut by the fire
    perimeter and the section gaps; rows are east-west.
    """
    shaped = footprints.withColumn("area", geometry.area(F.col("ring"))).withColumn("a", packing.axes("ring"))
    edge = 2 * solar.perimeter_m(F.col("a.short"))
    fill = F.least(F.lit(1.0), F.col("area") / (F.col("a.short") * F.col("a.long")))
    width, height = F.col("a.long") - edge, F.col("a.short") * fill - edge
    cuts = geometry.sections(width, 150 * solar.FT, 4 * solar.FT)
    part = (width - (cuts - 1) * 4 * solar.FT) / cuts
    depth = WIDTH_M * F.cos(F.radians(F.lit(TILT_DEG)))
    per_row = F.floor((part + GAP_M) / (LENGTH_M + GAP_M) + 1e-9) * cuts
    rows = F.floor((height - depth) / (WIDTH_M / COVERAGE) + 1e-9) + 1
    modules = F.when((width > 0) & (height > depth), F.greatest(per_row * rows, F.lit(0))).otherwise(0)
    kept = F.when(modules >= 6, modules).otherwise(0)
    return shaped.select(*footprints.columns, "area", structure_kind(F.col("class"), F.col("area"), F.col("a.short"), F.col("a.long")).alias("structure"), kept.cast("int").alias("module_count"), (kept * WATTS / 1000).alias("dc_kw"))


def size_sites(sites: DataFrame, footprints: DataFrame) -> DataFrame:
    """One row per site (site_id, px, py, units, ord): its match, kW, and reasons."""
    estimates = sized(footprints)
    box = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    boxes = footprints.select("bid", "ring", box(F.array_min, "x").alias("xmin"), box(F.array_min, "y").alias("ymin"), box(F.array_max, "x").alias("xmax"), box(F.array_max, "y").alias("ymax"))
    near = spatial.points_near_boxes(sites.select("site_id", "ord", "px", "py"), boxes, SEARCH_M)
    inside = geometry.contains(F.col("ring"), F.col("px"), F.col("py"))
    near = near.withColumn("d", F.when(inside, 0.0).otherwise(geometry.distance(F.col("ring"), F.col("px"), F.col("py")))).where(F.col("d") <= SEARCH_M)
    best = spatial.nearest_with_runner_up(near, "site_id", ["d", "bid"]).select("site_id", "ord", "bid", "d", "runner_up_d")
    claimed = ordered.first_claimant(best, "bid", "site_id", ["ord"]).select("site_id", "bid", "d", "runner_up_d", F.col("reason").alias("claim_reason"))
    joined = sites.join(claimed, "site_id", "left").join(estimates.drop("ring", "class"), "bid", "left")
    counted = joined.withColumn("counted", F.col("bid").isNotNull()).withColumn("review", F.lit(False))
    doubts = review.match_reasons(F.col("d"), F.col("runner_up_d"), F.lit(False))
    per_unit = review.unit_reasons(F.col("dc_kw"), F.col("units"), F.col("area") * 2, F.lit(1))
    every = F.array_distinct(F.concat(doubts, F.array_compact(F.array("claim_reason")), per_unit))
    rolled = rollup.site_rollup(counted, "site_id", "dc_kw", "dc_kw", "module_count", "area", "structure", "counted", "review").drop("needs_review", "buildings")
    rows = counted.select("site_id", "ord", "bid", "d", "structure", every.alias("reasons"))
    return rows.join(rolled, "site_id").withColumn("needs_review", F.size("reasons") > 0)
