"""The rows of the result files: buildings, sites, and the buildings of sites. Missing values are null here, blank in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.operators.calibration import segment_key

#: What a building's estimate brings: a layout (primary), the kW of both methods, and what one of them left out.
ESTIMATE = (
    "building_id string, dc_kw double, raw_kw double, method string, calibration_factor double, calibration_source string, agreement_ratio double, needs_review boolean, reasons array<string>, "
    "primary struct<module_count: bigint, gross_m2: double, usable_m2: double, roof_type: string, flags: array<string>>, geometric_kw double, google_kw double"
)
LEFT_OUT = "left_out struct<poleward_kw: double, poleward_excluded: boolean, clearance_kw: double, low_yield_kw: double, raised_modules: bigint, imagery_date: string>"
DISAGREE = "methods_disagree_ratio_"

# The columns of the result files, in order.
BUILDING_COLUMNS = [
    "building_id", "dc_kw", "raw_kw", "module_count", "method", "segment", "calibration_factor", "calibration_source", "geometric_kw", "google_kw", "agreement_ratio",
    "gross_roof_area_m2", "usable_area_m2", "roof_type", "needs_review", "reasons", "flags",
]
SITE_COLUMNS = [
    "site_id", "group", "address", "matched_address", "lat", "lon", "location_source", "parcel_id", "parcel_acres", "buildings", "units_in_input", "kw_per_unit", "units_in_address_data",
    "units_in_parcel_records", "dc_kw", "best_estimate_kw", "estimate_basis", "kw_estimate_from_units", "floor_m2_per_unit", "year_built", "existing_solar_check", "raw_kw", "module_count",
    "north_faces_kw_not_counted", "maxfit_raised_racking_kw", "rooftop_kw", "carport_kw", "equipment_clearance_kw_not_counted", "low_yield_kw_not_counted", "uncounted_buildings_kw",
    "roof_area_m2", "manual_review", "manual_review_reason", "needs_review", "reasons",
]
SITE_BUILDING_COLUMNS = ["site_id", "counted", *BUILDING_COLUMNS, "structure", "overture_id", "overture_class", "occupancy", "distance_from_address_m", "height_m", "google_imagery_date"]


def listed(reasons: Column) -> Column:
    return F.array_join(F.coalesce(reasons, F.array().cast("array<string>")), ";")


def building_values() -> dict[str, Column]:
    """The building columns from an estimate's (see ESTIMATE) and its occupancy."""
    known = lambda c: F.col(f"primary.{c}")
    values = {
        "building_id": F.col("building_id"), "dc_kw": F.bround("dc_kw", 2), "raw_kw": F.bround("raw_kw", 2), "module_count": F.coalesce(known("module_count"), F.lit(0)), "method": F.col("method"),
        "segment": segment_key("method", "occupancy", F.coalesce(known("roof_type"), F.lit(""))), "calibration_factor": F.bround("calibration_factor", 4), "calibration_source": F.col("calibration_source"),
        "geometric_kw": F.bround("geometric_kw", 2), "google_kw": F.bround("google_kw", 2), "agreement_ratio": F.bround("agreement_ratio", 3), "gross_roof_area_m2": F.bround(known("gross_m2"), 1),
        "usable_area_m2": F.bround(known("usable_m2"), 1), "roof_type": known("roof_type"), "needs_review": F.col("needs_review"), "reasons": listed(F.col("reasons")), "flags": listed(known("flags")),
    }
    return {c: values[c] for c in BUILDING_COLUMNS}


def building_rows(estimates: DataFrame) -> DataFrame:
    return estimates.select(*[v.alias(c) for c, v in building_values().items()])


def site_building_rows(buildings: DataFrame) -> DataFrame:
    """Rows of sites' buildings: an estimate's columns, LEFT_OUT, site_id, counted, structure, overture_id, mapped, occupancy, distance_m, height_m."""
    values = building_values() | {
        "site_id": F.col("site_id"), "counted": F.coalesce("counted", F.lit(True)), "structure": F.col("structure"), "overture_id": F.col("overture_id"), "overture_class": F.col("mapped"),
        "occupancy": F.col("occupancy"), "distance_from_address_m": F.bround("distance_m", 1), "height_m": F.col("height_m"), "google_imagery_date": F.col("left_out.imagery_date"),
    }
    return buildings.select(*[values[c].alias(c) for c in SITE_BUILDING_COLUMNS])


def site_rows(sites: DataFrame, buildings: DataFrame) -> DataFrame:
    """A row per site, with totals over its counted buildings and all reasons once, in order.

    sites: site_id, group, address, matched_address, lat, lon, source, precision, parcel_id, parcel_acres, units, listed_units,
    parcel_units, units_estimate_kw, floor_m2_per_unit, year_built, solar_check, reasons, manual_review. buildings: as of
    site_building_rows, and ord, their order within the site. Sites without buildings have zeros. Buildings on which the
    two methods disagree make one reason, with their number if there are several buildings.
    """
    counted = F.coalesce("counted", F.lit(True))
    roof = counted & (F.col("structure") == "building")
    total = lambda condition, value: F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))
    per_module = F.coalesce(F.try_divide(F.col("dc_kw"), F.col("primary.module_count")), F.lit(0.0))
    out = lambda c: F.coalesce(F.col(f"left_out.{c}"), F.lit(0))
    said = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("reasons", F.array().cast("array<string>")).alias("r")))), lambda x: x["r"]))
    sums = buildings.groupBy("site_id").agg(
        F.count("*").alias("b_n"), total(counted, F.col("dc_kw")).alias("b_kw"), F.sum("dc_kw").alias("b_all"), total(counted, F.col("raw_kw")).alias("b_raw"),
        F.coalesce(F.sum(F.when(counted, F.col("primary.module_count"))), F.lit(0)).alias("b_modules"), total(counted & F.col("left_out.poleward_excluded"), out("poleward_kw")).alias("b_north"),
        total(counted, out("raised_modules") * per_module).alias("b_raised"), total(roof, F.col("dc_kw")).alias("b_roof"), total(counted & ~roof, F.col("dc_kw")).alias("b_carport"),
        total(counted, out("clearance_kw")).alias("b_clearance"), total(counted, out("low_yield_kw")).alias("b_low"), total(counted, F.col("primary.gross_m2")).alias("b_area"), said.alias("b_said"),
    )
    rows = sites.join(sums, "site_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    kw, few = zero("b_kw"), F.coalesce("units_estimate_kw", F.lit(0.0))
    own, others = F.coalesce("reasons", F.array().cast("array<string>")), F.coalesce("b_said", F.array().cast("array<string>"))
    disagree = F.filter(others, lambda r: r.startswith(DISAGREE))
    more = F.filter(F.array_distinct(others), lambda r: ~r.startswith(DISAGREE) & ~F.array_contains(own, r))
    n = F.size(disagree)
    one = F.when((n == 1) & (F.col("b_n") == 1), F.get(disagree, F.lit(0))).when(n > 0, F.concat(F.lit("methods_disagree_on_"), n.cast("string"), F.lit("_of_"), F.col("b_n").cast("string"), F.lit("_buildings")))
    every = F.array_compact(F.concat(own, more, F.array(one)))
    some = lambda c: F.when(F.col(c) != 0, F.col(c))
    values = {
        "lat": F.bround("lat", 7), "lon": F.bround("lon", 7), "location_source": F.concat("source", F.lit(":"), "precision"), "parcel_acres": some("parcel_acres"),
        "buildings": F.coalesce("b_n", F.lit(0)), "units_in_input": some("units"), "kw_per_unit": F.bround(F.try_divide(kw, some("units")), 2), "units_in_address_data": some("listed_units"), "units_in_parcel_records": some("parcel_units"),
        "dc_kw": F.bround(kw, 2), "best_estimate_kw": F.bround(F.greatest(kw, few), 2), "estimate_basis": F.when(few > kw, "units").otherwise("roof"), "kw_estimate_from_units": F.bround(some("units_estimate_kw"), 1),
        "floor_m2_per_unit": F.bround("floor_m2_per_unit", 1), "year_built": some("year_built"), "existing_solar_check": F.col("solar_check"), "raw_kw": F.bround(zero("b_raw"), 2), "module_count": F.coalesce("b_modules", F.lit(0)),
        "north_faces_kw_not_counted": F.bround(zero("b_north"), 1), "maxfit_raised_racking_kw": F.bround(kw + zero("b_raised"), 2), "rooftop_kw": F.bround(zero("b_roof"), 2), "carport_kw": F.bround(zero("b_carport"), 2),
        "equipment_clearance_kw_not_counted": F.bround(zero("b_clearance"), 1), "low_yield_kw_not_counted": F.bround(zero("b_low"), 1), "uncounted_buildings_kw": F.bround(zero("b_all") - kw, 1), "roof_area_m2": F.bround(zero("b_area"), 1),
        "manual_review": F.size(F.coalesce("manual_review", F.array())) > 0, "manual_review_reason": listed(F.col("manual_review")), "needs_review": F.size(every) > 0, "reasons": F.array_join(every, ";"),
    }
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in SITE_COLUMNS])
