"""Review rules: each is a reason code and a condition; codes come in the order of the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bounds of the rules.
AGREEMENT = (0.70, 1.05)
MIN_KW = 1.0
FAR_M, TIE_M = 25.0, 10.0
COVERAGE = 0.25
STALE_YEARS = 6
LEAST_KW_PER_UNIT, MOST_KW_PER_UNIT = 0.1, 4.0
LEAST_FLOOR_M2 = 15.0
KW_PER_UNIT = 1.7


def reasons(*rules: tuple[Column, Column | str]) -> Column:
    """The codes whose conditions hold (null does not), in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(condition, code if isinstance(code, Column) else F.lit(code)) for condition, code in rules))))


def numbered(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def building_reasons(geometric_kw: Column, google_kw: Column, google_flags: Column, calibrated: Column, dc_kw: Column) -> Column:
    """Why one building's estimate needs a person."""
    ratio = F.try_divide(google_kw, geometric_kw)
    usable = google_kw > 0
    flags = F.when(F.size(google_flags) > 0, F.array_join(google_flags, ",")).otherwise("zero_panels")
    return reasons(
        (usable & ~ratio.between(*AGREEMENT), numbered("methods_disagree_ratio_%.2f", ratio)),
        (google_kw.isNotNull() & ~usable, F.concat(F.lit("google_unusable:"), flags)),
        (google_kw.isNull(), "single_method_no_obstruction_data"),
        (~calibrated, "uncalibrated"),
        (dc_kw < MIN_KW, "no_usable_roof_area"),
    )


def match_reasons(distance_m: Column, runner_up_m: Column, from_parcel: Column) -> Column:
    """Doubts about which building an address point means."""
    tie = (distance_m > 0) & (runner_up_m - distance_m < TIE_M)
    return reasons(
        (distance_m.isNull() & ~from_parcel, "no_building_within_40m"),
        (~from_parcel & (distance_m > FAR_M), numbered("address_point_%.0fm_from_building_check_match", distance_m)),
        (~from_parcel & tie, "two_buildings_equally_close_check_match"),
    )


def manual_review(buildings: Column, reason_codes: Column, covered_share: Column, imagery: Column, age_years: Column) -> Column:
    """What a person must look at before a site's figure is used."""
    doubtful = F.exists(reason_codes, lambda r: r.endswith("_check_match") | r.startswith("no_building_within"))
    return reasons(
        (buildings == 0, "no_building_found"),
        ((buildings > 0) & doubtful, "building_match_uncertain"),
        ((buildings > 0) & covered_share.isNull(), "no_google_imagery_sized_from_outline"),
        (covered_share < COVERAGE, F.concat(F.lit("google_sees_"), F.format_number(covered_share * 100, "0"), F.lit("%_of_footprint_capacity"))),
        (age_years > STALE_YEARS, F.concat(F.lit("google_imagery_"), imagery, F.lit("_"), F.format_number(F.floor(age_years), "0"), F.lit("_years_old"))),
    )


def unit_reasons(dc_kw: Column, units: Column, floor_m2: Column, buildings: Column) -> Column:
    """Figures per home that point to missing or wrong buildings."""
    per_unit, floor_per_unit = F.try_divide(dc_kw, units), F.try_divide(floor_m2, units)
    return reasons(
        (per_unit < LEAST_KW_PER_UNIT, numbered("only_%.2f_kw_per_unit_buildings_likely_missing", per_unit)),
        ((per_unit > MOST_KW_PER_UNIT) & (buildings == 1), numbered("one_building_%.1f_kw_per_unit_check_match", per_unit)),
        (floor_per_unit < LEAST_FLOOR_M2, numbered("buildings_found_hold_%.0f_m2_floor_per_unit_estimated_1.7_kw_per_unit", floor_per_unit)),
    )


def best_estimate(dc_kw: Column, units: Column, floor_m2: Column) -> Column:
    """kW and its basis: from units where too little building was found, else from roofs."""
    short = F.try_divide(floor_m2, units) < LEAST_FLOOR_M2
    return F.struct(F.when(short, units * KW_PER_UNIT).otherwise(dc_kw).alias("best_estimate_kw"), F.when(short, "units").otherwise("roofs").alias("estimate_basis"))


def storeys(height_m: Column) -> Column:
    """At least one storey of 3.3 m, half-even; two where the height is unknown."""
    return F.when(height_m.isNull(), 2.0).otherwise(F.greatest(F.lit(1.0), F.bround(height_m / 3.3, 0)))


def demoted(manual: Column, harmless: list[str]) -> Column:
    """The manual-review codes that start with none of the harmless prefixes."""
    return F.filter(manual, lambda r: ~F.array_contains(F.transform(F.array(*(F.lit(h) for h in harmless)), lambda h: r.startswith(h)), True))


def pin_quality(buildings: Column, doubtful: Column, floor_m2_per_unit: Column) -> Column:
    """0 nothing found, 1 doubtful, 2 plausible."""
    return F.when(buildings == 0, 0).when(doubtful | F.coalesce(floor_m2_per_unit < LEAST_FLOOR_M2, F.lit(False)), 1).otherwise(2)


def repinned(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One round of re-pinning: the new outcome where its pin_quality is better, else the old one."""
    new = after.select(F.col(key).alias("x_key"), F.col("pin_quality").alias("x_quality"), F.struct(*before.columns).alias("x_row"))
    joined = before.join(new, F.col(key) == F.col("x_key"), "left")
    better = F.coalesce(F.col("x_quality") > F.col("pin_quality"), F.lit(False))
    return joined.select(*(F.when(better, F.col("x_row")[c]).otherwise(F.col(c)).alias(c) for c in before.columns))
