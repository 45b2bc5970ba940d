"""Queries of the result files' rows: parts are buildings, suppliers are sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from helioframe.catalog import query, table
from helioframe.plans import projections

BUILDINGS_SQL = """
    b AS (SELECT p_partkey AS ord, p_partkey % 97 + 1 AS site_id, p_partkey % 11 <> 0 AS counted, CASE WHEN p_partkey % 5 = 0 THEN 'carport_or_garage' ELSE 'building' END AS structure,
                 sqrt(p_retailprice) AS dc_kw, sqrt(p_retailprice * 1.7) AS raw_kw, CASE WHEN p_partkey % 13 > 0 THEN p_size * 10 END AS modules, CASE WHEN p_partkey % 13 > 0 THEN sqrt(p_retailprice * 31) END AS gross,
                 CASE WHEN p_partkey % 3 = 0 THEN sqrt(p_size::DOUBLE) END AS north, p_partkey % 4 = 0 AS excluded, sqrt(p_size * 3.0::DOUBLE) AS clearance, sqrt(p_size * 7.0::DOUBLE) AS low, p_partkey % 9 AS raised,
                 list_concat(CASE WHEN p_partkey % 7 = 0 THEN ['methods_disagree_ratio_' || p_size] ELSE [] END, CASE WHEN p_partkey % 6 = 0 THEN ['check_roof'] ELSE [] END, CASE WHEN p_size > 45 THEN ['large_' || p_size // 2] ELSE [] END) AS reasons, p_type, p_size, p_retailprice, p_brand
          FROM part)"""


def buildings(spark, sf_dir):
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    some = lambda condition, reason: F.when(condition, F.array(reason)).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(some(k % 7 == 0, F.concat(F.lit("methods_disagree_ratio_"), size.cast("string"))), some(k % 6 == 0, F.lit("check_roof")), some(size > 45, F.concat(F.lit("large_"), F.floor(size / 2).cast("string"))))
    layout = F.struct((size * 10).cast("long").alias("module_count"), F.sqrt(price * 31).alias("gross_m2"), F.sqrt(price * 23).alias("usable_m2"), F.when(size > 25, "flat").otherwise("pitched").alias("roof_type"), some(k % 8 == 0, F.lit("assumed_flat")).alias("flags"))
    left = F.struct(
        F.when(k % 3 == 0, F.sqrt(size.cast("double"))).alias("poleward_kw"), (k % 4 == 0).alias("poleward_excluded"), F.sqrt(size * 3.0).alias("clearance_kw"), F.sqrt(size * 7.0).alias("low_yield_kw"), (k % 9).alias("raised_modules"),
        F.when(k % 10 > 0, "2023-05-01").alias("imagery_date"),
    )
    return table(spark, sf_dir, "part").select(
        k.alias("ord"), (k % 97 + 1).alias("site_id"), (k % 11 != 0).alias("counted"), F.when(k % 5 == 0, "carport_or_garage").otherwise("building").alias("structure"), k.cast("string").alias("building_id"),
        F.sqrt(price).alias("dc_kw"), F.sqrt(price * 1.7).alias("raw_kw"), F.when(k % 2 == 0, "geometric").otherwise("google").alias("method"), F.sqrt(size / 50.0).alias("calibration_factor"), F.lit("global").alias("calibration_source"),
        F.when(k % 2 == 1, F.sqrt(size / 60.0)).alias("agreement_ratio"), (F.size(reasons) > 0).alias("needs_review"), reasons.alias("reasons"), F.when(k % 13 > 0, layout).alias("primary"), F.sqrt(price * 1.1).alias("geometric_kw"),
        F.when(k % 2 == 1, F.sqrt(price * 1.2)).alias("google_kw"), left.alias("left_out"), F.col("p_brand").alias("overture_id"), F.when(k % 14 > 0, "office").alias("mapped"), F.lit("commercial").alias("occupancy"),
        F.sqrt(size * 2.0).alias("distance_m"), F.when(k % 15 > 0, size / 4).alias("height_m"),
    )


@query("f1_building_rows", f"""
    WITH {BUILDINGS_SQL} SELECT ord::VARCHAR AS building_id, round_even(dc_kw, 2) AS dc_kw, round_even(raw_kw, 2) AS raw_kw, coalesce(modules, 0)::BIGINT AS module_count, CASE WHEN ord % 2 = 0 THEN 'geometric' ELSE 'google' END AS method,
        CASE WHEN ord % 2 = 0 THEN 'geometric' ELSE 'google' END || '|commercial|' || CASE WHEN modules IS NULL THEN '' WHEN p_size > 25 THEN 'flat' ELSE 'pitched' END AS segment, round_even(sqrt(p_size / 50.0::DOUBLE), 4) AS calibration_factor,
        'global' AS calibration_source, round_even(sqrt(p_retailprice * 1.1), 2) AS geometric_kw, CASE WHEN ord % 2 = 1 THEN round_even(sqrt(p_retailprice * 1.2), 2) END AS google_kw, CASE WHEN ord % 2 = 1 THEN round_even(sqrt(p_size / 60.0::DOUBLE), 3) END AS agreement_ratio,
        round_even(gross, 1) AS gross_roof_area_m2, CASE WHEN modules IS NOT NULL THEN round_even(sqrt(p_retailprice * 23), 1) END AS usable_area_m2, CASE WHEN modules IS NULL THEN NULL WHEN p_size > 25 THEN 'flat' ELSE 'pitched' END AS roof_type,
        len(reasons) > 0 AS needs_review, array_to_string(reasons, ';') AS reasons, CASE WHEN modules IS NOT NULL AND ord % 8 = 0 THEN 'assumed_flat' ELSE '' END AS flags FROM b""")
def f1_building_rows(spark, sf_dir):
    return projections.building_rows(buildings(spark, sf_dir))


@query("f2_site_rows", f"""
    WITH {BUILDINGS_SQL},
    t AS (SELECT site_id, count(*) AS n, sum(CASE WHEN counted THEN dc_kw ELSE 0 END) AS kw, sum(dc_kw) AS every, sum(CASE WHEN counted THEN raw_kw ELSE 0 END) AS raw, sum(CASE WHEN counted THEN modules ELSE 0 END) AS modules,
                 sum(CASE WHEN counted AND excluded THEN coalesce(north, 0) ELSE 0 END) AS north, sum(CASE WHEN counted AND modules > 0 THEN raised * dc_kw / modules ELSE 0 END) AS raised, sum(CASE WHEN counted AND structure = 'building' THEN dc_kw ELSE 0 END) AS roof,
                 sum(CASE WHEN counted AND structure <> 'building' THEN dc_kw ELSE 0 END) AS carport, sum(CASE WHEN counted THEN clearance ELSE 0 END) AS clearance, sum(CASE WHEN counted THEN low ELSE 0 END) AS low, sum(CASE WHEN counted THEN coalesce(gross, 0) ELSE 0 END) AS area FROM b GROUP BY site_id),
    r AS (SELECT site_id, ord, generate_subscripts(reasons, 1) AS k, unnest(reasons) AS reason FROM b),
    f AS (SELECT site_id, reason, min(ord * 10 + k) AS place FROM r WHERE NOT starts_with(reason, 'methods_') GROUP BY ALL),
    g AS (SELECT site_id, string_agg(reason, ';' ORDER BY place) AS said FROM f WHERE NOT (site_id % 8 = 0 AND reason = 'check_roof') GROUP BY site_id),
    d AS (SELECT site_id, count(*) AS n_d FROM r WHERE starts_with(reason, 'methods_') GROUP BY site_id),
    s AS (SELECT s.*, t.*, s_suppkey % 4 * 25 AS units, CASE WHEN s_suppkey % 3 = 0 THEN sqrt(abs(s_acctbal) * 50) END AS from_units,
                 concat_ws(';', CASE WHEN s_suppkey % 8 = 0 THEN 'check_roof' END, said, CASE WHEN n_d > 0 THEN 'methods_disagree_on_' || n_d || '_of_' || n || '_buildings' END) AS reasons
          FROM supplier s LEFT JOIN t ON s_suppkey = t.site_id LEFT JOIN g ON s_suppkey = g.site_id LEFT JOIN d ON s_suppkey = d.site_id)
    SELECT s_suppkey AS site_id, 'n' || s_nationkey AS "group", s_name AS address, upper(s_name) AS matched_address, 34.25::DOUBLE AS lat, -118.5::DOUBLE AS lon, 'census:rooftop' AS location_source, 'p' || s_suppkey AS parcel_id,
        nullif(s_suppkey % 5, 0)::DOUBLE AS parcel_acres, coalesce(n, 0) AS buildings, nullif(units, 0)::BIGINT AS units_in_input, round_even(coalesce(kw, 0) / nullif(units, 0), 2) AS kw_per_unit, nullif(s_suppkey % 6, 0)::BIGINT AS units_in_address_data,
        NULL::BIGINT AS units_in_parcel_records, round_even(coalesce(kw, 0), 2) AS dc_kw, round_even(greatest(coalesce(kw, 0), coalesce(from_units, 0)), 2) AS best_estimate_kw, CASE WHEN coalesce(from_units, 0) > coalesce(kw, 0) THEN 'units' ELSE 'roof' END AS estimate_basis,
        round_even(nullif(from_units, 0), 1) AS kw_estimate_from_units, round_even(sqrt(s_suppkey * 11.0::DOUBLE), 1) AS floor_m2_per_unit, CASE WHEN s_suppkey % 7 > 0 THEN 1950 + s_suppkey % 70 END::BIGINT AS year_built, '' AS existing_solar_check,
        round_even(coalesce(raw, 0), 2) AS raw_kw, coalesce(modules, 0)::BIGINT AS module_count, round_even(coalesce(north, 0), 1) AS north_faces_kw_not_counted, round_even(coalesce(kw, 0) + coalesce(raised, 0), 2) AS maxfit_raised_racking_kw,
        round_even(coalesce(roof, 0), 2) AS rooftop_kw, round_even(coalesce(carport, 0), 2) AS carport_kw, round_even(coalesce(clearance, 0), 1) AS equipment_clearance_kw_not_counted, round_even(coalesce(low, 0), 1) AS low_yield_kw_not_counted,
        round_even(coalesce(every, 0) - coalesce(kw, 0), 1) AS uncounted_buildings_kw, round_even(coalesce(area, 0), 1) AS roof_area_m2, s_suppkey % 9 = 0 AS manual_review, CASE WHEN s_suppkey % 9 = 0 THEN 'far_from_address' ELSE '' END AS manual_review_reason,
        reasons <> '' AS needs_review, reasons FROM s""")
def f2_site_rows(spark, sf_dir):
    k = F.col("s_suppkey")
    some = lambda condition, reason: F.when(condition, F.array(F.lit(reason))).otherwise(F.array().cast("array<string>"))
    sites = table(spark, sf_dir, "supplier").select(
        k.alias("site_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("group"), F.col("s_name").alias("address"), F.upper("s_name").alias("matched_address"), F.lit(34.25).alias("lat"), F.lit(-118.5).alias("lon"),
        F.lit("census").alias("source"), F.lit("rooftop").alias("precision"), F.concat(F.lit("p"), k.cast("string")).alias("parcel_id"), (k % 5).cast("double").alias("parcel_acres"), (k % 4 * 25).alias("units"), (k % 6).alias("listed_units"),
        F.lit(None).cast("long").alias("parcel_units"), F.when(k % 3 == 0, F.sqrt(F.abs("s_acctbal") * 50)).alias("units_estimate_kw"), F.sqrt(k * 11.0).alias("floor_m2_per_unit"), F.when(k % 7 > 0, 1950 + k % 70).alias("year_built"), F.lit("").alias("solar_check"),
        some(k % 8 == 0, "check_roof").alias("reasons"), some(k % 9 == 0, "far_from_address").alias("manual_review"),
    )
    return projections.site_rows(sites, buildings(spark, sf_dir))


@query("f3_site_building_rows", f"""
    WITH {BUILDINGS_SQL} SELECT site_id, counted, ord::VARCHAR AS building_id, round_even(dc_kw, 2) AS dc_kw, round_even(raw_kw, 2) AS raw_kw, coalesce(modules, 0)::BIGINT AS module_count, CASE WHEN ord % 2 = 0 THEN 'geometric' ELSE 'google' END AS method,
        array_to_string(reasons, ';') AS reasons, structure, p_brand AS overture_id, CASE WHEN ord % 14 > 0 THEN 'office' END AS overture_class, 'commercial' AS occupancy, round_even(sqrt(p_size * 2.0::DOUBLE), 1) AS distance_from_address_m,
        CASE WHEN ord % 15 > 0 THEN p_size / 4 END::DOUBLE AS height_m, CASE WHEN ord % 10 > 0 THEN '2023-05-01' END AS google_imagery_date FROM b""")
def f3_site_building_rows(spark, sf_dir):
    """The columns that the building rows don't have, and some that they do."""
    rows = projections.site_building_rows(buildings(spark, sf_dir))
    return rows.select("site_id", "counted", "building_id", "dc_kw", "raw_kw", "module_count", "method", "reasons", "structure", "overture_id", "overture_class", "occupancy", "distance_from_address_m", "height_m", "google_imagery_date")
