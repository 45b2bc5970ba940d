"""Queries of the site flow: attachment, comparison with truth, per-unit figures, screening, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from helioframe.catalog import CELLS_SQL, PLACES_SQL, cells, near_boxes, query, table
from helioframe.functions import solar, text
from helioframe.operators import ordered, stateful
from helioframe.plans import review, sites


@query("f5_structure_kind", """
    WITH p AS (SELECT p_partkey, p_size * 20.0 AS area, p_size / 3.0 AS short, p_retailprice / 30 AS long, CASE WHEN p_brand = 'Brand#2' THEN 'garage' END AS cls FROM part)
    SELECT p_partkey, CASE WHEN cls = 'garage' OR area < 100 OR (short < 8 AND long / short > 3.5) THEN 'carport_or_garage' ELSE 'building' END AS structure FROM p""")
def f5_structure_kind(spark, sf_dir):
    size = F.col("p_size")
    kind = sites.structure_kind(F.when(F.col("p_brand") == "Brand#2", "garage"), size * 20.0, size / 3.0, F.col("p_retailprice") / 30)
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("structure"))


@query("f8_equipment_screen", """
    WITH e AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity / 20 AS short, l_quantity / 10 AS long, l_quantity / 60 AS area, l_discount * 10 AS compactness, l_suppkey % 5 AS flat, l_suppkey % 3 AS pitched FROM lineitem)
    SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN area < 0.5 THEN 'small_equipment' ELSE 'equipment' END AS kind FROM e
    WHERE NOT (short < 0.6 OR (long > 4 AND long / short > 4) OR area > 40 OR compactness < 0.3 OR pitched > flat)""")
def f8_equipment_screen(spark, sf_dir):
    q = F.col("l_quantity")
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (q / 20).alias("short"), (q / 10).alias("long"), (q / 60).alias("area"), (F.col("l_discount") * 10).alias("compactness"), (F.col("l_suppkey") % 5).alias("flat"), (F.col("l_suppkey") % 3).alias("pitched"))
    return stateful.equipment_screen(found, "short", "long", "area", "compactness", "flat", "pitched").select("l_orderkey", "l_partkey", "l_linenumber", "kind")


@query("f19_m3_slopes", """
    SELECT p_partkey, abs((((p_size * 13 % 360) - 0 + 180) % 360) - 180) < 45 AS poleward, round(CASE WHEN p_size % 2 = 0 THEN 1.134 + 0.02 ELSE 1.134 / 0.9 END, 6)::DOUBLE AS pitch FROM part""")
def f19_m3_slopes(spark, sf_dir):
    racking = F.when(F.col("p_size") % 2 == 0, "flush").otherwise("east_west")
    pitch = solar.flat_row_pitch(racking, F.lit(1.134), F.lit(10.0), F.lit(34.0), 0.9)
    return table(spark, sf_dir, "part").select("p_partkey", solar.poleward((F.col("p_size") * 13 % 360).cast("double"), F.lit(34.0)).alias("poleward"), F.round(pitch, 6).alias("pitch"))


@query("j9_parent_child", """
    SELECT o_orderkey, count(l_partkey) AS children, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def j9_parent_child(spark, sf_dir):
    parents, children = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    orphans = children.join(parents, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("orphans"))
    counts = parents.join(children, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_partkey").alias("children"))
    return counts.crossJoin(F.broadcast(orphans))


@query("j11_truth_comparison", """
    WITH p AS (SELECT o_custkey, sum(o_totalprice) AS kw FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
    SELECT c_custkey, CASE WHEN kw IS NULL THEN 'not run' ELSE 'run' END AS state, round((kw - c_acctbal * 100) / (c_acctbal * 100), 4) AS err
    FROM customer LEFT JOIN p ON c_custkey = o_custkey WHERE c_acctbal > 0""")
def j11_truth_comparison(spark, sf_dir):
    predicted = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("kw"))
    truth = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    known = F.col("c_acctbal") * 100
    joined = truth.join(predicted, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.when(F.col("kw").isNull(), "not run").otherwise("run").alias("state"), F.round((F.col("kw") - known) / known, 4).alias("err"))


@query("j15_same_owner", r"""
    WITH s AS (SELECT s_suppkey, s_nationkey, 'The Fund ' || (s_suppkey % 7) || CASE WHEN s_suppkey % 2 = 0 THEN ', L.L.C.' ELSE ' LP' END AS owner FROM supplier)
    SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND a.s_suppkey % 7 = b.s_suppkey % 7""")
def j15_same_owner(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    owner = F.concat(F.lit("The Fund "), (F.col("s_suppkey") % 7).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ", L.L.C.").otherwise(" LP"))
    named = s.select("s_suppkey", "s_nationkey", text.owner_name(owner).alias("owner"))
    a, b = named.withColumnRenamed("s_suppkey", "a"), named.withColumnRenamed("s_suppkey", "b")
    return a.join(b, ["s_nationkey", "owner"]).where("a < b").select("a", "b")


@query("j19_segment_by_index", """
    WITH s AS (SELECT o_orderkey, [o_orderkey % 30, o_custkey % 30, o_custkey % 7] AS pitch FROM orders)
    SELECT l_orderkey, l_partkey, l_linenumber, coalesce(pitch[l_linenumber], 0)::BIGINT AS pitch FROM lineitem LEFT JOIN s ON l_orderkey = o_orderkey""")
def j19_segment_by_index(spark, sf_dir):
    segments = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_orderkey") % 30, F.col("o_custkey") % 30, F.col("o_custkey") % 7).alias("segments"))
    panels = table(spark, sf_dir, "lineitem").join(segments, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return panels.select("l_orderkey", "l_partkey", "l_linenumber", F.coalesce(F.try_element_at("segments", F.col("l_linenumber")), F.lit(0)).alias("pitch"))


@query("j25_nearest_qualifying", f"""
    WITH {PLACES_SQL} SELECT pid, bid, round(d, 4) AS d FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, bid) AS k FROM hits WHERE area >= 150 AND cx < cy) WHERE k = 1""")
def j25_nearest_qualifying(spark, sf_dir):
    hits = near_boxes(spark, sf_dir, 1, "(xmax - xmin) * (ymax - ymin) >= 150 and (xmin + xmax) / 2 < (ymin + ymax) / 2")[0]
    return ordered.first_by_key(hits, ["pid"], ["d", "bid"]).select("pid", "bid", F.round("d", 4).alias("d"))


@query("j26_points_to_new_buildings", f"""
    WITH {PLACES_SQL}, f AS (SELECT pid, bid, row_number() OVER (PARTITION BY pid ORDER BY d, d_center, bid) AS k FROM hits WHERE d <= 3),
    have AS (SELECT bid FROM boxes WHERE (xmax - xmin) * (ymax - ymin) < 100)
    SELECT bid, min(pid) AS first_point FROM f WHERE k = 1 AND bid NOT IN (SELECT bid FROM have) GROUP BY bid""")
def j26_points_to_new_buildings(spark, sf_dir):
    hits, boxes = near_boxes(spark, sf_dir)
    have = boxes.where("(xmax - xmin) * (ymax - ymin) < 100").select("bid")
    first = ordered.first_by_key(hits.where("d <= 3"), ["pid"], ["d", "d_center", "bid"])
    return first.join(have, "bid", "left_anti").groupBy("bid").agg(F.min("pid").alias("first_point"))


@query("a9_histogram", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def a9_histogram(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("a14_distinct_units", "SELECT l_orderkey, nullif(count(DISTINCT CASE WHEN l_linenumber > 2 THEN l_linenumber || '/' || l_suppkey END), 0) AS units FROM lineitem GROUP BY l_orderkey")
def a14_distinct_units(spark, sf_dir):
    pair = F.when(F.col("l_linenumber") > 2, F.struct("l_linenumber", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.nullif(F.count_distinct(pair), F.lit(0)).alias("units"))


@query("a15_floor_area", """
    WITH f AS (SELECT o_custkey, o_totalprice / 100 AS area, CASE WHEN o_orderkey % 4 = 0 THEN 2.0 ELSE greatest(1, round_even((o_orderkey % 20)::DOUBLE / 3.3, 0)) END AS storeys, o_custkey % 90 + 1 AS units FROM orders)
    SELECT o_custkey, round(sum(area * storeys), 2) AS floor_m2, CASE WHEN sum(area * storeys) / max(units) < 15 THEN 'units' ELSE 'roofs' END AS estimate_basis FROM f GROUP BY o_custkey""")
def a15_floor_area(spark, sf_dir):
    height = F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 20).cast("double"))
    rows = table(spark, sf_dir, "orders").withColumn("floor", F.col("o_totalprice") / 100 * review.storeys(height))
    sums = rows.groupBy("o_custkey").agg(F.sum("floor").alias("floor_m2"), F.max(F.col("o_custkey") % 90 + 1).alias("units"))
    basis = review.best_estimate(F.lit(1.0), F.col("units"), F.col("floor_m2"))["estimate_basis"]
    return sums.select("o_custkey", F.round("floor_m2", 2).alias("floor_m2"), basis.alias("estimate_basis"))


@query("a17_area_by_coverage", """
    SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END), 2) AS with_data, round(sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END), 2) AS without_data,
    sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END) > 1.5 * sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS mostly_outlines FROM lineitem GROUP BY l_suppkey""")
def a17_area_by_coverage(spark, sf_dir):
    seen = F.col("l_returnflag") == "N"
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(seen, F.col("l_quantity")).otherwise(0.0)).alias("a"), F.sum(F.when(~seen, F.col("l_quantity")).otherwise(0.0)).alias("b"))
    return sums.select("l_suppkey", F.round("a", 2).alias("with_data"), F.round("b", 2).alias("without_data"), (F.col("b") > 1.5 * F.col("a")).alias("mostly_outlines"))


@query("a20_comparison_rows", """
    WITH u AS (SELECT o_orderkey, unnest([1, 2, 3]) AS k, o_totalprice, o_custkey FROM orders), v AS (SELECT o_orderkey, k, o_totalprice * (0.8 + k * 0.1) AS kw, o_totalprice AS known FROM u)
    SELECT o_orderkey, max(CASE WHEN k = 1 THEN round((kw - known) / known, 4) END)::DOUBLE AS tool_err, max(CASE WHEN k = 2 THEN round((kw - known) / known, 4) END)::DOUBLE AS raised_err, max(CASE WHEN k = 3 THEN round((kw - known) / known, 4) END)::DOUBLE AS google_err FROM v GROUP BY o_orderkey""")
def a20_comparison_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("known"), *((F.col("o_totalprice") * (0.8 + k * 0.1)).alias(n) for k, n in ((1, "tool"), (2, "raised"), (3, "google"))))
    long = o.unpivot(["o_orderkey", "known"], ["tool", "raised", "google"], "label", "kw").withColumn("err", F.round((F.col("kw") - F.col("known")) / F.col("known"), 4))
    wide = long.groupBy("o_orderkey").pivot("label", ["tool", "raised", "google"]).agg(F.first("err"))
    return wide.select("o_orderkey", *(F.col(n).alias(f"{n}_err") for n in ("tool", "raised", "google")))


@query("t5_subset_test", "SELECT o_custkey, bool_and(o_orderpriority IN ('1-URGENT', '5-LOW', '2-HIGH')) AS all_known FROM orders GROUP BY o_custkey")
def t5_subset_test(spark, sf_dir):
    known = F.array(F.lit("1-URGENT"), F.lit("5-LOW"), F.lit("2-HIGH"))
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("s"))
    return sets.select("o_custkey", (F.size(F.array_except("s", known)) == 0).alias("all_known"))


@query("w13_budget", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 10")
def w13_budget(spark, sf_dir):
    return stateful.budgeted(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 10).select("user_id", "event_id")


@query("j18_covering_points")
def j18_covering_points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("building"), F.col("vec_id").alias("ord"), (F.col("embedding")[0].cast("double") * 1000).alias("x"), (F.col("embedding")[1].cast("double") * 1000).alias("y"))
    return stateful.covering_points(e, "building", "x", "y", 60.0, 9).select("building", "pick", "ord")


@query("a23_raster_components", f"""
    WITH RECURSIVE {CELLS_SQL}, on_ AS (SELECT raster, r, c, r * 1048576 + c AS id FROM cells WHERE z > 45),
    walk(raster, id, label) AS (SELECT raster, id, id FROM on_ UNION SELECT o.raster, o.id, w.label FROM walk w JOIN on_ o ON o.raster = w.raster
        AND o.id IN (w.id + 1, w.id - 1, w.id + 1048576, w.id - 1048576) AND w.label < o.id),
    l AS (SELECT raster, id, min(label) AS label FROM walk GROUP BY ALL)
    SELECT raster, label, count(*) AS cells FROM l GROUP BY ALL HAVING count(*) >= 2""")
def a23_raster_components(spark, sf_dir):
    return stateful.raster_components(cells(spark, sf_dir).where("z > 45"), "raster", "r", "c", 2).select("raster", "label", "cells")


@query("l6_seeded_sample")
def l6_seeded_sample(spark, sf_dir):
    """A repeatable sample of 40 designs, as the accuracy command draws it."""
    return table(spark, sf_dir, "orders").orderBy(F.xxhash64(F.lit(0), F.col("o_orderkey")), "o_orderkey").limit(40).select("o_orderkey", "o_totalprice")
