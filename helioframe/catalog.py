"""All registered queries of the library's own operators, with the SQL that checks them.

The star schema stands in for the domain: parts are buildings, suppliers and customers are sites, line
items are samples or panels, events are raster cells and numbered points, embeddings are coordinates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.functions import geometry, solar, text
from helioframe.operators import addresses, calibration, ordered, quantiles, rollup, spatial

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- calibration and accuracy --------------------------------------------------------------------

SAMPLES_SQL = """
    samples AS (SELECT l_orderkey, l_discount, p_brand || '|' || p_type || '|' || l_returnflag AS segment, p_brand AS brand,
                       p_retailprice * l_quantity AS predicted, l_extendedprice AS known
                FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_discount", calibration.segment_key("p_brand", "p_type", "l_returnflag").alias("segment"), F.col("p_brand").alias("brand"), (F.col("p_retailprice") * F.col("l_quantity")).alias("predicted"), F.col("l_extendedprice").alias("known"))


@query("a1_accuracy", f"""
    WITH {SAMPLES_SQL}, e AS (SELECT brand, (predicted - known) / known AS e, abs((predicted - known) / known) AS ae FROM samples WHERE known > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY ae) - 1 AS k, count(*) OVER (PARTITION BY brand) AS n FROM e)
    SELECT brand, count(*) AS n, round(avg(CASE WHEN ae <= 0.1 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS within, round(median(ae), 6) AS median_abs, round(avg(ae), 6) AS mean_abs,
           round(median(e), 6) AS median_signed, round(max(CASE WHEN k = round_even(0.9::DOUBLE * (n - 1), 0)::BIGINT THEN ae END), 6) AS p90_abs
    FROM r GROUP BY brand""")
def a1_accuracy(spark, sf_dir):
    out = calibration.accuracy(samples(spark, sf_dir), "predicted", "known", ["brand"])
    return out.select("brand", "n", *(F.round(c, 6).alias(c) for c in ("within", "median_abs", "mean_abs", "median_signed", "p90_abs")))


@query("a2_calibration_fit", f"""
    WITH {SAMPLES_SQL}, r AS (SELECT segment, known / predicted AS ratio FROM samples WHERE predicted > 0 AND known > 0)
    SELECT segment, round(median(ratio), 6) AS factor, count(*) AS n, round((SELECT median(ratio) FROM r), 6) AS global_factor
    FROM r GROUP BY segment HAVING count(*) >= 5""")
def a2_calibration_fit(spark, sf_dir):
    factors, overall = calibration.fit(samples(spark, sf_dir), "predicted", "known", "segment")
    return factors.select("segment", F.round("factor", 6).alias("factor"), "n", F.round(F.lit(overall), 6).alias("global_factor"))


@query("j21_calibration_lookup", f"""
    WITH {SAMPLES_SQL}, r AS (SELECT segment, known / predicted AS ratio FROM samples WHERE predicted > 0 AND known > 0),
    f AS (SELECT segment, median(ratio) AS factor FROM r GROUP BY segment HAVING count(*) >= 40)
    SELECT brand, coalesce(CASE WHEN factor IS NOT NULL THEN 'segment' END, 'global') AS calibration_source, count(*) AS n,
           round(sum(predicted * coalesce(factor, (SELECT median(ratio) FROM r))), 1) AS calibrated
    FROM samples LEFT JOIN f USING (segment) GROUP BY ALL""")
def j21_calibration_lookup(spark, sf_dir):
    rows = samples(spark, sf_dir)
    factors, overall = calibration.fit(rows, "predicted", "known", "segment", 40)
    found = calibration.with_factor(rows, factors, overall, "segment")
    return found.groupBy("brand", "calibration_source").agg(F.count("*").alias("n"), F.round(F.sum(F.col("predicted") * F.col("calibration_factor")), 1).alias("calibrated"))


@query("a3_cross_validation", f"""
    WITH {SAMPLES_SQL}, s AS (SELECT *, l_orderkey % 5 AS fold FROM samples),
    r AS (SELECT segment, fold, known / predicted AS ratio FROM s WHERE predicted > 0 AND known > 0),
    k AS (SELECT unnest(range(5)) AS fold),
    f AS (SELECT k.fold, segment, median(ratio) AS factor FROM r JOIN k ON r.fold <> k.fold GROUP BY ALL HAVING count(*) >= 5),
    g AS (SELECT k.fold, median(ratio) AS factor FROM r JOIN k ON r.fold <> k.fold GROUP BY ALL),
    c AS (SELECT s.fold, abs(predicted * coalesce(f.factor, g.factor) - known) / known AS ae FROM s LEFT JOIN f ON s.fold = f.fold AND s.segment = f.segment JOIN g ON s.fold = g.fold WHERE known > 0)
    SELECT fold, count(*) AS n, round(median(ae), 6) AS median_abs, round(avg(ae), 6) AS mean_abs FROM c GROUP BY fold""")
def a3_cross_validation(spark, sf_dir):
    rows = calibration.cross_validate(samples(spark, sf_dir), "predicted", "known", "segment", "l_orderkey")
    ae = F.abs(calibration.signed_error("calibrated", "known"))
    rows = rows.where("known > 0").withColumn("ae", ae)
    base = rows.groupBy("fold").agg(F.count("*").alias("n"), F.avg("ae").alias("mean_abs"))
    return quantiles.with_medians(base, rows, ["fold"], {"median_abs": "ae"}).select("fold", "n", F.round("median_abs", 6).alias("median_abs"), F.round("mean_abs", 6).alias("mean_abs"))


@query("a26_auto_accept", f"""
    WITH {SAMPLES_SQL}, e AS (SELECT brand, l_discount < 0.05 AS ok, abs((predicted - known) / known) AS ae FROM samples WHERE known > 0)
    SELECT brand, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS auto_accept_rate, count(*) AS n_all, round(median(ae), 6) AS median_abs_all,
           count(*) FILTER (WHERE ok) AS n_accepted, round(median(ae) FILTER (WHERE ok), 6) AS median_abs_accepted
    FROM e GROUP BY brand""")
def a26_auto_accept(spark, sf_dir):
    out = calibration.auto_accept(samples(spark, sf_dir), "predicted", "known", F.col("l_discount") >= 0.05, ["brand"])
    return out.select("brand", F.round("auto_accept_rate", 6).alias("auto_accept_rate"), "n_all", F.round("median_abs_all", 6).alias("median_abs_all"), "n_accepted", F.round("median_abs_accepted", 6).alias("median_abs_accepted"))


@query("a22_parameter_sweep", f"""
    WITH {SAMPLES_SQL}, c AS (SELECT * FROM (VALUES ('low', 0.9::DOUBLE), ('base', 1.0::DOUBLE), ('high', 1.1::DOUBLE)) t(scenario, factor)),
    e AS (SELECT scenario, (predicted * factor - known) / known AS err FROM samples, c)
    SELECT scenario, count(*) AS n, sum(CASE WHEN abs(err) <= 0.1 THEN 1 ELSE 0 END)::BIGINT AS hits, round(median(abs(err)), 6) AS median_abs, round(median(err), 6) AS median_err,
           sum(CASE WHEN err < -0.1 THEN 1 ELSE 0 END)::BIGINT AS floors
    FROM e GROUP BY scenario""")
def a22_parameter_sweep(spark, sf_dir):
    scenarios = spark.createDataFrame([("low", 0.9), ("base", 1.0), ("high", 1.1)], "scenario string, factor double")
    out = rollup.sweep(samples(spark, sf_dir), scenarios, "predicted", "known")
    return out.select("scenario", "n", "hits", F.round("median_abs", 6).alias("median_abs"), F.round("median_err", 6).alias("median_err"), "floors")


@query("a19_best_design", """
    WITH d AS (SELECT l_orderkey, l_extendedprice AS known, l_partkey * 100 + l_linenumber AS ord FROM lineitem WHERE l_extendedprice > 0),
    p AS (SELECT o_orderkey AS l_orderkey, o_totalprice / 4 AS predicted FROM orders),
    x AS (SELECT l_orderkey, predicted, known, (predicted - known) / known AS err, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs((predicted - known) / known), ord, known) AS k FROM p JOIN d USING (l_orderkey))
    SELECT l_orderkey, round(predicted, 4) AS predicted, known, round(err, 6) AS err FROM x WHERE k = 1""")
def a19_best_design(spark, sf_dir):
    designs = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("known"), F.struct(F.col("l_partkey") * 100 + F.col("l_linenumber"), "l_extendedprice").alias("ord"))
    predictions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 4).alias("predicted"))
    out = rollup.best_design(predictions, designs, "l_orderkey", "predicted", "known", "ord")
    return out.select("l_orderkey", F.round("predicted", 4).alias("predicted"), "known", F.round("err", 6).alias("err"))


@query("a11_a12_index_quantiles", """
    WITH r AS (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
    SELECT p_brand, max(CASE WHEN k = floor(0.9::DOUBLE * (n - 1)) THEN v END) AS p90, max(CASE WHEN k = n // 2 THEN v END) AS upper_median, max(CASE WHEN k = n // 4 THEN v END) AS lower_quartile
    FROM r GROUP BY p_brand""")
def a11_a12_index_quantiles(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    wanted = [("p90", quantiles.p90_floor_rank()), ("upper_median", quantiles.upper_median_rank()), ("lower_quartile", quantiles.lower_quartile_rank())]
    out = None
    for name, rank in wanted:
        one = quantiles.at_rank(part, ["p_brand"], "p_retailprice", rank, name)
        out = one if out is None else out.join(one, "p_brand")
    return out


# --- order: claims, numbering, runs, intervals, rasters --------------------------------------------


@query("j20_first_claimant", """
    WITH x AS (SELECT o_custkey, o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS owner FROM orders)
    SELECT o_orderkey, owner, CASE WHEN owner <> o_orderkey THEN 'same_building_as_site_' || owner END AS reason FROM x""")
def j20_first_claimant(spark, sf_dir):
    return ordered.first_claimant(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "owner", "reason")


@query("a18_largest_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def a18_largest_per_key(spark, sf_dir):
    return ordered.first_by_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("w4_top_n", "SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def w4_top_n(spark, sf_dir):
    return ordered.top_n(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 3).select("c_nationkey", "c_custkey", "rank")


@query("w1_w6_names", """
    WITH x AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_name) AS n FROM part)
    SELECT p_partkey, CASE WHEN k > 1 THEN p_name || ' (' || k || ')' ELSE p_name END AS unique_name, CASE WHEN n > 1 THEN p_name || ' #' || k ELSE p_name END AS numbered, p_name AS site FROM x""")
def w1_w6_names(spark, sf_dir):
    rows = ordered.numbered_names(ordered.unique_names(table(spark, sf_dir, "part"), "p_name", ["p_partkey"]), "p_name", ["p_partkey"])
    return rows.select("p_partkey", "unique_name", "numbered", text.site_of(F.col("numbered")).alias("site"))


@query("a7_a8_dominant", """
    WITH s AS (SELECT l_suppkey, l_returnflag || l_linestatus AS label, round(sum(l_extendedprice), 2) AS weight, min(l_orderkey) AS first_seen FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, label, weight FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, first_seen, label) AS k FROM s) WHERE k = 1""")
def a7_a8_dominant(spark, sf_dir):
    out = ordered.dominant(table(spark, sf_dir, "lineitem"), "l_suppkey", F.concat("l_returnflag", "l_linestatus"), F.col("l_extendedprice"), "l_orderkey")
    return out.select("l_suppkey", "label", F.round("weight", 2).alias("weight"))


@query("w11_running_offset", "SELECT event_id, user_id, coalesce(sum(length(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM events")
def w11_running_offset(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("size", F.length("event_type"))
    return ordered.running_offset(rows, "user_id", ["ts", "event_id"], "size").select("event_id", "user_id", F.col("offset").alias("off"))


CELLS_SQL = "cells AS (SELECT event_id // 10000 AS raster, (event_id // 100) % 100 AS r, event_id % 100 AS c, value AS z FROM events)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.floor(e / 10000).alias("raster"), (F.floor(e / 100) % 100).alias("r"), (e % 100).alias("c"), F.col("value").alias("z"))


@query("w8_g19_opening", f"""
    WITH {CELLS_SQL}, a AS (SELECT *, min(z) OVER (PARTITION BY raster, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM cells),
    b AS (SELECT *, min(l) OVER (PARTITION BY raster, c ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM a),
    d AS (SELECT *, max(m) OVER (PARTITION BY raster, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM b),
    o AS (SELECT *, max(n) OVER (PARTITION BY raster, c ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS opened FROM d)
    SELECT raster, r, c, opened, z - opened >= 0.3 AS raised FROM o""")
def w8_g19_opening(spark, sf_dir):
    out = ordered.opening(cells(spark, sf_dir), ["raster"], "r", "c", "z", 5)
    return out.select("raster", "r", "c", "opened", (F.col("z") - F.col("opened") >= 0.3).alias("raised"))


@query("w9_g20_runs", f"""
    WITH {CELLS_SQL}, m AS (SELECT raster, r, c, c - row_number() OVER (PARTITION BY raster, r ORDER BY c) AS g FROM cells WHERE z > 20)
    SELECT raster, r, min(c) AS "start", max(c) AS "end", count(*) AS cells FROM m GROUP BY raster, r, g""")
def w9_g20_runs(spark, sf_dir):
    return ordered.runs(cells(spark, sf_dir).where("z > 20"), ["raster", "r"], "c")


SPANS_SQL = "spans AS (SELECT user_id, floor(value * 10)::BIGINT AS a, floor(value * 10)::BIGINT + length(event_type) AS b FROM events)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.floor(F.col("value") * 10)
    return table(spark, sf_dir, "events").select("user_id", a.alias("a"), (a + F.length("event_type")).alias("b"))


MERGED_SQL = """,
    w AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM spans),
    g AS (SELECT *, sum(CASE WHEN so_far IS NULL OR a > so_far THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM w),
    merged AS (SELECT user_id, min(a) AS s, max(b) AS e FROM g GROUP BY user_id, k)"""


@query("w10_merged_intervals", f'WITH {SPANS_SQL}{MERGED_SQL} SELECT user_id, s AS "start", e AS "end" FROM merged')
def w10_merged_intervals(spark, sf_dir):
    return ordered.merged_intervals(spans(spark, sf_dir), "user_id", "a", "b")


@query("g10_free_intervals", f"""
    WITH {SPANS_SQL}{MERGED_SQL}, f AS (SELECT user_id, coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY s), 0) AS free_start, s AS free_end FROM merged
    UNION ALL SELECT user_id, max(e), 100000 FROM merged GROUP BY user_id)
    SELECT * FROM f WHERE free_end > free_start""")
def g10_free_intervals(spark, sf_dir):
    return ordered.free_intervals(spans(spark, sf_dir), "user_id", "a", "b", F.lit(0).cast("bigint"), F.lit(100000).cast("bigint"))


@query("j13_interpolation", """
    WITH e AS (SELECT event_id, event_type IN ('view', 'click') AS known, user_id // 2 AS street, user_id % 2 AS parity, (value * 10)::DOUBLE AS pos, length(event_type)::DOUBLE + event_id AS v FROM events),
    o AS (SELECT street, parity, pos, v FROM (SELECT *, row_number() OVER (PARTITION BY street, parity, pos ORDER BY event_id) AS k FROM e WHERE known) WHERE k = 1),
    q AS (SELECT event_id, street, parity, pos FROM e WHERE NOT known),
    l AS (SELECT q.*, o.pos AS la, o.v AS lv FROM q ASOF LEFT JOIN o ON q.street = o.street AND q.parity = o.parity AND q.pos >= o.pos),
    b AS (SELECT l.*, o.pos AS ua, o.v AS uv FROM l ASOF LEFT JOIN o ON l.street = o.street AND l.parity = o.parity AND l.pos <= o.pos)
    SELECT event_id, round(la, 4) AS lower_at, round(ua, 4) AS upper_at,
           round(CASE WHEN la = ua THEN lv WHEN ua - la > 0 AND ua - la <= 200 THEN lv + (uv - lv) * (pos - la) / (ua - la) END, 4) AS interpolated FROM b""")
def j13_interpolation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").isin("view", "click").alias("known"), F.floor(F.col("user_id") / 2).alias("street"), (F.col("user_id") % 2).alias("parity"), (F.col("value") * 10).alias("at"), (F.length("event_type").cast("double") + F.col("event_id")).alias("v"))
    out = ordered.as_of_pair(e.where("not known").select("event_id", "street", "parity", "at"), e.where("known"), ["street", "parity"], "at", "v", "event_id", 200.0)
    return out.select("event_id", F.round("lower_at", 4).alias("lower_at"), F.round("upper_at", 4).alias("upper_at"), F.round("interpolated", 4).alias("interpolated"))


# --- spatial joins -------------------------------------------------------------------------------

def places_sql(reach: int) -> str:
    """Points, boxes and hits, the pairs within reach."""
    return f"""
    pts AS (SELECT vec_id AS pid, embedding[1]::DOUBLE * 1000 AS px, embedding[2]::DOUBLE * 1000 AS py FROM embeddings WHERE vec_id % 2 = 0),
    boxes AS (SELECT vec_id AS bid, x AS xmin, y AS ymin, x + 5 + vec_id % 20 AS xmax, y + 5 + vec_id % 15 AS ymax FROM (SELECT vec_id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y FROM embeddings WHERE vec_id % 2 = 1)),
    near AS (SELECT pid, bid, px, py, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy, (xmax - xmin) * (ymax - ymin) AS area,
             sqrt(greatest(xmin - px, 0, px - xmax) ** 2 + greatest(ymin - py, 0, py - ymax) ** 2) AS d FROM pts, boxes
             WHERE px BETWEEN xmin - {reach} AND xmax + {reach} AND py BETWEEN ymin - {reach} AND ymax + {reach}),
    hits AS (SELECT *, sqrt((cx - px) ** 2 + (cy - py) ** 2) AS d_center FROM near WHERE d <= {reach})"""


PLACES_SQL = places_sql(40)


def near_boxes(spark: SparkSession, sf_dir: str, nearest: int | None = None, only: str = "true", of: DataFrame | None = None, reach: float = 40.0, met: bool = False) -> tuple[DataFrame, DataFrame]:
    """Points with the boxes within reach, or only those among which the nearest ones are; and all boxes.

    only: which boxes count. of: which points (pid). met: pairs are for windows by the cell they met in.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 1000).alias("x"), (F.col("embedding")[1].cast("double") * 1000).alias("y"))
    points = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"))
    points = points if of is None else points.join(of, "pid", "left_semi")
    boxes = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("bid"), F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + 5 + F.col("vec_id") % 20).alias("xmax"), (F.col("y") + 5 + F.col("vec_id") % 15).alias("ymax")).where(only)
    size = reach / 4 if met else max(reach, 20.0)
    hits = spatial.points_near_nearest_boxes(points, "pid", boxes, reach, nearest) if nearest else spatial.points_near_boxes(points, boxes, reach, size, met)
    cx, cy = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    hits = hits.withColumn("d_center", F.sqrt((cx - F.col("px")) ** 2 + (cy - F.col("py")) ** 2)).withColumn("area", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))
    return hits, boxes


@query("j2_range_join", f"WITH {PLACES_SQL} SELECT pid, bid, round(d, 4) AS d FROM hits")
def j2_range_join(spark, sf_dir):
    return near_boxes(spark, sf_dir)[0].select("pid", "bid", F.round("d", 4).alias("d"))


@query("j3_nearest_runner_up", f"""
    WITH {PLACES_SQL} SELECT pid, bid, round(d, 4) AS d, round(runner_up_d, 4) AS runner_up_d FROM
    (SELECT *, row_number() OVER w AS k, lead(d) OVER w AS runner_up_d FROM hits WINDOW w AS (PARTITION BY pid ORDER BY d, d_center, bid)) WHERE k = 1""")
def j3_nearest_runner_up(spark, sf_dir):
    out = spatial.nearest_with_runner_up(near_boxes(spark, sf_dir, 2)[0], "pid", ["d", "d_center", "bid"])
    return out.select("pid", "bid", F.round("d", 4).alias("d"), F.round("runner_up_d", 4).alias("runner_up_d"))


@query("j4_campus", f"""
    WITH {PLACES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, d_center, bid) AS match_rank FROM hits)
    SELECT pid, bid, match_rank FROM r WHERE match_rank = 1 OR (d_center <= 30 AND area >= 50)""")
def j4_campus(spark, sf_dir):
    return spatial.campus(near_boxes(spark, sf_dir, met=True)[0], [*spatial.MET, "pid"], ["d", "d_center", "bid"], 30.0, 50.0).select("pid", "bid", "match_rank")


@query("j6_contains_else_nearest", f"""
    WITH {PLACES_SQL} SELECT pid, bid, d = 0 AS contains FROM
    (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY CASE WHEN d = 0 THEN 0 ELSE 1 END, d, bid) AS k FROM hits) WHERE k = 1""")
def j6_contains_else_nearest(spark, sf_dir):
    return spatial.containing_else_nearest(near_boxes(spark, sf_dir, 1)[0], "pid", "bid").select("pid", "bid", "contains")


@query("f9_home_like", f"""
    WITH {PLACES_SQL}, ok AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, d_center, bid) AS rank FROM hits WHERE area / 20 <= 13 AND NOT cx < cy - 500 AND area <= 1200),
    m AS (SELECT pid, list_sort(list(area)) AS a FROM ok WHERE rank <= 8 GROUP BY pid)
    SELECT pid, bid, rank FROM ok JOIN m USING (pid) WHERE area BETWEEN 0.5 * a[len(a) // 2 + 1] AND 2.0 * a[len(a) // 2 + 1]""")
def f9_home_like(spark, sf_dir):
    hits = near_boxes(spark, sf_dir, met=True)[0].withColumn("height_m", F.col("area") / 20)
    cx, cy = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    return spatial.home_like(hits.withColumn("mapped", F.when(cx < cy - 500, "retail")), [*spatial.MET, "pid"], ["d", "d_center", "bid"], 2).select("pid", "bid", "rank")


@query("j7_homes_on_footprints", f"""
    WITH {PLACES_SQL} SELECT bid, count(DISTINCT CASE WHEN d <= 3 THEN pid % 7 END) AS homes FROM boxes LEFT JOIN hits USING (bid) GROUP BY bid""")
def j7_homes_on_footprints(spark, sf_dir):
    hits, boxes = near_boxes(spark, sf_dir)
    return spatial.distinct_on_boxes(hits.where("d <= 3").withColumn("number", F.col("pid") % 7), boxes, "bid", ["number"])


@query("j22_ring_probe", f"""
    WITH {PLACES_SQL}, o AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, 25), (2, 25, 0), (3, 0, -25), (4, -25, 0)) t(k, ox, oy)),
    q AS (SELECT pid, k, px + ox AS x, py + oy AS y FROM pts, o),
    h AS (SELECT pid, k, bid, (xmax - xmin) * (ymax - ymin) AS panels FROM q JOIN boxes ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax)
    SELECT pid, k, bid FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY CASE WHEN k = 0 THEN 0 ELSE 1 END, round(panels, 6) DESC, k, bid) AS n FROM h) WHERE n = 1""")
def j22_ring_probe(spark, sf_dir):
    hits, boxes = near_boxes(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0")
    offsets = spark.createDataFrame([(0, 0, 0), (1, 0, 25), (2, 25, 0), (3, 0, -25), (4, -25, 0)], "k int, ox int, oy int")
    probes = e.crossJoin(F.broadcast(offsets)).select(F.col("vec_id").alias("pid"), "k", (F.col("embedding")[0].cast("double") * 1000 + F.col("ox")).alias("px"), (F.col("embedding")[1].cast("double") * 1000 + F.col("oy")).alias("py"))
    found = spatial.points_near_boxes(probes, boxes, 0.0, 40.0).withColumn("panels", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))
    return ordered.first_by_key(found, ["pid"], [F.col("k") != 0, F.desc(F.round("panels", 6)), "k", "bid"]).select("pid", "k", "bid")


@query("j23_neighbour_counts", """
    WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y FROM embeddings)
    SELECT a.vec_id, count(*) FILTER (WHERE b.label % 2 = 0) AS flat, count(*) FILTER (WHERE b.label % 2 = 1) AS pitched
    FROM e a JOIN e b ON abs(a.x - b.x) <= 20 AND abs(a.y - b.y) <= 20 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 20 GROUP BY a.vec_id""")
def j23_neighbour_counts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("embedding")[0].cast("double") * 1000).alias("x"), (F.col("embedding")[1].cast("double") * 1000).alias("y"))
    pairs = spatial.points_near_points(e.select("vec_id", F.col("x").alias("ax"), F.col("y").alias("ay")), e.select("label", F.col("x").alias("bx"), F.col("y").alias("by")), 20.0)
    return pairs.groupBy("vec_id").agg(F.count_if(F.col("label") % 2 == 0).alias("flat"), F.count_if(F.col("label") % 2 == 1).alias("pitched"))


@query("j16_anti_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j16_anti_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    c = table(spark, sf_dir, "customer")
    return c.join(big, c["c_custkey"] == big["o_custkey"], "left_anti").select("c_custkey", "c_mktsegment")


# --- addresses and text ----------------------------------------------------------------------------

STREETS_SQL = """
    q AS (SELECT c_custkey, c_nationkey AS zone, CASE c_mktsegment WHEN 'BUILDING' THEN 'small widget street' WHEN 'MACHINERY' THEN 'North red ring Avenue' ELSE 'blue widget' END AS street FROM customer),
    s AS (SELECT DISTINCT s_nationkey AS zone, p_name AS name FROM supplier JOIN part ON p_partkey % 100 = s_suppkey % 100)"""


@query("j12_best_street", f"""
    WITH {STREETS_SQL},
    dir AS (SELECT map(['NORTH', 'SOUTH', 'EAST', 'WEST', 'STREET', 'AVENUE'], ['N', 'S', 'E', 'W', 'ST', 'AVE']) AS m),
    t AS (SELECT c_custkey, name, list_transform(regexp_extract_all(upper(street), '[A-Z0-9]+'), lambda x: coalesce(m[x], x)) AS a,
                 list_transform(regexp_extract_all(upper(name), '[A-Z0-9]+'), lambda x: coalesce(m[x], x)) AS b FROM q JOIN s USING (zone), dir),
    c AS (SELECT *, list_filter(a, lambda x: NOT list_contains(['ST', 'AVE', 'N', 'S', 'E', 'W'], x)) AS core FROM t),
    r AS (SELECT c_custkey, name, CASE WHEN len(core) = 0 OR len(list_filter(core, lambda x: NOT list_contains(b, x))) > 0 THEN 0 ELSE len(list_filter(a, lambda x: list_contains(b, x))) / len(a) END AS score FROM c)
    SELECT c_custkey, name AS best_street, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, name DESC) AS k FROM r WHERE score > 0) WHERE k = 1""")
def j12_best_street(spark, sf_dir):
    street = F.when(F.col("c_mktsegment") == "BUILDING", "small widget street").when(F.col("c_mktsegment") == "MACHINERY", "North red ring Avenue").otherwise("blue widget")
    q = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("zone"), street.alias("street"))
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    names = s.join(p, F.col("p_partkey") % 100 == F.col("s_suppkey") % 100).select(F.col("s_nationkey").alias("zone"), F.col("p_name").alias("name"))
    return addresses.best_street(q, names, "c_custkey", "zone", "street", "name").select("c_custkey", "best_street", F.round("score", 6).alias("score"))


@query("j14_range_expansion", "SELECT p_partkey, unnest(range(p_size, CASE WHEN p_size % 5 * 120 <= 400 THEN p_size + p_size % 5 * 120 ELSE p_size END + 1))::INT AS number FROM part")
def j14_range_expansion(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("high", F.col("p_size") + F.col("p_size") % 5 * 120)
    return addresses.expanded_ranges(rows, "p_size", "high").select("p_partkey", "number")


ADDRESS_SQL = "a AS (SELECT c_custkey, (c_custkey % 900 + 1) || CASE WHEN c_custkey % 7 = 0 THEN '-' || (c_custkey % 900 + 9) ELSE '' END || ' ' || c_mktsegment || ' street apt 5, LA, CA ' || (90000 + c_nationkey) || CASE WHEN c_custkey % 3 = 0 THEN '-1234, USA' ELSE '' END AS address FROM customer)"


@query("x2_parse_address", rf"""
    WITH {ADDRESS_SQL} SELECT c_custkey, upper(regexp_extract(address, '^\s*(\d+[A-Za-z]?)(?:-\d+)?\s+([^,#]+)', 1)) AS number,
    trim(regexp_replace(regexp_extract(address, '^\s*(\d+[A-Za-z]?)(?:-\d+)?\s+([^,#]+)', 2), '(?i)\b(APT|UNIT|STE|SUITE|BLDG|BUILDING)\b.*$', '')) AS street,
    regexp_extract(address, '\b(\d{{5}})(?:-\d{{4}})?\s*(?:,?\s*(?:USA|US|United States))?\s*$', 1) AS zip FROM a""")
def x2_parse_address(spark, sf_dir):
    k = F.col("c_custkey")
    part = F.when(k % 7 == 0, F.concat(F.lit("-"), (k % 900 + 9).cast("string"))).otherwise("")
    address = F.concat((k % 900 + 1).cast("string"), part, F.lit(" "), "c_mktsegment", F.lit(" street apt 5, LA, CA "), (F.col("c_nationkey") + 90000).cast("string"), F.when(k % 3 == 0, "-1234, USA").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", text.parse_address(address).alias("p")).select("c_custkey", "p.*")


@query("x6_x11_x16_text", r"""
    SELECT page_id, regexp_replace(url || '?api_key=abc' || page_id || '&token=x', '(?i)((?:key|token|api_key|apikey)=)[^&\s''"]+', '\1***', 'g') AS redacted,
    regexp_replace(left(regexp_replace(url, '[^A-Za-z0-9_]+', '_', 'g'), 60), '^_+|_+$', '', 'g') AS slug FROM pages""")
def x6_x11_x16_text(spark, sf_dir):
    url = F.concat("url", F.lit("?api_key=abc"), F.col("page_id").cast("string"), F.lit("&token=x"))
    return table(spark, sf_dir, "pages").select("page_id", text.redact(url).alias("redacted"), text.error_slug(F.col("url")).alias("slug"))


@query("x8_f12_permits", r"""
    WITH d AS (SELECT p_partkey, 'Install ' || p_size || '.5 kW solar and ' || (p_size % 3) || ' MW' || CASE WHEN p_partkey % 4 = 0 THEN ' carport' ELSE '' END AS t FROM part)
    SELECT p_partkey, list_max(list_filter(list_concat(list_transform(regexp_extract_all(t, '(?i)(\d{1,4}(?:[.,]\d+)?)\s*-?\s*(?:KW|KILO\s*WATTS?)(?:\s*-?\s*DC)?\b', 1), lambda v: replace(v, ',', '.')::DOUBLE),
           list_transform(regexp_extract_all(t, '(?i)(\d{1,2}(?:\.\d+)?)\s*-?\s*MW\b', 1), lambda v: v::DOUBLE * 1000)), lambda v: v > 0 AND v < 20000)) AS kw,
           NOT contains(t, 'carport') AS new_rooftop FROM d""")
def x8_f12_permits(spark, sf_dir):
    t = F.concat(F.lit("Install "), F.col("p_size").cast("string"), F.lit(".5 kW solar and "), (F.col("p_size") % 3).cast("string"), F.lit(" MW"), F.when(F.col("p_partkey") % 4 == 0, " carport").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", text.kw_from_text(t).alias("kw"), text.new_roof_install(t).alias("new_rooftop"))


@query("j24_t4_shared_names", """
    WITH n AS (SELECT p_partkey, list_distinct(list_filter(regexp_extract_all(lower(p_name || ' the homes'), '[a-z0-9]+'), lambda x: NOT list_contains(['the', 'homes'], x) AND len(x) > 1)) AS w FROM part)
    SELECT p_partkey, list_sort(w) AS words, list_has_any(w, ['ring', 'small']) AS shared FROM n""")
def j24_t4_shared_names(spark, sf_dir):
    words = text.name_words(F.concat("p_name", F.lit(" the homes")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(words).alias("words"), F.arrays_overlap(words, F.array(F.lit("ring"), F.lit("small"))).alias("shared"))


@query("f7_occupancy", """
    SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'commercial' WHEN p_size % 3 = 0 THEN 'R-3' WHEN p_size % 3 = 1 THEN 'R-2' END AS occupancy FROM part""")
def f7_occupancy(spark, sf_dir):
    t = F.when(F.col("p_type") == "ECONOMY", "Commercial single").when(F.col("p_size") % 3 == 0, "Attached Townhomes apartment").when(F.col("p_size") % 3 == 1, " multi-family ").otherwise("barn")
    return table(spark, sf_dir, "part").select("p_partkey", text.occupancy_from_text(t).alias("occupancy"))


@query("f6_occupancy_class", """
    WITH p AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN ['apartments', 'house', 'retail', 'barn', 'terrace', 'garage'][p_size % 6 + 1] END AS mapped FROM part)
    SELECT p_partkey, CASE mapped WHEN 'apartments' THEN 'R-2' WHEN 'house' THEN 'R-3' WHEN 'terrace' THEN 'R-3' WHEN 'retail' THEN 'commercial' WHEN 'garage' THEN 'commercial' END AS occupancy FROM p""")
def f6_occupancy_class(spark, sf_dir):
    classes = F.array(*(F.lit(c) for c in ("apartments", "house", "retail", "barn", "terrace", "garage")))
    mapped = F.when(F.col("p_size") > 5, F.get(classes, F.col("p_size") % 6))
    return table(spark, sf_dir, "part").select("p_partkey", text.occupancy_from_class(mapped).alias("occupancy"))


# --- roll-ups ----------------------------------------------------------------------------------------

BUILDINGS_SQL = "b AS (SELECT o_custkey AS site, o_orderkey, o_orderkey % 4000 AS building, o_totalprice AS kw, o_orderstatus <> 'P' AS counted, o_orderpriority = '1-URGENT' AS review, CASE WHEN o_orderkey % 5 = 0 THEN 'carport_or_garage' ELSE 'building' END AS kind FROM orders)"


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("site"), "o_orderkey", (F.col("o_orderkey") % 4000).alias("building"), F.col("o_totalprice").alias("kw"), (F.col("o_orderstatus") != "P").alias("counted"), (F.col("o_orderpriority") == "1-URGENT").alias("review"), F.when(F.col("o_orderkey") % 5 == 0, "carport_or_garage").otherwise("building").alias("kind"))


@query("a4_site_rollup", f"""
    WITH {BUILDINGS_SQL} SELECT site, count(*) AS buildings, round(coalesce(sum(kw) FILTER (WHERE counted), 0), 2) AS dc_kw, coalesce(sum(building) FILTER (WHERE counted), 0)::BIGINT AS module_count,
    round(coalesce(sum(kw) FILTER (WHERE counted AND kind <> 'building'), 0), 2) AS carport_kw, round(coalesce(sum(kw) FILTER (WHERE NOT counted), 0), 2) AS uncounted_buildings_kw, bool_or(review) AS needs_review FROM b GROUP BY site""")
def a4_site_rollup(spark, sf_dir):
    out = rollup.site_rollup(buildings(spark, sf_dir), "site", "kw", "kw", "building", "kw", "kind", "counted", "review")
    return out.select("site", "buildings", F.round("dc_kw", 2).alias("dc_kw"), "module_count", F.round("carport_kw", 2).alias("carport_kw"), F.round("uncounted_buildings_kw", 2).alias("uncounted_buildings_kw"), "needs_review")


@query("a6_raised_extra", f"""
    WITH {BUILDINGS_SQL} SELECT site, round(coalesce(sum(CASE WHEN counted THEN (o_orderkey % 13) * CASE WHEN building = 0 THEN 0 ELSE kw / building END END), 0), 2) AS raised_extra_kw FROM b GROUP BY site""")
def a6_raised_extra(spark, sf_dir):
    rows = buildings(spark, sf_dir).withColumn("extra", F.col("o_orderkey") % 13)
    return rollup.raised_extra_kw(rows, "site", "extra", "kw", "building", "counted").select("site", F.round("raised_extra_kw", 2).alias("raised_extra_kw"))


@query("a5_property_rollup", f"""
    WITH {BUILDINGS_SQL}, g AS (SELECT *, site % 10 AS grp FROM b), f AS (SELECT *, row_number() OVER (PARTITION BY grp, building ORDER BY o_orderkey) AS k FROM g)
    SELECT grp, count(DISTINCT site) AS sites, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END)::BIGINT AS buildings, round(coalesce(sum(kw) FILTER (WHERE k = 1 AND counted), 0), 1) AS dc_kw, bool_or(review) AS needs_review FROM f GROUP BY grp""")
def a5_property_rollup(spark, sf_dir):
    rows = buildings(spark, sf_dir).withColumn("grp", F.col("site") % 10)
    out = rollup.property_rollup(rows, "grp", "site", "building", "kw", "counted", "review", "o_orderkey")
    return out.select("grp", "sites", "buildings", F.round("dc_kw", 1).alias("dc_kw"), "needs_review")


@query("t2_ordered_reasons", """
    WITH r AS (SELECT o_custkey, o_orderpriority AS reason, min(o_orderkey) AS first_seen FROM orders GROUP BY ALL)
    SELECT o_custkey, string_agg(reason, ';' ORDER BY first_seen) AS reasons FROM r GROUP BY o_custkey""")
def t2_ordered_reasons(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.array_join(rollup.ordered_reasons(F.col("o_orderkey"), F.col("o_orderpriority")), ";").alias("reasons"))


PANELS_SQL = """
    p AS (SELECT l_suppkey, l_quantity AS area, CASE WHEN l_linenumber = 1 THEN 'setback' WHEN l_tax < 0.02 THEN 'outside_zone' WHEN l_returnflag = 'R' THEN 'poleward' WHEN l_discount < 0.03 THEN 'low_yield' ELSE 'kept' END AS disposition FROM lineitem)"""


@query("f10_a13_dispositions", f"""
    WITH {PANELS_SQL}, s AS (SELECT l_suppkey, disposition, floor(round(sum(area), 6) / 2.583252)::BIGINT AS modules FROM p GROUP BY ALL)
    SELECT l_suppkey, disposition, modules, round(modules * 550.0 / 1000, 3)::DOUBLE AS kw FROM s""")
def f10_a13_dispositions(spark, sf_dir):
    label = rollup.disposition(F.col("l_linenumber") == 1, F.when(F.col("l_tax") < 0.02, 0.5).otherwise(1.0), F.col("l_returnflag") == "R", F.when(F.col("l_discount") < 0.03, 0.1).otherwise(0.9))
    panels = table(spark, sf_dir, "lineitem").select("l_suppkey", label.alias("disposition"), "l_quantity")
    out = rollup.disposition_kw(panels, "l_suppkey", "disposition", "l_quantity", 2.583252, 550.0)
    return out.select("l_suppkey", "disposition", "modules", F.round("kw", 3).alias("kw"))


@query("a16_community_scaling", """
    WITH s AS (SELECT o_custkey AS k, o_orderkey % 9 + 1 AS homes, o_totalprice / 10000 AS kw FROM orders),
    q AS (SELECT *, kw / homes AS per, row_number() OVER (PARTITION BY k ORDER BY kw / homes) - 1 AS place, count(*) OVER (PARTITION BY k) AS n FROM s),
    t AS (SELECT k, sum(homes)::BIGINT AS homes, sum(kw) AS kw, max(n) AS n, max(per) AS most, max(CASE WHEN place = n // 4 THEN per END) AS lq FROM q GROUP BY k),
    g AS (SELECT c_custkey AS k, c_custkey % 200 + 50 AS units FROM customer)
    SELECT k, units, homes AS sampled_homes, round(kw * CASE WHEN homes < units AND n >= 3 AND kw / homes <= 20 AND most <= 3 * greatest(lq, 0.1) THEN units / homes ELSE 1.0 END, 3) AS scaled_kw FROM g JOIN t USING (k)""")
def a16_community_scaling(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 9 + 1).alias("homes"), (F.col("o_totalprice") / 10000).alias("kw"))
    groups = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 200 + 50).alias("units"))
    out = rollup.scaled_to_units(groups, rows, "k", "units", "homes", "kw", 3)
    return out.select("k", "units", "sampled_homes", F.round("scaled_kw", 3).alias("scaled_kw"))


# --- solar and geometry expressions ------------------------------------------------------------------


@query("m2_m6_solar", """
    WITH p AS (SELECT p_partkey, p_size AS lat, 200.0 + p_size * 6 AS watts FROM part),
    a AS (SELECT *, asin(sin(radians(lat)) * sin(radians(-23.44)) + cos(radians(lat)) * cos(radians(-23.44)) * cos(radians(30))) AS alt FROM p),
    z AS (SELECT *, acos(least(greatest((sin(alt) * sin(radians(lat)) - sin(radians(-23.44))) / (cos(alt) * cos(radians(lat))), -1), 1)) AS az FROM a)
    SELECT p_partkey, CASE WHEN alt > 0 THEN round(degrees(atan(tan(alt) / cos(az))), 6) END AS profile_deg,
    (CASE WHEN watts < 250 THEN 150 WHEN watts < 300 THEN 170 WHEN watts < 350 THEN 190 WHEN watts < 400 THEN 205 WHEN watts < 480 THEN 210 ELSE 215 END)::DOUBLE AS density,
    round(CASE WHEN lat * 3 <= 76.2 THEN 1.2192 ELSE 1.8288 END::DOUBLE, 6) AS perimeter FROM z""")
def m2_m6_solar(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(solar.winter_profile_angle(F.col("p_size")), 6).alias("profile_deg"), solar.module_density(200.0 + F.col("p_size") * 6).alias("density"), F.round(solar.perimeter_m(F.col("p_size") * 3), 6).alias("perimeter"))


@query("g7_ring_measures", """
    WITH p AS (SELECT p_partkey, p_size::DOUBLE AS w, p_retailprice / 20 AS h FROM part)
    SELECT p_partkey, round(w * h, 4) AS area, round(2 * (w + h), 4) AS perimeter, round(4 * pi() * w * h / (4 * (w + h) ** 2), 6) AS compactness, 10 < w AND 30 < h AS inside FROM p""")
def g7_ring_measures(spark, sf_dir):
    w, h = F.col("p_size").cast("double"), F.col("p_retailprice") / 20
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    ring = F.array(at(zero, zero), at(w, zero), at(w, h), at(zero, h))
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(geometry.area(ring), 4).alias("area"), F.round(geometry.perimeter(ring), 4).alias("perimeter"), F.round(geometry.compactness(ring), 6).alias("compactness"), geometry.contains(ring, F.lit(10.0), F.lit(30.0)).alias("inside"))


@query("g10_rectangle_packing", """
    WITH p AS (SELECT p_partkey, p_size::DOUBLE AS w, p_retailprice / 20 AS h FROM part), k AS (SELECT unnest(range(8)) AS k),
    c AS (SELECT p_partkey, w, h, greatest(0, floor((h - 1.134 - 1.3 * k / 8 + 1e-9) / 1.3) + 1) AS n FROM p, k)
    SELECT p_partkey, (greatest(floor((any_value(w) + 0.02) / (2.278 + 0.02) + 1e-9), 0) * max(n))::BIGINT AS modules,
    max(CASE WHEN h <= 45.72 THEN 1 ELSE ceil((h + 1.2192) / (45.72 + 1.2192)) END)::INT AS sections FROM c GROUP BY p_partkey""")
def g10_rectangle_packing(spark, sf_dir):
    w, h = F.col("p_size").cast("double"), F.col("p_retailprice") / 20
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", geometry.modules_in_rectangle(w, h, 2.278, 1.134, 1.3).alias("modules"), geometry.sections(h, 150 * solar.FT, 4 * solar.FT).alias("sections"))


@query("g1_local_frame", """
    WITH e AS (SELECT vec_id, embedding[1]::DOUBLE / 100 AS dlat, embedding[2]::DOUBLE / 100 AS dlon FROM embeddings),
    c AS (SELECT *, sin(radians(34.05)) AS s, cos(radians(34.05)) AS c, 1 - 0.0066943799901413165 * sin(radians(34.05)) ** 2 AS w2, radians(dlat) AS dp, radians(dlon) AS dl FROM e),
    m AS (SELECT *, 6378137.0 / sqrt(w2) AS n, 6378137.0 * (1 - 0.0066943799901413165) / (w2 * sqrt(w2)) AS m FROM c)
    SELECT vec_id, round(dl * (n * c - m * s * dp), 3) AS x, round(m * dp + 0.5 * n * s * c * dl * dl + 1.5 * m * 0.0066943799901413165 * s * c / w2 * dp * dp, 3) AS y FROM m""")
def g1_local_frame(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    lat, lon = F.col("embedding")[0].cast("double") / 100, F.col("embedding")[1].cast("double") / 100
    at = geometry.local_xy(lon - 118.25, lat + 34.05, F.lit(-118.25), F.lit(34.05))
    return e.select("vec_id", at.alias("p")).select("vec_id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))
