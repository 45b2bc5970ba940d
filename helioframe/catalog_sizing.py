"""Queries of polygon algebra, insets, sizing and overlay joins.

Their shapes are rectangles and L shapes turned by an angle of their own, so that SQL can tell areas and counts from
the shapes as they were before.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helioframe.catalog import query, table
from helioframe.functions import geometry
from helioframe.operators import overlay, spatial
from helioframe.plans import sizing

RINGS = "array<array<struct<x:double,y:double>>>"


def ring(*points: tuple[Column | float, Column | float]) -> Column:
    return F.array(*[overlay.point(*(c if isinstance(c, Column) else F.lit(float(c)) for c in p)) for p in points])


def rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def column(name: str, factor: int = 1, modulus: int | None = None) -> Column:
    """A number made from a key: its multiple, or the remainder of that."""
    value = F.col(name) * factor
    return (value if modulus is None else value % modulus).cast("double")


PAIRS_SQL = """
    r AS (SELECT p_partkey, 0.0 AS ax, 0.0 AS ay, p_size::DOUBLE AS aw, p_retailprice / 50 AS ah, (p_partkey % 10)::DOUBLE - 3 AS bx, (p_partkey % 7)::DOUBLE AS b_y, (p_partkey % 23)::DOUBLE + 1 AS bw, (p_partkey % 17)::DOUBLE + 1 AS bh FROM part),
    s AS (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, b_y + bh) - greatest(ay, b_y)) AS shared FROM r)"""


@query("t7_polygon_algebra", f"""
    WITH {PAIRS_SQL} SELECT p_partkey, round(shared, 4) AS shared, round(aw * ah + bw * bh - shared, 4) AS united, round(aw * ah - shared, 4) AS rest, round(aw * ah + bw * bh - 2 * shared, 4) AS either FROM s""")
def t7_polygon_algebra(spark, sf_dir):
    zero, turn = F.lit(0.0), column("p_partkey", 13, 180)
    one = geometry.rotated(rectangle(zero, zero, F.col("p_size").cast("double"), F.col("p_retailprice") / 50), turn)
    two = geometry.rotated(rectangle(column("p_partkey", 1, 10) - 3, column("p_partkey", 1, 7), column("p_partkey", 1, 23) + 1, column("p_partkey", 1, 17) + 1), turn)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(one).alias("one"), F.array(two).alias("two"))
    rows = rows.withColumn("op", F.explode(F.array(*map(F.lit, ("shared", "united", "rest", "either")))))
    key = ["p_partkey", "op"]
    edges = overlay.edges(rows, key, F.lit("a"), F.col("one")).unionByName(overlay.edges(rows, key, F.lit("b"), F.col("two")))
    a, b, op = F.col("in_a"), F.col("in_b"), F.col("op")
    found = overlay.overlay(edges, key, ["a", "b"], F.when(op == "shared", a & b).when(op == "united", a | b).when(op == "rest", a & ~b).otherwise(a != b))
    wide = overlay.areas(found, key).groupBy("p_partkey").pivot("op", ["shared", "united", "rest", "either"]).agg(F.sum("area"))
    return wide.select("p_partkey", *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("shared", "united", "rest", "either")])


@query("a24_dissolve", """
    WITH r AS (SELECT c_nationkey AS g, c_custkey * 37 % 199 AS x0, c_custkey * 91 % 197 AS y0, c_custkey * 37 % 199 + c_custkey % 13 + 2 AS x1, c_custkey * 91 % 197 + c_custkey % 7 + 2 AS y1 FROM customer),
    xs AS (SELECT g, x, lead(x) OVER (PARTITION BY g ORDER BY x) AS nx FROM (SELECT g, x0 AS x FROM r UNION SELECT g, x1 FROM r)),
    ys AS (SELECT g, y, lead(y) OVER (PARTITION BY g ORDER BY y) AS ny FROM (SELECT g, y0 AS y FROM r UNION SELECT g, y1 FROM r))
    SELECT xs.g AS c_nationkey, round(sum((nx - x) * (ny - y))::DOUBLE, 3) AS area FROM xs JOIN ys ON xs.g = ys.g AND nx IS NOT NULL AND ny IS NOT NULL
    WHERE EXISTS (SELECT 1 FROM r WHERE r.g = xs.g AND x0 <= x AND x1 >= nx AND y0 <= y AND y1 >= ny) GROUP BY xs.g""")
def a24_dissolve(spark, sf_dir):
    """The area of each nation's customers' plots, which overlap: keys of many parts."""
    c = table(spark, sf_dir, "customer")
    plot = rectangle(column("c_custkey", 37, 199), column("c_custkey", 91, 197), column("c_custkey", 1, 13) + 2, column("c_custkey", 1, 7) + 2)
    edges = overlay.edges(c, ["c_nationkey"], F.lit("plot"), F.array(geometry.rotated(plot, column("c_nationkey", 7))))
    found = overlay.areas(overlay.overlay(edges, ["c_nationkey"], ["plot"], F.col("in_plot"), tiles=True), ["c_nationkey"])
    return found.select("c_nationkey", F.round("area", 3).alias("area"))


@query("g4_mitred_inset", """
    WITH r AS (SELECT p_partkey, p_size + 4.0 AS a, p_retailprice / 60 AS b, (p_size + 4.0) * 0.4 AS c, p_retailprice / 60 * (p_partkey % 5 + 1) / 7 AS d, p_partkey % 4 + 0.5 AS t FROM part),
    i AS (SELECT p_partkey, greatest(0, a - 2 * t) AS w, greatest(0, b - 2 * t) AS h, c, d FROM r)
    SELECT p_partkey, round(w * h - least(c, w) * least(d, h), 4) AS area FROM i WHERE w * h - least(c, w) * least(d, h) > 1e-6""")
def g4_mitred_inset(spark, sf_dir):
    """What is left of L-shaped roofs within a setback; narrow arms vanish."""
    a, b = F.col("p_size") + 4.0, F.col("p_retailprice") / 60
    c, d = a * 0.4, b * (F.col("p_partkey") % 5 + 1) / 7
    zero = F.lit(0.0)
    ell = geometry.rotated(ring((zero, zero), (a, zero), (a, b - d), (a - c, b - d), (a - c, b), (zero, b)), column("p_partkey", 11, 180))
    roofs = table(spark, sf_dir, "part").select("p_partkey", F.array(ell).alias("rings"), (F.col("p_partkey") % 4 + 0.5).alias("t"))
    left = overlay.areas(overlay.inset(roofs, ["p_partkey"], "rings", F.col("t")), ["p_partkey"])
    return left.where("area > 1e-6").select("p_partkey", F.round("area", 4).alias("area"))


NO_PLANES = f"bid long, plane long, rings {RINGS}, pitch double, azimuth double"
NO_OBSTRUCTIONS = f"bid long, rings {RINGS}, kind string, height_m double"


def roofs(spark, sf_dir, w: Column, d: Column, occupancy: str):
    turned = geometry.rotated(rectangle(-w / 2, -d / 2, w, d), column("p_partkey", 13, 180))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("bid"), F.array(turned).alias("rings"), F.lit(occupancy).alias("occupancy"), F.lit(34.05).alias("lat"), F.lit(0.0).alias("parapet_m"), F.lit(True).alias("mapped"))


@query("g12_flat_sizing", """
    WITH r AS (SELECT p_partkey, 20 + p_retailprice / 25 AS w, 6.0 + p_size * 2 AS d FROM part),
    u AS (SELECT p_partkey, w - 2 * e AS u, d - 2 * e AS v FROM (SELECT *, CASE WHEN least(w, d) <= 76.2 THEN 1.2192 ELSE 1.8288 END AS e FROM r)),
    f AS (SELECT p_partkey, u AS l, v AS s FROM u UNION ALL SELECT p_partkey, v, u FROM u),
    c AS (SELECT *, CASE WHEN l <= 45.72 THEN 1 ELSE ceil((l + 1.2192) / 46.9392) END AS nx, CASE WHEN s <= 45.72 THEN 1 ELSE ceil((s + 1.2192) / 46.9392) END AS ny FROM f),
    t AS (SELECT *, (l - (nx - 1) * 1.2192) / nx AS wide, (s - (ny - 1) * 1.2192) / ny AS tall FROM c),
    y AS (SELECT t.*, k, 1.154 * k / 8 + 1.154 * j AS y FROM t, range(0, 8) a(k), range(0, 100) b(j) WHERE 1.154 * k / 8 + 1.154 * j + 1.134 <= s + 1e-9),
    n AS (SELECT p_partkey, l, s, k, nx * floor((wide + 0.02) / 2.298 + 1e-9) * count(*) FILTER (y + 1.134 <= floor((y + 1e-6) / (tall + 1.2192)) * (tall + 1.2192) + tall + 1e-6) AS n FROM y GROUP BY p_partkey, l, s, k, nx, wide),
    m AS (SELECT p_partkey, max(n) AS n FROM n GROUP BY p_partkey)
    SELECT u.p_partkey, CASE WHEN coalesce(n, 0) < 6 THEN 0 ELSE n END::BIGINT AS module_count, round(u * v, 3) AS usable_m2, CASE WHEN n > 0 AND n < 6 THEN 1 ELSE 0 END::INT AS undersized FROM u LEFT JOIN m USING (p_partkey)""")
def g12_flat_sizing(spark, sf_dir):
    """Flush layouts on flat commercial roofs: setback, sections and aisles, both axes, all row phases."""
    found = sizing.estimate(
        roofs(spark, sf_dir, 20 + F.col("p_retailprice") / 25, 6.0 + F.col("p_size") * 2, "commercial"), spark.createDataFrame([], NO_PLANES), spark.createDataFrame([], NO_OBSTRUCTIONS), sizing.Design(racking="flush")
    )
    few = F.array_contains("flags", "under_6_modules_not_designed").cast("int")
    return found.select(F.col("bid").alias("p_partkey"), "module_count", F.round("usable_m2", 3).alias("usable_m2"), few.alias("undersized"))


@query("g13_pitched_sizing", """
    WITH r AS (SELECT p_partkey, p_size * 0.5 + 8 - 1.8288 AS along, (p_retailprice / 200 - 1.8288) / cos(radians(10 + p_partkey % 40)) AS slope FROM part),
    n AS (SELECT p_partkey, greatest(
        greatest(0, floor((along + 0.02) / 1.154 + 1e-9)) * greatest(0, floor((slope - 2.278 + 1e-9) / 2.298) + 1),
        greatest(0, floor((along + 0.02) / 2.298 + 1e-9)) * greatest(0, floor((slope - 1.134 + 1e-9) / 1.154) + 1)) AS n FROM r)
    SELECT p_partkey, CASE WHEN n < 6 THEN 0 ELSE n END::BIGINT AS module_count, round(CASE WHEN n < 6 THEN 0 ELSE n END * 0.55, 4) AS dc_kw FROM n""")
def g13_pitched_sizing(spark, sf_dir):
    """The better of portrait and landscape on pitched planes of apartment roofs, within the residential setback."""
    w, d = F.col("p_size") * 0.5 + 8, F.col("p_retailprice") / 200
    azimuth = column("p_partkey", 29, 360)
    plane = geometry.rotated(rectangle(-w / 2, -d / 2, w, d), -azimuth)
    p = table(spark, sf_dir, "part")
    planes = p.select(F.col("p_partkey").alias("bid"), F.lit(0).cast("long").alias("plane"), F.array(plane).alias("rings"), (10.0 + F.col("p_partkey") % 40).alias("pitch"), azimuth.alias("azimuth"))
    homes = planes.select("bid", "rings", F.lit("R-2").alias("occupancy"), F.lit(34.05).alias("lat"), F.lit(0.0).alias("parapet_m"), F.lit(True).alias("mapped"))
    found = sizing.estimate(homes, planes, spark.createDataFrame([], NO_OBSTRUCTIONS))
    return found.select(F.col("bid").alias("p_partkey"), "module_count", F.round("dc_kw", 4).alias("dc_kw"))


ZONES_SQL = """
    z AS (SELECT s_suppkey, s_suppkey % 40 * 30.0 AS zx, s_suppkey // 40 * 30.0 AS zy, 10.0 + s_suppkey % 19 AS zw, 12.0 + s_suppkey % 17 AS zh FROM supplier),
    p AS (SELECT c_custkey, c_custkey * 7 % 1201 + (c_custkey % 3) * 0.4 + 0.013731 AS px, c_custkey * 11 % 103 + (c_custkey % 4) * 0.3 + 0.017177 AS py, 1.0 + c_custkey % 5 AS pw, 1.6 + c_custkey % 3 AS ph FROM customer),
    o AS (SELECT c_custkey, s_suppkey, pw * ph AS whole, (least(px + pw, zx + zw) - greatest(px, zx)) * (least(py + ph, zy + zh) - greatest(py, zy)) AS shared
          FROM p JOIN z ON px < zx + zw AND zx < px + pw AND py < zy + zh AND zy < py + ph)"""


def zones_and_panels(spark, sf_dir):
    """Zones that don't overlap, and panels over them; all turned by 20 degrees."""
    turn = F.lit(20.0)
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    zone = rectangle(column("s_suppkey", 1, 40) * 30, F.floor(F.col("s_suppkey") / 40) * 30.0, 10.0 + F.col("s_suppkey") % 19, 12.0 + F.col("s_suppkey") % 17)
    panel = rectangle(column("c_custkey", 7, 1201) + (F.col("c_custkey") % 3) * 0.4 + 0.013731, column("c_custkey", 11, 103) + (F.col("c_custkey") % 4) * 0.3 + 0.017177, 1.0 + F.col("c_custkey") % 5, 1.6 + F.col("c_custkey") % 3)
    return s.select("s_suppkey", F.array(geometry.rotated(zone, turn)).alias("rings")), c.select("c_custkey", F.array(geometry.rotated(panel, turn)).alias("rings"))


@query("j17_area_fraction", f"""
    WITH {ZONES_SQL} SELECT c_custkey, round(coalesce(any_value(f), 0) + 1e-9, 5) AS fraction, coalesce(any_value(f), 0) >= 0.95 AS kept
    FROM customer LEFT JOIN (SELECT c_custkey, sum(shared)::DOUBLE / any_value(whole)::DOUBLE AS f FROM o GROUP BY c_custkey) USING (c_custkey) GROUP BY c_custkey""")
def j17_area_fraction(spark, sf_dir):
    """Panels by how much of them lies in the usable zones; from 95 % on they are kept."""
    zones, panels = zones_and_panels(spark, sf_dir)
    found = spatial.area_fractions(panels, "c_custkey", "rings", zones, "s_suppkey", "rings", 30.0)
    return found.select("c_custkey", F.round(F.col("fraction") + 1e-9, 5).alias("fraction"), (F.round("fraction", 9) >= 0.95).alias("kept"))


@query("j5_buildings_in_polygon", f"""
    WITH {ZONES_SQL} SELECT s_suppkey, c_custkey, round(whole::DOUBLE, 4) AS m2, round(shared::DOUBLE / whole::DOUBLE + 1e-9, 5) AS share,
        row_number() OVER (PARTITION BY s_suppkey ORDER BY round(whole, 6) DESC, c_custkey)::INT AS rank FROM o WHERE round(shared::DOUBLE / whole::DOUBLE, 9) >= 0.5""")
def j5_buildings_in_polygon(spark, sf_dir):
    """Buildings of which at least half lies on a parcel, the largest first."""
    zones, panels = zones_and_panels(spark, sf_dir)
    found = spatial.mostly_inside(zones, "s_suppkey", "rings", panels, "c_custkey", "rings", 30.0)
    return found.select("s_suppkey", "c_custkey", F.round("m2", 4).alias("m2"), F.round(F.col("share") + 1e-9, 5).alias("share"), "rank")


@query("j8_first_containing", f"""
    WITH {ZONES_SQL} SELECT c_custkey, min(s_suppkey) AS s_suppkey FROM p LEFT JOIN z ON px + pw / 2 BETWEEN zx AND zx + zw AND py + ph / 2 BETWEEN zy AND zy + zh GROUP BY c_custkey""")
def j8_first_containing(spark, sf_dir):
    """The roof that each drawn shape belongs to: the first that has the shape's interior point inside."""
    zones, panels = zones_and_panels(spark, sf_dir)
    return spatial.first_containing(panels, "c_custkey", "rings", zones, "s_suppkey", "rings", "s_suppkey", 30.0)


@query("g1_geodesic_round_trip", """
    SELECT vec_id, round(embedding[1]::DOUBLE * 100000)::DOUBLE AS x, round(embedding[2]::DOUBLE * 100000)::DOUBLE AS y FROM embeddings""")
def g1_geodesic_round_trip(spark, sf_dir):
    """Metres to degrees and back, up to some 50 km away, at latitudes all over the globe: exact to a millimetre."""
    e = table(spark, sf_dir, "embeddings")
    x, y = (F.round(F.col("embedding")[i].cast("double") * 100000) for i in (0, 1))
    lon0, lat0 = (F.col("vec_id") * 31 % 360 - 180).cast("double"), (F.col("vec_id") * 17 % 161 - 80).cast("double")
    there = e.select("vec_id", lon0.alias("lon0"), lat0.alias("lat0"), geometry.geodesic_lonlat(x, y, lon0, lat0).alias("p"))
    back = there.select("vec_id", geometry.geodesic_xy(F.col("p.lon"), F.col("p.lat"), F.col("lon0"), F.col("lat0")).alias("q"))
    return back.select("vec_id", (F.round("q.x", 3) + 0.0).alias("x"), (F.round("q.y", 3) + 0.0).alias("y"))
