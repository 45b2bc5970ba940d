"""Spatial joins by grid cells: the range condition becomes an equality, so no nested-loop join is planned.

Cells that many rows share are split by Spark's skew handling; a pair of rows meets in exactly one cell
of the point side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.functions import geometry
from helioframe.operators import overlay

# Mapped classes that are no homes.
NONRESIDENTIAL = ["retail", "commercial", "warehouse", "industrial", "office", "supermarket", "manufacture", "service", "parking", "school", "hospital", "church"]


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("bigint")


#: The cell that pairs met in (see points_near_boxes), and tasks over which such cells are dealt.
MET, MET_TASKS = ["x_cx", "x_cy"], 512


def points_near_boxes(points: DataFrame, boxes: DataFrame, reach: float, size: float | None = None, met: bool = False) -> DataFrame:
    """Points (px, py) with the boxes (xmin, ymin, xmax, ymax) within reach, and the distance d to each.

    With met, pairs keep the cell they met in (MET). All of a point's are in its one cell, and cells are dealt over
    MET_TASKS, so a window by MET and the point takes pairs where they met: points and boxes are moved, pairs are not.
    """
    size = size or max(reach, 1e-9)
    p = points.withColumn("x_cx", cell(F.col("px"), size)).withColumn("x_cy", cell(F.col("py"), size))
    span = lambda a, b: F.sequence(cell(F.col(a) - reach, size), cell(F.col(b) + reach, size))
    b = boxes.withColumn("x_cx", F.explode(span("xmin", "xmax"))).withColumn("x_cy", F.explode(span("ymin", "ymax")))
    p = p.repartition(MET_TASKS, *MET) if met else p
    pairs = p.join(b, MET).withColumn("d", box_distance()).where(F.col("d") <= reach)
    return pairs if met else pairs.drop(*MET)


def points_near_nearest_boxes(points: DataFrame, key: str, boxes: DataFrame, reach: float, k: int, levels: int = 8) -> DataFrame:
    """points_near_boxes without boxes farther from a point (key, unique) than its k-th nearest: for what is nearest, not for all.

    Where k boxes have their middle in a point's cell of a grid, its k-th nearest box is no farther than that cell is
    wide across. The finest grid in which that is so bounds how far a point looks; without one it looks as far as reach.
    """
    grids = F.explode(F.array(*[F.lit(reach / 2**n) for n in range(levels)]))
    at = lambda x: F.floor(x / F.col("x_size")).cast("bigint")
    celled = lambda df, x, y: df.withColumn("x_size", grids).withColumns({"x_cx": at(x), "x_cy": at(y)})
    middles = celled(boxes, (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2).groupBy("x_size", "x_cx", "x_cy").agg(F.count("*").alias("x_n")).where(F.col("x_n") >= k).drop("x_n")
    bounds = celled(points, F.col("px"), F.col("py")).select(key, "x_size", "x_cx", "x_cy").join(middles, ["x_size", "x_cx", "x_cy"]).groupBy(key).agg(F.min("x_size").alias("x_across"))
    looking = points.join(bounds, key, "left").withColumn("x_bound", F.least(F.coalesce(F.col("x_across") * (2**0.5 * (1 + 1e-9)), F.lit(reach)), F.lit(reach))).drop("x_across")
    close = F.col("x_bound") <= reach / 4
    pairs = points_near_boxes(looking.where(close), boxes, reach / 4).unionByName(points_near_boxes(looking.where(~close), boxes, reach))
    return pairs.where(F.col("d") <= F.col("x_bound")).drop("x_bound")


def box_distance() -> Column:
    dx = F.greatest(F.col("xmin") - F.col("px"), F.lit(0.0), F.col("px") - F.col("xmax"))
    dy = F.greatest(F.col("ymin") - F.col("py"), F.lit(0.0), F.col("py") - F.col("ymax"))
    return F.sqrt(dx * dx + dy * dy)


def points_near_points(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """Pairs of points (ax, ay) and (bx, by) within reach, and their distance d."""
    left = a.withColumn("x_cx", cell(F.col("ax"), reach)).withColumn("x_cy", cell(F.col("ay"), reach))
    around = lambda c: F.explode(F.sequence(cell(F.col(c), reach) - 1, cell(F.col(c), reach) + 1))
    right = b.withColumn("x_cx", around("bx")).withColumn("x_cy", around("by"))
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return left.join(right, ["x_cx", "x_cy"]).drop("x_cx", "x_cy").withColumn("d", d).where(F.col("d") <= reach)


def nearest_with_runner_up(pairs: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The nearest match of each key and the distance of the second one."""
    w = Window.partitionBy(key).orderBy(*order)
    return pairs.withColumn("runner_up_d", F.lead("d").over(w)).withColumn("x_place", F.row_number().over(w)).where("x_place = 1").drop("x_place")


def campus(pairs: DataFrame, key: str | list[str], order: list[Column | str], radius: float, least_area: float) -> DataFrame:
    """The nearest match, and further ones within radius that are large enough (d_center, area)."""
    ranked = pairs.withColumn("match_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where((F.col("match_rank") == 1) | ((F.col("d_center") <= radius) & (F.col("area") >= least_area)))


def containing_else_nearest(pairs: DataFrame, key: str, order: str) -> DataFrame:
    """The first box that contains the point (d = 0), else the nearest one."""
    inside = F.col("d") == 0
    w = Window.partitionBy(key).orderBy(F.desc(inside), F.when(inside, F.lit(0.0)).otherwise(F.col("d")), order)
    return pairs.withColumn("x_place", F.row_number().over(w)).where("x_place = 1").drop("x_place").withColumn("contains", inside)


def home_like(pairs: DataFrame, key: str | list[str], order: list[Column | str], n: int, most_area: float = 1200.0, most_height: float = 13.0, pool: int = 4) -> DataFrame:
    """Matches that look like a community's homes (mapped, height_m, area), with their rank and whether the pool is full.

    Non-residential, tall and very large ones go; of the rest, those of 0.5 to 2 times the upper median
    area of the nearest pool * n stay (pool_full: there are so many).
    """
    home = ~F.coalesce(F.col("mapped").isin(NONRESIDENTIAL), F.lit(False)) & (F.col("height_m").isNull() | (F.col("height_m") <= most_height)) & (F.col("area") <= most_area)
    ranked = pairs.where(home).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    pooled = F.array_sort(F.collect_list(F.when(F.col("rank") <= pool * n, F.col("area"))).over(Window.partitionBy(key)))
    middle = ranked.withColumn("x_pool", pooled).withColumn("x_middle", F.get("x_pool", F.floor(F.size("x_pool") / 2).cast("int")))
    alike = middle.where(F.col("area").between(0.5 * F.col("x_middle"), 2.0 * F.col("x_middle")))
    return alike.withColumn("pool_full", F.size("x_pool") >= pool * n).drop("x_pool", "x_middle")


def distinct_on_boxes(pairs: DataFrame, boxes: DataFrame, key: str, what: list[str]) -> DataFrame:
    """How many distinct (what) lie on each box; 0 where none do."""
    counts = pairs.groupBy(key).agg(F.countDistinct(F.struct(*what)).alias("homes"))
    return boxes.select(key).join(counts, key, "left").withColumn("homes", F.coalesce("homes", F.lit(0)))


def bounds(rings: str) -> dict[str, Column]:
    """The box of an array of rings, as columns xmin, ymin, xmax, ymax."""
    values = {c: F.flatten(rings)[c] for c in ("x", "y")}
    return {f"{c}{e}": f(v) for c, v in values.items() for e, f in (("min", F.array_min), ("max", F.array_max))}


def meeting_boxes(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Rows of a and b whose boxes (b's columns named b_xmin and so on) have a common area; each pair meets in one cell."""

    def celled(df: DataFrame, p: str) -> DataFrame:
        span = lambda c: F.explode(F.sequence(cell(F.col(f"{p}{c}min"), size), cell(F.col(f"{p}{c}max"), size)))
        return df.withColumn("x_cx", span("x")).withColumn("x_cy", span("y"))

    pairs = celled(a, "").join(celled(b, "b_"), ["x_cx", "x_cy"])
    common = (F.col("xmin") < F.col("b_xmax")) & (F.col("b_xmin") < F.col("xmax")) & (F.col("ymin") < F.col("b_ymax")) & (F.col("b_ymin") < F.col("ymax"))
    first = (F.col("x_cx") == cell(F.greatest("xmin", "b_xmin"), size)) & (F.col("x_cy") == cell(F.greatest("ymin", "b_ymin"), size))
    return pairs.where(common & first).drop("x_cx", "x_cy")


def near_pairs(shapes: DataFrame, key: str, rings: str, others: DataFrame, other_key: str, other_rings: str, size: float) -> DataFrame:
    """key, other_key and both shapes' rings (rings, b_rings) where their boxes have a common area."""
    a = shapes.select(key, F.col(rings).alias("rings")).withColumns(bounds("rings"))
    b = others.select(other_key, F.col(other_rings).alias("b_rings")).withColumns({f"b_{c}": v for c, v in bounds("b_rings").items()})
    return meeting_boxes(a, b, size).select(key, other_key, "rings", "b_rings")


def area_fractions(shapes: DataFrame, key: str, rings: str, zones: DataFrame, zone_key: str, zone_rings: str, size: float) -> DataFrame:
    """key and fraction: how much of each shape's area lies in the zones, which count once where they overlap.

    Shapes without an area have no fraction (null). size is that of the cells in which shapes and zones meet: about
    that of a usual zone.
    """
    pairs = near_pairs(shapes, key, rings, zones, zone_key, zone_rings, size)
    own = overlay.edges(shapes, [key], F.lit("shape"), F.col(rings))
    edges = own.unionByName(overlay.edges(pairs, [key], F.lit("zone"), F.col("b_rings")))
    covered = overlay.areas(overlay.overlay(edges, [key], ["shape", "zone"], F.col("in_shape") & F.col("in_zone"), tiles=True), [key], "covered")
    whole = overlay.areas(overlay.overlay(own, [key], ["shape"], F.col("in_shape"), tiles=True), [key], "whole")
    found = whole.join(covered, key, "left").select(key, (F.coalesce("covered", F.lit(0.0)) / F.col("whole")).alias("fraction"))
    return shapes.select(key).join(found, key, "left")


def mostly_inside(areas: DataFrame, key: str, rings: str, buildings: DataFrame, building_key: str, building_rings: str, size: float, least: float = 0.5) -> DataFrame:
    """Buildings of which a share of at least least lies in an area: key, building_key, m2, share, rank (largest first).

    A building may lie in several areas; equally large ones rank by their keys.
    """
    pairs = near_pairs(areas, key, rings, buildings, building_key, building_rings, size)
    both = [key, building_key]
    edges = overlay.edges(pairs, both, F.lit("area"), F.col("rings")).unionByName(overlay.edges(pairs, both, F.lit("building"), F.col("b_rings")))
    wanted = overlay.overlay(edges, both, ["area", "building"], F.col("in_building"), tiles=True).groupBy(*both)
    whole = wanted.agg(F.sum(overlay.trapezoid_area()).alias("m2"))
    shared = overlay.areas(overlay.overlay(edges, both, ["area", "building"], F.col("in_building") & F.col("in_area"), tiles=True), both, "shared")
    found = whole.join(shared, both).withColumn("share", F.col("shared") / F.col("m2")).where(F.col("share") >= least - 1e-9)
    return found.select(*both, "m2", "share", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("m2", 6)), building_key)).alias("rank"))


def covers(rings: str, x: Column, y: Column) -> Column:
    """Whether a shape with holes has a point inside."""
    return F.size(F.filter(rings, lambda r: geometry.contains(r, x, y))) % 2 == 1


def first_containing(extras: DataFrame, key: str, rings: str, roofs: DataFrame, roof_key: str, roof_rings: str, order: str, size: float) -> DataFrame:
    """key and roof_key: of each extra shape the first roof, by order, that has the shape's interior point inside.

    Extras that lie in no roof have a null roof_key (see unowned), as have those without an area.
    """
    points = overlay.interior_points(extras, [key], rings).withColumns({"px": F.col("x"), "py": F.col("y")})
    boxes = roofs.select(roof_key, F.col(order).alias("x_order"), F.col(roof_rings).alias("x_rings")).withColumns(bounds("x_rings"))
    near = points_near_boxes(points, boxes, 0.0, size).where(covers("x_rings", F.col("px"), F.col("py")))
    first = near.groupBy(key).agg(F.min_by(roof_key, F.struct("x_order", roof_key)).alias(roof_key))
    return extras.select(key).join(first, key, "left")


def unowned(owned: DataFrame, key: str, roof_key: str) -> None:
    """Raise for extras outside of all roofs, with the first of their keys."""
    lost = owned.where(F.col(roof_key).isNull()).orderBy(key).limit(5).collect()
    if lost:
        raise ValueError("not inside any roof outline: " + ", ".join(str(r[key]) for r in lost))
