"""Operators in which the order of rows matters: first wins, numbering, runs, intervals, rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("x_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("x_place = 1").drop("x_place")


def top_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def unique_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Later rows of the same name get a suffix: ' (2)', ' (3)', ..."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("unique_name", F.when(k > 1, F.format_string("%s (%d)", F.col(name), k)).otherwise(F.col(name)))


def numbered_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Rows of a name that occurs several times get ' #1', ' #2', ..."""
    w = Window.partitionBy(name)
    k, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    return df.withColumn("numbered", F.when(n > 1, F.format_string("%s #%d", F.col(name), k)).otherwise(F.col(name)))


def first_claimant(df: DataFrame, item: str, claimant: str, order: list[str]) -> DataFrame:
    """Who claimed each item first, and a reason code for every later claimant."""
    first = F.first_value(F.col(claimant)).over(Window.partitionBy(item).orderBy(*order))
    rows = df.withColumn("owner", first)
    return rows.withColumn("reason", F.when(F.col("owner") != F.col(claimant), F.concat(F.lit("same_building_as_site_"), F.col("owner").cast("string"))))


def dominant(df: DataFrame, group: str, label: Column, weight: Column, order: str) -> DataFrame:
    """The label with the largest total weight in each group; the first inserted wins ties."""
    sums = df.groupBy(group, label.alias("label")).agg(F.sum(weight).alias("weight"), F.min(order).alias("first_seen"))
    return first_by_key(sums, [group], [F.desc("weight"), "first_seen", "label"]).select(group, "label", "weight")


def running_offset(df: DataFrame, group: str, order: list[str], size: str) -> DataFrame:
    """The sum of the sizes before each row of its group."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def runs(df: DataFrame, group: list[str], position: str) -> DataFrame:
    """Maximal runs of consecutive positions (gaps and islands): start, end, cells."""
    w = Window.partitionBy(*group).orderBy(position)
    marked = df.withColumn("x_new", (F.col(position) - F.lag(position).over(w) > 1).cast("int"))
    numbered = marked.withColumn("x_run", F.sum(F.coalesce("x_new", F.lit(1))).over(w))
    return numbered.groupBy(*group, "x_run").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count("*").alias("cells")).drop("x_run")


def merged_intervals(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals as one."""
    w = Window.partitionBy(group).orderBy(start, end)
    so_far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("x_new", F.when(so_far.isNull() | (F.col(start) > so_far), 1).otherwise(0))
    numbered = marked.withColumn("x_run", F.sum("x_new").over(w))
    return numbered.groupBy(group, "x_run").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("x_run")


def free_intervals(df: DataFrame, group: str, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """What blocked intervals leave free between low and high."""
    blocked = merged_intervals(df, group, start, end)
    w = Window.partitionBy(group).orderBy("start")
    before = blocked.select(group, F.coalesce(F.lag("end").over(w), low).alias("free_start"), F.col("start").alias("free_end"))
    last = blocked.groupBy(group).agg(F.max("end").alias("free_start")).select(group, "free_start", high.alias("free_end"))
    return before.unionByName(last).where("free_end > free_start")


def moving(df: DataFrame, group: list[str], position: str, value: str, size: int, how: str) -> Column:
    half = size // 2
    w = Window.partitionBy(*group).orderBy(position).rowsBetween(-half, half)
    return (F.min if how == "min" else F.max)(value).over(w)


def opening(grid: DataFrame, raster: list[str], row: str, col: str, z: str, size: int) -> DataFrame:
    """Grey opening of dense rasters by a size x size square: erosion, then dilation, rows and columns apart."""
    out = grid
    for how in ("min", "max"):
        out = out.withColumn("x_line", moving(out, [*raster, row], col, z if how == "min" else "opened", size, how))
        out = out.withColumn("opened", moving(out, [*raster, col], row, "x_line", size, how))
    return out.drop("x_line")


def as_of_pair(queries: DataFrame, points: DataFrame, keys: list[str], at: str, value: str, order: str, most_gap: float) -> DataFrame:
    """Each query interpolated between the nearest lower and upper points of its key.

    Points with equal positions count once, the first in order; queries on a point take its value. A gap
    of more than most_gap gives null.
    """
    one = first_by_key(points, [*keys, at], [order]).select(*keys, at, F.col(value).alias("x_value"))
    marks = queries.select(*keys, at, F.struct(*queries.columns).alias("x_query")).withColumn("x_value", F.lit(None).cast("double"))
    both = marks.unionByName(one.withColumn("x_query", F.lit(None).cast(marks.schema["x_query"].dataType)))
    point = F.when(F.col("x_query").isNull(), F.struct(F.col(at).alias("a"), F.col("x_value").alias("v")))
    w = Window.partitionBy(*keys).orderBy(at, F.col("x_query").isNotNull())
    upward = Window.partitionBy(*keys).orderBy(F.desc(at), F.col("x_query").isNotNull())
    seen = both.withColumn("lo", F.last(point, True).over(w)).withColumn("hi", F.last(point, True).over(upward)).where("x_query is not null")
    gap = F.col("hi.a") - F.col("lo.a")
    between = F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * (F.col(at) - F.col("lo.a")) / gap
    fit = F.when(gap == 0, F.col("lo.v")).when((gap > 0) & (gap <= most_gap), between)
    return seen.select("x_query.*", F.col("lo.a").alias("lower_at"), F.col("hi.a").alias("upper_at"), fit.alias("interpolated"))
