"""Exact order statistics of groups of any size, all groups, columns and ranks in the same passes.

Three passes count values: in buckets of equal ratio, within the bucket that a rank falls into in cells of equal
width, and within that cell value by value. Counts are combined map-side, so what a pass shuffles are counts, and the
rows of the brackets that are still open; no group's values are gathered, and nothing comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.operators.stages import stored

#: Buckets of a doubling in the first pass, cells of a bucket in the second.
PER_DOUBLING, CELLS = 64, 4096


def at_rank(df: DataFrame, by: list[str], value: str, rank: Column, name: str) -> DataFrame:
    """Per group, the value at a 0-based rank computed from the group's size column `n`."""
    w = Window.partitionBy(*by)
    rows = df.where(F.col(value).isNotNull()).withColumn("n", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(value)) - 1)
    return rows.where(F.col("place") == rank).select(*by, F.col(value).alias(name))


def same(by: list[str]) -> Column:
    """A row's group is that of the row joined to it, whose columns are named g_...; null is a group of its own."""
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in by), F.lit(True))


def long_form(rows: DataFrame, by: list[str], values: Mapping[str, str], more: list[str] | None = None) -> DataFrame:
    """by..., more..., c and v: the values of several columns (c: its name here, v: the value) below each other, nulls left out."""
    each = F.array(*[F.struct(F.lit(c).alias("c"), F.col(v).cast("double").alias("v")) for c, v in values.items()])
    return rows.select(*by, *(more or []), F.explode(each).alias("x")).select(*by, *(more or []), "x.c", "x.v").where("v is not null")


def bucket(v: Column) -> Column:
    """A number that never falls as v grows; NaN comes last, as in Spark's order."""
    size = F.floor(F.log2(F.abs(v)) * PER_DOUBLING) + 100_000.0
    return F.when(F.isnan(v), 1e9).when(v == 0, 0.0).when(F.abs(v) == math.inf, F.signum(v) * 1e8).otherwise(F.signum(v) * size)


def placed(counts: DataFrame, key: list[str], order: str) -> DataFrame:
    """counts with below: how many values of the key come before."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("below", F.sum("m").over(w) - F.col("m"))


def selected(long: DataFrame, by: list[str], ranks: Mapping[str, Mapping[str, Column]], tests: str | None = None, few: bool = False) -> DataFrame:
    """by..., c, n (how many values), name and value: for each column c of a long form, the values at named ranks.

    A rank is 0-based and computed from n. With tests, the name of an array column of long, a row counts in every group
    of its array, whose name comes as column test: what is counted is multiplied, not the rows. Groups may be null.
    With few, the groups are a short list: their brackets are broadcast, as else all rows of a group meet in one task.
    """
    own = [*by, "c"]
    raw = long.groupBy(*own, *([tests] if tests else []), bucket(F.col("v")).alias("b")).agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    if tests:
        own = [*by, "test", "c"]
        raw = raw.withColumn("test", F.explode(tests)).groupBy(*own, "b").agg(F.sum("m").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    wanted = reduce(lambda rest, c: F.when(F.col("c") == c, F.array(*[F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank")) for k, r in ranks[c].items()])).otherwise(rest), ranks, F.lit(None))
    counts = placed(raw.withColumn("n", F.sum("m").over(Window.partitionBy(*own))), own, "b").withColumn("r", F.explode(wanted))
    here = (F.col("below") <= F.col("r.rank")) & (F.col("r.rank") < F.col("below") + F.col("m"))
    brackets = counts.where(here).select(*own, "n", "r.name", (F.col("r.rank") - F.col("below")).alias("rest"), "lo", "hi")

    def inside(brackets: DataFrame, cell: Column) -> DataFrame:
        """The counts of each bracket's cells, and where the rank is among them."""
        named = brackets.withColumnsRenamed({c: f"k_{c}" for c in own})
        match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in own if c != "test"])
        if tests:
            match &= F.array_contains(tests, F.col("k_test"))
        key = [*(f"k_{c}" for c in own), "n", "name", "rest"]
        met = long.join(F.broadcast(named) if few else named, match & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        found = met.groupBy(*key, cell.alias("b")).agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        found = placed(found, key, "b").where((F.col("below") <= F.col("rest")) & (F.col("rest") < F.col("below") + F.col("m")))
        return found.select(*[F.col(f"k_{c}").alias(c) for c in own], "n", "name", (F.col("rest") - F.col("below")).alias("rest"), F.col("low").alias("lo"), F.col("high").alias("hi"))

    width = F.col("hi") - F.col("lo")
    cell = F.when((F.abs(F.col("lo")) < math.inf) & (width > 0), F.floor((F.col("v") - F.col("lo")) / (width / CELLS)).cast("double")).otherwise(0.0)
    last = inside(inside(brackets, cell), F.col("v"))
    return last.select(*own, "n", "name", F.col("lo").alias("value"))


def wide(found: DataFrame, by: list[str], ranks: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """A row per group with n_<c> and the columns <c>_<name> of selected."""
    at = lambda c, k: F.max(F.when((F.col("c") == c) & (F.col("name") == k), F.col("value"))).alias(f"{c}_{k}")
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("c") == c, F.col("n"))).alias(f"n_{c}") for c in ranks], *[at(c, k) for c in ranks for k in ranks[c]])


def ranks_by(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Per group, the values at named 0-based ranks, each computed from the group's size n (nulls left out)."""
    found = wide(selected(long_form(df, by, {"v": value}), by, {"v": ranks}), by, {"v": ranks})
    return found.select(*by, *[F.col(f"v_{k}").alias(k) for k in ranks])


def order_statistics(df: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """The values at 0-based ranks of a whole column of doubles (nulls left out)."""
    found = ranks_by(df, [], value, {f"r{k}": F.lit(k) for k in set(ranks)}).first()
    return [found[f"r{k}"] for k in ranks]


def median(df: DataFrame, value: str) -> float | None:
    """The interpolating median of a whole column, or None if it has no value."""
    found = ranks_by(df, [], value, median_ranks("m")).first()
    return None if found is None or found["m_lo"] is None else (found["m_lo"] + found["m_hi"]) / 2


def median_ranks(name: str) -> dict[str, Column]:
    """The two ranks whose mean is the interpolating median."""
    return {f"{name}_lo": F.floor((F.col("n") - 1) / 2), f"{name}_hi": F.floor(F.col("n") / 2)}


def with_medians(base: DataFrame, df: DataFrame, by: list[str], values: dict[str, str], more: dict[str, dict[str, Column]] | None = None, few: bool = False) -> DataFrame:
    """base (a row per group) with medians of df's value columns, and with `more` values at ranks: column to names and ranks."""
    ranks = {name: median_ranks("x") | (more or {}).get(value, {}) for name, value in values.items()}
    long = stored(long_form(df, by, values))
    got = wide(selected(long, by, ranks, few=few), by, ranks)
    medians = [((F.col(f"{name}_x_lo") + F.col(f"{name}_x_hi")) / 2).alias(name) for name in values]
    got = got.select(*(F.col(c).alias(f"g_{c}") for c in by), *medians, *[F.col(f"{name}_{k}").alias(k) for name, value in values.items() for k in (more or {}).get(value, {})])
    return base.join(got, same(by), "left").drop(*(f"g_{c}" for c in by))


def upper_median_rank() -> Column:
    return F.floor(F.col("n") / 2)


def lower_quartile_rank() -> Column:
    return F.floor(F.col("n") / 4)


def p90_floor_rank() -> Column:
    return F.floor(0.9 * (F.col("n") - 1))


def p90_round_rank() -> Column:
    """The half-even rounding of 0.9 * (n - 1)."""
    return F.bround(0.9 * (F.col("n") - 1), 0).cast("bigint")


def fraction_rank(f: float) -> Column:
    return F.least(F.col("n") - 1, F.floor(f * F.col("n")))
