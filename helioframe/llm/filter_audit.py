"""Interaction of document filters by inclusion-exclusion over joint failures.

One pass counts, for every set S of filters, the rows that fail all of S: the sum of the product of their flags,
2^k sums for k filters, combined map-side by part. All else is arithmetic on those counts:

* survivors of a set T of filters: the sum over S within T of (-1)^|S| N(S) (Moebius inversion);
* what a filter removes as a step of an order: survivors of the steps before, less survivors of those and it;
* rows that fail one filter only: the same inversion above S = {filter};
* Shapley value: the game "rows removed by T" has the Harsanyi dividends (-1)^(|S|+1) N(S), and a filter's value
  is the sum of dividend / |S| over the sets that hold it. Times k! it is a whole number.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.llm.shared import written

#: The most filters: 2^6 sums of each measure and 720 orders of 6 steps.
MAX_FILTERS = 6


def text_filters(text: str = "d_text") -> dict[str, Column]:
    """Failure conditions A to D on a column without nulls; E needs the whole table (see first_of_text)."""
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    count = F.size("d_words")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "d_words": words,
        "A": count < 200,
        "B": F.lit(100) * F.size(F.array_distinct("d_words")) < F.lit(50) * count,
        "C": F.lit(100) * capitals > F.lit(3) * F.length(text),
        "D": F.col(text).rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, the failure flags A to E, the measures good and toxic, and n: the rows that share an identifier and a text.

    Null texts count as empty, null parts as the empty string. E fails where a smaller identifier has the same
    text anywhere in the table (same SHA-256 and length): a row whose identifier is null, or the smallest of its
    text, doesn't fail. A row is good or toxic if any label row of its identifier says 1; null identifiers have
    no labels. Other columns are ignored; an empty table gives none.

    Hot texts: the smallest identifier of each text is an aggregate with map-side combine, and rows meet it by
    (identifier, text), never by text alone, so that copies spread. Rows without an identifier meet no labels,
    and spread by their text. Whole texts are read once; the flags are written in the shared folder.
    """
    filters = text_filters()
    rows = docs.select(F.col(id_col).alias("d_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("d_text"))
    rows = rows.withColumn("d_words", filters.pop("d_words")).select(
        "d_id", F.unhex(F.sha2("d_text", 256)).alias("d_sha"), F.octet_length("d_text").alias("d_len"), "part", *[test.alias(name) for name, test in filters.items()]
    )
    rows = written(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "flags")
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("l_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("l_good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("l_toxic")
    )
    firsts = rows.where("d_id IS NOT NULL").groupBy(F.col("d_sha").alias("f_sha"), F.col("d_len").alias("f_len")).agg(F.min("d_id").alias("f_id"))
    found = rows.withColumn("d_key", F.coalesce(F.col("d_id").cast("string"), F.hex("d_sha")))
    found = found.join(marks, F.expr("d_key = l_id AND d_id IS NOT NULL"), "left").join(firsts, F.expr("d_id = f_id AND d_sha = f_sha AND d_len = f_len"), "left")
    return found.select(
        "part", *filters, (F.col("d_id").isNotNull() & F.col("f_id").isNull()).alias("E"),
        F.coalesce("l_good", F.lit(0)).alias("good"), F.coalesce("l_toxic", F.lit(0)).alias("toxic"), "n",
    )


def joint_failures(flags: DataFrame, filters: list[str], measures: Mapping[str, Column], part: str = "part") -> DataFrame:
    """A row per part: for each measure an array of 2^k longs, at S the sum of the measure over rows that fail all of S.

    Bit i of S stands for filters[i]. Null flags count as passed.
    """
    failed = {f: F.when(F.col(f), 1).otherwise(0).cast("long") for f in filters}
    rows = flags.select(F.col(part).alias("part"), *[v.alias(f"f_{i}") for i, v in enumerate(failed.values())], *[v.cast("long").alias(f"m_{m}") for m, v in measures.items()])

    def product(measure: str, s: int) -> Column:
        return reduce(lambda p, i: p * F.col(f"f_{i}"), [i for i in range(len(filters)) if s >> i & 1], F.col(f"m_{measure}"))

    sums = rows.groupBy("part").agg(*[F.sum(product(m, s)).alias(f"{m}_{s}") for m in measures for s in range(1 << len(filters))])
    return sums.select("part", *[F.array(*[F.col(f"{m}_{s}") for s in range(1 << len(filters))]).alias(m) for m in measures])


def survivors(joint: Column, k: int) -> Column:
    """From joint failures N(S), the array of rows that pass every filter of T, for each set T."""
    return F.array(*[reduce(lambda a, b: a + b, [F.get(joint, F.lit(s)) * (-1) ** s.bit_count() for s in range(1 << k) if s & t == s]) for t in range(1 << k)])


def only_failures(joint: Column, k: int) -> Column:
    """From joint failures, the array of rows that fail one filter and no other."""
    return F.array(*[reduce(lambda a, b: a + b, [F.get(joint, F.lit(s)) * (-1) ** (s.bit_count() - 1) for s in range(1 << k) if s >> i & 1]) for i in range(k)])


def shapley(joint: Column, k: int) -> Column:
    """From joint failures, k! times each filter's Shapley value of the rows removed: dividends shared by set size."""
    return F.array(
        *[reduce(lambda a, b: a + b, [F.get(joint, F.lit(s)) * ((-1) ** (s.bit_count() + 1) * factorial(k) // s.bit_count()) for s in range(1 << k) if s >> i & 1]) for i in range(k)]
    )


def audit(flags: DataFrame, filters: list[str], measures: Mapping[str, Column], part: str = "part") -> DataFrame:
    """A row per part, order of the filters (all k!) and step, as counts of longs.

    measures must hold "rows"; each other measure m gives a column m_lost. Columns: part, filter_order (the names
    strung together), step from 1, kept (after the step), removed (here), redundant (failing this filter, but
    removed before), unique_fails (failing this filter only), the m_lost (removed here) and shapley (removed by
    this filter, summed over all orders). Names of filters must be one letter each, and different.
    """
    k = len(filters)
    if not 1 <= k <= MAX_FILTERS or len(set(filters)) < k or any(len(f) != 1 for f in filters):
        raise ValueError(f"1 to {MAX_FILTERS} filters with different names of one letter")
    letters = "".join(filters)
    counts = joint_failures(flags, filters, measures, part)
    counts = counts.select(
        "part", only_failures(F.col("rows"), k).alias("only"), shapley(F.col("rows"), k).alias("value"),
        F.array(*[F.get("rows", F.lit(1 << i)) for i in range(k)]).alias("fails"), *[survivors(F.col(m), k).alias(f"after_{m}") for m in measures],
    )
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    steps = counts.withColumn("filter_order", F.explode(orders)).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    place = F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    before = reduce(lambda a, b: a + b, [F.when(F.instr(earlier, f) > 0, 1 << i).otherwise(0) for i, f in enumerate(filters)])  # the earlier filters, as bits
    steps = steps.withColumn("i", place.cast("int")).withColumn("before", before).withColumn("now", F.col("before") + F.call_function("shiftleft", F.lit(1), F.col("i")))

    def removed(m: str) -> Column:
        return F.get(f"after_{m}", F.col("before")) - F.get(f"after_{m}", F.col("now"))

    return steps.select(
        "part", "filter_order", "step", F.get("after_rows", F.col("now")).alias("kept"), removed("rows").alias("removed"), (F.get("fails", F.col("i")) - removed("rows")).alias("redundant"),
        F.get("only", F.col("i")).alias("unique_fails"), *[removed(m).alias(f"{m}_lost") for m in measures if m != "rows"], F.get("value", F.col("i")).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of filters A to E over documents, with good (labels.quality = 1) and toxic (labels.toxic = 1) rows lost."""
    flags = flagged(docs, labels, id_col, text_col, part_col)
    n = F.col("n")
    return audit(flags, list("ABCDE"), {"rows": n, "good": n * F.col("good"), "toxic": n * F.col("toxic")})
