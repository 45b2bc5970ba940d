"""Exact deduplication by a tree of merges of sorted digest runs.

Every input partition becomes one run: its distinct digests in order, with the smallest identifier and
the count of each. In binomial rounds, runs whose numbers agree but for their lowest FAN_BITS bits meet and
merge into one, until one run is left. A run is cut at fixed places of the digest's range into slots, so a
task of a round gets the same slot of all runs that meet, puts the pieces in order and merges them in
one pass over neighbours (a sort aggregate behind an exchange by run and slot): it holds no group in memory,
and the last round has as many tasks as the first. With one input partition there is no round. Then the
kept identifiers go down the same way: from the last run to the leaf runs, and from a leaf run to its
rows, so that no task gets more than one row per leaf run of a digest, however many copies it has.

Two texts count as equal if they agree in SHA-256, length and a second 64-bit hash of the normalised
text ("verified"), at every level; a digest on its own never merges rows.

Null texts count as empty; empty texts are equal to each other. Of repeated identifiers, each row is
reported. A null identifier is never the smallest: such rows are not kept, and where a text has no other
rows its keep_id is null. Columns besides the identifier and the text are left alone. An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.llm.shared import without, written

#: Runs that meet in a round differ in so many bits of their numbers.
FAN_BITS = 3
#: Slots of a run, as a power of two: the first bits of the digest.
SLOT_BITS = 12
KEY = ["d_sha", "d_len", "d_xx"]


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: identifier, run, slot and the three parts of its digest, written out.

    The texts are read once here and never shuffled.
    """
    n = docs.select(F.col(id_col).alias("d_id"), normalised(F.col(text_col)).alias("d_text"))
    rows = n.select("d_id", F.spark_partition_id().alias("d_run"), F.sha2("d_text", 256).alias("d_hex"), F.length("d_text").alias("d_len"), F.xxhash64("d_text").alias("d_xx"))
    slot = F.shiftright(F.conv(F.substring("d_hex", 1, 4), 16, 10).cast("int"), 16 - SLOT_BITS)
    return written(rows.select("d_id", "d_run", slot.alias("d_slot"), F.unhex("d_hex").alias("d_sha"), "d_len", "d_xx"), "digests")


def merged(runs: DataFrame, least: Column, count: Column) -> DataFrame:
    """One row per digest of each run and slot: the smallest identifier and the count.

    The smallest identifier is taken as a struct, which Spark merges by a sort aggregate: neighbours in order.
    """
    found = runs.groupBy("d_run", "d_slot", *KEY).agg(F.min(F.struct(least.isNull().alias("none"), least.alias("id"))).alias("least"), F.sum(count).alias("d_n"))
    return found.select("d_run", "d_slot", *KEY, F.col("least.id").alias("d_min"), "d_n")


def merge_round(runs: DataFrame, parts: int) -> DataFrame:
    """Bring together the runs that differ in the lowest FAN_BITS bits, slot by slot and in order, and merge them."""
    meet = runs.withColumn("d_run", F.shiftright("d_run", FAN_BITS))
    dealt = meet.repartition(parts, "d_run", "d_slot").sortWithinPartitions("d_run", "d_slot", *KEY)
    return merged(dealt, F.col("d_min"), F.col("d_n"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept and text_sha256."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    leaves = digest_runs(docs, id_col, text_col)
    base = level = written(merged(leaves, F.col("d_id"), F.lit(1)), "run0")
    last = level.agg(F.max("d_run")).first()[0] or 0
    k = 0
    while last > 0:
        level, last, k = merge_round(level, parts), last >> FAN_BITS, k + 1
        if k % 3 == 0:
            level = written(level, f"run{k}")
    whole = level.select(*KEY, F.col("d_min").alias("keep_id"), F.col("d_n").alias("group_size"))
    down = base.select("d_run", *KEY).join(whole, KEY)
    rows = leaves.join(down, ["d_run", *KEY])
    kept = F.coalesce(F.col("d_id") == F.col("keep_id"), F.lit(False))
    return rows.select(F.col("d_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("d_sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their columns unchanged (identifiers must be unique; rows without one stay)."""
    return without(docs, exact_duplicates(docs, id_col, text_col).where(F.col(id_col).isNotNull() & ~F.col("kept")), id_col)
