"""What several operators need: a shared work folder, written tables, Arrow tasks and connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode a fresh one where it is unset.

    On a cluster without the setting this raises an error: each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Bytes of a batch between the JVM and Python, where the session has Spark's own default of 64 MB.
BATCH_BYTES = 2 << 20


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with small batches, and with the memory of a task given back at its end."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(64 << 20):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(task, schema)


def release() -> None:
    """Give free memory back to the system: Python workers are used again, and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: it cuts lineage and survives lost executors.

    Spark drops the files of a shuffle once the plans that read it are garbage. They are, after the write;
    asking for a collection keeps a long job from holding the disk of all its shuffles.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    release()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that written() made, once everything that reads it has been written itself."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of the largest filter in likely_in, as a power of two: 1 MB, however many keys there are.
FILTER_BITS = 23


def likely_in(keys: DataFrame, key: str) -> Column:
    """A condition on a column named key that holds for all keys and for few other values (a Bloom filter).

    It is a constant of the plan, to be checked before a shuffle: 16 bits for each key, up to 2^FILTER_BITS in
    all. With very many keys it lets more through, so an exact join has to follow.
    """
    bits = min(FILTER_BITS, max(12, (16 * keys.count()).bit_length()))
    cell = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    bit = cell.bitwiseAND(F.lit(63)).cast("int")
    words = keys.select(F.shiftright(cell, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = [0] * (1 << bits - 6)
    for r in words.toLocalIterator():
        table[r["w"]] = r["b"]
    constant = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    return F.call_function("shiftrightunsigned", F.get(constant, F.shiftright(cell, 6)), bit).bitwiseAND(F.lit(1)) == 1


#: Bits of the largest table of members, as a power of two: 64 MB, enough for 30 million hashes.
TABLE_BITS = 29


@dataclass
class Members:
    """A table of bits that holds all of a set of 64-bit hashes, and few others."""

    words: np.ndarray
    bits: int

    def has(self, h: np.ndarray) -> np.ndarray:
        cell = h >> np.uint64(64 - self.bits)
        return (self.words[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) == 1


def members(hashes: DataFrame, column: str) -> Members:
    """The table of a column of well-mixed longs: 16 bits or more for each, up to 2^TABLE_BITS in all.

    Past that size it stays as it is and lets more through; whoever asks it must get the same result then.
    """
    bits = min(TABLE_BITS, max(16, (16 * hashes.count()).bit_length()))
    cell = F.shiftrightunsigned(column, 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), cell.bitwiseAND(F.lit(63)).cast("int"))
    table = np.zeros(1 << bits - 6, dtype=np.int64)
    for r in hashes.select(F.shiftright(cell, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        table[r["w"]] = r["b"]
    return Members(table.view(np.uint64), bits)


def without(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose identifier is in dropped (id_col).

    Only the rows that the filter takes for dropped ones are shuffled, for the exact anti-join; the
    others, texts and all, stay where they are. Rows with a null in id_col stay.
    """
    dropped = written(dropped.select(id_col).distinct(), "dropped")
    perhaps = F.coalesce(likely_in(dropped, id_col), F.lit(False))
    rest = docs.where(perhaps).join(dropped, id_col, "left_anti").select(*docs.columns)
    return docs.where(~perhaps).unionByName(rest)


#: A node with more neighbours than this, and than a ten-thousandth of all edges, is a hub: at most 20,000 nodes are.
HUB = 10_000


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Connected components of an edge list by alternating large-star and small-star rounds.

    Returns node, root (the smallest node of its component) for every node of an edge; nodes without
    an edge are their own roots and are not returned. Each round keeps at most as many edges as there
    are; no component is ever gathered in one task: the neighbours of hubs meet a broadcast of the hubs,
    of which there are 20,000 at most, and stay where they are. Null ends are dropped, repeated edges and
    loops make no difference, and an empty edge list gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    pairs = written(pairs, "edges")
    count = pairs.count()
    most = max(HUB, count // 10_000)

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        """rows with the m of their u."""
        if count <= HUB:  # no node can be a hub
            return rows.join(least.drop("c"), "u")
        usual = rows.join(least.where(F.col("c") <= most).drop("c"), "u")
        return usual.unionByName(rows.join(F.broadcast(least.where(F.col("c") > most).drop("c")), "u"))

    for _ in range(rounds):
        # large star: every larger neighbour of u hangs on u's smallest neighbour (or u)
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))
        large = with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = small.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        joined = with_least(small, least)
        stars = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        done, pairs = pairs, written(stars, "stars")
        discard(done)
        # settled: nothing that others hang on hangs on something itself
        if pairs.join(pairs.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
