"""Hard negatives of anchors, by a block matrix product of anchors and rows (SUMMA).

Rows and anchors are dealt to blocks, and their vectors to chunks of dimensions. Block (a, k) of the anchors goes to
all row blocks r and block (r, k) of the rows to all anchor blocks a, dealt by (a, r). There a task multiplies them
chunk by chunk as they stream by, adds the products to one tile of 64-bit scores, and reduces the finished tile at
once to the few rows of each anchor that can still matter. Tiles are never moved. Spark's windows then take the best
of all tiles.

Blocks hold rows of labels that hash alike, so that the first product, which finds the positives, only needs tiles
of like blocks; the second one looks for negatives within the windows that the positives set. A label with most of
the rows has more blocks, not larger ones. Nothing is gathered but one count per label hash (64 at most).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.llm.shared import in_arrow, written

#: Hashes of labels; blocks are made within each.
LABEL_HASHES = 64
#: Rows and anchors of a block, on average: a tile of scores takes 4 MB.
ROWS_PER_BLOCK, ANCHORS_PER_BLOCK = 2048, 256
#: Dimensions of a chunk.
CHUNK = 32


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long, x as double; beyond 64 bits it stays at the end of the range."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(rows: DataFrame, is_anchor: Column, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """id, label (as text), vector (longs) and anchor of the rows that take part, one per identifier.

    Rows with a null identifier, label or vector, or a component that is null, NaN or infinite take no part. Of rows
    that share an identifier, that with the smallest label and vector does.
    """
    finite = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    kept = F.struct(F.col(label_col).cast("string").alias("label"), quantised(F.col(vector_col)).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    return rows.select(F.col(id_col).cast("long").alias("id"), kept.alias("row")).groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*")


@dataclass
class Grid:
    """How many blocks of rows and of anchors each label hash has, and how many chunks a vector has."""

    rows: list[int]
    anchors: list[int]
    chunks: int

    @staticmethod
    def of(base: DataFrame) -> Grid:
        found = {r["g"]: r for r in base.groupBy(label_hash().alias("g")).agg(F.count("*").alias("n"), F.count_if("anchor").alias("a"), F.max(F.size("vector")).alias("d")).collect()}
        blocks = lambda key, size: [-(-found[g][key] // size) if g in found else 0 for g in range(LABEL_HASHES)]
        return Grid(blocks("n", ROWS_PER_BLOCK), blocks("a", ANCHORS_PER_BLOCK), max([1, *(-(-r["d"] // CHUNK) for r in found.values())]))


def label_hash() -> Column:
    return F.pmod(F.xxhash64("label"), F.lit(LABEL_HASHES)).cast("int")


def block_of(blocks: list[int]) -> Column:
    """The block of a row: those of a label hash are numbered in a run, and its rows dealt to them by their identifiers."""
    first = F.array(*[F.lit(sum(blocks[:g])) for g in range(len(blocks))])
    count = F.array(*[F.lit(max(1, b)) for b in blocks])
    return F.get(first, "g") + F.pmod(F.xxhash64(F.lit(5), "id"), F.get(count, "g")).cast("int")


def partners(blocks: list[int], alike: bool) -> Column:
    """The blocks of the other side that a block meets: those of its label hash, or all."""
    if not alike:
        return F.sequence(F.lit(0), F.lit(sum(blocks) - 1))
    first = F.array(*[F.lit(sum(blocks[:g])) for g in range(len(blocks))])
    count = F.array(*[F.lit(b) for b in blocks])
    return F.when(F.get(count, "g") > 0, F.sequence(F.get(first, "g"), F.get(first, "g") + F.get(count, "g") - 1))


def chunked(base: DataFrame, own: str, grid: Grid, blocks: list[int], more: list[str]) -> DataFrame:
    """A row per block and chunk: g, the block (named own), k, and the block's members in order of their identifiers.

    own_values strings the members' components together; own_ids, own_labels and the columns named in more are lists
    of the first chunk only. Short vectors are filled with zeros.
    """
    full = F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(grid.chunks * CHUNK) - F.size("vector")))
    rows = base.withColumn("g", label_hash()).withColumn(own, block_of(blocks)).withColumn("vector", full).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(grid.chunks - 1))))
    member = F.struct("id", F.slice("vector", F.col("k") * CHUNK + 1, F.lit(CHUNK)).alias("values"), *[F.when(F.col("k") == 0, F.col(c)).alias(c) for c in ("label", *more)])
    found = rows.groupBy("g", own, "k").agg(F.sort_array(F.collect_list(member)).alias("m"))
    return found.select(
        "g", own, "k", F.flatten("m.values").alias(f"{own}_values"), F.when(F.col("k") == 0, F.col("m.id")).alias(f"{own}_ids"), F.when(F.col("k") == 0, F.col("m.label")).alias(f"{own}_labels"),
        *[F.when(F.col("k") == 0, F.col(f"m.{c}")).alias(f"{own}_{c}") for c in more],
    )


def met(anchors: DataFrame, rows: DataFrame, grid: Grid, alike: bool) -> DataFrame:
    """The chunks of anchors and rows that meet: a, r, k, side (0: anchors, 1: rows), values, ids, labels, windows.

    Both are dealt by (a, r) and come in order of (a, r, k, side). Nothing is joined: Spark would take the compressed
    size of the tables for that of the blocks, and send a copy of them for each partner to the driver.
    """
    windows = next((f.dataType for f in anchors.schema if f.name == "a_windows"), None)
    given = F.lit(None).cast("string") if windows is None else F.lit(None).cast(windows)

    def side(blocks: DataFrame, own: str, other: str, theirs: list[int]) -> DataFrame:
        found = blocks.withColumn(other, F.explode(partners(theirs, alike)))
        more = F.col(f"{own}_windows") if f"{own}_windows" in blocks.columns else given
        return found.select("a", "r", "k", F.lit(int(own == "r")).alias("side"), *[F.col(f"{own}_{c}").alias(c) for c in ("values", "ids", "labels")], more.alias("windows"))

    both = side(anchors, "a", "r", grid.rows).unionByName(side(rows, "r", "a", grid.anchors))
    return both.repartition("a", "r").sortWithinPartitions("a", "r", "k", "side")


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left times right transposed, in 64-bit whole numbers; by way of doubles where they hold every sum exactly."""
    most = float(np.abs(left.astype(np.float64)).max(initial=0)) * float(np.abs(right.astype(np.float64)).max(initial=0)) * left.shape[1]
    if most < 2**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def added(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[dict, np.ndarray]]:
    """The tiles of chunks (so many dimensions wide) that come as met() deals them, each with the first chunks' columns.

    It holds one tile and one chunk of either side at a time.
    """
    at, first, total, left = None, {}, None, None
    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        for i in range(batch.num_rows):
            key = (columns["a"][i].as_py(), columns["r"][i].as_py())
            k, own = columns["k"][i].as_py(), "r" if columns["side"][i].as_py() else "a"
            if key != at:
                if total is not None:
                    yield first, total
                at, first, total, left = key, {}, None, None
            if k == 0:
                first |= {f"{own}_{c}": columns[c][i].as_py() for c in ("ids", "labels", "windows")}
            values = columns["values"][i].values.to_numpy(zero_copy_only=False).reshape(-1, width)
            if own == "a":
                left = (k, values)
            elif left is not None and left[0] == k:
                tile = product(left[1], values)
                total = tile if total is None else np.add(total, tile, out=total)
    if total is not None:
        yield first, total


def tops(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, most: int) -> np.ndarray:
    """Places of the largest scores among the allowed ones, ties by smaller identifier."""
    at = np.flatnonzero(allowed)
    if len(at) > most:
        at = at[scores[at] >= np.partition(scores[at], len(at) - most)[len(at) - most]]
    return at[np.lexsort((ids[at], ~scores[at]))[:most]]


def reduced(chunks: DataFrame, schema: str, rows_of) -> DataFrame:
    """Multiply and add the chunks that meet, and turn each whole tile into rows.

    rows_of(first, ids, same, scores, i) yields rows for anchor i of a tile: ids are those of the tile's rows, same
    says which of them have the anchor's label, and scores are the anchor's.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, scores in added(batches, CHUNK):
            ids, codes = np.array(first["r_ids"], dtype=np.int64), {x: n for n, x in enumerate(dict.fromkeys(first["r_labels"]))}
            labels = np.array([codes[x] for x in first["r_labels"]])
            found = [row for i, label in enumerate(first["a_labels"]) for row in rows_of(first, ids, labels == codes.get(label, -1), scores[i], i)]
            if found:
                columns = [c.split()[0] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([row[j] for row in found], pa.int64()) for j in range(len(columns))], columns)

    return in_arrow(chunks, task, schema)


def mine(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """For each anchor and each of its positives, the best rows of other labels within the positive's window.

    A score is the inner product of quantised vectors, of which a shorter one counts as filled with zeros; it must fit
    64 bits. An anchor's positives are its highest scored other rows of the same label, at most so many; negatives of
    a positive are the highest scored rows of other labels with low * positive <= 100 * negative <= high * positive.
    Ties go to the smaller identifier. Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score and
    negative_score; anchors without positives, and positives with an empty window, give no row. See usable for rows
    that take no part and repeated identifiers, which must be whole numbers; other columns are ignored, and an empty
    table, or one without anchors, gives an empty result. Every row is scored against every anchor.
    """
    spark, schema = rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    base = written(usable(rows, is_anchor, id_col, label_col, vector_col), "vectors")
    grid = Grid.of(base)
    if not sum(grid.anchors):
        return spark.createDataFrame([], schema)
    blocks = written(chunked(base, "r", grid, grid.rows, []), "row-blocks")
    anchors = base.where("anchor")

    def likest(first, ids, same, scores, i):
        own = first["a_ids"][i]
        for at in tops(scores, ids, same & (ids != own), positives):
            yield own, int(ids[at]), int(scores[at])

    chunks = met(chunked(anchors, "a", grid, grid.anchors, []), blocks, grid, True)
    found = reduced(chunks, "anchor_id long, positive_id long, positive_score long", likest)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = written(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives).drop("n"), "positives")

    def within(first, ids, same, scores, i):
        for positive in first["a_windows"][i]:
            least, most = -(-low * positive["positive_score"] // 100), high * positive["positive_score"] // 100
            for at in tops(scores, ids, ~same & (scores >= least) & (scores <= most), negatives):
                yield first["a_ids"][i], positive["positive_id"], int(ids[at]), positive["positive_score"], int(scores[at])

    windows = found.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("windows"))
    chunks = met(chunked(anchors.join(windows.hint("merge"), "id"), "a", grid, grid.anchors, ["windows"]), blocks, grid, False)
    found = reduced(chunks, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long", within)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
