"""Benchmark decontamination with an FM-index per shard of training text.

Each shard (SHARD_BYTES of documents in a task) is turned into word numbers over the alphabet of the
benchmark's words; other words cannot be part of a match and only end a run of text. The shard's suffix
order, its Burrows-Wheeler transform and a wavelet tree over it make the index. All benchmark phrases
are searched backwards at once through wavelet-tree ranks; occurrences are located by walking to sampled
suffix positions, and overlapping ones merge into removal spans.

A phrase is each window of WINDOW consecutive words of an item; an item of fewer words, but not none, is
one phrase. A benchmark of more than about MAX_PHRASES phrases is dealt to blocks by Spark, and each block
is sent to the tasks for a pass of its own over the documents, so the driver and a task hold one block
(or one larger item) at a time however large the benchmark is. What several passes find is brought together
by a key that each row gets once.

Null texts have no words. Documents without words are reported with zeros and not contaminated. Items that
repeat an identifier count once, a null identifier counts as ''; documents that repeat an identifier, or
have none, are each reported. An empty benchmark contaminates nothing, and an empty document table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.shared import in_arrow, written
from helioframe.llm.text_arrays import ALNUM_WORDS, slices, text_bytes, word_hashes, word_spans

WINDOW = 10
#: Phrases in one pass, at 40 bytes and a few more each.
MAX_PHRASES = 1_000_000
#: Bytes of text in one shard.
SHARD_BYTES = 2 << 20
#: One suffix position in so many is kept.
SAMPLE = 8


class Phrases:
    """The phrases of a block of items: word alphabet, symbols of each distinct phrase, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        raw, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        starts, ends, first = word_spans(raw, offsets, ALNUM_WORDS)
        self.alphabet, symbol = np.unique(word_hashes(raw, starts, ends), return_inverse=True)
        self.items = [i for i, _ in items]
        words = np.diff(first)
        count = np.where(words > window, words - window + 1, np.minimum(words, 1))
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - first[:-1], count)
        lengths = np.repeat(np.minimum(words, window), count)
        cells = np.minimum(at[:, None] + np.arange(window), max(len(symbol) - 1, 0))
        symbols = np.where(np.arange(window) < lengths[:, None], symbol[cells] + 1 if len(symbol) else 0, 0).astype(np.int32)
        self.symbols, use = np.unique(symbols, axis=0, return_inverse=True) if len(symbols) else (symbols, np.zeros(0, np.int64))
        self.lengths = (self.symbols > 0).sum(1)
        owners = np.unique(np.stack((use.ravel(), np.repeat(np.arange(len(items)), count)), axis=1), axis=0)
        #: the items of phrase p stand at owner_at[p] to owner_at[p + 1]
        self.owners, self.owner_at = owners[:, 1].astype(np.int32), np.searchsorted(owners[:, 0], np.arange(len(self.symbols) + 1))
        #: a bit for each low half of an alphabet hash: a quick no for most words
        self.maybe = np.zeros(1 << 18, dtype=bool)
        self.maybe[(self.alphabet & np.uint64(0x3FFFF)).astype(np.int64)] = True


class WaveletTree:
    """Ranks over an integer sequence, one bit level after the other (a wavelet matrix)."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for k in range(bits - 1, -1, -1):
            bit = (sequence >> k) & 1
            ones = np.concatenate(([0], np.cumsum(bit))).astype(np.int32)
            self.levels.append(ones)
            self.zeros.append(len(sequence) - int(ones[-1]))
            sequence = np.concatenate((sequence[bit == 0], sequence[bit == 1]))
        self.bits = bits

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low = np.zeros_like(at)
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            a, b = ones[at], ones[low]
            at = np.where(bit == 1, zeros + a, at - a)
            low = np.where(bit == 1, zeros + b, low - b)
        return at - low


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; zeros are separators that are all different."""
    n = len(text)
    key = text.copy()
    gaps = np.flatnonzero(text == 0)
    key += len(gaps)
    key[gaps] = np.arange(len(gaps))
    width = 1
    order = np.argsort(key, kind="stable")
    while True:
        ranked = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        width *= 2


class FmIndex:
    """An index over a text of symbols from 0 (separator, also the last) to most."""

    def __init__(self, text: np.ndarray, most: int, sample: int = SAMPLE):
        order = suffix_order(text)
        before = text[order - 1]
        self.before = before
        self.tree = WaveletTree(before, max(1, int(most).bit_length()))
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=most + 1))))
        # positions after a separator are kept too, so that no walk crosses one
        kept = (order % sample == 0) | (before == 0)
        self.kept, self.samples = kept, np.where(kept, order, -1)

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each phrase, by backward search."""
        last = symbols[np.arange(len(symbols)), lengths - 1]
        low, high = self.starts[last], self.starts[last + 1]
        for k in range(2, symbols.shape[1] + 1):
            on = np.flatnonzero((lengths >= k) & (low < high))
            c = symbols[on, lengths[on] - k]
            low[on] = self.starts[c] + self.tree.rank(c, low[on])
            high[on] = self.starts[c] + self.tree.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: step back until a kept one, then add the steps."""
        rows = rows.copy()
        steps = np.zeros(len(rows), dtype=np.int64)
        left = np.flatnonzero(~self.kept[rows])
        while len(left):
            c = self.before[rows[left]]
            rows[left] = self.starts[c] + self.tree.rank(c, rows[left])
            steps[left] += 1
            left = left[~self.kept[rows[left]]]
        return self.samples[rows] + steps


def search_shard(raw: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> tuple:
    """Words, hit words, spans and found items of the texts in a shard."""
    starts, ends, first = word_spans(raw, offsets, ALNUM_WORDS)
    n_docs, n_words = len(offsets) - 1, len(starts)
    covered = np.zeros(n_words + 1, dtype=np.int64)
    found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n_words and len(phrases.lengths):
        hashes = word_hashes(raw, starts, ends)
        symbol = np.zeros(n_words, dtype=np.int64)
        some = np.flatnonzero(phrases.maybe[(hashes & np.uint64(0x3FFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(phrases.alphabet, hashes[some]), len(phrases.alphabet) - 1)
        known = phrases.alphabet[at] == hashes[some]
        symbol[some[known]] = at[known] + 1
        # runs of known words within a document; shorter ones than any phrase hold no match
        known = symbol > 0
        fresh = np.zeros(n_words, dtype=bool)
        fresh[first[:-1][first[:-1] < n_words]] = True
        run_start = np.flatnonzero(known & (fresh | ~np.concatenate(([False], known[:-1]))))
        run_end = np.flatnonzero(known & (np.concatenate((fresh[1:], [True])) | ~np.concatenate((known[1:], [False])))) + 1
        long = run_end - run_start >= phrases.lengths.min()
        run_start, run_end = run_start[long], run_end[long]
        if len(run_start):
            sizes = run_end - run_start + 1
            heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            word = np.arange(int(sizes.sum())) - np.repeat(heads - run_start, sizes)
            gap = np.zeros(len(word), dtype=bool)
            gap[heads + sizes - 1] = True
            text = np.where(gap, 0, symbol[np.minimum(word, n_words - 1)])
            index = FmIndex(text, len(phrases.alphabet))
            low, high = index.search(phrases.symbols, phrases.lengths)
            hits = np.flatnonzero(high > low)
            if len(hits):
                times = high[hits] - low[hits]
                phrase = np.repeat(hits, times)
                rows = np.repeat(low[hits], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                where = word[index.locate(rows)]
                np.add.at(covered, where, 1)
                np.add.at(covered, where + phrases.lengths[phrase], -1)
                doc = np.searchsorted(first, where, side="right") - 1
                pairs = np.unique(np.stack((doc, phrase), axis=1), axis=0)
                a, b = phrases.owner_at[pairs[:, 1]], phrases.owner_at[pairs[:, 1] + 1]
                sizes = b - a
                owner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - a, sizes)
                found = np.repeat(pairs[:, 0], sizes), phrases.owners[owner]
    hit = np.cumsum(covered[:-1]) > 0
    return starts, ends, first, hit, found


#: Spans hold their first and last word's numbers, and where they start and end in UTF-8 bytes.
SPANS = "array<struct<first:int,last:int,start:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([(f, pa.int32()) for f in ("first", "last", "start", "end")]))


def searched(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """Per row of docs (id, row, text): id, row, n_words, n_hit, the items found and the merged spans."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        for whole in batches:
            for batch in slices(whole, "text", SHARD_BYTES):
                raw, offsets = text_bytes(batch.column("text"))
                starts, ends, first, hit, (doc, item) = search_shard(raw, offsets, phrases)
                n = batch.num_rows
                sums = np.concatenate(([0], np.cumsum(hit)))
                items: list[set[int]] = [set() for _ in range(n)]
                for d, i in zip(doc.tolist(), item.tolist()):
                    items[d].add(i)
                edge = np.zeros(len(hit) + 1, dtype=bool)
                edge[first] = True
                opens = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate(([False], hit[:-1]))))
                closes = np.flatnonzero(hit & (edge[1:] | ~np.concatenate((hit[1:], [False]))))
                owner = np.searchsorted(first, opens, side="right") - 1
                fields = (opens - first[owner], closes - first[owner], starts[opens] - offsets[owner], ends[closes] - offsets[owner])
                spans = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in fields], ["first", "last", "start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), batch.column("row"), pa.array(np.diff(first), pa.int64()), pa.array(sums[first[1:]] - sums[first[:-1]], pa.int64()),
                        pa.array([sorted({phrases.items[i] for i in x}) for x in items], pa.list_(pa.string())),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), spans),
                    ],
                    ["id", "row", "n_words", "n_hit", "items", "spans"],
                )

    return in_arrow(docs.select("id", "row", "text"), search, f"id {docs.schema['id'].dataType.simpleString()}, row long, n_words long, n_hit long, items array<string>, spans {SPANS}")


def blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int = MAX_PHRASES) -> tuple[int, Iterator[Phrases]]:
    """How many blocks of about so many phrases the items make, and the phrases of one block after the other."""
    need = F.coalesce(F.length(text_col), F.lit(0)) / 2 + 1  # phrases are at least two bytes apart
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    count = max(1, math.ceil((benchmark.agg(F.sum(need)).first()[0] or 0) / most))
    if count > 1:
        items = written(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count))), "items")

    def each() -> Iterator[Phrases]:
        for k in range(count):
            part = items.where(F.col("block") == k).drop("block") if count > 1 else items
            yield Phrases([tuple(r) for r in part.collect()])

    return count, each()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_phrases: int = MAX_PHRASES) -> DataFrame:
    """Per document: id_col, n_words, n_hit, n_items, items_sha256, contaminated and spans."""
    narrow = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    count, parts = blocks(benchmark, item_col, item_text_col, max_phrases)
    if count == 1:
        found = searched(narrow, next(parts))
    else:
        narrow = written(narrow, "keyed")
        every = [written(searched(narrow, p), "found") for p in parts]
        hits = [x.where("n_hit > 0").select("row", "items", "spans") for x in every]
        found = every[0].select("id", "row", "n_words").join(merged_spans(reduce(DataFrame.unionByName, hits)), "row", "left")
        found = found.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumns({c: F.coalesce(c, F.array().cast(found.schema[c].dataType)) for c in ("items", "spans")})
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_phrases: int = MAX_PHRASES) -> DataFrame:
    """The documents without any phrase, with all their columns; no row is shuffled."""

    def clean(part: DataFrame, phrases: Phrases) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, text_col, SHARD_BYTES):
                    _, _, first, hit, _ = search_shard(*text_bytes(batch.column(text_col)), sent.value)
                    sums = np.concatenate(([0], np.cumsum(hit)))
                    yield batch.filter(pa.array(sums[first[1:]] == sums[first[:-1]]))

        return in_arrow(part, run, part.schema)

    count, parts = blocks(benchmark, item_col, item_text_col, max_phrases)
    for k, phrases in enumerate(parts):
        docs = clean(docs, phrases)
        if k < count - 1:
            docs = written(docs, "clean")
    return docs


def merged_spans(hits: DataFrame) -> DataFrame:
    """row, n_hit, items and spans of the rows that several passes found: their spans joined where words touch."""
    rows = hits.groupBy("row").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, spans = [], []
            for listed in batch.column("spans").to_pylist():
                out: list[dict] = []
                for x in sorted(listed, key=lambda x: (x["first"], x["last"])):
                    if out and x["first"] <= out[-1]["last"] + 1:
                        if x["last"] > out[-1]["last"]:
                            out[-1] |= {"last": x["last"], "end": x["end"]}
                    else:
                        out.append(dict(x))
                spans.append(out)
                n_hit.append(sum(x["last"] - x["first"] + 1 for x in out))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_hit, pa.int64()), batch.column("items"), pa.array(spans, SPAN_TYPE)], ["row", "n_hit", "items", "spans"])

    return in_arrow(rows, merge, f"row long, n_hit long, items array<string>, spans {SPANS}")


def remove_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans of found cut out of the text (identifiers must be unique)."""
    rows = docs.select(F.col(id_col).alias("id"), F.struct(*docs.columns).alias("row"))
    cut = rows.join(found.select(F.col(id_col).alias("id"), F.col("spans")), "id")
    old = F.col("row")[text_col]
    raw = F.encode(F.coalesce(old, F.lit("")), "UTF-8")
    keep = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.lit(b"").alias("out")),
        lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["out"], F.substring(raw, s["at"] + 1, x["start"] - s["at"])).alias("out")),
        lambda s: F.concat(s["out"], F.substring(raw, s["at"] + 1, F.octet_length(raw))),
    )
    text = F.when(F.size("spans") > 0, F.decode(keep, "UTF-8")).otherwise(old)
    return cut.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
