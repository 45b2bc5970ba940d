"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counted from each text's bytes. Cyclic boosting visits one feature after the other and
fits a shallow tree to the gradients of its bins; all trees of a feature add up to one lookup table.
Then the pairs of features that explain most of what is left get two-way tables the same way. A score
is the sum of one table entry per feature and pair, taken for whole batches at once.

The model is fitted on the driver from the features of at most labelled.MAX_ROWS labelled rows (a few
doubles each); texts never leave the tasks. Null texts count as empty and get a score like any other;
null labels, labels other than 0 and 1 and labelled rows without a document are left out. A score depends
on the text alone, not on the rows beside it. With no labels of one kind every score
is the share of label 1 (0.5 without any labels). Repeated rows each get their score; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.labelled import MAX_ROWS, remainder, sample, sigmoid
from helioframe.llm.shared import in_arrow
from helioframe.llm.text_arrays import SPACE_SPLIT, slices, text_bytes, word_hashes, word_spans

SLICE_BYTES = 1 << 20
THRESHOLD = 0.7

FEATURES = ["log_bytes", "log_words", "word_length", "letters", "upper", "digits", "stops", "symbols", "other_ascii", "spaces", "repeated_next", "distinct_words", "distinct_pairs", "no_letter_words", "all_upper_words", "symbol_ended", "long_words", "words_per_line"]

_CLASS = {
    "letters": np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)]),
    "upper": np.isin(np.arange(256), range(65, 91)),
    "digits": np.isin(np.arange(256), range(48, 58)),
    "stops": np.isin(np.arange(256), list(b".,;:?'\"()")),
    "symbols": np.isin(np.arange(256), list(b"!#$%&*+/<=>@[\\]^_`{|}~")),
    "spaces": ~SPACE_SPLIT,
    "lines": np.isin(np.arange(256), [10]),
}
_CODE = np.zeros(256, dtype=np.int64)
for _k, _m in enumerate(("letters", "digits", "stops", "symbols", "spaces")):
    _CODE[_CLASS[_m]] = _k + 1


def text_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    starts, ends, first = word_spans(raw, offsets, SPACE_SPLIT)
    words = np.diff(first)
    per_byte = np.maximum(size, 1)
    per_word = np.maximum(words, 1)

    def by_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[at[1:]] - sums[at[:-1]]

    x = np.zeros((n, len(FEATURES)))
    col = {f: k for k, f in enumerate(FEATURES)}
    x[:, col["log_bytes"]] = np.log1p(size)
    x[:, col["log_words"]] = np.log1p(words)
    for k in ("letters", "upper", "digits", "stops", "symbols", "spaces"):
        x[:, col[k]] = by_doc(_CLASS[k][raw], offsets) / per_byte
    x[:, col["other_ascii"]] = by_doc(_CODE[raw] == 0, offsets) / per_byte
    x[:, col["words_per_line"]] = np.log1p(words / (by_doc(_CLASS["lines"][raw], offsets) + 1))
    if not len(starts):
        return x
    lengths = ends - starts
    doc = np.repeat(np.arange(n), words)
    x[:, col["word_length"]] = by_doc(lengths, first) / per_word
    x[:, col["long_words"]] = by_doc(lengths > 20, first) / per_word
    letters = np.concatenate(([0], np.cumsum(_CLASS["letters"][raw])))
    upper = np.concatenate(([0], np.cumsum(_CLASS["upper"][raw])))
    lettered = letters[ends] - letters[starts]
    x[:, col["no_letter_words"]] = by_doc(lettered == 0, first) / per_word
    x[:, col["all_upper_words"]] = by_doc((lettered > 1) & (upper[ends] - upper[starts] == lettered), first) / per_word
    x[:, col["symbol_ended"]] = by_doc(_CLASS["symbols"][raw[ends - 1]], first) / per_word
    h = word_hashes(raw, starts, ends)
    x[:, col["repeated_next"]] = by_doc(np.concatenate(((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]), [False])), first) / per_word
    # distinct words and distinct neighbouring pairs of one text, each against a power of the length
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    for name, keys, of in (("distinct_words", h, doc), ("distinct_pairs", h[pair] * np.uint64(3) + h[pair + 1], doc[pair])):
        if not len(keys):
            continue
        # 40 bits of the hash below the number of the text: counts for a feature need no more
        both = np.sort(of.astype(np.uint64) << np.uint64(40) | keys >> np.uint64(24))
        fresh = np.concatenate(([True], both[1:] != both[:-1]))
        x[:, col[name]] = np.bincount((both[fresh] >> np.uint64(40)).astype(np.int64), minlength=n) / per_word ** (0.8 if name == "distinct_words" else 1.0)
    return x


class AdditiveModel:
    """Lookup tables per feature and per pair of features, and the edges of their bins."""

    def __init__(self, bins: int = 48, coarse: int = 10, rounds: int = 80, pairs: int = 8, pair_rounds: int = 30, rate: float = 0.15, least: float = 5.0):
        self.bins, self.coarse, self.rounds, self.pairs, self.pair_rounds, self.rate, self.least = bins, coarse, rounds, pairs, pair_rounds, rate, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.wide = [np.unique(np.quantile(c, np.linspace(0, 1, self.coarse + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.chosen: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        at = [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)]
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for k, table in enumerate(self.tables):
                step = self._tree(at[k], *self._gradients(raw, y), len(table))
                table += step
                raw += step[at[k]]
        cells = [np.searchsorted(e, c, side="right") for e, c in zip(self.wide, x.T)]
        g, h = self._gradients(raw, y)
        gains = []
        for a, b in combinations(range(x.shape[1]), 2):
            cell = cells[a] * self.coarse + cells[b]
            gs, hs = np.bincount(cell, g, self.coarse**2), np.bincount(cell, h, self.coarse**2)
            gains.append(((gs**2 / (hs + self.least)).sum(), a, b))
        self.chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[: self.pairs]]
        self.pair_tables = [np.zeros((self.coarse, self.coarse)) for _ in self.chosen]
        for _ in range(self.pair_rounds):
            for (a, b), table in zip(self.chosen, self.pair_tables):
                step = self._pair_tree(cells[a], cells[b], *self._gradients(raw, y))
                table += step
                raw += step[cells[a], cells[b]]
        return self

    @staticmethod
    def _gradients(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(raw)
        return y - p, np.maximum(p * (1 - p), 1e-6)

    def _leaf(self, g: float, h: float) -> float:
        return self.rate * g / (h + 1.0)

    def _cut(self, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> int:
        """The best cut of a row of bins, or 0."""
        gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
        if not len(gl):
            return 0
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
        gain[(nl < self.least) | (n.sum() - nl < self.least)] = -1
        k = int(np.argmax(gain))
        return k + 1 if gain[k] > 1e-9 else 0

    def _tree(self, at: np.ndarray, g: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
        """A tree of depth two over the bins, as a table."""
        gs, hs, ns = np.bincount(at, g, size), np.bincount(at, h, size), np.bincount(at, minlength=size)
        cuts = [0, size]
        for _ in range(2):
            new = [a + self._cut(gs[a:b], hs[a:b], ns[a:b]) for a, b in zip(cuts, cuts[1:])]
            cuts = sorted({*cuts, *new})
        out = np.zeros(size)
        for a, b in zip(cuts, cuts[1:]):
            out[a:b] = self._leaf(gs[a:b].sum(), hs[a:b].sum())
        return out

    def _pair_tree(self, a: np.ndarray, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree that cuts one feature, then the other on either side."""
        k = self.coarse
        gs, hs, ns = (np.bincount(a * k + b, w, k * k).reshape(k, k) for w in (g, h, np.ones(len(g))))
        out = np.zeros((k, k))
        c = self._cut(gs.sum(1), hs.sum(1), ns.sum(1))
        for lo, hi in ((0, c), (c, k)) if c else ((0, k),):
            d = self._cut(gs[lo:hi].sum(0), hs[lo:hi].sum(0), ns[lo:hi].sum(0))
            for left, right in ((0, d), (d, k)) if d else ((0, k),):
                out[lo:hi, left:right] = self._leaf(gs[lo:hi, left:right].sum(), hs[lo:hi, left:right].sum())
        return out

    def _sum(self, at: list[np.ndarray], cells: list[np.ndarray]) -> np.ndarray:
        raw = self.base + sum(t[i] for t, i in zip(self.tables, at))
        for (a, b), table in zip(self.chosen, self.pair_tables):
            raw = raw + table[cells[a], cells[b]]
        return raw

    def score(self, x: np.ndarray) -> np.ndarray:
        at = [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)]
        cells = [np.searchsorted(e, c, side="right") for e, c in zip(self.wide, x.T)]
        return sigmoid(self._sum(at, cells))


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The features of each document, as an array of doubles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                x = text_features(*text_bytes(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "x"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return in_arrow(narrow, count, f"id {narrow.schema['id'].dataType.simpleString()}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Fit the model on at most max_rows labelled documents."""
    chosen = sample(labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("y")), id_col, max_rows)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    # the fit must not depend on the order in which rows arrive
    got = features(rows.withColumn("pair", F.struct(F.col(id_col).alias("k"), "y")), "pair", text_col).select("id.k", "id.y", "x").toPandas().sort_values("k", kind="stable")
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return AdditiveModel().fit(x, np.array(got["y"].tolist(), dtype=float))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                s = sent.value.score(text_features(*text_bytes(batch.column("text"))))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s, pa.float64())], ["id", "score"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return in_arrow(narrow, run, f"id {narrow.schema['id'].dataType.simpleString()}, score double").select(F.col("id").alias(id_col), "score")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score and predicted of every document; rows held out are never learnt from."""
    model = fit(docs, labels.where(remainder(id_col, 4) != 2), "quality", id_col, text_col)
    scored = score(docs, model, id_col, text_col)
    return scored.select(id_col, (remainder(id_col, 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose score reaches THRESHOLD, with all their columns; no row is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.where(remainder(id_col, 4) != 2), "quality", id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, SLICE_BYTES):
                yield batch.filter(pa.array(sent.value.score(text_features(*text_bytes(batch.column(text_col)))) >= THRESHOLD))

    return in_arrow(docs, run, docs.schema)
