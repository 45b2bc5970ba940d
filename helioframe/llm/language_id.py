"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as one stream of bytes, words and spaces alike. The network runs over it in both
directions, labels every byte with language probabilities, and a document's probabilities are the mean over
all its bytes. A stream is worked on in chunks of CHUNK bytes side by side: the state of either direction is
carried into a chunk from RUN_IN bytes beyond its edge (or from the edge of the text, if that is nearer), so
a byte's label depends on at least RUN_IN bytes on either side of it, and on no other text.

Training is backpropagation through time in numpy, on the driver, over all bytes of at most MAX_ROWS
documents, as many of each language as there are of the rarest up to an equal share; the loss weighs languages
alike. Scoring reads whole texts.

A null text, or one without a letter, is `und` with score 0. Rows with a null language or text, or an empty
text, are not learnt from, and rows that repeat identifier, text and language are learnt from once; without
any usable row every text is `und`. Repeated rows are each reported, ties between languages go to the
first in alphabetical order, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helioframe.llm.labelled import remainder
from helioframe.llm.shared import in_arrow
from helioframe.llm.text_arrays import slices, text_bytes

CHUNK = 256
RUN_IN = 32
#: Chunks worked on side by side.
ROWS = 2048
HIDDEN = 8
MAX_ROWS = 1_200
#: Bytes of a training sequence, sequences in a step, and the fewest steps.
SEQUENCE = 48
BATCH = 256
STEPS = 300
SLICE_BYTES = 1 << 20
UNKNOWN = "und"
#: The symbol beside a text's edge: it leaves the state as it is.
EDGE = 256
_ASCII_LETTERS = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


def chunks(raw: np.ndarray, offsets: np.ndarray, size: int = CHUNK, run_in: int = RUN_IN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's chunks: document, first byte and length."""
    count = -(-np.diff(offsets) // size)
    doc = np.repeat(np.arange(len(count)), count)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * size + offsets[doc]
    return doc, start, np.minimum(size, offsets[doc + 1] - start)


def symbols(raw: np.ndarray, offsets: np.ndarray, doc: np.ndarray, start: np.ndarray, before: int, after: int) -> np.ndarray:
    """The bytes from before each start to after it, a column each; EDGE outside of the text."""
    at = start + np.arange(-before, after)[:, None]
    inside = (at >= offsets[doc]) & (at < offsets[doc + 1])
    return np.where(inside, raw[np.clip(at, 0, len(raw) - 1)].astype(np.int64), EDGE)


class Network:
    """Two gated recurrent layers side by side, one per direction, and a softmax at each position."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs, h = langs, hidden
        self.w: dict[str, np.ndarray] = {"out": rng.normal(0, 0.3, (2 * h, max(1, len(langs)))), "bias": np.zeros(max(1, len(langs)))}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.4, (EDGE + 1, 3 * h))
            self.w["u" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.h = h

    def _states(self, cells: np.ndarray, d: str) -> np.ndarray:
        """States of one direction after each position (a row of cells), from a state of zeros."""
        h = self.h
        x, u = self.w["x" + d].copy(), self.w["u" + d].copy()
        x[EDGE] = 0
        x[EDGE, :h] = -60  # the gate of the new state is shut
        for m in (x, u):
            m[:, : 2 * h] *= 0.5  # sigmoid(v) = tanh(v / 2) / 2 + 1 / 2
        steps, n = cells.shape
        out = np.empty((steps, n, h), x.dtype)
        gates, rec, zr, c = np.empty((n, 3 * h), x.dtype), np.empty((n, 3 * h), x.dtype), np.empty((n, 2 * h), x.dtype), np.empty((n, h), x.dtype)
        state = np.zeros((n, h), x.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(x, cells[t], axis=0, out=gates, mode="clip")
            np.matmul(state, u, out=rec)
            np.add(gates[:, : 2 * h], rec[:, : 2 * h], out=zr)
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(zr[:, h:], rec[:, 2 * h :], out=c)
            c += gates[:, 2 * h :]
            np.tanh(c, out=c)
            c -= state
            c *= zr[:, :h]
            np.add(state, c, out=out[t])
            state = out[t]
        return out

    def _softmax(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        logits = f @ self.w["out"][: self.h]
        logits += b @ self.w["out"][self.h :]
        logits += self.w["bias"]
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def pooled(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's mean over its bytes of the language probabilities at each."""
        doc, start, length = chunks(raw, offsets)
        sums = np.zeros((len(offsets) - 1, len(self.langs)))
        by_length = np.argsort(length, kind="stable")  # little padding side by side
        for a in range(0, len(doc), ROWS):
            part = by_length[a : a + ROWS]
            longest = int(length[part].max())
            cells = symbols(raw, offsets, doc[part], start[part], RUN_IN, longest + RUN_IN)
            f = self._states(cells[: RUN_IN + longest], "f")[RUN_IN:]
            b = self._states(cells[RUN_IN:], "b")[:longest]
            each = self._softmax(f, b)
            each *= (np.arange(longest)[:, None] < length[part])[:, :, None]
            np.add.at(sums, doc[part], each.sum(0))
        return sums / np.maximum(np.diff(offsets), 1)[:, None]

    def gradients(self, cells: np.ndarray, on: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the weighted mean cross entropy over the positions that are on."""
        h, w = self.h, self.w
        states, kept = {}, {}
        steps, n = cells.shape
        for d in "fb":
            x, u = w["x" + d], w["u" + d]
            state, states[d], kept[d] = np.zeros((n, h), x.dtype), np.empty((steps, n, h), x.dtype), []
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                gates, rec = x[cells[t]], state @ u
                zr = 0.5 * np.tanh(0.5 * (gates[:, : 2 * h] + rec[:, : 2 * h])) + 0.5
                z, r = zr[:, :h] * on[t][:, None], zr[:, h:]
                c = np.tanh(gates[:, 2 * h :] + r * rec[:, 2 * h :])
                kept[d].append((t, state, z, r, c, rec[:, 2 * h :]))
                state = state + z * (c - state)
                states[d][t] = state
        delta = self._softmax(states["f"], states["b"])
        delta[:, np.arange(n), label] -= 1
        delta *= (on * weight)[:, :, None] / (on * weight).sum()
        both = np.concatenate((states["f"], states["b"]), axis=2)
        g = {"out": np.tensordot(both, delta, ((0, 1), (0, 1))), "bias": delta.sum((0, 1))}
        back = delta @ w["out"].T
        for d, part in (("f", back[:, :, :h]), ("b", back[:, :, h:])):
            u, gu, ds = w["u" + d], np.zeros_like(w["u" + d]), np.zeros((n, h), back.dtype)
            all_gates = np.empty((steps, n, 3 * h), back.dtype)
            for t, state, z, r, c, rc in reversed(kept[d]):
                ds = ds + part[t]
                dz, dc = ds * (c - state) * z * (1 - z), ds * z * (1 - c * c)
                dr = dc * rc * r * (1 - r)
                all_gates[t] = np.concatenate((dz, dr, dc), axis=1)
                rec = np.concatenate((dz, dr, dc * r), axis=1)
                gu += state.T @ rec
                ds = ds * (1 - z) + rec @ u.T
            at, flat = cells.ravel(), all_gates.reshape(-1, 3 * h)
            g["x" + d], g["u" + d] = np.stack([np.bincount(at, v, EDGE + 1) for v in flat.T], axis=1), gu
        return g

    def fit(self, raw: np.ndarray, offsets: np.ndarray, label: np.ndarray, seed: int = 3) -> Network:
        """Train on all sequences of the texts, in a random order, again and again until STEPS steps are done."""
        rng = np.random.default_rng(seed)
        doc, start, length = chunks(raw, offsets, SEQUENCE)
        count = np.bincount(label[doc], length, len(self.langs))
        weight = (count.sum() / np.maximum(count, 1) / max(1, (count > 0).sum()))[label[doc]].astype(np.float32)
        rounds = max(1, -(-STEPS * BATCH // len(doc)))
        steps = rounds * -(-len(doc) // BATCH)
        one = {k: np.zeros_like(v) for k, v in self.w.items()}
        two = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(rounds):
            order = rng.permutation(len(doc))
            for a in range(0, len(doc), BATCH):
                pick, step = order[a : a + BATCH], step + 1
                cells = symbols(raw, offsets, doc[pick], start[pick], 0, int(length[pick].max()))
                on = (np.arange(len(cells))[:, None] < length[pick]).astype(np.float32)
                rate = 0.03 * (1 - step / (steps + 1))
                for k, g in self.gradients(cells, on, label[doc[pick]], weight[pick]).items():
                    one[k] = 0.9 * one[k] + 0.1 * g
                    two[k] = 0.99 * two[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only texts without an ASCII one are decoded."""
    ascii_sums = np.concatenate(([0], np.cumsum(_ASCII_LETTERS[raw])))
    found = ascii_sums[offsets[1:]] > ascii_sums[offsets[:-1]]
    for k in np.flatnonzero(~found):
        found[k] = any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return found


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Network:
    """Train on at most max_rows documents with a language and a text, the same number of each language at most."""
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.col(lang_col))
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(key.alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = known.groupBy("lang").agg(F.count("*").alias("all"))
    langs = counts.count()
    if not langs:
        return Network([])
    most = max(1, max_rows // langs)
    # about twice as many by their hashes, wherever they are, and of those the ones with the smallest keys
    some = known.select("key", "lang").join(counts, "lang").where(F.pmod("key", F.lit(1 << 31)).cast("double") * F.col("all") < float(2 * most) * (1 << 31))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = some.select("key", "lang").distinct().withColumn("place", place).where(F.col("place") <= most).select("key")
    rows = known.join(F.broadcast(chosen), "key").dropDuplicates(["key"]).toPandas().sort_values("key", kind="stable")
    net = Network(sorted(set(rows["lang"])))
    raw, offsets = text_bytes(pa.array(rows["text"].tolist(), pa.string()))
    place_of = {x: k for k, x in enumerate(net.langs)}
    return net.fit(raw, offsets, np.array([place_of[x] for x in rows["lang"]]))


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                raw, offsets = text_bytes(batch.column("text"))
                n = batch.num_rows
                pred, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
                lettered = has_letter(raw, offsets)
                if net.langs and lettered.any():
                    means = net.pooled(raw, offsets)
                    best = means.argmax(1)
                    pred[lettered] = np.array(net.langs, dtype=object)[best[lettered]]
                    score[lettered] = np.clip(means[np.arange(n), best], 0, 1)[lettered]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return in_arrow(narrow, run, f"id {narrow.schema['id'].dataType.simpleString()}, lang_pred string, score double").select(F.col("id").alias(id_col), "lang_pred", "score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, held_out, lang_pred and score; rows held out are never learnt from."""
    net = fit(docs.where(remainder(id_col, 4) != 2), lang_col, id_col, text_col)
    return predict(docs, net, id_col, text_col).select(id_col, (remainder(id_col, 4) == 2).alias("held_out"), "lang_pred", "score")
