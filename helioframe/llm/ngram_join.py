"""Near-duplicate join on word shingles: Jaccard similarity of at least 0.75, found through count vectors.

Texts with the same shingle set are one entity. Shingles are hashed into GROUPS groups; an entity is the
point of its group counts. Two sets share at most the sum of the coordinate minima of their points, which
is what prunes pairs: an R-tree of points (boxes hold coordinate maxima and the range of set sizes) is
walked against itself, subtrees whose bound is too low for any pair in them are left out, and surviving
pairs are verified on the whole sets.

The points are dealt to shards by shingle: in a global order of all shingles, two sets that are similar
enough share some of the first quarter of their shingles, so each entity joins the shards of those. The
order is that of a hash, but shingles which more than HEAVY documents would so be dealt to (counted
exactly) come last; the order only decides how large shards get, never what is found. Sets of sizes n and m
must share a known number of their first shingles, so a pair that the trees bring up in fewer shards than
that is dropped unseen. Large groups of near copies would be brought up again and again: each entity is
first verified against the one that leads most of its shards, or stands before it in most, then against the
one of its large shards that is in most of them, and shards whose members are all linked by then are not walked. Of the pairs from the trees, the one that shares most
shards with an entity is verified first, and then those whose ends are not linked yet. A shard of more
than BLOCK entities is cut into blocks, and each pair of blocks is a task's work of its own, so that no
group is gathered whole. Near copies that are too far apart to be linked meet in many shards, and there are as
many pairs of them as the square of their number: in a shard of more than LEAF entities, each row carries the
first few of its entity's large shards, so that a pair is only looked at where its ends first meet, and finer
points, which leave out most pairs before they are a row.

Results are connected components, not pairs; no link between different texts is lost. Shingles are
compared as 64-bit hashes, whole sets as 128-bit ones. Null and empty texts, and texts without words, have
an empty set and are linked with nothing. Rows are documents: repeated identifiers and repeated rows are
each reported; a null identifier is never the smallest of a component that has another one. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.llm.shared import Members, components, discard, in_arrow, likely_in, members, without, written
from helioframe.llm.text_arrays import SPACE_SPLIT, mix, shingle_sets, slices, text_bytes, word_hashes, word_spans

WIDTH = 5
#: The least similarity, as a fraction: 100 * shared >= 75 * union.
PERCENT = 75
GROUPS = 64
#: A shingle that is among the first quarter of more documents' than this goes to the end of the order.
HEAVY = 256
BLOCK = 2048
LEAF = 16
SLICE_BYTES = 1 << 20
#: Large shards that a row knows of its entity, and the logarithm of the most groups of a finer point that it carries.
FIRST = 8
CARRIED_BITS = 10
#: Keys beyond which the filter of a plan's constants lets too much through, and a table is sent as well.
FILTER_KEYS = 1 << 19


def sets_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = text_bytes(batch.column("text"))
    starts, ends, first = word_spans(raw, offsets, SPACE_SPLIT)
    return shingle_sets(word_hashes(raw, starts, ends), first, WIDTH)


def signatures(h: np.ndarray, at: np.ndarray, key: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each set (0 for the empty one)."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(key)), dtype=np.uint64)))
    size = np.diff(at).astype(np.uint64)
    return np.where(size == 0, np.uint64(0), mix((sums[at[1:]] - sums[at[:-1]]) ^ (size * np.uint64(0xD6E8FEB86659FD93))) | np.uint64(1))


def first_quarter(n):
    """Of how many shingles a set of size n joins the shards."""
    return n - (PERCENT * n + 99) // 100 + np.minimum(n, 1)


def least_in_common(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many of their first shingles two sets of these sizes share at least, if they are similar enough.

    They share s or more in all; of those, the set whose first quarter ends earlier in the order has all but
    the ones beyond it.
    """
    s = -(-PERCENT * (n + m) // (100 + PERCENT))
    return np.maximum(1, np.minimum(s - n + first_quarter(n), s - m + first_quarter(m)))


def leading(h: np.ndarray, at: np.ndarray, heavy: Members | None) -> list[np.ndarray]:
    """The first quarter of each set's shingles."""
    order = mix(h) >> np.uint64(1)
    if heavy is not None:
        order |= heavy.has(h).astype(np.uint64) << np.uint64(63)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        p = int(first_quarter(b - a))
        out.append(h[a:b] if p >= b - a else h[a:b][np.argpartition(order[a:b], p - 1)[:p]])
    return out


def profile(docs: DataFrame) -> DataFrame:
    """id, key, n (set size), the set's two signatures, its points and its first shingles in the order of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                h, at = sets_of(batch)
                tokens = leading(h, at, None)
                heads = np.concatenate(([0], np.cumsum([len(x) for x in tokens])))
                flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), batch.column("key"), pa.array(np.diff(at), pa.int32()), pa.array(signatures(h, at).view(np.int64)),
                        pa.array(signatures(h, at, 0xA0761D6478BD642F).view(np.int64)), pa.array([p.tobytes() for p in group_points(h, at)], pa.binary()), pa.array(fine_points(h, at), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(heads, pa.int32()), pa.array(flat.view(np.int64))),
                    ],
                    ["id", "key", "n", "sig", "check", "point", "fine", "tokens"],
                )

    return in_arrow(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, key long, n int, sig long, check long, point binary, fine binary, tokens array<long>")


def dealt(docs: DataFrame, heavy: Members) -> DataFrame:
    """token, sig and n: the shingles under which each set joins a shard."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                h, at = sets_of(batch)
                n, sig = np.diff(at), signatures(h, at)
                one = np.unique(sig, return_index=True)[1]
                one = one[n[one] > 0]
                heads = np.concatenate(([0], np.cumsum(n[one])))
                kept = h[np.arange(heads[-1]) - np.repeat(heads[:-1] - at[one], n[one])]
                tokens = leading(kept, heads, sent.value)
                times = [len(x) for x in tokens]
                flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(sig[one], times).view(np.int64)), pa.array(np.repeat(n[one], times), pa.int32())], ["token", "sig", "n"])

    return in_arrow(docs.select("text"), run, "token long, sig long, n int")


def shards(prefix: DataFrame, parts: int) -> DataFrame:
    """The rows of tokens that several entities have: token, sig, n, the shard's first entity and the one before.

    Rows arrive sorted, so only the last row is carried from batch to batch, whatever a shard's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = sig = np.zeros(0, np.int64)
        n = np.zeros(0, np.int32)
        lead = lead_n = None

        def cut(token, sig, n, first, first_n, last):
            """Rows of shards with several entities. The last row waits for the next batch."""
            same = token[1:] == token[:-1]
            multi = np.zeros(len(token), dtype=bool)
            multi[1:] |= same
            multi[:-1] |= same
            heads = np.concatenate(([True], ~same))
            head = np.maximum.accumulate(np.where(heads, np.arange(len(token)), 0))
            lead, lead_n = sig[head], n[head]
            if first is not None:
                lead, lead_n = np.where(head == 0, first, lead), np.where(head == 0, first_n, lead_n)
                multi |= head == 0
            stop = len(token) if last else len(token) - 1
            # the row before in the shard; its first entity where there is none or it was passed on
            at = np.where(heads, np.arange(len(token)), np.arange(len(token)) - 1)
            prev, prev_n = np.where(heads, lead, sig[at]), np.where(heads, lead_n, n[at])
            columns = {"token": token, "sig": sig, "n": n.astype(np.int32), "lead": lead, "lead_n": lead_n.astype(np.int32), "prev": prev, "prev_n": prev_n.astype(np.int32)}
            row = pa.RecordBatch.from_arrays([pa.array(x[:stop][multi[:stop]]) for x in columns.values()], list(columns))
            # a token that goes on keeps its first entity, if one row or more of it has been passed on
            ongoing = head[-1] < len(token) - 1 or (first is not None and head[-1] == 0)
            return row, (lead[-1], lead_n[-1]) if ongoing else (None, None)

        for batch in batches:
            t, s, m = (batch.column(c).to_numpy() for c in ("token", "sig", "n"))
            if not len(t):
                continue
            token, sig, n = np.concatenate((token, t)), np.concatenate((sig, s)), np.concatenate((n, m))
            fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])))
            token, sig, n = token[fresh], sig[fresh], n[fresh]
            row, (lead, lead_n) = cut(token, sig, n, lead, lead_n, False)
            yield row
            token, sig, n = token[-1:], sig[-1:], n[-1:]
        if len(token):
            yield cut(token, sig, n, lead, lead_n, True)[0]

    return in_arrow(prefix.repartition(parts, "token").sortWithinPartitions("token", "sig"), run, "token long, sig long, n int, lead long, lead_n int, prev long, prev_n int")


def group_points(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The point of each set in bytes: a scale, then its shingles per group in units of it, rounded up."""
    n = len(at) - 1
    cell = np.repeat(np.arange(n), np.diff(at)) * GROUPS + (mix(h) & np.uint64(GROUPS - 1)).astype(np.int64)
    counts = np.bincount(cell, minlength=n * GROUPS).reshape(n, GROUPS)
    scale = np.maximum(1, -(-counts.max(1, initial=0) // 255))
    return np.concatenate((scale.astype(np.uint32)[:, None].view(np.uint8), (-(-counts // scale[:, None])).astype(np.uint8)), axis=1)


def coordinates(points: pa.Array) -> np.ndarray:
    """Upper bounds of the group counts, from the bytes of points."""
    raw = np.frombuffer(b"".join(points.to_pylist()), dtype=np.uint8).reshape(len(points), GROUPS + 4)
    scale = np.ascontiguousarray(raw[:, :4]).view(np.uint32).astype(np.int32)
    return raw[:, 4:] * scale


def fine_points(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A finer point of each set: as many groups as it has shingles or more (a power of two), counts of two bits.

    The first byte is the logarithm of the number of groups, the next eight the shingles that the counts leave out.
    """
    out, group = [], mix(h ^ np.uint64(0x94D049BB133111EB))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        bits = max(6, (b - a).bit_length())
        counts = np.bincount((group[a:b] & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        low = np.minimum(counts, 3).astype(np.uint8).reshape(-1, 4)
        out.append(bytes([bits]) + int(b - a - low.sum()).to_bytes(8, "little") + (low << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes())
    return out


def fine_bounds(left: pa.Array, right: pa.Array) -> np.ndarray:
    """How many shingles the sets of two columns of finer points share at most; the larger one folds to fewer groups."""
    x, y = left.to_pylist(), right.to_pylist()
    out = np.zeros(len(x), dtype=np.int64)
    kinds = np.array([(p[0], q[0]) for p, q in zip(x, y)], dtype=np.int64).reshape(-1, 2)
    for b, c in np.unique(kinds, axis=0).tolist():
        rows = np.flatnonzero((kinds == (b, c)).all(1))
        step = max(1, (1 << 22) >> max(b, c))
        for k in range(0, len(rows), step):
            at = rows[k : k + step]
            (p, e), (q, f) = fine_counts([x[i] for i in at], b, min(b, c)), fine_counts([y[i] for i in at], c, min(b, c))
            out[at] = np.minimum(p, q).sum(1, dtype=np.int64) + e + f
    return out


def fine_counts(points: list[bytes], bits: int, fewest: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of finer points of so many bits, folded to fewer groups, and the shingles that they leave out."""
    raw = np.frombuffer(b"".join(points), dtype=np.uint8).reshape(len(points), -1)
    cells = (raw[:, 9:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(len(points), 1 << bits)
    folded = cells.reshape(len(points), -1, 1 << fewest).sum(1, dtype=np.int32) if bits > fewest else cells
    return folded, np.ascontiguousarray(raw[:, 1:9]).view(np.int64)[:, 0]


def fine_limits(points: list[bytes | None], x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many shingles the sets at x and y share at most; most where one of them carries no finer point."""
    out = most.copy()
    kinds = np.array([p[0] if p is not None else 0 for p in points], dtype=np.int64)
    code = kinds[x] << 8 | kinds[y]
    for k in np.flatnonzero(np.bincount(code)).tolist():
        b, c = k >> 8, k & 255
        if not b or not c:
            continue
        rows, place, sides = np.flatnonzero(code == k), np.zeros(len(points), dtype=np.int64), {}
        for bits in {b, c}:
            own = np.flatnonzero(kinds == bits)
            place[own] = np.arange(len(own))
            sides[bits] = fine_counts([points[i] for i in own], bits, min(b, c))
        (p, e), (q, f) = sides[b], sides[c]
        step = max(1, (1 << 22) >> min(b, c))
        for s in range(0, len(rows), step):
            at = rows[s : s + step]
            i, j = place[x[at]], place[y[at]]
            out[at] = np.minimum(p[i], q[j]).sum(1, dtype=np.int64) + e[i] + f[j]
    return out


def met_before(token: int, firsts: list[list[int] | None], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the members at x and y of a shard are known to meet in an earlier one (of the commonest 64)."""
    sizes = [len(f) if f is not None else 0 for f in firsts]
    known = np.array([t for f in firsts if f is not None for t in f], dtype=np.int64)
    member = np.repeat(np.arange(len(firsts)), sizes)
    member, known = member[known < token], known[known < token]
    distinct, which, times = np.unique(known, return_inverse=True, return_counts=True)
    bit = np.full(len(distinct), -1)
    common = np.argsort(-times, kind="stable")[:64]
    bit[common] = np.arange(len(common))
    mask = np.zeros(len(firsts), dtype=np.uint64)
    has = bit[which] >= 0
    np.bitwise_or.at(mask, member[has], np.uint64(1) << bit[which[has]].astype(np.uint64))
    return (mask[x] & mask[y]) != 0


def enough(shared, a, b):
    """Whether so many shared shingles make sets of sizes a and b similar enough."""
    return 100 * shared >= PERCENT * (a + b - shared)


def whole_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, sig and the sorted shingles (as bytes) of the documents of nodes (key), and perhaps of a few more."""
    nodes = written(nodes.distinct(), "wanted")
    table = docs.sparkSession.sparkContext.broadcast(members(nodes, "key") if nodes.count() > FILTER_KEYS else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            if table.value is not None:
                big = big.filter(pa.array(table.value.has(big.column("key").to_numpy().view(np.uint64))))
            for batch in slices(big, "text", SLICE_BYTES):
                h, at = sets_of(batch)
                sig = signatures(h, at).view(np.int64)
                data = [h[a:b].tobytes() for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sig), pa.array(data, pa.binary())], ["key", "sig", "data"])

    found = in_arrow(docs.where(likely_in(nodes, "key")).select("key", "text"), run, "key long, sig long, data binary")
    return written(found.join(nodes, "key", "left_semi").groupBy("key", "sig").agg(F.first("data").alias("data")), "sets")


def linked(docs: DataFrame, entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links (a, b as nodes) among pairs of entities (a, b as sig): held against their finer points, then on whole sets."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            yield batch.select(["a", "sa", "b", "sb"]).filter(pa.array(enough(fine_bounds(batch.column("pa"), batch.column("pb")), n, m)))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                keep.append(bool(enough(int((q[at] == p).sum()), len(p), len(q))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda x: entities.select(F.col("sig").alias("s" + x), F.col("node").alias(x), F.col("n").alias("n" + x), F.col("fine").alias("p" + x))
    node = entities.schema["node"].dataType.simpleString()
    placed = pairs.select(F.col("a").alias("sa"), F.col("b").alias("sb")).join(of("a"), "sa").join(of("b"), "sb")
    near = written(in_arrow(placed.select("a", "sa", "b", "sb", "na", "nb", "pa", "pb"), bounded, f"a {node}, sa long, b {node}, sb long"), "near")
    sets = whole_sets(docs, near.select("a.key").unionByName(near.select("b.key")))
    side = lambda x: sets.select(F.col("key").alias("k" + x), F.col("sig").alias("s" + x), F.col("data").alias("t" + x))
    got = near.withColumn("ka", F.col("a.key")).withColumn("kb", F.col("b.key")).join(side("a"), ["ka", "sa"]).join(side("b"), ["kb", "sb"])
    links = written(in_arrow(got.select("a", "b", "ta", "tb"), verified, f"a {node}, b {node}"), "links")
    discard(sets)
    discard(near)
    return links


class Tree:
    """An R-tree packed bottom up over points sorted by set size; boxes hold coordinate maxima."""

    def __init__(self, points: np.ndarray, n: np.ndarray, fan: int = LEAF):
        self.levels = [(points, n, n)]
        while len(self.levels[-1][0]) > 1:
            box, low, high = self.levels[-1]
            at = np.arange(0, len(box), fan)
            self.levels.append((np.maximum.reduceat(box, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
        self.fan = fan

    def pairs(self, other: Tree, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Positions in both trees whose bounds allow a link (once per unordered pair within one tree)."""
        i = j = np.zeros(1, np.int64)
        top = max(len(self.levels), len(other.levels)) - 1
        for level in range(top, -1, -1):
            (pa_, la, ha), (pb, lb, hb) = (t.levels[min(level, len(t.levels) - 1)] for t in (self, other))
            if level < top:
                i, j = self._down(i, level, len(pa_), j, other, len(pb))
            if same:
                up = i <= j if level else i < j
                i, j = i[up], j[up]
            ok = np.zeros(len(i), dtype=bool)
            for s in range(0, len(i), 1 << 16):
                x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                # sizes first: the smaller set must hold PERCENT of the larger one
                fit = (100 * ha[x] >= PERCENT * lb[y]) & (100 * hb[y] >= PERCENT * la[x])
                k = np.flatnonzero(fit)
                bound = np.minimum(pa_[x[k]], pb[y[k]]).sum(1, dtype=np.int64)
                ok[s + k[enough(bound, la[x[k]].astype(np.int64), lb[y[k]].astype(np.int64))]] = True
            i, j = i[ok], j[ok]
        return i, j

    def _down(self, i, level, most_i, j, other, most_j):
        def children(x, tree, most):
            deep = level < len(tree.levels) - 1
            return (x[:, None] * tree.fan + np.arange(tree.fan), most) if deep else (x[:, None], most)

        (ci, mi), (cj, mj) = children(i, self, most_i), children(j, other, most_j)
        a = np.repeat(ci, cj.shape[1], axis=1).ravel()
        b = np.tile(cj, (1, ci.shape[1])).ravel()
        fit = (a < mi) & (b < mj)
        return a[fit], b[fit]


def candidates(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs of entities with different roots whose points allow a link, and in how many shards (c) they meet.

    rows: token, sig, n, root and m (members of the shard); shards above BLOCK are cut into blocks. Pairs that meet
    in fewer shards than similar sets of their sizes do are left out. A pair that meets in a shard of more than LEAF
    is held against its finer points there, once, and c is then what these allow it to share.
    """
    large = F.col("m") > LEAF
    firsts = rows.where(large).groupBy("sig").agg(F.slice(F.array_sort(F.collect_set("token")), 1, FIRST).alias("first"))
    carried = F.when(F.length("fine") <= 9 + (1 << CARRIED_BITS - 2), F.col("fine"))
    points = entities.select("sig", "point", carried.alias("fine")).join(firsts, "sig", "left")
    blocks = F.floor((F.col("m") + BLOCK - 1) / BLOCK).cast("int")
    rows = rows.join(points, "sig").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "token", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "mine", "sig", "n", "root", "m", "point",
        F.when(large, F.col("fine")).alias("fine"), F.when(large, F.col("first")).alias("first"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            both = np.stack((np.minimum(x, y), np.maximum(x, y), least_in_common(n, m)), axis=1) if len(x) else np.zeros((0, 3), np.int64)
            both, which = np.unique(both, axis=0, return_inverse=True)
            times = np.bincount(which.ravel(), weights=c, minlength=len(both))
            return pa.RecordBatch.from_arrays([*(pa.array(k) for k in both.T.copy()), pa.array(times.astype(np.int64))], ["a", "b", "r", "c"])

        rest = None
        for batch in batches:
            rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0] if rest.num_rows + batch.num_rows else batch
            yield from walk(rest, False, emit)
            rest = rest.slice(tail(rest))
        if rest is not None and rest.num_rows:
            yield from walk(rest, True, emit)

    met = in_arrow(rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "sig"), run, "a long, b long, r long, c long")
    return met.groupBy("a", "b").agg(F.max("r").alias("r"), F.sum("c").alias("c")).where("c >= r").select("a", "b", "c")


def tail(batch: pa.RecordBatch) -> int:
    """Where the last shard (pair of blocks) of a sorted batch begins."""
    if not batch.num_rows:
        return 0
    keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("token", "i", "j")], axis=1)
    return int(np.flatnonzero((keys != keys[-1]).any(1)).max(initial=-1)) + 1


def walk(batch: pa.RecordBatch, last: bool, emit) -> Iterator[pa.RecordBatch]:
    """The pairs of all shards in a batch but the last one, which may go on, unless last is set."""
    stop = batch.num_rows if last else tail(batch)
    if not stop:
        return
    batch = batch.slice(0, stop)
    cols = {c: batch.column(c).to_numpy().astype(np.int64) for c in ("token", "i", "j", "mine", "sig", "n", "root", "m")}
    points = coordinates(batch.column("point"))
    fresh = np.concatenate(([True], (cols["token"][1:] != cols["token"][:-1]) | (cols["i"][1:] != cols["i"][:-1]) | (cols["j"][1:] != cols["j"][:-1])))
    heads = np.flatnonzero(fresh)
    ends = np.concatenate((heads[1:], [stop]))
    sizes = ends - heads
    large = cols["m"][heads] > LEAF
    left, right = [], []
    # small shards all at once: each row with the one k rows on
    small = np.repeat(~large, sizes)
    end_of = np.repeat(ends, sizes)
    for k in range(1, LEAF):
        x = np.flatnonzero(small & (np.arange(stop) + k < end_of))
        y = x + k
        fit = (cols["root"][x] != cols["root"][y]) & (100 * cols["n"][x] >= PERCENT * cols["n"][y])
        left.append(x[fit])
        right.append(y[fit])
    x, y = np.concatenate(left), np.concatenate(right)
    left, right = [], []
    for s in range(0, len(x), 1 << 16):
        p, q = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
        fit = enough(np.minimum(points[p], points[q]).sum(1, dtype=np.int64), cols["n"][p], cols["n"][q])
        left.append(p[fit])
        right.append(q[fit])
    shared = [np.ones(len(p), np.int64) for p in left]
    for a, b in zip(heads[large].tolist(), ends[large].tolist()):
        if cols["i"][a] == cols["j"][a]:
            one = np.arange(a, b)
            tree = Tree(points[one], cols["n"][one])
            p, q = tree.pairs(tree, True)
            p, q = one[p], one[q]
        else:
            one, two = (a + np.flatnonzero(cols["mine"][a:b] == cols[c][a]) for c in "ij")
            if not len(one) or not len(two):
                continue
            p, q = Tree(points[one], cols["n"][one]).pairs(Tree(points[two], cols["n"][two]), False)
            p, q = one[p], two[q]
        fit = cols["root"][p] != cols["root"][q]
        p, q = p[fit], q[fit]
        if not len(p):
            continue
        new = ~met_before(int(cols["token"][a]), batch.column("first").slice(a, b - a).to_pylist(), p - a, q - a)
        p, q = p[new], q[new]
        n, m = cols["n"][p], cols["n"][q]
        most = fine_limits(batch.column("fine").slice(a, b - a).to_pylist(), p - a, q - a, np.minimum(n, m))
        fit = enough(most, n, m)
        left.append(p[fit])
        right.append(q[fit])
        shared.append(most[fit])
    if left:
        p, q = np.concatenate(left), np.concatenate(right)
        yield emit(cols["sig"][p], cols["sig"][q], cols["n"][p], cols["n"][q], np.concatenate(shared))


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key, n and component_id of each row; key is the hash of the row's identifier and text."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    profiles = written(profile(narrow), "profile")
    rows = written(profiles.select("id", "key", "n", "sig", "check"), "rows")
    node = F.struct(F.col("id").isNull().alias("nameless"), "id", "key")
    entities = written(profiles.where("n > 0").groupBy("sig", "check", "n").agg(F.min(node).alias("node"), F.first("point").alias("point"), F.first("fine").alias("fine")), "entities")
    firsts = profiles.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    heavy = written(firsts.where(f"c > {HEAVY}").select("token"), "heavy")
    discard(profiles)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    shared = written(shards(dealt(narrow, members(heavy, "token")), parts), "shards")

    links = linked(narrow, entities, favourites(shared, "lead").unionByName(favourites(shared, "prev")).distinct())
    roots = components(links, "a", "b")

    left = unlinked(shared, rooted(entities, roots))
    discard(shared)
    hubs = written(central(left), "central")
    if not hubs.isEmpty():
        links = written(links.unionByName(linked(narrow, entities, hubs)), "links")
        roots = components(links, "a", "b")
        mixed, left = left, unlinked(left, rooted(entities, roots))
        discard(mixed)
    pairs = written(candidates(left, entities), "pairs")
    discard(left)
    ends = pairs.select(F.col("a").alias("sig"), "c", F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("sig"), "c", F.col("a").alias("other")))
    best = ends.groupBy("sig").agg(F.max(F.struct("c", "other")).alias("x")).select(F.least("sig", "x.other").alias("a"), F.greatest("sig", "x.other").alias("b")).distinct()
    best = written(best, "best")
    links = written(links.unionByName(linked(narrow, entities, best)), "links")
    roots = components(links, "a", "b")
    root = lambda x: rooted(entities, roots).select(F.col("sig").alias(x), F.col("root").alias("r" + x))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(root("a"), "a").join(root("b"), "b").where("ra <> rb").select("a", "b").distinct()
    more = linked(narrow, entities, rest)
    if not more.isEmpty():
        roots = components(links.unionByName(more), "a", "b")
    named = entities.join(roots, "node", "left").select("sig", "check", "n", F.coalesce("root.id", "node.id").alias("component_id"))
    return rows.join(named, ["sig", "check", "n"], "left").select("id", "key", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))


def rooted(entities: DataFrame, roots: DataFrame) -> DataFrame:
    """sig and root (the key of the root's row) of each entity."""
    return entities.select("sig", "node").join(roots, "node", "left").select("sig", F.coalesce("root.key", "node.key").alias("root"))


def favourites(shared: DataFrame, other: str) -> DataFrame:
    """Each entity with the one that is its other ("lead" or "prev") in most of its shards, as pairs (a, b).

    Members of a shard stand in the same order in all their shards, so near copies of one text are each
    other's neighbours again and again, while texts with one passage in common are so a few times.
    """
    n, m = F.col("n"), F.col(other + "_n")
    fit = (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (F.col("sig") != F.col(other))
    seen = shared.where(fit).groupBy("sig", F.col(other).alias("other")).agg(F.count("*").alias("c"))
    best = seen.groupBy("sig").agg(F.max(F.struct("c", "other")).alias("x"))
    return best.select(F.least("sig", "x.other").alias("a"), F.greatest("sig", "x.other").alias("b"))


def central(left: DataFrame) -> DataFrame:
    """Each entity with the one that leads most of its large shards and isn't linked with it yet, as pairs (a, b).

    A shard is led by the entity that is in most large shards: of a group of near copies, the one that the others
    were made from, or one like it, which is nearer to them than they are to each other.
    """
    large = left.where(F.col("m") > LEAF).select("token", "sig", "n", "root")
    often = large.groupBy("sig").agg(F.count("*").alias("w"))
    leads = large.join(often, "sig").groupBy("token").agg(F.max(F.struct("w", "sig", "n", "root")).alias("x"))
    leads = leads.select("token", F.col("x.sig").alias("lead"), F.col("x.n").alias("lead_n"), F.col("x.root").alias("lead_root"))
    return favourites(large.join(leads, "token").where("root <> lead_root"), "lead")


def unlinked(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of shards whose members are not all in one component yet: token, sig, n, root and m (the members)."""
    rows = written(shared.select("token", "sig", "n").join(roots, "sig"), "members")
    mixed = rows.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("m")).where("r0 <> r1").select("token", "m")
    left = written(rows.join(mixed, "token"), "mixed")
    discard(rows)
    return left


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles and component_id (the smallest identifier reachable)."""
    return classes(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest identifier.

    Rows that repeat an identifier and its text stay or go together; rows without an identifier go if their
    component has another one.
    """
    found = classes(docs, id_col, text_col)
    key = max([*docs.columns, ""], key=len) + "_key"
    gone = found.where("component_id is not null and not (id <=> component_id)").select(F.col("key").alias(key))
    return without(docs.withColumn(key, row_key(id_col, text_col)), gone, key).select(*docs.columns)
