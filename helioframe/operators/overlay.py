"""Boolean algebra of polygons as joins and windows.

A region is a table of directed edges, so it may have any number of parts and holes. An overlay cuts the plane of
each key at the heights of all ends and crossings of edges; within a slab no two edges cross, so a window from left
to right tells where the wanted combination of regions begins and ends. The result is a table of trapezoids:

    key..., y0, y1 (the slab), xl0, xl1 (the left side at y0 and y1), xr0, xr1 (the right side)

Keys of at most SMALL edges are gathered, and each is swept where it lies (swept), which moves every edge once. Keys
with more edges are cut into bands of y, and crossings are looked for in cells, so that a key may be large: its edges
aren't gathered, and the slabs of a band only span that band. Where only areas or regions are wanted, such keys are cut
into tiles: one that no edge can change, as enough shapes cover it, isn't cut into slabs at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.operators.stages import stored

#: Edges of a band, and of a cell, on average.
BAND_EDGES, CELL_EDGES = 128, 64
#: Edges of a key that is swept where it lies, and pairs of edges held at once there.
SMALL, PAIRS = 96, 100_000
#: Edges of a tile on average, at most so many tiles to an edge; and edges of a tile that is swept where it lies.
TILE_EDGES, EDGE_TILES, TILE_SMALL = 24, 8, 512
#: Trapezoids flatter than this, or narrower at both ends, are left out: edges that are all but level make some.
SLIVER = 1e-9


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def signed_area(ring: Column) -> Column:
    """Positive for rings that run counter-clockwise."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda a, b: a + b) / 2


def oriented(ring: Column, clockwise: Column) -> Column:
    return F.when((signed_area(ring) < 0) == clockwise, ring).otherwise(F.reverse(ring))


def edges(shapes: DataFrame, key: list[str], side: Column, rings: Column) -> DataFrame:
    """The edges of shapes: key..., side, x0, y0, x1, y1 (upwards) and w, by how much the region's winding grows across.

    rings is an array of rings, each an array of points (x, y), closed or not: the outer ring, then holes, in any
    direction. Keys mustn't be named as columns of the edges or the result are, nor start with x_ or k_.
    Shapes of a key and side are united. Null shapes and rings, and rings of less than three points, have
    no edges; level edges aren't needed.
    """
    ring = shapes.select(*key, side.alias("side"), F.posexplode(rings).alias("x_at", "x_ring")).where(F.size("x_ring") >= 3)
    ring = ring.withColumn("x_ring", oriented(F.col("x_ring"), F.col("x_at") > 0))
    following = F.concat(F.slice("x_ring", 2, F.size("x_ring")), F.slice("x_ring", 1, 1))
    one = ring.select(*key, "side", F.explode(F.arrays_zip(F.col("x_ring").alias("x_p"), following.alias("x_q"))).alias("x_e")).select(*key, "side", "x_e.x_p", "x_e.x_q")
    up = F.col("x_p.y") < F.col("x_q.y")
    pick = lambda a, b, c: F.when(up, F.col(f"x_{a}.{c}")).otherwise(F.col(f"x_{b}.{c}"))
    return one.where(F.col("x_p.y") != F.col("x_q.y")).select(
        *key, "side", pick("p", "q", "x").alias("x0"), pick("p", "q", "y").alias("y0"), pick("q", "p", "x").alias("x1"), pick("q", "p", "y").alias("y1"), F.when(up, -1).otherwise(1).alias("w")
    )


def at(y: Column, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> Column:
    """Where an edge is at height y; its ends exactly."""
    a, b, c, d = (F.col(v) for v in (x0, y0, x1, y1))
    return F.when(y == b, a).when(y == d, c).otherwise(a + (c - a) * ((y - b) / (d - b)))


def banded(edges: DataFrame, key: list[str]) -> DataFrame:
    """Edges cut at the borders of their key's bands, with band, and cell: the size of the key's cells."""
    span = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("y0").alias("low"), F.max("y1").alias("high"), F.min(F.least("x0", "x1")).alias("west"), F.max(F.greatest("x0", "x1")).alias("east"))
    bands = F.ceil(F.col("n") / BAND_EDGES)
    grid = F.ceil(F.sqrt(F.col("n") / CELL_EDGES))
    span = span.select(*key, "low", ((F.col("high") - F.col("low")) / bands).alias("step"), bands.alias("bands"), (F.greatest(F.col("high") - F.col("low"), F.col("east") - F.col("west")) * 1.000001 / grid).alias("cell"), "west")
    named = span.withColumnsRenamed({k: f"k_{k}" for k in key})
    rows = edges.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in key])).drop(*(f"k_{k}" for k in key))
    band = lambda y: F.least(F.floor((F.col(y) - F.col("low")) / F.col("step")), F.col("bands") - 1).cast("int")
    rows = rows.withColumn("band", F.explode(F.sequence(band("y0"), band("y1"))))
    border = F.col("low") + F.col("step") * F.col("band")
    a = F.when(F.col("band") == 0, F.col("y0")).otherwise(F.greatest("y0", border))
    b = F.when(F.col("band") == F.col("bands") - 1, F.col("y1")).otherwise(F.least("y1", F.col("low") + F.col("step") * (F.col("band") + 1)))
    rows = rows.withColumn("x_a", a).withColumn("x_b", b).where("x_a < x_b")
    ends = {"x0": at(F.col("x_a")), "y0": F.col("x_a"), "x1": at(F.col("x_b")), "y1": F.col("x_b")}
    return rows.select(*key, "band", "side", *[v.alias(c) for c, v in ends.items()], "w", "cell", "low", "west")


def crossings(cut: DataFrame, by: list[str]) -> DataFrame:
    """by..., y: the heights at which edges of a band cross, each pair met in the cells that both reach."""
    along = lambda lo, hi, base: F.explode(F.sequence(F.floor((lo - F.col(base)) / F.col("cell")).cast("int"), F.floor((hi - F.col(base)) / F.col("cell")).cast("int")))
    celled = cut.withColumn("cx", along(F.least("x0", "x1"), F.greatest("x0", "x1"), "west")).withColumn("cy", along(F.col("y0"), F.col("y1"), "low"))
    own = ["x0", "y0", "x1", "y1"]
    a, b = celled.select(*by, "cx", "cy", *own).distinct(), celled.select(*[F.col(c).alias(f"b_{c}") for c in [*by, "cx", "cy", *own]]).distinct()
    met = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in [*by, "cx", "cy"]])
    first = F.struct(*own) < F.struct(*[F.col(f"b_{c}") for c in own])
    pairs = a.join(b, met).where(first)
    low, high = F.greatest("y0", "b_y0"), F.least("y1", "b_y1")
    other = lambda y: at(y, "b_x0", "b_y0", "b_x1", "b_y1")
    pairs = pairs.where(low < high).withColumn("d0", at(low) - other(low)).withColumn("d1", at(high) - other(high)).where(F.col("d0") * F.col("d1") < 0)
    return pairs.select(*by, (low + (high - low) * (F.col("d0") / (F.col("d0") - F.col("d1")))).alias("y"))


def overlay(edges: DataFrame, key: list[str], wanted: Mapping[str, str] | list[str], inside: Column, tiles: bool = False) -> DataFrame:
    """The trapezoids of each key in which inside holds, a condition on boolean columns in_<side> for the sides in wanted.

    A point is in a side where its winding is positive, so overlapping parts of a side are united and holes are
    empty. Regions that only touch have nothing in common. An empty table, or one in which nothing is inside, gives
    an empty result; keys may be null. With tiles the trapezoids of large keys are cut at the borders of tiles as well,
    which suits areas and further overlays, but not chords or rows.
    """
    edges = edges.where(F.col("side").isin(*wanted)).dropna(subset=["x0", "y0", "x1", "y1"])
    return by_size(edges, key, list(wanted), inside, SMALL, tiled if tiles else joined)


def by_size(edges: DataFrame, key: list[str], wanted: list[str], inside: Column, small: int, large: Callable[[DataFrame, list[str], list[str], Column], DataFrame]) -> DataFrame:
    """Keys of at most small edges are swept, the others go to large."""
    many = stored(edges.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > small).select(*[F.col(k).alias(f"k_{k}") for k in key]))
    if many.isEmpty():
        return swept(edges, key, wanted, inside)
    same = same_key(key)
    return swept(edges.join(many, same, "left_anti"), key, wanted, inside).unionByName(large(edges.join(many, same, "left_semi"), key, wanted, inside))


def same_key(key: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in key])


def swept(edges: DataFrame, key: list[str], wanted: list[str], inside: Column) -> DataFrame:
    """overlay of keys with few edges."""
    number = reduce(lambda rest, s: F.when(F.col("side") == s[1], s[0]).otherwise(rest), enumerate(wanted), F.lit(0))
    one = F.struct(number.cast("long").alias("s"), F.col("w").cast("long").alias("w"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    held = edges.groupBy(*key).agg(F.collect_list(one).alias("x_edges"))
    for bits in range(2 ** len(wanted)):  # what inside says of every combination of sides
        held = held.withColumns({f"in_{s}": F.lit(bool(bits >> n & 1)) for n, s in enumerate(wanted)}).withColumn(f"x_{bits}", F.coalesce(inside, F.lit(False)))
    held = held.select(*key, F.array(*[f"x_{bits}" for bits in range(2 ** len(wanted))]).alias("x_inside"), "x_edges")
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in held.select(*key).schema]
    return held.mapInArrow(sweeping(len(key)), ", ".join([*types, *(f"{c} double" for c in ("y0", "y1", "xl0", "xl1", "xr0", "xr1"))]))


def sweeping(keys: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of keys with their x_inside and x_edges to batches of trapezoids, so many keys at once as PAIRS allows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, inside = batch.column(keys + 1), batch.column(keys)
            n = np.diff(lists.offsets.to_numpy())
            edges = {c: lists.flatten().field(c).to_numpy() for c in ("s", "w", "x0", "y0", "x1", "y1")}
            truth = inside.flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(len(n), -1)
            part, start = (np.cumsum(n.astype(np.int64) ** 2) - 1) // PAIRS, np.concatenate(([0], np.cumsum(n)))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(n)]))
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    row, found = sweep(n[a:b], truth[a:b], {c: v[start[a] : start[b]] for c, v in edges.items()})
                    own = batch.slice(a, b - a).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*own.columns[:keys], *map(pa.array, found)], names=[*batch.schema.names[:keys], "y0", "y1", "xl0", "xl1", "xr0", "xr1"])

    return run


def ranges(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: which of them each element belongs to, and its place there."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def sweep(n: np.ndarray, truth: np.ndarray, e: dict[str, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The trapezoids of keys with n edges each, all at once: the key's number, and y0, y1, xl0, xl1, xr0, xr1."""
    first = np.cumsum(n) - n
    of, _ = ranges(n)
    x0, y0, x1, y1 = (e[c] for c in ("x0", "y0", "x1", "y1"))

    def at(i: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(y == y0[i], x0[i], np.where(y == y1[i], x1[i], x0[i] + (x1[i] - x0[i]) * ((y - y0[i]) / (y1[i] - y0[i]))))

    pair, k = ranges(n * n)
    i, j = first[pair] + k // n[pair], first[pair] + k % n[pair]
    low, high = np.maximum(y0[i], y0[j]), np.minimum(y1[i], y1[j])
    meet = (i < j) & (low < high)
    i, j, low, high = i[meet], j[meet], low[meet], high[meet]
    d0, d1 = at(i, low) - at(j, low), at(i, high) - at(j, high)
    cross = d0 * d1 < 0
    ys = np.concatenate([y0, y1, (low + (high - low) * np.divide(d0, d0 - d1, out=np.zeros_like(d0), where=cross))[cross]])
    key = np.concatenate([of, of, of[i[cross]]])
    order = np.lexsort((ys, key))
    new = np.concatenate(([True], (np.diff(key[order]) != 0) | (np.diff(ys[order]) != 0)))
    place = np.empty(len(ys), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    height = ys[order][new]
    # a slab reaches from each height to the next one; edges are cut into those that they span
    count = place[len(of) : 2 * len(of)] - place[: len(of)]
    edge, k = ranges(count)
    slab = place[edge] + k
    a, b = height[slab], height[slab + 1]
    thick = b - a > SLIVER
    edge, slab, a, b = edge[thick], slab[thick], a[thick], b[thick]
    xa, xb = at(edge, a), at(edge, b)
    order = np.lexsort((xa, xa + xb, slab))
    edge, slab, a, b, xa, xb = (v[order] for v in (edge, slab, a, b, xa, xb))
    begins = np.concatenate(([True], np.diff(slab) != 0))[: len(slab)]
    head = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    bits = np.zeros(len(slab), dtype=np.int64)
    for s in range(truth.shape[1].bit_length() - 1):
        w = np.where(e["s"][edge] == s, e["w"][edge], 0)
        total = np.cumsum(w)
        bits |= (total - (total - w)[head] > 0).astype(np.int64) << s
    # edges that coincide count together
    leads = begins | np.concatenate(([True], np.diff(xa + xb) != 0))[: len(slab)]
    lead = np.flatnonzero(leads)
    now = truth[of[edge], bits][np.concatenate((lead[1:], [len(slab)])).astype(np.int64) - 1] if len(slab) else np.zeros(0, dtype=bool)
    before = np.concatenate(([False], now[:-1]))[: len(now)] & ~begins[lead]
    at_change = lead[now != before]
    opens = np.flatnonzero(now[now != before])
    opens = opens[opens + 1 < len(at_change)]
    left, right = at_change[opens], at_change[opens + 1]
    wide = (slab[left] == slab[right]) & ((xa[right] - xa[left] > SLIVER) | (xb[right] - xb[left] > SLIVER))
    left, right = left[wide], right[wide]
    return of[edge[left]], [a[left], b[left], xa[left], xb[left], xa[right], xb[right]]


def joined(edges: DataFrame, key: list[str], wanted: list[str], inside: Column) -> DataFrame:
    """overlay of keys with many edges."""
    by = [*key, "band"]
    cut = stored(banded(edges, key))  # read four times
    ends = cut.select(*by, F.explode(F.array("y0", "y1")).alias("y"))
    lines = ends.unionByName(crossings(cut, by)).groupBy(*by).agg(F.array_sort(F.collect_set("y")).alias("ys"))
    lines = lines.select(*[F.col(c).alias(f"k_{c}") for c in by], F.arrays_zip(F.col("ys").alias("a"), F.slice("ys", 2, F.size("ys")).alias("b")).alias("slabs"))
    both = cut.join(lines, reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in by]))
    piece = both.withColumn("slab", F.explode(F.filter("slabs", lambda s: (s["a"] >= F.col("y0")) & (s["b"] <= F.col("y1")))))
    piece = piece.select(*by, "side", "w", F.col("slab.a").alias("y0"), F.col("slab.b").alias("y1"), at(F.col("slab.a")).alias("xa"), at(F.col("slab.b")).alias("xb"))
    # edges that coincide count together: sums over a range include all of them, so only the first can change a state
    w = Window.partitionBy(*by, "y0").orderBy(F.col("xa") + F.col("xb"))
    swept = piece.select(*by, "y0", "y1", "xa", "xb", *[F.sum(F.when(F.col("side") == s, F.col("w")).otherwise(0)).over(w).alias(f"n_{s}") for s in wanted])
    states = swept.select(*by, "y0", "y1", "xa", "xb", *[(F.col(f"n_{s}") > 0).alias(f"in_{s}") for s in wanted]).withColumn("now", inside)
    changes = states.withColumn("before", F.lag("now", 1, False).over(w)).where("now <> before")
    found = changes.select(*key, "y0", "y1", "now", F.col("xa").alias("xl0"), F.col("xb").alias("xl1"), F.lead("xa").over(w).alias("xr0"), F.lead("xb").over(w).alias("xr1"))
    return found.where(F.col("now") & (F.col("y1") - F.col("y0") > SLIVER) & ((F.col("xr0") - F.col("xl0") > SLIVER) | (F.col("xr1") - F.col("xl1") > SLIVER))).drop("now")


def level_edges(edges: DataFrame, key: list[str]) -> DataFrame:
    """key..., side, y, xa, xb, w: the level edges that close the rings again, w being how much the winding grows upwards."""
    ends = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("w").alias("d")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (-F.col("w")).alias("d")))
    corners = edges.select(*key, "side", F.inline(ends)).groupBy(*key, "side", "y", "x").agg(F.sum("d").alias("d")).where("d <> 0")
    across = Window.partitionBy(*key, "side", "y").orderBy("x")
    level = corners.select(*key, "side", "y", F.col("x").alias("xa"), F.lead("x").over(across).alias("xb"), F.sum("d").over(across.rowsBetween(Window.unboundedPreceding, 0)).alias("w"))
    return level.where("w <> 0")


def tile_pieces(edges: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """Edges cut at the borders of tiles: key..., t_cy, t_cx (the tile), side, w, x0, y0, x1, y1; step, delta, from.

    step is by how much the edge changes the winding of the lower left corners of the tiles to the right. Above the
    height from, where the edge meets the tile's left border, the winding there changes by delta.
    """
    rows = edges.join(spans, same_key(key)).drop(*(f"k_{k}" for k in key))
    place = lambda v, base: F.floor((v - F.col(base)) / F.col("t_size"))
    line = lambda c, base: F.col(base) + F.col("t_size") * F.col(c)
    rows = rows.withColumn("t_cy", F.explode(F.sequence(place(F.col("y0"), "t_low"), place(F.col("y1"), "t_low"))))
    rows = rows.withColumns({"t_a": F.greatest("y0", line("t_cy", "t_low")), "t_b": F.least(F.col("y1"), F.col("t_low") + F.col("t_size") * (F.col("t_cy") + 1)), "t_spans": F.col("y0") <= line("t_cy", "t_low")}).where("t_a < t_b")
    rows = rows.withColumns({"t_xa": at(F.col("t_a")), "t_xb": at(F.col("t_b"))}).drop("x0", "y0", "x1", "y1")
    rows = rows.withColumns({"t_k0": place(F.col("t_xa"), "t_west"), "t_k1": place(F.col("t_xb"), "t_west")})
    rows = rows.withColumn("t_cx", F.explode(F.sequence(F.least("t_k0", "t_k1"), F.greatest("t_k0", "t_k1"))))
    left, right = line("t_cx", "t_west"), F.col("t_west") + F.col("t_size") * (F.col("t_cx") + 1)
    height = lambda x: F.least(F.greatest(F.col("t_a") + (F.col("t_b") - F.col("t_a")) * ((x - F.col("t_xa")) / (F.col("t_xb") - F.col("t_xa"))), F.col("t_a")), F.col("t_b"))
    east = F.col("t_k0") < F.col("t_k1")
    first, last = F.col("t_cx") == F.col("t_k0"), F.col("t_cx") == F.col("t_k1")
    into, out_of = F.when(east, left).otherwise(right), F.when(east, right).otherwise(left)
    border = F.when(east & ~first, left).when((F.col("t_k0") > F.col("t_k1")) & ~last, left)
    return rows.select(
        *key, "t_cy", "t_cx", "side", "w", F.when(first, F.col("t_xa")).otherwise(into).alias("x0"), F.when(first, F.col("t_a")).otherwise(height(into)).alias("y0"),
        F.when(last, F.col("t_xb")).otherwise(out_of).alias("x1"), F.when(last, F.col("t_b")).otherwise(height(out_of)).alias("y1"),
        F.when(first & F.col("t_spans"), F.col("w")).otherwise(0).alias("step"), F.when(border.isNull(), 0).when(east, -F.col("w")).otherwise(F.col("w")).alias("delta"), height(border).alias("from"),
    )


def level_pieces(level: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """Level edges as tile_pieces has them; they aren't edges of a tile, but change the winding along its left border."""
    rows = level.join(spans, same_key(key)).drop(*(f"k_{k}" for k in key))
    place = lambda v, base: F.floor((v - F.col(base)) / F.col("t_size"))
    rows = rows.withColumn("t_cy", place(F.col("y"), "t_low")).withColumn("t_first", place(F.col("xa"), "t_west"))
    rows = rows.withColumn("t_cx", F.explode(F.sequence("t_first", F.greatest("t_first", place(F.least(F.coalesce("xb", "t_east"), "t_east"), "t_west")))))
    # edges that begin on the lower border count there already
    met = (F.col("t_cx") > F.col("t_first")) & (F.col("y") > F.col("t_low") + F.col("t_size") * F.col("t_cy"))
    none = F.lit(None).cast("double")
    return rows.select(*key, "t_cy", "t_cx", "side", F.lit(0).alias("w"), *[none.alias(c) for c in ("x0", "y0", "x1", "y1")], F.lit(0).alias("step"), F.when(met, F.col("w")).otherwise(0).alias("delta"), F.when(met, F.col("y")).alias("from"))


def tiled(edges: DataFrame, key: list[str], wanted: list[str], inside: Column) -> DataFrame:
    """overlay of keys with many edges, cut into tiles; for areas and further overlays.

    Of a tile the winding at its lower left corner is known, and by how much the edges that meet it can change that at
    most: where this leaves no side open, it is inside as a whole or not at all. Only the others are cut into slabs.
    """
    edges = stored(edges.groupBy(*key, "side", "x0", "y0", "x1", "y1").agg(F.sum("w").alias("w")).where("w <> 0"))
    n, long = F.count("*"), F.sum(F.abs(F.col("x1") - F.col("x0")) + F.col("y1") - F.col("y0"))
    spans = edges.groupBy(*key).agg(n.alias("n"), long.alias("long"), F.min("y0").alias("low"), F.max("y1").alias("high"), F.min(F.least("x0", "x1")).alias("west"), F.max(F.greatest("x0", "x1")).alias("t_east"))
    area = (F.col("high") - F.col("low")) * (F.col("t_east") - F.col("west"))
    wide = (F.sqrt(F.col("long") ** 2 + 4 * TILE_EDGES * F.col("n") * area) - F.col("long")) / (2 * F.col("n"))
    spans = spans.withColumn("t_size", F.greatest(wide, F.col("long") / F.col("n") / EDGE_TILES))
    spans = stored(spans.select(*[F.col(k).alias(f"k_{k}") for k in key], "t_size", (F.col("low") - 0.381966 * F.col("t_size")).alias("t_low"), (F.col("west") - 0.618034 * F.col("t_size")).alias("t_west"), "t_east"))
    level = stored(level_edges(edges, key))
    pieces = tile_pieces(edges, spans, key).unionByName(level_pieces(level, spans, key))

    tile = [*key, "t_cy", "t_cx"]
    sums = {}
    for s in wanted:
        mine = lambda v: F.sum(F.when(F.col("side") == s, v).otherwise(0))
        sums |= {f"step_{s}": mine(F.col("step")), f"less_{s}": mine(F.greatest(-F.col("w"), F.lit(0)) + F.greatest(-F.col("delta"), F.lit(0))), f"more_{s}": mine(F.greatest("w", F.lit(0)) + F.greatest("delta", F.lit(0)))}
    found = pieces.groupBy(*tile).agg(*[v.alias(c) for c, v in sums.items()])
    across = Window.partitionBy(*key, "t_cy").orderBy("t_cx")
    found = found.withColumns({f"base_{s}": F.coalesce(F.sum(f"step_{s}").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for s in wanted}).withColumn("t_next", F.lead("t_cx").over(across))
    found = found.withColumn("t_open", reduce(lambda a, b: a | b, [(F.col(f"base_{s}") <= F.col(f"less_{s}")) & (F.col(f"base_{s}") + F.col(f"more_{s}") > 0) for s in wanted]))
    found = stored(found.select(*tile, "t_next", "t_open", *[f"base_{s}" for s in wanted], *[(F.col(f"base_{s}") + F.col(f"step_{s}")).alias(f"next_{s}") for s in wanted]))

    placed = found.join(spans, same_key(key)).drop(*(f"k_{k}" for k in key))
    rectangle = lambda a, b: [
        (F.col("t_low") + F.col("t_size") * F.col("t_cy")).alias("y0"), (F.col("t_low") + F.col("t_size") * (F.col("t_cy") + 1)).alias("y1"),
        *[(F.col("t_west") + F.col("t_size") * v).alias(c) for c, v in (("xl0", a), ("xl1", a), ("xr0", b), ("xr1", b))]]
    states = lambda df, of: df.withColumns({f"in_{s}": F.col(f"{of}_{s}") > 0 for s in wanted}).where(inside)
    whole = states(placed.where("not t_open"), "base").select(*key, *rectangle(F.col("t_cx"), F.col("t_cx") + 1))
    gaps = states(placed.where("t_next > t_cx + 1"), "next").select(*key, *rectangle(F.col("t_cx") + 1, F.col("t_next")))

    opened = placed.where("t_open")
    of_tile = opened.select(*[F.col(k).alias(f"k_{k}") for k in tile], (F.col("t_low") + F.col("t_size") * (F.col("t_cy") + 1)).alias("t_top"), (F.col("t_west") + F.col("t_size") * F.col("t_cx")).alias("t_left"))
    met = pieces.join(of_tile, same_key(tile)).drop(*(f"k_{k}" for k in tile))
    own = met.where("y0 < y1").select(*tile, "side", "x0", "y0", "x1", "y1", "w")
    rising = met.where((F.col("delta") != 0) & (F.col("from") < F.col("t_top"))).select(*tile, "side", F.col("t_left").alias("x0"), F.col("from").alias("y0"), F.col("t_left").alias("x1"), F.col("t_top").alias("y1"), F.col("delta").alias("w"))
    upright = lambda side, x, w: F.struct(F.lit(side).alias("side"), x.alias("x0"), w.cast("long").alias("w"))
    left, right = F.col("t_west") + F.col("t_size") * F.col("t_cx"), F.col("t_west") + F.col("t_size") * (F.col("t_cx") + 1)
    sides = F.array(*[upright(s, left, F.col(f"base_{s}")) for s in wanted], upright("x_tile", left, F.lit(1)), upright("x_tile", right, F.lit(-1)))
    low, high = F.col("t_low") + F.col("t_size") * F.col("t_cy"), F.col("t_low") + F.col("t_size") * (F.col("t_cy") + 1)
    frame = opened.select(*tile, low.alias("y0"), high.alias("y1"), F.inline(sides)).where("w <> 0").withColumn("x1", F.col("x0"))
    cut = stored(own.unionByName(rising).unionByName(frame))
    parts = by_size(cut, tile, [*wanted, "x_tile"], inside & F.col("in_x_tile"), TILE_SMALL, joined).drop("t_cy", "t_cx")
    return whole.unionByName(gaps).unionByName(parts)


def trapezoid_area() -> Column:
    return (F.col("xr0") - F.col("xl0") + F.col("xr1") - F.col("xl1")) / 2 * (F.col("y1") - F.col("y0"))


def areas(found: DataFrame, key: list[str], name: str = "area") -> DataFrame:
    return found.groupBy(*key).agg(F.sum(trapezoid_area()).alias(name))


def edges_of(found: DataFrame, key: list[str], side: str) -> DataFrame:
    """Trapezoids as a region again, for a further overlay."""
    ends = F.array(*[F.struct(F.col(f"x{s}0").alias("x0"), F.col("y0").alias("y0"), F.col(f"x{s}1").alias("x1"), F.col("y1").alias("y1"), F.lit(n).alias("w")) for s, n in (("l", 1), ("r", -1))])
    return found.select(*key, F.explode(ends).alias("e")).select(*key, F.lit(side).alias("side"), "e.*")


def border(rings: Column, distance: Column, limit: float = 5.0) -> Column:
    """The strip of a width along all edges of a shape, as an array of polygons that overlap.

    Inside the shape for a positive distance, outside for a negative one. Corners that stick out of the strip are
    mitred; where the mitre would be longer than limit times the width, they are bevelled. An inset is the shape
    without its border; a buffer is the shape with it.
    """
    out, width = distance < 0, F.abs(distance)
    turned = F.transform(rings, lambda r, n: oriented(F.when(r[0] == F.element_at(r, -1), F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(r), (n > 0) != out))

    def strips(ring: Column) -> Column:
        before = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))
        after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        corners = F.arrays_zip(before.alias("o"), ring.alias("p"), after.alias("q"))
        return F.flatten(F.transform(corners, lambda c: corner(c["o"], c["p"], c["q"])))

    def normal(p: Column, q: Column) -> tuple[Column, Column]:
        long = F.greatest(F.hypot(q["x"] - p["x"], q["y"] - p["y"]), F.lit(1e-300))
        return -(q["y"] - p["y"]) / long, (q["x"] - p["x"]) / long

    def corner(o: Column, p: Column, q: Column) -> Column:
        (ax, ay), (bx, by) = normal(o, p), normal(p, q)
        shift = lambda s, x, y: point(s["x"] + x * width, s["y"] + y * width)
        strip = F.array(F.array(point(p["x"], p["y"]), point(q["x"], q["y"]), shift(q, bx, by), shift(p, bx, by)))
        turn = F.greatest(1 + ax * bx + ay * by, F.lit(1e-12))  # 1 + the cosine of the turn
        tip = shift(p, (ax + bx) / turn, (ay + by) / turn)
        kite = F.when(F.sqrt(2 / turn) <= limit, F.array(point(p["x"], p["y"]), shift(p, ax, ay), tip, shift(p, bx, by))).otherwise(F.array(point(p["x"], p["y"]), shift(p, ax, ay), shift(p, bx, by)))
        return F.when(ax * by - ay * bx < 0, F.concat(strip, F.array(kite))).otherwise(strip)

    distinct = lambda r: F.filter(r, lambda p, n: (n == 0) | (p != r[n - 1]))
    return F.when(width > 0, F.flatten(F.transform(F.filter(F.transform(turned, distinct), lambda r: F.size(r) >= 3), strips))).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>"))


def with_border(shapes: DataFrame, key: list[str], side: str, rings: str, distance: Column, rim: str) -> DataFrame:
    """Edges of shapes (side) and of their borders (rim)."""
    strips = shapes.select(*key, F.explode(border(F.col(rings), distance)).alias("strip"))
    return edges(shapes, key, F.lit(side), F.col(rings)).unionByName(edges(strips, key, F.lit(rim), F.array("strip")))


def inset(shapes: DataFrame, key: list[str], rings: str, distance: Column) -> DataFrame:
    """Trapezoids of shapes drawn in by a distance with mitred corners; arms narrower than twice that vanish."""
    return overlay(stored(with_border(shapes, key, "shape", rings, distance, "rim")), key, ["shape", "rim"], F.col("in_shape") & ~F.col("in_rim"))


def interior_points(shapes: DataFrame, key: list[str], rings: str) -> DataFrame:
    """key..., x, y: of each shape, the middle of the widest chord half way up one of its slabs (the lowest of equals)."""
    found = overlay(edges(shapes, key, F.lit("shape"), F.col(rings)), key, ["shape"], F.col("in_shape"))
    wide = (F.col("xr0") + F.col("xr1") - F.col("xl0") - F.col("xl1")) / 2
    here = point((F.col("xl0") + F.col("xl1") + F.col("xr0") + F.col("xr1")) / 4, (F.col("y0") + F.col("y1")) / 2)
    best = found.groupBy(*key).agg(F.max_by(here, F.struct(F.round(wide, 9), -F.col("y0"), -F.col("xl0"))).alias("p"))
    return best.select(*key, "p.x", "p.y")
