"""Polygon algebra, insets and interior points against scan lines in plain Python and closed forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helioframe.operators import overlay

RINGS = "array<array<struct<x: double, y: double>>>"


def star(rng, cx, cy, r, n, hole=False):
    ring = [(cx + r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), cy + r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    rings = [ring if rng.random() < 0.5 else ring[::-1] + [ring[-1]]]
    if hole:
        rings.append([(cx + 0.2 * r * math.cos(a), cy + 0.2 * r * math.sin(a)) for a in (0, 2, 4)])
    return rings


def turned(ring):
    return sum(x * v - u * y for (x, y), (u, v) in zip(ring, ring[1:] + ring[:1]))


def scanned(shapes, inside, lines=1500):
    """The area in which inside(windings by side) holds, from many level lines."""
    sides = sorted({s for s, _ in shapes})
    edges = []
    for s, rings in shapes:
        for i, ring in enumerate(rings):
            if (turned(ring) < 0) != (i > 0):
                ring = ring[::-1]
            edges += [(s, *p, *q) for p, q in zip(ring, ring[1:] + ring[:1])]
    low, high = min(min(e[2], e[4]) for e in edges), max(max(e[2], e[4]) for e in edges)
    total = 0.0
    for k in range(lines):
        y = low + (high - low) * (k + 0.5) / lines
        cuts = sorted((x0 + (x1 - x0) * (y - y0) / (y1 - y0), s, 1 if y1 < y0 else -1) for s, x0, y0, x1, y1 in edges if (y0 > y) != (y1 > y))
        n = dict.fromkeys(sides, 0)
        for (x, s, w), following in zip(cuts, cuts[1:]):
            n[s] += w
            if inside({t: v > 0 for t, v in n.items()}):
                total += following[0] - x
    return total * (high - low) / lines


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(21)
    rows = []
    for k in range(8):
        for s in "abc":
            rows += [(k, s, star(rng, rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(1, 4), rng.randint(3, 14), rng.random() < 0.5)) for _ in range(rng.randint(1, 3))]
    rows += [(9, "a", star(rng, rng.uniform(0, 60), rng.uniform(0, 60), 3, 9)) for _ in range(60)] + [(9, "b", star(rng, 30, 30, 25, 40, True))]
    return rows


CASES = [
    ("in_a or in_b", lambda n: n["a"] or n["b"]), ("in_a and in_b", lambda n: n["a"] and n["b"]), ("in_a and not in_b", lambda n: n["a"] and not n["b"]),
    ("in_a != in_b and not in_c", lambda n: n["a"] != n["b"] and not n.get("c")),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_algebra_of_any_polygons(spark, shapes, case):
    table = spark.createDataFrame(shapes, f"k int, s string, rings {RINGS}")
    inside, plain = CASES[case]
    edges = overlay.edges(table, ["k"], F.col("s"), F.col("rings"))
    got = {r["k"]: r["area"] for r in overlay.areas(overlay.overlay(edges, ["k"], ["a", "b", "c"], F.expr(inside)), ["k"]).collect()}
    for k in {r[0] for r in shapes}:
        want = scanned([(s, rings) for i, s, rings in shapes if i == k], plain)
        assert got.get(k, 0) == pytest.approx(want, rel=2e-3, abs=1e-2), k


@pytest.mark.parametrize("case", range(len(CASES)))
def test_keys_with_few_edges_are_swept_as_joins_would_have_them(spark, shapes, case):
    table = spark.createDataFrame([*shapes, (None, "a", star(random.Random(3), 0, 0, 2, 5))], f"k int, s string, rings {RINGS}")
    inside, edges = F.expr(CASES[case][0]), overlay.edges(table, ["k"], F.col("s"), F.col("rings")).where("k < 9 or k is null")
    swept = overlay.overlay(edges, ["k"], ["a", "b", "c"], inside)
    plan = swept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Join" not in plan  # every edge moves once
    area = lambda found: {r["k"]: r["area"] for r in overlay.areas(found, ["k"]).collect()}
    got = area(swept)
    assert len(got) > 3 and got == pytest.approx(area(overlay.joined(edges, ["k"], ["a", "b", "c"], inside)), abs=1e-6)


def test_results_are_regions_again(spark, shapes):
    table = spark.createDataFrame(shapes, f"k int, s string, rings {RINGS}")
    edges = overlay.edges(table, ["k"], F.col("s"), F.col("rings"))
    both = overlay.overlay(edges, ["k"], ["a", "b"], F.col("in_a") & F.col("in_b"))
    again = overlay.edges_of(both, ["k"], "ab").unionByName(edges.where("side = 'c'"))
    steps = overlay.areas(overlay.overlay(again, ["k"], ["ab", "c"], F.col("in_ab") & ~F.col("in_c")), ["k"], "a1")
    whole = overlay.areas(overlay.overlay(edges, ["k"], ["a", "b", "c"], F.col("in_a") & F.col("in_b") & ~F.col("in_c")), ["k"], "a2")
    rows = steps.join(whole, "k", "full").collect()
    assert rows and all(r["a1"] == pytest.approx(r["a2"], rel=1e-6, abs=1e-6) for r in rows)


def box(x0, y0, x1, y1):
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]


def test_touching_empty_and_null(spark):
    rows = [
        (1, "a", box(0.0, 0.0, 1.0, 1.0)), (1, "b", box(1.0, 0.0, 2.0, 1.0)), (1, "b", box(0.0, 1.0, 1.0, 2.0)),
        (2, "a", box(0.0, 0.0, 2.0, 2.0)), (2, "a", box(0.0, 0.0, 2.0, 2.0)), (2, "b", box(0.0, 0.0, 2.0, 2.0)),
        (None, "a", box(0.0, 0.0, 3.0, 3.0)), (3, "a", None), (4, "a", [[(0.0, 0.0), (5.0, 5.0)]]), (5, "b", box(0.0, 0.0, 1.0, 1.0)),
    ]
    table = spark.createDataFrame(rows, f"k int, s string, rings {RINGS}")
    edges = overlay.edges(table, ["k"], F.col("s"), F.col("rings"))
    found = lambda inside: {r["k"]: round(r["area"], 9) for r in overlay.areas(overlay.overlay(edges, ["k"], ["a", "b"], inside), ["k"]).collect()}
    assert found(F.col("in_a") & F.col("in_b")) == {2: 4}
    assert found(F.col("in_a") | F.col("in_b")) == {1: 3, 2: 4, None: 9, 5: 1}
    assert found(F.col("in_a") & ~F.col("in_b")) == {1: 1, None: 9}
    assert overlay.overlay(edges.limit(0), ["k"], ["a"], F.col("in_a")).count() == 0


def test_insets_and_buffers(spark):
    ell = [[(0.0, 0.0), (10.0, 0.0), (10.0, 4.0), (4.0, 4.0), (4.0, 10.0), (0.0, 10.0)]]
    turn = lambda rings, a: [[(x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a)) for x, y in r] for r in rings]
    rows, want = [], {}

    def add(rings, d, area):
        for a in (0.0, 0.4, 2.0):
            rows.append((len(rows), turn(rings, a), d))
            want[len(rows) - 1] = area

    add(ell, 1.0, 8 * 8 - 6 * 6)  # mitred at the inner corner
    add(ell, 2.5, 0)
    add([ell[0][::-1]], -1.0, 12 * 12 - 6 * 6)  # a buffer
    add(box(0.0, 0.0, 10.0, 8.0) + box(4.0, 3.0, 6.0, 5.0), 1.0, 8 * 6 - 4 * 4)  # a hole grows
    add(box(0.0, 0.0, 10.0, 8.0) + box(4.0, 3.0, 6.0, 5.0), 1.5, 7 * 5 - 5 * 5)  # and cuts the shape in two
    add([[(0.0, 0.0), (20.0, 0.0), (20.0, 10.0), (12.0, 10.0), (12.0, 1.5), (8.0, 1.5), (8.0, 10.0), (0.0, 10.0)]], 1.0, 2 * 6 * 8)  # the bridge vanishes
    add([[(0.0, 0.0), (10.0, 0.0), (10.0, 8.0), (0.0, 8.0), (0.0, 0.0)]], 0.0, 80)
    add([[(0.0, 0.0), (6.0, 0.0), (0.0, 8.0)]], 1.0, 24 * (1 - 1 / 2.0) ** 2)  # a triangle of inradius 2
    table = spark.createDataFrame(rows, f"k int, rings {RINGS}, d double")
    got = {r["k"]: r["area"] for r in overlay.areas(overlay.inset(table.where("d >= 0"), ["k"], "rings", F.col("d")), ["k"]).collect()}
    wide = overlay.with_border(table.where("d < 0"), ["k"], "shape", "rings", F.col("d"), "rim")
    got |= {r["k"]: r["area"] for r in overlay.areas(overlay.overlay(wide, ["k"], ["shape", "rim"], F.col("in_shape") | F.col("in_rim")), ["k"]).collect()}
    assert {k: round(got.get(k, 0), 6) for k in want} == {k: pytest.approx(v, abs=1e-5) for k, v in want.items()}


def test_interior_points(spark):
    horse = [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (6.0, 9.0), (6.0, 2.0), (3.0, 2.0), (3.0, 9.0), (0.0, 9.0)]]
    ring = box(0.0, 0.0, 9.0, 9.0) + box(1.0, 1.0, 8.0, 8.0)
    got = {r["k"]: (r["x"], r["y"]) for r in overlay.interior_points(spark.createDataFrame([(1, horse), (2, ring), (3, None)], f"k int, rings {RINGS}"), ["k"], "rings").collect()}
    assert got == {1: (4.5, 1.0), 2: (4.5, 0.5)}


def test_large_keys_are_cut_into_bands(spark, monkeypatch, shapes):
    monkeypatch.setattr(overlay, "BAND_EDGES", 10)
    monkeypatch.setattr(overlay, "CELL_EDGES", 4)
    table = spark.createDataFrame([r for r in shapes if r[0] in (1, 9)], f"k int, s string, rings {RINGS}")
    edges = overlay.edges(table, ["k"], F.col("s"), F.col("rings"))
    got = {r["k"]: r["area"] for r in overlay.areas(overlay.overlay(edges, ["k"], ["a", "b"], F.col("in_a") & ~F.col("in_b")), ["k"]).collect()}
    for k in got:
        assert got[k] == pytest.approx(scanned([(s, rings) for i, s, rings in shapes if i == k], lambda n: n["a"] and not n["b"]), rel=2e-3, abs=1e-2)
    assert len(got) == 2


@pytest.mark.parametrize("case", range(len(CASES)))
def test_tiles_have_the_same_areas(spark, monkeypatch, shapes, case):
    monkeypatch.setattr(overlay, "SMALL", 0)
    monkeypatch.setattr(overlay, "TILE_EDGES", 6)
    monkeypatch.setattr(overlay, "TILE_SMALL", 20)
    level = [(11, s, box(float(i), i % 3.0, i + 2.0 + i % 2, i % 3 + 2.0)) for i in range(6) for s in "ab"] + [(None, "a", box(0.0, 0.0, 900.0, 0.5)), (None, "b", box(3.0, -2.0, 4.0, 700.0))]
    table = spark.createDataFrame([*shapes, *level], f"k int, s string, rings {RINGS}")
    inside, edges = F.expr(CASES[case][0]), overlay.edges(table, ["k"], F.col("s"), F.col("rings"))
    area = lambda found: {r["k"]: r["area"] for r in overlay.areas(found, ["k"]).collect()}
    got = area(overlay.overlay(edges, ["k"], ["a", "b", "c"], inside, tiles=True))
    assert len(got) > 3 and got == pytest.approx(area(overlay.swept(edges, ["k"], ["a", "b", "c"], inside)), abs=1e-6)


def test_tiles_that_are_covered_are_not_cut(spark):
    """Where shapes lie dense, their number doubles the trapezoids at most: slabs grow with the square of it."""
    def dissolved(n):
        shapes = [(1, "a", box(i * 37 % 53.0, i * 91 % 47.0, i * 37 % 53 + i % 13 + 2.0, i * 91 % 47 + i % 7 + 2.0)) for i in range(n)]
        covered = {(x, y) for _, _, [[(x0, y0), _, (x1, y1), _]] in shapes for x in range(int(x0), int(x1)) for y in range(int(y0), int(y1))}
        found = overlay.overlay(overlay.edges(spark.createDataFrame(shapes, f"k int, s string, rings {RINGS}"), ["k"], F.col("s"), F.col("rings")), ["k"], ["a"], F.col("in_a"), tiles=True).cache()
        assert overlay.areas(found, ["k"]).first()["area"] == pytest.approx(len(covered), abs=1e-6)
        return found.count()

    assert dissolved(4000) < 2 * dissolved(2000)
