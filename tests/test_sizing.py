"""Packing and sizing against hand counts, closed forms and a plain check of every module."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helioframe.functions import solar
from helioframe.operators import overlay, packing
from helioframe.plans import sizing

FT = solar.FT
RINGS = "array<array<struct<x: double, y: double>>>"
BUILDINGS = f"bid string, rings {RINGS}, occupancy string, lat double, parapet_m double, mapped boolean"
PLANES = f"bid string, plane long, rings {RINGS}, pitch double, azimuth double"
OBSTRUCTIONS = f"bid string, rings {RINGS}, kind string, height_m double"


def box(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def feet(w, d):
    return [box(-w / 2 * FT, -d / 2 * FT, w / 2 * FT, d / 2 * FT)]


def turned(rings, degrees):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [[(x * c - y * s, x * s + y * c) for x, y in r] for r in rings]


def sized(spark, buildings, planes=(), obstructions=(), **design):
    rows = [(b, rings, occ, 34.05, 0.0, mapped) for b, rings, occ, mapped in buildings]
    found = sizing.estimate(spark.createDataFrame(rows, BUILDINGS), spark.createDataFrame(list(planes), PLANES), spark.createDataFrame(list(obstructions), OBSTRUCTIONS), sizing.Design(**design))
    return {r["bid"]: r for r in found.collect()}


def test_flush_roofs(spark):
    ell = [[(0.0, 0.0), (60.0, 0.0), (60.0, 20.0), (20.0, 20.0), (20.0, 50.0), (0.0, 50.0)]]
    hatch = ("hatched", [box(9.0, -1.0, 11.0, 1.0)], "hatch", 0.0)
    got = sized(
        spark, [("a", feet(200, 100), "commercial", False), ("turned", turned(feet(200, 100), 27), "commercial", False), ("hatched", feet(200, 100), "commercial", True), ("big", feet(400, 300), "commercial", True), ("ell", turned(ell, 10), "commercial", True), ("tiny", [box(0, 0, 5.0, 5.0)], "commercial", True), ("none", None, "commercial", True)],
        obstructions=[hatch], racking="flush",
    )
    # 192 x 92 ft in two sections of 94 ft: 24 rows of 2 x 12
    assert got["a"]["module_count"] == got["turned"]["module_count"] == 576 and got["a"]["dc_kw"] == pytest.approx(576 * 0.55)
    assert got["a"]["perimeter_m"] == pytest.approx(4 * FT) and got["big"]["perimeter_m"] == pytest.approx(6 * FT)
    assert got["a"]["usable_m2"] == pytest.approx(192 * 92 * FT * FT) and got["a"]["roof_type"] == "flat"
    assert got["a"]["flags"] == ["no_roof_planes_assumed_flat", "obstructions_not_mapped_upper_bound"]
    assert got["hatched"]["module_count"] <= 576 - 7 and got["hatched"]["flags"] == ["no_roof_planes_assumed_flat"]
    assert got["hatched"]["usable_m2"] == pytest.approx(192 * 92 * FT * FT - (2 + 8 * FT) ** 2)
    e = 4 * FT
    assert got["ell"]["usable_m2"] == pytest.approx((60 - 2 * e) * (50 - 2 * e) - 40 * 30)
    assert got["tiny"]["module_count"] == 0 and got["none"]["module_count"] == 0
    assert got["tiny"]["flags"][-1] == "under_6_modules_not_designed" or got["tiny"]["usable_m2"] < 12


def test_tilted_racking(spark):
    roof = [("a", feet(240, 140), "commercial", True)]
    crossed, south = sized(spark, roof)["a"], sized(spark, roof, racking="south_tilt")["a"]
    assert 0.80 < crossed["module_count"] * 2.278 * 1.134 / crossed["usable_m2"] <= 0.90
    assert 0 < south["module_count"] < crossed["module_count"]


def test_pitched_planes(spark):
    ring = [box(-10.0, -5.0, 10.0, 5.0)]
    planes = [("r2", 0, ring, 30.0, 180.0), ("east", 0, turned(ring, 90), 30.0, 90.0), ("mixed", 0, ring, 30.0, 180.0), ("mixed", 1, [box(-10.0, 5.0, 10.0, 25.0)], 2.0, 0.0)]
    house = [("r2", ring, "R-2", True), ("east", turned(ring, 90), "R-2", True), ("mixed", [box(-10.0, -5.0, 10.0, 25.0)], "commercial", True)]
    got = sized(spark, house, planes)
    along, slope = 20 - 2 * 0.9144, (10 - 2 * 0.9144) / math.cos(math.radians(30))
    fits = lambda a, b: math.floor((along + 0.02) / (a + 0.02)) * math.floor((slope + 0.02) / (b + 0.02))
    assert got["r2"]["module_count"] == got["east"]["module_count"] == max(fits(1.134, 2.278), fits(2.278, 1.134))
    assert got["r2"]["roof_type"] == "pitched" and got["r2"]["flags"] == ["pitched_setbacks_approximated"] and got["mixed"]["roof_type"] == "mixed"
    strict = sized(spark, house[:1], planes[:1], residential_for_pitched=False)["r2"]
    assert strict["flags"] == [] and strict["usable_m2"] == pytest.approx((20 - 8 * FT) * (10 - 8 * FT))


def test_shade_of_obstructions(spark):
    roof, tank = [("a", [box(0.0, 0.0, 60.0, 40.0)], "commercial", True)], [("a", [box(20.0, 10.0, 22.0, 12.0)], "other", 3.0)]
    plain, shaded = sized(spark, roof, (), tank)["a"], sized(spark, roof, (), tank, shade_ratio=2.0)["a"]
    assert plain["usable_m2"] - shaded["usable_m2"] == pytest.approx(6 * (2 + 2 * FT))


def region(spark, rings):
    edges = overlay.edges(spark.createDataFrame([(1, rings)], f"k int, rings {RINGS}"), ["k"], F.lit("a"), F.col("rings"))
    return overlay.overlay(edges, ["k"], ["a"], F.col("in_a"))


def layout(spark, rings, along, depth, pitch, gap, most=None, aisle=None):
    spec = spark.createDataFrame([(1, along, depth, pitch, gap, most, aisle)], "k int, along double, depth double, pitch double, gap double, most double, aisle double")
    runs = packing.packed(region(spark, rings), ["k"], spec)
    best = packing.best_runs(runs, ["k"], [])
    return [(r["x"], r["y"]) for r in packing.modules(runs, best, ["k"], [], F.lit(along), F.lit(gap)).collect()]


def test_rows_of_odd_regions(spark):
    assert len(layout(spark, [[(0.0, 0.0), (10.0, 0.0), (10.0, 5.0), (5.0, 5.0), (5.0, 10.0), (0.0, 10.0)]], 2.0, 1.0, 1.0, 0.0)) == 35
    assert len(layout(spark, [box(0.0, 0.0, 10.0, 10.0), box(4.0, 4.0, 6.0, 6.0)], 1.0, 1.0, 1.0, 0.0)) == 96
    cut = layout(spark, [box(0.0, 0.0, 388 * FT, 100 * FT)], 2.0, 1.0, 1.0, 0.0, 150 * FT, 4 * FT)
    section = (388 - 8) / 3 * FT
    assert all((x + 1e-6) % (section + 4 * FT) + 2.0 <= section + 1e-5 for x, _ in cut) and len(cut) == 3 * int(section / 2) * int(100 * FT)


def inside(rings, x, y):
    n = 0
    for r in rings:
        for (a, b), (c, d) in zip(r, r[1:] + r[:1]):
            n += (b > y) != (d > y) and a + (c - a) * (y - b) / (d - b) > x
    return n % 2 == 1


def test_modules_lie_inside(spark):
    rng = random.Random(31)
    ring = [((14 + rng.uniform(-6, 6)) * math.cos(i / 11 * 2 * math.pi), (12 + rng.uniform(-6, 6)) * math.sin(i / 11 * 2 * math.pi)) for i in range(11)]
    rings = [ring, box(-2.0, -1.5, 1.0, 2.5)]
    found = layout(spark, rings, 1.1, 0.7, 0.8, 0.02)
    assert len(found) > 100
    for x, y in found:
        for i in range(12):
            u, v = x + 1e-6 + (1.1 - 2e-6) * i / 11, y + 1e-6 + (0.7 - 2e-6) * i / 11
            assert inside(rings, u, y + 1e-6) and inside(rings, u, y + 0.7 - 1e-6) and inside(rings, x + 1e-6, v) and inside(rings, x + 1.1 - 1e-6, v)
    assert len(set(found)) == len(found)


def test_nothing_to_pack(spark):
    assert layout(spark, [box(0.0, 0.0, 1.0, 0.5)], 2.0, 1.0, 1.0, 0.0) == []
    assert layout(spark, None, 2.0, 1.0, 1.0, 0.0) == []


def test_small_regions_are_packed_as_joins_would_have_them(spark):
    rng = random.Random(5)
    rows = [(k, [[(rng.uniform(3, 15) * math.cos(i / 9 * 2 * math.pi), rng.uniform(3, 12) * math.sin(i / 9 * 2 * math.pi)) for i in range(9)]]) for k in range(6)]
    rows += [(6, [box(0.0, 0.0, 30.0, 9.0), box(4.0, 4.0, 6.0, 6.0)]), (None, [box(0.0, 0.0, 20.0, 20.0)]), (7, [box(0.0, 0.0, 0.4, 0.4)])]
    edges = overlay.edges(spark.createDataFrame(rows, f"k int, rings {RINGS}"), ["k"], F.lit("a"), F.col("rings"))
    regions = overlay.overlay(edges, ["k"], ["a"], F.col("in_a"))
    kinds = [(0, 1.1, 0.7, 0.8, 0.02, None, None), (1, 0.7, 1.1, 1.1, 0.0, 8.0, 1.0)]
    spec = spark.createDataFrame([(k, *s) for k, _ in rows for s in kinds], "k int, o int, along double, depth double, pitch double, gap double, most double, aisle double")
    runs = packing.packed(regions, ["k"], spec)
    moved = packing.joined(regions, ["k"], spec, 8)
    plain = lambda df: sorted([(-1 if r["k"] is None else r["k"], r["o"], r["phase"], round(r["y"], 6), round(r["x"], 6), r["n"]) for r in df.collect()])
    got = plain(runs)
    assert len(got) > 300 and got == plain(moved)
    best = lambda df: {(r["k"], r["o"], r["phase"], r["modules"]) for r in df.collect()}
    layouts = packing.best_layouts(regions, ["k"], spec, ["k"], ["o"])
    assert len(best(layouts)) == 8 and best(layouts) == best(packing.best_runs(moved, ["k"], ["o"]))
    plan = layouts._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan.split("MapInArrow")[0]  # no row of modules is a row of a table


def test_large_regions_are_packed_by_joins(spark, monkeypatch):
    monkeypatch.setattr(packing, "SMALL", 0)
    assert len(layout(spark, [box(0.0, 0.0, 10.0, 10.0), box(4.0, 4.0, 6.0, 6.0)], 1.0, 1.0, 1.0, 0.0)) == 96
