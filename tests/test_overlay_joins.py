"""Joins of shapes by their common area and by interior points."""

import pytest

from helioframe.operators import spatial

RINGS = "array<array<struct<x: double, y: double>>>"


def box(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def shapes(spark, rows):
    return spark.createDataFrame(rows, f"k int, rings {RINGS}")


def test_area_fractions(spark):
    panels = shapes(spark, [(1, [box(-1, -1, 1, 1)]), (2, [box(9, 9, 11, 11)]), (3, [box(40, 0, 41, 1)]), (4, None), (5, [box(0, 0, 0, 0)]), (6, [box(4, 4, 6, 6)])])
    # zones that overlap count once; cell edges (0, 10, 20) run through panels and zones; zone 4 has a hole
    zones = shapes(spark, [(1, [box(0, -5, 10, 10)]), (2, [box(0, 0, 20, 20)]), (3, [box(9, 9, 10, 11)]), (4, [box(-2, -2, 0, 0), box(-1, -1, -0.5, -0.5)]), (5, None)]).withColumnsRenamed({"k": "z"})
    got = {r["k"]: r["fraction"] for r in spatial.area_fractions(panels, "k", "rings", zones, "z", "rings", 10.0).collect()}
    assert got == {1: pytest.approx((2 + 1 - 0.25) / 4), 2: pytest.approx(1.0), 3: 0.0, 4: None, 5: None, 6: pytest.approx(1.0)}


def test_buildings_of_a_parcel(spark):
    ell = [[(0.0, 0.0), (30.0, 0.0), (30.0, 10.0), (10.0, 10.0), (10.0, 30.0), (0.0, 30.0)]]
    parcels = spark.createDataFrame([("a", ell), ("b", [box(100, 100, 120, 120)]), ("c", [box(0, 0, 30, 30)])], f"p string, rings {RINGS}")
    buildings = shapes(spark, [(1, [box(1, 1, 9, 9)]), (2, [box(5, 5, 15, 15)]), (3, [box(12, 12, 28, 28)]), (4, [box(25, 2, 35, 8)]), (5, [box(2, 12, 8, 25)]), (6, None)])
    got = [(r["p"], r["k"], round(r["m2"], 6), round(r["share"], 6), r["rank"]) for r in spatial.mostly_inside(parcels, "p", "rings", buildings, "k", "rings", 10.0).orderBy("p", "rank").collect()]
    assert got == [("a", 2, 100, 0.75, 1), ("a", 5, 78, 1, 2), ("a", 1, 64, 1, 3), ("a", 4, 60, 0.5, 4), ("c", 3, 256, 1, 1), ("c", 2, 100, 1, 2), ("c", 5, 78, 1, 3), ("c", 1, 64, 1, 4), ("c", 4, 60, 0.5, 5)]


def test_first_roof_of_a_shape(spark):
    horse = [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (6.0, 9.0), (6.0, 2.0), (3.0, 2.0), (3.0, 9.0), (0.0, 9.0)]]
    extras = shapes(spark, [(1, horse), (2, [box(20, 20, 22, 22)]), (3, [box(50, 50, 51, 51)]), (4, [box(1, 1, 2, 2)])])
    roofs = spark.createDataFrame([("late", 2, [box(-1, -1, 10, 10)]), ("first", 1, [box(0, 0, 9, 3), box(1, 0.5, 2, 2.5)]), ("other", 3, [box(15, 15, 30, 30)])], f"roof string, n int, rings {RINGS}")
    owned = spatial.first_containing(extras, "k", "rings", roofs, "roof", "rings", "n", 10.0)
    assert {r["k"]: r["roof"] for r in owned.collect()} == {1: "first", 2: "other", 3: None, 4: "late"}  # the hole of the first roof is not inside
    with pytest.raises(ValueError, match="3"):
        spatial.unowned(owned, "k", "roof")
    spatial.unowned(owned.where("k <> 3"), "k", "roof")


def test_geodesics(spark):
    from pyspark.sql import functions as F

    from helioframe.functions import geometry

    at = lambda lon, lat, lon0, lat0: geometry.geodesic_xy(*map(F.lit, (lon, lat, lon0, lat0)))
    r = spark.range(1).select(at(1.0, 0.0, 0.0, 0.0).alias("equator"), at(7.0, 46.0, 7.0, 45.0).alias("meridian"), at(7.0, 45.0, 7.0, 45.0).alias("same"), at(-118.24, 34.06, -118.25, 34.05).alias("near"), geometry.local_xy(*map(F.lit, (-118.24, 34.06, -118.25, 34.05))).alias("plain")).first()
    # known lengths: a degree of the equator, and of a meridian from 45 to 46 degrees
    assert r["equator"]["x"] == pytest.approx(111319.4908, abs=1e-3) and abs(r["equator"]["y"]) < 1e-6
    assert r["meridian"]["y"] == pytest.approx(111141.548, abs=0.01) and (r["same"]["x"], r["same"]["y"]) == (0, 0)
    assert r["near"]["x"] == pytest.approx(r["plain"]["x"], abs=1e-3) and r["near"]["y"] == pytest.approx(r["plain"]["y"], abs=1e-3)
