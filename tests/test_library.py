import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from helioframe.functions import geometry, solar, text
from helioframe.operators import addresses, calibration, ordered, packing, quantiles, rollup, spatial, stateful
from helioframe.plans import review, sites
from helioframe.sources import readers, writers
from helioframe.streaming import lookups

FT = solar.FT


def values(spark, *columns):
    return spark.range(1).select(*columns).first()


def rectangle(x0, y0, x1, y1):
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], dtype=float)


def column_ring(points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def test_principal_axes_and_ring_measures(spark):
    turn = math.radians(30)
    ring = rectangle(0, 0, 40, 15) @ np.array([[math.cos(turn), math.sin(turn)], [-math.sin(turn), math.cos(turn)]])
    r = column_ring(ring)
    got = values(spark, packing.axes(r).alias("a"), geometry.area(r).alias("area"), geometry.perimeter(r).alias("p"), geometry.distance(column_ring(rectangle(0, 0, 60, 40)), F.lit(30.0), F.lit(-12.0)).alias("d"))
    assert (got["a"]["short"], got["a"]["long"], got["a"]["angle"]) == pytest.approx((15, 40, 30))
    assert got["area"] == pytest.approx(600) and got["p"] == pytest.approx(110) and got["d"] == pytest.approx(12)


def test_solar_expressions(spark):
    got = values(spark, solar.winter_profile_angle(F.lit(34.05)).alias("a"), solar.winter_profile_angle(F.lit(80.0)).alias("dark"), solar.perimeter_m(F.lit(300 * FT)).alias("p"), solar.clearance_m(F.lit("chimney")).alias("c"), solar.poleward(F.lit(350.0), F.lit(40.0)).alias("north"), solar.module_density(F.lit(395.0)).alias("m"), solar.south_row_pitch(F.lit(1.134), F.lit(10.0), F.lit(34.05)).alias("pitch"))
    assert 26 < got["a"] < 34 and got["dark"] is None and got["p"] == pytest.approx(6 * FT) and got["c"] == pytest.approx(FT) and got["north"] and got["m"] == 205.0 and got["pitch"] > 1.134
    cuts = values(spark, geometry.sections(F.lit(388 * FT), 150 * FT, 4 * FT).alias("n"))["n"]
    assert cuts == 3


@pytest.mark.parametrize("said, kw", [("250 kW DC rooftop", 250), ("solar 249,9 KW", 249.9), ("1.2 MW plant", 1200), ("7.6 kW inverter, 99.75-kW DC", 99.75), ("reroof", None)])
def test_kw_from_text(spark, said, kw):
    assert values(spark, text.kw_from_text(F.lit(said)).alias("kw"))["kw"] == kw


def test_text_rules(spark):
    score = lambda q, c: text.street_score(text.street_tokens(F.lit(q)), text.street_tokens(F.lit(c)))
    got = values(
        spark, score("North Main Street", "N MAIN ST").alias("same"), score("N Main St", "MAIN ST").alias("part"), score("Main St", "OAK ST").alias("none"), text.parse_address(F.lit("12b-14 Oak Ave Apt 3, LA, CA 90001-1234, USA")).alias("a"), text.parse_address(F.lit("Oak Ave")).alias("no"),
        text.owner_name(F.lit("The Oak Park, L.L.C.")).alias("o"), text.plane_from_name(F.lit("Plane 6/12 SW")).alias("p"), text.obstruction_kind(F.lit("Smoke vent 2")).alias("k"), text.redact(F.lit("u?api_key=s3&x=1 TOKEN=y")).alias("r"), text.existing_solar_check(F.lit("1 A St, X, CA 90001"), F.lit(2021), F.lit(False)).alias("e"), text.new_roof_install(F.lit("PV carport")).alias("c"),
    )
    assert (got["same"], got["none"]) == (1.0, 0.0) and got["part"] == pytest.approx(2 / 3)
    assert tuple(got["a"]) == ("12B", "Oak Ave", "90001") and got["no"] is None and got["o"] == "OAK PARK" and got["k"] == "smoke_vent"
    assert got["p"]["pitch_deg"] == pytest.approx(26.565, abs=1e-3) and got["p"]["azimuth_deg"] == 225.0
    assert got["r"] == "u?api_key=***&x=1 TOKEN=***" and got["e"] == "built_2021" and got["c"] is False


def test_interpolation(spark):
    points = spark.createDataFrame([("MAIN", 100.0, -118.0, 1), ("MAIN", 140.0, -118.004, 2), ("MAIN", 140.0, 0.0, 3), ("MAIN", 900.0, 1.0, 4)], "street string, number double, lon double, o int")
    asked = spark.createDataFrame([("MAIN", 120.0), ("MAIN", 140.0), ("MAIN", 500.0), ("OAK", 1.0)], "street string, number double")
    got = {(r["street"], r["number"]): r["interpolated"] for r in ordered.as_of_pair(asked, points, ["street"], "number", "lon", "o", 200.0).collect()}
    assert got[("MAIN", 120.0)] == pytest.approx(-118.002) and got[("MAIN", 140.0)] == -118.004 and got[("MAIN", 500.0)] is None and got[("OAK", 1.0)] is None


def test_order_statistics(spark):
    df = spark.range(1000).select((F.pmod(F.xxhash64("id"), F.lit(400)) / 7).alias("v"))
    xs = sorted(r["v"] for r in df.collect())
    assert quantiles.order_statistics(df, "v", [0, 17, 500, 999]) == [xs[0], xs[17], xs[500], xs[999]]
    assert quantiles.median(df, "v") == (xs[499] + xs[500]) / 2 and quantiles.median(df.limit(0), "v") is None


def test_ranks_of_large_groups_by_bucket_counts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("wide", float(x)) for x in np.exp(rng.normal(0, 9, 900))] + [("ties", float(x)) for x in rng.integers(0, 3, 901)] + [(None, float(x)) for x in rng.normal(size=40)]
    rows += [("odd", x) for x in (math.inf, -math.inf, math.nan, 1.0, 2.0, -3.0, 2.0)] + [("ties", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    ranks = quantiles.median_ranks("m") | {"p90": quantiles.p90_round_rank()}
    expected = {}
    for g in ("wide", "ties", None, "odd"):
        xs = sorted((x for k, x in rows if k == g and x is not None), key=lambda x: (math.isnan(x), x))
        expected[g] = (xs[(len(xs) - 1) // 2], xs[len(xs) // 2], xs[round(0.9 * (len(xs) - 1))])
    for per_doubling, cells in ((64, 4096), (1, 2)):
        monkeypatch.setattr(quantiles, "PER_DOUBLING", per_doubling)
        monkeypatch.setattr(quantiles, "CELLS", cells)
        assert {r["g"]: tuple(r)[1:] for r in quantiles.ranks_by(df, ["g"], "v", ranks).collect()} == expected
    assert quantiles.ranks_by(df.limit(0), ["g"], "v", ranks).collect() == []


def test_covering_points_without_gathering_a_group(spark):
    rng = np.random.default_rng(5)
    rows = [(g, int(k), float(a), float(b)) for g, n in ((1, 60), (2, 5), (None, 12), (4, 1)) for k, (a, b) in enumerate(rng.integers(0, 12, (n, 2)))]
    expected = set()
    for g in {r[0] for r in rows}:
        of = sorted(r for r in rows if r[0] == g) if g else [r for r in rows if r[0] is None]
        picked = [of[0]]
        while len(picked) < 4:
            d = [min(math.hypot(r[2] - p[2], r[3] - p[3]) for p in picked) for r in of]
            if max(d) <= 3.0:
                break
            picked.append(of[d.index(max(d))])
        expected |= {(*p, k) for k, p in enumerate(picked, 1)}
    got = stateful.covering_points(spark.createDataFrame(rows, "g int, ord long, x double, y double").repartition(3), "g", "x", "y", 3.0, 4)
    assert {tuple(r) for r in got.collect()} == expected
    assert "InPandas" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["a1_accuracy", "a3_cross_validation", "a22_parameter_sweep"])
def test_no_aggregate_buffers_the_values_of_a_report_group(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    gathered = [line for line in plan.splitlines() if "median(" in line or "percentile(" in line]
    assert [line for line in gathered if "segment" not in line.split("]")[0]] == []



def test_calibration_recovers_a_bias(spark):
    rows = spark.range(200).select("id", F.lit("a").alias("key"), (F.col("id") + 10.0).alias("known"), ((F.col("id") + 10.0) * 1.25).alias("pred"))
    factors, overall = calibration.fit(rows, "pred", "known", "key")
    assert factors.first()["factor"] == pytest.approx(0.8) and overall == pytest.approx(0.8)
    cv = calibration.cross_validate(rows, "pred", "known", "key", "id")
    assert cv.count() == 200 and cv.where("abs(calibrated - known) > 1e-6").count() == 0


def test_spatial_edges(spark):
    boxes = spark.createDataFrame([("w", 0.0, 0.0, 60.0, 40.0), ("a", 200.0, 0.0, 240.0, 15.0)], "bid string, xmin double, ymin double, xmax double, ymax double")
    points = spark.createDataFrame([(1, 30.0, -12.0), (2, 30.0, -80.0), (3, 220.0, 7.0)], "pid int, px double, py double")
    got = {r["pid"]: (r["bid"], r["d"]) for r in spatial.points_near_boxes(points, boxes, 40.0).collect()}
    assert got == {1: ("w", 12.0), 3: ("a", 0.0)}


def test_addresses(spark):
    q = spark.createDataFrame([(1, 100, 141), (2, 7, 5), (3, 1, 900)], "q int, low int, high int")
    assert {r["q"]: r["n"] for r in addresses.expanded_ranges(q, "low", "high").groupBy("q").agg(F.count("*").alias("n")).collect()} == {1: 42, 2: 1, 3: 1}


def test_size_sites(spark):
    ring = lambda *b: [{"x": float(x), "y": float(y)} for x, y in rectangle(*b)]
    footprints = spark.createDataFrame([("w", ring(0, 0, 200 * FT, 100 * FT), "warehouse"), ("g", ring(300, 0, 305, 30), "garage")], "bid string, ring array<struct<x:double,y:double>>, class string")
    points = spark.createDataFrame([("s1", 1, 10.0, 10.0, 10), ("s2", 2, 10.0, -30.0, None), ("s3", 3, 900.0, 900.0, 5)], "site_id string, ord int, px double, py double, units int")
    got = {r["site_id"]: r for r in sites.size_sites(points, footprints).collect()}
    assert got["s1"]["module_count"] > 400 and got["s1"]["bid"] == "w"
    assert got["s2"]["reasons"][:2] == ["address_point_30m_from_building_check_match", "same_building_as_site_s1"]
    assert got["s3"]["reasons"] == ["no_building_within_40m"] and got["s3"]["dc_kw"] == 0


def test_review_rules(spark):
    got = values(spark, review.building_reasons(F.lit(100.0), F.lit(50.0), F.array(), F.lit(False), F.lit(0.5)).alias("b"), review.best_estimate(F.lit(10.0), F.lit(5000), F.lit(100.0)).alias("u"), review.storeys(F.lit(8.25)).alias("s"), review.storeys(F.lit(None).cast("double")).alias("s0"), review.pin_quality(F.lit(1), F.lit(False), F.lit(20.0)).alias("q"), review.demoted(F.array(F.lit("google_imagery_x"), F.lit("y")), ["google_imagery_"]).alias("d"))
    assert got["b"] == ["methods_disagree_ratio_0.50", "uncalibrated", "no_usable_roof_area"]
    assert tuple(got["u"]) == (8500.0, "units") and got["s"] == 2.0 and got["s0"] == 2.0 and got["q"] == 2 and got["d"] == ["y"]


def test_site_csv(spark, tmp_path):
    (tmp_path / "sites.csv").write_text('﻿Name,Street Address,City,State,Zip,Lat,Lon,Type,# Units,Year_Built\nA,1 Main St,LA,CA,90001,34.0,"-118,0",Single-Family BTR,"1,200",built 2021\nA,"2 Main St, LA",LA,CA,90001,x,,office,,\n,,,,,,,,,\n,,,,,1,2,,,\n', encoding="utf-8")
    got = readers.read_sites(spark, str(tmp_path / "sites.csv")).orderBy("ordinal").collect()
    assert [r["id"] for r in got] == ["A", "A (2)", "site-4"]
    assert got[0]["address"] == "1 Main St, LA, CA 90001" and got[0]["units"] == 1200 and got[0]["year_built"] == 2021 and got[0]["occupancy"] == "R-3"
    assert got[1]["address"] == "2 Main St, LA, CA 90001" and got[1]["lat"] is None
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_sites(spark, str(tmp_path / "bad.csv"))


def test_geojson(spark, tmp_path):
    square = lambda n: [[[0, 0], [n, 0], [n, n], [0, n], [0, 0]]]
    features = [
        {"type": "Feature", "id": "b1", "geometry": {"type": "MultiPolygon", "coordinates": [square(1), square(3)]}, "properties": {}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square(2)}, "properties": {"role": "obstruction", "building_id": "b1", "kind": "hvac"}},
    ]
    (tmp_path / "x.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = readers.read_geojson(spark, str(tmp_path / "x.geojson")).orderBy("position").collect()
    assert got[0]["id"] == "b1" and max(p["x"] for p in got[0]["ring"]) == 3.0 and got[1]["role"] == "obstruction" and got[1]["properties"]["kind"] == "hvac"


def test_kml_there_and_back(spark, tmp_path):
    ring = "<Polygon><outerBoundaryIs><LinearRing><coordinates>0,0,0 1,0,0 1,1,0 0,0,0</coordinates></LinearRing></outerBoundaryIs></Polygon>"
    (tmp_path / "a.kml").write_text(f"<kml xmlns='http://www.opengis.net/kml/2.2'><Document><Folder><name>Townhomes</name><Placemark><name>Roof</name>{ring}</Placemark><Placemark><name>plane 20 S</name>{ring}</Placemark></Folder></Document></kml>")
    got = readers.kml_buildings(readers.read_kml(spark, str(tmp_path / "a.kml"))).orderBy("position").collect()
    assert [(r["role"], r["occupancy"]) for r in got] == [("footprint", "R-3"), ("roof_plane", "R-3")] and got[1]["azimuth_deg"] == 180.0
    shapes = readers.read_kml(spark, str(tmp_path / "a.kml")).select(F.concat(F.lit("S & T #"), F.col("position") + 1).alias("building"), "name", "ring", F.lit(2.0).alias("kw"), "position")
    folder = writers.kml_folders(shapes, "building", "name", "ring", "kw", "position").first()["value"]
    assert folder.startswith("<Folder><name>S &amp; T (4.0 kW)</name>") and folder.count("<Placemark>") == 2
    feature = json.loads(writers.layout_features(shapes.withColumn("method", F.lit("m")), "building", "method", "ring").first()["value"])
    assert feature["geometry"]["coordinates"][0][0] == [0.0, 0.0]


def test_calibration_files_and_truth(spark, tmp_path):
    factors = spark.createDataFrame([("a|b", 0.8, 7)], "key string, factor double, n long")
    writers.write_calibration(factors, 0.9, 30, 5, str(tmp_path / "c"))
    assert {r["key"]: (r["factor"], r["n"]) for r in readers.read_calibration(spark, str(tmp_path / "c")).collect()} == {"a|b": (0.8, 7), None: (0.9, 30)}
    (tmp_path / "t.csv").write_text("Site,Address,KW,Module W,Racking\nA,x,10,395,\nA,y,20,,raised\nB,z,,,\n")
    got = readers.read_truth(spark, str(tmp_path / "t.csv")).collect()
    assert len(got) == 1 and got[0]["address"] == "x" and got[0]["kind"] == "maxfit" and [(d["kw"], d["racking"]) for d in got[0]["designs"]] == [(10.0, "standard"), (20.0, "raised")]
    writers.write_csv(spark.createDataFrame([(1, None, ["a", "b"])], "i int, n string, r array<string>"), str(tmp_path / "out"))
    parts = [f.read_text().splitlines() for f in (tmp_path / "out").glob("part*.csv")]  # a part may hold the header alone
    assert all(lines[0] == "i,n,r" for lines in parts)
    assert [line for lines in parts for line in lines[1:]] in (['1,"",a;b'], ["1,,a;b"])


def test_parquet_scans_push_down(spark, tmp_path):
    rows = [("1", "MAIN ST", None, "90001", "US", (-118.0, -118.0, 34.0, 34.0)), ("2", "MAIN ST", "A", "90002", "US", (-119.0, -119.0, 35.0, 35.0))]
    df = spark.createDataFrame(rows, "number string, street string, unit string, postcode string, country string, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>")
    df.write.parquet(str(tmp_path / "p" / "2025-01-01"))
    path = str(tmp_path / "p" / readers.newest_release(spark, str(tmp_path / "p")))
    assert [r["lat"] for r in readers.addresses_of(spark, path, ["90001"]).collect()] == [34.0]
    found = readers.footprints_in(spark, path, -118.5, 33, -117.5, 36)
    assert found.count() == 1 and "bbox.xmin" in found._jdf.queryExecution().toString()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("address,grp,kw,at\nx,g,1.0,2025-01-01 00:00:00\nx,g,2.0,2025-01-01 00:01:00\ny,g,3.0,2025-01-01 00:02:00\n")
    stream = lookups.site_stream(spark, str(tmp_path / "in"), "address string, grp string, kw double, at timestamp")
    run = lookups.new_lookups(stream, "address", "at").writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r["address"] for r in spark.table("fresh").collect()} == {"x", "y"} and spark.table("fresh").count() == 2


def test_entry_registers_queries(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 40 and set(oracles) <= set(queries)


def test_occupancy_of_mapped_classes(spark):
    rows = spark.createDataFrame([("apartments",), ("house",), ("garage",), ("barn",), (None,)], "mapped string")
    got = [r[0] for r in rows.select(text.occupancy_from_class(F.col("mapped"))).collect()]
    assert got == ["R-2", "R-3", "commercial", None, None]


def test_home_like_leaves_out_other_buildings(spark):
    """Mapped shops, tall and very large ones go; then what is far from the upper median of the nearest pool."""
    rows = [(1, 10, 1.0, 100.0, 5.0, None), (1, 11, 2.0, 110.0, None, "house"), (1, 12, 3.0, 130.0, 13.0, None), (1, 13, 4.0, 400.0, 5.0, None),
            (1, 14, 0.5, 100.0, 5.0, "retail"), (1, 15, 0.6, 100.0, 13.5, None), (1, 16, 0.7, 1300.0, 5.0, None), (1, 17, 9.0, 260.0, 5.0, None), (2, 18, 1.0, 90.0, 5.0, None)]
    pairs = spark.createDataFrame(rows, "site int, bid int, d double, area double, height_m double, mapped string")
    got = spatial.home_like(pairs, "site", ["d", "bid"], 1).select("site", "bid", "rank").collect()
    # of the nearest four (100, 110, 130, 400) the upper median is 130
    assert sorted(map(tuple, got)) == [(1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 17, 5), (2, 18, 1)]


def test_raised_extra_counts_only_counted_buildings_with_modules(spark):
    rows = [("a", 4, 10.0, 20, True), ("a", 4, 10.0, 0, True), ("a", 6, 30.0, 10, False), ("b", 1, 5.0, 5, False)]
    out = rollup.raised_extra_kw(spark.createDataFrame(rows, "site string, extra int, kw double, modules int, counted boolean"), "site", "extra", "kw", "modules", "counted")
    assert {r["site"]: r["raised_extra_kw"] for r in out.collect()} == {"a": 2.0, "b": 0.0}


def test_unit_points_bring_in_their_first_building_only(spark):
    """A point within reach of two buildings adds the nearer one; a point without any adds none."""
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 50.0, 50.0)], "pid int, px double, py double")
    boxes = spark.createDataFrame([(7, 0.0, 0.0, 6.0, 6.0), (8, 7.0, 0.0, 12.0, 6.0)], "bid int, xmin double, ymin double, xmax double, ymax double")
    hits = spatial.points_near_boxes(points, boxes, 3.0)
    assert sorted((r["pid"], r["bid"]) for r in hits.collect()) == [(1, 7), (1, 8)]
    assert [(r["pid"], r["bid"]) for r in ordered.first_by_key(hits, ["pid"], ["d", "bid"]).collect()] == [(1, 7)]


def test_rows_of_a_short_list_of_scenarios_do_not_meet_by_scenario(spark):
    samples = spark.range(4000).select((F.col("id") % 997 + 1.0).alias("p"), (F.col("id") % 991 + 2.0).alias("t"))
    scenarios = spark.createDataFrame([("low", 0.9), ("high", 1.1)], "scenario string, factor double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        long = quantiles.long_form(samples.crossJoin(F.broadcast(scenarios)).withColumn("e", F.col("p") * F.col("factor") - F.col("t")), ["scenario"], {"e": "e"})
        plan = quantiles.selected(long, ["scenario"], {"e": quantiles.median_ranks("x")}, few=True)._jdf.queryExecution().executedPlan().toString()
        found = {r["scenario"]: r for r in rollup.sweep(samples, scenarios, "p", "t").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan
    for name, factor in (("low", 0.9), ("high", 1.1)):
        err = [((i % 997 + 1.0) * factor - (i % 991 + 2.0)) / (i % 991 + 2.0) for i in range(4000)]
        assert found[name]["n"] == 4000 and found[name]["median_err"] == pytest.approx(float(np.median(err))) and found[name]["median_abs"] == pytest.approx(float(np.median(np.abs(err))))


@pytest.mark.parametrize("k", [1, 2])
def test_points_only_meet_boxes_as_near_as_their_nearest(spark, k):
    rng = np.random.default_rng(5)
    boxes = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(np.column_stack([rng.normal(0, 30, (300, 2)), rng.uniform(1, 9, (300, 2))]))]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 45, (200, 2)))]
    p, b = spark.createDataFrame(points, "pid int, px double, py double"), spark.createDataFrame(boxes, "bid int, xmin double, ymin double, xmax double, ymax double")
    every, few = spatial.points_near_boxes(p, b, 40.0), spatial.points_near_nearest_boxes(p, "pid", b, 40.0, k)
    all_pairs, pairs = {(r["pid"], r["bid"]): r["d"] for r in every.collect()}, {(r["pid"], r["bid"]): r["d"] for r in few.collect()}
    assert pairs.items() <= all_pairs.items() and len(pairs) < len(all_pairs) / 2
    for i in {a for a, _ in all_pairs}:
        own = sorted(d for (a, _), d in all_pairs.items() if a == i)
        furthest = own[min(k, len(own)) - 1]
        assert {x for x, d in all_pairs.items() if x[0] == i and d <= furthest} <= pairs.keys()
