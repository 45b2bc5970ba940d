"""The community sample and the fold over a site's parcels against plain loops."""

import math
import random
from statistics import median_high

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from helioframe.operators import community


def test_further_parcels_depend_on_the_order(spark):
    rng = random.Random(8)
    rows, own = [], [(s, s * 100) for s in range(30)]
    for s in range(29):
        for o in range(rng.randrange(1, 60)):
            parcel = rng.choice([None, *(s * 100 + k for k in range(14))])
            covering = rng.choice([None, [], [parcel] if parcel else [], [s * 100 + rng.randrange(14), parcel] if parcel else [s * 100 + 3]])
            rows.append((s, o, parcel, covering, parcel is not None and parcel % 3 == 0))
    want = {}
    for s in range(29):
        asked, seen, added, skipped = 0, {s * 100}, [], 0
        for _, o, parcel, covering, same in [r for r in rows if r[0] == s]:
            if asked >= 10 or seen & set(covering or []):
                continue
            asked += 1
            if parcel is None:
                continue
            seen.add(parcel)
            added, skipped = (added + [parcel], skipped) if same else (added, skipped + 1)
        want[s] = (added, skipped)
    rng.shuffle(rows)
    points = spark.createDataFrame(rows, "site int, ord int, parcel int, covering array<int>, same_owner boolean")
    got = community.further_parcels(points, spark.createDataFrame(own, "site int, parcel int"))
    assert {r["site"]: (r["added"], r["skipped"]) for r in got.collect()} == want
    assert community.further_parcels(points.limit(0), spark.createDataFrame(own, "site int, parcel int")).count() == 0


def test_community_sample(spark):
    rng = random.Random(9)
    homes = lambda a, c: c or (max(1, round(a / 100)) if a >= 300 else 1)
    sites = [(s, rng.choice([5, 12, 60, 400, None]), rng.choice(["R-3", "R-3", "R-3", "commercial"]), rng.random() < 0.6) for s in range(150)]
    found = [(s, b, rng.choice([120.0, 340.0, 950.0]), rng.choice([0, 0, 4])) for s in range(150) for b in range(rng.randrange(6))]
    near = [(s, b, round(rng.uniform(5, 900), 3), rng.choice([90.0, 150.0, 180.0, 220.0, 330.0, 700.0, 1500.0]), rng.choice([None, None, None, "retail"]), rng.choice([None, 5.0, 20.0]), rng.choice([0, 0, 2]), rng.choice([True, True, False, None])) for s in range(148) for b in range(3, 3 + rng.randrange(40))]
    n, want, reasons = 6, {}, {}
    for s, units, occ, known in sites:
        have = [(a, c) for i, _, a, c in found if i == s]
        if not units or units < 10 or occ != "R-3" or len(have) >= 5 or sum(homes(a, c) for a, c in have) * 2 >= units:
            continue
        radius = min(1000.0, max(150.0, 1.6 * math.sqrt(units * 450 / math.pi)))
        ids = {b for i, b, *_ in found if i == s}
        ok = sorted((r for r in near if r[0] == s and r[1] not in ids and r[2] <= radius and r[4] is None and (r[5] is None or r[5] <= 13) and r[3] <= 1200), key=lambda r: (r[2], r[1]))
        middle = median_high([r[3] for r in ok[: 4 * n]]) if ok else 0
        picked, checked, other = [], 0, 0
        for r in [r for r in ok if 0.5 * middle <= r[3] <= 2 * middle]:
            if len(picked) + len(have) >= n or (known and checked >= 3 * n):
                break
            checked += 1
            if known and not r[7]:
                other += r[7] is False
                continue
            picked.append(r)
            want[s, r[1]] = (len(picked), homes(r[3], r[6]))
        reasons[s] = f"community_sampled_{len(have) + len(picked)}_buildings_within_{radius:.0f}m" + (f"_skipped_{other}_other_owners" if other else "") + ("" if known else "_ownership_not_checked")
    picked, told = community.community_sample(
        spark.createDataFrame(sites, "site int, units int, occupancy string, owner_known boolean"), spark.createDataFrame(found, "site int, bid int, area double, counted int"),
        spark.createDataFrame(near, "site int, bid int, d double, area double, mapped string, height_m double, counted int, same_owner boolean"), n,
    )
    assert {(r["site"], r["bid"]): (r["place"], r["homes"]) for r in picked.collect()} == want and len(want) > 20
    assert {r["site"]: r["reason"] for r in told.collect()} == reasons and any("skipped" in r for r in reasons.values())


def test_circles_widen_until_the_sample_is_whole(spark):
    rng = random.Random(10)
    asked = [(s, rng.choice([150.0, 320.0, 1000.0]), rng.randrange(8), rng.random() < 0.5, "R-3") for s in range(120)]
    asked = spark.createDataFrame(asked, "site int, radius double, have int, owner_known boolean, occupancy string").withColumn("have", F.col("have").cast("int"))
    rows = [(s, b, round(rng.uniform(0, 1100) * (s % 4 + 1) / 4, 0), rng.choice([90.0, 150.0, 180.0, 700.0, 1500.0]), None, None, 0, rng.choice([True, False, False, None])) for s in range(118) for b in range(rng.choice([0, 3, 30, 150]))]
    near = spark.createDataFrame(rows, "site int, bid int, d double, area double, mapped string, height_m double, counted int, same_owner boolean")
    found, reaches, n = near.where("bid % 9 = 0").select("site", "bid"), [], 6

    def look(sites, reach):
        reaches.append(reach)
        return near.join(sites, "site").where(F.col("d") <= reach)

    for got, want in zip(community.sampled_in_circles(asked, found, look, n), community.sampled(asked, found, near, n)):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 100
    assert reaches == [40.0, 80.0, 160.0, 320.0, 640.0, 1000.0]
    assert community.sampled_in_circles(asked.limit(0), found, look, n)[0].count() == 0


def test_sample_takes_homes_as_far_as_the_radius(spark, tmp_path):
    rng, folder = random.Random(11), str(tmp_path)
    rows = [(i, [rng.uniform(-0.4, 0.4), rng.uniform(-0.4, 0.4)]) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(folder + "/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    got = sorted(map(tuple, __spark_entry__.queries()["j27_community_sample"](spark, folder).collect()))
    assert got == sorted(db.sql(__spark_entry__.oracle_sql()["j27_community_sample"]).fetchall())
    at, far = dict(rows), 0
    for site, bid, *_ in got:
        (px, py), (x, y) = at[site], at[bid]
        gap = lambda p, low, size: max(1000 * low - 1000 * p, 0, 1000 * p - 1000 * low - size)
        far = max(far, math.hypot(gap(px, x, 5 + bid % 20), gap(py, y, 5 + bid % 15)))
    assert far > 100
