"""Queries of properties of many lots."""

from __future__ import annotations

from pyspark.sql import functions as F

from helioframe.catalog import near_boxes, places_sql, query, table
from helioframe.operators import community
from helioframe.operators.stages import stored


@query("j15_further_parcels", """
    WITH RECURSIVE p AS (
        SELECT o_custkey AS site, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, CASE WHEN o_orderkey % 17 > 0 THEN o_custkey * 100 + o_orderkey % 13 END AS parcel, o_orderkey % 3 > 0 AS inside FROM orders),
    walk(site, k, asked, seen, added, skipped) AS (
        SELECT DISTINCT site, 0::BIGINT, 0, [site * 100], []::BIGINT[], 0 FROM p UNION ALL
        SELECT w.site, p.k, CASE WHEN skip THEN asked ELSE asked + 1 END, CASE WHEN skip OR parcel IS NULL THEN seen ELSE list_append(seen, parcel) END,
               CASE WHEN skip OR parcel IS NULL OR parcel % 4 > 0 THEN added ELSE list_append(added, parcel) END, CASE WHEN skip OR parcel IS NULL OR parcel % 4 = 0 THEN skipped ELSE skipped + 1 END
        FROM walk w JOIN p ON p.site = w.site AND p.k = w.k + 1, LATERAL (SELECT asked >= 10 OR coalesce(inside AND list_contains(seen, parcel), false) AS skip) t)
    SELECT site AS o_custkey, arg_max(array_to_string(added, ','), k) AS added, arg_max(skipped, k)::INT AS skipped FROM walk GROUP BY site""")
def j15_further_parcels(spark, sf_dir):
    """Parcels under each customer's orders, in order: those seen need no look-up, and look-ups are limited."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    points = o.select(F.col("o_custkey").alias("site"), key.alias("ord"), F.when(key % 17 > 0, F.col("o_custkey") * 100 + key % 13).alias("parcel"))
    points = points.withColumn("covering", F.when((F.col("ord") % 3 > 0) & F.col("parcel").isNotNull(), F.array("parcel"))).withColumn("same_owner", F.col("parcel") % 4 == 0)
    own = o.select(F.col("o_custkey").alias("site")).distinct().withColumn("parcel", F.col("site") * 100)
    found = community.further_parcels(points, own)
    return found.select(F.col("site").alias("o_custkey"), F.array_join(F.transform("added", lambda x: x.cast("string")), ",").alias("added"), "skipped")


@query("j27_community_sample", f"""
    WITH {places_sql(1000)}, s AS (SELECT pid, pid % 90 + 5 AS units, pid % 4 = 0 AS known FROM pts WHERE pid % 5 <> 0),
    h AS (SELECT *, CASE WHEN bid % 3 = 0 THEN 2 WHEN area >= 300 THEN greatest(1, round_even(area / 100, 0)) ELSE 1 END AS homes, CASE WHEN bid % 7 > 0 THEN bid % 5 <> 0 END AS same FROM hits),
    f AS (SELECT pid, count(*) AS have, sum(homes) AS have_homes FROM h WHERE d <= 1 GROUP BY pid),
    a AS (SELECT s.*, coalesce(have, 0) AS have, greatest(150, least(1000, 1.6 * sqrt(units * 450 / pi()))) AS radius FROM s LEFT JOIN f USING (pid)
          WHERE units >= 10 AND coalesce(have, 0) < 5 AND coalesce(have_homes, 0) * 2 < units),
    ok AS (SELECT h.*, have, known, row_number() OVER (PARTITION BY pid ORDER BY d, bid) AS rank FROM h JOIN a USING (pid) WHERE d > 1 AND d <= radius AND area / 20 <= 13 AND area <= 1200),
    m AS (SELECT pid, list_sort(list(area)) AS l FROM ok WHERE rank <= 16 GROUP BY pid),
    c AS (SELECT ok.*, row_number() OVER w AS checked, NOT known OR coalesce(same, false) AS fits, sum((NOT known OR coalesce(same, false))::INT) OVER w AS taken
          FROM ok JOIN m USING (pid) WHERE area BETWEEN 0.5 * l[len(l) // 2 + 1] AND 2 * l[len(l) // 2 + 1] WINDOW w AS (PARTITION BY pid ORDER BY d, bid))
    SELECT pid, bid, taken::INT AS place, homes::INT AS homes FROM c WHERE fits AND taken - 1 + have < 4 AND (NOT known OR checked <= 12)""")
def j27_community_sample(spark, sf_dir):
    """Homes taken as a sample of each community, nearest first, others' passed over where owners are known."""
    def marked(hits):
        return hits.withColumnRenamed("pid", "site").select(
            "site", "bid", "d", "area", F.lit(None).cast("string").alias("mapped"), (F.col("area") / 20).alias("height_m"), F.when(F.col("bid") % 3 == 0, 2).otherwise(0).alias("counted"),
            F.when(F.col("bid") % 7 > 0, F.col("bid") % 5 != 0).alias("same_owner"),
        )

    sites = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("site"))
    sites = sites.select("site", (F.col("site") % 90 + 5).alias("units"), F.when(F.col("site") % 5 != 0, "R-3").otherwise("R-2").alias("occupancy"), (F.col("site") % 4 == 0).alias("owner_known"))
    # what is found is counted first: where buildings lie dense, no site is asked, and what else is near isn't looked for
    asked = stored(community.asked_sites(sites, marked(near_boxes(spark, sf_dir, reach=1.0)[0])))
    around = lambda some, reach: marked(near_boxes(spark, sf_dir, of=some.select(F.col("site").alias("pid")), reach=reach)[0])
    picked, _ = community.sampled_in_circles(asked, stored(around(asked, 1.0)), around, 4)
    return picked.select(F.col("site").alias("pid"), "bid", "place", "homes")
