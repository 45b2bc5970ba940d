"""Properties of many lots: a sample of a community's homes, and further parcels of the same owner."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.functions import solar
from helioframe.operators import spatial
from helioframe.operators.stages import stored

#: Square metres of a home in a row of homes; smaller buildings than three of them are one home.
HOME_M2 = 100.0
#: The least units of a community, and the buildings that make a sample needless.
LEAST_UNITS, ENOUGH_BUILDINGS = 10, 5
#: How many owners are looked up at most, for each building that the sample may have.
CHECKS = 3
#: Owners looked up for the further parcels of a site.
LOOKUPS = 10


def homes(area: Column, counted: Column) -> Column:
    """Homes of a building: address points on it, else one, or one per HOME_M2 of a large one."""
    rows = F.when(area >= 3 * HOME_M2, F.greatest(F.lit(1), F.bround(area / HOME_M2, 0).cast("int"))).otherwise(1)
    return F.when(F.coalesce(counted, F.lit(0)) > 0, counted).otherwise(rows).cast("int")


def asked_sites(sites: DataFrame, found: DataFrame) -> DataFrame:
    """The sites that community_sample samples, with radius and have: few buildings are found at any, so few are near."""
    have = found.groupBy("site").agg(F.count("*").cast("int").alias("have"), F.sum(homes(F.col("area"), F.col("counted"))).alias("have_homes"))
    asked = sites.join(have, "site", "left").withColumns({"have": F.coalesce("have", F.lit(0)), "have_homes": F.coalesce("have_homes", F.lit(0)), "radius": solar.community_radius(F.col("units"))})
    return asked.where((F.col("units") >= LEAST_UNITS) & (F.col("occupancy") == "R-3") & (F.col("have") < ENOUGH_BUILDINGS) & (F.col("have_homes") * 2 < F.col("units")))


def community_sample(sites: DataFrame, found: DataFrame, near: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """A sample of homes around the sites whose units far exceed the homes found: (buildings, sites with a reason).

    sites: site, units, occupancy, owner_known. found: site, bid, area, counted (address points), the buildings
    matched so far. near: site, bid, d, area, mapped, height_m, counted, same_owner (null where the look-up failed),
    the other buildings around. A site is sampled if it is a single-family property of LEAST_UNITS or more with fewer
    than ENOUGH_BUILDINGS found, whose homes are less than half its units. Within its community's radius, buildings
    that look like homes are taken nearest first until the site has n; where the owner is known each is checked, those
    of others are passed over, and checks end after CHECKS * n.

    The buildings picked: site, bid, place, homes. The sites sampled: site, radius, have, picked, skipped, reason.
    """
    return sampled(asked_sites(sites, found), found, near, n)


def sampled(asked: DataFrame, found: DataFrame, near: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """community_sample of asked_sites; found and near are only needed for these."""
    return told(asked, looked_at(asked, found, near, n))


def sampled_in_circles(asked: DataFrame, found: DataFrame, look: Callable[[DataFrame, float], DataFrame], n: int, reach: float = 40.0) -> tuple[DataFrame, DataFrame]:
    """sampled, with near looked for as far as it matters: look(sites, reach) gives what is within reach of sites (site).

    Circles double until each site is done: its whole radius has been looked at, or the pool that home_like takes is
    full and the last building needed, or allowed, was found. What is farther away comes later in both.
    """
    most = asked.agg(F.max("radius")).first()[0] or 0.0
    left, seen = asked, []
    while True:
        reach = reach if reach * 1.25 < most else most
        rows = stored(looked_at(left, found, look(left.select("site"), reach), n))
        if reach >= most:
            break
        ends = rows.groupBy("site").agg((F.bool_or("pool_full") & ((F.max("taken") + F.first("have") >= n) | (F.first("owner_known") & (F.max("check") >= CHECKS * n)))).alias("ended"))
        marked = left.join(ends, "site", "left").withColumn("done", F.coalesce("ended", F.lit(False)) | (F.col("radius") <= reach) | (F.col("have") >= n)).drop("ended")
        left = stored(marked.where(~F.col("done")).drop("done"))
        seen.append(rows.join(left, "site", "left_anti"))
        reach *= 2
    return told(asked, reduce(DataFrame.unionByName, [*seen, rows]))


def looked_at(asked: DataFrame, found: DataFrame, near: DataFrame, n: int) -> DataFrame:
    """The buildings that are looked at for each site's sample, with check (their place), fits and taken (so far)."""
    within = near.join(asked.select("site", "radius", "have", "owner_known"), "site").where(F.col("d") <= F.col("radius")).join(found.select("site", "bid"), ["site", "bid"], "left_anti")
    order = ["d", "bid"]
    alike = spatial.home_like(within, "site", order, n).drop("rank")
    w = Window.partitionBy("site").orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = ~F.col("owner_known") | F.coalesce("same_owner", F.lit(False))
    # every candidate is a check; those after the last one needed, or allowed, are never looked at
    seen = alike.withColumn("check", F.row_number().over(w)).withColumn("fits", fits).withColumn("taken", F.sum(fits.cast("int")).over(so_far))
    return seen.where((F.col("taken") - F.col("fits").cast("int") + F.col("have") < n) & (~F.col("owner_known") | (F.col("check") <= CHECKS * n)))


def told(asked: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The buildings picked of those looked at, and the sites with their reasons."""
    picked = seen.where("fits").select("site", "bid", F.col("taken").cast("int").alias("place"), homes(F.col("area"), F.col("counted")).alias("homes"))
    sums = seen.groupBy("site").agg(F.count_if("fits").cast("int").alias("picked"), F.count_if(F.col("owner_known") & (F.col("same_owner") == F.lit(False))).cast("int").alias("skipped"))
    counted = asked.join(sums, "site", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("picked", "skipped")})
    reason = F.concat(
        F.lit("community_sampled_"), (F.col("have") + F.col("picked")).cast("string"), F.lit("_buildings_within_"), F.bround("radius", 0).cast("int").cast("string"), F.lit("m"),
        F.when(F.col("skipped") > 0, F.concat(F.lit("_skipped_"), F.col("skipped").cast("string"), F.lit("_other_owners"))).otherwise(""), F.when(F.col("owner_known"), "").otherwise("_ownership_not_checked"),
    )
    return picked, counted.select("site", "radius", "have", "picked", "skipped", reason.alias("reason"))


def further_parcels(points: DataFrame, own: DataFrame, budget: int = LOOKUPS) -> DataFrame:
    """Further parcels under each site's unit addresses: site, added (parcels of the same owner, in order) and skipped.

    points: site, ord, parcel (null where the look-up fails), covering (the parcels that have the point inside) and
    same_owner of its parcel. own: site and its own parcel. Points are taken in order: one that a parcel seen before
    covers needs no look-up; any other costs one, also a failing one, up to the budget; the site's own parcel is
    seen from the start. Points with the same parcel and covering parcels are alike, so of each kind only as many as
    the budget are gathered.
    """
    covering = F.array_sort(F.coalesce("covering", F.array().cast(points.schema["covering"].dataType)))
    first = Window.partitionBy("site", "parcel", "covering").orderBy("ord")
    few = points.withColumn("covering", covering).withColumn("k", F.row_number().over(first)).where(F.col("k") <= budget)
    gathered = few.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("ord", "parcel", "covering", F.coalesce("same_owner", F.lit(False)).alias("same")))).alias("points"))
    rows = own.select("site", F.col("parcel").alias("own")).join(gathered, "site")
    ids = f"array<{points.schema['parcel'].dataType.simpleString()}>"
    start = F.struct(F.lit(0).alias("asked"), F.array("own").cast(ids).alias("seen"), F.array().cast(ids).alias("added"), F.lit(0).alias("skipped"))

    def step(s: Column, p: Column) -> Column:
        known = p["parcel"].isNotNull()
        looked = F.struct(
            (s["asked"] + 1).alias("asked"), F.when(known, F.concat(s["seen"], F.array(p["parcel"]))).otherwise(s["seen"]).alias("seen"),
            F.when(known & p["same"], F.concat(s["added"], F.array(p["parcel"]))).otherwise(s["added"]).alias("added"), (s["skipped"] + F.when(known & ~p["same"], 1).otherwise(0)).alias("skipped"),
        )
        return F.when((s["asked"] >= budget) | F.arrays_overlap(s["seen"], p["covering"]), s).otherwise(looked)

    return rows.select("site", F.aggregate("points", start, step).alias("s")).select("site", "s.added", "s.skipped")
