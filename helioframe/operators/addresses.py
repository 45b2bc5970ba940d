"""Address matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helioframe.functions import text

MOST_SPAN = 400


def best_street(queries: DataFrame, streets: DataFrame, query_key: str, zone: str, query_street: str, street: str) -> DataFrame:
    """Each query's best street of its zone by score; ties go to the last street in the alphabet.

    Every distinctive word of a query must be in the street, so a query's text only meets the streets that have its
    rarest one, by an index of (zone, word). Texts are asked once per zone, however many queries have them.
    """
    words = lambda c: text.street_tokens(F.col(c))
    index = streets.select(zone, F.col(street).alias("x_street")).distinct().withColumn("x_tokens", words("x_street")).withColumn("x_token", F.explode(F.array_distinct("x_tokens")))
    common = index.groupBy(F.col(zone).alias("x_zone"), F.col("x_token").alias("x_word")).agg(F.count("*").alias("x_n"))
    generic = F.array(*(F.lit(w) for w in text.GENERIC_STREET_WORDS))
    asked = queries.select(zone, query_street).distinct().withColumn("x_asked", words(query_street))
    core = asked.withColumn("x_token", F.explode(F.array_except("x_asked", generic)))
    rated = core.join(common, (F.col(zone) == F.col("x_zone")) & (F.col("x_token") == F.col("x_word")), "left")
    rarest = rated.groupBy(zone, query_street).agg(F.first("x_asked").alias("x_asked"), F.min_by("x_token", F.struct(F.coalesce("x_n", F.lit(0)), "x_token")).alias("x_token"))
    scored = rarest.join(index, [zone, "x_token"]).withColumn("score", text.street_score(F.col("x_asked"), F.col("x_tokens"))).where("score > 0")
    best = scored.groupBy(zone, query_street).agg(F.max_by(F.struct(F.col("x_street").alias("best_street"), "score"), F.struct("score", "x_street")).alias("x"))
    return queries.join(best, [zone, query_street]).select(*queries.columns, "x.best_street", "x.score")


def expanded_ranges(queries: DataFrame, low: str, high: str, most_span: int = MOST_SPAN) -> DataFrame:
    """A row per house number of each range that is not too long; else only its low end."""
    fit = (F.col(high) >= F.col(low)) & (F.col(high) - F.col(low) <= most_span)
    return queries.withColumn("number", F.explode(F.sequence(F.col(low), F.when(fit, F.col(high)).otherwise(F.col(low)))))


def address_hits(queries: DataFrame, addresses: DataFrame, zone: str, number: str, unit: str) -> DataFrame:
    """Queries with the address points of their zone and number; null units first."""
    w = Window.partitionBy(*queries.columns).orderBy(F.col(unit).isNotNull(), F.col(unit))
    return queries.join(addresses, [zone, number]).withColumn("x_place", F.row_number().over(w)).where("x_place = 1").drop("x_place")
