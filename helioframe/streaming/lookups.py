"""New site files as a stream: each address is looked up once, and totals per group run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def site_stream(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).option("header", True).csv(folder)


def new_lookups(sites: DataFrame, key: str, seen_at: str, keep: str = "1 day") -> DataFrame:
    """Each key once within the watermark: what a lookup cache would still have to fetch."""
    return sites.withWatermark(seen_at, keep).dropDuplicatesWithinWatermark([key])


def group_totals(rows: DataFrame, group: str, value: str, seen_at: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Totals per group and time window, late rows left out after the watermark."""
    return rows.withWatermark(seen_at, late).groupBy(F.window(seen_at, window), group).agg(F.sum(value).alias("total"), F.count("*").alias("rows"))
