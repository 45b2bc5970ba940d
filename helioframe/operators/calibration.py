"""Accuracy of estimates against known values, and calibration by segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.operators import quantiles
from helioframe.operators.stages import stored

MIN_SAMPLES = 5
TOLERANCE = 0.10


def segment_key(*parts: str) -> Column:
    return F.concat_ws("|", *parts)


def signed_error(predicted: str, true: str) -> Column:
    return (F.col(predicted) - F.col(true)) / F.col(true)


def accuracy(samples: DataFrame, predicted: str, true: str, by: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Per group: n, share within tolerance, median and mean absolute error, 90th percentile, median signed error."""
    rows = samples.where(F.col(true) > 0).withColumn("e", signed_error(predicted, true)).withColumn("ae", F.abs("e"))
    base = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col("ae") <= tolerance).cast("double")).alias("within"), F.avg("ae").alias("mean_abs"),
    )
    found = quantiles.with_medians(base, rows, by, {"median_abs": "ae", "median_signed": "e"}, {"ae": {"p90_abs": quantiles.p90_round_rank()}})
    return found.select(*by, "n", "within", "median_abs", "mean_abs", "median_signed", "p90_abs")


def ratios(samples: DataFrame, predicted: str, true: str, key: str, *more: str) -> DataFrame:
    """A long form of the ratios true / predicted: by key as column `segment`, and again without it as `global`."""
    rows = samples.where((F.col(predicted) > 0) & (F.col(true) > 0)).select(key, *more, (F.col(true) / F.col(predicted)).alias("v"))
    both = F.array(F.struct(F.col(key).alias("key"), F.lit("segment").alias("c")), F.struct(F.lit(None).alias("key"), F.lit("global").alias("c")))
    return rows.withColumn("x", F.explode(both)).select("x.key", "x.c", *more, "v")


def medians(long: DataFrame, tests: str | None = None) -> DataFrame:
    """key, test, c, n and factor: the medians of ratios of each key and of all."""
    ranks = {c: quantiles.median_ranks("m") for c in ("segment", "global")}
    by = ["key", "test"] if tests else ["key"]
    found = quantiles.selected(long, ["key"], ranks, tests)
    return found.groupBy(*by, "c").agg(F.max("n").alias("n"), (F.sum("value") / F.count("*")).alias("factor"))


def fit(samples: DataFrame, predicted: str, true: str, key: str, min_samples: int = MIN_SAMPLES) -> tuple[DataFrame, float | None]:
    """Median ratio true / predicted per key with at least min_samples, and of all samples."""
    found = stored(medians(stored(ratios(samples, predicted, true, key))))
    overall = found.where("c = 'global'").first()
    factors = found.where((F.col("c") == "segment") & (F.col("n") >= min_samples)).select(F.col("key").alias(key), "factor", "n")
    return factors, None if overall is None else overall["factor"]


def with_factor(rows: DataFrame, factors: DataFrame, overall: float | None, key: str) -> DataFrame:
    """rows with calibration_factor and calibration_source: segment, else global, else 1."""
    known = factors.select(key, F.col("factor").alias("x_factor"))
    joined = rows.join(known, key, "left")
    return joined.select(
        *rows.columns,
        F.coalesce("x_factor", F.lit(overall), F.lit(1.0)).alias("calibration_factor"),
        F.when(F.col("x_factor").isNotNull(), "segment").when(F.lit(overall is not None), "global").otherwise("none").alias("calibration_source"),
    )


def fold(ordinal: str, folds: int) -> Column:
    return F.pmod(F.col(ordinal), F.lit(folds))


def cross_validate(samples: DataFrame, predicted: str, true: str, key: str, ordinal: str, folds: int = 5, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """samples with their fold and the prediction calibrated on all other folds."""
    rows = samples.withColumn("fold", fold(ordinal, folds).cast("int"))
    # a row counts for every fold but its own
    others = F.array_except(F.sequence(F.lit(0), F.lit(folds - 1)), F.array("fold"))
    long = stored(ratios(rows.withColumn("tests", others), predicted, true, key, "tests"))
    found = stored(medians(long, "tests"))
    own = found.where((F.col("c") == "segment") & (F.col("n") >= min_samples)).select(F.col("test").alias("fold"), F.col("key").alias(key), "factor")
    overall = found.where("c = 'global'").select(F.col("test").alias("fold"), F.col("factor").alias("x_overall"))  # a row per fold
    joined = rows.join(own, ["fold", key], "left").join(F.broadcast(overall), "fold", "left")
    return joined.select(*samples.columns, "fold", (F.col(predicted) * F.coalesce("factor", "x_overall", F.lit(1.0))).alias("calibrated"))


def auto_accept(rows: DataFrame, predicted: str, true: str, needs_review: Column, by: list[str]) -> DataFrame:
    """Accuracy of all rows and of those accepted without review, and the share of the latter."""
    marked = rows.withColumn("accepted", ~needs_review)
    share = marked.groupBy(*by).agg(F.avg(F.col("accepted").cast("double")).alias("auto_accept_rate"))
    every = accuracy(marked, predicted, true, by).select(*by, F.col("n").alias("n_all"), F.col("median_abs").alias("median_abs_all"))
    taken = accuracy(marked.where("accepted"), predicted, true, by).select(*by, F.col("n").alias("n_accepted"), F.col("median_abs").alias("median_abs_accepted"))
    return share.join(every, by).join(taken, by, "left")
