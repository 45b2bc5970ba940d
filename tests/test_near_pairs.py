"""Joins of points and boxes that lie dense: pairs stay where they met, and only needed ones are made."""

import random

import duckdb
import pytest

import __spark_entry__


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    folder, rng = str(tmp_path_factory.mktemp("dense")), random.Random(8)
    rows = [(i, [rng.gauss(0, 0.02), rng.gauss(0, 0.02)]) for i in range(1200)] + [(i, [rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3)]) for i in range(1200, 1500)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(folder + "/embeddings.parquet")
    return folder


def ran(df):
    """The plan as it ran."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[: text.index("Initial Plan")] if "Initial Plan" in text else text


@pytest.mark.parametrize("name", ["j4_campus", "f9_home_like", "j25_nearest_qualifying", "j27_community_sample"])
def test_dense_points_and_boxes_as_in_sql(spark, dense, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{dense}/embeddings.parquet/*.parquet'")
    want = sorted(db.sql(__spark_entry__.oracle_sql()[name]).fetchall())
    assert want and sorted(map(tuple, __spark_entry__.queries()[name](spark, dense).collect())) == want


@pytest.mark.parametrize("name", ["j4_campus", "f9_home_like"])
def test_pairs_are_ranked_where_they_met(spark, dense, name):
    plan = ran(__spark_entry__.queries()[name](spark, dense))
    top = plan[: plan.index("Join")]
    assert "Window" in top and "Exchange" not in top and "ShuffleQueryStage" not in top
