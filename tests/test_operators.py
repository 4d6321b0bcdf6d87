"""Hand-worked rules and the SQL of every registered query on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import scalar
from quarry.operators import clusters, dedup, review
from quarry.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "part", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(df):
    df = df[sorted(df.columns)].astype(object)
    cell = lambda v: "~" if v is None or v is pd.NA or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert rows_of(got) == rows_of(duck.execute(catalogue.ORACLE_SQL[name]).df())


def test_smoothed_weights(spark):
    df = spark.createDataFrame([(1, 1), (20, 23), (0, 0)], "f int, q int")
    got = [r[0] for r in df.select(scalar.smoothed_weight(F.col("f"), F.col("q"), F.lit(0))).collect()]
    assert [round(x, 3) for x in got] == [0.667, 0.84, 0.5]


def test_empty_cluster_is_reported(spark):
    examples = spark.createDataFrame([("a", True), ("a", False)], "c string, failed boolean")
    spine = spark.createDataFrame([("a",), ("b",)], "c string")
    got = {r["c"]: (r["num_questions"], r["failure_rate"]) for r in clusters.nodes(examples, spine, "c", "failed").collect()}
    assert got == {"a": (2, 0.5), "b": (0, 0.0)}


def test_allocation(spark):
    strata = spark.createDataFrame([("x", 129), ("y", 122), ("z", 114)], "g string, n int")
    got = {r["g"]: r["allocated"] for r in clusters.allocate(strata, "g", "n", 100).collect()}
    assert got == {"x": 35, "y": 34, "z": 31}


def test_latest_wins(spark):
    df = spark.createDataFrame(
        [("a", 1, "ok"), ("a", 2, "error"), ("b", 1, "error"), ("b", 2, "error"), ("c", 1, "error"), ("c", 2, "ok")],
        "id string, line int, decision string",
    )
    got = dedup.latest_wins(df, ["id"], F.col("decision") == "error", F.col("line")).collect()
    assert {r["id"]: r["line"] for r in got} == {"a": 1, "b": 2, "c": 2}


def test_severity_and_terms(spark):
    df = spark.createDataFrame([("PASS", "REJECT"), ("PASS", None), ("MINOR_REVISION", "PASS")], "a string, b string")
    got = [r[0] for r in df.select(scalar.worst_severity(F.col("a"), F.col("b"))).collect()]
    assert got == ["REJECT", "PASS", "MINOR_REVISION"]
    terms = spark.createDataFrame([("RSN index",), ("a b c d e",), ("plain words",)], "t string")
    assert [r[0] for r in terms.select(review.can_reject(F.col("t"))).collect()] == [False, False, True]


def test_missing_verdict_is_no_failure(spark):
    df = spark.createDataFrame([(1, "s", "FAILED"), (1, "t", None), (2, "s", "FAILED"), (2, "t", "FAILED")], "id int, system string, verdict string")
    strict = {r["id"]: r["failed_by_all"] for r in review.failed_by_all(df, 2).collect()}
    loose = {r["id"]: r["failed_by_all"] for r in review.failed_by_all(df, 2, missing_fails=True).collect()}
    assert strict == {1: False, 2: True} and loose == {1: True, 2: True}


def test_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(scalar.cosine_distance(F.col("a"), F.col("b"))).first()[0] == 1.0
