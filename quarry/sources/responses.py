"""Recorded responses of JSON services: one table by endpoint, read back as papers, counts and batches.

A row is one try of a request: (endpoint, request, attempt, status, body).  Endpoints are
partitions of the table, so reading one opens no file of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "request string, attempt int, status int, body string, endpoint string"
PAPER = "struct<paperId:string,title:string,year:int,authors:array<struct<name:string>>,url:string,fieldsOfStudy:array<string>,citationCount:bigint>"


def record(tries: DataFrame, path: str) -> None:
    """Append tries to the table."""
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    tries.select(*names).write.mode("append").partitionBy("endpoint").parquet(path)


def recorded(spark: SparkSession, path: str, endpoint: str) -> DataFrame:
    """The tries of one endpoint."""
    return spark.read.schema(SCHEMA).parquet(path).filter(F.col("endpoint") == endpoint)


def retryable(status: Column) -> Column:
    """A status after which a service is asked again: too many requests, or its own fault."""
    return (status == 429) | (status >= 500)


def settled(tries: DataFrame, most: int) -> DataFrame:
    """(request, status, body, tries) of each request: its first try that is not to be repeated, else its last.

    Only the first `most` tries count.  A body counts only with status 200; a request that has no try at all is not in the table.
    """
    counted = tries.filter(F.col("attempt") < most)
    order = F.struct(F.coalesce(retryable(F.col("status")), F.lit(True)), F.when(retryable(F.col("status")), -F.col("attempt")).otherwise(F.col("attempt")))
    won = counted.groupBy("request").agg(F.min_by(F.struct("status", "body", "attempt"), order).alias("w"))
    body = F.when(F.col("w.status") == 200, F.col("w.body"))
    return won.select("request", F.col("w.status").alias("status"), body.alias("body"), (F.col("w.attempt") + 1).alias("tries"))


def papers(answers: DataFrame) -> DataFrame:
    """(request, place, paper) of search answers {"data": [...]}; a failed or broken answer gives no row."""
    data = F.from_json("body", f"data array<{PAPER}>").getField("data")
    return answers.select("request", F.posexplode(data).alias("place", "paper"))


def totals(answers: DataFrame) -> DataFrame:
    """(request, total) of count answers {"total": n}; null where the search failed, which is not 0."""
    return answers.select("request", F.get_json_object("body", "$.total").cast("bigint").alias("total"))


def batch(answers: DataFrame) -> DataFrame:
    """(request, id, paper) of batch answers, whose list follows the ids of the request (JSON list); null for ids the service does not know."""
    ids = F.from_json("request", "array<string>")
    found = F.from_json("body", f"array<{PAPER}>")
    return answers.select("request", F.posexplode(ids).alias("__at", "id"), found.alias("__found")).select("request", "id", F.get("__found", F.col("__at")).alias("paper"))
