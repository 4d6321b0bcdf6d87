"""A streaming view of the call log: calls, errors and spend by time window and kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from quarry.storage import fresh_path


def read_calls(spark: SparkSession, path: str, schema: StructType, names: str = "*.parquet", files: int = 1000) -> DataFrame:
    """The Parquet files of a folder as a stream of rows, at most `files` of them a batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", names).option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def spend(
    calls: DataFrame, time: str, kind: str, cost: str, is_error: Column, width: str, lateness: str | None = None
) -> DataFrame:
    """(window_start, kind, calls, errors, cost) by windows of `width`.

    With `lateness`, rows behind the watermark are left out and closed windows leave the
    state; without it the state holds one row for each window and kind seen.
    """
    rows = calls.withWatermark(time, lateness) if lateness else calls
    grouped = rows.groupBy(F.window(time, width).alias("__w"), F.col(kind)).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(is_error).alias("errors"), F.sum(cost).alias("cost")
    )
    return grouped.select(F.col("__w.start").alias("window_start"), kind, "calls", "errors", "cost")


def run_available(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Process what is there now in update mode and return the last state of every key.

    Each batch goes to its own folder, overwritten if the batch is repeated after a failure.
    """
    spark = stream.sparkSession
    root = fresh_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    started = (
        stream.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    try:
        rows = spark.read.schema(StructType([*stream.schema.fields]).add("batch", LongType())).parquet(f"{root}/rows")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], stream.schema)
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("batch").desc()))
    return rows.withColumn("__newest", newest).filter("__newest = 1").select(*stream.columns)
