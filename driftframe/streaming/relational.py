"""Stateless and windowed forms on streams of drives: sessions, counts, masks, unit projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, lateness: str, *aggregates: Column) -> DataFrame:
    """Sessions by gap; a gap strictly longer than `gap` begins the next. Rows later than the watermark are dropped."""
    x = stream.withWatermark(ts, lateness).groupBy(*keys, F.session_window(ts, gap).alias("session"))
    return x.agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first"), F.max(ts).alias("last"), *aggregates).drop("session")


def counts(stream: DataFrame, keys: list[str], ts: str, width: str, lateness: str) -> DataFrame:
    """Rows by key in tumbling windows."""
    return stream.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def run_to_memory(spark: SparkSession, stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all it has now, into a table of the driver's memory: for small results and tests."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def run_to_table(spark: SparkSession, stream: DataFrame, folder: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all it has now, each micro-batch's result into Parquet files of its own: of any size, and of a batch that is run
    again the last result counts. mode complete: the last batch's table; update: all rows given out."""
    last: list[int] = []

    def put(rows: DataFrame, nth: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={nth}")
        last.append(nth)

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{folder}/batch={max(last)}"] if mode == "complete" else [f"{folder}/batch={n}" for n in sorted(set(last))]
    return spark.read.schema(stream.schema).parquet(*paths)


def run_to_files(spark: SparkSession, stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Run a stream of appended rows over all it has now, into Parquet files: exactly once, and of any size."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)
