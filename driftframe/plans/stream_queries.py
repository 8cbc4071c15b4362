"""Streaming queries over `events` and synthetic drives, run over all that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.plans import navigation
from driftframe.plans.registry import query, r, rs
from driftframe.runtime import new_folder, remove, ship, table
from driftframe.streaming import engine, relational


def _events(spark: SparkSession, sf: str) -> DataFrame:
    s = relational.file_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    checkpoint = new_folder(spark, "stream-checkpoint")
    out = relational.run_to_table(spark, stream, new_folder(spark, "stream"), mode, checkpoint)
    remove(spark, checkpoint)
    return out


@query(
    "stream_sessions",
    f"""WITH g AS (SELECT user_id, ts, value, sum(CASE WHEN epoch_us(ts) - epoch_us(before) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
    FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) SELECT user_id, s AS session, count(*) AS n_rows, {rs('sum(value)', 3)} AS total FROM (SELECT user_id, value, CAST(s AS INTEGER) AS s FROM g) GROUP BY 1, 2""",
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    s = _run(spark, relational.sessions(_events(spark, sf), ["user_id"], "ts", "6 hours", "1 hour", F.sum("value").alias("total")), "complete")
    nth = (F.row_number().over(Window.partitionBy("user_id").orderBy("first")) - 1).cast("int")
    return s.select("user_id", nth.alias("session"), "n_rows", r("total", 3).alias("total"))


@query("stream_counts", "SELECT event_type, CAST(epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000000 AS BIGINT) AS start_s, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = _run(spark, relational.counts(_events(spark, sf), ["event_type"], "ts", "1 day", "1 hour"), "update")
    return c.groupBy("event_type", F.unix_seconds("start").alias("start_s")).agg(F.max("n").alias("n"))


def engine_input(spark: SparkSession, count: int) -> DataFrame:
    """Test drives with one outage of 30 s, alignment from the first 150 s, and a wall clock."""
    from driftframe.operators import navigate

    d = navigation.test_drives(spark, count)
    dark = (F.col("t") >= 200.0) & (F.col("t") < 230.0)
    seen = navigation.outages.mask(d, dark)
    al = navigate.calibrations(seen.where("t < 150"), ["drive_id"], navigation.CFG).select("drive_id", "alignment")
    return seen.join(al, "drive_id").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6 + 1.7e15).cast("long"))).withColumn("enabled", F.lit(True))


@query("stream_engine")
def stream_engine(spark: SparkSession, sf: str) -> DataFrame:
    """Variant B on a stream of shuffled files of samples; a last sample long after moves the watermark past all others."""
    ship(spark)
    folder, checkpoint = new_folder(spark, "samples"), new_folder(spark, "samples-checkpoint")
    rows = engine_input(spark, navigation.n_drives(spark, sf))
    rows = rows.select("drive_id", *engine.INPUT)
    rows.repartition(6, F.floor(F.col("t") / 70)).write.parquet(folder)
    after = rows.where("t = 0").withColumns({"t": F.col("t") + 2000.0, "ts": F.col("ts") + F.expr("interval 2000 seconds")})
    after.coalesce(1).write.mode("append").parquet(folder)
    stream = relational.file_stream(spark, folder, rows.schema, files_per_trigger=2)
    out = relational.run_to_files(spark, engine.navigate(stream, navigation.CFG, "B", 10.0, "500 seconds"), new_folder(spark, "navigated"), checkpoint)
    remove(spark, folder)
    remove(spark, checkpoint)
    return out
