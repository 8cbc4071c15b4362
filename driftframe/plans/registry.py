"""The registry of queries: a name, a callable of (spark, sf_dir), and the same query in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.functions.geo import heading_to_yaw
from driftframe.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The drive adapter in SQL, as common table expressions to go on from.
DRIVE = r"""WITH raw_ AS (
  SELECT event_id, user_id AS drive_id, ts, event_type, value AS speed, CAST(regexp_extract(props, '"k": (\d+)', 1) AS INTEGER) AS k, epoch_us(ts) AS us FROM events),
 timed_ AS (SELECT *, (us - min(us) OVER (PARTITION BY drive_id)) / 1e6 AS t, 3.6e0 * k AS heading_deg, radians(90e0 - 3.6e0 * k) AS yaw,
  event_type <> 'error' AS valid, event_type IN ('view', 'click') AS healthy FROM raw_),
 drive AS (SELECT *, sum(speed * cos(yaw)) OVER w AS east, sum(speed * sin(yaw)) OVER w AS north FROM timed_ WINDOW w AS (PARTITION BY drive_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql may start with {DRIVE} (or, to recurse, {RDRIVE}) to build on the adapter."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql.replace("{RDRIVE}", DRIVE.replace("WITH", "WITH RECURSIVE", 1)).replace("{DRIVE}", DRIVE)
        return f

    return put


def r(x: Column | str, places: int = 6) -> Column:
    """Rounded for comparison between engines: a half is told on the scaled double, as rs() does, not on its decimal digits."""
    scale = float(10**places)
    return F.round((F.col(x) if isinstance(x, str) else x) * F.lit(scale)) / F.lit(scale)


def rs(x: str, places: int = 6) -> str:
    """r() in SQL; never minus zero."""
    return f"(round({x}, {places}) + 0::DOUBLE)"


def drive(spark: SparkSession, sf_dir: str, track: bool = True) -> DataFrame:
    """`events` as drives: a user is a drive, value its speed, k its heading, running sums of velocity its track."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    d = e.select("event_id", F.col("user_id").alias("drive_id"), "ts", "event_type", F.col("value").alias("speed"), F.regexp_extract("props", r'"k": (\d+)', 1).cast("int").alias("k"), us.alias("us"))
    d = d.withColumn("t", (F.col("us") - F.min("us").over(Window.partitionBy("drive_id"))) / F.lit(1e6)).withColumn("heading_deg", F.lit(3.6) * F.col("k"))
    d = d.withColumns({"yaw": heading_to_yaw(F.col("heading_deg")), "valid": F.col("event_type") != "error", "healthy": F.col("event_type").isin("view", "click")})
    if track:
        w = Window.partitionBy("drive_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumns({"east": F.sum(F.col("speed") * F.cos("yaw")).over(w), "north": F.sum(F.col("speed") * F.sin("yaw")).over(w)})
    return d
