"""Synthetic drives as DataFrames: from a table of specifications by the numpy generator, or in the JVM without noise."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftframe.kernels import synthetic
from driftframe.schema import DRIVE

SPEC = "drive_id string, duration_s double, rate_hz double, seed long, mount_yaw_deg double, gyro_bias double, acc_bias double, grade double, acc_noise double, gyro_noise double, gnss_noise double"


def drives(specs: DataFrame) -> DataFrame:
    """Standard drive tables of specs (columns as in SPEC); a drive is made in one task, drives in parallel."""

    def f(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield synthetic.drive(
                    r.drive_id, r.duration_s, r.rate_hz, int(r.seed), r.acc_noise, r.gyro_noise, r.gnss_noise, mount_yaw_deg=r.mount_yaw_deg, gyro_bias=r.gyro_bias, acc_bias=r.acc_bias, grade=r.grade
                )[DRIVE.fieldNames()]

    made = specs.mapInPandas(f, DRIVE)
    doubles = [f.name for f in DRIVE if f.dataType.simpleString() == "double" and f.name != "t"]
    return made.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})


def specs(spark: SparkSession, count: int, duration_s: float = 420.0, rate_hz: float = 10.0, prefix: str = "d", **shape: float) -> DataFrame:
    """`count` specifications with seeds 0, 1, ... and mounts spread over the circle."""
    s = {"gyro_bias": 0.002, "acc_bias": 0.05, "grade": 0.0, "acc_noise": 0.05, "gyro_noise": 0.002, "gnss_noise": 1.0} | shape
    i = F.col("id")
    base = spark.range(count, numPartitions=max(1, min(count, 64)))
    return base.select(
        F.concat(F.lit(prefix), i).alias("drive_id"), F.lit(float(duration_s)).alias("duration_s"), F.lit(float(rate_hz)).alias("rate_hz"), i.alias("seed"), ((i * 47) % 360 - 180).cast("double").alias("mount_yaw_deg"),
        *(F.lit(float(s[k])).alias(k) for k in ("gyro_bias", "acc_bias", "grade", "acc_noise", "gyro_noise", "gnss_noise")),
    )


def truth_native(spark: SparkSession, count: int, duration_s: float, rate_hz: float) -> DataFrame:
    """(drive_id, i, t, speed, yaw, x, y) without noise, by column expressions alone; turns alternate sides."""
    n = int(round(duration_s * rate_hz))
    d = spark.range(count).select(F.col("id").alias("drive_id"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("t", F.col("i") / F.lit(float(rate_hz)))
    t, g = F.col("t"), synthetic
    cruise = F.lit(g.CRUISE)
    for a, p in g.WAVES:
        cruise = cruise + a * F.sin(2 * math.pi * t / p)
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.abs(t - g.STOP_AT * duration_s) - g.STOP_HALF) / g.STOP_RAMP))
    d = d.withColumn("speed", F.least(cruise, g.LAUNCH * t) * u * u * (3 - 2 * u))
    turn = F.lit(0.0)
    for k in range(g.n_turns(duration_s)):
        side = F.when((F.col("drive_id") + k) % 2 == 0, 1.0).otherwise(-1.0)
        off = F.abs(t - (g.TURN_FIRST + g.TURN_EVERY * k))
        turn = turn + F.when(off < g.TURN_LENGTH / 2, side * g.TURN_RATE * (0.5 + 0.5 * F.cos(2 * math.pi * off / g.TURN_LENGTH))).otherwise(0.0)
    d = d.withColumn("turn", F.when(F.col("speed") > 1, turn).otherwise(0.0))
    w = Window.partitionBy("drive_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("yaw", 0.3 + F.sum("turn").over(w) / rate_hz)
    return d.withColumns({"x": F.sum(F.col("speed") * F.cos("yaw")).over(w) / rate_hz, "y": F.sum(F.col("speed") * F.sin("yaw")).over(w) / rate_hz})


def resampled(d: DataFrame, keys: list[str], rate_hz: float, columns: list[str], gnss_hz: float, outages: list[tuple[float, float]]) -> DataFrame:
    """A drive on another clock: samples interpolated to rate_hz, a fix gnss_hz times a second, none inside the outages."""
    from driftframe.operators import align

    grid = align.resample(d, keys, "t", 1.0 / rate_hz)
    out = grid
    for c in columns:
        out = align.interpolate(out, d.select(*keys, "t", c), keys, "t", c, c, clamp=True)
    every = max(round(rate_hz / gnss_hz), 1)
    dark = F.lit(False)
    for a, b in outages:
        dark = dark | ((F.col("t") >= a) & (F.col("t") < b))
    return out.withColumn("gnss_healthy", (F.pmod(F.round(F.col("t") * rate_hz), F.lit(every)) == 0) & ~dark)


