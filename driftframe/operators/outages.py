"""Simulated outages: candidate windows, an even choice among them, slices, masks, truth kept apart, and the mode of a receiver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.operators.clean import series
from driftframe.schema import ESTIMATOR, estimator_input


def path_step(x: str, y: str, w) -> Column:
    """Distance from the row before; null at the first row and beside missing positions."""
    return F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))


def path_length(df: DataFrame, keys: list[str], x: str, y: str, t: str, order: str, into: str = "distance_m") -> DataFrame:
    """Per series the length of its track; steps with a missing end count nothing."""
    return df.withColumn("d_", path_step(x, y, series(keys, t, order))).groupBy(*keys).agg(F.coalesce(F.sum("d_"), F.lit(0.0)).alias(into))


def candidate_grid(sessions: DataFrame, keys: list[str], duration: float, warmup: float, post: float, least_step: float = 15.0) -> DataFrame:
    """Start times t0 + warmup, + step, ... below t1 - duration - post of sessions(keys, t0, t1); step max(duration / 2, least_step)."""
    step = max(duration / 2, least_step)
    first, stop = F.col("t0") + warmup, F.col("t1") - duration - post
    n = F.ceil((stop - first) / step).cast("long")
    grid = sessions.where(n > 0).withColumn("i_", F.explode(F.sequence(F.lit(0), n - 1)))
    start = first + F.col("i_") * F.lit(float(step))
    return grid.select(*keys, F.lit(float(duration)).alias("duration_s"), start.alias("t_start"), (start + duration).alias("t_end"))


def in_windows(df: DataFrame, windows: DataFrame, keys: list[str], t: str, before: float = 0.0, after: float = 0.0) -> DataFrame:
    """Range join: rows of df with every window [t_start - before, t_end + after) of their series that holds them."""
    w = windows.select(*(F.col(k).alias(f"w_{k}") for k in keys), *[c for c in windows.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys]
    on += [F.col(t) >= F.col("t_start") - before, F.col(t) < F.col("t_end") + after]
    return df.join(w, on).drop(*(f"w_{k}" for k in keys))


def eligible(df: DataFrame, windows: DataFrame, keys: list[str], t: str, order: str, warmup: float, post: float, rate_hz: float, min_distance: float, max_still: float, x: str = "ref_x", y: str = "ref_y", speed: str = "ref_speed", valid: str = "ref_valid") -> DataFrame:
    """Windows whose whole slice is labelled, that hold 90 % of the expected rows, enough distance and little standing."""
    wide = in_windows(df, windows, keys, t, warmup, post)
    inside = (F.col(t) >= F.col("t_start")) & (F.col(t) < F.col("t_end"))
    w = Window.partitionBy(*keys, "duration_s", "t_start", "in_").orderBy(t, order)
    wide = wide.withColumn("in_", inside).withColumn("d_", path_step(x, y, w))
    g = wide.groupBy(*keys, "duration_s", "t_start", "t_end").agg(
        F.bool_and(F.coalesce(F.col(valid), F.lit(False))).alias("all_"), F.count_if("in_").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("in_"), F.col("d_"))), F.lit(0.0)).alias("distance_m"),
        F.avg(F.when(F.col("in_"), F.when(F.col(speed) < 0.5, 1.0).otherwise(0.0))).alias("still_frac"),
    )
    good = F.col("all_") & (F.col("n_rows") >= 0.9 * F.col("duration_s") * rate_hz) & (F.col("distance_m") >= min_distance) & (F.col("still_frac") <= max_still)
    return g.where(good).drop("all_")


def evenly_spread(windows: DataFrame, keys: list[str], count: int, *order: str) -> DataFrame:
    """Of each group's n windows in order, those at round(i (n - 1) / (k - 1)), k = min(count, n), halves to even."""
    by = Window.partitionBy(*keys)
    ranked = windows.withColumns({"r_": F.row_number().over(by.orderBy(*order)) - 1, "n_": F.count(F.lit(1)).over(by)})
    k = F.least(F.lit(count), F.col("n_")).cast("long")
    at = F.when(k > 1, F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.rint(i * (F.col("n_") - 1) / (k - 1)))).otherwise(F.array(F.lit(0.0)))
    return ranked.where(F.array_contains(at, F.col("r_").cast("double"))).drop("r_", "n_")


def mask(df: DataFrame, inside: Column) -> DataFrame:
    """df as an estimator may see it: satellite columns null and unhealthy inside the outage, no truth columns at all."""
    out = df.select(*(c for c in df.columns if c in ESTIMATOR or c in ("t_start", "t_end", "duration_s", "window_id")))
    for c in ("gnss_x", "gnss_y", "gnss_speed", "gnss_yaw", "gnss_std"):
        if c in out.columns:
            out = out.withColumn(c, F.when(~inside, F.col(c)))
    out = out.withColumn("gnss_healthy", F.coalesce(F.col("gnss_healthy"), F.lit(False)) & ~inside)
    return estimator_input(out, ("t_start", "t_end", "duration_s", "window_id"))


def truth(df: DataFrame, keys: list[str]) -> DataFrame:
    """The hidden track, for scoring only."""
    return df.select(*keys, "t", F.col("ref_x").alias("true_x"), F.col("ref_y").alias("true_y"), F.col("ref_speed").alias("true_speed"), F.col("ref_yaw").alias("true_yaw"), F.col("ref_valid").alias("true_valid"))


def mode(df: DataFrame, keys: list[str], t: str, order: str, fix: Column, timeout_s: float, start: Column, into: str = "mode") -> DataFrame:
    """Receiver mode of each row: waiting before the first usable fix, satellite while the last fix is at most timeout_s old, else dead reckoning."""
    w = series(keys, t, order).rowsBetween(Window.unboundedPreceding, 0)
    begun = F.min(F.when(fix & start, F.col(t))).over(w)
    last = F.last(F.when(fix, F.col(t)), ignorenulls=True).over(w)
    return df.withColumns({"begun_": begun, "last_": last}).withColumn(
        into, F.when(F.col("begun_").isNull(), "WAITING FOR GNSS").when(F.col(t) - F.greatest("last_", "begun_") <= timeout_s, "GNSS+INS").otherwise("DEAD RECKONING")
    ).drop("begun_", "last_")
