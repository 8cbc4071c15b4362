"""Row order: strictly increasing clocks, adjacent duplicates, gap sessions, frame audits.

Every function takes the keys of a series and an order column that makes its rows' order unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(keys: list[str], *order: str) -> WindowSpec:
    """The window of one series in order."""
    return Window.partitionBy(*keys).orderBy(*order)


def strictly_increasing(df: DataFrame, keys: list[str], t: str, order: str) -> DataFrame:
    """Rows whose t exceeds that of every row before them; null t, repeats and backward steps go."""
    before = F.max(t).over(series(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("before_", before).where(F.col(t).isNotNull() & (F.col("before_").isNull() | (F.col(t) > F.col("before_")))).drop("before_")


def adjacent_dedup(df: DataFrame, keys: list[str], t: str, order: str) -> DataFrame:
    """Rows whose t exceeds that of the row just before them in the table, kept or not; the first row stays."""
    w = series(keys, order)
    return df.withColumns({"before_": F.lag(t).over(w), "nth_": F.row_number().over(w)}).where((F.col("nth_") == 1) | (F.col(t) - F.col("before_") > 0)).drop("before_", "nth_")


def sessionize(df: DataFrame, keys: list[str], t: str, order: str, max_gap_s: float, into: str = "session") -> DataFrame:
    """A session number from 0 in each series; a gap strictly above max_gap_s begins the next."""
    w = series(keys, t, order)
    breaks = F.when(F.col(t) - F.lag(t).over(w) > max_gap_s, 1).otherwise(0)
    return df.withColumn("break_", breaks).withColumn(into, F.sum("break_").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("break_")


def valid_fix(lat: Column, lon: Column) -> Column:
    """Whether a fix is present and not the receiver's zero position."""
    return lat.isNotNull() & lon.isNotNull() & (F.abs(lat) > 1e-6)


def first_valid(df: DataFrame, keys: list[str], order: str, valid: Column, **columns: str) -> DataFrame:
    """Per series the named columns of its first valid row: a drive's origin."""
    return df.where(valid).groupBy(*keys).agg(*(F.min_by(c, order).alias(name) for name, c in columns.items()))


def keep_last(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """Of rows with equal keys, the last in order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if isinstance(order, str) else order.desc())
    return df.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def frame_audit(df: DataFrame, keys: list[str], t: str, order: str, signal: Column, session: str | None = None, labelled: Column | None = None) -> DataFrame:
    """Per series: rows, duration, clock checks, quantiles of the step, nulls and range of a signal, sessions, labelled share."""
    step = F.col(t) - F.lag(t).over(series(keys, order))
    x = df.withColumns({"step_": step, "signal_": signal, "label_": labelled if labelled is not None else F.lit(None).cast("boolean")})
    out = [
        F.count(F.lit(1)).alias("n_rows"), (F.max_by(t, order) - F.min_by(t, order)).alias("duration_s"), F.coalesce(F.bool_and(F.col("step_") > 0), F.lit(True)).alias("monotonic"),
        F.count_if(F.col("step_") == 0).alias("duplicates"), F.count_if(F.col("step_") < 0).alias("backwards"), F.median("step_").alias("dt_median"),
        F.percentile("step_", 0.01).alias("dt_p01"), F.percentile("step_", 0.99).alias("dt_p99"), F.count_if(F.col("step_") > 1.0).alias("gaps"),
        F.count_if(F.col("signal_").isNull()).alias("nulls"), F.median("signal_").alias("signal_median"), F.max(F.abs("signal_")).alias("signal_max"),
    ]
    if session:
        out.append(F.countDistinct(session).alias("sessions"))
    if labelled is not None:
        out.append(F.avg(F.when(F.col("label_"), 1.0).otherwise(0.0)).alias("labelled"))
    return x.groupBy(*keys).agg(*out)
