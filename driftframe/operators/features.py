"""Rolling statistics, label runs, sliding sequences, decimation and linear recurrences over ordered series."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.operators.clean import series


def _deviation(values: Column) -> Column:
    """Sample standard deviation of an array by Welford's recurrence, oldest first; null under two values. The engine's own aggregate takes
    the same sum of squares by another recurrence, and a last bit decides where a deviation lies on a threshold."""

    def add(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares"))

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    return F.aggregate(values, zero, add, lambda s: F.when(s["n"] > 1, F.sqrt(s["squares"] / (s["n"] - 1))))


def rolling(column: str, w, n: int, how: str, partial: bool = False) -> Column:
    """std, mean, max or min over the last n rows; null until there are n unless partial."""
    over = w.rowsBetween(-(n - 1), 0)
    if how == "std":
        value = _deviation(F.collect_list(F.col(column).cast("double")).over(over))
    else:
        value = {"mean": F.avg, "max": F.max, "min": F.min}[how](column).over(over)
    return value if partial else F.when(F.count(column).over(over) == n, value)


def rolling_before(column: str, w, n: int) -> Column:
    """Mean of the n rows before the current one; null until there are n."""
    over = w.rowsBetween(-n, -1)
    return F.when(F.count(column).over(over) == n, F.avg(column).over(over))


def stationary(df: DataFrame, keys: list[str], acc: str, gyro: str, n: int, acc_std: float, gyro_std: float, gyro_mean: float, *order: str, into: str = "still") -> DataFrame:
    """Whether the last n rows were still by norm of acceleration and rotation; false until there are n."""
    w = series(keys, *order)
    test = (rolling(acc, w, n, "std") < acc_std) & (rolling(gyro, w, n, "std") < gyro_std) & (rolling(gyro, w, n, "mean") < gyro_mean)
    return df.withColumn(into, F.coalesce(test, F.lit(False)))


def straight(df: DataFrame, keys: list[str], gyro: str, n: int, limit: float, *order: str, into: str = "straight") -> DataFrame:
    """Whether no rotation in the last n rows reached the limit."""
    return df.withColumn(into, rolling(gyro, series(keys, *order), n, "max", partial=True) < limit)


def label_runs(df: DataFrame, keys: list[str], valid: Column, *order: str, into: str = "run") -> DataFrame:
    """How many labelled rows end at each row without a break."""
    w = series(keys, *order)
    x = df.withColumn("ok_", F.coalesce(valid, F.lit(False)))
    x = x.withColumn("island_", F.sum(F.when(F.col("ok_"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.sum(F.when(F.col("ok_"), 1).otherwise(0)).over(Window.partitionBy(*keys, "island_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn(into, F.when(F.col("ok_"), nth).otherwise(0).cast("int")).drop("ok_", "island_")


def sequence_ends(df: DataFrame, keys: list[str], valid: Column, window: int, stride: int, *order: str) -> DataFrame:
    """Rows that end a wholly labelled window, every stride-th of them in each series."""
    ends = label_runs(df, keys, valid, *order, into="run_").where(F.col("run_") >= window)
    return ends.withColumn("nth_", F.row_number().over(series(keys, *order)) - 1).where(F.col("nth_") % stride == 0).drop("run_", "nth_")


def sequences(df: DataFrame, keys: list[str], columns: list[str], window: int, stride: int, valid: Column, *order: str, into: str = "seq") -> DataFrame:
    """Rows of sequence_ends() with the last `window` rows' columns as an array of structs, oldest first."""
    w = series(keys, *order).rowsBetween(-(window - 1), 0)
    x = df.withColumn(into, F.collect_list(F.struct(*columns)).over(w))
    return sequence_ends(x, keys, valid, window, stride, *order).where(F.size(into) == window)


def decimate(df: DataFrame, keys: list[str], columns: list[str], k: int, *order: str) -> DataFrame:
    """Means of blocks of k rows; a last block that is not full goes."""
    nth = F.row_number().over(series(keys, *order)) - 1
    x = df.withColumn("block", F.floor(nth / k).cast("long"))
    return x.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n_"), *(F.avg(c).alias(c) for c in columns)).where(F.col("n_") == k).drop("n_")


def thin(df: DataFrame, keys: list[str], k: int, *order: str) -> DataFrame:
    """Every k-th row of each series, from the first."""
    return df.withColumn("nth_", F.row_number().over(series(keys, *order)) - 1).where(F.col("nth_") % k == 0).drop("nth_")


def upper_median(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row in the middle of each group in order; of two middle ones the later."""
    by = Window.partitionBy(*keys)
    x = df.withColumns({"nth_": F.row_number().over(by.orderBy(*order)), "n_": F.count(F.lit(1)).over(by)})
    return x.where(F.col("nth_") == F.floor(F.col("n_") / 2) + 1).drop("nth_", "n_")


def scan(df: DataFrame, keys: list[str], order: list[str], columns: list[str], walk: Callable[..., list[float]], into: str) -> DataFrame:
    """A value carried along each series: walk() takes the columns of a series in order, as lists, and gives a value for each row, in one
    pass. Rows come back with it; a series is the unit of parallelism. NaN and null are one, and come back as null."""
    kept = [*keys, *order, *(c for c in columns if c not in order)]
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", `{into}` double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(**{into: walk(*(pdf[c].to_numpy(float).tolist() for c in columns))})

    out = df.select(*kept).groupBy(*keys).applyInPandas(one, schema)
    return out.withColumn(into, F.when(~F.isnan(into), F.col(into)))


def biquad(cutoff_hz: float, rate_hz: float) -> tuple[float, float, float, float, float]:
    """b0, b1, b2, a1, a2 of a second-order Butterworth low-pass by the bilinear transform; cutoff at most 0.45 of the rate."""
    k = math.tan(math.pi * min(cutoff_hz, 0.45 * rate_hz) / rate_hz)
    n = 1 / (1 + math.sqrt(2) * k + k * k)
    return k * k * n, 2 * k * k * n, k * k * n, 2 * (k * k - 1) * n, (1 - math.sqrt(2) * k + k * k) * n


def ema(df: DataFrame, keys: list[str], order: list[str], x: str, dt: str, into: str) -> DataFrame:
    """Exponential mean with gain min(dt, 1), from the first value on."""

    def walk(values: list[float], steps: list[float]) -> list[float]:
        mean, out = values[0], []
        for i, (v, step) in enumerate(zip(values, steps, strict=True)):
            mean += (min(step, 1.0) if i and step == step else 0.0) * (v - mean)
            out.append(mean)
        return out

    return scan(df, keys, order, [x, dt], walk, into)


def low_pass(df: DataFrame, keys: list[str], order: list[str], x: str, cutoff_hz: float, rate_hz: float, into: str) -> DataFrame:
    """Causal Butterworth low-pass of each series, primed so that a constant passes unchanged from the first row."""
    b0, b1, b2, a1, a2 = biquad(cutoff_hz, rate_hz)

    def walk(values: list[float]) -> list[float]:
        second = (b2 - a2) * values[0]
        first, out = (b1 - a1) * values[0] + second, []
        for v in values:
            y = b0 * v + first
            first, second = b1 * v - a1 * y + second, b2 * v - a2 * y
            out.append(y)
        return out

    return scan(df, keys, order, [x], walk, into)
