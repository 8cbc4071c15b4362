"""Time alignment: as-of and interpolation joins without range blow-up, lag search, piecewise sync, unwrapping, gradients.

As-of joins are a union of both sides and one ordered window over it: O(n log n), no pair of rows outside the bracket is made.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.functions.geo import TWO_PI
from driftframe.operators.clean import series


def _stacked(left: DataFrame, right: DataFrame, keys: list[str], t: str, values: list[str], left_first: bool) -> DataFrame:
    """Both sides as rows of one table: rt_ and rv_ (an array of values) of right rows, is_left_ for left ones."""
    side = (0, 1) if left_first else (1, 0)
    a = left.withColumns({"side_": F.lit(side[0]), "rt_": F.lit(None).cast("double"), "rv_": F.lit(None).cast("array<double>"), "is_left_": F.lit(True)})
    b = right.select(*keys, t, F.lit(side[1]).alias("side_"), F.col(t).cast("double").alias("rt_"), F.array(*(F.col(v).cast("double") for v in values)).alias("rv_"), F.lit(False).alias("is_left_"))
    return a.unionByName(b, allowMissingColumns=True)


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: str, into: str, max_age: float | None = None) -> DataFrame:
    """left with the value of the last row of right at or before its t (one right row per key and t), null if older than max_age."""
    both = _stacked(left, right, keys, t, [value], left_first=False)
    past = Window.partitionBy(*keys).orderBy(t, "side_").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(~F.col("is_left_"), F.struct("rt_", "rv_")), ignorenulls=True).over(past)
    out = both.withColumn("m_", last).where("is_left_")
    fresh = F.lit(True) if max_age is None else (F.col(t) - F.col("m_.rt_") <= max_age)
    return out.withColumn(into, F.when(fresh, F.col("m_.rv_")[0])).drop("m_", "side_", "rt_", "rv_", "is_left_")


def interpolate(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: str | list[str], into: str | list[str], max_gap: float | None = None, clamp: bool = False, look_ahead: bool = True) -> DataFrame:
    """left with right's value (or several) interpolated linearly at its t.

    The bracket is the last right row strictly before t and the first at or after it. clamp holds the ends' values outside
    right's range; otherwise the value is null there. max_gap makes it null where the bracket is wider; at an exact hit the
    bracket on its left counts, or at right's first row the one after it; without look_ahead there is none there, and max_gap
    makes the value null.
    """
    values, names = ([value], [into]) if isinstance(value, str) else (value, into)
    both = _stacked(left, right, keys, t, values, left_first=True)
    look_ahead = look_ahead and max_gap is not None
    if look_ahead:
        both = both.withColumn("rt2_", F.when(~F.col("is_left_"), F.lead("rt_").over(Window.partitionBy(*keys, "is_left_").orderBy(t))))
    # the next row is the last one of the reversed order: a frame that follows the row would be read anew for each row
    past = lambda *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    right_row = ~F.col("is_left_")
    ahead = F.struct("rt_", "rv_", "rt2_") if look_ahead else F.struct("rt_", "rv_")
    both = both.withColumns({
        "p_": F.last(F.when(right_row, F.struct("rt_", "rv_")), ignorenulls=True).over(past(F.asc(t), F.asc("side_"))),
        "n_": F.last(F.when(right_row, ahead), ignorenulls=True).over(past(F.desc(t), F.desc("side_"))),
    }).where("is_left_")
    share = (F.col(t) - F.col("p_.rt_")) / (F.col("n_.rt_") - F.col("p_.rt_"))
    out = {}
    for i, name in enumerate(names):
        before, after = F.col("p_.rv_")[i], F.col("n_.rv_")[i]
        result = F.when(F.col("n_.rt_") == F.col(t), after).when(F.col("p_").isNotNull() & F.col("n_").isNotNull(), before + (after - before) * share)
        if clamp:
            result = F.coalesce(result, after, before)
        if look_ahead:
            width = F.when(F.col("p_").isNotNull(), F.col("n_.rt_") - F.col("p_.rt_")).otherwise(F.col("n_.rt2_") - F.col("n_.rt_"))
            result = F.when(F.coalesce(width, F.lit(0.0)) <= max_gap, result)
        elif max_gap is not None:
            result = F.when(F.col("n_.rt_") - F.col("p_.rt_") <= max_gap, result)
        out[name] = result
    return both.withColumns(out).drop("p_", "n_", "rt2_", "side_", "rt_", "rv_", "is_left_")


def nearest_time(df: DataFrame, keys: list[str], t: str, at: float, value: str, into: str) -> DataFrame:
    """Per series the value of the row nearest to a time; of two equally near, the earlier."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(F.abs(F.col(t) - at), F.col(t))).alias(into))


def correlation(a: str, b: str, least: int = 10) -> Column:
    """Pearson correlation; 0 under `least` rows or for a flat signal."""
    flat = (F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)) < least) | (F.stddev_pop(a) < 1e-9) | (F.stddev_pop(b) < 1e-9)
    return F.when(flat, 0.0).otherwise(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def unwrap(df: DataFrame, keys: list[str], angle: str, *order: str, into: str) -> DataFrame:
    """An angle without jumps of over half a turn: corrections of full turns, summed up along the series."""
    w = series(keys, *order)
    step = F.col(angle) - F.lag(angle).over(w)
    short = step - F.lit(TWO_PI) * F.floor((step + math.pi) / TWO_PI)
    # a step of exactly half a turn keeps its sign
    short = F.when((short == -math.pi) & (step > 0), F.lit(math.pi)).otherwise(short)
    fix = F.coalesce(F.when(F.abs(step) >= math.pi, short - step), F.lit(0.0))
    return df.withColumn("fix_", fix).withColumn(into, F.col(angle) + F.sum("fix_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fix_")


def gradient(df: DataFrame, keys: list[str], t: str, x: str, order: str, into: str) -> DataFrame:
    """Derivative by central differences weighted for uneven steps, one-sided at the ends and beside equal times; null for a single row."""
    w = series(keys, t, order)
    before, after = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    left, right = F.try_divide(F.col(x) - F.lag(x).over(w), before), F.try_divide(F.lead(x).over(w) - F.col(x), after)
    return df.withColumns({"hb_": before, "ha_": after, "l_": left, "r_": right}).withColumn(
        into, F.when(F.col("l_").isNull(), F.col("r_")).when(F.col("r_").isNull(), F.col("l_")).otherwise(F.try_divide(F.col("ha_") * F.col("l_") + F.col("hb_") * F.col("r_"), F.col("hb_") + F.col("ha_")))
    ).drop("hb_", "ha_", "l_", "r_")


def resample(df: DataFrame, keys: list[str], t: str, step: float) -> DataFrame:
    """A regular grid (keys, t) from each series' first time to before its last."""
    ends = df.groupBy(*keys).agg(F.min(t).alias("lo_"), F.max(t).alias("hi_"))
    n = F.ceil((F.col("hi_") - F.col("lo_")) / step).cast("long")
    grid = ends.where(n > 0).withColumn("i_", F.explode(F.sequence(F.lit(0), n - 1)))
    return grid.select(*keys, (F.col("lo_") + F.col("i_") * F.lit(float(step))).alias(t))


def lag_search(a: DataFrame, b: DataFrame, keys: list[str], t: str, value: str, max_lag: float, step: float, overlap: float = 0.8, least: int = 50) -> DataFrame:
    """Per series the clock offset o that maximises the correlation of a(t) with b(t - o): keys, offset, corr.

    a is given on its grid; b is interpolated at every candidate. a is standardised over its whole grid, b over the overlap,
    which must hold at least `overlap` of the grid; of equal correlations (to 9 places) the first candidate wins. Each side is shuffled
    once; a series' candidates, whose number is a parameter, are scored one after the other on its sorted arrays.
    """
    n = int(math.floor(2 * max_lag / step + 0.5)) + 1
    kinds = dict(a.dtypes)

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.dropna(), right.dropna().sort_values("bt_", kind="stable")
        ta, x = left[t].to_numpy(float), left[value].to_numpy(float)
        tb, y = right["bt_"].to_numpy(float), right["bv_"].to_numpy(float)
        best: tuple[float, float, float] | None = None
        top = -math.inf
        if len(ta) >= least and len(tb):
            z = (x - x.mean()) / (x.std() + 1e-9)
            for i in range(n):
                lag = -float(max_lag) + i * float(step)
                at = ta - lag
                inside = (at >= tb[0]) & (at <= tb[-1])
                if not inside.any() or inside.sum() < overlap * len(ta):
                    continue
                there = np.interp(at[inside], tb, y)
                spread = there.std()
                if spread < 1e-9:
                    continue
                c = float(((z[inside] * there).mean() - z[inside].mean() * there.mean()) / spread)
                top = max(top, c)
                if best is None or round(c, 9) > best[1]:
                    best = (lag, round(c, 9), c)
        columns = [*keys, "offset", "corr"]
        return pd.DataFrame([[*key, best[0], top]] if best else [], columns=columns)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", offset double, corr double"
    # the right side's columns have names of their own: both sides may stem from one table
    right = b.select(*(F.col(k).alias(f"b_{k}_") for k in keys), F.col(t).alias("bt_"), F.col(value).alias("bv_"))
    return a.select(*keys, t, value).groupBy(*keys).cogroup(right.groupBy(*(f"b_{k}_" for k in keys))).applyInPandas(one, schema)


def sync_report(segments: DataFrame, keys: list[str], segment: str, min_corr: float = 0.5, drift: float = 1.0, strong: float = 0.85, agree: float = 0.5) -> DataFrame:
    """segments(keys, segment, offset, corr, informative) with consensus, passed, rescued and ok.

    A segment passes by its correlation and information; one that departs from its series' median offset by over `drift` only
    if its correlation is `strong`. One that doesn't pass is rescued between passing neighbours that agree.
    """
    by = Window.partitionBy(*keys)
    earlier = lambda order: by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    first = segments.withColumn("p0_", (F.col("corr") >= min_corr) & F.col("informative"))
    first = first.withColumn("consensus", F.median(F.when(F.col("p0_"), F.col("offset"))).over(by))
    first = first.withColumn("passed", F.col("p0_") & ~((F.abs(F.col("offset") - F.col("consensus")) > drift) & (F.col("corr") < strong)))
    mark = F.when(F.col("passed"), F.col("offset"))
    first = first.withColumns({
        "before_": F.last(mark, ignorenulls=True).over(earlier(F.asc(segment))),
        "after_": F.last(mark, ignorenulls=True).over(earlier(F.desc(segment))),
    })
    rescued = ~F.col("passed") & F.coalesce(F.abs(F.col("before_") - F.col("after_")) < agree, F.lit(False))
    return first.withColumn("rescued", rescued).withColumn("ok", F.col("passed") | F.col("rescued")).drop("p0_", "before_", "after_")
