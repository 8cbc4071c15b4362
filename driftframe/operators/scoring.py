"""Scores of outage windows and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.functions.geo import wrap

#: Variants in report order.
VARIANTS = ("A", "B", "C", "C+NHC", "D")


def window_scores(rows: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Scores per window of rows(keys, t, t_start, t_end, x, y, speed, yaw, disp_x, disp_y, true_x, true_y, true_speed, true_yaw).

    Inside is [t_start, t_end); the final error is that of the last inside row; moving is true speed above 2 m/s; the largest
    displayed step counts from 0.2 s before the end, the time back under 5 m from the end.
    """
    inside = (F.col(t) >= F.col("t_start")) & (F.col(t) < F.col("t_end"))
    err = F.hypot(F.col("x") - F.col("true_x"), F.col("y") - F.col("true_y"))
    herr = F.abs(wrap(F.col("yaw") - F.col("true_yaw")))
    near = F.col(t) >= F.col("t_end") - 0.2
    x = rows.withColumns({"in_": inside, "err_": err, "herr_": herr, "serr_": F.col("speed") - F.col("true_speed"), "near_": near})
    by_in, by_near = Window.partitionBy(*keys, "in_").orderBy(t), Window.partitionBy(*keys, "near_").orderBy(t)
    gap = lambda a, b, w: F.hypot(F.col(a) - F.lag(a).over(w), F.col(b) - F.lag(b).over(w))
    x = x.withColumns({"step_": gap("true_x", "true_y", by_in), "jump_": gap("disp_x", "disp_y", by_near)})
    only = lambda c: F.when(F.col("in_"), c)
    moving = F.col("in_") & (F.col("true_speed") > 2.0)
    g = x.groupBy(*keys).agg(
        F.coalesce(F.sum(only(F.col("step_"))), F.lit(0.0)).alias("distance_m"), F.max_by(only(F.col("err_")), only(F.col(t))).alias("final_error_m"), F.avg(only(F.col("err_"))).alias("mean_error_m"),
        F.sqrt(F.avg(only(F.col("err_") * F.col("err_")))).alias("rms_error_m"), F.max(only(F.col("err_"))).alias("worst_error_m"),
        F.sqrt(F.avg(only(F.col("serr_") * F.col("serr_")))).alias("speed_rms"), F.avg(only(F.abs("serr_"))).alias("speed_abs"),
        F.degrees(F.avg(F.when(moving, F.col("herr_")))).alias("heading_abs_deg"), F.degrees(F.max_by(only(F.col("herr_")), only(F.col(t)))).alias("heading_last_deg"),
        F.coalesce(F.max(F.when(F.col("near_"), F.col("jump_"))), F.lit(0.0)).alias("return_step_m"),
        F.min(F.when((F.col(t) >= F.col("t_end")) & (F.col("err_") < 5.0), F.col(t) - F.col("t_end"))).alias("return_time_s"),
    )
    return g.withColumn("drift_pct", F.when(F.col("distance_m") > 0, 100.0 * F.col("final_error_m") / F.col("distance_m")))


def variant_order(variant: Column) -> Column:
    """Place of a variant in reports; unknown ones last."""
    out = F.lit(len(VARIANTS))
    for i, v in enumerate(VARIANTS):
        out = F.when(variant == v, i).otherwise(out)
    return out


def summarise(scores: DataFrame) -> DataFrame:
    """Scores by duration and variant: count, means and medians, in report order."""
    g = scores.groupBy("duration_s", "variant").agg(
        F.count(F.lit(1)).alias("windows"), F.avg("distance_m").alias("distance_m"), F.median("drift_pct").alias("median_drift_pct"), F.avg("drift_pct").alias("mean_drift_pct"),
        F.median("final_error_m").alias("median_final_m"), F.median("mean_error_m").alias("median_error_m"), F.median("speed_rms").alias("speed_rms"),
        F.median("heading_abs_deg").alias("heading_abs_deg"), F.median("return_step_m").alias("return_step_m"),
    )
    return g.orderBy("duration_s", variant_order(F.col("variant")))


def verdict(summary: DataFrame, limit: float = 10.0) -> DataFrame:
    """summary with PASS or FAIL by its median drift."""
    return summary.withColumn("verdict", F.when(F.col("median_drift_pct") < limit, "PASS").otherwise("FAIL"))


def event_counts(events: DataFrame, keys: list[str], kinds: tuple[str, ...] = ("shock", "transient", "slip")) -> DataFrame:
    """Events by kind and series, zero where there are none of a kind."""
    return events.groupBy(*keys).agg(*(F.count_if(F.col("kind") == k).cast("long").alias(k) for k in kinds))


def update_counts(log: DataFrame, keys: list[str], t0: float, t1: float, accepted_only: bool = True) -> DataFrame:
    """Measurement updates by source in [t0, t1)."""
    x = log.where((F.col("t") >= t0) & (F.col("t") < t1))
    return (x.where("accepted") if accepted_only else x).groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("n"))


def rmse_mae(df: DataFrame, keys: list[str], error: Column) -> DataFrame:
    """Root mean square and mean absolute error and count."""
    return df.groupBy(*keys).agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.count(error).alias("n"))


def coverage(df: DataFrame, keys: list[str], error: Column, sigma: Column) -> DataFrame:
    """Share of errors within one and two sigma, and the factor that calibrates sigma."""
    z = F.try_divide(F.abs(error), sigma)
    return df.groupBy(*keys).agg(F.avg(F.when(z <= 1, 1.0).otherwise(0.0)).alias("share_1sd"), F.avg(F.when(z <= 2, 1.0).otherwise(0.0)).alias("share_2sd"), F.sqrt(F.avg(z * z)).alias("sd_factor"))


def markdown(df: DataFrame) -> str:
    """A small report as a Markdown table, floats with two places."""
    rows = df.collect()
    show = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"
