"""Calibration by grouped sums: plane rotation fits, masked means with fallbacks, speed aids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plane_rotation(df: DataFrame, keys: list[str], hx: str, hy: str, ex: str, ey: str, into: str = "theta") -> DataFrame:
    """Per group the rotation angle that best takes centred vectors h onto centred vectors e (least squares)."""
    n = F.count(F.lit(1))
    cross = F.covar_pop(hx, ey) * n - F.covar_pop(hy, ex) * n
    dot = F.covar_pop(hx, ex) * n + F.covar_pop(hy, ey) * n
    return df.groupBy(*keys).agg(F.atan2(cross, dot).alias(into))


def masked_mean(column: str, masks: list[tuple[Column, float]]) -> Column:
    """Mean over the first mask that more rows than its limit pass; over all rows if none does."""
    out = F.avg(column)
    for m, least in reversed(masks):
        out = F.when(F.count_if(m) > least, F.avg(F.when(m, F.col(column)))).otherwise(out)
    return out


def speed_aid(speed: str, healthy: str) -> Column:
    """Satellite speed where the receiver is healthy, else null."""
    return F.when(F.col(healthy), F.col(speed))
