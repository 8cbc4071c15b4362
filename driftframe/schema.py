"""Closed schemas, column roles and the guards that keep truth away from estimators. Guards work on plans, before any row is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The standard drive table by role.
IMU = ("ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz")
GNSS = ("gnss_x", "gnss_y", "gnss_speed", "gnss_yaw", "gnss_std", "gnss_healthy")
REFERENCE = ("ref_x", "ref_y", "ref_lat", "ref_lon", "ref_speed", "ref_yaw", "ref_yaw_rate", "ref_wheel_speed", "ref_valid")
META = ("drive_id", "session", "t")
FORBIDDEN = ("gnss", "gps", "lat", "lon", "ref_", "speed", "x", "y", "pos")


class LeakageError(AssertionError):
    """Truth or masked values would reach an estimator."""


def _field(name: str) -> T.StructField:
    role = "imu" if name in IMU else "gnss" if name in GNSS else "reference" if name in REFERENCE else "meta"
    kind = {"drive_id": T.StringType(), "session": T.IntegerType(), "gnss_healthy": T.BooleanType(), "ref_valid": T.BooleanType()}.get(name, T.DoubleType())
    return T.StructField(name, kind, True, {"role": role, "during_blackout": {"meta": "yes", "imu": "yes", "gnss": "only while healthy", "reference": "never"}[role]})


DRIVE = T.StructType([_field(n) for n in (*META, *IMU, *GNSS, *REFERENCE)])
ESTIMATOR = tuple((*META, *IMU, *GNSS))


def role_report(spark, schema: T.StructType = DRIVE) -> DataFrame:
    """(column, type, role, allowed) of a schema from its field metadata."""
    rows = [(f.name, f.dataType.simpleString(), f.metadata.get("role", ""), f.metadata.get("during_blackout", "")) for f in schema]
    return spark.createDataFrame(rows, "column string, type string, role string, allowed string")


def estimator_input(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """df, refused if it has any column beyond what an estimator may see."""
    bad = [c for c in df.columns if c not in ESTIMATOR and c not in extra]
    if bad:
        raise LeakageError(f"an estimator may not see {bad}")
    return df


def model_features(names: list[str]) -> list[str]:
    """names, refused if one of them is no motion feature."""
    allowed = {"a_f", "a_l", "a_u", "w_f", "w_l", "w_u", "w_h"}
    bad = [n for n in names if n not in allowed or any(n.lower() == f or (len(f) > 1 and f in n.lower()) for f in FORBIDDEN)]
    if bad:
        raise LeakageError(f"not allowed as model features: {bad}")
    return list(names)


def tampered(masked: DataFrame, inside) -> DataFrame:
    """Rows inside an outage whose satellite values are not masked; empty if the mask holds."""
    present = F.lit(False)
    for c in ("gnss_x", "gnss_y", "gnss_speed", "gnss_yaw"):
        if c in masked.columns:
            present = present | F.col(c).isNotNull()
    return masked.where(inside & (F.coalesce(F.col("gnss_healthy"), F.lit(False)) | present))
