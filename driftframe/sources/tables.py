"""Raw logs to standard drive tables: manifests, phone and vehicle CSV files, conformed and aligned."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftframe.functions import geo
from driftframe.kernels.sync import offsets
from driftframe.operators import align, clean
from driftframe.runtime import sized
from driftframe.schema import DRIVE

#: Headers of the raw logs (name and unit), and of the manifest.
PHONE = {
    "date": "DATE(YYYY-MO-DD HH-MI-SS_SSS)", "lat": "LATITUDE (degrees)", "lon": "LONGITUDE (degrees)", "speed": "SPEED (Kmh)", "accuracy": "ACCURACY (m)", "course": "ORIENTATION (degrees)",
    "ex": "ACCELEROMETER X (m/s2)", "ey": "ACCELEROMETER Y (m/s2)", "az": "ACCELEROMETER Z (m/s2)", "mx": "MAGNETIC FIELD X (uT)", "my": "MAGNETIC FIELD Y (uT)", "mz": "MAGNETIC FIELD Z (uT)",
    "gx": "GYROSCOPE Roll (rad/s)", "gy": "GYROSCOPE Yaw (rad/s)", "gz": "GYROSCOPE Pitch (rad/s)", "azimuth": "ORIENTATION Yaw (degrees)",
}
VEHICLE = {"t": "TIME (s)", "lat": "LATITUDE (degrees)", "lon": "LONGITUDE (degrees)", "kmh": "VELOCITY (km/h)", "heading": "HEADING (degrees)", "yaw_rate": "YAW RATE (deg/s)", "wheel": "INDICATED SPEED (km/h)"}
MANIFEST = "drive_id string, driver string, `group` string, s_path string, v_path string, s_bytes long, v_bytes long, s_sha256 string, v_sha256 string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("header", True).csv(path)


def column_key(header: str) -> str:
    """A header without case, marks or the wrong bytes of mixed encodings: its letters and digits, and three letters of its unit."""
    name, _, unit = header.partition("(")
    return re.sub(r"[^A-Z0-9]", "", name.upper()) + "|" + re.sub(r"[^a-z]", "", (unit or name).lower())[:3]


def _name(header: str) -> str:
    """The part of a key that no encoding touches."""
    return column_key(header).partition("|")[0]


def raw(spark: SparkSession, path: str, wanted: dict[str, str], drive_id: str) -> DataFrame:
    """Columns of a Latin-1 CSV file by canonical header, as text, with drive_id and the row's place `ord`.

    Of headers with one and the same key the first counts; Spark's renaming of repeated headers is undone by position.
    """
    first = spark.read.option("encoding", "ISO-8859-1").text(path).first()
    headers = [h.strip().strip('"') for h in first[0].split(",")] if first else []
    place: dict[str, int] = {}
    for i, h in enumerate(headers):
        place.setdefault(column_key(h), i)
    for i, h in enumerate(headers):  # a unit sign that an encoding has lost leaves the name
        place.setdefault(_name(h), i)
    at = lambda h: place.get(column_key(h), place.get(_name(h)))
    df = spark.read.option("encoding", "ISO-8859-1").option("header", True).csv(path).toDF(*(f"c{i}" for i in range(len(headers))))
    missing = [h for h in wanted.values() if at(h) is None]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    ids = F.monotonically_increasing_id()
    return df.select(F.lit(drive_id).alias("drive_id"), ids.alias("ord"), *(F.trim(F.col(f"c{at(h)}")).alias(n) for n, h in wanted.items()))


def _numbers(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.nanvl(F.col(n).try_cast("double"), F.lit(None).cast("double")) for n in names})


def phone_rows(phone: DataFrame, max_gap_s: float) -> DataFrame:
    """Phone rows with a strictly increasing clock t_abs (seconds of the day), t from 0, sessions, body-frame accelerometer."""
    p = _numbers(phone, [n for n in PHONE if n != "date"]).withColumn("t_abs", geo.time_of_day_s(F.col("date"))).drop("date")
    p = p.withColumn("nth", F.row_number().over(clean.series(["drive_id"], "ord")))
    p = clean.strictly_increasing(p, ["drive_id"], "t_abs", "ord")
    p = p.withColumn("t", F.col("t_abs") - F.min("t_abs").over(Window.partitionBy("drive_id")))
    ax, ay = geo.rotate_xy(F.col("ex"), F.col("ey"), F.radians("azimuth"))
    return clean.sessionize(p.withColumns({"ax": ax, "ay": ay}), ["drive_id"], "t", "ord", max_gap_s)


def vehicle_rows(vehicle: DataFrame) -> DataFrame:
    """Vehicle rows whose clock moved on from the row before, in SI units, heading unwrapped."""
    v = _numbers(vehicle, list(VEHICLE)).withColumn("nth", F.row_number().over(clean.series(["drive_id"], "ord")))
    v = clean.adjacent_dedup(v, ["drive_id"], "t", "ord")
    v = v.withColumns({"speed": geo.kmh_to_ms(F.col("kmh")), "wheel": geo.kmh_to_ms(F.col("wheel")), "yaw_rate": F.radians("yaw_rate"), "turned": F.radians("heading")})
    return align.unwrap(v, ["drive_id"], "turned", "ord", into="heading_u")


def synchronised(phone: DataFrame, vehicle: DataFrame, paired: DataFrame, sync: dict) -> DataFrame:
    """phone rows with tq (their time on the vehicle's clock) and labelled; a drive's signals meet in one task."""

    def one(key: tuple, p: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        p, v = p.sort_values("ord"), v.sort_values("t")
        if not len(p) or len(v) < 2:
            return pd.DataFrame(columns=["drive_id", "ord", "tq", "labelled"])
        t = p["t_abs"].to_numpy(float)
        o, ok, _ = offsets(t, np.nan_to_num(p["gz"].to_numpy(float)), v["t"].to_numpy(float), np.nan_to_num(v["yaw_rate"].to_numpy(float)), p["paired"].to_numpy(float), p["session"].to_numpy(), sync)
        return pd.DataFrame({"drive_id": p["drive_id"], "ord": p["ord"], "tq": t - o, "labelled": ok})

    left = phone.join(paired, ["drive_id", "nth"], "left").select("drive_id", "ord", "t_abs", "gz", "session", (F.col("t_abs") - F.col("t_paired")).alias("paired"))
    found = left.groupBy("drive_id").cogroup(vehicle.select("drive_id", "t", "yaw_rate").groupBy("drive_id")).applyInPandas(one, "drive_id string, ord long, tq double, labelled boolean")
    return phone.join(found, ["drive_id", "ord"])


def standardise(phone: DataFrame, vehicle: DataFrame, cfg: dict, gnss_source: str = "vehicle") -> DataFrame:
    """The standard drive table (schema.DRIVE) of raw(phone) and raw(vehicle) rows of any number of drives."""
    p, v = phone_rows(phone, cfg["data"]["max_gap_s"]), vehicle_rows(vehicle)
    rows = _numbers(vehicle.select("drive_id", "ord", "t"), ["t"]).select("drive_id", F.row_number().over(clean.series(["drive_id"], "ord")).alias("nth"), F.col("t").alias("t_paired"))
    s = synchronised(p, v, rows, cfg["data"]["sync"])
    values = ["lat", "lon", "heading_u", "speed", "wheel", "yaw_rate"]
    names = ["ref_lat", "ref_lon", "heading_r", "ref_speed", "ref_wheel_speed", "ref_yaw_rate"]
    s = s.withColumnRenamed("t", "t_rel").withColumnRenamed("tq", "t")
    s = align.interpolate(s, v.select("drive_id", "t", *values), ["drive_id"], "t", values, names, max_gap=0.5).drop("t").withColumnRenamed("t_rel", "t")
    s = s.withColumn("fix_ok", clean.valid_fix(F.col("ref_lat"), F.col("ref_lon")))
    origin = clean.first_valid(s, ["drive_id"], "t", F.col("fix_ok"), lat0="ref_lat", lon0="ref_lon")
    s = s.join(sized(origin), "drive_id")
    x, y = geo.east_north(F.col("ref_lat"), F.col("ref_lon"), F.col("lat0"), F.col("lon0"))
    s = s.withColumns({"ref_x": x, "ref_y": y, "ref_yaw": geo.wrap(F.lit(np.pi / 2) - F.col("heading_r")), "ref_valid": F.col("labelled") & F.col("fix_ok") & F.col("ref_speed").isNotNull()})
    if gnss_source == "vehicle":
        g = {"gnss_x": F.col("ref_x"), "gnss_y": F.col("ref_y"), "gnss_speed": F.col("ref_speed"), "gnss_yaw": F.col("ref_yaw"), "gnss_std": F.lit(float(cfg["filter"]["gnss_pos_sigma"])), "gnss_healthy": F.col("ref_valid")}
    else:
        gx, gy = geo.east_north(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
        # the phone's speed column says km/h and holds m/s
        g = {"gnss_x": gx, "gnss_y": gy, "gnss_speed": F.col("speed"), "gnss_yaw": geo.heading_to_yaw(F.col("course")), "gnss_std": geo.at_least(F.col("accuracy"), 2.0), "gnss_healthy": clean.valid_fix(F.col("lat"), F.col("lon"))}
    return s.withColumns(g).select(*(F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in DRIVE))


def save_drives(df: DataFrame, path: str) -> None:
    """Standard tables as Parquet, a folder for each drive, so that later reads prune to the drives asked for."""
    df.repartition("drive_id").sortWithinPartitions("drive_id", "session", "t").write.mode("overwrite").partitionBy("drive_id").parquet(path)


def load_drives(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df if ids is None else df.where(F.col("drive_id").isin(ids))
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in DRIVE))


def verified(spark: SparkSession, files: DataFrame) -> DataFrame:
    """files(path, bytes, sha256) with ok: whether the stored file has that length and digest."""
    paths = [r["path"] for r in files.select("path").distinct().toLocalIterator()]
    found = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("at"), F.col("length"), F.sha2("content", 256).alias("digest"))
    return files.join(found, F.regexp_replace("path", "^file:/*", "/") == F.col("at"), "left").select("path", F.coalesce((F.col("length") == F.col("bytes")) & (F.col("digest") == F.col("sha256")), F.lit(False)).alias("ok"))
