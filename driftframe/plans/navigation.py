"""The benchmark: drives, outages, calibration, navigation by variant, scores. Rows-only queries on synthetic drives whose number follows the data."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe import config
from driftframe.kernels.engine import VARIANTS
from driftframe.operators import experiments, navigate, outages, roads, scoring
from driftframe.plans.registry import query, r, rs
from driftframe.runtime import settled, ship, table
from driftframe.sources import synthetic

CFG = config.with_changes(
    config.DEFAULTS,
    {"evaluate.durations_s": [30.0, 60.0], "evaluate.windows_per_duration": 2, "evaluate.warmup_s": 120.0, "evaluate.post_s": 20.0, "preprocess.attitude_use_gyro": True},
)
KEYS = ["drive_id", "session"]
WINDOW = ["drive_id", "session", "duration_s", "t_start", "t_end"]
USERS_PER_DRIVE = 75


def n_drives(spark: SparkSession, sf: str) -> int:
    """Synthetic drives for this data: one for every USERS_PER_DRIVE users of `events`, at least two."""
    return max(2, table(spark, sf, "events").select("user_id").distinct().count() // USERS_PER_DRIVE)


@lru_cache(maxsize=4)
def _drives(app: str, count: int, prefix: str, **shape: float) -> DataFrame:
    """Drives made once per application, in the shared folder."""
    return settled(synthetic.drives(synthetic.specs(SparkSession.active(), count, prefix=prefix, **shape)), "drives")


def test_drives(spark: SparkSession, count: int) -> DataFrame:
    return _drives(spark.sparkContext.applicationId, count, "t")


def mapping_drives(spark: SparkSession, count: int) -> DataFrame:
    """The same routes on another day, for the speed model and the road map: no test drive is among them."""
    return _drives(spark.sparkContext.applicationId, count, "m", acc_bias=0.02, gyro_bias=0.0)


def windows_of(drives: DataFrame, cfg: dict) -> DataFrame:
    """Eligible outage windows of every duration, evenly spread over each drive."""
    e = cfg["evaluate"]
    ends = drives.groupBy(*KEYS).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    found = []
    for d in e["durations_s"]:
        grid = outages.candidate_grid(ends, KEYS, d, e["warmup_s"], e["post_s"])
        ok = outages.eligible(drives, grid, KEYS, "t", "t", e["warmup_s"], e["post_s"], e["rate_hz"], e["min_distance_m"], e["max_stationary_frac"])
        found.append(outages.evenly_spread(ok, ["drive_id"], e["windows_per_duration"], "session", "t_start"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(*WINDOW)


def network(spark: SparkSession, mapping: DataFrame, cfg: dict) -> DataFrame:
    """(drive_id, segments) of the routes that test drives share with mapping drives."""
    s = roads.trace_segments(mapping.where("ref_valid"), ["drive_id"], "ref_x", "ref_y", "t", cfg["map"]["trace_spacing_m"])
    route = F.concat(F.lit("t"), F.substring("drive_id", 2, 100)).alias("drive_id")
    return s.groupBy(route).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.array("x0", "y0", "x1", "y1").alias("p")))), lambda x: x["p"]).alias("segments"))


@lru_cache(maxsize=4)
def _model(app: str, count: int) -> str:
    spark = SparkSession.active()
    rows = mapping_drives(spark, count)
    f = navigate.motion_features(rows, KEYS, CFG, ("ref_speed", "ref_valid"))
    return navigate.train_speed(f, KEYS, "ref_speed", "ref_valid", CFG).to_json()


def speed_model(spark: SparkSession, count: int) -> str:
    """The speed model fitted on mapping drives, as JSON; once per application."""
    return _model(spark.sparkContext.applicationId, count)


def prepared(spark: SparkSession, count: int, variants: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(masked rows by window and variant, context by window and variant, hidden truth by window)."""
    e, drives = CFG["evaluate"], test_drives(spark, count)
    slices = outages.in_windows(drives, windows_of(drives, CFG), KEYS, "t", e["warmup_s"], e["post_s"])
    slices = settled(slices, "window-slices")
    inside = (F.col("t") >= F.col("t_start")) & (F.col("t") < F.col("t_end"))
    seen, hidden = outages.mask(slices, inside), outages.truth(slices, WINDOW)
    calib = seen.where((F.col("t") < F.col("t_start")) & (F.col("t") >= F.col("t_start") - CFG["preprocess"]["calib_max_s"]))
    context = navigate.calibrations(calib, WINDOW, CFG).join(network(spark, mapping_drives(spark, count), CFG), "drive_id", "left").select(*WINDOW, "alignment", "segments")
    dimension = lambda: spark.createDataFrame([(x,) for x in variants], "variant string")  # noqa: E731  one for each side, else their columns are the same
    return experiments.for_each(seen, dimension()), experiments.for_each(context, dimension()), hidden


def benchmark_scores(spark: SparkSession, sf: str, variants: tuple[str, ...] = tuple(VARIANTS)) -> DataFrame:
    """Scores of every window and variant."""
    count = n_drives(spark, sf)
    rows, context, hidden = prepared(spark, count, list(variants))
    model = speed_model(spark, count) if any(VARIANTS[v].model for v in variants) else None
    tracks = navigate.trajectories(rows, context, WINDOW, CFG, model)
    both = tracks.withColumn("speed", F.hypot("v_f", "v_l")).join(hidden, [*WINDOW, "t"])
    return scoring.window_scores(both, [*WINDOW, "variant"])


@query("nav_benchmark")
def nav_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: median drift by duration and variant."""
    ship(spark)
    return scoring.verdict(scoring.summarise(benchmark_scores(spark, sf)))


@query("nav_scores")
def nav_scores(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return benchmark_scores(spark, sf, ("A", "B"))


@query("nav_trajectory")
def nav_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    count = n_drives(spark, sf)
    rows, context, _ = prepared(spark, count, ["C+NHC"])
    return navigate.trajectories(rows, context, WINDOW, CFG, speed_model(spark, count))


@query("ekf_update_counts")
def ekf_update_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements inside the outages by source, accepted or not; no satellite source may appear."""
    ship(spark)
    count = n_drives(spark, sf)
    rows, context, _ = prepared(spark, count, ["B", "D"])
    log = navigate.update_log(rows, context, WINDOW, CFG, speed_model(spark, count))
    inside = log.where((F.col("t") >= F.col("t_start")) & (F.col("t") < F.col("t_end")))
    return inside.groupBy("variant", "duration_s", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("n_accepted"))


@query("calibration_fit")
def calibration_fit(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return navigate.calibrations(test_drives(spark, n_drives(spark, sf)), KEYS, CFG).drop("alignment")


@query("motion_features")
def motion_features(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return navigate.motion_features(test_drives(spark, n_drives(spark, sf)), KEYS, CFG)


@query("anomaly_events")
def anomaly_events(spark: SparkSession, sf: str) -> DataFrame:
    """Planted jolts and bursts: every 60 s a vertical kick, once a turn of the phone."""
    ship(spark)
    d = test_drives(spark, n_drives(spark, sf))
    kick = (F.round(F.col("t") * 10).cast("long") % 600) == 300
    d = d.withColumn("az", F.col("az") + F.when(kick, 25.0).otherwise(0.0)).withColumn("gx", F.col("gx") + F.when(F.abs(F.col("t") - 200.0) < 0.04, 6.0).otherwise(0.0))
    return navigate.anomalies(d, KEYS, CFG)


@query("anomaly_drive_pass")
def anomaly_drive_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Events of whole drives by kind, in all and inside any outage window (each once), and kilometres driven."""
    ship(spark)
    d = test_drives(spark, n_drives(spark, sf))
    events = anomaly_events(spark, sf)
    w = windows_of(d, CFG).select(*KEYS, "t_start", "t_end")
    hit = events.alias("e").join(w.alias("w"), (F.col("e.drive_id") == F.col("w.drive_id")) & (F.col("e.session") == F.col("w.session")) & (F.col("e.t") >= F.col("w.t_start")) & (F.col("e.t") < F.col("w.t_end")), "left_semi")
    both = scoring.event_counts(events, ["drive_id"]).join(scoring.event_counts(hit, ["drive_id"]).selectExpr("drive_id", "shock shock_blackout", "transient transient_blackout", "slip slip_blackout"), "drive_id", "left")
    from pyspark.sql import Window

    step = F.col("t") - F.lag("t").over(Window.partitionBy(*KEYS).orderBy("t"))
    km = d.withColumn("dt", step).groupBy("drive_id").agg((F.sum(F.col("ref_speed") * F.col("dt")) / 1000).alias("km"))
    return km.join(both, "drive_id", "left").fillna(0)


@query("motion_predict")
def motion_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Speeds of the model on sliding windows of test drives, beside the truth."""
    ship(spark)
    from driftframe.operators.features import sequences

    count = n_drives(spark, sf)
    f = navigate.motion_features(test_drives(spark, count), KEYS, CFG, ("ref_speed",))
    names = CFG["model"]["features"]
    s = sequences(f, KEYS, ["t", *names], CFG["model"]["window"], 10, F.lit(True), "t").withColumnRenamed("t", "t_end")
    return navigate.predict(s.select(*KEYS, F.col("t_end").alias("t"), "ref_speed", "seq"), [*KEYS, "t", "ref_speed"], "seq", speed_model(spark, count))


@query(
    "synthetic_truth",
    f"""WITH u AS (SELECT greatest(2, count(DISTINCT user_id) // 75) AS n FROM events), d AS (SELECT drive_id, i, i / 10e0 AS t FROM u, range(1000) r(i), range(1, 1001) q(k), LATERAL (SELECT k - 1 AS drive_id) WHERE k <= n),
    v AS (SELECT *, least(13 + 3.5e0 * sin(2 * pi() * t / 80) + 1.5e0 * sin(2 * pi() * t / 31), 0.8e0 * t) * u * u * (3 - 2 * u) AS speed FROM (SELECT *, least(1e0, greatest(0e0, (abs(t - 60e0) - 6) / 12)) AS u FROM d)),
    w AS (SELECT *, CASE WHEN speed > 1 AND abs(t - 35) < 7 THEN CASE WHEN drive_id % 2 = 0 THEN 1e0 ELSE -1e0 END * 0.24e0 * (0.5e0 + 0.5e0 * cos(2 * pi() * abs(t - 35) / 14)) ELSE 0e0 END AS turn FROM v),
    y AS (SELECT *, 0.3e0 + sum(turn) OVER (PARTITION BY drive_id ORDER BY i ROWS UNBOUNDED PRECEDING) / 10e0 AS yaw FROM w)
    SELECT drive_id, CAST(i AS INTEGER) AS i, {rs('speed', 6)} AS speed, {rs('yaw', 5)} AS yaw, {rs('sum(speed * cos(yaw)) OVER q / 10e0', 3)} AS x, {rs('sum(speed * sin(yaw)) OVER q / 10e0', 3)} AS y FROM y WINDOW q AS (PARTITION BY drive_id ORDER BY i ROWS UNBOUNDED PRECEDING)""",
)
def synthetic_truth(spark: SparkSession, sf: str) -> DataFrame:
    d = synthetic.truth_native(spark, n_drives(spark, sf), 100.0, 10.0)
    return d.select("drive_id", "i", r("speed").alias("speed"), r("yaw", 5).alias("yaw"), r("x", 3).alias("x"), r("y", 3).alias("y"))
