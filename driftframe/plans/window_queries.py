"""Outage windows, rolling features, runs, sequences, scoring and experiment reports over the drive adapter and star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftframe.operators import calibrate, features, outages, scoring
from driftframe.operators.clean import first_valid, series, valid_fix
from driftframe.plans.registry import drive, query, r, rs
from driftframe.plans.time_queries import SESSIONS_48H, sessions
from driftframe.runtime import table
from driftframe.schema import tampered

DAY = 86400.0
KEYS = ["drive_id", "session"]


@query(
    "rolling_stationary",
    f"""{{DRIVE}}, w AS (SELECT drive_id, event_id, count(*) OVER x AS n, stddev_samp(speed) OVER x AS sa, stddev_samp(CAST(k AS DOUBLE)) OVER x AS sg, avg(CAST(k AS DOUBLE)) OVER x AS mg FROM drive
      WINDOW x AS (PARTITION BY drive_id ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT drive_id, event_id, {rs('CASE WHEN n = 5 THEN sa END', 6)} AS sa, coalesce(n = 5 AND sa < 25e0 AND sg < 30e0 AND mg < 60e0, false) AS still FROM w""",
)
def rolling_stationary(spark: SparkSession, sf: str) -> DataFrame:
    d = drive(spark, sf, False).withColumn("kd", F.col("k").cast("double"))
    d = features.stationary(d, ["drive_id"], "speed", "kd", 5, 25.0, 30.0, 60.0, "t", "event_id")
    return d.select("drive_id", "event_id", r(features.rolling("speed", series(["drive_id"], "t", "event_id"), 5, "std")).alias("sa"), "still")


@query(
    "rolling_straight",
    """{DRIVE} SELECT drive_id, event_id, max(k) OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) < 70 AS straight FROM drive""",
)
def rolling_straight(spark: SparkSession, sf: str) -> DataFrame:
    d = features.straight(drive(spark, sf, False), ["drive_id"], "k", 4, 70, "t", "event_id")
    return d.select("drive_id", "event_id", "straight")


@query(
    "rolling_highpass",
    f"""{{DRIVE}} SELECT drive_id, event_id, {rs('CASE WHEN count(*) OVER x = 10 THEN abs(speed - avg(speed) OVER x) END', 6)} AS deviation FROM drive
    WINDOW x AS (PARTITION BY drive_id ORDER BY t, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
)
def rolling_highpass(spark: SparkSession, sf: str) -> DataFrame:
    w = series(["drive_id"], "t", "event_id")
    return drive(spark, sf, False).select("drive_id", "event_id", r(F.abs(F.col("speed") - features.rolling_before("speed", w, 10))).alias("deviation"))


@query(
    "path_length",
    f"""{{DRIVE}}, s AS (SELECT drive_id, hypot_(east - lag(east) OVER w, north - lag(north) OVER w) AS d FROM drive WINDOW w AS (PARTITION BY drive_id ORDER BY t, event_id))
    SELECT drive_id, {rs('coalesce(sum(d), 0e0)', 3)} AS distance_m FROM s GROUP BY drive_id""".replace("hypot_(east - lag(east) OVER w, north - lag(north) OVER w)", "sqrt((east - lag(east) OVER w) ** 2 + (north - lag(north) OVER w) ** 2)"),
)
def path_length(spark: SparkSession, sf: str) -> DataFrame:
    return outages.path_length(drive(spark, sf), ["drive_id"], "east", "north", "t", "event_id").select("drive_id", r("distance_m", 3).alias("distance_m"))


@query(
    "cumulative_distance",
    f"""{{DRIVE}}, s AS (SELECT drive_id, event_id, t, coalesce(sqrt((east - lag(east) OVER w) ** 2 + (north - lag(north) OVER w) ** 2), 0e0) AS d FROM drive WINDOW w AS (PARTITION BY drive_id ORDER BY t, event_id))
    SELECT drive_id, event_id, {rs('sum(d) OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)', 3)} AS distance_m FROM s""",
)
def cumulative_distance(spark: SparkSession, sf: str) -> DataFrame:
    w = series(["drive_id"], "t", "event_id")
    d = drive(spark, sf).withColumn("d", F.coalesce(outages.path_step("east", "north", w), F.lit(0.0)))
    return d.select("drive_id", "event_id", r(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), 3).alias("distance_m"))


@query(
    "first_fix_origin",
    f"""{{DRIVE}}, f AS (SELECT drive_id, t, event_id, CASE WHEN healthy THEN speed / 10 END AS lat, k / 2e0 AS lon FROM drive)
    SELECT drive_id, {rs('arg_min(lat, struct_pack(a := t, b := event_id))')} AS lat0, {rs('arg_min(lon, struct_pack(a := t, b := event_id))')} AS lon0 FROM f WHERE lat IS NOT NULL AND abs(lat) > 1e-6 GROUP BY drive_id""",
)
def first_fix_origin(spark: SparkSession, sf: str) -> DataFrame:
    d = drive(spark, sf, False).select("drive_id", F.struct("t", "event_id").alias("ord"), F.when(F.col("healthy"), F.col("speed") / 10).alias("lat"), (F.col("k") / F.lit(2.0)).alias("lon"))
    o = first_valid(d, ["drive_id"], "ord", valid_fix(F.col("lat"), F.col("lon")), lat0="lat", lon0="lon")
    return o.select("drive_id", r("lat0").alias("lat0"), r("lon0").alias("lon0"))


# Windows in drive time: a duration of half a day, warm-up one day, post-roll a quarter, steps of a quarter of a day.
_GRID = """, ends AS (SELECT drive_id, session, min(t) AS t0, max(t) AS t1 FROM s GROUP BY 1, 2),
    grid AS (SELECT drive_id, session, t0 + 86400e0 + i * 21600e0 AS t_start FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((t1 - 43200e0 - 21600e0 - (t0 + 86400e0)) / 21600e0) AS BIGINT), 0))) AS i FROM ends))"""


def _grid(d: DataFrame) -> DataFrame:
    ends = d.groupBy(*KEYS).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return outages.candidate_grid(ends, KEYS, 0.5 * DAY, DAY, 0.25 * DAY)


@query("outage_grid", SESSIONS_48H + _GRID + f" SELECT drive_id, session, {rs('t_start', 3)} AS t_start FROM grid")
def outage_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(sessions(spark, sf, 48, False)).select(*KEYS, r("t_start", 3).alias("t_start"))


_CANDIDATES = (
    SESSIONS_48H
    + _GRID
    + """, j AS (SELECT g.drive_id, g.session, g.t_start, s.t, s.event_id, s.event_type, s.speed, s.east, s.north, s.t >= g.t_start AND s.t < g.t_start + 43200e0 AS ins
      FROM grid g JOIN s ON s.drive_id = g.drive_id AND s.session = g.session AND s.t >= g.t_start - 86400e0 AND s.t < g.t_start + 43200e0 + 21600e0),
    d AS (SELECT *, sqrt((east - lag(east) OVER w) ** 2 + (north - lag(north) OVER w) ** 2) AS d FROM j WINDOW w AS (PARTITION BY drive_id, session, t_start, ins ORDER BY t, event_id)),
    c AS (SELECT drive_id, session, t_start, bool_and(event_type <> 'nothing') AS ok, count_if(ins) AS n, coalesce(sum(CASE WHEN ins THEN d END), 0e0) AS dist, avg(CASE WHEN ins THEN CASE WHEN speed < 0.5e0 THEN 1e0 ELSE 0e0 END END) AS still FROM d GROUP BY 1, 2, 3),
    e AS (SELECT * FROM c WHERE ok AND n >= 0.9e0 * 43200 * (1 / 28800e0) AND dist >= 5 AND still <= 0.5e0)"""
)


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    d = sessions(spark, sf, 48).withColumn("ok", F.col("event_type") != "nothing")
    return outages.eligible(d, _grid(d), KEYS, "t", "event_id", DAY, 0.25 * DAY, 1 / 28800.0, 5.0, 0.5, x="east", y="north", speed="speed", valid="ok")


@query("blackout_candidates", _CANDIDATES + f" SELECT drive_id, session, {rs('t_start', 3)} AS t_start, CAST(n AS BIGINT) AS n_rows, {rs('dist', 3)} AS distance_m, {rs('still')} AS still_frac FROM e")
def blackout_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).select(*KEYS, r("t_start", 3).alias("t_start"), "n_rows", r("distance_m", 3).alias("distance_m"), r("still_frac").alias("still_frac"))


_SELECT = (
    _CANDIDATES
    + """, rk AS (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY session, t_start) - 1 AS r, count(*) OVER (PARTITION BY drive_id) AS nn FROM e),
    pick AS (SELECT drive_id, session, t_start, nn, r FROM rk WHERE list_contains(CASE WHEN least(6, nn) > 1 THEN list_transform(range(0, least(6, nn)), lambda i: round_even(i * (nn - 1) / (least(6, nn) - 1), 0)) ELSE [0e0] END, CAST(r AS DOUBLE)))"""
)


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    return outages.evenly_spread(_candidates(spark, sf), ["drive_id"], 6, "session", "t_start")


@query("blackout_select", _SELECT + f" SELECT drive_id, session, {rs('t_start', 3)} AS t_start FROM pick")
def blackout_select(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf).select(*KEYS, r("t_start", 3).alias("t_start"))


@query(
    "mask_outage",
    _SELECT
    + f""" SELECT p.drive_id, p.session, {rs('p.t_start', 3)} AS t_start, {rs('s.t', 3)} AS t, s.healthy AND NOT (s.t >= p.t_start AND s.t < p.t_start + 43200e0) AS gnss_healthy,
    CASE WHEN s.t >= p.t_start AND s.t < p.t_start + 43200e0 THEN NULL ELSE {rs('s.speed')} END AS gnss_speed FROM pick p JOIN s ON s.drive_id = p.drive_id AND s.session = p.session AND s.t >= p.t_start - 86400e0 AND s.t < p.t_start + 43200e0 + 21600e0""",
)
def mask_outage(spark: SparkSession, sf: str) -> DataFrame:
    d = sessions(spark, sf, 48).select(*KEYS, "t", F.col("healthy").alias("gnss_healthy"), F.col("speed").alias("gnss_speed"), F.col("east").alias("gnss_x"), F.col("north").alias("gnss_y"), F.col("speed").alias("ref_speed"))
    rows = outages.in_windows(d, _selected(spark, sf).select(*KEYS, "t_start", "t_end"), KEYS, "t", DAY, 0.25 * DAY)
    seen = outages.mask(rows, (F.col("t") >= F.col("t_start")) & (F.col("t") < F.col("t_end")))
    return seen.select(*KEYS, r("t_start", 3).alias("t_start"), r("t", 3).alias("t"), "gnss_healthy", r("gnss_speed").alias("gnss_speed"))


@query(
    "mask_tamper_check",
    _SELECT
    + """, seen AS (SELECT s.t >= p.t_start AND s.t < p.t_start + 43200e0 AS ins, s.healthy, s.speed FROM pick p JOIN s ON s.drive_id = p.drive_id AND s.session = p.session AND s.t >= p.t_start - 86400e0 AND s.t < p.t_start + 43200e0 + 21600e0),
    masked AS (SELECT ins, healthy AND NOT ins AS healthy, CASE WHEN ins THEN NULL ELSE speed END AS speed FROM seen) SELECT count(*) AS n_rows FROM masked WHERE ins AND (healthy OR speed IS NOT NULL)""",
)
def mask_tamper_check(spark: SparkSession, sf: str) -> DataFrame:
    d = sessions(spark, sf, 48).select(*KEYS, "t", F.col("healthy").alias("gnss_healthy"), F.col("speed").alias("gnss_speed"), F.col("east").alias("gnss_x"), F.col("north").alias("gnss_y"))
    rows = outages.in_windows(d, _selected(spark, sf).select(*KEYS, "t_start", "t_end"), KEYS, "t", DAY, 0.25 * DAY)
    inside = (F.col("t") >= F.col("t_start")) & (F.col("t") < F.col("t_end"))
    return tampered(outages.mask(rows, inside), inside).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "calibration_slice",
    _SELECT + f""" SELECT p.drive_id, p.session, {rs('p.t_start', 3)} AS t_start, count(*) AS n_rows, {rs('avg(s.speed)')} AS mean_speed FROM pick p JOIN s ON s.drive_id = p.drive_id AND s.session = p.session
      AND s.t >= p.t_start - 43200e0 AND s.t < p.t_start GROUP BY ALL""",
)
def calibration_slice(spark: SparkSession, sf: str) -> DataFrame:
    w = _selected(spark, sf).select(*KEYS, "t_start", F.col("t_start").alias("t_end"))
    rows = outages.in_windows(sessions(spark, sf, 48, False).select(*KEYS, "t", "speed"), w, KEYS, "t", 0.5 * DAY)
    return rows.groupBy(*KEYS, r("t_start", 3).alias("t_start")).agg(F.count(F.lit(1)).alias("n_rows"), r(F.avg("speed")).alias("mean_speed"))


@query(
    "range_join_windows",
    """{DRIVE}, w AS (SELECT o_custkey % 150 AS drive_id, o_orderkey, (o_orderkey % 29) * 86400e0 AS t_start, (o_orderkey % 29) * 86400e0 + 86400e0 AS t_end FROM orders)
    SELECT w.o_orderkey, drive.drive_id, count(*) AS n_rows FROM drive JOIN w ON drive.drive_id = w.drive_id AND t >= t_start AND t < t_end GROUP BY ALL""",
)
def range_join_windows(spark: SparkSession, sf: str) -> DataFrame:
    j = outages.in_windows(drive(spark, sf, False).select("drive_id", "t"), _order_windows(spark, sf), ["drive_id"], "t")
    return j.groupBy("o_orderkey", "drive_id").agg(F.count(F.lit(1)).alias("n_rows"))


def _order_windows(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 150).alias("drive_id"), "o_orderkey", ((F.col("o_orderkey") % 29) * F.lit(DAY)).alias("t_start"), ((F.col("o_orderkey") % 29) * F.lit(DAY) + DAY).alias("t_end"))


@query(
    "events_in_windows_once",
    """{DRIVE}, w AS (SELECT o_custkey % 150 AS drive_id, (o_orderkey % 29) * 86400e0 AS t_start, (o_orderkey % 29) * 86400e0 + 86400e0 AS t_end FROM orders)
    SELECT drive_id, CAST(count_if(event_type = 'click') AS BIGINT) AS click, CAST(count_if(event_type = 'error') AS BIGINT) AS error, CAST(count_if(event_type = 'view') AS BIGINT) AS "view"
    FROM drive d WHERE EXISTS (SELECT 1 FROM w WHERE w.drive_id = d.drive_id AND d.t >= w.t_start AND d.t < w.t_end) GROUP BY drive_id""",
)
def events_in_windows_once(spark: SparkSession, sf: str) -> DataFrame:
    d, w = drive(spark, sf, False).select("drive_id", "t", F.col("event_type").alias("kind")), _order_windows(spark, sf).distinct()
    once = d.alias("d").join(w.alias("w"), (F.col("d.drive_id") == F.col("w.drive_id")) & (F.col("d.t") >= F.col("w.t_start")) & (F.col("d.t") < F.col("w.t_end")), "left_semi")
    return scoring.event_counts(once, ["drive_id"], ("click", "error", "view"))


@query(
    "mode_machine",
    """{DRIVE}, m AS (SELECT drive_id, event_id, t, min(CASE WHEN healthy AND speed >= 3 THEN t END) OVER w AS begun, last_value(CASE WHEN healthy THEN t END IGNORE NULLS) OVER w AS fix FROM drive
      WINDOW w AS (PARTITION BY drive_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))
    SELECT drive_id, event_id, CASE WHEN begun IS NULL THEN 'WAITING FOR GNSS' WHEN t - greatest(begun, fix) <= 30000 THEN 'GNSS+INS' ELSE 'DEAD RECKONING' END AS mode FROM m""",
)
def mode_machine(spark: SparkSession, sf: str) -> DataFrame:
    d = outages.mode(drive(spark, sf, False), ["drive_id"], "t", "event_id", F.col("healthy"), 30000.0, F.col("speed") >= 3)
    return d.select("drive_id", "event_id", "mode")


@query(
    "label_runs",
    """{DRIVE}, i AS (SELECT drive_id, event_id, t, valid, sum(CASE WHEN valid THEN 0 ELSE 1 END) OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM drive)
    SELECT drive_id, event_id, CAST(CASE WHEN valid THEN sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER (PARTITION BY drive_id, island ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS INTEGER) AS run FROM i""",
)
def label_runs(spark: SparkSession, sf: str) -> DataFrame:
    return features.label_runs(drive(spark, sf, False), ["drive_id"], F.col("valid"), "t", "event_id").select("drive_id", "event_id", "run")


_SEQ = (
    SESSIONS_48H
    + """, i AS (SELECT *, sum(CASE WHEN valid THEN 0 ELSE 1 END) OVER (PARTITION BY drive_id, session ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island,
      list(speed) OVER (PARTITION BY drive_id, session ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS seq FROM s),
    ru AS (SELECT *, sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER (PARTITION BY drive_id, session, island ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM i),
    en AS (SELECT *, row_number() OVER (PARTITION BY drive_id, session ORDER BY t, event_id) - 1 AS nth FROM ru WHERE valid AND run >= 5),
    sq AS (SELECT * FROM en WHERE nth % 3 = 0)"""
)


def _seqs(spark: SparkSession, sf: str) -> DataFrame:
    return features.sequences(sessions(spark, sf, 48, False), KEYS, ["speed"], 5, 3, F.col("valid"), "t", "event_id")


@query("sliding_windows", _SEQ + f" SELECT drive_id, session, event_id, {rs('seq[1]')} AS first, {rs('seq[5]')} AS target, {rs('list_sum(seq)')} AS total FROM sq")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    s = _seqs(spark, sf)
    total = F.aggregate("seq", F.lit(0.0), lambda a, x: a + x["speed"])
    return s.select(*KEYS, "event_id", r(F.col("seq")[0]["speed"]).alias("first"), r(F.col("seq")[4]["speed"]).alias("target"), r(total).alias("total"))


@query("window_norm_stats", _SEQ + f" SELECT count(*) AS n, {rs('avg(x)')} AS mean, {rs('stddev_pop(x) + 1e-6')} AS std FROM (SELECT unnest(seq) AS x FROM sq)")
def window_norm_stats(spark: SparkSession, sf: str) -> DataFrame:
    x = _seqs(spark, sf).select(F.explode("seq.speed").alias("x"))
    return x.agg(F.count(F.lit(1)).alias("n"), r(F.avg("x")).alias("mean"), r(F.stddev_pop("x") + 1e-6).alias("std"))


@query(
    "rmse_coverage",
    f"""SELECT coalesce(c_mktsegment, 'all') AS split, CAST(count(*) AS BIGINT) AS n, {rs('sqrt(avg(e * e))', 4)} AS rmse, {rs('avg(abs(e))', 4)} AS mae, {rs('avg(CASE WHEN abs(e) / s <= 1 THEN 1e0 ELSE 0e0 END)')} AS share_1sd,
    {rs('avg(CASE WHEN abs(e) / s <= 2 THEN 1e0 ELSE 0e0 END)')} AS share_2sd, {rs('sqrt(avg((e / s) ** 2))')} AS sd_factor
    FROM (SELECT c_mktsegment, o_totalprice / 1000e0 - c_acctbal / 20e0 AS e, 100e0 + c_custkey % 50 AS s FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY GROUPING SETS ((c_mktsegment), ())""",
)
def rmse_coverage(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.select("c_mktsegment", (F.col("o_totalprice") / 1000.0 - F.col("c_acctbal") / 20.0).alias("e"), (100.0 + F.col("c_custkey") % 50).alias("s"))
    j = j.withColumn("split", F.explode(F.array("c_mktsegment", F.lit("all"))))
    a, b = scoring.rmse_mae(j, ["split"], F.col("e")), scoring.coverage(j, ["split"], F.col("e"), F.col("s"))
    out = a.join(b, "split")
    return out.select("split", "n", r("rmse", 4).alias("rmse"), r("mae", 4).alias("mae"), r("share_1sd").alias("share_1sd"), r("share_2sd").alias("share_2sd"), r("sd_factor").alias("sd_factor"))


@query(
    "decimate_blocks",
    f"""{{DRIVE}}, b AS (SELECT drive_id, (row_number() OVER (PARTITION BY drive_id ORDER BY t, event_id) - 1) // 4 AS block, speed, k FROM drive)
    SELECT drive_id, CAST(block AS BIGINT) AS block, {rs('avg(speed)')} AS speed, {rs('avg(CAST(k AS DOUBLE))')} AS k FROM b GROUP BY 1, 2 HAVING count(*) = 4""",
)
def decimate_blocks(spark: SparkSession, sf: str) -> DataFrame:
    d = features.decimate(drive(spark, sf, False), ["drive_id"], ["speed", "k"], 4, "t", "event_id")
    return d.select("drive_id", "block", r("speed").alias("speed"), r("k").alias("k"))


@query("display_thin", "{DRIVE}, b AS (SELECT drive_id, event_id, row_number() OVER (PARTITION BY drive_id ORDER BY t, event_id) - 1 AS nth FROM drive) SELECT drive_id, event_id FROM b WHERE nth % 5 = 0")
def display_thin(spark: SparkSession, sf: str) -> DataFrame:
    return features.thin(drive(spark, sf, False), ["drive_id"], 5, "t", "event_id").select("drive_id", "event_id")


@query(
    "median_row",
    "{DRIVE}, b AS (SELECT drive_id, event_id, row_number() OVER (PARTITION BY drive_id ORDER BY speed, event_id) AS nth, count(*) OVER (PARTITION BY drive_id) AS n FROM drive) SELECT drive_id, event_id FROM b WHERE nth = n // 2 + 1",
)
def median_row(spark: SparkSession, sf: str) -> DataFrame:
    return features.upper_median(drive(spark, sf, False), ["drive_id"], "speed", "event_id").select("drive_id", "event_id")


_ROWS = """{DRIVE}, o AS (SELECT drive_id, event_id, t, speed, k, yaw, row_number() OVER (PARTITION BY drive_id ORDER BY t, event_id) AS n, least(coalesce(t - lag(t) OVER (PARTITION BY drive_id ORDER BY t, event_id), 0) / 1e5, 1) AS g FROM drive)"""


@query(
    "ema_recurrence",
    _ROWS.replace("{DRIVE}", "{RDRIVE}")
    + f""", e AS (SELECT drive_id, event_id, n, CAST(speed AS DOUBLE) AS v FROM o WHERE n = 1 UNION ALL SELECT o.drive_id, o.event_id, o.n, e.v + o.g * (o.speed - e.v) FROM e JOIN o ON o.drive_id = e.drive_id AND o.n = e.n + 1)
    SELECT drive_id, event_id, {rs('v', 6)} AS v FROM e""",
)
def ema_recurrence(spark: SparkSession, sf: str) -> DataFrame:
    w = series(["drive_id"], "t", "event_id")
    d = drive(spark, sf, False).withColumn("dt", (F.col("t") - F.lag("t").over(w)) / 1e5)
    return features.ema(d, ["drive_id"], ["t", "event_id"], "speed", "dt", "v").select("drive_id", "event_id", r("v").alias("v"))


_B0, _B1, _B2, _A1, _A2 = features.biquad(2.0, 10.0)


@query(
    "biquad_lowpass",
    _ROWS.replace("{DRIVE}", "{RDRIVE}")
    + f""", f AS (SELECT drive_id, event_id, n, speed AS y, ({_B1!r}::DOUBLE - {_A1!r}::DOUBLE + {_B2!r}::DOUBLE - {_A2!r}::DOUBLE) * speed AS z1, ({_B2!r}::DOUBLE - {_A2!r}::DOUBLE) * speed AS z2 FROM o WHERE n = 1
      UNION ALL SELECT o.drive_id, o.event_id, o.n, {_B0!r}::DOUBLE * o.speed + f.z1, {_B1!r}::DOUBLE * o.speed - {_A1!r}::DOUBLE * ({_B0!r}::DOUBLE * o.speed + f.z1) + f.z2, {_B2!r}::DOUBLE * o.speed - {_A2!r}::DOUBLE * ({_B0!r}::DOUBLE * o.speed + f.z1)
      FROM f JOIN o ON o.drive_id = f.drive_id AND o.n = f.n + 1) SELECT drive_id, event_id, {rs('y', 6)} AS y FROM f""",
)
def biquad_lowpass(spark: SparkSession, sf: str) -> DataFrame:
    return features.low_pass(drive(spark, sf, False), ["drive_id"], ["t", "event_id"], "speed", 2.0, 10.0, "y").select("drive_id", "event_id", r("y").alias("y"))


@query(
    "wahba_yaw",
    f"""{{DRIVE}} SELECT drive_id, {rs('atan2(covar_pop(hx, ey) * count(*) - covar_pop(hy, ex) * count(*), covar_pop(hx, ex) * count(*) + covar_pop(hy, ey) * count(*))', 5)} AS theta
    FROM (SELECT drive_id, speed AS hx, CAST(k AS DOUBLE) AS hy, speed * cos(0.6e0) - k * sin(0.6e0) + (event_id % 7) AS ex, speed * sin(0.6e0) + k * cos(0.6e0) - (event_id % 5) AS ey FROM drive) GROUP BY drive_id""",
)
def wahba_yaw(spark: SparkSession, sf: str) -> DataFrame:
    c, s = F.cos(F.lit(0.6)), F.sin(F.lit(0.6))
    d = drive(spark, sf, False).select(
        "drive_id", F.col("speed").alias("hx"), F.col("k").cast("double").alias("hy"), (F.col("speed") * c - F.col("k") * s + F.col("event_id") % 7).alias("ex"),
        (F.col("speed") * s + F.col("k") * c - F.col("event_id") % 5).alias("ey"),
    )
    return calibrate.plane_rotation(d, ["drive_id"], "hx", "hy", "ex", "ey").select("drive_id", r("theta", 5).alias("theta"))


@query(
    "masked_bias",
    f"""{{DRIVE}} SELECT drive_id, {rs("CASE WHEN count_if(event_type = 'view') > 14 THEN avg(CASE WHEN event_type = 'view' THEN speed END) WHEN count_if(valid) > 50 THEN avg(CASE WHEN valid THEN speed END) ELSE avg(speed) END")} AS bias,
    {rs('avg(CASE WHEN healthy THEN speed END)')} AS aid FROM drive GROUP BY drive_id""",
)
def masked_bias(spark: SparkSession, sf: str) -> DataFrame:
    d = drive(spark, sf, False).withColumn("aid", calibrate.speed_aid("speed", "healthy"))
    bias = calibrate.masked_mean("speed", [(F.col("event_type") == "view", 14), (F.col("valid"), 50)])
    return d.groupBy("drive_id").agg(r(bias).alias("bias"), r(F.avg("aid")).alias("aid"))


# Scores: the estimate is the track seen through a heading error that grows from the outage's start.
_SCORED = (
    _SELECT
    + """, rw AS (SELECT p.drive_id, p.session, p.t_start, p.t_start + 43200e0 AS t_end, s.t, s.event_id, s.east AS tx, s.north AS ty, s.speed AS tv, s.yaw AS tyaw,
      s.east + greatest(s.t - p.t_start, 0) / 5000e0 AS x, s.north - greatest(s.t - p.t_start, 0) / 9000e0 AS y, s.speed * 1.02e0 AS v, s.yaw + 0.05e0 AS yaw FROM pick p JOIN s ON s.drive_id = p.drive_id AND s.session = p.session AND s.t >= p.t_start - 86400e0 AND s.t < p.t_start + 43200e0 + 21600e0),
    st AS (SELECT *, t >= t_start AND t < t_end AS ins, t >= t_end - 0.2e0 AS near, sqrt((x - tx) ** 2 + (y - ty) ** 2) AS err, abs((yaw - tyaw) - 2 * pi() * floor(((yaw - tyaw) + pi()) / (2 * pi()))) AS herr, v - tv AS serr FROM rw),
    sp AS (SELECT *, sqrt((tx - lag(tx) OVER wi) ** 2 + (ty - lag(ty) OVER wi) ** 2) AS stp, sqrt((x - lag(x) OVER wn) ** 2 + (y - lag(y) OVER wn) ** 2) AS jump FROM st
      WINDOW wi AS (PARTITION BY drive_id, session, t_start, ins ORDER BY t), wn AS (PARTITION BY drive_id, session, t_start, near ORDER BY t)),
    sc AS (SELECT drive_id, session, t_start, coalesce(sum(CASE WHEN ins THEN stp END), 0e0) AS distance_m, arg_max(err, t) FILTER (ins) AS endpoint, avg(err) FILTER (ins) AS ate, sqrt(avg(err * err) FILTER (ins)) AS rmse, max(err) FILTER (ins) AS worst,
      sqrt(avg(serr * serr) FILTER (ins)) AS srmse, avg(abs(serr)) FILTER (ins) AS smae, degrees(avg(herr) FILTER (ins AND tv > 2)) AS hmae, degrees(arg_max(herr, t) FILTER (ins)) AS hfin, coalesce(max(jump) FILTER (near), 0e0) AS jmp,
      min(t - t_end) FILTER (t >= t_end AND err < 5) AS back FROM sp GROUP BY 1, 2, 3)"""
)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    d = sessions(spark, sf, 48).select(*KEYS, "t", F.col("east").alias("true_x"), F.col("north").alias("true_y"), F.col("speed").alias("true_speed"), F.col("yaw").alias("true_yaw"))
    rows = outages.in_windows(d, _selected(spark, sf).select(*KEYS, "t_start", "t_end"), KEYS, "t", DAY, 0.25 * DAY)
    late = F.greatest(F.col("t") - F.col("t_start"), F.lit(0.0))
    rows = rows.withColumns({"x": F.col("true_x") + late / 5000.0, "y": F.col("true_y") - late / 9000.0, "speed": F.col("true_speed") * 1.02, "yaw": F.col("true_yaw") + 0.05})
    rows = rows.withColumns({"disp_x": F.col("x"), "disp_y": F.col("y")})
    return scoring.window_scores(rows, [*KEYS, "t_start", "t_end"])


@query(
    "drift_metrics",
    _SCORED
    + f""" SELECT drive_id, session, {rs('t_start', 3)} AS t_start, {rs('distance_m', 3)} AS distance_m, {rs('endpoint', 4)} AS final_error_m, {rs('CASE WHEN distance_m > 0 THEN 100 * endpoint / distance_m END', 3)} AS drift_pct, {rs('ate', 4)} AS mean_error_m,
    {rs('rmse', 4)} AS rms_error_m, {rs('worst', 4)} AS worst_error_m, {rs('srmse', 4)} AS speed_rms, {rs('smae', 4)} AS speed_abs FROM sc""",
)
def drift_metrics(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    return s.select(
        *KEYS, r("t_start", 3).alias("t_start"), r("distance_m", 3).alias("distance_m"), r("final_error_m", 4).alias("final_error_m"), r("drift_pct", 3).alias("drift_pct"),
        *(r(c, 4).alias(c) for c in ("mean_error_m", "rms_error_m", "worst_error_m", "speed_rms", "speed_abs")),
    )


@query("reacquisition", _SCORED + f" SELECT drive_id, session, {rs('t_start', 3)} AS t_start, {rs('jmp', 4)} AS return_step_m, {rs('back', 3)} AS return_time_s FROM sc")
def reacquisition(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select(*KEYS, r("t_start", 3).alias("t_start"), r("return_step_m", 4).alias("return_step_m"), r("return_time_s", 3).alias("return_time_s"))


@query("heading_scores", _SCORED + f" SELECT drive_id, session, {rs('t_start', 3)} AS t_start, {rs('hmae', 5)} AS heading_abs_deg, {rs('hfin', 5)} AS heading_last_deg FROM sc")
def heading_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select(*KEYS, r("t_start", 3).alias("t_start"), r("heading_abs_deg", 5).alias("heading_abs_deg"), r("heading_last_deg", 5).alias("heading_last_deg"))
