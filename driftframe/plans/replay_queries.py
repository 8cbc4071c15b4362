"""Replays, pairings, splits and model heads over the drive adapter and star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftframe.functions import geo
from driftframe.operators import align, clean, features, scoring
from driftframe.plans.registry import drive, query, r, rs
from driftframe.plans.time_queries import SESSIONS_48H, sessions
from driftframe.runtime import table
from driftframe.schema import role_report

KEYS = ["drive_id", "session"]


@query(
    "positional_join",
    f"""WITH a AS (SELECT o_custkey AS g, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    b AS (SELECT user_id AS g, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
    SELECT g, n, o_orderkey, event_id, {rs('o_totalprice - value', 3)} AS gap FROM a JOIN b USING (g, n)""",
)
def positional_join(spark: SparkSession, sf: str) -> DataFrame:
    """Row i of one series with row i of the other, as far as both go."""
    nth = lambda k, o: F.row_number().over(Window.partitionBy(k).orderBy(o)).cast("long")
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), "o_orderkey", "o_totalprice", nth("o_custkey", "o_orderkey").alias("n"))
    b = table(spark, sf, "events").select(F.col("user_id").alias("g"), "event_id", "value", nth("user_id", "event_id").alias("n"))
    return a.join(b, ["g", "n"]).select("g", "n", "o_orderkey", "event_id", r(F.col("o_totalprice") - F.col("value"), 3).alias("gap"))


@query(
    "replay_frame",
    f"""{{DRIVE}}, p AS (SELECT drive_id, t, arg_max(speed, event_id) AS said FROM drive WHERE k >= 50 GROUP BY 1, 2),
    j AS (SELECT d.*, CASE WHEN d.t - p.t <= 40000e0 THEN p.said END AS said FROM drive d ASOF LEFT JOIN p ON d.drive_id = p.drive_id AND d.t >= p.t)
    SELECT drive_id, event_id, {rs('50e0 + degrees(north / 6378137e0)', 8)} AS lat, {rs('8e0 + degrees(east / (6378137e0 * cos(radians(50e0))))', 8)} AS lon, {rs('t - 432000e0', 3)} AS rel_t, t >= 432000 AND t < 1296000 AS denied, {rs('said')} AS said FROM j""",
)
def replay_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Track in degrees, time from the outage, last model speed unless it is stale."""
    d = drive(spark, sf)
    said = clean.keep_last(d.where("k >= 50").select("drive_id", "t", "event_id", "speed"), ["drive_id", "t"], "event_id").drop("event_id")
    f = align.asof_backward(d, said, ["drive_id"], "t", "speed", "said", 40000.0)
    lat, lon = geo.lat_lon(F.col("east"), F.col("north"), 50.0, 8.0)
    return f.select("drive_id", "event_id", r(lat, 8).alias("lat"), r(lon, 8).alias("lon"), r(F.col("t") - 432000.0, 3).alias("rel_t"), ((F.col("t") >= 432000) & (F.col("t") < 1296000)).alias("denied"), r("said").alias("said"))


@query(
    "session_eligibility",
    SESSIONS_48H + " SELECT drive_id, session, count(*) AS n_rows, CAST(count_if(valid) AS BIGINT) AS n_valid FROM s GROUP BY 1, 2 HAVING count_if(valid) >= 10 AND count(*) >= 15",
)
def session_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    g = sessions(spark, sf, 48, False).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("valid").alias("n_valid"))
    return g.where("n_valid >= 10 and n_rows >= 15")


_SPLIT = "CASE WHEN drive_id % 10 < 7 THEN 'train' WHEN drive_id % 10 < 9 THEN 'val' ELSE 'test' END"


@query(
    "split_windows",
    SESSIONS_48H
    + f""", ru AS (SELECT *, sum(CASE WHEN valid THEN 0 ELSE 1 END) OVER (PARTITION BY drive_id, session ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s),
    rn AS (SELECT *, sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER (PARTITION BY drive_id, session, island ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM ru),
    en AS (SELECT *, row_number() OVER (PARTITION BY drive_id, session ORDER BY t, event_id) - 1 AS nth FROM rn WHERE valid AND run >= 4)
    SELECT {_SPLIT} AS split, count(*) AS windows, count(DISTINCT drive_id) AS drives, {rs('avg(speed)')} AS target FROM en WHERE nth % CASE WHEN {_SPLIT} = 'train' THEN 3 ELSE 1 END = 0 GROUP BY 1""",
)
def split_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Sequence windows by split: every third in training, all elsewhere; a drive is in one split only."""
    d = sessions(spark, sf, 48, False).withColumn("split", F.expr(_SPLIT))
    train = features.sequence_ends(d.where("split = 'train'"), KEYS, F.col("valid"), 4, 3, "t", "event_id")
    rest = features.sequence_ends(d.where("split <> 'train'"), KEYS, F.col("valid"), 4, 1, "t", "event_id")
    g = train.unionByName(rest).groupBy("split")
    return g.agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("drive_id").alias("drives"), r(F.avg("speed")).alias("target"))


@query(
    "model_head",
    f"""SELECT vec_id, {rs('greatest(a, 0) + ln(1 + exp(-abs(a)))')} AS speed, {rs('exp(0.5e0 * greatest(least(b * 40, 6e0), -6e0)) * 1.7e0')} AS sigma
    FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 30 AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)""",
)
def model_head(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 30).alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    return e.select("vec_id", r(geo.softplus(F.col("a"))).alias("speed"), r(geo.std_from_logvar(F.col("b") * 40, 1.7)).alias("sigma"))


@query(
    "model_compare",
    f"""WITH e AS (SELECT 'last value' AS model, drive_id, speed - before AS err FROM (SELECT drive_id, speed, lag(speed) OVER (PARTITION BY drive_id ORDER BY t, event_id) AS before FROM ({{D}}) d) UNION ALL
      SELECT 'mean of five', drive_id, CASE WHEN n = 5 THEN speed - m END FROM (SELECT drive_id, speed, avg(speed) OVER x AS m, count(*) OVER x AS n FROM ({{D}}) d WINDOW x AS (PARTITION BY drive_id ORDER BY t, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)))
    SELECT model, count(err) AS n, {rs('sqrt(avg(err * err))', 4)} AS rmse, {rs('avg(abs(err))', 4)} AS mae FROM e GROUP BY model""".replace(
        "{D}", "SELECT event_id, user_id AS drive_id, value AS speed, epoch_us(ts) AS t FROM events"
    ),
)
def model_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of two simple speed models, one under the other."""
    w = clean.series(["drive_id"], "t", "event_id")
    d = drive(spark, sf, False)
    a = d.select(F.lit("last value").alias("model"), (F.col("speed") - F.lag("speed").over(w)).alias("err"))
    b = d.select(F.lit("mean of five").alias("model"), (F.col("speed") - features.rolling_before("speed", w, 5)).alias("err"))
    out = scoring.rmse_mae(a.unionByName(b), ["model"], F.col("err"))
    return out.select("model", "n", r("rmse", 4).alias("rmse"), r("mae", 4).alias("mae"))


_ROLES = {
    "meta": ("drive_id session t", "yes"),
    "imu": ("ax ay az gx gy gz mx my mz", "yes"),
    "gnss": ("gnss_x gnss_y gnss_speed gnss_yaw gnss_std gnss_healthy", "only while healthy"),
    "reference": ("ref_x ref_y ref_lat ref_lon ref_speed ref_yaw ref_yaw_rate ref_wheel_speed ref_valid", "never"),
}


@query(
    "column_roles",
    "SELECT \"column\", CASE WHEN \"column\" = 'drive_id' THEN 'string' WHEN \"column\" = 'session' THEN 'int' WHEN \"column\" IN ('gnss_healthy', 'ref_valid') THEN 'boolean' ELSE 'double' END AS type, role, allowed FROM (SELECT unnest(string_split(names, ' ')) AS \"column\", role, allowed FROM (VALUES "
    + ", ".join(f"('{role}', '{names}', '{allowed}')" for role, (names, allowed) in _ROLES.items())
    + ") v(role, names, allowed)) u",
)
def column_roles(spark: SparkSession, sf: str) -> DataFrame:
    return role_report(spark)
