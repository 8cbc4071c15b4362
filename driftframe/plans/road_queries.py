"""Road maps from drive tracks: resampling, radius joins, adjacency and match scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.operators import roads
from driftframe.plans.registry import drive, query, r, rs

SPACING, RADIUS = 8.0, 19.8765

_TRACE = """{DRIVE}, st AS (SELECT drive_id, event_id, t, east, north, coalesce(sqrt((east - lag(east) OVER w) ** 2 + (north - lag(north) OVER w) ** 2), 0e0) AS d FROM drive WINDOW w AS (PARTITION BY drive_id ORDER BY t, event_id)),
    cu AS (SELECT *, sum(d) OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s0 FROM st),
    nx AS (SELECT *, lead(s0) OVER w AS s1, lead(east) OVER w AS ex, lead(north) OVER w AS ny FROM cu WINDOW w AS (PARTITION BY drive_id ORDER BY t, event_id)),
    mk AS (SELECT *, unnest(range(CAST(ceil(s0 / 8e0) AS BIGINT), CAST(ceil(s1 / 8e0) AS BIGINT))) AS seq FROM nx WHERE s1 > s0),
    pt AS (SELECT drive_id, seq, east + (seq * 8e0 - s0) / (s1 - s0) * (ex - east) AS x0, north + (seq * 8e0 - s0) / (s1 - s0) * (ny - north) AS y0 FROM mk),
    sg AS (SELECT * FROM (SELECT *, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1 FROM pt WINDOW w AS (PARTITION BY drive_id ORDER BY seq)) WHERE x1 IS NOT NULL)"""


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return roads.trace_segments(drive(spark, sf), ["drive_id"], "east", "north", "event_id", SPACING)


@query("trace_resample", _TRACE + f" SELECT drive_id, seq, {rs('x0', 3)} AS x0, {rs('y0', 3)} AS y0, {rs('x1', 3)} AS x1, {rs('y1', 3)} AS y1 FROM sg")
def trace_resample(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf).select("drive_id", "seq", *(r(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")))


_NET = (
    _TRACE
    + """, ge AS (SELECT drive_id * 100000 + seq AS seg, drive_id, drive_id // 3 AS region, seq, x0, y0, x1, y1, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len, seq % 3 = 0 AS oneway FROM sg),
    gm AS (SELECT *, (x1 - x0) / len AS ux, (y1 - y0) / len AS uy, atan2(y1 - y0, x1 - x0) AS ryaw FROM ge WHERE len > 0.1e0),
    po AS (SELECT event_id, drive_id // 3 AS region, east AS x, north AS y, yaw FROM drive),
    cd AS (SELECT po.event_id, po.x, po.y, po.yaw, seg, ryaw, oneway, x0 + ux * least(greatest((x - x0) * ux + (y - y0) * uy, 0), len) AS px, y0 + uy * least(greatest((x - x0) * ux + (y - y0) * uy, 0), len) AS py FROM po JOIN gm
      ON po.region = gm.region AND abs(po.x - (x0 + x1) / 2) <= 25 + len AND abs(po.y - (y0 + y1) / 2) <= 25 + len),
    ds AS (SELECT *, sqrt((px - x) ** 2 + (py - y) ** 2) AS distance FROM cd), rj AS (SELECT * FROM ds WHERE distance <= 19.8765e0)"""
)


def _network(spark: SparkSession, sf: str) -> DataFrame:
    s = _segments(spark, sf).withColumn("seg", F.col("drive_id") * 100000 + F.col("seq")).withColumn("oneway", F.col("seq") % 3 == 0)
    return roads.geometry(s.withColumn("region", F.floor(F.col("drive_id") / 3)).drop("drive_id"))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    p = drive(spark, sf).select("event_id", F.floor(F.col("drive_id") / 3).alias("region"), F.col("east").alias("x"), F.col("north").alias("y"), "yaw")
    return roads.radius_join(p, _network(spark, sf), RADIUS, keys=("region",))


@query("radius_join", _NET + f" SELECT event_id, seg, {rs('distance', 3)} AS distance, {rs('px', 3)} AS px, {rs('py', 3)} AS py FROM rj")
def radius_join(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).select("event_id", "seg", *(r(c, 3).alias(c) for c in ("distance", "px", "py")))


_SCORED = (
    _NET
    + """, he AS (SELECT *, abs((yaw - ryaw) - 2 * pi() * floor(((yaw - ryaw) + pi()) / (2 * pi()))) AS fwd, abs((yaw - ryaw - pi()) - 2 * pi() * floor(((yaw - ryaw - pi()) + pi()) / (2 * pi()))) AS bwd FROM rj),
    ue AS (SELECT *, CASE WHEN bwd < fwd AND NOT oneway THEN bwd ELSE fwd END AS herr FROM he), sc AS (SELECT *, (distance / 16e0) ** 2 + (herr / (radians(35e0) / 2)) ** 2 AS score FROM ue WHERE herr <= radians(35e0))"""
)


@query("match_score", _SCORED + f" SELECT event_id, seg, {rs('degrees(herr)', 3)} AS heading_error_deg, {rs('score', 4)} AS score FROM sc")
def match_score(spark: SparkSession, sf: str) -> DataFrame:
    s = roads.match_scores(_candidates(spark, sf), "yaw").where(F.col("score") < float("inf"))
    return s.select("event_id", "seg", r(F.degrees("heading_error"), 3).alias("heading_error_deg"), r("score", 4).alias("score"))


@query("best_match", _SCORED + f", rk AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(score, 9), seg) AS nth FROM sc WHERE score <= 6) SELECT event_id, seg, {rs('score', 4)} AS score FROM rk WHERE nth = 1")
def best_match(spark: SparkSession, sf: str) -> DataFrame:
    return roads.best_match(roads.match_scores(_candidates(spark, sf), "yaw"), ["event_id"]).select("event_id", "seg", r("score", 4).alias("score"))


@query(
    "road_adjacency",
    """WITH w AS (SELECT o_orderkey AS seg, o_custkey AS node_a, o_orderkey // 3 + 1000000 AS node_b FROM orders), e AS (SELECT seg, node_a AS node FROM w UNION SELECT seg, node_b FROM w)
    SELECT DISTINCT l.seg, r.seg AS nbr FROM e l JOIN e r USING (node)""",
)
def road_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    from driftframe.runtime import table

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seg"), F.col("o_custkey").alias("node_a"), (F.floor(F.col("o_orderkey") / 3) + 1000000).alias("node_b"))
    return roads.adjacency_by_node(o)


_ADJ = """{DRIVE}, s AS (SELECT event_id AS seg, drive_id // 3 AS region, round(east, 1) AS x0, round(north, 1) AS y0, round(east + speed * cos(yaw), 1) AS x1, round(north + speed * sin(yaw), 1) AS y1 FROM drive),
    e AS (SELECT region, seg, x0 AS x, y0 AS y FROM s UNION SELECT region, seg, x1, y1 FROM s), q AS (SELECT DISTINCT region, x AS qx, y AS qy FROM e),
    n AS (SELECT DISTINCT q.region, qx, qy, seg FROM q JOIN e ON q.region = e.region AND abs(x - qx) <= 5 AND abs(y - qy) <= 5 AND sqrt((x - qx) ** 2 + (y - qy) ** 2) <= 4.83e0)
    SELECT DISTINCT a.seg, b.seg AS nbr FROM n a JOIN n b USING (region, qx, qy)"""


@query("geometric_adjacency", _ADJ)
def geometric_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    d = drive(spark, sf)
    one = lambda c: F.round(c, 1)
    s = d.select(
        F.col("event_id").alias("seg"), F.floor(F.col("drive_id") / 3).alias("region"), one(F.col("east")).alias("x0"), one(F.col("north")).alias("y0"), one(F.col("east") + F.col("speed") * F.cos("yaw")).alias("x1"), one(F.col("north") + F.col("speed") * F.sin("yaw")).alias("y1")
    )
    return roads.adjacency_by_distance(s, 4.83, keys=("region",))


