"""Road maps as tables: segments, projection, radius joins by grid cells, adjacency, stateless match scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.functions.geo import heading_error
from driftframe.operators.clean import series


def geometry(segments: DataFrame, least: float = 0.1) -> DataFrame:
    """segments(x0, y0, x1, y1) longer than `least`, with length, direction and yaw."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    s = segments.withColumn("length", F.hypot(dx, dy)).where(F.col("length") > least)
    return s.withColumns({"ux": dx / F.col("length"), "uy": dy / F.col("length"), "road_yaw": F.atan2(dy, dx)})


def trace_segments(df: DataFrame, keys: list[str], x: str, y: str, order: str, spacing: float) -> DataFrame:
    """Each track resampled every `spacing` metres of its length, as segments between neighbouring points: keys, seq, x0, y0, x1, y1."""
    w = series(keys, order)
    d = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    p = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("d_", d).withColumn("s0", F.sum("d_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumns({"s1": F.lead("s0").over(w), "nx_": F.lead(x).over(w), "ny_": F.lead(y).over(w)}).where("s1 > s0")
    # the marks k * spacing in [s0, s1) fall on this step; the track's end is no mark, whatever the last bits of the sums say
    upto = lambda s: F.ceil(F.round(F.col(s) / spacing, 9)).cast("long")
    first, last = upto("s0"), upto("s1") - 1
    marks = p.where(first <= last).withColumn("seq", F.explode(F.sequence(first, last)))
    u = (F.col("seq") * F.lit(float(spacing)) - F.col("s0")) / (F.col("s1") - F.col("s0"))
    pts = marks.select(*keys, "seq", (F.col(x) + u * (F.col("nx_") - F.col(x))).alias("x0"), (F.col(y) + u * (F.col("ny_") - F.col(y))).alias("y0"))
    v = Window.partitionBy(*keys).orderBy("seq")
    return pts.withColumns({"x1": F.lead("x0").over(v), "y1": F.lead("y0").over(v)}).where("x1 is not null")


def _cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, cell: float, reach: float) -> DataFrame:
    """df once for every grid cell that its box, widened by reach, touches."""
    low = lambda a, b: F.floor((F.least(a, b) - reach) / cell).cast("long")
    high = lambda a, b: F.floor((F.greatest(a, b) + reach) / cell).cast("long")
    return df.withColumn("cx_", F.explode(F.sequence(low(x0, x1), high(x0, x1)))).withColumn("cy_", F.explode(F.sequence(low(y0, y1), high(y0, y1))))


def radius_join(points: DataFrame, segments: DataFrame, radius: float, x: str = "x", y: str = "y", keys: tuple[str, ...] = ()) -> DataFrame:
    """Points with every segment of geometry() within the radius, its nearest point (px, py) and distance.

    Segments go to the cells that their box widened by the radius touches; a point meets those of its own cell only, so no
    pair is made twice and none beyond neighbouring cells. keys: columns that must be equal too, such as a region.
    """
    cell = max(2 * radius, 1e-6)
    s = _cells(segments, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), cell, radius)
    p = points.withColumns({"cx_": F.floor(F.col(x) / cell).cast("long"), "cy_": F.floor(F.col(y) / cell).cast("long")})
    j = p.join(s, [*keys, "cx_", "cy_"]).drop("cx_", "cy_")
    along = (F.col(x) - F.col("x0")) * F.col("ux") + (F.col(y) - F.col("y0")) * F.col("uy")
    u = F.least(F.greatest(along, F.lit(0.0)), F.col("length"))
    j = j.withColumns({"px": F.col("x0") + F.col("ux") * u, "py": F.col("y0") + F.col("uy") * u})
    return j.withColumn("distance", F.hypot(F.col("px") - F.col(x), F.col("py") - F.col(y))).where(F.col("distance") <= radius)


def adjacency_by_node(segments: DataFrame, seg: str = "seg", a: str = "node_a", b: str = "node_b") -> DataFrame:
    """(seg, nbr) of segments that share a node; a segment is its own neighbour."""
    ends = segments.select(F.col(seg).alias("seg"), F.explode(F.array(a, b)).alias("node")).distinct()
    return ends.alias("l").join(ends.alias("r"), F.col("l.node") == F.col("r.node")).select(F.col("l.seg").alias("seg"), F.col("r.seg").alias("nbr")).distinct()


def adjacency_by_distance(segments: DataFrame, radius: float, seg: str = "seg", keys: tuple[str, ...] = ()) -> DataFrame:
    """(seg, nbr) of segments with end points within the radius of a common end point (and equal keys); grid cells bound the pairs."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ends = segments.select(*keys, F.col(seg).alias("seg"), F.explode(F.array(point("x0", "y0"), point("x1", "y1"))).alias("e")).select(*keys, "seg", "e.x", "e.y").distinct()
    centres = ends.select(*keys, F.col("x").alias("qx"), F.col("y").alias("qy")).distinct()
    cell = max(radius, 1e-6)
    at = ends.withColumns({"cx_": F.floor(F.col("x") / cell).cast("long"), "cy_": F.floor(F.col("y") / cell).cast("long")})
    around = _cells(centres, F.col("qx"), F.col("qy"), F.col("qx"), F.col("qy"), cell, radius)
    near = around.join(at, [*keys, "cx_", "cy_"]).where(F.hypot(F.col("x") - F.col("qx"), F.col("y") - F.col("qy")) <= radius).select(*keys, "qx", "qy", "seg").distinct()
    return near.join(near.withColumnRenamed("seg", "nbr"), [*keys, "qx", "qy"]).select("seg", "nbr").distinct()


def match_scores(candidates: DataFrame, yaw: str, sigma_across: float = 8.0, gate_deg: float = 35.0) -> DataFrame:
    """Candidates of radius_join() with heading error, direction used and score; beyond the heading gate the score is infinite."""
    err, used = heading_error(F.col(yaw), F.col("road_yaw"), F.col("oneway"))
    gate = math.radians(gate_deg)
    score = F.pow(F.col("distance") / (2 * sigma_across), F.lit(2.0)) + F.pow(err / (gate / 2), F.lit(2.0))
    return candidates.withColumns({"heading_error": err, "used_yaw": used}).withColumn("score", F.when(F.col("heading_error") > gate, F.lit(float("inf"))).otherwise(score))


def best_match(scored: DataFrame, keys: list[str], seg: str = "seg", max_score: float = 6.0) -> DataFrame:
    """The best candidate of each point at most max_score away; scores equal to nine places go to the lower segment."""
    w = Window.partitionBy(*keys).orderBy(F.round("score", 9), seg)
    return scored.where(F.col("score") <= max_score).withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")
