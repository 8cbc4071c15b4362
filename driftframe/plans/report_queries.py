"""Joins of sets, experiment grids, reports and audits over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.operators import experiments, scoring
from driftframe.operators.clean import keep_last
from driftframe.plans.registry import drive, query, r, rs
from driftframe.runtime import sized, table

_LABEL = "CASE l_linenumber % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'C+NHC' ELSE 'D' END"
_DUR = "CASE l_returnflag WHEN 'A' THEN 30 WHEN 'N' THEN 60 ELSE 120 END"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """Line items read as scored windows: return flag is duration, line number the variant, discount the drift."""
    li = table(spark, sf, "lineitem")
    v = F.element_at(F.array(*(F.lit(x) for x in scoring.VARIANTS)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    d = F.when(F.col("l_returnflag") == "A", 30).when(F.col("l_returnflag") == "N", 60).otherwise(120)
    p = F.col("l_extendedprice")
    return li.select(
        d.alias("duration_s"), v.alias("variant"), (p / 100.0).alias("distance_m"), (F.col("l_discount") * 100 + F.col("l_quantity") / 10.0).alias("drift_pct"), (p / 1000.0).alias("final_error_m"),
        (F.col("l_quantity") / 3.0).alias("mean_error_m"), F.col("l_tax").alias("speed_rms"), F.when(F.col("l_tax") > 0.01, F.col("l_tax") * 90).alias("heading_abs_deg"), F.col("l_quantity").alias("return_step_m"),
    )


_SUMMARY = f"""SELECT {_DUR} AS duration_s, {_LABEL} AS variant, count(*) AS windows, {rs('avg(l_extendedprice / 100e0)', 4)} AS distance_m, {rs('median(l_discount * 100 + l_quantity / 10e0)')} AS median_drift_pct,
    {rs('avg(l_discount * 100 + l_quantity / 10e0)')} AS mean_drift_pct, {rs('median(l_extendedprice / 1000e0)')} AS median_final_m, {rs('median(l_quantity / 3e0)')} AS median_error_m, {rs('median(l_tax)')} AS speed_rms,
    {rs('median(CASE WHEN l_tax > 0.01e0 THEN l_tax * 90 END)')} AS heading_abs_deg, {rs('median(l_quantity)')} AS return_step_m FROM lineitem GROUP BY 1, 2"""
_ROUND = ("median_drift_pct", "mean_drift_pct", "median_final_m", "median_error_m", "speed_rms", "heading_abs_deg", "return_step_m")


@query("benchmark_summary", _SUMMARY)
def benchmark_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = scoring.summarise(_scores(spark, sf))
    return s.select("duration_s", "variant", "windows", r("distance_m", 4).alias("distance_m"), *(r(c).alias(c) for c in _ROUND))


@query("benchmark_verdict", f"SELECT duration_s, variant, CASE WHEN median_drift_pct < 7.5e0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({_SUMMARY}) x")
def benchmark_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.verdict(scoring.summarise(_scores(spark, sf)), 7.5).select("duration_s", "variant", "verdict")


@query(
    "ablation_summary",
    f"""SELECT s.setting, {_DUR} AS duration_s, {_LABEL} AS variant, {rs('median((l_discount * 100 + l_quantity / 10e0) * s.gain)')} AS drift, {rs('median(l_extendedprice / 1000e0)')} AS endpoint, {rs('median(l_tax)')} AS speed
    FROM lineitem, (VALUES ('base', 1e0), ('no map', 1.25e0), ('no nhc', 1.5e0)) s(setting, gain) GROUP BY 1, 2, 3""",
)
def ablation_summary(spark: SparkSession, sf: str) -> DataFrame:
    settings = spark.createDataFrame([("base", 1.0), ("no map", 1.25), ("no nhc", 1.5)], "setting string, gain double")
    x = experiments.for_each(_scores(spark, sf), settings).withColumn("d", F.col("drift_pct") * F.col("gain"))
    g = x.groupBy("setting", "duration_s", "variant")
    return g.agg(r(F.median("d")).alias("drift"), r(F.median("final_error_m")).alias("endpoint"), r(F.median("speed_rms")).alias("speed"))


@query(
    "variant_crossjoin",
    """SELECT o_orderkey, v.variant, v.ordinal FROM orders, (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'C+NHC'), (4, 'D')) v(ordinal, variant)""",
)
def variant_crossjoin(spark: SparkSession, sf: str) -> DataFrame:
    v = spark.createDataFrame(list(enumerate(scoring.VARIANTS)), "ordinal int, variant string")
    return experiments.for_each(table(spark, sf, "orders").select("o_orderkey"), v)


@query(
    "param_grid_pivot",
    f"""WITH g AS (SELECT CAST(row_number() OVER (ORDER BY a.i, b.i, c.i) - 1 AS INTEGER) AS point, a.v AS sigma, b.v AS scale, c.v AS across FROM (VALUES (0, 0.1e0), (1, 0.15e0), (2, 0.2e0)) a(i, v), (VALUES (0, 0.5e0), (1, 1e0), (2, 2e0)) b(i, v), (VALUES (0, 4e0), (1, 8e0)) c(i, v)),
    x AS (SELECT l_suppkey % 18 AS point, {_LABEL} AS variant, l_discount * 100 + l_quantity / 10e0 AS drift FROM lineitem)
    SELECT g.*, {rs("median(drift) FILTER (variant = 'D')")} AS d, {rs("median(drift) FILTER (variant = 'C+NHC')")} AS no_map FROM g JOIN x USING (point) GROUP BY ALL""",
)
def param_grid_pivot(spark: SparkSession, sf: str) -> DataFrame:
    g = experiments.grid(spark, sigma=[0.1, 0.15, 0.2], scale=[0.5, 1.0, 2.0], across=[4.0, 8.0])
    v = F.element_at(F.array(*(F.lit(x) for x in scoring.VARIANTS)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    x = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 18).cast("int").alias("point"), v.alias("variant"), (F.col("l_discount") * 100 + F.col("l_quantity") / 10.0).alias("drift"))
    p = experiments.pivot_medians(x, ["point"], "variant", "drift", ["D", "C+NHC"])
    return g.join(p, "point").select("point", "sigma", "scale", "across", r("D").alias("d"), r("`C+NHC`").alias("no_map"))


@query(
    "tuning_top5",
    f"""SELECT l_suppkey % 18 AS point, {rs('median(CASE WHEN l_linenumber % 5 = 4 THEN l_discount * 100 + l_quantity / 10e0 END)')} AS drift FROM lineitem GROUP BY 1 ORDER BY 2, 1 LIMIT 5""",
)
def tuning_top5(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 18).alias("point"))
    return x.agg(r(F.median(F.when(F.col("l_linenumber") % 5 == 4, F.col("l_discount") * 100 + F.col("l_quantity") / 10.0))).alias("drift")).orderBy("drift", "point").limit(5)


@query(
    "split_overlap",
    """SELECT o_custkey, count(DISTINCT split) AS n_splits FROM (SELECT o_custkey, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'val' ELSE 'test' END AS split FROM orders) GROUP BY 1 HAVING count(DISTINCT split) > 1""",
)
def split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    o = table(spark, sf, "orders").select("o_custkey", F.when(d < F.lit("1997-01-01").cast("date"), "train").when(d < F.lit("1999-01-01").cast("date"), "val").otherwise("test").alias("split"))
    return experiments.split_overlap(o, "o_custkey", "split")


@query("anti_holdout", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_holdout(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return experiments.without(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), held, ["c_custkey"])


@query("unknown_ids", "SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def unknown_ids(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.unknown(table(spark, sf, "events").select(F.col("user_id").alias("id")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), "id")


@query("common_ids", "SELECT user_id AS id FROM events INTERSECT SELECT s_suppkey FROM supplier")
def common_ids(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.common(table(spark, sf, "events").select(F.col("user_id").alias("id")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))


@query("union_ids", "SELECT count(*) AS n, count(DISTINCT id) AS n_distinct FROM (SELECT user_id AS id FROM events UNION ALL SELECT s_suppkey FROM supplier)")
def union_ids(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "events").select(F.col("user_id").alias("id")).unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))
    return both.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_distinct"))


@query(
    "rounded_key_lookup",
    f"""SELECT s_suppkey, {rs('s.s_acctbal')} AS balance, {rs('p.price')} AS price FROM supplier s LEFT JOIN (SELECT CAST(floor(p_retailprice + 0.5e0) AS BIGINT) AS k, max(p_retailprice) AS price FROM part GROUP BY 1) p ON CAST(floor(s.s_acctbal + 0.5e0) AS BIGINT) = p.k""",
)
def rounded_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").groupBy(F.floor(F.col("p_retailprice") + 0.5).alias("k")).agg(F.max("p_retailprice").alias("price"))
    s = table(spark, sf, "supplier").withColumn("k", F.floor(F.col("s_acctbal") + 0.5))
    return s.join(p, "k", "left").select("s_suppkey", r("s_acctbal").alias("balance"), r("price").alias("price"))


@query("keep_last_dedup", f"SELECT user_id, event_type, max(event_id) AS event_id, {rs('max_by(value, event_id)')} AS value FROM events GROUP BY 1, 2")
def keep_last_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return keep_last(table(spark, sf, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", r("value").alias("value"))


@query("event_kind_counts", "SELECT user_id, CAST(count_if(event_type = 'click') AS BIGINT) AS click, CAST(count_if(event_type = 'signup') AS BIGINT) AS signup, CAST(count_if(event_type = 'slip') AS BIGINT) AS slip FROM events GROUP BY 1")
def event_kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.event_counts(table(spark, sf, "events").withColumn("kind", F.col("event_type")), ["user_id"], ("click", "signup", "slip"))


@query("update_log_counts", "{DRIVE} SELECT drive_id, event_type AS source, count(*) AS n FROM drive WHERE t >= 86400 AND t < 864000 AND k < 80 GROUP BY 1, 2")
def update_log_counts(spark: SparkSession, sf: str) -> DataFrame:
    log = drive(spark, sf, False).select("drive_id", "t", F.col("event_type").alias("source"), (F.col("k") < 80).alias("accepted"))
    return scoring.update_counts(log, ["drive_id"], 86400.0, 864000.0)


@query(
    "distance_km",
    f"""{{DRIVE}}, s AS (SELECT drive_id, speed, t - lag(t) OVER (PARTITION BY drive_id ORDER BY t, event_id) AS dt FROM drive) SELECT drive_id, {rs('coalesce(sum(speed * dt), 0) / 1000', 3)} AS km FROM s GROUP BY 1""",
)
def distance_km(spark: SparkSession, sf: str) -> DataFrame:
    from driftframe.operators.clean import series

    d = drive(spark, sf, False).withColumn("dt", F.col("t") - F.lag("t").over(series(["drive_id"], "t", "event_id")))
    return d.groupBy("drive_id").agg(r(F.coalesce(F.sum(F.col("speed") * F.col("dt")), F.lit(0.0)) / 1000, 3).alias("km"))


@query(
    "leakage_audit",
    """{DRIVE}, f AS (SELECT count(*) AS n, count(DISTINCT event_id) AS ids, min(t) AS lo, count_if(speed IS NULL) AS nulls, count_if(yaw > pi() / 2 + 1e-9) AS wide, count_if(healthy AND NOT valid) AS clash FROM drive),
    c AS (SELECT unnest(['rows', 'unique', 'clock', 'no_nulls', 'yaw_range', 'mask']) AS "check", unnest([n > 0, n = ids, lo = 0, nulls = 0, wide = 0, clash = 0]) AS passed FROM f)
    SELECT "check", passed FROM c UNION ALL SELECT 'all', bool_and(passed) FROM c""",
)
def leakage_audit(spark: SparkSession, sf: str) -> DataFrame:
    facts = drive(spark, sf, False).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"), F.min("t").alias("lo"), F.count_if(F.col("speed").isNull()).alias("nulls"),
        F.count_if(F.col("yaw") > F.lit(1.5707963267948966 + 1e-9)).alias("wide"), F.count_if(F.col("healthy") & ~F.col("valid")).alias("clash"),
    )
    c = F.col
    return experiments.audit(
        [("rows", c("n") > 0), ("unique", c("n") == c("ids")), ("clock", c("lo") == 0), ("no_nulls", c("nulls") == 0), ("yaw_range", c("wide") == 0), ("mask", c("clash") == 0)], facts
    )


@query("manifest_bytes", "SELECT n_regionkey, CAST(sum(s_suppkey) AS BIGINT) AS bytes, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def manifest_bytes(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "supplier").join(sized(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_regionkey").agg(F.sum("s_suppkey").alias("bytes"), F.count(F.lit(1)).alias("n"))


@query(
    "drift_so_far",
    f"""{{DRIVE}}, s AS (SELECT drive_id, event_id, t, east, north, coalesce(sqrt((east - lag(east) OVER w) ** 2 + (north - lag(north) OVER w) ** 2), 0) AS stp FROM drive WINDOW w AS (PARTITION BY drive_id ORDER BY t, event_id)),
    c AS (SELECT *, sum(CASE WHEN t >= 432000 AND t < 1296000 THEN stp ELSE 0 END) OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS dist FROM s)
    SELECT drive_id, event_id, {rs('t - 432000', 3)} AS rel_t, {rs('dist', 3)} AS blackout_dist FROM c WHERE t - 432000 >= -86400 AND t - 432000 <= 864000 + 43200""",
)
def drift_so_far(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    from driftframe.operators import outages
    from driftframe.operators.clean import series

    w = series(["drive_id"], "t", "event_id")
    d = drive(spark, sf).withColumn("step", F.coalesce(outages.path_step("east", "north", w), F.lit(0.0)))
    inside = (F.col("t") >= 432000) & (F.col("t") < 1296000)
    d = d.withColumn("dist", F.sum(F.when(inside, F.col("step")).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rel = F.col("t") - 432000
    return d.where((rel >= -86400) & (rel <= 864000 + 43200)).select("drive_id", "event_id", r(rel, 3).alias("rel_t"), r("dist", 3).alias("blackout_dist"))
