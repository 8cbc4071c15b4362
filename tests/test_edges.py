"""Edge rows of ordered operators: ties, gaps at the threshold, backward steps, nulls, single rows, empty tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from driftframe import plans
from driftframe.functions import geo
from driftframe.operators import align, calibrate, clean, experiments, features, outages, roads, scoring
from driftframe.plans.registry import r, rs


def frame(spark, rows, ddl="k long, t double, o long, v double"):
    return spark.createDataFrame(rows, ddl)


def values(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()]


def test_sessions_split_only_beyond_the_gap(spark):
    df = frame(spark, [(1, 0.0, 0, 1.0), (1, 1.0, 1, 1.0), (1, 2.5, 2, 1.0), (2, 9.0, 0, 1.0)])
    got = clean.sessionize(df, ["k"], "t", "o", 1.0).orderBy("k", "t")
    assert values(got, "session") == [0, 0, 1, 0]
    assert clean.sessionize(df.limit(0), ["k"], "t", "o", 1.0).count() == 0


def test_clocks(spark):
    df = frame(spark, [(1, 1.0, 0, 0.0), (1, 1.0, 1, 0.0), (1, 3.0, 2, 0.0), (1, 2.0, 3, 0.0), (1, 2.5, 4, 0.0), (1, None, 5, 0.0), (1, 4.0, 6, 0.0)])
    assert values(clean.strictly_increasing(df, ["k"], "t", "o").orderBy("o"), "o") == [0, 2, 6]
    assert values(clean.adjacent_dedup(df, ["k"], "t", "o").orderBy("o"), "o") == [0, 2, 4]


def test_interpolation_brackets(spark):
    right = frame(spark, [(1, 0.0, 0, 0.0), (1, 1.0, 1, 10.0), (1, 5.0, 2, 50.0), (1, 5.4, 3, 54.0)])
    left = frame(spark, [(1, -1.0, 0, None), (1, 0.0, 1, None), (1, 0.5, 2, None), (1, 1.0, 3, None), (1, 3.0, 4, None), (1, 5.0, 5, None), (1, 5.2, 6, None), (1, 9.0, 7, None), (2, 1.0, 8, None)]).drop("v")
    plain = align.interpolate(left, right, ["k"], "t", "v", "x").orderBy("o")
    assert [None if x is None else round(x, 6) for x in values(plain, "x")] == [None, 0.0, 5.0, 10.0, 30.0, 50.0, 52.0, None, None]
    gap = align.interpolate(left, right, ["k"], "t", "v", "x", max_gap=1.0).orderBy("o")
    # an exact hit after a wide bracket is null, the first row looks ahead
    assert [None if x is None else round(x, 6) for x in values(gap, "x")] == [None, 0.0, 5.0, 10.0, None, None, 52.0, None, None]
    held = align.interpolate(left, right, ["k"], "t", "v", "x", clamp=True).orderBy("o")
    assert values(held, "x")[0] == 0.0 and values(held, "x")[-2] == 54.0 and values(held, "x")[-1] is None


def test_a_gap_query_has_no_bracket_before_the_first_row(spark, tmp_path):
    # the order of 1996-01-01 falls on the first event of its user, and no event stands before it
    stamp = lambda day: f"CAST('{day}' AS TIMESTAMP_NTZ)"
    spark.sql(f"SELECT 1L AS o_orderkey, 0L AS o_custkey, {stamp('1996-01-01')} AS o_orderdate UNION ALL SELECT 2L, 0L, {stamp('1996-01-02')}").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id AS event_id, 0L AS user_id, CAST(10 + id AS DOUBLE) AS value FROM range(5)").write.parquet(f"{tmp_path}/events.parquet")
    got = plans.load()[0]["interp_gap_null"](spark, str(tmp_path)).orderBy("o_orderkey")
    assert values(got, "v") == [None, 14.0]


def test_rounding_tells_a_half_on_the_scaled_number(spark):
    # the mean of 0.41, 0.43 and like ones is a last bit below 0.42075, which times 10^4 is 4207.5
    xs = [0.42074999999999996, 0.9996499999999999, -18478.25165, 2.5, -0.00004, 12.34]
    want = [x for (x,) in duckdb.sql(f"SELECT {rs('x', 4)} FROM (SELECT unnest({xs}::DOUBLE[]) AS x)").fetchall()]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    assert values(df.orderBy("i").select(r("x", 4).alias("x")), "x") == want and want[:2] == [0.4208, 0.9997]
    assert spark.range(1).select(r(F.lit(None).cast("double")).alias("x")).first()[0] is None


def test_a_deviation_on_its_threshold_falls_as_in_the_sql(spark, tmp_path):
    # the deviation of these is 30 but for the last bit, by which the engines' own aggregates differ
    ks = [[96, 30, 79, 52, 28], [79, 45, 12, 31, 3], [90, 66, 58, 34, 12], [4, 42, 25, 66, 78], [81, 73, 12, 39, 25], [66, 68, 5, 24, 12]]
    rows = [(10 * u + j, 60 * j, u, 2.0 + k / 100, f'{{"k": {k}}}') for u, five in enumerate(ks) for j, k in enumerate(five)]
    e = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double, props string").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    e.drop("s").withColumn("event_type", F.lit("view")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    queries, sql = plans.load()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(duck.execute(sql["rolling_stationary"]).fetchall())
    assert sorted(tuple(x) for x in queries["rolling_stationary"](spark, str(tmp_path)).collect()) == want and len(want) == 5 * len(ks)


def test_asof_takes_equal_times_and_forgets_old_values(spark):
    right = frame(spark, [(1, 1.0, 0, 10.0), (1, 2.0, 1, 20.0)])
    left = frame(spark, [(1, 0.5, 0, 0.0), (1, 1.0, 1, 0.0), (1, 2.1, 2, 0.0), (1, 9.0, 3, 0.0)]).drop("v")
    assert values(align.asof_backward(left, right, ["k"], "t", "v", "x", 0.15).orderBy("o"), "x") == [None, 10.0, 20.0, None]


def test_angles(spark):
    df = spark.range(1).select(*(geo.wrap(F.lit(a)).alias(n) for n, a in (("a", math.pi), ("b", -math.pi), ("c", 7.0), ("d", -7.0))))
    a, b, c, d = df.first()
    assert a == b == -math.pi and abs(c - (7 - 2 * math.pi)) < 1e-12 and abs(d - (2 * math.pi - 7)) < 1e-12
    df = frame(spark, [(1, float(i), i, v) for i, v in enumerate([3.0, -3.0, 3.0, -3.0])])
    u = values(align.unwrap(df, ["k"], "v", "t", into="u").orderBy("t"), "u")
    assert [round(x, 3) for x in u] == [3.0, 3.283, 3.0, 3.283]
    e = spark.range(1).select(*geo.heading_error(F.lit(math.pi - 0.1), F.lit(0.0), F.lit(False))).first()
    assert abs(e[0] - 0.1) < 1e-9


def test_gradient_of_short_series(spark):
    df = frame(spark, [(1, 0.0, 0, 0.0), (1, 1.0, 1, 1.0), (1, 3.0, 2, 9.0), (2, 0.0, 0, 5.0), (3, 0.0, 0, 0.0), (3, 0.0, 1, 1.0), (3, 1.0, 2, 3.0)])
    got = align.gradient(df, ["k"], "t", "v", "o", "g").orderBy("k", "o")
    assert values(got, "g") == [1.0, 2.0, 4.0, None, None, 2.0, 2.0]


def test_correlation_of_flat_or_few(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0) for i in range(12)], "a double, b double, c double")
    r = df.agg(align.correlation("a", "b").alias("x"), align.correlation("a", "c").alias("y")).first()
    assert round(r["x"], 9) == 1.0 and r["y"] == 0.0
    assert df.limit(5).agg(align.correlation("a", "b")).first()[0] == 0.0


def test_rolling_needs_full_windows(spark):
    df = frame(spark, [(1, float(i), i, float(i)) for i in range(4)])
    w = clean.series(["k"], "t")
    got = df.withColumn("m", features.rolling("v", w, 3, "mean")).withColumn("p", features.rolling("v", w, 3, "max", partial=True)).withColumn("b", features.rolling_before("v", w, 2)).orderBy("t")
    assert values(got, "m") == [None, None, 1.0, 2.0] and values(got, "p") == [0.0, 1.0, 2.0, 3.0] and values(got, "b") == [None, None, 0.5, 1.5]


def test_runs_break_at_unlabelled_rows(spark):
    df = frame(spark, [(1, float(i), i, 0.0 if i == 10 else 1.0) for i in range(21)])
    ends = features.sequence_ends(df, ["k"], F.col("v") > 0, 5, 1, "t").orderBy("t")
    assert values(ends, "o") == [*range(4, 10), *range(15, 21)]
    assert values(features.sequence_ends(df, ["k"], F.col("v") > 0, 5, 3, "t").orderBy("t"), "o") == [4, 7, 15, 18]
    s = features.sequences(df, ["k"], ["o"], 5, 3, F.col("v") > 0, "t").orderBy("t")
    assert [[x["o"] for x in r[0]] for r in s.select("seq").collect()][0] == [0, 1, 2, 3, 4]


def test_blocks_thinning_and_medians(spark):
    df = frame(spark, [(1, float(i), i, float(i)) for i in range(7)])
    assert values(features.decimate(df, ["k"], ["v"], 3, "t").orderBy("block"), "v") == [1.0, 4.0]
    assert values(features.thin(df, ["k"], 3, "t").orderBy("t"), "o") == [0, 3, 6]
    assert values(features.upper_median(df.limit(4), ["k"], "v"), "o") == [2]


def test_windows_spread_evenly_with_halves_to_even(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(6)] + [("b", 1.0)], "k string, t_start double")
    got = outages.evenly_spread(df, ["k"], 3, "t_start").orderBy("k", "t_start")
    assert [tuple(r) for r in got.collect()] == [("a", 0.0), ("a", 2.0), ("a", 5.0), ("b", 1.0)]


def test_drift_by_its_definition(spark):
    rows = [(1, i / 10, 5.0, 15.0, i * 1.0 + 0.0, 2.0 * max(0.0, min(i / 10, 15.0) - 5.0), i * 1.0, 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "w long, t double, t_start double, t_end double, x double, y double, true_x double, true_y double")
    df = df.withColumns({"disp_x": F.col("x"), "disp_y": F.col("y"), "speed": F.lit(10.0), "true_speed": F.lit(10.0), "yaw": F.lit(0.1), "true_yaw": F.lit(0.0)})
    r = scoring.window_scores(df, ["w"]).first()
    assert abs(r["distance_m"] - 99.0) < 1e-9 and abs(r["final_error_m"] - 19.8) < 1e-9 and abs(r["drift_pct"] - 20.0) < 1e-9
    assert abs(r["mean_error_m"] - 9.9) < 1e-9 and abs(r["heading_abs_deg"] - math.degrees(0.1)) < 1e-9 and r["return_time_s"] is None
    still = scoring.window_scores(df.withColumns({"true_x": F.lit(0.0), "true_speed": F.lit(0.0)}), ["w"]).first()
    assert still["drift_pct"] is None and still["heading_abs_deg"] is None


def test_mode_waits_then_times_out(spark):
    df = frame(spark, [(1, float(i), i, float(i)) for i in range(6)])
    got = outages.mode(df, ["k"], "t", "o", F.col("o").isin(0, 1, 2), 1.5, F.col("v") >= 1).orderBy("t")
    assert values(got, "mode") == ["WAITING FOR GNSS", "GNSS+INS", "GNSS+INS", "GNSS+INS", "DEAD RECKONING", "DEAD RECKONING"]


def test_recurrences_on_single_rows_and_constants(spark):
    df = frame(spark, [(1, 0.0, 0, 4.0), *((2, float(i), i, 3.0) for i in range(30))])
    got = features.low_pass(df, ["k"], ["t", "o"], "v", 2.0, 10.0, "y")
    assert all(abs(a - b) < 1e-9 for a, b in values(got, "v", "y"))


def test_the_end_of_a_track_is_no_mark(spark):
    # F8: 0.1 + 0.2 is a last bit above 0.3, so a length of 0.3 showed a mark at its end
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.1, 0.0), (1, 2, 0.1, 0.2), (2, 0, 0.0, 0.0), (2, 1, 0.7, 0.0)], "k int, o int, x double, y double")
    assert values(roads.trace_segments(df, ["k"], "x", "y", "o", 0.3).orderBy("k", "seq"), "k", "seq") == [(2, 0), (2, 1)]


def test_radius_join_finds_each_pair_once(spark):
    s = roads.geometry(spark.createDataFrame([(0, 0.0, 0.0, 500.0, 0.0), (1, 0.0, 25.0, 500.0, 25.0), (2, 3.0, 3.0, 3.05, 3.0)], "seg int, x0 double, y0 double, x1 double, y1 double"))
    p = spark.createDataFrame([(0, 250.0, 10.0), (1, -5.0, 0.0), (2, 250.0, 90.0)], "p int, x double, y double")
    got = roads.radius_join(p, s, 16.0).orderBy("p", "seg")
    assert values(got, "p", "seg") == [(0, 0), (0, 1), (1, 0)] and values(got, "distance") == [10.0, 15.0, 5.0]


def test_rotation_fit_and_means_with_fallbacks(spark):
    c, s = math.cos(0.7), math.sin(0.7)
    df = spark.createDataFrame([(1, float(i), float(i % 3), c * i - s * (i % 3) + 5, s * i + c * (i % 3) - 2) for i in range(10)], "k int, hx double, hy double, ex double, ey double")
    assert abs(calibrate.plane_rotation(df, ["k"], "hx", "hy", "ex", "ey").first()["theta"] - 0.7) < 1e-9
    m = df.groupBy("k").agg(calibrate.masked_mean("hx", [(F.col("hx") > 100, 0), (F.col("hx") > 7, 1)]).alias("m")).first()["m"]
    assert m == 8.5


def test_splits_and_grids(spark):
    m = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "val")], "drive string, split string")
    assert values(experiments.split_overlap(m, "drive", "split"), "drive") == ["a"]
    g = experiments.grid(spark, x=[1, 2], y=["p", "q", "r"])
    assert values(g.orderBy("point"), "point", "x", "y") == [(0, 1, "p"), (1, 1, "q"), (2, 1, "r"), (3, 2, "p"), (4, 2, "q"), (5, 2, "r")]
    facts = spark.createDataFrame([(3, None)], "n int, z boolean")
    a = {r["check"]: r["passed"] for r in experiments.audit([("some", F.col("n") > 0), ("known", F.col("z"))], facts).collect()}
    assert a == {"some": True, "known": False, "all": False}


def test_reports(spark):
    df = spark.createDataFrame([(30.0, v, 5.0 + i) for i, v in enumerate(["D", "A", "C+NHC"])], "duration_s double, variant string, drift_pct double")
    df = df.withColumns({c: F.col("drift_pct") for c in ("distance_m", "final_error_m", "mean_error_m", "speed_rms", "heading_abs_deg", "return_step_m")})
    out = scoring.verdict(scoring.summarise(df), 6.5)
    assert values(out, "variant", "verdict") == [("A", "PASS"), ("C+NHC", "FAIL"), ("D", "PASS")]
    assert scoring.markdown(out.select("variant", "median_drift_pct")).splitlines()[2] == "| A | 6.00 |"


@pytest.mark.parametrize("n", [0, 1])
def test_frame_audit_of_few_rows(spark, n):
    df = frame(spark, [(1, 0.0, 0, None)]).limit(n)
    got = clean.frame_audit(df, ["k"], "t", "o", F.col("v")).collect()
    assert len(got) == n and (n == 0 or (got[0]["n_rows"], got[0]["duration_s"], got[0]["monotonic"], got[0]["nulls"]) == (1, 0.0, True, 1))
