"""Streams give what the batch plans give."""

import numpy as np
from pyspark.sql import functions as F

from driftframe.kernels.engine import VARIANTS, Engine
from driftframe.operators import navigate
from driftframe.plans import navigation, stream_queries
from driftframe.streaming import engine, relational


def test_engine_on_shuffled_files_equals_batch(spark, tmp_path):
    rows = stream_queries.engine_input(spark, 2).select("drive_id", *engine.INPUT).where("t < 260").cache()
    folder = str(tmp_path / "in")
    after = rows.where("t = 0").withColumns({"t": F.col("t") + 2000.0, "ts": F.col("ts") + F.expr("interval 2000 seconds")})
    rows.repartition(5, F.floor(F.col("t") / 11)).write.parquet(folder)
    after.coalesce(1).write.mode("append").parquet(folder)
    s = relational.file_stream(spark, folder, rows.schema, files_per_trigger=1)
    out = relational.run_to_memory(spark, engine.navigate(s, navigation.CFG, "B", 10.0, "400 seconds"), "engine_out", "append", str(tmp_path / "cp"))
    got = out.where("kind = 'state'").toPandas()
    assert out.where("kind = 'late'").count() == 0
    for drive, pdf in rows.toPandas().groupby("drive_id"):
        pdf = pdf.sort_values("t")
        e = Engine(navigation.CFG, navigate.unpack(pdf["alignment"].iloc[0]), VARIANTS["B"], 10.0)
        want = np.array([r[1:7] for r in navigate.run(e, pdf)], float)
        mine = got[got["drive_id"] == drive].sort_values("t")
        assert len(mine) == len(pdf) and np.abs(mine[["x", "y", "v_f", "v_l", "yaw", "pos_sigma"]].to_numpy(float) - want).max() <= 1e-9
    inside = out.where("kind = 'update' and t >= 200 and t < 230 and source like 'gnss%'")
    assert inside.count() == 0


def test_switch_off_satellites(spark, tmp_path):
    rows = stream_queries.engine_input(spark, 1).select("drive_id", *engine.INPUT).where("t < 60").withColumn("enabled", F.col("t") < 40).withColumn("gnss_healthy", F.lit(True))
    folder = str(tmp_path / "in")
    after = rows.where("t = 0").withColumns({"t": F.col("t") + 500.0, "ts": F.col("ts") + F.expr("interval 500 seconds")})
    rows.coalesce(1).write.parquet(folder)
    after.coalesce(1).write.mode("append").parquet(folder)
    s = relational.file_stream(spark, folder, rows.schema, files_per_trigger=1)
    out = relational.run_to_memory(spark, engine.navigate(s, navigation.CFG, "B", 10.0, "100 seconds"), "engine_off", "append", str(tmp_path / "cp"))
    assert out.where("kind = 'update' and t >= 40 and source like 'gnss%'").count() == 0
    assert out.where("kind = 'state' and t > 42 and mode = 'DEAD RECKONING'").count() > 100
