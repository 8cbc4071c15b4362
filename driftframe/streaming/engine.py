"""The navigation engine on a stream: one engine a drive, the same kernel as in batch.

A drive's rows are held until the watermark has passed them and then released in order of t, so rows may come shuffled over
micro-batches; rows at or before the last released t are dropped and counted. State of a drive: the pickled engine (a few kB),
the held rows, the last released t. Logs are given out, never kept. A column `enabled` (true where absent) switches
satellites off: fixes of rows where it is false are not looked at.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftframe.kernels.engine import VARIANTS, Engine
from driftframe.kernels.speed import SpeedModel
from driftframe.operators.navigate import ACC, GYRO, fixes, unpack

OUTPUT = (
    "drive_id string, kind string, t double, x double, y double, v_f double, v_l double, yaw double, pos_sigma double, mode string, source string, accepted boolean, nis double, magnitude double, dropped long"
)
_COLUMNS = [c.strip().split(" ")[0] for c in OUTPUT.split(",")]
INPUT = ["t", "ts", *ACC, *GYRO, "gnss_x", "gnss_y", "gnss_speed", "gnss_yaw", "gnss_std", "gnss_healthy", "enabled", "alignment"]


def _release(engine: Engine, drive: str, rows: pd.DataFrame) -> list[tuple]:
    out = []
    acc, gyro, t, on = rows[ACC].to_numpy(float), rows[GYRO].to_numpy(float), rows["t"].tolist(), rows["enabled"].fillna(True).tolist()
    for i, fix in enumerate(fixes(rows)):
        engine.enabled = bool(on[i])
        s = engine.step(t[i], acc[i], gyro[i], fix)
        out.append((drive, "state", s[0], s[1], s[2], s[3], s[4], s[5], s[6], s[9], None, None, None, None, None))
    log, events = engine.drain()
    out += [(drive, "update", u[0], None, None, None, None, None, None, None, u[1], bool(u[2]), float(u[3]), None, None) for u in log]
    out += [(drive, "anomaly", e[0], None, None, None, None, None, None, e[3], e[1], None, None, float(e[2]), None) for e in events]
    return out


def navigate(stream: DataFrame, cfg: dict, variant: str, rate_hz: float, lateness: str = "2 seconds", model: str | None = None) -> DataFrame:
    """Trajectory, updates and anomalies (kind: state, update, anomaly, late) of a stream of masked samples with their alignment."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        drive = key[0]
        engine, held, released = pickle.loads(state.get[0]) if state.exists else (None, pd.DataFrame(columns=INPUT), -np.inf)
        new = [b for b in batches if len(b)]
        dropped = 0
        if new:
            rows = pd.concat(new)[INPUT]
            late = rows["t"] <= released
            dropped = int(late.sum())
            held = pd.concat([held, rows[~late]]) if len(held) else rows[~late]
        watermark = state.getCurrentWatermarkMs()
        ready = held[(held["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000 <= watermark)] if len(held) else held
        out: list[tuple] = []
        if len(ready):
            held = held.drop(index=ready.index) if held.index.is_unique else held[held["t"] > ready["t"].max()]
            ready = ready.sort_values("t").drop_duplicates("t")
            if engine is None:
                engine = Engine(cfg, unpack(ready["alignment"].iloc[0]), VARIANTS[variant], rate_hz, SpeedModel.from_json(model) if model else None)
            out = _release(engine, drive, ready)
            released = float(ready["t"].iloc[-1])
        if dropped:
            out.append((drive, "late", None, None, None, None, None, None, None, None, None, None, None, None, dropped))
        state.update((pickle.dumps((engine, held.reset_index(drop=True), released)),))
        if len(held):
            state.setTimeoutTimestamp(max(int(held["ts"].astype("datetime64[ns]").astype("int64").min() // 1_000_000), watermark + 1))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    x = stream if "enabled" in stream.columns else stream.withColumn("enabled", F.lit(True))
    x = x.withWatermark("ts", lateness).select("drive_id", *INPUT)
    return x.groupBy("drive_id").applyInPandasWithState(step, OUTPUT, "blob binary", "append", GroupStateTimeout.EventTimeTimeout)
