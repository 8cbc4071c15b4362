"""Grouped forms of the sequential kernels: one group is one session, window or window and variant, so it fits one task."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.kernels import calibration
from driftframe.kernels.anomaly import Detector
from driftframe.kernels.engine import VARIANTS, Engine, Fix
from driftframe.kernels.matcher import Network
from driftframe.kernels.speed import SpeedModel

ACC, GYRO = ["ax", "ay", "az"], ["gx", "gy", "gz"]
CONTEXT = "alignment string, segments array<array<double>>"
TRAJECTORY_DDL = "t double, x double, y double, v_f double, v_l double, yaw double, pos_sigma double, disp_x double, disp_y double, mode string, init boolean"


def rate_of(t: np.ndarray) -> float:
    """Samples a second, from the median step; 10 for a single row."""
    return 1.0 / float(np.median(np.diff(t))) if len(t) > 1 else 10.0


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """df dealt out by key over all cores. Adaptive execution would gather groups into few tasks, as it sees their bytes, not the work on them."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def _ddl(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def fit(pdf: pd.DataFrame, pre: dict) -> calibration.Alignment:
    """Alignment from rows in order of t; null speeds and courses count as unknown."""
    number = lambda c: pdf[c].to_numpy(float)
    return calibration.calibrate(number("t"), pdf[ACC].to_numpy(float), pdf[GYRO].to_numpy(float), number("gnss_speed"), number("gnss_yaw"), pdf["gnss_healthy"].fillna(False).to_numpy(bool), pre)


def pack(al: calibration.Alignment) -> str:
    return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(al).items()})


def unpack(text: str) -> calibration.Alignment:
    d = json.loads(text)
    return calibration.Alignment(**{k: np.array(v) if isinstance(v, list) else v for k, v in d.items()})


def calibrations(rows: DataFrame, keys: list[str], cfg: dict, least: int = 100) -> DataFrame:
    """Per group with at least `least` rows: keys, mount_yaw_deg ... n_samples, and the alignment as JSON."""
    pre = cfg["preprocess"]
    names = ["mount_yaw_deg", "tilt_deg", "gravity", "fit_corr", "lateral_corr", "yaw_rate_corr"]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < least:
            return pd.DataFrame(columns=[*keys, *names, "n_samples", "alignment"])
        al = fit(pdf.sort_values("t"), pre)
        row = al.row()
        return pd.DataFrame([[*key, *(row[n] for n in names), row["n_samples"], pack(al)]], columns=[*keys, *names, "n_samples", "alignment"])

    return spread(rows, keys).groupBy(*keys).applyInPandas(one, f"{_ddl(rows, keys)}, {', '.join(f'{n} double' for n in names)}, n_samples long, alignment string")


def motion_features(rows: DataFrame, keys: list[str], cfg: dict, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of each session as motion features, calibrated on the session itself; sessions under 300 rows are left out."""
    pre = cfg["preprocess"]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 300:
            return pd.DataFrame(columns=[*keys, "t", *carry, *calibration.FEATURES])
        pdf = pdf.sort_values("t")
        p = calibration.Preprocessor(fit(pdf, pre), pre, rate_of(pdf["t"].to_numpy()), filtered=True)
        speed = np.where(pdf["gnss_healthy"].fillna(False).to_numpy(bool), pdf["gnss_speed"].to_numpy(float), np.nan)
        x = pd.DataFrame(p.block(pdf[ACC].to_numpy(float), pdf[GYRO].to_numpy(float), speed), columns=calibration.FEATURES)
        return pd.concat([pdf[[*keys, "t", *carry]].reset_index(drop=True), x], axis=1)

    extra = "".join(f", `{c}` {dict(rows.dtypes)[c]}" for c in carry)
    return spread(rows, keys).groupBy(*keys).applyInPandas(one, f"{_ddl(rows, keys)}, t double{extra}, {', '.join(f'{c} double' for c in calibration.FEATURES)}")


def anomalies(rows: DataFrame, keys: list[str], cfg: dict) -> DataFrame:
    """(keys, t, kind, magnitude) of shocks, transients and slips in each session."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, acc, gyro = pdf["t"].to_numpy(), pdf[ACC].to_numpy(float), pdf[GYRO].to_numpy(float)
        detect = Detector(cfg, rate_of(t))
        found = [e for i in range(len(t)) if (e := detect(t[i], acc[i], gyro[i])) is not None]
        return pd.DataFrame([[*key, float(e.t), e.kind, float(e.magnitude)] for e in found], columns=[*keys, "t", "kind", "magnitude"])

    return spread(rows, keys).groupBy(*keys).applyInPandas(one, f"{_ddl(rows, keys)}, t double, kind string, magnitude double")


def fixes(pdf: pd.DataFrame) -> list[Fix | None]:
    """A fix for each row that is healthy and has a position."""
    columns = (pdf[c].to_numpy(float).tolist() for c in ("gnss_x", "gnss_y", "gnss_speed", "gnss_yaw", "gnss_std"))
    healthy = pdf["gnss_healthy"].fillna(False).to_numpy(bool).tolist()
    return [Fix(x, y, v, h, s) if ok and x == x and y == y else None for ok, x, y, v, h, s in zip(healthy, *columns, strict=True)]


def run(engine: Engine, pdf: pd.DataFrame) -> list[tuple]:
    """Trajectory rows of samples in order."""
    t, acc, gyro = pdf["t"].to_numpy(float).tolist(), pdf[ACC].to_numpy(float), pdf[GYRO].to_numpy(float)
    return [engine.step(t[i], acc[i], gyro[i], f) for i, f in enumerate(fixes(pdf))]


def _grouped(rows: DataFrame, context: DataFrame, keys: list[str], cfg: dict, model: str | None, out: Callable, ddl: str) -> DataFrame:
    def one(key: tuple, pdf: pd.DataFrame, ctx: pd.DataFrame) -> pd.DataFrame:
        columns = [c.strip().split(" ")[0] for c in ddl.split(",")]
        variant = VARIANTS[key[-1]]
        if not len(pdf) or not len(ctx):
            return pd.DataFrame(columns=[*keys, "variant", *columns])
        pdf = pdf.sort_values("t")
        seg = ctx["segments"].iloc[0]
        network = Network(np.array([list(s) for s in seg]).reshape(-1, 4), connect=cfg["map"]["trace_spacing_m"] * 0.6) if variant.road and seg is not None and len(seg) else None
        if variant.road and network is None:
            return pd.DataFrame(columns=[*keys, "variant", *columns])
        engine = Engine(cfg, unpack(ctx["alignment"].iloc[0]), variant, rate_of(pdf["t"].to_numpy()), SpeedModel.from_json(model) if model else None, network)
        found = pd.DataFrame(out(engine, pdf), columns=columns)
        for i, k in enumerate([*keys, "variant"]):
            found.insert(i, k, key[i])
        return found

    by = [*keys, "variant"]
    return spread(rows, by).groupBy(*by).cogroup(spread(context, by).groupBy(*by)).applyInPandas(one, f"{_ddl(rows, by)}, {ddl}")


def trajectories(rows: DataFrame, context: DataFrame, keys: list[str], cfg: dict, model: str | None = None) -> DataFrame:
    """(keys, variant, trajectory columns) of masked rows(keys, variant, samples), with context(keys, variant, alignment, segments)."""
    return _grouped(rows, context, keys, cfg, model, run, TRAJECTORY_DDL)


def update_log(rows: DataFrame, context: DataFrame, keys: list[str], cfg: dict, model: str | None = None) -> DataFrame:
    """(keys, variant, t, source, accepted, nis) of every measurement in the same runs."""

    def out(engine: Engine, pdf: pd.DataFrame) -> list[tuple]:
        run(engine, pdf)
        return engine.drain()[0]

    return _grouped(rows, context, keys, cfg, model, out, "t double, source string, accepted boolean, nis double")


def predict(sequences: DataFrame, keys: list[str], column: str, model: str) -> DataFrame:
    """sequences(keys, column: array of structs) with speed and sigma of the model."""

    def f(batches):
        m = SpeedModel.from_json(model)
        for pdf in batches:
            windows = [np.array([[r[c] for c in m.features] for r in w], float) for w in pdf[column]]
            out = m.batch(np.array(windows)) if windows else np.zeros((0, 2))
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "speed": out[:, 0], "sigma": out[:, 1]})

    return sequences.select(*keys, column).mapInPandas(f, f"{_ddl(sequences, keys)}, speed double, sigma double")


def train_speed(features: DataFrame, keys: list[str], target: str, valid: str, cfg: dict) -> SpeedModel:
    """A linear speed model on window summaries (mean, deviation, last row of normalised features), fitted by Spark ML."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from driftframe.operators.clean import series
    from driftframe.operators.features import sequence_ends

    names, n = cfg["model"]["features"], cfg["model"]["window"]
    features = features.persist()
    stats = features.agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names)).first()
    mean, std = np.array([stats[f"m_{c}"] for c in names]), np.array([stats[f"s_{c}"] for c in names]) + 1e-6
    x = features.withColumns({c: (F.col(c) - float(mean[i])) / float(std[i]) for i, c in enumerate(names)})
    w = series(keys, "t").rowsBetween(-(n - 1), 0)
    columns = [f"mean_{c}" for c in names] + [f"std_{c}" for c in names] + list(names)
    x = x.withColumns({f"mean_{c}": F.avg(c).over(w) for c in names} | {f"std_{c}": F.stddev_pop(c).over(w) for c in names})
    x = sequence_ends(x, keys, F.col(valid) & F.col(target).isNotNull(), n, cfg["model"]["stride"], "t")
    rows = VectorAssembler(inputCols=columns, outputCol="x_").transform(x).select("x_", F.col(target).cast("double").alias("y_"))
    fitted = LinearRegression(featuresCol="x_", labelCol="y_", regParam=1e-3, solver="normal").fit(rows)
    sigma = float(fitted.summary.rootMeanSquaredError)
    features.unpersist()
    return SpeedModel("linear", {"coef": fitted.coefficients.toArray(), "intercept": float(fitted.intercept), "sigma": sigma}, list(names), n, mean, std, 1.0, {"rows": int(fitted.summary.numInstances), "rmse": sigma})


