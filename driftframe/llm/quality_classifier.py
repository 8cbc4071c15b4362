"""Quality classifier: hierarchical empirical Bayes over a document classifier and its host and path.

Level 0 is a logistic model of rule statistics, fitted on a bounded sample of labelled rows; its log-odds less those of its
training prior are the document's evidence. Level 1 and 2 are the shares of bad documents of a host and of a path within it:
soft counts over all documents (labels where known, the classifier's probability else) by grouped aggregation, with beta
priors whose strengths are estimated from the spread between sites (method of moments). A sparse host shrinks toward the
global share and a sparse path toward its host. The posterior adds the evidence to the path's log-odds; the cut comes from
all labelled rows. Nothing of a document's text leaves its task, and a host or path of any size is pre-aggregated.

Defined cases: a null or empty text has no words and gets the evidence of such a text; null hosts or paths are sites of their
own; repeated rows get a verdict each and count each; a null doc_id joins no label; contradictory labels of a doc_id count as
their mean; without labels of both kinds the classifier is silent (evidence 0) and nothing is rejected; an empty table gives
an empty result; other columns, whatever their names, pass through keep() and are ignored elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftframe.llm.calibration import best_cut, bounded_sample, quantiles
from driftframe.llm.common import arrow_map, sized, stored
from driftframe.llm.quality_rules import stats_batch
from driftframe.llm.text_stats import COUNTS, FEATURES

#: The document classifier is fitted on at most this many labelled documents, taken by hash of doc_id.
FIT_ROWS = 20_000
#: Soft counts of a classifier weigh this much of a label's.
SOFT_WEIGHT = 0.5
MARGIN_LEVEL = 0.999
LIMIT = 12.0

_FEATURES = [f"f_{f}" for f in FEATURES]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, x.T @ (y - p) - penalty * w)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


@dataclass
class QualityModel:
    """What fit() learned. sites: path posteriors (one row per host and path) as a DataFrame."""

    weights: list[float]
    margin: list[float]
    center: list[float]
    scale: list[float]
    prior: float
    cut: float
    sites: DataFrame = field(repr=False)

    def evidence(self) -> Column:
        """Log-odds of bad that the text alone adds, from columns f_FEATURES."""
        total = F.lit(self.weights[-1] - float(np.log(self.prior / (1 - self.prior))))
        k = len(_FEATURES)
        for i, f in enumerate(_FEATURES):
            total = total + F.lit(self.weights[i]) * ((F.col(f) - self.center[i]) / self.scale[i])
            total = total + F.lit(self.weights[k + i]) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(f) - self.margin[i]) / max(self.margin[i], 0.02))
        return F.greatest(F.least(total, F.lit(LIMIT)), F.lit(-LIMIT))

    def with_posterior(self, df: DataFrame) -> DataFrame:
        """df(host_, path_, evidence) with path_share and posterior_logit, joined by site; hot sites are split by Spark's skew join."""
        sites = self.sites
        on = df["host_"].eqNullSafe(sites["s_host"]) & df["path_"].eqNullSafe(sites["s_path"])
        joined = df.join(sized(sites), on, "left").drop("s_host", "s_path")
        share = F.coalesce(F.col("path_share"), F.lit(self.prior))
        return joined.withColumn("path_share", share).withColumn("posterior_logit", F.col("evidence") + _logit(share))

    def keep(self, docs: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
        """The rows of docs that the posterior keeps, columns as they were; texts are scored where they are read, not shuffled."""
        fields = docs.schema
        schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
        t = fields.fieldNames().index("text")

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = stats_batch(pa.RecordBatch.from_arrays([batch.column(t)], ["text"]), ())
            return pa.RecordBatch.from_arrays([*batch.columns, *(s.column(n) for n in _FEATURES)], [*(f"c{i}" for i in range(batch.num_columns)), *_FEATURES])

        plain = docs.toDF(*(f"c{i}" for i in range(len(fields))))
        scored = arrow_map(plain, f, f"{schema}, " + ", ".join(f"{n} double" for n in _FEATURES)).withColumn("evidence", self.evidence())
        at = {n: F.col(f"c{i}") for i, n in enumerate(fields.fieldNames())}
        scored = scored.withColumns({"host_": at[host].cast("string"), "path_": at[path].cast("string")})
        out = self.with_posterior(scored).where(F.col("posterior_logit") <= self.cut)
        return out.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(fields.fieldNames())))


def _fit_rows(stats: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = bounded_sample(stats.join(labels, "doc_id").select("doc_id", "bad", *_FEATURES), "doc_id", FIT_ROWS).collect()
    x = np.array([r[2:] for r in rows], float).reshape(-1, len(_FEATURES))
    return x, (np.array([r["bad"] for r in rows], float) > 0.5).astype(float)


def _moments(sites: DataFrame, n: Column, bad: Column, mean: Column) -> float:
    """Strength of the beta prior of site shares around mean: binomial spread taken off the spread seen between sites."""
    r = sites.agg(
        F.sum(n).alias("n"), F.sum(n * (bad / n - mean) * (bad / n - mean)).alias("spread"), F.sum(mean * (1 - mean) * n).alias("binomial"),
        F.sum(mean * (1 - mean)).alias("noise"),
    ).first()
    if not r["n"]:
        return 1.0
    between = max((r["spread"] - r["noise"]) / r["n"], 1e-9)
    return float(min(max(r["binomial"] / r["n"] / between - 1, 1.0), 1e6))


def site_posteriors(evidence: DataFrame, prior: float, rows: int | None = None) -> DataFrame:
    """s_host, s_path, n, host_share, path_share from evidence(host_, path_, bad) of all documents; bad is a soft count in [0, 1]."""
    paths = evidence.groupBy(F.col("host_").alias("s_host"), F.col("path_").alias("s_path")).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("bad")).alias("bad"))
    paths = stored(paths, "site-counts", rows)
    hosts = paths.groupBy(F.col("s_host").alias("h")).agg(F.sum("n").alias("h_n"), F.sum("bad").alias("h_bad"))
    total = hosts.agg(F.sum("h_n").alias("n"), F.sum("h_bad").alias("bad")).first()
    mean = (total["bad"] + prior) / (total["n"] + 1) if total["n"] else prior
    k_host = _moments(hosts, F.col("h_n"), F.col("h_bad"), F.lit(mean))
    hosts = hosts.withColumn("host_share", (F.col("h_bad") + k_host * mean) / (F.col("h_n") + k_host))
    both = paths.join(hosts, paths["s_host"].eqNullSafe(hosts["h"])).drop("h")
    k_path = _moments(both, F.col("n"), F.col("bad"), F.col("host_share"))
    share = (F.col("bad") + k_path * F.col("host_share")) / (F.col("n") + k_path)
    return both.select("s_host", "s_path", share.alias("path_share"))


def fit(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> tuple[QualityModel, DataFrame]:
    """The model, and the stored evidence of all documents: doc_id, host_, path_, f_FEATURES, evidence."""
    columns = [F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host_"), F.col(path).cast("string").alias("path_"), F.col("text").cast("string")]
    keep = ("doc_id", "host_", "path_")
    schema = "doc_id long, host_ string, path_ string, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, " + ", ".join(f"{f} double" for f in _FEATURES)
    stats = arrow_map(docs.select(*columns), lambda b: stats_batch(b, keep), schema).select(*keep, *_FEATURES)
    stats = stored(stats, "quality-stats", mapped=True)
    labels = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.avg("quality")).alias("bad"))
    k = len(_FEATURES)
    x, y = _fit_rows(stats, labels)
    if len(set(y)) == 2:
        good = stats.join(labels.where("bad < 0.5"), "doc_id", "left_semi")
        margin = quantiles(good, _FEATURES, MARGIN_LEVEL) or [0.0] * k
        center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        excess = np.minimum(1, np.maximum(0, x - np.array(margin)) / np.maximum(margin, 0.02))
        weights, prior = _logistic(np.column_stack([(x - center) / scale, excess]), y), float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    else:
        margin, center, scale, weights, prior = [0.0] * k, np.zeros(k), np.ones(k), np.zeros(2 * k + 1), 0.5
    model = QualityModel([float(w) for w in weights], margin, [float(c) for c in center], [float(s) for s in scale], prior, LIMIT * 3, stats)
    scored = stats.withColumn("evidence", model.evidence())
    logit = float(np.log(prior / (1 - prior)))
    known = scored.join(labels.withColumnRenamed("bad", "label_bad"), "doc_id", "left")
    soft = known.select(
        "host_", "path_", F.coalesce("label_bad", 1 / (1 + F.exp(-(F.col("evidence") + logit)))).alias("bad"), F.when(F.col("label_bad").isNull(), SOFT_WEIGHT).otherwise(1.0).alias("w")
    )
    model.sites = site_posteriors(soft, prior, stats.count())
    model.sites = stored(model.sites, "site-posteriors", model.sites.count())
    labelled = model.with_posterior(scored).join(labels.select("doc_id", F.when(F.col("bad") > 0.5, 0).otherwise(1).alias("quality")), "doc_id")
    model.cut = best_cut(labelled, F.col("posterior_logit"), -3 * LIMIT, 3 * LIMIT, 3 * LIMIT)
    return model, scored


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """Per document: doc_id, evidence, path_share (site posterior), p_bad (posterior), kept."""
    model, scored = fit(docs, labels, host, path)
    out = model.with_posterior(scored)
    return out.select(
        "doc_id", "evidence", "path_share", (1 / (1 + F.exp(-F.col("posterior_logit")))).alias("p_bad"), (F.col("posterior_logit") <= model.cut).alias("kept")
    )
