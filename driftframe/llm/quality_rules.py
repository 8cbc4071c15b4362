"""Quality rules: an isolation forest over rule statistics, with thresholds calibrated from labelled rows.

Rule statistics of every whole text are computed once, in one map pass, and stored without the texts. The forest sees the statistics
themselves, each in units of its 99.9th percentile among all rows labelled good, and is fitted on a bounded sample of those rows: random
splits isolate a document after few steps if no such row is near it. The verdict comes from the path lengths alone; the cut of
the anomaly score is calibrated from all labelled rows.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows get a verdict each; a null doc_id
stays null and joins no label; without rows labelled good units and forest come from all base-passing rows, without labels of both
kinds the cut is DEFAULT_CUT; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.llm.calibration import best_cut, bounded_sample, quantiles
from driftframe.llm.common import arrow_map, stored
from driftframe.llm.iforest import IsolationForest
from driftframe.llm.text_stats import COUNTS, FEATURES, base_failed, count_columns, features

#: The forest is fitted on at most this many base-passing documents labelled good, taken by hash of doc_id.
FIT_ROWS = 8192
#: Statistics that the forest sees.
RULES = ("symbols", "upper", "exclaims", "runs", "repeats", "dup_lines")
UNIT_LEVEL = 0.999
#: Least unit of a statistic, all of which are shares.
LEAST_UNIT = 0.02
DEFAULT_CUT = 0.6

_STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, " + ", ".join(f"f_{f} double" for f in FEATURES)


def stats_batch(batch: pa.RecordBatch, keep: tuple[str, ...] = ("doc_id",)) -> pa.RecordBatch:
    """The columns in keep, COUNTS, base_failed and f_FEATURES of a batch with a column text."""
    counts = count_columns(batch.column("text"))
    x = features(counts)
    columns = [batch.column(k) for k in keep] + [pa.array(c) for c in counts.T] + [pa.array(base_failed(counts))] + [pa.array(c) for c in x.T]
    return pa.RecordBatch.from_arrays(columns, [*keep, *COUNTS, "base_failed", *(f"f_{f}" for f in FEATURES)])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed and f_FEATURES of every whole text."""
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), stats_batch, _STATS)


def anomalies(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, COUNTS, base_failed, anomaly (score, higher is odder), cut, kept.

    docs(doc_id, text), labels(doc_id, quality). kept is false if base_failed, else whether anomaly is at most the cut.
    """
    labels = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    stats = stored(statistics(docs), "rule-stats", mapped=True)
    names = [f"f_{r}" for r in RULES]
    passing = stats.where("not base_failed").select("doc_id", *names)
    fitted = passing.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    high = quantiles(fitted, names, UNIT_LEVEL)
    if high is None:
        fitted = passing
        high = quantiles(fitted, names, UNIT_LEVEL) or [0.0] * len(names)
    unit = np.maximum(high, LEAST_UNIT)
    sample = bounded_sample(fitted, "doc_id", FIT_ROWS).collect()
    forest = IsolationForest().fit(np.array([r[1:] for r in sample], float).reshape(-1, len(RULES)) / unit)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
        keep = [*COUNTS, "base_failed"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(k) for k in keep), pa.array(forest.score(x / unit))], ["doc_id", *keep, "anomaly"])

    scored = arrow_map(stats, score, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double")
    labelled = scored.where("not base_failed").join(labels, "doc_id")
    cut = best_cut(labelled, F.col("anomaly"), 0.0, 1.0, DEFAULT_CUT)
    return scored.withColumn("cut", F.lit(cut)).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.col("cut")))
