"""Cuts and margins calibrated from all labelled rows by grouped aggregation; only bounded histograms reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cut may reject at most this share of the rows labelled good.
MAX_FALSE_REJECTS = 0.005
BINS = 2000


def best_cut(labelled: DataFrame, score: Column, low: float, high: float, default: float) -> float:
    """The cut of score (rejected: above it) that splits labelled rows best.

    labelled has a column quality (1 good, 0 bad; others are left out). The cut maximises the rejected share of bad rows
    less that of good rows, with at most MAX_FALSE_REJECTS of the good ones rejected; of equally good cuts, the middle of the
    highest run. Without labels of both kinds: default.
    """
    width = (high - low) / BINS
    at = F.floor((F.least(F.greatest(score, F.lit(low)), F.lit(high)) - low) / width)
    rows = labelled.where("quality in (0, 1)").groupBy(at.alias("bin"), "quality").count().collect()
    good, bad = [0] * (BINS + 2), [0] * (BINS + 2)
    for r in rows:
        (good if r["quality"] == 1 else bad)[int(r["bin"] or 0)] += r["count"]
    if not sum(good) or not sum(bad):
        return default
    best, first, last = 0.0, None, None
    above_good = above_bad = 0
    for b in range(BINS, -1, -1):  # the cut lies at the lower edge of bin b
        above_good, above_bad = above_good + good[b], above_bad + bad[b]
        if above_good > MAX_FALSE_REJECTS * sum(good):
            break
        gain = above_bad / sum(bad) - above_good / sum(good)
        if gain > best + 1e-12:
            best, first, last = gain, b, b
        elif first is not None and gain >= best - 1e-12 and last == b + 1:
            last = b
    if first is None:
        return high
    return low + width * (first + last) / 2 - 1e-9


#: Bins of each of the two histograms that narrow a quantile down.
QUANTILE_BINS = 1000


def quantiles(df: DataFrame, columns: list[str], level: float) -> list[float] | None:
    """For each column about the least value that a share `level` of all rows doesn't exceed; None for no rows.

    Two histograms, the second of the bin that the first points at, by grouped counts: what reaches the driver is bounded by bins, and
    no task gathers more than that. The value is exact where the second bin holds one value, else that bin's greatest.
    """
    ask = [f(F.col(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for f, n in ((F.min, "low"), (F.max, "high"))]
    r = df.agg(F.count(F.lit(1)).alias("n"), *ask).first()
    if not r["n"]:
        return None
    low = [float(r[f"low{i}"] or 0.0) for i in range(len(columns))]
    high = [float(r[f"high{i}"] or 0.0) for i in range(len(columns))]
    below, out = [0] * len(columns), list(high)
    for _ in range(2):
        width = [(h - b) / QUANTILE_BINS or 1.0 for b, h in zip(low, high, strict=True)]
        cells = []
        for i, c in enumerate(columns):
            v = F.coalesce(F.col(c), F.lit(0.0))
            at = F.least(F.greatest(F.floor((v - low[i]) / width[i]), F.lit(-1)), F.lit(QUANTILE_BINS)).cast("int")
            cells.append(F.struct(F.lit(i).alias("i"), F.when((v < low[i]) | (v > high[i]), -1).when(v == high[i], QUANTILE_BINS - 1).otherwise(at).alias("bin"), v.alias("v")))
        counts = df.select(F.explode(F.array(*cells)).alias("x")).where(F.col("x.bin").between(0, QUANTILE_BINS - 1)).groupBy("x.i", "x.bin").agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("least"), F.max("x.v").alias("most"))
        of: dict[int, list] = {}
        for row in counts.collect():
            of.setdefault(row["i"], []).append((row["bin"], row["n"], row["least"], row["most"]))
        for i, found in of.items():
            for _, n, least, most in sorted(found):
                if below[i] + n >= level * r["n"]:
                    low[i], high[i], out[i] = float(least), float(most), float(most)
                    break
                below[i] += n
    return out


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, the same ones on every run: those whose hash of key is least, thinned before they are ordered."""
    n = df.count()
    h = F.xxhash64(F.col(key), F.lit("sample"))
    if n > 3 * rows:
        share = int((1 << 40) * min(1.0, 3 * rows / n)) + 1
        df = df.where(F.pmod(h, F.lit(1 << 40)) < share)
    return df.orderBy(h, key).limit(rows)
