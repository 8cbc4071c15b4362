"""Positions within a group without sorting a group in one task: buckets by hash, a running total over buckets, then within each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket of the largest group holds on average, and the most buckets of one group.
BUCKET_ROWS = 128
MAX_BUCKETS = 1 << 20


def hash_order(*columns: str, seed: str = "order") -> Column:
    """A pseudo-random order that depends on the columns alone, as a number from 0 to 2**62."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *(F.col(c) for c in columns)), 2)


def running(df: DataFrame, group: list[str], order: list[Column], amount: Column, rows: int, into: str) -> DataFrame:
    """df with `into`: the sum of amount over the rows of its group before it, groups ordered by `order`.

    order[0] must be spread evenly over 0 to 2**62 (see hash_order); its top bits are the bucket. rows: about how many rows the
    largest group has, which sets the number of buckets, so that neither a bucket nor the list of a group's buckets grows large.
    """
    buckets = 1
    while buckets < MAX_BUCKETS and buckets * BUCKET_ROWS < rows:
        buckets *= 2
    width = (1 << 62) // buckets
    at = df.withColumns({"bucket_": F.floor(order[0] / F.lit(float(width))).cast("long"), "amount_": amount, "o0_": order[0]})
    key = F.struct(*(F.col(g) for g in group))
    totals = at.groupBy(*group, "bucket_").agg(F.sum("amount_").alias("total_"))
    # a group's buckets are at most `buckets` small rows
    before = F.coalesce(F.sum("total_").over(Window.partitionBy(*group).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.xxhash64(key, "bucket_").alias("h_"), key.alias("k_"), F.col("bucket_").alias("b_"), before.alias("before_"))
    own = Window.partitionBy(*group, "bucket_").orderBy("o0_", *order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    inner = at.withColumn("own_", F.coalesce(F.sum("amount_").over(own), F.lit(0)))
    joined = inner.join(totals, (key.eqNullSafe(totals["k_"])) & (inner["bucket_"] == totals["b_"]))
    return joined.withColumn(into, F.col("before_") + F.col("own_")).drop("bucket_", "amount_", "o0_", "h_", "k_", "b_", "before_", "own_", "total_")
