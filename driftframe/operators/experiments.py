"""Experiment plumbing: splits, variants, parameter grids, ablations and audits as small tables joined to large ones."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a dimension that for_each() takes.
MOST_VALUES = 1000


def split_overlap(members: DataFrame, drive: str, split: str) -> DataFrame:
    """(drive, n_splits) of drives in more than one split; empty if the splits are disjoint."""
    return members.groupBy(drive).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def without(df: DataFrame, held_out: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not held out."""
    return df.join(held_out.select(*on).distinct(), on, "left_anti")


def unknown(ids: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Distinct ids that are not among the known."""
    return ids.select(on).distinct().join(known.select(on), on, "left_anti")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """Every combination of the axes' values, numbered in order; the axes are parameters, a handful of values each."""
    out = spark.createDataFrame([(i, *values) for i, values in enumerate(product(*axes.values()))], ["point", *axes])
    return out.withColumn("point", F.col("point").cast("int"))


def for_each(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Every row of df with every row of a small dimension (variants, settings): each row is given out once a value, without a join."""
    rows = dimension.limit(MOST_VALUES + 1).collect()
    if len(rows) > MOST_VALUES:
        raise ValueError(f"a dimension of more than {MOST_VALUES} rows is no parameter; join it by a key")
    kinds = {f.name: f.dataType for f in dimension.schema}
    values = [F.struct(*(F.lit(r[n]).cast(kind).alias(n) for n, kind in kinds.items())) for r in rows]
    if not values:
        return df.limit(0).select("*", *(F.lit(None).cast(kind).alias(n) for n, kind in kinds.items()))
    return df.withColumn("each_", F.explode(F.array(*values))).select(*df.columns, *(F.col("each_").getField(n).alias(n) for n in kinds))


def pivot_medians(df: DataFrame, by: list[str], variant: str, value: str, variants: list[str]) -> DataFrame:
    """Median of value for each variant in columns named after them."""
    return df.groupBy(*by).pivot(variant, variants).agg(F.median(value))


def audit(checks: list[tuple[str, Column]], facts: DataFrame) -> DataFrame:
    """(check, passed) for named conditions over one row of facts, and their conjunction as check 'all'."""
    row = facts.select(*(c.alias(n) for n, c in checks))
    every = row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(False)).alias("passed")) for n, _ in checks))).alias("c")).select("c.*")
    return every.unionByName(every.agg(F.bool_and("passed").alias("passed")).select(F.lit("all").alias("check"), "passed"))
