"""Where results go: Parquet, CSV and JSON tables, Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from driftframe.operators.scoring import markdown


def save(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a table; kind: parquet, csv (with header), json, or md for a small report written by the driver."""
    if kind == "md":
        with open(path, "w") as f:
            f.write(markdown(df))
    elif kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif kind in ("parquet", "json"):
        df.write.mode("overwrite").format(kind).save(path)
    else:
        raise ValueError(f"no such sink: {kind}")
