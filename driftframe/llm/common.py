"""What the operators of this package share: durable intermediate tables, Arrow batches, size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.runtime import new_folder, put, remove, sized

__all__ = ["BATCH_ROWS", "WORD", "arrow_map", "dealt", "forget", "keyed", "n_words", "plain", "put", "sized", "stored"]

#: Words everywhere in this package: runs of anything but space and \t \n \v \f \r. bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch sent to Python, so that a batch of long texts stays small.
BATCH_ROWS = 1024
#: Rows of a file of an intermediate table, where their number is known before it is written.
FILE_ROWS = 200_000
LEAST_FILES = 4
#: Partitions of a scan whose narrow rows share a file.
SCAN_PARTS = 8


def stored(df: DataFrame, kind: str, rows: int | None = None, mapped: bool = False, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and a lost executor loses nothing.

    rows: the most rows that df can have, if known; a table of narrow rows is then dealt out evenly to as many files as these
    need at file_rows a file, rather than one for each shuffle partition. mapped: df is a map of a scan to narrow rows, with no shuffle below; it
    gets a file for every SCAN_PARTS partitions of the scan. Many small files cost more than the rows in them.
    """
    path = new_folder(df.sparkSession, kind)
    if rows is not None:
        df = dealt(df, rows, file_rows)
    elif mapped:
        df = df.repartition(max(LEAST_FILES, -(-df.rdd.getNumPartitions() // SCAN_PARTS)))
    put(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at_ = path
    return out


def dealt(df: DataFrame, rows: int, file_rows: int = FILE_ROWS) -> DataFrame:
    """df, of at most `rows` narrow rows, in as many partitions as it shall have files."""
    return df.repartition(max(LEAST_FILES, -(-rows // file_rows)))


def forget(df: DataFrame) -> None:
    """Remove the files of a stored() table that no later plan reads; anything else is left alone."""
    path = getattr(df, "stored_at_", None)
    if path is not None:
        remove(df.sparkSession, path)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, setup: Callable | None = None) -> DataFrame:
    """mapInArrow with small batches; f gets one batch (and what setup() returned on the worker) and returns one."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            out = f(batch, state) if setup else f(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def n_words(text: str = "text"):
    """Number of words of a column, 0 for null, computed in the JVM."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def plain(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ..., so that no name clashes with what an operator adds; columns may share a name."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def keyed(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with k1 and k2, 128 bits of hash over columns: rows that agree in all of them, nulls included, are taken as repeated ones."""
    kinds = dict(df.dtypes)
    of = [F.to_json(F.struct(c)) if "map<" in kinds[c] or "variant" in kinds[c] else F.col(c) for c in columns]
    return df.withColumns({"k1": F.xxhash64(*of, F.lit("k1")), "k2": F.xxhash64(F.lit("k2"), *of)})
