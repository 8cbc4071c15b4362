"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str):
    """One table of the driver's data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one where that is unset, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_folders: list[tuple[SparkSession, str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there and the session still runs."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass
    _folders[:] = [x for x in _folders if x[1] != path]


@atexit.register
def _clear() -> None:
    for spark, path in list(_folders):
        if spark.sparkContext._jsc is not None and spark.sparkContext._jsc.sc().isStopped() is False:
            remove(spark, path)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver's Python ends, or by remove()."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


def put(df: DataFrame, path: str) -> None:
    """Write an intermediate table without a _SUCCESS mark, which nobody reads: on local folders the driver starts a process for each file it makes."""
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)


def settled(df: DataFrame, kind: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, and no executor's memory holds it."""
    path = new_folder(df.sparkSession, kind)
    put(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A side is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows (counted), else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
