"""Python data source "synthetic_drive": spark.read.format("synthetic_drive").option("drives", 4).load(); a partition a drive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from driftframe.kernels import synthetic
from driftframe.schema import DRIVE


class SyntheticDrives(DataSource):
    """Options: drives, duration_s, rate_hz, mount_yaw_deg, gyro_bias, acc_bias, grade."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_drive"

    def schema(self) -> StructType:
        return DRIVE

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.drives = int(options.pop("drives", 1))
        known = ("duration_s", "rate_hz", "mount_yaw_deg", "gyro_bias", "acc_bias", "grade")
        self.shape = {k: float(options[k]) for k in known if k in options}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.drives)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        made = synthetic.drive(f"d{partition.value}", seed=partition.value, **self.shape)[DRIVE.fieldNames()]
        for row in made.astype(object).itertuples(index=False):
            yield tuple(None if isinstance(v, float) and np.isnan(v) else v for v in row)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SyntheticDrives)
