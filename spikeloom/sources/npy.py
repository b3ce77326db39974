"""Arrays in .npy files as a Spark data source, read in row ranges.

Register with ``spark.dataSource.register(NpySource)`` and load with
``spark.read.format("npy").option("path", file).load()``.  Rows are the first axis; the
remaining axes arrive flattened in C order in ``value``.
"""

from __future__ import annotations

import ast
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def header(path: str) -> tuple[np.dtype, tuple[int, ...], int]:
    """Element type, shape and byte offset of the data."""
    with open(path, "rb") as f:
        if f.read(6) != b"\x93NUMPY":
            raise ValueError(f"{path} is not an npy file")
        major = f.read(2)[0]
        n = int.from_bytes(f.read(2 if major == 1 else 4), "little")
        meta = ast.literal_eval(f.read(n).decode("latin1"))
        if meta["fortran_order"] and len(meta["shape"]) > 1:
            raise ValueError("column-major arrays are not supported")
        return np.dtype(meta["descr"]), meta["shape"], f.tell()


class Rows(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self):
        _, shape, _ = header(self.path)
        return [Rows(self.path, i, min(i + self.rows, shape[0])) for i in range(0, shape[0], self.rows)] or [Rows(self.path, 0, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        dtype, shape, offset = header(partition.path)
        width = int(np.prod(shape[1:], dtype=int))
        n = partition.stop - partition.start
        with open(partition.path, "rb") as f:
            f.seek(offset + partition.start * width * dtype.itemsize)
            a = np.fromfile(f, dtype, n * width).reshape(n, width)
        for i in range(n):
            yield partition.start + i, [float(v) for v in a[i]]


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row bigint, value array<double>"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options["path"], int(self.options.get("rowsPerPartition", "1000000")))


def load(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("path", path).load()


def sorted_spikes(spark: SparkSession, folder: str, recording: str, first_sample: int = 1) -> DataFrame:
    """Sorter output as a spikes table: parallel arrays joined by row, times moved to start at zero."""
    def col(file: str, name: str, kind: str) -> DataFrame:
        return load(spark, os.path.join(folder, file)).select("row", F.get("value", F.lit(0)).cast(kind).alias(name))

    d = col("spike_times.npy", "t", "bigint")
    d = d.join(col("spike_clusters.npy", "cluster_id", "bigint"), "row").join(col("spike_templates.npy", "template_id", "bigint"), "row")
    d = d.join(col("amplitudes.npy", "amplitude", "double"), "row")
    return d.select(
        F.lit(recording).alias("recording_id"), F.col("row").alias("spike_id"), "cluster_id", "template_id",
        (F.col("t") - first_sample).alias("t"), "amplitude",
    )


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """templates.npy (template, sample, channel) as one waveform per template and channel."""
    path = os.path.join(folder, "templates.npy")
    _, shape, _ = header(path)
    n, c = shape[1], shape[2]
    w = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("value", i * c + F.col("channel")))
    return load(spark, path).withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(c - 1)))).select(
        F.col("row").alias("template_id"), "channel", w.alias("waveform")
    )


def accepted_units(spark: SparkSession, folder: str, spikes: DataFrame) -> DataFrame:
    """Accept mask in cluster order; all units are accepted where no mask exists."""
    units = spikes.select("recording_id", "cluster_id").distinct()
    path = os.path.join(folder, "accepted_units.npy")
    if not os.path.exists(path):
        return units.withColumn("accepted", F.lit(True))
    from spikeloom.operators.ordered import in_order

    d = in_order(units, ["recording_id"], "cluster_id", 1 << 20, index="row")
    mask = load(spark, path).select("row", (F.get("value", F.lit(0)) != 0).alias("accepted"))
    return d.join(mask, "row").drop("row")
