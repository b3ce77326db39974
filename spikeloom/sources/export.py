"""Exports: tab-separated unit tables and raw sample-major int16 files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from spikeloom.operators.clean import round_sig


def rounded(df: DataFrame) -> DataFrame:
    """Columns other than texts and whole numbers to four significant digits."""
    keep = (IntegralType, StringType)
    return df.select(*[F.col(f.name) if isinstance(f.dataType, keep) else round_sig(f.name).alias(f.name) for f in df.schema.fields])


def write_tsv(df: DataFrame, path: str) -> None:
    rounded(df).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def curation_tables(props: DataFrame) -> dict[str, DataFrame]:
    """Cluster tables of a spike-curation tool: info, amplitude, contamination, label."""
    d = props.withColumnRenamed("channel", "ch").withColumns(
        {"Amplitude": F.col("center_y") - F.col("start_y"), "ContamPct": F.lit(100.0)}
    )
    return {
        "cluster_info": d,
        "cluster_Amplitude": d.select("cluster_id", "Amplitude"),
        "cluster_ContamPct": d.select("cluster_id", "ContamPct"),
        "cluster_KSLabel": d.select("cluster_id", F.lit("mua").alias("KSLabel")),
    }


def write_curation(props: DataFrame, folder: str) -> None:
    for name, d in curation_tables(props).items():
        write_tsv(d, f"{folder}/{name}")


def write_raw(chunks: DataFrame, path: str, channels: int, size: int) -> None:
    """Little-endian int16, all channels of a sample next to each other, in one file on shared storage.

    Every chunk of time is one group of at most channels x size samples and goes to its own
    byte range, so tasks write side by side and a repeated task writes the same bytes.
    """
    open(path, "wb").close()

    def put(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fd = os.open(path, os.O_WRONLY)
        try:
            for pdf in it:
                done = 0
                for chunk, rows in zip(pdf["chunk"], pdf["rows"]):
                    if len(rows) != channels:
                        raise ValueError(f"chunk {chunk} has {len(rows)} channels, expected {channels}")
                    a = np.stack([np.asarray(r["samples"]) for r in rows]).T.astype("<i2")
                    done += os.pwrite(fd, a.tobytes(), int(chunk) * size * channels * 2)
                yield pd.DataFrame({"bytes": [done]})
        finally:
            os.close(fd)

    g = chunks.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("channel", "samples"))).alias("rows"))
    g.mapInPandas(put, "bytes bigint").agg(F.sum("bytes")).collect()  # one row


def write_npy(df: DataFrame, path: str, shape: tuple[int, ...], dtype: str = "<f4") -> None:
    """Rows (row, value) as one .npy array on shared storage; every row goes to its own byte range."""
    kind = np.dtype(dtype)
    head = repr({"descr": kind.str, "fortran_order": False, "shape": tuple(int(v) for v in shape)})
    start = -(-(10 + len(head) + 1) // 64) * 64
    with open(path, "wb") as f:
        f.write(b"\x93NUMPY\x01\x00" + (start - 10).to_bytes(2, "little") + head.ljust(start - 11).encode() + b"\n")
    width = int(np.prod(shape[1:], dtype=int))

    def put(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fd = os.open(path, os.O_WRONLY)
        try:
            for pdf in it:
                for row, value in zip(pdf["row"], pdf["value"]):
                    os.pwrite(fd, np.asarray(value).astype(kind).tobytes(), start + int(row) * width * kind.itemsize)
                yield pd.DataFrame({"rows": [len(pdf)]})
        finally:
            os.close(fd)

    df.select("row", "value").mapInPandas(put, "rows bigint").agg(F.sum("rows")).collect()  # one row
