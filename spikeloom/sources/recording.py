"""Recordings as partitioned parquet: chunked signals, channel and unit tables, settings."""

from __future__ import annotations

import dataclasses
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeloom import schema as S


def write_signal(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Signal chunks partitioned by recording and sorted by channel, so reads prune files and row groups."""
    S.validate(chunks, S.SIGNAL_CHUNK).repartition("recording_id", "channel", F.expr("chunk div 256")).sortWithinPartitions(
        "recording_id", "channel", "chunk"
    ).write.mode(mode).partitionBy("recording_id").parquet(path)


def read_signal(
    spark: SparkSession, path: str, size: int, channels: tuple[int, int] | None = None, samples: tuple[int, int] | None = None
) -> DataFrame:
    """Rows [lo, hi) of channels and samples; the chunk bounds reach the parquet scan."""
    d = spark.read.parquet(path)
    if channels:
        d = d.where((F.col("channel") >= channels[0]) & (F.col("channel") < channels[1]))
    if samples:
        lo, hi = samples
        d = d.where((F.col("chunk") >= lo // size) & (F.col("chunk") <= (hi - 1) // size))
        at = F.col("chunk") * size
        a = F.greatest(F.lit(lo) - at, F.lit(0))
        b = F.least(F.lit(hi) - at, F.size("samples"))
        d = d.withColumn("samples", F.slice("samples", (a + 1).cast("int"), (b - a).cast("int")))
    return d


def channel_map(spark: SparkSession, path: str, probe: str) -> DataFrame:
    """One-column text or csv file of physical channels; anything but a permutation is refused."""
    if path.endswith((".xls", ".xlsx")):
        raise ValueError("spreadsheets are not supported")
    d = spark.read.csv(path)
    if len(d.columns) != 1:
        raise ValueError("a channel map has one column")
    values = [int(float(r[0])) for r in d.collect()]  # one entry per channel of a probe
    return map_frame(spark, values, probe)


def map_frame(spark: SparkSession, values: list[int], probe: str) -> DataFrame:
    if sorted(values) != list(range(len(values))):
        raise ValueError("a channel map is a permutation of 0..n-1")
    return spark.createDataFrame([(probe, i, v) for i, v in enumerate(values)], "probe string, channel bigint, mapped bigint")


@dataclasses.dataclass(frozen=True)
class FilterSettings:
    filter_type: str = "butterworth_zero"
    order: int = 4
    highpass: float | None = None
    high_width: float | None = None
    lowpass: float | None = None
    low_width: float | None = None
    window: str = "hann"
    sample_rate: float = 1000.0
    notch_freq: float | None = None
    notch_q: float | None = None


@dataclasses.dataclass(frozen=True)
class WaveletSettings:
    f0: float = 1.0
    f1: float = 110.0
    fn: int = 400
    scaling: str = "log"
    gauss_sd: float = 5.0
    n_cycles: float = 7.0
    sigma: float = -1
    zero_mean: bool = True


@dataclasses.dataclass(frozen=True)
class WelchSettings:
    nperseg: int = 2048
    noverlap: int = 1000
    nfft: int = 2048
    window: tuple = ("tukey", 0.25)
    scaling: str = "density"


# Defaults of the published analyses.
LFP_FILTER = FilterSettings(highpass=0.5, lowpass=300.0, sample_rate=1000.0)
SPIKE_FILTER = FilterSettings(highpass=300.0, lowpass=5000.0, sample_rate=40000.0)
PHASE_BANDS = {"gamma": (30.0, 80.0), "beta": (12.0, 20.0), "theta": (4.0, 10.0)}


def save_settings(spark: SparkSession, recording: str, name: str, settings, path: str) -> None:
    """One row per save of a recording's settings group: a map of texts, absent values left out, and when it was saved."""
    vals = {k: repr(v) for k, v in dataclasses.asdict(settings).items() if v is not None}
    spark.createDataFrame([(recording, name, vals)], "recording_id string, name string, settings map<string,string>").withColumn(
        "saved", F.lit(time.time_ns())
    ).write.mode("append").parquet(path)


def load_settings(spark: SparkSession, recording: str, name: str, cls, path: str):
    """The settings that were saved last."""
    import ast

    row = spark.read.parquet(path).where((F.col("recording_id") == recording) & (F.col("name") == name)).agg(F.max_by("settings", "saved").alias("settings")).first()
    if row["settings"] is None:
        raise KeyError(f"no settings {name} for {recording}")
    return cls(**{k: ast.literal_eval(v) for k, v in row["settings"].items()})


def csv_tables(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """All csv files of a pattern as one table, tagged with the name of their folder."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return reader.csv(pattern).withColumn("id", folder)
