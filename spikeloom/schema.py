"""Table schemas and the views that present the given tables in those schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPIKES = T.StructType(
    [
        T.StructField("recording_id", T.StringType()),
        T.StructField("spike_id", T.LongType()),
        T.StructField("cluster_id", T.LongType()),
        T.StructField("template_id", T.LongType()),
        T.StructField("t", T.LongType()),
        T.StructField("amplitude", T.DoubleType()),
    ]
)
SIGNAL_CHUNK = T.StructType(
    [
        T.StructField("recording_id", T.StringType()),
        T.StructField("channel", T.LongType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("samples", T.ArrayType(T.DoubleType())),
    ]
)
CHANNEL = T.StructType(
    [
        T.StructField("recording_id", T.StringType()),
        T.StructField("channel", T.LongType()),
        T.StructField("coeff", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("fs", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
    ]
)
UNIT = T.StructType(
    [
        T.StructField("recording_id", T.StringType()),
        T.StructField("cluster_id", T.LongType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("cell_type", T.StringType()),
    ]
)

EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"
HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
STOP_US = 30 * DAY_US
SEGMENT_US = 5 * DAY_US
HOURS = 720
SAMPLES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def validate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a schema, failing in analysis when a column is missing."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sorted spikes: user = unit, value = amplitude, type = recording probe."""
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("recording_id"),
        F.col("event_id").alias("spike_id"),
        F.col("user_id").alias("cluster_id"),
        F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)").alias("t"),
        F.col("value").alias("amplitude"),
        F.col("event_type").alias("probe"),
    )


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 64-sample channels in long form."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("channel"),
        F.col("label"),
        F.posexplode("embedding").alias("pos", "raw"),
    ).select(
        F.lit("embeddings").alias("recording_id"),
        "channel",
        "label",
        F.col("pos").cast("bigint").alias("idx"),
        F.col("raw").cast("double").alias("v"),
    )


def signal_chunks(spark: SparkSession, sf_dir: str, size: int = 16) -> DataFrame:
    """Embeddings as chunked channels, the stored form of dense signals, as long as each vector is."""
    n = F.ceil(F.greatest(F.size("embedding"), F.lit(1)) / size).cast("int")
    emb = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        F.lit("embeddings").alias("recording_id"),
        F.col("vec_id").alias("channel"),
        F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(emb, i * size + 1, F.lit(size)))).alias(
            "chunk", "samples"
        ),
    ).withColumn("chunk", F.col("chunk").cast("bigint"))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as unit templates."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("template_id"),
        F.col("label").alias("unit_class"),
        F.col("embedding").cast("array<double>").alias("waveform"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> Column:
    """Number of embeddings, as a scalar."""
    return table(spark, sf_dir, "embeddings").agg(F.nullif(F.count(F.lit(1)), F.lit(0))).scalar()


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event counts per type: dense channels of HOURS samples, longer where events lie before or after; the start stays on a whole segment."""
    e = spikes(spark, sf_dir)
    hour = F.expr(f"(t - pmod(t, {HOUR_US})) div {HOUR_US}")
    bound = lambda f, least, at: e.agg(least(F.coalesce(f(hour), F.lit(at)), F.lit(at)).cast("bigint")).scalar()
    first, last = bound(F.min, F.least, 0), bound(F.max, F.greatest, HOURS - 1)
    first = first - F.pmod(first, F.lit(SEGMENT_US // HOUR_US).cast("bigint"))
    n = e.groupBy(F.col("probe").alias("channel"), hour.alias("idx")).agg(
        F.count(F.lit(1)).alias("n")
    )
    spine = e.select(F.col("probe").alias("channel")).distinct().select(
        "channel", F.explode(F.sequence(first, last)).alias("idx")
    )
    return spine.join(n, ["channel", "idx"], "left").select(
        F.lit("events").alias("recording_id"), "channel", "idx", F.coalesce("n", F.lit(0)).cast("double").alias("v")
    )


# The same views as SQL text, shared by the equivalent queries.
SPK = """spk AS (
  SELECT event_id AS spike_id, user_id AS cluster_id,
         epoch_us(ts) - 1704067200000000 AS t, value AS amplitude, event_type AS probe
  FROM events)"""
SIG = """sig AS (
  SELECT vec_id AS channel, label, CAST(i AS BIGINT) AS idx,
         CAST(embedding[CAST(i + 1 AS INTEGER)] AS DOUBLE) AS v
  FROM embeddings CROSS JOIN range(64) r(i))"""
HRS = f"""hrs AS (
  SELECT c.channel, CAST(r.i AS BIGINT) AS idx, CAST(coalesce(n.n, 0) AS DOUBLE) AS v
  FROM (SELECT DISTINCT event_type AS channel FROM events) c
  CROSS JOIN range({HOURS}) r(i)
  LEFT JOIN (SELECT event_type AS channel,
                    (epoch_us(ts) - 1704067200000000) // {HOUR_US} AS h, count(*) AS n
             FROM events GROUP BY 1, 2) n ON n.channel = c.channel AND n.h = r.i)"""
