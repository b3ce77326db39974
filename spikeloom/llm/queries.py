"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeloom.llm import chat, fingerprint, minhash, mixing, periods, pieces, pii, pivots, quality, sql, suffix, trie, urls, warc
from spikeloom.plans.registry import Builder

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {
    "op11_periodic_runs": sql.PERIODIC_RUNS,
    "op12_prefix_trie": sql.PREFIX_TRIE,
    "op13_exact_top_k": sql.EXACT_TOP_K,
}


def query(fn: Builder) -> Builder:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of verified links of every document, and whether it stays."""
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("class_id") == F.col("doc_id"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced."""
    return pii.pseudonymised(table(spark, sf_dir, "documents"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes, removed runs and the digest of what is left, of every document."""
    return suffix.deduplicated(table(spark, sf_dir, "documents"))


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document and whether they decode to its text."""
    return pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and its edited text."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query
def op7_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of the conversations, linked, ordered, validated and serialised."""
    calls, results = chat.from_turns(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame([(k, chat.canonical(v)) for k, v in chat.SCHEMAS.items()], "name string, schema string")
    return chat.linked(calls, results, schemas)


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urls.judged(table(spark, sf_dir, "pages"))


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and taken words of every document."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold of every page."""
    return warc.archived(table(spark, sf_dir, "pages"), warc.shared_folder(spark, "warc")).drop("url", "body_digest")


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of periodic runs of every document, the greatest of them, digests of all and of what is left."""
    found = periods.periodic_runs(periods.with_planted_period(table(spark, sf_dir, "documents")))
    found = found.withColumn("_run", periods.greatest_run(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_run.start", "_run.length", "_run.period",
        F.expr("(1000 * _run.length) div _run.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations, with the digest of its end list."""
    made = trie.prefix_trie(table(spark, sf_dir, "conversations"))
    out = made.nodes.join(trie.end_digests(made.ends), trie.KEY, "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))).drop(*trie.SUMS)


@query
def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors of every hundredth vector."""
    return pivots.top_scores(table(spark, sf_dir, "embeddings")).drop("n_bounded", "n_evaluated")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
