"""The operators of this subpackage over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLE_SQL  # noqa: F401
from .store import table


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compression import compression_bands, fit_bands

    docs = table(spark, sf_dir, "documents")
    return compression_bands(docs, fit_bands(docs, table(spark, sf_dir, "labels")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination, items_digest

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .relative_lz import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .page_template import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import shingle_components

    return shingle_components(table(spark, sf_dir, "documents"))


def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_along_curve

    return pack_along_curve(table(spark, sf_dir, "documents"))


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages")).drop("component")


def op11_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .digest_index import drop_copies

    return drop_copies(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_terms import divergence

    return divergence(table(spark, sf_dir, "documents"))


def with_periods(docs: DataFrame) -> DataFrame:
    """documents with a tenth of the texts made periodic from some word on, as the query's contract says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    periodic = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), periodic).otherwise(F.col("text")).alias("text"))


def op13_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import find_runs, longest_run, runs_digest

    found = find_runs(with_periods(table(spark, sf_dir, "documents"))).withColumn("best", longest_run())
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), runs_digest().alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_compression_bands, op2_secret_scan, op3_decontamination, op4_importance_resampling, op5_relative_lz, op6_template_extraction, op7_shingle_join, op8_curve_packing, op9_byte_shards, op10_url_filter, op11_digest_index, op12_source_divergence, op13_harmonic_runs)}
