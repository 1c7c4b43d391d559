"""The queries of the training-data operators and their SQL, as __spark_entry__ registers them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, mixing
from .ann import nearest_neighbours
from .html_extract import main_text
from .packing import pack_documents
from .quality import quality
from .simhash import near_duplicates
from .substring import remove_repeated_passages
from .suffix import remove_repeated_bytes
from .toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text")).drop("ids")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return out.select("doc_id", F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, false)").alias("held_out"), "score", "predicted")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.balance(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_quality_rules, op3_suffix_array_dedup, op4_harmonic_packing, op5_substring_dedup, op6_simhash_near_dedup, op7_html_main_text, op8_toxicity, op9_nearest_neighbours, op10_source_mixing)
}
ORACLE_SQL = {"op1_license_scan": licenses.ORACLE, "op10_source_mixing": mixing.ORACLE}
