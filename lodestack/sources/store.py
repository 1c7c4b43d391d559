"""Saved collections, indexes and reports. Parquet takes the place of own binary formats."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as I
from ..session import dense_ids


def write_documents(docs: DataFrame, path: str, order: str) -> None:
    """Documents as a table; without a doc_id they get dense ids in the given order (SQL sort keys that tell rows apart)."""
    numbered = docs if "doc_id" in docs.columns else dense_ids(docs, "doc_id", *(x.strip() for x in order.split(",")))
    numbered.write.parquet(path)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def documents_by_id(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of ids(ord, doc_id), with ord: as often and, sorted by ord, in the order as asked for."""
    return ids.select("ord", "doc_id").join(docs, "doc_id")


def document(docs: DataFrame, doc_id: int) -> DataFrame:
    """One document and what is known of it; the filter reaches the scan."""
    return docs.where(F.col("doc_id") == doc_id)


def write_index(dictionary: DataFrame, postings: DataFrame, path: str) -> None:
    """keys (every token, empty lists too) and postings sorted by token, so that one list is read by few row groups."""
    dictionary.select("token_id").write.parquet(f"{path}/keys")
    postings.select("token_id", "doc_id").repartitionByRange("token_id", "doc_id").sortWithinPartitions("token_id", "doc_id").write.parquet(f"{path}/postings")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """keys and postings."""
    return spark.read.parquet(f"{path}/keys"), spark.read.parquet(f"{path}/postings")


def write_cluster_indexes(index: DataFrame, path: str) -> None:
    """An index folder for each cluster of index(token_id, cluster_id, doc_id)."""
    index.repartition("cluster_id", F.pmod(F.xxhash64("token_id"), F.lit(16))).sortWithinPartitions("token_id", "doc_id").write.partitionBy("cluster_id").parquet(path)


def cluster_index(spark: SparkSession, path: str, cluster_id: int) -> DataFrame:
    """token_id, doc_id of one cluster: only its folder is read."""
    return spark.read.parquet(path).where(F.col("cluster_id") == cluster_id).select("token_id", "doc_id")


def union_saved(spark: SparkSession, paths: list[str], path: str) -> None:
    """Joins saved indexes of disjoint documents into one."""
    joined = I.union_index_files(spark, paths)
    write_index(spark.read.parquet(f"{paths[0]}/keys"), joined, path)


def write_report(report: DataFrame, path: str) -> None:
    """A tab-separated report with a header; arrays are written as JSON."""
    columns = [F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in report.dtypes]
    report.select(columns).write.csv(path, sep="\t", header=True)
