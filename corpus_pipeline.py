"""A training corpus from raw documents: toxic documents go, then near copies, then passages that an earlier
document holds; the rest is mixed to source weights and packed into sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs, the table that the stage before it
wrote; all but the last return the columns of documents. Stages handle nulls, empty texts, repeated rows and
empty tables as their operators' docstrings say.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.mixing import mixed_documents
from lodestack.llm.packing import pack_documents
from lodestack.llm.registry import table
from lodestack.llm.session import materialise
from lodestack.llm.simhash import one_of_each
from lodestack.llm.substring import without_repeated_passages
from lodestack.llm.toxicity import flag_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by a model of the labels that are no held-out rows."""
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    flagged = flag_toxic(docs, model)
    score = flagged.columns[-1]
    return flagged.where(F.col(score) < 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word windows that an earlier document holds; documents of which nothing is left go."""
    return without_repeated_passages(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a sequence."""
    return pack_documents(docs).drop("ids")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

#: Fingerprint components, learned scores and token ids are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "*")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
