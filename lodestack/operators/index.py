"""The inverted index as postings(token_id, doc_id), one row for each term of a document, and its packed view."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_from_lists(lists: DataFrame) -> DataFrame:
    """key, value: the distinct entries of lists(key, values array)."""
    return lists.select("key", F.explode("values").alias("value")).distinct()


def index_tokens(docs: DataFrame) -> DataFrame:
    """token_id, doc_id of docs(doc_id, tokens array): each token once a document."""
    return docs.select(F.explode(F.array_distinct("tokens")).alias("token_id"), "doc_id").distinct()


def packed(postings: DataFrame) -> DataFrame:
    """token_id, n_docs, doc_ids: an ascending array for each token. Its size grows with the collection: for reading
    single lists and for export; operators work on the long form."""
    return postings.groupBy("token_id").agg(F.count("*").alias("n_docs"), F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))


def unpacked(lists: DataFrame) -> DataFrame:
    return lists.select("token_id", F.explode("doc_ids").alias("doc_id"))


def posting_lists(postings: DataFrame, token_ids: DataFrame) -> DataFrame:
    """The rows of the tokens in token_ids(token_id)."""
    return postings.join(token_ids.select("token_id").distinct(), "token_id", "left_semi")


def read_list(postings: DataFrame, token_id: int) -> DataFrame:
    """doc_id of one list, ascending; the filter reaches the scan."""
    return postings.where(F.col("token_id") == token_id).select("doc_id").orderBy("doc_id")


def index_keys(dictionary: DataFrame, postings: DataFrame) -> DataFrame:
    """token_id, size for every key, 0 for those without documents."""
    sizes = postings.groupBy("token_id").agg(F.count("*").alias("size"))
    return dictionary.select("token_id").join(sizes, "token_id", "left").select("token_id", F.coalesce("size", F.lit(0)).alias("size"))


def union_indexes(*indexes: DataFrame) -> DataFrame:
    """The union of disjoint indexes; a document that two of them list for one token is an error."""
    out = indexes[0].select("token_id", "doc_id")
    for x in indexes[1:]:
        out = out.unionByName(x.select("token_id", "doc_id"))
    out = out.groupBy("token_id", "doc_id").agg(F.count("*").alias("n"))
    twice = F.raise_error(F.concat(F.lit("document in two indexes: "), F.col("doc_id").cast("string")))
    return out.select("token_id", F.when(F.col("n") > 1, twice).otherwise(F.col("doc_id")).alias("doc_id"))


def union_index_files(spark, paths: list[str]) -> DataFrame:
    """The union of saved indexes, which must have the same number of keys."""
    keys = {spark.read.parquet(f"{p}/keys").count() for p in paths}
    if len(keys) > 1:
        raise ValueError("files do not match")
    return union_indexes(*(spark.read.parquet(f"{p}/postings") for p in paths))


def doc_limit(documents: DataFrame, first: int | None = None, random: int | None = None, seed: int = 0) -> DataFrame:
    """The documents with id below first, or random ones by a hash of their id; not both."""
    if first is not None and random is not None:
        raise ValueError("either the first or random documents")
    if first is not None:
        return documents.where(F.col("doc_id") < first)
    if random is not None:
        return documents.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}"))), "doc_id").limit(random)
    return documents


def restricted_terms(postings: DataFrame, top: DataFrame) -> DataFrame:
    """doc_id, token_id, local_id: postings of the terms in top(token_id), renumbered from 0 in order of token_id.

    top is a chosen number of terms, so its window is as small as that number."""
    local = top.selectExpr("token_id", "cast(row_number() over (order by token_id) - 1 as bigint) as local_id")
    return postings.join(local, "token_id").select("doc_id", "token_id", "local_id")
