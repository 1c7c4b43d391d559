"""A document collection as tables: words, terms of a document, dictionary, boolean postings; and its statistics.

``documents`` has a doc_id that is unique and a text; the tables are:

* words(doc_id, words array) - every word, in order
* doc_terms(doc_id, term, n, first) - a row for each term of a document: its places' number and first one
* dictionary(token_id, term, tf, df) - token ids are dense, in order of first sight by (doc_id, position)
* postings(token_id, doc_id) - distinct; sorted by both, so that a list is read by row groups

A document keeps at most ``MAX_DOC_TOKENS`` tokens for postings and lengths; term frequencies count all.
"""

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import dense_ids, materialise, partitions

MAX_DOC_TOKENS = 16_382
#: Counters stop here.
MAX_COUNT = 2**32 - 1
#: Words whose documents one task counts.
TASK_TOKENS = 3_000_000


@dataclass(frozen=True)
class Collection:
    words: DataFrame
    doc_terms: DataFrame
    dictionary: DataFrame
    postings: DataFrame

    @staticmethod
    def build(documents: DataFrame) -> "Collection":
        """Tokenises and indexes documents(doc_id, text); every table is written once to the shared folder.

        Null texts have no words; rows with a null id are left out; rows that share an id are one document.
        """
        words = materialise(word_table(documents))
        doc_terms = materialise(doc_term_frequencies(words))
        dictionary = materialise(build_dictionary(doc_terms))
        postings = build_postings(doc_terms, dictionary)
        n = partitions(documents.sparkSession)
        postings = materialise(postings.repartitionByRange(n, "token_id", "doc_id").sortWithinPartitions("token_id", "doc_id"))
        return Collection(words, doc_terms, dictionary, postings)

    def save(self, path: str) -> None:
        for name in ("words", "doc_terms", "dictionary", "postings"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str) -> "Collection":
        return Collection(*(spark.read.parquet(f"{path}/{name}") for name in ("words", "doc_terms", "dictionary", "postings")))


def word_table(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id is not null").select("doc_id", T.words("text").alias("words"))


def tokens(words: DataFrame) -> DataFrame:
    """doc_id, pos, term: a row for each word."""
    return words.select("doc_id", F.posexplode("words").alias("pos", "term")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "term")


def doc_term_frequencies(words: DataFrame) -> DataFrame:
    """Documents are dealt out whole, in bounded tasks, and counted where they are: words are shuffled as arrays, not a row for each."""
    n = words.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    words = words.select("doc_id", "words").repartition(max(partitions(words.sparkSession), ceil(n / TASK_TOKENS)), "doc_id")
    return tokens(words).groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def build_dictionary(doc_terms: DataFrame, max_doc_tokens: int = MAX_DOC_TOKENS) -> DataFrame:
    seen = doc_terms.groupBy("term").agg(
        F.min(F.struct("doc_id", "first")).alias("seen"),
        F.least(F.sum("n"), F.lit(MAX_COUNT)).cast("bigint").alias("tf"),
        F.count(F.when(F.col("first") < max_doc_tokens, 1)).alias("df"),
    )
    return dense_ids(seen, "token_id", "seen").select("token_id", "term", "tf", "df")


def build_postings(doc_terms: DataFrame, dictionary: DataFrame, max_doc_tokens: int | None = MAX_DOC_TOKENS) -> DataFrame:
    """token_id, doc_id; of whole texts if max_doc_tokens is None. A common term's rows may be many: the join is one that Spark splits at run time."""
    stored = (doc_terms if max_doc_tokens is None else doc_terms.where(F.col("first") < max_doc_tokens)).select("doc_id", "term")
    return stored.join(dictionary.select("term", "token_id"), "term").select("token_id", "doc_id")


def _coded(max_doc_tokens: int):
    def run(batches):
        terms, ids, table = [], [], None
        for b in batches:  # the block's dictionary comes first: its rows have a token_id
            k = len(b) - b.column("token_id").null_count
            if k:
                terms.append(b.column("term").slice(0, k))
                ids.append(b.column("token_id").slice(0, k))
            if k == len(b):
                continue
            if table is None:
                table = pa.concat_arrays(terms) if terms else pa.array([], pa.string()), pa.concat_arrays(ids) if ids else pa.array([], pa.int64())
            lists = b.column("words").slice(k)
            starts, ends = lists.offsets[:-1].to_numpy(), lists.offsets[1:].to_numpy()
            n = np.minimum(ends - starts, max_doc_tokens)
            at = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())
            found = pc.index_in(lists.values.take(pa.array(at)), value_set=table[0])
            offsets = np.r_[0, np.cumsum(n)]
            if found.null_count:  # words that the dictionary lacks
                known = np.r_[0, np.cumsum(found.is_valid().to_numpy(zero_copy_only=False))]
                offsets, found = known[offsets], found.drop_null()
            tokens_ = pa.ListArray.from_arrays(offsets.astype(np.int32), table[1].take(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(k), tokens_], names=["doc_id", "tokens"])

    return run


def token_docs(words: DataFrame, dictionary: DataFrame, max_doc_tokens: int = MAX_DOC_TOKENS) -> DataFrame:
    """doc_id, tokens: the stored token sequence of every document, empty ones too.

    Documents are dealt into blocks of bounded words; a block gets its own distinct terms with their ids, so words move once, as arrays."""
    n = words.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = max(ceil(n / TASK_TOKENS), min(partitions(words.sparkSession), ceil(n / 250_000)), 1)
    block = F.expr(f"cast(pmod(xxhash64(doc_id div 64), {blocks}) as int)").alias("block")
    used = words.select(block, F.explode(F.array_distinct("words")).alias("term")).distinct().join(dictionary.select("term", "token_id"), "term")
    used = used.select("block", F.lit(0).cast("bigint").alias("doc_id"), F.array().cast("array<string>").alias("words"), "term", "token_id")
    rows = words.select(block, "doc_id", "words", F.lit(None).cast("string").alias("term"), F.lit(None).cast("bigint").alias("token_id"))
    rows = used.unionByName(rows).repartitionById(blocks, "block").sortWithinPartitions(F.col("token_id").isNull())
    return rows.drop("block").mapInArrow(_coded(max_doc_tokens), "doc_id bigint, tokens array<bigint>")


def document_lengths(words: DataFrame, max_doc_tokens: int = MAX_DOC_TOKENS) -> DataFrame:
    """doc_id, length: stored tokens."""
    return words.select("doc_id", F.least(F.size("words"), F.lit(max_doc_tokens)).cast("bigint").alias("length"))


def lookup_words(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """terms(term, ...) with token_id, null if the dictionary has no such word."""
    return terms.join(dictionary.select("term", "token_id"), "term", "left")


def lookup_tokens(ids: DataFrame, dictionary: DataFrame) -> DataFrame:
    """ids(token_id, ...) with term; an id that is out of range is an error."""
    found = ids.join(dictionary.select("token_id", "term"), "token_id", "left")
    return found.withColumn("term", F.when(F.col("term").isNull(), F.raise_error(F.concat(F.lit("no such token: "), F.col("token_id").cast("string")))).otherwise(F.col("term")))


def add_words(dictionary: DataFrame, terms: DataFrame) -> DataFrame:
    """token_id, term: the dictionary with the new ones of terms(term, ord) after its last id, in order of first sight."""
    new = terms.groupBy("term").agg(F.min("ord").alias("ord")).join(dictionary, "term", "left_anti")
    size = dictionary.agg(F.coalesce(F.max("token_id") + 1, F.lit(0)).alias("size"))
    new = dense_ids(new, "rank", "ord", "term").crossJoin(F.broadcast(size))  # one row
    return dictionary.select("token_id", "term").unionByName(new.select((F.col("size") + F.col("rank")).alias("token_id"), "term"))


def term_probabilities(counts: DataFrame) -> DataFrame:
    """token_id, p of counts(token_id, n): shares of all counts, 0 if there are none."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("token_id", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("p"))


def log_counts(query_terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """token_id, n: how often each term of the dictionary is in query_terms(term); unknown words don't count."""
    n = query_terms.groupBy("term").agg(F.count("*").alias("n"))
    return dictionary.select("token_id", "term").join(n, "term", "left").select("token_id", F.coalesce("n", F.lit(0)).alias("n"))


def top_terms(weights: DataFrame, n: int, low_id_first: bool = True) -> DataFrame:
    """token_id, w: the n terms of weights(token_id, w) that weigh most; ties by id."""
    return weights.orderBy(F.desc("w"), F.asc("token_id") if low_id_first else F.desc("token_id")).limit(n)


def collection_statistics(words: DataFrame, dictionary: DataFrame, tops=(1000, 10_000, 100_000, 1_000_000)) -> DataFrame:
    """One row: documents, mean stored length, terms, mean, median, greatest and total frequency, sums of the top ones.

    The median is the entry at n div 2 of the descending list. Frequencies are numbered by value: a row for
    each distinct frequency, not for each term, meets in one task.
    """
    docs = document_lengths(words).agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_doc_length"))
    values = dictionary.groupBy("tf").agg(F.count("*").alias("m"))
    ahead = "coalesce(sum(m) over (order by tf desc rows between unbounded preceding and 1 preceding), 0)"
    values = values.selectExpr("tf", "m", f"{ahead} as ahead", "sum(m) over () as n")
    sums = [F.coalesce(F.sum(F.expr(f"tf * greatest(0, least(m, {t} - ahead))")), F.lit(0)).cast("bigint").alias(f"sum_top_{t}") for t in tops]
    terms = values.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("n_terms"),
        F.coalesce(F.sum(F.expr("tf * m")) / F.sum("m"), F.lit(0.0)).alias("avg_tf"),
        F.coalesce(F.max(F.expr("case when ahead <= n div 2 and n div 2 < ahead + m then tf end")), F.lit(0)).alias("median_tf"),
        F.coalesce(F.max("tf"), F.lit(0)).alias("max_tf"),
        F.coalesce(F.sum(F.expr("tf * m")), F.lit(0)).cast("bigint").alias("total_tf"),
        *sums,
    )
    return docs.crossJoin(F.broadcast(terms))  # one row each


def collection_bounds(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row: collection_size, max_doc_id, dictionary_size."""
    docs = words.agg(F.count("*").alias("collection_size"), F.max("doc_id").alias("max_doc_id"))
    return docs.crossJoin(F.broadcast(dictionary.agg(F.count("*").alias("dictionary_size"))))
