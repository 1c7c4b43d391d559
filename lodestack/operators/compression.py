"""Estimated sizes of posting lists under integer codes, by document ids as they are and as clusters relabel them.

A list is coded as gaps between ascending ids, the first gap being its first id + 1. All sizes are bits.
"""

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, partitions
from .clustering import contained, relabel

BLOCKS = (8, 16, 32, 64)
#: Postings whose gaps one task codes.
TASK_ROWS = 250_000


def _log2(x: Column) -> Column:
    return F.log(x) / F.lit(0.6931471805599453)


def approximate_bits(x: Column) -> Column:
    return (2 + F.ceil(_log2(x))).cast("bigint")


def gamma_bits(x: Column) -> Column:
    return (1 + 2 * F.floor(_log2(x))).cast("bigint")


def delta_bits(x: Column) -> Column:
    return (1 + 2 * F.floor(_log2(_log2(2 * x))) + F.floor(_log2(x))).cast("bigint")


def golomb_bits(b: Column, x: Column) -> Column:
    """Quotient in unary, then the remainder in floor(log2 b) bits if it is below half of that power of two, else in the ceiling."""
    q = F.floor((x - 1) / b)
    low = F.floor(_log2(b))
    r = x - q * b - 1
    return (q + 1 + F.when(r < F.pow(F.lit(2.0), low - 1), low).otherwise(F.ceil(_log2(b)))).cast("bigint")


def golomb_factor(total: Column, n: Column) -> Column:
    """The parameter for n gaps that sum to total: the mean gap by ln 2, rounded half to even, 2 at least."""
    return F.when(n == 0, 2).otherwise(F.greatest(F.lit(2), F.rint(total / n * F.lit(0.6931471805599453)).cast("bigint"))).cast("bigint")


def gaps(postings: DataFrame) -> DataFrame:
    """token_id, nth (from 0), gap of postings(token_id, doc_id).

    Lists are dealt out whole in bounded tasks, and stay there for :func:`code_sizes`; one list has a row for each document at most."""
    rows = materialise(postings.select("token_id", "doc_id"))
    rows = rows.repartition(max(partitions(rows.sparkSession), ceil(rows.count() / TASK_ROWS)), "token_id")
    order = "(partition by token_id order by doc_id)"
    return rows.selectExpr("token_id", f"cast(row_number() over {order} - 1 as bigint) as nth", f"doc_id - coalesce(lag(doc_id) over {order}, -1) as gap")


def code_sizes(gap_rows: DataFrame) -> DataFrame:
    """token_id, size, approx, gamma, delta, golomb, hybrid_8 to hybrid_64 of gaps(token_id, nth, gap).

    Hybrids give each block of gaps its own parameter, itself in gamma code. All is summed where a list's gaps are."""
    rows = gap_rows.withColumn("b_golomb", golomb_factor(F.expr("sum(gap) over (partition by token_id)"), F.expr("count(*) over (partition by token_id)")))
    rows = rows.select("*", *(F.expr(f"nth div {b}").alias(f"at_{b}") for b in BLOCKS))
    for b in BLOCKS:
        part = f"partition by token_id, at_{b}"
        rows = rows.withColumn(f"b_{b}", golomb_factor(F.expr(f"sum(gap) over ({part})"), F.expr(f"count(*) over ({part})")))
    x = F.col("gap")
    header = {b: F.when(F.col("nth") % b == 0, gamma_bits(F.col(f"b_{b}") - 1)).otherwise(0) for b in BLOCKS}
    return rows.groupBy("token_id").agg(
        F.count("*").alias("size"), F.sum(approximate_bits(x)).alias("approx"), F.sum(gamma_bits(x)).alias("gamma"), F.sum(delta_bits(x)).alias("delta"),
        F.sum(golomb_bits(F.col("b_golomb"), x)).alias("golomb"), *(F.sum(golomb_bits(F.col(f"b_{b}"), x) + header[b]).alias(f"hybrid_{b}") for b in BLOCKS),
    )


CODES = ["approx", "gamma", "delta", "golomb", *(f"hybrid_{b}" for b in BLOCKS)]


def compression_report(dictionary: DataFrame, postings: DataFrame, clustering: DataFrame) -> DataFrame:
    """token_id, size, then all codes as normal_ and cluster_ columns: a row for every token, 0 where a list is empty.
    Documents outside the clustering are left out."""
    held = contained(postings, clustering)
    held = materialise(held.select("token_id", "doc_id"))
    new = held.join(relabel(clustering).select("doc_id", "new_id"), "doc_id").select("token_id", F.col("new_id").alias("doc_id"))
    normal = code_sizes(gaps(held)).select("token_id", "size", *(F.col(c).alias(f"normal_{c}") for c in CODES))
    by_cluster = code_sizes(gaps(new)).select("token_id", *(F.col(c).alias(f"cluster_{c}") for c in CODES))
    out = dictionary.select("token_id").join(normal, "token_id", "left").join(by_cluster, "token_id", "left")
    return out.select("token_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "token_id"))
