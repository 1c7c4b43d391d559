"""What clustering saves: costs of intersecting the two lists of a query, whole and cluster by cluster."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clustering import summary


def min_cost(x: Column, y: Column) -> Column:
    return F.least(x, y)


def cache_cost(x: Column, y: Column) -> Column:
    """min * (400 - 350 * min / max); 0 for an empty list."""
    small, big = F.least(x, y), F.greatest(x, y)
    return F.when(small == 0, 0.0).otherwise(small * (400 - 350 * (small / big)))


def log_cost(x: Column, y: Column) -> Column:
    """min * ln(min / max); 0 for an empty list."""
    small, big = F.least(x, y), F.greatest(x, y)
    return F.when(small == 0, 0.0).otherwise(small * F.log(small / big))


def cluster_lengths(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, cluster_id, l1, l2 of pairs(query_id, t1, t2): every cluster that holds either term; 0 for the other."""
    s = summary(index)
    sides = pairs.select("query_id", F.explode(F.array(F.struct(F.col("t1").alias("token_id"), F.lit(1).alias("side")), F.struct(F.col("t2").alias("token_id"), F.lit(2).alias("side")))).alias("x"))
    rows = sides.select("query_id", "x.token_id", "x.side").join(s, "token_id")
    return rows.groupBy("query_id", "cluster_id").agg(*(F.sum(F.expr(f"if(side = {k}, n, 0)")).alias(f"l{k}") for k in (1, 2)))


def query_lengths(pairs: DataFrame, lengths: DataFrame) -> DataFrame:
    """query_id, total1, total2, min_sum (of the smaller length over clusters), n_both (clusters that hold both terms), n1, n2."""
    sums = lengths.groupBy("query_id").agg(
        F.sum("l1").alias("total1"), F.sum("l2").alias("total2"), F.sum(F.least("l1", "l2")).alias("min_sum"),
        F.count(F.expr("if(l1 > 0 and l2 > 0, 1, null)")).alias("n_both"), F.count(F.expr("if(l1 > 0, 1, null)")).alias("n1"), F.count(F.expr("if(l2 > 0, 1, null)")).alias("n2"),
    )
    names = [c for c in sums.columns if c != "query_id"]
    return pairs.select("query_id").distinct().join(sums, "query_id", "left").select("query_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))


def query_speedups(pairs: DataFrame, lengths: DataFrame, n_clusters: int) -> DataFrame:
    """query_id, total_cost, list_cost, cluster_cost (with the merge of the cluster lists), n_both, speedup (1 if nothing is left to do)."""
    q = query_lengths(pairs, lengths)
    q = q.select("query_id", F.least("total1", "total2").alias("total_cost"), F.col("min_sum").alias("list_cost"), (F.col("min_sum") + F.least("n_both", F.lit(n_clusters))).alias("cluster_cost"), "n_both")
    return q.withColumn("speedup", F.when(F.col("cluster_cost") == 0, 1.0).otherwise(F.col("total_cost") / F.col("cluster_cost")))


def speedup_report(pairs: DataFrame, lengths: DataFrame, n_clusters: int) -> DataFrame:
    """One row: mean speed-up, speed-up of the sums with and without the merge of the cluster lists, mean clusters of both terms."""
    s = query_speedups(pairs, lengths, n_clusters).agg(
        F.count("*").alias("n_queries"), F.avg("speedup").alias("avg_speedup"), F.coalesce(F.sum("total_cost"), F.lit(0)).alias("total_cost"),
        F.coalesce(F.sum("cluster_cost"), F.lit(0)).alias("cluster_cost"), F.coalesce(F.sum("list_cost"), F.lit(0)).alias("list_cost"), F.avg("n_both").alias("avg_clusters"),
    )
    ratio = "if({0} = 0, 1D, total_cost / {0})"
    return s.select("n_queries", "avg_speedup", F.expr(ratio.format("cluster_cost")).alias("total_speedup"), F.expr(ratio.format("list_cost")).alias("list_speedup"), "total_cost", "cluster_cost", "avg_clusters")


def _grid(pairs: DataFrame, lengths: DataFrame, clusters: DataFrame) -> DataFrame:
    """query_id, cluster_id, l1, l2 for every cluster id of clusters(cluster_id), and the queries' totals."""
    greatest = F.broadcast(clusters.agg(F.max("cluster_id").alias("m")).where("m is not null"))  # one row
    grid = pairs.select("query_id").distinct().join(greatest).select("query_id", F.explode(F.expr("sequence(0L, m)")).alias("cluster_id"))
    grid = grid.join(lengths, ["query_id", "cluster_id"], "left").select("query_id", "cluster_id", F.coalesce("l1", F.lit(0)).alias("l1"), F.coalesce("l2", F.lit(0)).alias("l2"))
    return grid.join(query_lengths(pairs, lengths).select("query_id", "total1", "total2"), "query_id")


def ratio_report(pairs: DataFrame, lengths: DataFrame, clusters: DataFrame) -> DataFrame:
    """query_id, cluster_id (-1: whole lists), ratio: of the list that is shorter as a whole to the longer one; 0 for an empty divisor."""
    g = _grid(pairs, lengths, clusters)
    rows = g.select("query_id", "cluster_id", "l1", "l2", "total1", "total2").unionByName(g.where("cluster_id = 0").selectExpr("query_id", "-1L as cluster_id", "total1 as l1", "total2 as l2", "total1", "total2"))
    ratio = "case when total1 > total2 then if(l1 = 0, 0D, l2 / l1) else if(l2 = 0, 0D, l1 / l2) end"
    return rows.select("query_id", "cluster_id", F.expr(ratio).alias("ratio"))


def sizes_report(pairs: DataFrame, lengths: DataFrame, clusters: DataFrame) -> DataFrame:
    """query_id, total ("l1/l2"), clusters (an array of the same for each cluster)."""
    g = _grid(pairs, lengths, clusters).withColumn("text", F.expr("concat(l1, '/', l2)"))
    return g.groupBy("query_id").agg(F.expr("concat(first(total1), '/', first(total2))").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("cluster_id", "text"))), lambda x: x["text"]).alias("clusters"))


def log_factorials(spark, greatest: int) -> DataFrame:
    """n, lf: ln(n!) for n up to greatest, as running sums; a small table (greatest is twice the longest list at most)."""
    return spark.range(greatest + 1).selectExpr("id as n", "sum(if(id = 0, 0D, ln(id))) over (order by id rows unbounded preceding) as lf")


def log_complexity(rows: DataFrame, x: str, y: str, name: str, table: DataFrame, greatest: int) -> DataFrame:
    """rows with name: the floor of ln((x + y)! / (x! y!)), the bits (in nats) that tell the merge of two lists. Beyond the
    table it is an error."""
    out = rows.withColumn("__s", F.when(F.col(x) + F.col(y) > greatest, F.raise_error(F.lit("value out of precalculated range"))).otherwise(F.col(x) + F.col(y)))
    for k, column in enumerate((x, y, "__s")):
        out = out.join(table.select(F.col("n").alias(f"__n{k}"), F.col("lf").alias(f"__lf{k}")), F.col(column) == F.col(f"__n{k}"))
    out = out.withColumn(name, F.floor(F.col("__lf2") - F.col("__lf1") - F.col("__lf0")))
    return out.drop("__s", *(f"__{p}{k}" for p in ("n", "lf") for k in range(3)))


def benchmark_sizes(pairs: DataFrame, lengths: DataFrame, log: bool = False, greatest: int | None = None) -> DataFrame:
    """query_id, size_small, size_big, normal_comp, intersect_comp, cluster_comp: costs by the smaller length or, with log,
    by log_complexity: of whole lists, summed over clusters, and of the lists of clusters."""
    q = query_lengths(pairs, lengths)
    base = q.select("query_id", F.least("total1", "total2").alias("size_small"), F.greatest("total1", "total2").alias("size_big"), "total1", "total2", "min_sum", "n1", "n2")
    if not log:
        return base.select("query_id", "size_small", "size_big", F.col("size_small").alias("normal_comp"), F.col("min_sum").alias("intersect_comp"), F.least("n1", "n2").alias("cluster_comp"))
    if greatest is None:
        greatest = base.agg(F.max(F.col("total1") + F.col("total2"))).first()[0] or 0
    table = log_factorials(pairs.sparkSession, greatest)
    each = log_complexity(lengths, "l1", "l2", "c", table, greatest).groupBy("query_id").agg(F.sum("c").alias("intersect_comp"))
    out = log_complexity(log_complexity(base, "total1", "total2", "normal_comp", table, greatest), "n1", "n2", "cluster_comp", table, greatest)
    out = out.join(each, "query_id", "left")
    return out.select("query_id", "size_small", "size_big", "normal_comp", F.coalesce("intersect_comp", F.lit(0)).alias("intersect_comp"), "cluster_comp")


def tab_separated(report: DataFrame, *columns: str) -> DataFrame:
    """line: the columns of each row as text, with tabs between; for a report file with one header line."""
    return report.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in columns)).alias("line"))
