"""Search as a stream: query lines come in, each is answered once against a saved collection."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import search_report


def query_lines(spark: SparkSession, folder: str) -> DataFrame:
    """raw: the lines of files as they arrive in a folder."""
    return spark.readStream.text(folder).select(F.col("value").alias("raw"))


def answer(lines: DataFrame, dictionary: DataFrame, postings: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends raw, status, n_docs, first_docs for every line of each micro-batch to the Parquet folder sink, once.

    A batch writes its own folder, overwritten if it is run again after a failure."""

    def run(batch: DataFrame, n: int) -> None:
        queries = batch.groupBy("raw").agg(F.count("*").alias("asked")).withColumn("query_id", F.col("raw"))  # equal lines are answered once
        out = search_report(queries, dictionary, postings)
        out = queries.join(out, "query_id").select(F.explode(F.expr("sequence(1L, asked)")).alias("_"), "raw", "status", "n_docs", "first_docs").drop("_")
        out.write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
