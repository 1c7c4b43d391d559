"""Tables that cut lineage, from the package's session module, and the size of Arrow batches."""

from pyspark.sql import SparkSession

from ..session import discard, materialise, partitions, shared_dir

__all__ = ["discard", "materialise", "partitions", "shared_dir", "small_batches"]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's rows of an Arrow batch to this many, so that batches of long texts stay small in a worker. Spark reads
    the setting when a plan runs, so it stays lowered; a session that has it lower keeps its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
