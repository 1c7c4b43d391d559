"""Settings of the session that operators read, tables that cut lineage, and dense numbering without one big task."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local one stands in on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "lodestack-shared")
    return path.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: no lineage, and no single copy on an executor.

    Spark's own checkpoint() is not used, as it keeps rows uncompressed; Parquet also lets later scans prune columns.
    The table goes when the application ends (or by :func:`discard`), as results that read it may be lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestack-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _hadoop_path(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.lodestack_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of :func:`materialise` that nothing reads any more."""
    path = getattr(df, "lodestack_path", None)
    if path:
        files, where = _hadoop_path(df.sparkSession, path)
        files.delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dense_ids(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with a column name: 0, 1, ... in the order of the SQL sort keys, which should tell all rows apart.

    Rows are dealt out by ranges of the keys; each range numbers its own rows, after the rows of the ranges
    before it. Only a row for each range meets in one task.
    """
    keys = [F.expr(o[:-5]).desc() if o.lower().endswith(" desc") else F.expr(o) for o in order]
    ranged = df.repartitionByRange(partitions(df.sparkSession), *keys).withColumn("__range", F.spark_partition_id())
    ranged = materialise(ranged)
    before = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = before.selectExpr("__range", "coalesce(sum(__n) over (order by __range rows between unbounded preceding and 1 preceding), 0) as __before")
    inner = f"row_number() over (partition by __range order by {', '.join(order)}) - 1"
    out = ranged.join(F.broadcast(before), "__range")  # a row for each partition
    return out.withColumn(name, F.expr(f"cast(__before + {inner} as bigint)")).drop("__range", "__before")
