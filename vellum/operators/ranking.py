"""Ranks over whole tables without one task for all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Up to so many partitions, their offsets (16 bytes each) are sent to every executor; beyond, they are joined by key.
MOST_BROADCAST = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one, but only if Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="vellum-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, and lost executors cost no more than tasks. Deleted as the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vellum-rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """df with a rank from 1, without ties if order is total.

    Rows are sorted by range; a row's rank is its place in its partition after the rows of the
    partitions before it. The sizes of partitions, a row each, are all that is gathered. df is written first, as
    sorting reads it twice.
    """
    bits = (1 << 33) - 1
    rows = written(df).orderBy(*order).select("*", F.monotonically_increasing_id().alias("_m"))
    rows = written(rows.select("*", F.shiftright("_m", 33).alias("_p")))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    sizes = written(sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o")))
    out = rows.join(F.broadcast(sizes) if sizes.count() <= MOST_BROADCAST else sizes, "_p")
    return out.withColumn(name, F.col("_o") + F.col("_m").bitwiseAND(F.lit(bits)) + 1).drop("_m", "_p", "_o")
