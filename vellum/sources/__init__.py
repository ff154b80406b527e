"""Readers of the input tables, and the roles that they play."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tab_separated(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Lines of tab-separated text without quoting; lines with fewer columns are left out. Compressed files are read as they are."""
    from pyspark.sql import functions as F

    parts = spark.read.text(path).select(F.split("value", "\t").alias("v")).where(F.size("v") >= len(columns))
    return parts.select(*[F.col("v")[i].alias(c) for i, c in enumerate(columns)])


def json_lines(spark: SparkSession, path: str, schema: str, needle: str | None = None) -> DataFrame:
    """JSON lines of a pinned schema; with a needle, only lines that contain it are parsed."""
    from pyspark.sql import functions as F

    lines = spark.read.text(path)
    if needle:
        lines = lines.where(F.col("value").contains(needle))
    return lines.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")
