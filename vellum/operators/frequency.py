"""Frequency lists and their blends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ranked


def words(df: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of df with a row for each word (letters, lower-cased)."""
    return df.withColumn("word", F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)))).drop(text)


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def frequency_ranks(counted: DataFrame, key: str, name: str) -> DataFrame:
    return ranked(counted, name, F.col("n").desc(), F.col(key)).select(key, name)


def blended(first: DataFrame, second: DataFrame, key: str, third: DataFrame | None = None, weight: float = 1.0) -> DataFrame:
    """Mean log rank of keys in both lists; a third list counts `weight`, and a key that it lacks ranks after its last."""
    a, b = frequency_ranks(first, key, "rank_a"), frequency_ranks(second, key, "rank_b")
    both = a.join(b, key)
    total: Column = F.ln("rank_a") + F.ln("rank_b")
    if third is None:
        return both.withColumn("score", total / 2)
    c = frequency_ranks(third, key, "rank_c")
    last = third.agg((F.count("*") + 1).alias("last"))
    both = both.join(c, key, "left").crossJoin(F.broadcast(last)).withColumn("rank_c", F.coalesce("rank_c", "last")).drop("last")
    return both.withColumn("score", (total + weight * F.ln("rank_c")) / (2 + weight))
