"""Groups of items that links connect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import written


def groups(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(item, root) of each item in links (a, b); root is the least item that its links reach.

    In a round an item takes the least root among its neighbours, then that root's own root. Rounds grow with the logarithm of
    the longest way in most graphs; more than most_rounds raise an error. Each round is a written table. Null ends are ignored.
    """
    ends = links.where("a is not null and b is not null")
    ends = written(ends.select("a", "b").union(ends.select("b", "a")).distinct())
    roots = written(ends.groupBy(F.col("a").alias("item")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(most_rounds):
        near = ends.join(roots.select(F.col("item").alias("b"), "root"), "b").groupBy(F.col("a").alias("item")).agg(F.min("root").alias("near"))
        least = roots.join(near, "item").select("item", F.least("root", "near").alias("root"))
        jumps = roots.select(F.col("item").alias("root"), F.col("root").alias("next"))
        after = written(least.join(jumps, "root", "left").select("item", F.least("root", F.coalesce("next", "root")).alias("root")))
        moved = after.join(roots.withColumnRenamed("root", "before"), "item").where("root <> before").isEmpty()
        roots = after
        if moved:
            return roots
    raise RuntimeError(f"groups are unfinished after {most_rounds} rounds")
