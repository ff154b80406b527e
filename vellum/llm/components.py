"""Connected components, and linking within buckets without emitting all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, free_shuffles, table


def _print_of(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in links (a, b); component is the smallest id reachable.

    Alternates large-star and small-star steps on the edge table. A step is two
    aggregations with map-side combine and two joins whose skewed keys Spark can split; no
    neighbourhood is gathered in one task. Each round's edges are a written table, so a lost
    executor costs a task, not the history. Null ends and self links are ignored. Rounds grow with
    the logarithm of the ids; more than most_rounds raise an error.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = table(edges, "edges")
    before = _print_of(edges)
    rounds = 0
    while before[0]:
        if (rounds := rounds + 1) > most_rounds:
            raise RuntimeError(f"components are unfinished after {most_rounds} rounds")
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(lowest.hint("merge"), "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = table(moved.union(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        drop_table(edges)
        edges, now = after, _print_of(after)
        if now == before:
            break
        before = now
    stars = edges.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "id")
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())


def written(links: DataFrame, used: list[DataFrame]) -> DataFrame:
    out = table(links, "links")
    for x in used:
        drop_table(x)
    free_shuffles(out.sparkSession)
    return out


def linked(buckets: DataFrame, sketches: DataFrame, near: Callable[[str, str], Column], confirm: Callable[[DataFrame], tuple[DataFrame, list[DataFrame]]], rounds: int = 2, closer: tuple[DataFrame, Callable[[str, str], Column]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Components of ids that share a bucket and pass `near` and `confirm`, and the confirmed links used.

    buckets: (key, id, band), one row for each id in a bucket of two or more; an id is in one
    bucket of a band at most. sketches: (id, keys, ...), keys being an id's bucket of each band.
    near(x, y): a cheap test on the sketch columns of aliases x and y that lets every true
    link through. confirm: keeps the true links of (a, b), and names the tables that aren't needed once these are written.

    A round links each member of a bucket with one leader, a row per membership. Its links
    join most of a group of copies, whose inner pairs then need no test. What remains is
    every pair of a bucket that lies in different components, with one end outside the
    bucket's largest component; these are joined with the sketch test as a join
    condition, in the first bucket that they share, so that no link is lost and no failing pair
    leaves the join. closer: more columns (id, ...) for that join alone, some ids may lack them, and a sharper test on them.
    """
    links = None
    comp = None
    for k in range(rounds):
        if comp is None:
            now = buckets.select("key", "id")
            lead = now.groupBy("key").agg(F.min("id").alias("leader"))
            pairs = now.join(lead.hint("merge"), "key").where("id <> leader")
        else:
            now = buckets.select("key", "id").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
            order = F.xxhash64("id", F.lit(k))
            lead = now.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("id").alias("leader"), F.col("component").alias("c"))).alias("l"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key", "l.leader", "l.c")
            pairs = now.join(lead.hint("merge"), "key").where("component <> c")
        pairs = pairs.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        x, y = sketches.alias("x"), sketches.alias("y")
        pairs = pairs.join(x, F.col("a") == F.col("x.id")).join(y, (F.col("b") == F.col("y.id")) & near("x", "y")).select("a", "b")
        found = written(*confirm(pairs))
        links = found if links is None else links.union(found)
        if comp is None or not found.isEmpty():
            comp = table(components(links), "components")
    now = buckets.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sized = now.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sized.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("m.component").alias("main"))
    rest = now.join(main.hint("merge"), "key").join(sketches, "id")
    rest = table(rest.join(closer[0], "id", "left") if closer else rest, "rest")
    free_shuffles(rest.sparkSession)
    y, x = rest.alias("y"), rest.where("component <> main").alias("x")
    once = F.expr("forall(zip_with(slice(x.keys, 1, x.band), slice(y.keys, 1, x.band), (p, q) -> p <> q), z -> z)")
    tested = near("x", "y") & once
    tested = F.when(tested, closer[1]("x", "y")).otherwise(False) if closer else tested  # the sharper test only where it is needed
    pairs = x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))) & tested)
    found = written(*confirm(pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()))
    drop_table(rest)
    links = links.union(found)
    if found.isEmpty():
        return comp, links
    return table(components(links), "components"), links
