"""Mixing sources to target weights: whole repetitions plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table

#: Up to so many sources, their rates (about 50 bytes a row) are sent to every executor; beyond, they are joined by key.
MOST_BROADCAST_SOURCES = 50_000
SEEDS = 32


def draw(seed: int, column: str = "doc_id"):
    """A number in [0, 1) from the id and the seed: 8 hexadecimal digits of an MD5, four seeds to a hash."""
    text = F.concat(F.lit(f"{seed // 4}:"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 8 * (seed % 4) + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sized: DataFrame, most: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target) of each source in sized (source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. Together the targets are the total
    size; none exceeds `most` times its source's size. With sources ordered by cap over weight,
    a source is capped if the level of those not capped before it reaches its cap. One row a source
    meets in the windows.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    per = per.withColumn("cap", F.col("source_size") * F.lit(most))
    all_, order = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cap0 = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight0 = F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("total", F.sum("source_size").over(all_)).withColumn("weights", F.sum("weight").over(all_))
    per = per.withColumn("capped", (F.col("total") - cap0) * F.col("weight") >= F.col("cap") * (F.col("weights") - weight0))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(all_), F.lit(0.0))
    share = F.col("weights") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(all_), F.lit(0))
    return per.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(left * F.col("weight") / share)).select("source", "source_size", "weight", "target")


def by_source(docs: DataFrame, small: DataFrame, n: int) -> DataFrame:
    """docs with the columns of small, which has a row for each source."""
    same = docs["source"].eqNullSafe(small["source"])
    return docs.join(F.broadcast(small) if n <= MOST_BROADCAST_SOURCES else small, same).drop(small["source"])


def mixed_documents(docs: DataFrame, most: float = 3.0, seeds: int = SEEDS) -> DataFrame:
    """docs with size, source_size, target, copies and taken; a row for each row of docs.

    docs: doc_id, text, source and any other columns; those of these five names are replaced. Size
    is the number of words, 0 for null texts. A source repeats each document floor(rate) times,
    rate = target / source size, and once more if the document's draw is under the fraction.
    Each source uses that one of `seeds` seeds (ties: the first) whose copies come nearest to its
    target; all are summed in the same pass. With one seed a copy is a Bernoulli draw of the fraction; the best
    of several keeps that chance only about. Sources without words have a target of 0 and take
    nothing. Rows that repeat a doc_id share its draw. Null ids draw as the empty id.
    """
    out = drawn(docs, most, seeds)
    own = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    return out.select(*own, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def drawn(docs: DataFrame, most: float, seeds: int) -> DataFrame:
    """(row, size, source_size, target, copies): row is the whole row of docs, so that no names of its columns can clash."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", size.alias("size"))
    rates = targets(sized.select("source", "size"), most)
    rates = rates.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0)))
    rates = table(rates.select("source", "source_size", "target", "rate"), "rates")
    n = rates.count()
    fraction = F.col("rate") - F.floor("rate")
    tried = by_source(sized.select("doc_id", "source", "size"), rates, n)
    sums = [F.sum(F.when(draw(s) < fraction, F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(seeds)]
    tried = tried.groupBy("source").agg(F.first("target").alias("target"), F.first("rate").alias("rate"), F.first("source_size").alias("source_size"), *sums)
    off = [F.struct(F.abs(F.floor("rate") * F.col("source_size") + F.col(f"s{s}") - F.col("target")).alias("off"), F.lit(s).alias("seed")) for s in range(seeds)]
    rates = table(tried.select("source", "source_size", "target", "rate", F.array_min(F.array(*off))["seed"].alias("seed")), "rates")
    out = by_source(sized, rates, n)
    copies = (F.floor("rate") + F.when(_draw_of("seed") < fraction, 1).otherwise(0)).cast("long")
    return out.select("row", "size", "source_size", "target", copies.alias("copies"))


def _draw_of(seed: str):
    """draw() with the seed in a column."""
    text = F.concat(F.floor(F.col(seed) / 4).cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), F.col(seed) % 4 * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def emitted(docs: DataFrame, most: float = 3.0) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as the mix takes it, with the columns of docs as they are.

    docs: doc_id, text, source and columns of any other names. Null texts and ids, repeated rows and empty tables are dealt
    with as in mixed_documents(); rows without words follow their source's rate too.
    """
    out = drawn(docs, most, SEEDS).where("copies > 0")
    return out.select("row", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")
