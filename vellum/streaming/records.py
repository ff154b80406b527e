"""ST01 as a stream: the record of each item, folded as reviews arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ranking import shared_dir
from ..operators.workers import importable

#: A provisional item is known after so many right answers in a row.
MASTERED = 3
SCHEMA = "user_id long, k long, r long, w long, s long, prov boolean, n long"


def folded(record: tuple[int, int, int, bool], answers: list[bool]) -> tuple[int, int, int, bool]:
    """A record (right, wrong, streak, provisional) after the answers."""
    r, w, s, prov = record
    for ok in answers:
        r, w, s = (r + 1, w, s + 1) if ok else (r, w + 1, 0)
        prov = prov and ok and s < MASTERED
    return r, w, s, prov


def known_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.where("user_id is not null and k is not null and ok is not null").select("user_id", "k", "ok", F.coalesce("prov", F.lit(False)).alias("prov"), "ts", "event_id")


def record_stream(reviews: DataFrame) -> DataFrame:
    """(user_id, k, r, w, s, prov, n) of each item that a batch has reviews of; n: reviews so far.

    reviews: a stream of user_id, k, ok, prov, ts and event_id. An item's first review says whether it
    began as provisional. Reviews of a batch are taken in the order of (ts, event_id), batches as they arrive: state
    holds four numbers an item, no reviews. Rows without a key or an answer are left out.
    """

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        *record, n = state.get if state.exists else (0, 0, 0, bool(batch["prov"].iloc[0]), 0)
        record = folded(tuple(record), batch["ok"].tolist())
        state.update((*record, n + len(batch)))
        yield pd.DataFrame([(*key, *record, n + len(batch))], columns=["user_id", "k", "r", "w", "s", "prov", "n"])

    importable(reviews.sparkSession)
    return known_reviews(reviews).groupBy("user_id", "k").applyInPandasWithState(run, SCHEMA, "r long, w long, s long, prov boolean, n long", "update", GroupStateTimeout.NoTimeout)


def folded_batch(known: DataFrame) -> DataFrame:
    """(user_id, k, r, w, s, first, n) of each item of a batch's known_reviews(): its record from (0, 0, 0), and what its first review says of prov."""
    order = Window.partitionBy("user_id", "k").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    rows = known.withColumn("i", F.row_number().over(order).cast("long"))
    wrong = F.coalesce(F.max(F.when(~F.col("ok"), F.col("i"))), F.lit(0))
    return rows.groupBy("user_id", "k").agg(F.count_if("ok").alias("r"), F.count_if(~F.col("ok")).alias("w"), (F.count("*") - wrong).alias("s"), F.max(F.when(F.col("i") == 1, F.col("prov"))).alias("first"), F.count("*").alias("n"))


def caught_up_records(reviews: DataFrame) -> DataFrame:
    """What caught_up(record_stream(reviews)) gives, without a call of Python for each item.

    Each batch's reviews are folded by themselves as they arrive, into a row for each item that it has reviews of; the rows of batches are put together in their
    order: right and wrong answers add up, a streak goes on through batches without a wrong answer, and an item stays provisional
    until a wrong answer or MASTERED right ones.
    """
    rows = drained(known_reviews(reviews), folded_batch, "append", "user_id long, k long, r long, w long, s long, first boolean, n long")
    last = F.max(F.when(F.col("w") > 0, F.col("batch"))).over(Window.partitionBy("user_id", "k"))
    rows = rows.withColumn("last", F.coalesce(last, F.lit(-1)))
    r, w = F.sum("r"), F.sum("w")
    streak = F.sum(F.when(F.col("batch") >= F.col("last"), F.col("s")).otherwise(0))
    prov = F.min_by("first", "batch") & (w == 0) & (r < MASTERED)
    return rows.groupBy("user_id", "k").agg(r.alias("r"), w.alias("w"), streak.alias("s"), prov.alias("prov"), F.sum("n").alias("n"))


def caught_up(stream: DataFrame) -> DataFrame:
    """Runs record_stream() over all that its source holds, and gives the last record of each item, from files in the shared folder."""
    rows = drained(stream, lambda batch: batch, "update", SCHEMA)
    last = F.max_by(F.struct("r", "w", "s", "prov", "n"), "batch").alias("x")
    return rows.groupBy("user_id", "k").agg(last).select("user_id", "k", "x.*")


def drained(stream: DataFrame, fold: Callable[[DataFrame], DataFrame], mode: str, schema: str) -> DataFrame:
    """fold() of each batch of all that the stream's source holds, and the number of its batch, from files in the shared folder."""
    spark = stream.sparkSession
    top = f"{shared_dir(spark).rstrip('/')}/vellum-stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, n: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{top}/rows/batch={n}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{top}/state").foreachBatch(save).start()
    query.awaitTermination()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(hadoop)
    if not files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{top}/rows")):
        return spark.createDataFrame([], schema + ", batch int")
    return spark.read.schema(schema + ", batch int").parquet(f"{top}/rows")
