"""Queries of operators that need functions beyond SQL, or state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences, text
from ..operators import frequency, graph
from ..sources import read
from ..streaming import records
from .rules import ACCENTED, PLAIN

#: Dictionaries of up to so many words go to every worker; larger ones are an error, as segmenting needs them whole.
MOST_WORDS = 1_000_000


def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.counts(frequency.words(read(spark, sf_dir, "documents").select("text")), "word")


def accent_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with letters beyond ASCII, and their folded spelling."""
    words = distinct_words(spark, sf_dir).where(F.octet_length("word") > F.length("word"))
    return words.select("word", text.arrow_column(lambda s: text.fold_accents(s or ""), "string", "word").alias("folded"), "n")


def search_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What search compares of each word."""
    return distinct_words(spark, sf_dir).select("word", text.arrow_column(text.search_key, "string", "word").alias("search_key"))


def dictionary(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    words = frequency.words(read(spark, sf_dir, "benchmark").select("text")).select("word").distinct().limit(MOST_WORDS + 1).collect()
    if len(words) > MOST_WORDS:
        raise ValueError(f"the dictionary has over {MOST_WORDS} words")
    return {r["word"]: 0 for r in words}


def segmented_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users' turns with their blanks taken out, cut into words of the benchmark again."""
    kinds = spark.sparkContext.broadcast(dictionary(spark, sf_dir))

    def cut(s: str | None) -> list[str]:
        return [piece for piece, _ in sequences.segmented("".join((s or "").lower().split()), kinds.value)]

    turns = read(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", text.arrow_column(cut, "array<string>", "text").alias("pieces"))


def heard_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a conversation's turns are only heard, at its first and second attempt."""
    n = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))

    def at(attempt: int):
        return text.arrow_column(lambda i, n: sequences.heard_questions(str(i), attempt, int(n)), "array<int>", "conv_id", "n")

    return n.select("conv_id", "n", at(0).alias("first"), at(1).alias("second"))


def phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q08: fixed phrases in sentences, longer ones first, none across punctuation."""
    phrases = ("of the", "in the", "out of the", "de la", "a la", "in der", "auf die")

    def found(s: str | None) -> list[str]:
        import re

        tokens = [(t, not t[0].isalnum()) for t in re.findall(r"[^\W_]+|[^\w\s]", s or "")]
        return sequences.phrase_matches(tokens, phrases)[0] if any(p.split()[0] in (s or "").lower() for p in phrases) else []

    sentences = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"[.!?…\n]+")).alias("spos", "s")).where("trim(s) <> ''")
    rows = sentences.select("doc_id", "spos", F.explode(text.arrow_column(found, "array<string>", "s")).alias("phrase"))
    return rows.groupBy("phrase").agg(F.count("*").alias("sentences"), F.countDistinct("doc_id").alias("documents"))


#: Spellings of a word that are one for a reader: without marks, or with digraphs for German letters.
_LINKS = """
WITH v AS (SELECT DISTINCT word FROM {words}), k AS (SELECT word, translate(word, '{accented}', '{plain}') AS f, replace(replace(replace(replace(word, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS d FROM v)
SELECT k.word AS a, v.word AS b FROM k JOIN v ON k.f = v.word AND k.word <> v.word UNION SELECT k.word, v.word FROM k JOIN v ON k.d = v.word AND k.word <> v.word"""


def word_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that links of spelling connect, with the least of each group."""
    sql = _LINKS.replace("{accented}", ACCENTED).replace("{plain}", PLAIN)
    return graph.groups(spark.sql(sql, words=distinct_words(spark, sf_dir).select("word"))).select(F.col("item").alias("word"), F.col("root").alias("first_word"))


def text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of either direction in each turn of a conversation."""
    runs = text.arrow_column(lambda s: len(text.rtl_runs(s)), "long", "text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", runs.alias("runs"))


def streamed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST01 as a stream over the events, caught up."""
    source = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    reviews = source.select("user_id", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"), (F.col("event_type") != "error").alias("ok"), F.lit(False).alias("prov"), "ts", "event_id")
    return records.caught_up_records(reviews).select("user_id", "k", "r", "w", "s")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (accent_folds, search_keys, segmented_items, heard_questions, phrase_counts, word_groups, text_runs, streamed_records)}


_WORDS = r"(SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\pL+')) AS word FROM documents) GROUP BY word)"


def oracle_sql() -> dict[str, str]:
    links = _LINKS.replace("{accented}", ACCENTED).replace("{plain}", PLAIN).replace("{words}", _WORDS)
    return {
        "word_groups": f"""
WITH RECURSIVE l AS ({links}), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(word, g) AS (SELECT a, a FROM e UNION SELECT e.b, r.g FROM r JOIN e ON r.word = e.a)
SELECT word, min(g) AS first_word FROM r GROUP BY word""",
        "accent_folds": f"SELECT word, strip_accents(word) AS folded, n FROM {_WORDS} WHERE strlen(word) > length(word)",
        "search_keys": f"SELECT word, strip_accents(replace(replace(replace(word, 'ñ', 'nn'), 'ã', 'an'), 'õ', 'on')) AS search_key FROM {_WORDS}",
        "streamed_records": """
WITH v AS (SELECT event_id, ts, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type <> 'error' AS ok FROM events),
e AS (SELECT user_id, k, ok, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS i FROM v)
SELECT user_id, k, count(*) FILTER (ok) AS r, count(*) FILTER (NOT ok) AS w, CAST(max(i) - coalesce(max(CASE WHEN NOT ok THEN i END), 0) AS BIGINT) AS s FROM e GROUP BY user_id, k""",
    }
