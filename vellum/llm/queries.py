"""The queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_cnn, decontaminate, fuzzy_lines, mixing, near_dedup, pii, quality_rules, tokens, toxicity, unit_dedup
from .common import read

END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, see toxicity.toxicity_scores(): null and empty texts score as the bias does, and repeated rows give a row each."""
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), 0.3, (4, 2))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, see near_dedup.near_duplicates(): documents without words are in none, and repeated rows give a row each."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), 3, 85)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines and sentences of all documents, see unit_dedup.repeated_units(): null and empty texts have none, and a row that repeats another none for that."""
    return unit_dedup.repeated_units(read(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, see pii.personal_data(): null and empty texts have none, and repeated rows give a row each."""
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of the token ids of all documents, see tokens.encoded(): null texts are empty, and repeated rows are written each."""
    return tokens.encoded(read(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and words taken of all documents, see mixing.mixed_documents(): null texts have a size of 0, and a null source is one of its own."""
    return mixing.mixed_documents(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, see byte_cnn.quality_scores(): null texts score as empty ones, and repeated rows give a row each."""
    return byte_cnn.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), 0.5, (3, 1))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that repeat others fuzzily, see fuzzy_lines.fuzzy_line_dedup(): null and empty texts have no lines."""
    return fuzzy_lines.fuzzy_line_dedup(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents, see quality_rules.quality_rules(): null texts count as empty, and repeated rows are measured each."""
    out = quality_rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of benchmark items in all documents, see decontaminate.contaminations(): null and empty texts and items match nothing."""
    return decontaminate.contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of corpus_pipeline.run()."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_toxicity, op2_near_dedup, op3_substring_dedup, op4_pii, op5_tokens, op6_mixing, op7_quality, op8_line_dedup, op9_quality_rules, op10_decontamination, pipeline)
    return {f.__name__: f for f in ops}


_DRAW = "CAST('0x' || substr(md5(CAST({seed} // 4 AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), CAST({seed} % 4 * 8 + 1 AS INT), 8) AS BIGINT) / 4294967296.0"

OP6_SQL = f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3.0::DOUBLE AS cap FROM per),
run AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS cap0, coalesce(sum(weight) OVER w, 0) AS weight0, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, (total - cap0) * weight >= cap * (weights - weight0) AS capped FROM run),
targets AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE
  (total - coalesce(sum(cap) FILTER (capped) OVER (), 0))::DOUBLE * weight / (weights - coalesce(sum(weight) FILTER (capped) OVER (), 0)) END AS target FROM capped),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM targets),
tried AS (SELECT d.source, s.seed, abs(any_value(floor(rate) * r.source_size - target) + sum(CASE WHEN {_DRAW.format(seed="s.seed")} < rate - floor(rate) THEN size ELSE 0 END)) AS off
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN (SELECT unnest(range({mixing.SEEDS})) AS seed) s GROUP BY d.source, s.seed),
best AS (SELECT source, seed FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, seed) = 1)
SELECT doc_id, size, r.source_size, target, (size * (floor(rate) + CASE WHEN {_DRAW.format(seed="seed")} < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source JOIN best b ON d.source IS NOT DISTINCT FROM b.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": OP6_SQL}
