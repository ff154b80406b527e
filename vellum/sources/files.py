"""Readers and writers of the file formats around the tables."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from ..operators.workers import importable

#: A file's part that its writers leave alone, between these lines.
MANUAL = ("<!-- manual -->", "<!-- /manual -->")


def frequency_list(spark: SparkSession, path: str) -> DataFrame:
    """(word, n) of lines with exactly a word and a count between blanks; other lines are left out."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("v")).where((F.size("v") == 2) & F.col("v")[1].rlike("^[0-9]+$"))
    return parts.select(F.col("v")[0].alias("word"), F.col("v")[1].cast("long").alias("n"))


def zipf_counts(listed: DataFrame, most: int = 30_000) -> DataFrame:
    """(word, zipf, n) of the first `most` words by zipf score; n is the count in a thousand million that the score stands for."""
    top = listed.orderBy(F.col("zipf").desc(), "word").limit(most)
    return top.select("word", "zipf", F.pow(F.lit(10.0), "zipf").alias("n"))


def archive_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(value) lines of the archives' members whose names end in `member`; a plain file is read as it is.

    An archive is read by one task, as a stream: tar files compressed whole cannot be split.
    """
    import tarfile

    if not re.search(r"\.(tar|tgz|tar\.(bz2|gz|xz))$", path):
        return spark.read.text(path)

    def run(batches):
        import io

        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0).to_pylist():
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for found in tar:
                        if found.isfile() and found.name.endswith(member):
                            lines = []
                            for line in tar.extractfile(found):
                                lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
                                if len(lines) == 10_000:
                                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
                                    lines = []
                            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    importable(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")


def tagged_schema() -> str:
    return "sid long, tokens array<struct<text:string,lemma:string,upos:string,morph:string>>"


def write_tagged(sentences: DataFrame, path: str) -> None:
    """Sentences (sid, tokens) as gzipped lines of JSON arrays: the id, then the tokens, each an array."""
    token = F.transform("tokens", lambda t: F.array(t["text"], t["lemma"], t["upos"], t["morph"]))
    line = F.concat(F.lit("["), F.col("sid").cast("string"), F.lit(","), F.to_json(token, {"ignoreNullFields": "false"}), F.lit("]"))
    sentences.select(line.alias("value")).write.option("compression", "gzip").text(path)


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """(sid, tokens) of what write_tagged() wrote; lines that are none are left out."""
    parts = spark.read.text(path).select(F.regexp_extract("value", r"^\[(-?[0-9]+),(.*)\]$", 1).alias("sid"), F.regexp_extract("value", r"^\[(-?[0-9]+),(.*)\]$", 2).alias("t"))
    rows = parts.where("sid <> ''").select(F.col("sid").cast("long").alias("sid"), F.from_json("t", "array<array<string>>").alias("t"))
    token = F.transform("t", lambda x: F.struct(x[0].alias("text"), x[1].alias("lemma"), x[2].alias("upos"), x[3].alias("morph")))
    return rows.where("t is not null").select("sid", token.alias("tokens"))


def sorted_json(value: object, compact: bool = True) -> str:
    """JSON with sorted keys and a newline at its end."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, **({"separators": (",", ":")} if compact else {"indent": 2}))
    return text + "\n"


def js_constant(name: str, value: object) -> str:
    """A script that defines a constant; a closing tag inside it can't end the page's script."""
    return f"const {name}={sorted_json(value)[:-1].replace('</', '<' + chr(92) + '/')};\n"


def constant_of(script: str, name: str) -> object:
    """The value of a constant in a generated script; KeyError if there is none."""
    found = re.search(rf"(?m)^const {re.escape(name)}\s*=\s*", script)
    if not found:
        raise KeyError(name)
    return json.JSONDecoder().raw_decode(script, found.end())[0]


def write_if_changed(path: Path, text: str, check: bool = False) -> bool:
    """Whether the file differs from text; writes it then, unless it is only checked."""
    stale = not path.exists() or path.read_text(encoding="utf-8") != text
    if stale and not check:
        path.write_text(text, encoding="utf-8")
    return stale


def with_manual_part(report: str, before: str | None) -> str:
    """A report whose part between the markers is that of the one before it; the markers are added if it has none."""
    if MANUAL[0] not in report:
        report = report.rstrip("\n") + f"\n\n{MANUAL[0]}\n{MANUAL[1]}\n"
    if before and MANUAL[0] in before and MANUAL[1] in before:
        kept = before[before.index(MANUAL[0]) : before.index(MANUAL[1])]
        a, b = report.index(MANUAL[0]), report.index(MANUAL[1])
        report = report[:a] + kept + report[b:]
    return report


def built_page(template: str, sections: dict[str, str]) -> str:
    """A template whose marked sections hold the given text: <!-- name --> ... <!-- /name -->. A section without markers is an error."""
    for name, text in sections.items():
        pattern = re.compile(rf"(<!-- {re.escape(name)} -->\n).*?(<!-- /{re.escape(name)} -->)", re.S)
        if not pattern.search(template):
            raise ValueError(f"no section {name}")
        template = pattern.sub(lambda m, t=text: m[1] + t.rstrip("\n") + "\n" + m[2], template)
    return template


def without_fields(value: object, names: frozenset[str]) -> object:
    """Nested JSON without the fields of these names, at any depth."""
    if isinstance(value, dict):
        return {k: without_fields(v, names) for k, v in value.items() if k not in names}
    return [without_fields(v, names) for v in value] if isinstance(value, list) else value


def pack_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A pack's files as tables: pack.json (one row), words.json and sentences.json (a row for each entry)."""
    schemas = {
        "pack": "key string, name string, levels array<struct<id:string,label:string>>, setSize int, functionWords array<string>, spaced boolean",
        "words": "id string, w string, en string, lv string, pos string, pron string, alt array<string>",
        "sentences": "id string, t string, en string, lv string, words array<string>",
    }
    return {name: spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{name}.json") for name, schema in schemas.items()}


def signature(*columns: str) -> Column:
    """The first 16 hexadecimal digits of the SHA-1 of columns, nulls told from empty texts."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.substring(F.sha1(F.concat_ws("\x1f", *parts).cast("binary")), 1, 16)


def extra_rows(spark: SparkSession, path: str, columns: list[str], first_id: int) -> DataFrame:
    """(id, then columns) of tab-separated lines, numbered from first_id in the order of the file. Lines of other widths are left out."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("v"), F.monotonically_increasing_id().alias("place")).where(F.size("v") == len(columns))
    rows = ranked(lines, "k", "place")
    return rows.select((F.col("k") + first_id - 1).alias("id"), *[F.col("v")[i].alias(c) for i, c in enumerate(columns)])


def with_extra_rows(corpus: DataFrame, extra: DataFrame) -> DataFrame:
    """A corpus and the rows that are added to it; an id that the corpus has already is an error."""
    clash = extra.join(corpus, "id", "left_semi").first()
    if clash is not None:
        raise ValueError(f"id {clash['id']} is in the corpus already")
    return corpus.unionByName(extra, allowMissingColumns=True)


def rewritten_json(text: str, change: dict[str, object]) -> str:
    """JSON text with the values of some top-level keys replaced and the rest, its layout too, left as it is. New keys are an error."""
    decoder = json.JSONDecoder()
    for key, value in change.items():
        place, depth, at = None, 0, 0
        while at < len(text):
            c = text[at]
            if c == '"':
                found, end = decoder.raw_decode(text, at)
                after = re.match(r"\s*:\s*", text[end:])
                if depth == 1 and after and found == key:
                    start = end + after.end()
                    place = (start, decoder.raw_decode(text, start)[1])
                    break
                at = end
                continue
            depth += (c in "{[") - (c in "}]")
            at += 1
        if place is None:
            raise KeyError(key)
        text = text[: place[0]] + json.dumps(value, ensure_ascii=False) + text[place[1] :]
    return text
