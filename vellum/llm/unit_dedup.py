"""Substring dedup by hashed units: repeated lines, and repeated sentences within lines."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pieces, table

#: A sentence ends at its marks before a blank; the rest of the line ends the last one.
_SENTENCE = re.compile(r"[^.!?]*(?:[.!?]+(?![ \t])[^.!?]+)*(?:[.!?]+[ \t]*|$)")
#: Words that a unit of sentences has at least (or six times as many bytes, where blanks are rare); shorter sentences are joined.
MIN_WORDS = 10
#: Bytes of the shortest line that is a unit.
MIN_BYTES = 19


def units_of(text: str, least: int) -> list[tuple[int, int, int, bytes]]:
    """(line start, start, end, normalised unit) of the lines, and of the sentences of lines with several.

    Normalised: A-Z lower-cased, words joined by single blanks. Lines of under MIN_BYTES are left out. From each
    sentence on, and up to each, the fewest neighbours are joined that make `least` words, so that units
    of a passage are the same wherever it stands. A line's own unit comes before those of its sentences.
    """
    out, at = [], 0
    for line in text.split("\n"):
        words = line.encode().lower().split()
        whole = b" ".join(words)
        if len(whole) >= MIN_BYTES:
            out.append((at, at, at + len(line), whole))
            cuts = [m.span() for m in _SENTENCE.finditer(line) if m.end() > m.start()]
            if len(cuts) > 1:
                parts = [line[a:b].encode().lower().split() for a, b in cuts]
                counts, sizes = [len(p) for p in parts], [sum(map(len, p)) + len(p) for p in parts]
                spans = {}
                for step in (1, -1):
                    for i in range(len(cuts)):
                        j, n, size = i, 0, 0
                        while 0 <= j < len(cuts) and n < least and size <= 6 * least:
                            n, size, j = n + counts[j], size + sizes[j], j + step
                        if n >= least or size > 6 * least:
                            spans[min(i, j - step), max(i, j - step)] = True
                for i, j in spans:
                    if j - i + 1 < len(cuts):
                        out.append((at, at + cuts[i][0], at + cuts[j][1], b" ".join(w for p in parts[i : j + 1] for w in p)))
        at += len(line) + 1
    return out


def units(docs: DataFrame, least: int) -> DataFrame:
    def run(batches):
        for batch in pieces(batches):
            ids, hashes, rows, whole = [], [], [], []
            for i, t, h in zip(*(batch.column(j).to_pylist() for j in range(3))):
                if i is not None and t:
                    got = units_of(t, least)
                    ids += [i] * len(got)
                    hashes += [h] * len(got)
                    rows += got
                    whole += [k == 0 or r[0] != got[k - 1][0] for k, r in enumerate(got)]
            digests = [xxhash.xxh3_128_digest(r[3]) for r in rows]
            pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            cols = [np.array([r[j] for r in rows], np.int64) for j in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), *map(pa.array, cols), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(whole, pa.bool_())], ["doc_id", "h", "line", "start", "end", "d1", "d2", "whole"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")), run, "doc_id long, h long, line long, start long, end long, d1 long, d2 long, whole boolean")


def repeats(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, h, start, end, first_doc_id, first_start) of each unit to remove; h, a hash of the text, tells rows of one doc_id apart."""
    found = table(units(docs, least), "units")
    place = F.struct("doc_id", "start", "h")
    groups = found.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("d1", "d2", "first")
    gone = found.join(groups.hint("merge"), ["d1", "d2"]).where(place != F.col("first"))
    gone = table(gone.select("doc_id", "h", "line", "start", "end", "whole", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start")), "repeats")
    lines = gone.where("whole").select("doc_id", "h", "line", F.col("end").alias("covered")).distinct()
    out = gone.join(lines, ["doc_id", "h", "line"], "left").where("whole or covered is null or end > covered")
    return out.select("doc_id", "h", "start", "end", "first_doc_id", "first_start").distinct()


def repeated_units(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, end, first_doc_id, first_start) of each unit to remove.

    Units are hashed to 128 bits and grouped over all documents; the occurrence with the lowest
    (doc_id, start) stays. Offsets are code points of the original text, end exclusive. A
    sentence of a removed line is not listed again; the spans of joined sentences overlap. docs: doc_id and text; other columns are
    ignored. Null or empty texts and rows without a doc_id have no units. Rows that repeat a
    doc_id and text are the same occurrence, and none is removed for the other; rows of one doc_id with different texts
    are different occurrences. An empty table gives an empty table.
    """
    return repeats(docs, least).select("doc_id", "start", "end", "first_doc_id", "first_start").distinct()


def without_repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs with `text` cut to what repeated_units() leaves, and `removed`: array of (start, end) in the original; null if nothing is.

    docs: doc_id, text and any other columns; one named removed is replaced. Rows without a doc_id, and null or empty texts, stay as
    they are. Rows that repeat a doc_id are cut each by the spans of its own text. An empty table gives an empty table.
    """
    spans = repeats(docs, least).groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed")).toDF("id", "h", "removed")
    names = [c for c in docs.columns if c != "removed"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("h"))
    out = rows.join(spans, ["id", "h"], "left")
    left = F.expr("""aggregate(removed, struct(0L as at, '' as kept),
        (s, r) -> struct(greatest(s.at, r.end) as at, s.kept || substring(text, cast(s.at + 1 as int), cast(greatest(r.start - s.at, 0L) as int)) as kept),
        s -> s.kept || substring(text, cast(s.at + 1 as int)))""")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(left)
    return out.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in names], "removed")
