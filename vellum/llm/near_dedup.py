"""MinHash near-duplicates with odd sketches.

Each distinct shingle set gets `hashes` MinHash samples. Bands of `rows` samples are the
buckets. All samples are folded into a bitmap of parities (an odd sketch): sample i flips
one bit, so that the XOR of two sketches holds the samples in which two sets differ, and its
population count estimates the Jaccard similarity precisely where it is high. Bucket pairs
whose estimate lies more than `margin` under the threshold are let go; the others are
confirmed on full shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, kept, list_array, map_batches, mixed, pieces, table, texts_of, windows_hash
from .components import linked

BITS = 1024
#: Sets of up to so many shingles are compared within the join of the last candidates, larger ones after it.
SMALL_SET = 2048
#: Up to so many repeated ids (8 bytes each) are sent to every executor; beyond, Spark joins by key.
MOST_BROADCAST_IDS = 1_000_000


def shingle_set(text: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; of the whole sequence if shorter; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(windows_hash(hashes(words), min(k, len(words))))


def samples(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash samples of each set, a row each; long sets go through in blocks."""
    out = np.full((len(sets), len(a)), 0xFFFFFFFF, np.uint32)
    for i, s in enumerate(sets):
        low = (s >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(low), 2048):
            np.minimum(out[i], (a[:, None] * low[None, at : at + 2048] + b[:, None]).min(axis=1), out=out[i])
    return out


def odd_sketch(mh: np.ndarray) -> np.ndarray:
    """Parity bitmaps of BITS bits, as rows of int64."""
    n, k = mh.shape
    at = mixed((mh.astype(np.uint64) << np.uint64(16)) ^ np.arange(k, dtype=np.uint64)[None, :]) % np.uint64(BITS)
    flat = np.bincount((np.arange(n)[:, None] * BITS + at.astype(np.int64)).ravel(), minlength=n * BITS) & 1
    return np.packbits(flat.astype(np.uint8).reshape(n, BITS), axis=1).view(np.int64)


def most_bits(similarity: float, hashes: int, margin: float) -> int:
    """XOR population count of an odd sketch at an estimated similarity of `similarity - margin`."""
    low = max(0.0, similarity - margin)
    return math.ceil(BITS / 2 * (1 - math.exp(-4 * hashes * (1 - low) / BITS)))


def signatures(docs: DataFrame, k: int, bands: int, rows: int, hashes: int, seed: int = 7) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, sketch) of each row; digest, bands and sketch are null without shingles."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**31, hashes, dtype=np.int64).astype(np.uint32) * 2 + 1
    b = rng.integers(0, 2**32, hashes, dtype=np.int64).astype(np.uint32)

    def run(batches):
        known = kept("hashes", WordHashes)
        for batch in pieces(batches):
            sets = [shingle_set(t, k, known) for t in texts_of(batch.column(1))]
            some = [i for i, s in enumerate(sets) if len(s)]
            mh = samples([sets[i] for i in some], a, b)
            cut = mh[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
            key = np.tile(np.arange(bands, dtype=np.uint64), (len(some), 1))
            for j in range(rows):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, j])
            digest, has = [None] * len(sets), np.zeros(len(sets), np.int64)
            for i in some:
                digest[i], has[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), 1
            none = pa.array(has == 0)
            lists = [list_array(x.ravel(), has * n, pa.int64()) for x, n in ((key.view(np.int64), bands), (odd_sketch(mh), BITS // 64))] if some else [list_array(np.zeros(0, np.int64), has, pa.int64())] * 2
            lists = [pa.compute.if_else(none, pa.scalar(None, x.type), x) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), *lists], ["doc_id", "n_shingles", "digest", "bands", "sketch"])

    import pyarrow.compute  # noqa: F401  for pa.compute above

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, shingles, small) of each row; small: the distinct first halves of the hashes, of sets of up to SMALL_SET shingles."""

    def run(batches):
        known = kept("hashes", WordHashes)
        for batch in pieces(batches):
            sets = [shingle_set(t, k, known) for t in texts_of(batch.column(1))]
            small = pa.array([np.unique((s >> np.uint64(32)).astype(np.uint32)).view(np.int32) if len(s) <= SMALL_SET else None for s in sets], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]), pa.int64()), small], ["id", "shingles", "small"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "id long, shingles array<long>, small array<int>")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, hashes: int = 384, margin: float = 0.1) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs.

    docs: doc_id and text; other columns are ignored. Documents are linked when
    100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    smallest doc_id reachable, kept is doc_id = component_id. Null or empty texts have no
    shingles and no links. Rows without a doc_id get no component and stay kept. Rows
    that repeat a doc_id give a row each; with several texts under one doc_id, a link of any
    is a link of the id. An empty table gives an empty table.
    """
    sig = table(signatures(docs, k, bands, rows, hashes), "signatures")
    whole = sig.where("digest is not null and doc_id is not null")
    first = whole.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = whole.join(first.hint("merge"), "digest").where("doc_id = rep")
    spread = reps.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key"))
    shared = spread.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("key")
    buckets = table(spread.join(shared.hint("merge"), "key", "left_semi").select("key", "id", "band"), "buckets")
    wanted = buckets.select(F.col("id").alias("doc_id")).distinct()
    sketches = table(reps.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n_shingles", "sketch", F.col("bands").alias("keys")), "sketches")
    sets = table(full_sets(docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id", "left_semi"), k), "sets")

    allowed = most_bits(percent / 100, hashes, margin)

    def near(x: str, y: str):
        differ = sum((F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(BITS // 64)), F.lit(0))
        m, n = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
        return (F.least(m, n) * 100 >= F.greatest(m, n) * percent) & (differ <= allowed)

    def confirm(pairs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        s = sets.select(F.col("id").alias("a"), F.col("shingles").alias("p"))
        t = sets.select(F.col("id").alias("b"), F.col("shingles").alias("q"))
        both = pairs.join(s, "a").join(t, "b").withColumn("i", F.size(F.array_intersect("p", "q")))
        return both.where(F.col("i") * 100 >= (F.size("p") + F.size("q") - F.col("i")) * percent).select("a", "b"), []

    def possible(x: str, y: str):
        # Shared shingles are shared first halves, but for those of one set that fall together.
        most = F.size(F.array_intersect(f"{x}.small", f"{y}.small")) + F.col(f"{x}.n_shingles") - F.size(f"{x}.small")
        known = F.col(f"{x}.small").isNotNull() & F.col(f"{y}.small").isNotNull()
        return F.when(known, most * (100 + percent) >= (F.col(f"{x}.n_shingles") + F.col(f"{y}.n_shingles")) * percent).otherwise(True)

    comp, _ = linked(buckets, sketches, near, confirm, closer=(sets.select("id", "small"), possible))
    named = first.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    rows = sig.select("doc_id", "n_shingles", "digest")
    # Texts without shingles don't meet in the partition of the null key.
    out = rows.where("digest is not null").join(named.hint("merge"), "digest", "left").unionByName(rows.where("digest is null").withColumn("component_id", F.lit(None).cast("long")))
    known = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", known.alias("component_id"), F.col("doc_id").eqNullSafe(known).alias("kept"))


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each group of near copies.

    Groups are those of near_duplicates(), over rows: the row with the group's smallest doc_id stays. Rows without a doc_id, and rows that
    repeat one, are documents of their own, which count as later than all others; so of equal rows one stays. Null or
    empty texts, and texts without words, are in no group and all stay. An empty table gives an empty table.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    repeated = table(ids.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not repeated.isEmpty() or not ids.where("doc_id is null").isEmpty():
        # Such rows are written with numbers of their own; the others stay where they are.
        top = ids.agg(F.max("doc_id")).first()[0] or 0
        known = F.broadcast(repeated) if repeated.count() <= MOST_BROADCAST_IDS else repeated
        odd = rows.where("doc_id is null").unionByName(rows.join(known, "doc_id", "left_semi").select(*rows.columns))
        odd = table(odd.withColumn("doc_id", F.monotonically_increasing_id() + F.lit(top) + 1), "rows")
        rows = rows.where("doc_id is not null").join(known, "doc_id", "left_anti").select(*rows.columns).unionByName(odd)
    stay = near_duplicates(rows.select("doc_id", "text"), k, percent).where("kept").select("doc_id")
    return rows.join(stay, "doc_id", "left_semi").select("row.*")
