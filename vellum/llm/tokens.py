"""Token ids in ORC: integer run-length encoding, row indexes, and Bloom filters on document ids."""

from __future__ import annotations

import uuid
import zlib
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, kept, list_array, map_batches, pieces, shared_dir, table

STRIPE_BYTES = 64 << 20
ROWS_IN_INDEX = 10_000
#: Up to so many files, their offsets (16 bytes each) are sent to every executor; beyond, they are joined by key.
MOST_BROADCAST_FILES = 1_000_000


#: A word that ends in marks which the tokenizer never joins with the ASCII letter or digit before them.
MARKED = r"(?s)^(?P<stem>.*?[a-z0-9])(?P<marks>[.,!?;:*$&%#]+)$"
#: How byte-level models spell a byte: printable Latin-1 as it is, the others from 256 on.
_SPELLED = {}
for _b in range(256):
    _SPELLED[_b] = chr(_b) if 33 <= _b <= 126 or 161 <= _b <= 172 or 174 <= _b else chr(256 + sum(c > 255 for c in map(ord, _SPELLED.values())))
_SPELLING = str.maketrans({chr(k): v for k, v in _SPELLED.items()})


def plain(piece: str) -> bool:
    """Small Latin letters alone, composed: neither the normalizer nor the pre-tokenizer changes or splits them."""
    return piece.isalpha() and max(piece) < "\u0250" and piece == piece.lower() and is_normalized("NFC", piece)


class Encoder:
    """Token ids of whole texts, by way of their distinct words.

    The tokenizer splits at ASCII blanks before anything else, and neither its normalizer nor its
    merges reach across them, so a text's ids are those of its words, one after the other. Words
    are lower-cased there too, and marks after a letter are a piece of their own, so that the
    tokenizer need only encode distinct stems and marks; plain() ones go to its model directly. Words are split, told apart and
    put together again by Arrow. A worker keeps the ids of up to `most` pieces and then starts anew.
    """

    def __init__(self, path: str, most: int = 500_000):
        self.path, self.most, self.tokenizer, self.known = path, most, None, None

    def _learn(self, pieces: list[str]) -> None:
        found: list[list[int]] = []
        odd = []
        for k, piece in enumerate(pieces):
            if plain(piece):
                spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SPELLING)
                found.append([t.id for t in self.model.tokenize(spelled)])
            else:
                found.append([])
                odd.append(k)
        for a in range(0, len(odd), 5000):
            some = odd[a : a + 5000]
            for k, ids in zip(some, self._whole([pieces[k] for k in some])):
                found[k] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))])
        self.size = np.concatenate([self.size, sizes])
        self.first = np.cumsum(self.size) - self.size

    def _whole(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by the whole tokenizer."""
        joined = " ".join(words)
        got = self.tokenizer.encode(joined, add_special_tokens=False)
        # Offsets count characters; a word begins at the start and after each blank.
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        cuts = np.searchsorted(np.array([o[0] for o in got.offsets], np.int64), starts).tolist()
        ids = got.ids
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _numbers(self, pieces: pa.StringArray) -> np.ndarray:
        """Numbers of pieces, new ones learned."""
        coded = pieces.dictionary_encode()
        names, known = coded.dictionary.to_pylist(), self.known
        new = [x for x in names if x not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self._learn(new)
        return np.fromiter(map(known.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.model = self.tokenizer.model
        if self.known is None or len(self.known) > self.most:
            self.known, self.flat, self.size, self.first = {"": 0}, np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = pc.list_flatten(split).dictionary_encode()
        words = coded.dictionary
        low = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))  # special tokens are told by case
        cut = pc.extract_regex(low, MARKED)
        stems = pc.coalesce(pc.struct_field(cut, "stem"), low)
        marks = pc.fill_null(pc.struct_field(cut, "marks"), "")
        both = np.stack([self._numbers(stems), self._numbers(marks)], axis=1).ravel()
        size = self.size[both]
        ends = np.cumsum(size)
        values = self.flat[np.repeat(self.first[both] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        lists = list_array(values, size[0::2] + size[1::2], pa.int32()).take(coded.indices)
        bounds = lists.offsets.to_numpy()[split.offsets.to_numpy() - split.offsets[0].as_py()].astype(np.int64)
        return lists.values.to_numpy()[bounds[0] : bounds[-1]], np.diff(bounds)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Writes docs (doc_id, text; other columns are ignored) as ORC files at path, in ascending order of doc_id.

    A row has doc_id, ids (the text's, then end_id), n_tokens, and first: the ids before it in its
    file. Files cover ranges of ids in the order of their names. A null text is empty; rows without a
    doc_id come first; rows that repeat a doc_id are written each, ordered by a hash of the text.
    An empty table gives files without rows.
    """

    def run(batches):
        encode = kept(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        first = 0
        for batch in pieces(batches, 2048):
            ids, counts = encode(batch.column(1).cast(pa.string()))
            ends = np.cumsum(counts)
            ids, counts = np.insert(ids, ends, end_id), counts + 1
            before = first + np.concatenate([[0], np.cumsum(counts)])
            first = int(before[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before[:-1]), pa.array(counts), list_array(ids, counts, pa.int32())], ["doc_id", "first", "n_tokens", "ids"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    out = map_batches(rows, run, "doc_id long, first long, n_tokens long, ids array<int>")
    options = {"compression": "zstd", "orc.stripe.size": STRIPE_BYTES, "orc.create.index": "true", "orc.row.index.stride": ROWS_IN_INDEX, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01}
    out.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, first, n_tokens, ids) of files of write_tokens(). Files are read in parallel by stripe; a filter on doc_id is pushed down to stripes and row groups."""
    return spark.read.schema("doc_id long, first long, n_tokens long, ids array<int>").orc(path)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files that write_tokens() wrote at path, from the ids themselves.

    A row for each row of the files; rows without a doc_id come with a null one. Files without rows give none.
    """

    def run(batches):
        kept("digests", lambda: None)  # the encoder is done
        for batch in batches:
            ids = batch.column(2)
            offsets = ids.offsets.to_numpy()
            data = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
            view = memoryview(data).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64()), batch.column(3)], ["doc_id", "first", "n_tokens", "ids_crc32", "file"])

    rows = read_tokens(spark, path)
    # The number of the writer's partition; a file for each.
    named = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("long").alias("file")
    files = rows.select(named, F.col("first") + F.col("n_tokens")).toDF("file", "end").groupBy("file").agg(F.max("end").alias("ids"))
    # A row for each file.
    files = table(files.select("file", (F.sum("ids").over(Window.orderBy("file")) - F.col("ids")).alias("offset")), "files")
    files = F.broadcast(files) if files.count() <= MOST_BROADCAST_FILES else files
    out = map_batches(rows.select("doc_id", "first", "ids", named), run, "doc_id long, first long, n_tokens long, ids_crc32 long, file long")
    return out.join(files, "file").select("doc_id", (F.col("offset") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes docs to a new folder in the shared one, and reads the digests back: a row for each row of docs, see write_tokens()."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vellum-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return token_digests(spark, path)
