"""Helpers the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: A word is a run of bytes other than the ASCII blanks; the same class for Java regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one, but only if Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="vellum-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def table(df: DataFrame, label: str) -> DataFrame:
    """df as a written table: it cuts lineage, is computed once and survives lost executors. Deleted as the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vellum-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes what table() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/vellum-" in top:
            hadoop = jvm.org.apache.hadoop.fs.Path(top)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def free_shuffles(spark: SparkSession, large: bool = False) -> None:
    """Lets Spark delete the shuffle files of finished queries now: its cleaner acts as the driver's garbage is collected. Of large
    ones twice, with time for it: what the end of a query still refers to goes the second time."""
    for _ in range(1 + large):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1.5 * large)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose workers can import this package, wherever the driver was started."""
    env = df.sparkSession.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return df.mapInArrow(f, schema)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds what a worker holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text is an empty one."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


class WordHashes:
    """64-bit hashes of words. A worker's memory of them is emptied when it has grown to `most`."""

    def __init__(self, most: int = 300_000):
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            digest = xxhash.xxh3_64_intdigest
            for w in words:
                if w not in known:
                    known[w] = digest(w)
            return np.array([known[w] for w in words], np.uint64)


_KEPT: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What a worker keeps from task to task under this name. It keeps one thing: workers go from operator to operator, and
    what another one left is dropped first, and its memory given back to the system."""
    if name not in _KEPT:
        _KEPT.clear()
        gc.collect()
        give_back()
        _KEPT[name] = make()
    return _KEPT[name]


def give_back() -> None:
    """Returns what the allocators hold of freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatters the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for each k hashes in a row."""
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - k + 1 + j]
    return mixed(out)


def crc_mod(column: str, n: int):
    """crc32 of an id written as text, mod n: how rows are held out."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
