"""Quality classifier: a byte-level convolutional network in numpy.

A filter has a learned weight for each byte value at each of WIDTH places (a convolution over
one-hot bytes), so that applying it is a sum of table look-ups. Filters run over the
whole document; their outputs are max-pooled in overlapping chunks of SPAN blocks, every
CHUNK blocks, and the chunk maxima combined, by their maximum and mean, into one probability.
A blank before a word whose next eight bytes stood at an earlier word of the document is told
apart (code 1), so that filters see repetition; this input is made by hand, the filters over it are learned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, drop_table, map_batches, pieces, table, texts_of

WIDTH, FILTERS, STRIDE = 6, 8, 2
BLOCK, SPAN, CHUNK = 64, 4, 3
#: Labelled rows, and bytes of them all together, that training may use.
TRAIN_ROWS, TRAIN_BYTES = 1600, 32 << 20
#: Places whose outputs are held at once, a multiple of BLOCK; pooling goes on across such pieces.
PIECE = BLOCK << 10


def codes(text: bytes) -> np.ndarray:
    """Bytes, with marked blanks, and blanks appended up to one filter's width."""
    data = np.frombuffer(text + b" " * max(0, WIDTH + STRIDE - len(text)), np.uint8).copy()
    if len(data) > 9:
        starts = np.nonzero(data[:-9] == 32)[0]
        if len(starts) > 1:
            seen = np.zeros(len(starts), np.uint64)
            for j in range(1, 9):
                seen = (seen << np.uint64(8)) | data[starts + j].astype(np.uint64)
            order = np.argsort(seen, kind="stable")
            again = order[1:][seen[order[1:]] == seen[order[:-1]]]
            data[starts[again]] = 1
    return data


def conv(tables: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Outputs of the filters at every STRIDE-th place."""
    n = (len(data) - WIDTH) // STRIDE + 1
    out = tables[0].take(data[0 : STRIDE * n : STRIDE], axis=0)
    for j in range(1, WIDTH):
        out += tables[j].take(data[j : j + STRIDE * n : STRIDE], axis=0)
    return out


def chunk_bounds(n: int) -> list[tuple[int, int]]:
    """First and last block of each chunk over n places."""
    blocks = -(-n // BLOCK)
    return [(a, min(a + SPAN, blocks)) for a in range(0, max(1, blocks - SPAN + CHUNK), CHUNK) if a < blocks]


class Net:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {"tables": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), "w": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "b": np.zeros(1, np.float32)}

    def pooled(self, data: np.ndarray, where: bool = False):
        """Chunk maxima (chunks x FILTERS) and, for training, the places they come from."""
        n = (len(data) - WIDTH) // STRIDE + 1
        blocks, places = [], []
        for a in range(0, n, PIECE):
            out = conv(self.p["tables"], data[a * STRIDE : (min(n, a + PIECE) - 1) * STRIDE + WIDTH])
            starts = np.arange(0, len(out), BLOCK)
            blocks.append(np.maximum.reduceat(out, starts, axis=0))
            if where:
                places += [out[b : b + BLOCK].argmax(axis=0) + a + b for b in starts]
        top, bounds = np.concatenate(blocks), chunk_bounds(n)
        if where:
            rows, places = np.arange(FILTERS), np.array(places)
            places = np.array([places[a + top[a:b].argmax(axis=0), rows] for a, b in bounds])
        cuts = np.array(bounds).ravel()
        top = np.maximum.reduceat(top, cuts[: len(cuts) - (cuts[-1] == len(top))], axis=0)[::2]
        return (top, places) if where else top

    def features(self, text: bytes) -> np.ndarray:
        top = np.tanh(self.pooled(codes(text)))
        return np.concatenate([top.max(axis=0), top.mean(axis=0)])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts])
        return 1 / (1 + np.exp(-(x @ self.p["w"] + self.p["b"][0]).astype(np.float64)))

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.02, seed: int = 5) -> "Net":
        """Adam on the log loss, both classes of the same total weight. Gradients of a maximum go to its place."""
        if not len(texts):
            return self
        rng = np.random.default_rng(seed)
        rows = [codes(t) for t in texts]
        share = max(1e-3, min(1 - 1e-3, float(labels.mean())))
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                g = {k: np.zeros_like(x) for k, x in self.p.items()}
                some = order[at : at + batch]
                for i in some:
                    top, places = self.pooled(rows[i], True)
                    top = np.tanh(top)
                    best = top.argmax(axis=0)
                    x = np.concatenate([top[best, np.arange(FILTERS)], top.mean(axis=0)])
                    d = (1 / (1 + np.exp(-float(x @ self.p["w"] + self.p["b"][0]))) - labels[i]) * weight[i] / len(some)
                    g["w"] += d * x
                    g["b"] += d
                    back = np.tile(d * self.p["w"][FILTERS:] / len(top), (len(top), 1))
                    back[best, np.arange(FILTERS)] += d * self.p["w"][:FILTERS]
                    back *= 1 - top**2
                    for j in range(WIDTH):
                        np.add.at(g["tables"][j], (rows[i][places * STRIDE + j], np.broadcast_to(np.arange(FILTERS), places.shape)), back)
                step += 1
                now = rate * (1 - epoch / epochs)
                g["w"] += 1e-4 * self.p["w"]
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def sampled(docs: DataFrame, labels: DataFrame, label: str, held_out: tuple[int, int], rows: int, most: int) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels to learn from: at most rows / 2 of each class, the first by a hash of the id, none held out.

    held_out: (n, r) holds out the rows whose crc32(doc_id) mod n is r. Of those chosen, in the order of the hash, each
    that still fits into its class's `most` / 2 bytes is learned from, however long. Ids are chosen from the labels alone; they, at most
    `rows`, go to every executor, and they, their sizes and the texts that fit are all that comes to the driver.
    """
    known = labels.where(F.col(label).isin(0, 1) & (crc_mod("doc_id", held_out[0]) != held_out[1])).select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for y in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    texts = texts.join(F.broadcast(parts[0].union(parts[1])), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    found = table(texts, "labelled")
    used, fits = [0, 0], []
    for r in found.select("doc_id", "y", F.octet_length("text").alias("bytes"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect():
        if used[r["y"]] + r["bytes"] <= most // 2:
            used[r["y"]] += r["bytes"]
            fits.append(r["doc_id"])
    got = found.where(F.col("doc_id").isin(fits)).collect()
    drop_table(found)
    got.sort(key=lambda r: (r["y"], r["doc_id"]))
    return [r["text"].encode() for r in got], np.array([r["y"] for r in got], np.float64)


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.5, held_out: tuple[int, int] = (3, 1)) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs, from its whole text alone.

    docs: doc_id and text; other columns are ignored. labels: doc_id and quality, 1 for good. The net
    is trained on the driver on at most TRAIN_ROWS labelled rows that aren't held out. Null texts
    score as empty ones; rows without a doc_id are scored too and not held out; rows that repeat a
    doc_id are scored each. Without labels the untrained net scores.
    """
    net = Net().train(*sampled(docs, labels, "quality", held_out, TRAIN_ROWS, TRAIN_BYTES))

    def run(batches):
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.scores(texts_of(batch.column(1))), pa.float64())], ["doc_id", "score"])

    out = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")
    held = F.coalesce(crc_mod("doc_id", held_out[0]) == held_out[1], F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
