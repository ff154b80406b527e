"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel edit distance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_batches, pieces

RATE = 0.05
#: Benchmark text that one pass over the documents searches for; more text makes more passes.
BLOCK_BYTES = 8 << 20
_BLANK = np.ones(256, bool)
_BLANK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def folded(text: str) -> bytes:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.encode("utf-8", "replace")


def normalised(text: str) -> tuple[bytes, np.ndarray]:
    """Lower-cased UTF-8 with one blank for each run of ASCII characters other than letters and digits, and the place of each byte in folded(text)."""
    data = np.frombuffer(folded(text), np.uint8)
    blank = _BLANK[data]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    out = np.where(blank, 32, data)[keep].astype(np.uint8)
    return out.tobytes(), np.nonzero(keep)[0]


def distances(pattern: bytes, text: bytes) -> Iterator[int]:
    """For each end in text, 0 included: the least edit distance of pattern to a substring that ends there (Myers' bit-parallel columns)."""
    m = len(pattern)
    at: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        at[c] |= 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = mask, 0, m
    yield score
    for c in text:
        eq = at.get(c, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        up, down = minus | (mask & ~(d | plus)), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & mask, (down << 1) & mask
        plus, minus = down | (mask & ~(d | up)), up & d
        yield score


def best_match(pattern: bytes, text: bytes) -> tuple[int, int]:
    """(distance, end) of the substring of text nearest to pattern by edit distance; the leftmost end of several."""
    return min((d, j) for j, d in enumerate(distances(pattern, text)))


def occurrences(pattern: bytes, text: bytes, budget: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, distance) of the places within the budget that don't overlap, from the left.

    After the first end within the budget, the nearest of the ends up to 2 * budget further is taken, the
    leftmost of several; its start is the one nearest to it that gives the same distance. The search goes on at that end.
    """
    at = 0
    while at < len(text):
        best, last = None, 0
        for j, d in enumerate(distances(pattern, text[at:])):
            if best is None and d <= budget:
                best, last = (d, j), j + 2 * budget
            elif best is not None and d < best[0]:
                best = d, j
            if best is not None and (j >= last or not best[0]):
                break
        if best is None:
            return
        distance, end = best
        back = text[max(at, at + end - len(pattern) - budget) : at + end][::-1]
        _, size = best_match(pattern[::-1], back)
        if not size:
            return
        yield at + end - size, at + end, distance
        at += end


class Index:
    """Benchmark items cut into error-budget-plus-one pieces, in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.rate, self.automaton = [], rate, None
        for i, text in items:
            pattern = normalised(text)[0].strip()
            if pattern:
                self.items.append((i, pattern, int(len(pattern) * rate)))
        self.name = xxhash.xxh3_128_hexdigest(repr((rate, self.items)).encode())

    def build(self) -> Index:
        import ahocorasick

        where: dict[str, list] = defaultdict(list)
        for n, (_, pattern, budget) in enumerate(self.items):
            cuts = [len(pattern) * j // (budget + 1) for j in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    where[pattern[a:b].decode("latin-1")].append((n, a, b - a))
        a = ahocorasick.Automaton()
        for piece, places in where.items():
            a.add_word(piece, places)
        if where:
            a.make_automaton()
        self.automaton = a
        return self

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, distance): code points of the original text, end exclusive."""
        if not text or not len(self.automaton):
            return []
        data, place = normalised(text)
        hits = defaultdict(set)
        for end, places in self.automaton.iter(data.decode("latin-1")):
            for n, a, size in places:
                hits[n].add(end - size + 1 - a)
        if not hits:
            return []
        raw, out = folded(text), []
        for n, diagonals in hits.items():
            item, pattern, budget = self.items[n]
            regions: list[list[int]] = []
            for d in sorted(diagonals):
                lo, hi = max(0, d - budget), d + len(pattern) + budget
                if not regions or lo > regions[-1][1]:
                    regions.append([lo, hi])
                regions[-1][1] = max(hi, regions[-1][1])
            for lo, hi in regions:
                for start, end, distance in occurrences(pattern, data[lo:hi], budget):
                    a, b = int(place[lo + start]), int(place[lo + end - 1]) + 1
                    out.append((item, len(raw[:a].decode("utf-8", "ignore")), len(raw[:b].decode("utf-8", "ignore")), distance))
        return sorted(set(out))


def built(index: Index) -> Index:
    """The index with its automaton, which a worker builds once, not for each task."""
    return kept(f"index {index.name}", index.build)


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one partition at a time on the driver."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").dropDuplicates().toLocalIterator():
        if block and size + len(r[1]) > most:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


def contaminations(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, start, end, distance) of each place in docs within the error budget of a benchmark item.

    The budget is `rate` edits for each byte of the normalised item, rounded down. An item within
    its budget of a passage leaves at least one of budget + 1 pieces intact there, so no such
    passage is missed; of overlapping passages of one item occurrences() tells which is listed.
    Null or empty texts and items, and items without letters or digits, match nothing; rows
    without ids are left out; rows that repeat a doc_id give their rows each. The documents are
    passed over once for each block of the benchmark.
    """
    out = None
    for block in blocks(benchmark):
        index = Index(block, rate)

        def run(batches, index=index):
            own = built(index)
            for batch in pieces(batches):
                rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if i is not None for m in own.matches(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(5)], ["doc_id", "item_id", "start", "end", "distance"])

        found = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, item_id long, start long, end long, distance long")
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, end long, distance long")


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark item is found.

    docs: text and any other columns, none of which matters otherwise: rows without an id are searched too, and rows that
    repeat one are dealt with each. Null or empty texts stay, as do all rows if the benchmark is empty; items are as in contaminations().
    """
    text = docs.columns.index("text")
    for block in blocks(benchmark):
        index = Index(block, rate)

        def run(batches, index=index):
            own = built(index)
            for batch in pieces(batches):
                yield batch.filter(pa.array([not own.matches(t) for t in batch.column(text).to_pylist()], pa.bool_()))

        docs = map_batches(docs, run, docs.schema)
    return docs
