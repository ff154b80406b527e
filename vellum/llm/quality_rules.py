"""Quality rules whose cutoffs bound the false rejections of each stratum."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, map_batches, pieces, table, texts_of, windows_hash

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_HASHES = WordHashes()
#: Rules by measure, and their cutoffs from lenient to strict. A document over the cutoff is rejected.
GRID = {
    "symbols_per_word": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "repeat_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "upper_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "digit_share": (0.8, 0.6, 0.5, 0.4, 0.3, 0.2),
    "mark_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "same_as_previous_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2),
    "mean_word_chars": (40.0, 30.0, 25.0, 20.0, 18.0, 15.0),
}
#: Share of good documents that all rules together may reject in a stratum, and the chance that any bound is wrong.
RISK, CHANCE = 0.05, 0.05
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(hashes: np.ndarray) -> int:
    """Words in windows of WINDOW words that occur twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    w = windows_hash(hashes, WINDOW)
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[at] += 1
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measured(docs: DataFrame) -> DataFrame:
    """docs' doc_id and stratum with the counts and measures of the whole text; null texts count as empty."""

    def run(batches):
        blanks = b" \t\n\r\x0b\x0c"
        for batch in pieces(batches):
            rows = []
            for t in texts_of(batch.column(2)):
                words = t.split()
                joined = b"".join(words)
                chars = len(joined.decode("utf-8", "replace"))
                symbols = sum(t.count(bytes([c])) for c in SYMBOLS)
                lines = [x for x in t.split(b"\n") if x.strip(blanks)]
                dup = len(lines) - len(set(lines))
                h = _HASHES(words)
                data = np.bincount(np.frombuffer(joined, np.uint8), minlength=256)
                upper, lower = int(data[65:91].sum()), int(data[97:123].sum())
                digits, marks = int(data[48:58].sum()), int(data[33:48].sum() + data[58:65].sum() + data[91:97].sum() + data[123:127].sum())
                repeat, n = repeat_words(h), len(words)
                same = int((h[1:] == h[:-1]).sum()) if n > 1 else 0
                one, size = max(n, 1), max(len(joined), 1)
                rows.append((n, chars, symbols, dup, repeat, symbols / one, dup / max(len(lines), 1), repeat / one, upper / max(upper + lower, 1), digits / size, marks / size, same / one, chars / one))
            cols = [pa.array([r[j] for r in rows], pa.int64() if j < 5 else pa.float64()) for j in range(13)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "stratum", *COUNTS, *GRID])

    schema = "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in GRID)
    return map_batches(docs, run, schema)


def log_tail(x: int, n: int, p: float) -> float:
    """Probability of x or fewer of n at rate p."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return float(x >= n)
    k = np.arange(x + 1)
    ways = np.concatenate([[0.0], np.cumsum(np.log((n - k[1:] + 1) / k[1:]))])
    logs = ways + k * math.log(p) + (n - k) * math.log1p(-p)
    return float(np.exp(logs - logs.max()).sum() * math.exp(logs.max()))


def upper_bound(x: int, n: int, chance: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a rate of which x of n were seen, wrong with probability `chance`; bisected to 1e-12."""
    if n == 0 or x >= n:
        return 1.0
    low, high = x / n, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if log_tail(x, n, mid) > chance else (low, mid)
    return high


def settings() -> list[dict[str, float]]:
    """Joint settings in their fixed order: each makes one rule stricter by a step, all rules keeping pace through their grids."""
    steps = sorted(((i + 1) / len(g), k, m, c) for k, (m, g) in enumerate(GRID.items()) for i, c in enumerate(g))
    out: list[dict[str, float]] = []
    for _, _, m, c in steps:
        out.append((out[-1] if out else {}) | {m: c})
    return out


def rejected(rules: dict[str, float]) -> Column:
    over = F.lit(False)
    for m, c in rules.items():
        over = over | (F.col(m) > c)
    return over


def cutoffs(good: DataFrame, risk: float = RISK, chance: float = CHANCE) -> dict[str | None, dict[str, float]]:
    """The strictest safe joint setting of the rules in each stratum, from the measures of documents labelled good.

    All rules together may reject risk of a stratum's good documents. What a joint setting rejects is
    bounded as one rate; settings are tested in their fixed order, up to the first whose bound is too high; that order
    needs no correction. The chance is divided by the strata (Bonferroni), so that
    ln(chance / strata) / ln(1 - risk) good documents are enough for the first. All labelled rows
    are counted in Spark; a row for each stratum comes to the driver.
    """
    known = settings()
    sums = [F.count_if(rejected(rules)).alias(f"x{k}") for k, rules in enumerate(known)]
    rows = good.groupBy("stratum").agg(F.count("*").alias("n"), *sums).collect()
    share = chance / max(1, len(rows))
    out: dict[str | None, dict[str, float]] = {}
    for r in rows:
        for k, rules in enumerate(known):
            if upper_bound(r[f"x{k}"], r["n"], share) > risk:
                break
            out[r["stratum"]] = rules
    return out


def verdict(found: dict[str | None, dict[str, float]]) -> Column:
    """True if no rule of the row's stratum rejects it; strata without labels reject nothing."""
    out = F.lit(True)
    for stratum, rules in found.items():
        out = F.when(F.col("stratum").eqNullSafe(F.lit(stratum)), ~rejected(rules)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The counts, measures, base_failed and kept of each row of docs.

    docs: doc_id, text, the stratum column, and any others. labels: doc_id, quality; 1 is good,
    others and nulls are not used. base_failed: under 20 words, or over 30 % of the words in
    repeated windows. kept: neither that nor rejected by a rule; what base_failed rejects is no part of the rules' risk. Null texts count as empty; a null
    stratum is one of its own. Rows that repeat a doc_id are measured each. Without labels no
    rule rejects. Strata are names like languages: few enough for a row each on the driver.
    """
    found = table(measured(docs.select(F.col("doc_id").cast("long"), F.col(stratum).cast("string").alias("stratum"), "text")), "measures")
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long")).distinct()
    rules = cutoffs(found.join(good, "doc_id", "left_semi"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.withColumn("base_failed", base).withColumn("kept", ~base & verdict(rules))
