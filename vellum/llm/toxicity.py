"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

An input is a word: a vector of its own (by hash) beside the sum of the vectors of the
character runs of its letters (4 and 5 bytes, with marks at both ends, by hash). Of either kind one number is the label log-odds
counted on other folds, and EMBED numbers are trained with the rest of the network, by its gradient. Two gated
recurrent layers read a window of WINDOW words in both directions, attention pools their states,
and a logistic unit scores the window. Windows overlap by WINDOW - STEP words and cover the whole text; a
text's score is that of its highest window. Words of over LONG bytes are read as overlapping pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_cnn import sampled
from .common import crc_mod, kept, map_batches, pieces, texts_of

WINDOW, STEP, HIDDEN, EMBED = 32, 24, 6, 4
WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 15
#: Labelled rows, and bytes of them all together, that training may use.
TRAIN_ROWS, TRAIN_BYTES = 2000, 32 << 20
#: Texts that must hold a word or a character run for it to get a value, and the texts' worth of doubt in it.
MIN_TEXTS, SHRINK = 3, 4
#: Parts of the training texts; the values that a part trains on come from the others.
FOLDS = 6
#: Words whose inputs a worker keeps before it starts anew; bytes of a word that is one input, and by which the pieces of longer ones overlap.
MOST_WORDS, LONG, OVERLAP = 300_000, 48, 4
#: Share of the rate at which the trained vectors move, what they lose a step, and the share of a batch's words that go without
#: theirs: the words of single texts shouldn't be learned by heart.
VECTOR_RATE, VECTOR_DECAY, DROPPED = 0.02, 0.01, 0.5


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased; pieces of those of over LONG bytes."""
    words = text.lower().split()
    if max(map(len, words), default=0) <= LONG:
        return words
    return [w[a : a + LONG] for w in words for a in range(0, max(1, len(w) - OVERLAP), LONG - OVERLAP)]


def char_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character runs of all words, and where each word's begin; the one run of a word of one byte has three."""
    marked = [b"\x02" + w + b"\x03" for w in words]
    sizes = np.array([len(w) for w in marked], np.int64)
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    last = np.cumsum(sizes)[word]
    rows, owner = [], []
    h = np.zeros(len(data), np.uint64)
    for j in range(5):
        h = h[: len(data) - j] * np.uint64(0x9E3779B97F4A7C15) + data[j:] + np.uint64(1)
        if j >= 2:
            whole = np.arange(len(h)) + j < last[: len(h)]
            at = np.nonzero(whole if j > 2 else whole & (sizes[word[: len(h)]] == 3))[0]
            rows.append((((h[at] + np.uint64(j)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)).astype(np.int64) % CHAR_ROWS)
            owner.append(word[at])
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.searchsorted(owner[order], np.arange(len(words)))


def window_starts(n: int) -> np.ndarray:
    return np.arange(0, max(1, n - WINDOW + STEP), STEP)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        f = lambda *shape, scale=0.3: r.normal(0, scale, shape).astype(np.float32)
        self.p = {"words": np.zeros((WORD_ROWS, 1), np.float32), "chars": np.zeros((CHAR_ROWS, 1), np.float32), "word_vectors": np.zeros((WORD_ROWS, EMBED), np.float32), "char_vectors": np.zeros((CHAR_ROWS, EMBED), np.float32), "attend": f(2 * HIDDEN), "out": f(2 * HIDDEN), "bias": np.full(1, -2, np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": f(2 + 2 * EMBED, 3 * HIDDEN), f"b_{d}": np.zeros(3 * HIDDEN, np.float32), f"rec_{d}": f(HIDDEN, 3 * HIDDEN)}
        self.known: dict[bytes, int] = {}
        self.kept = None

    @staticmethod
    def rows_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array([xxhash.xxh3_64_intdigest(w) % WORD_ROWS for w in words], np.int64), *char_rows(words)

    def inputs(self, words: list[bytes]):
        rows, chars, starts = self.rows_of(words)
        x = np.concatenate([self.p["words"][rows], np.add.reduceat(self.p["chars"][chars], starts, axis=0), self.p["word_vectors"][rows], np.add.reduceat(self.p["char_vectors"][chars], starts, axis=0)], axis=1)
        return x, rows, chars, starts

    def gates_of(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p["in_f"] + self.p["b_f"], x @ self.p["in_b"] + self.p["b_b"]], axis=1)

    def layer(self, g: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States (steps x windows x HIDDEN) of one direction. g: steps x windows x gates."""
        n, w, h = g.shape[0], g.shape[1], HIDDEN
        rec, state = self.p[f"rec_{d}"], np.zeros((w, h), np.float32)
        out, memo, full = np.zeros((n, w, h), np.float32), [], mask.all(axis=1)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            u = state @ rec
            zr = 0.5 + 0.5 * np.tanh(0.5 * (g[t, :, : 2 * h] + u[:, : 2 * h]))
            c = np.tanh(g[t, :, 2 * h :] + zr[:, h:] * u[:, 2 * h :])
            new = c + zr[:, :h] * (state - c)
            if not full[t]:
                new = np.where(mask[t][:, None], new, state)
            if keep:
                memo.append((t, state, zr, c, u[:, 2 * h :]))
            state = out[t] = new
        return out, memo

    def windows(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. at: steps x windows, rows of gates; mask: which are words."""
        g = gates[at]
        f, mf = self.layer(g[:, :, : 3 * HIDDEN], mask, "f", keep)
        b, mb = self.layer(g[:, :, 3 * HIDDEN :], mask, "b", keep)
        states = np.concatenate([f, b], axis=2)
        a = np.where(mask, states @ self.p["attend"], -1e9)
        a = np.exp(a - a.max(axis=0))
        a = a * mask
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tw,twh->wh", a, states)
        return pooled @ self.p["out"] + self.p["bias"][0], (states, a, pooled, mf, mb)

    def gradients(self, at, mask, memory, d, inputs, used=True) -> dict:
        """Gradients for d = dloss / dlogit of each window. inputs: what inputs() gave for the words; used: whose vectors were."""
        states, a, pooled, mf, mb = memory
        x, rows, chars, starts = inputs
        dx = np.zeros_like(x)
        h, p = HIDDEN, self.p
        g = {"out": pooled.T @ d, "bias": np.array([d.sum()])}
        dpool = d[:, None] * p["out"]
        da = np.einsum("wh,twh->tw", dpool, states)
        ds = a * (da - (a * da).sum(axis=0))
        g["attend"] = np.einsum("tw,twh->h", ds, states)
        dstates = a[:, :, None] * dpool + ds[:, :, None] * p["attend"]
        for name, memo, part in (("f", mf, slice(0, h)), ("b", mb, slice(h, 2 * h))):
            rec, drec = p[f"rec_{name}"], np.zeros((h, 3 * h), np.float32)
            dg = np.zeros((len(mask), mask.shape[1], 3 * h), np.float32)
            back = np.zeros((mask.shape[1], h), np.float32)
            for t, state, zr, c, u in reversed(memo):
                back = back + dstates[t, :, part]
                on = mask[t][:, None]
                now = back * on
                z, r = zr[:, :h], zr[:, h:]
                dc = now * (1 - z) * (1 - c * c)
                dz = now * (state - c) * z * (1 - z)
                dr = dc * u * r * (1 - r)
                dg[t] = np.concatenate([dz, dr, dc], axis=1)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                drec += state.T @ du
                back = back * ~on + now * z + du @ rec.T
            flat, idx = dg.reshape(-1, 3 * h), at.ravel()
            per = np.zeros((len(x), 3 * h), np.float32)
            np.add.at(per, idx, flat)
            g[f"rec_{name}"], g[f"in_{name}"], g[f"b_{name}"] = drec, x.T @ per, per.sum(axis=0)
            dx += per @ p[f"in_{name}"].T
        dx[:, 2:] *= used
        g["word_vectors"], g["char_vectors"] = np.zeros_like(p["word_vectors"]), np.zeros_like(p["char_vectors"])
        np.add.at(g["word_vectors"], rows, dx[:, 2 : 2 + EMBED])
        np.add.at(g["char_vectors"], chars, np.repeat(dx[:, 2 + EMBED :], np.diff(np.append(starts, len(chars))), axis=0))
        return g

    @staticmethod
    def laid_out(ids: np.ndarray, counts: list[int]):
        """Windows (steps x windows) over the word numbers of several texts, their mask and text."""
        first = np.cumsum([0] + counts)
        starts = [window_starts(n) for n in counts]
        text = np.repeat(np.arange(len(counts)), [len(s) for s in starts])
        begin = np.concatenate(starts) + first[text]
        end = first[text + 1]
        at = begin[None, :] + np.arange(WINDOW)[:, None]
        mask = at < end[None, :]
        return ids[np.minimum(at, max(0, len(ids) - 1))], mask, text

    def row_values(self, held: list, labels: np.ndarray, use: np.ndarray) -> dict[str, np.ndarray]:
        """Each row's value: the log-odds of toxic texts among those in use that hold it, shrunk where they are few."""
        total = np.bincount(labels[use].astype(int), minlength=2)[:, None]
        out = {}
        for k, (name, n, scale) in enumerate((("words", WORD_ROWS, 0.5), ("chars", CHAR_ROWS, 0.1))):
            count = np.zeros((2, n))
            for i in np.nonzero(use)[0]:
                if held[i]:
                    count[int(labels[i]), held[i][k]] += 1
            seen = count.sum(axis=0)
            usual = SHRINK * seen / max(1, total.sum())
            odds = np.log((count[1] + usual + 0.1) / (total[1] + SHRINK + 0.2)) - np.log((count[0] + usual + 0.1) / (total[0] + SHRINK + 0.2))
            values = np.where(seen >= MIN_TEXTS, np.clip(odds * seen / (seen + SHRINK), -1, 4), 0) * scale
            out[name] = values[:, None].astype(np.float32)
        return out

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = 4, batch: int = 32, steps: int = 200, rate: float = 0.03, seed: int = 5) -> "Net":
        """Adam on the log loss of each text's highest window, `epochs` times over the texts or for `steps` batches, whichever is more.

        The values of words and character runs come from the other folds' labels, so that the layers
        learn how far to trust them on new texts; scoring uses those from all texts. The vectors start at 0, so that words and runs
        that training never met add nothing.
        """
        if not len(texts) or labels.min() == labels.max():
            return self
        rng = np.random.default_rng(seed)
        # The words of one text at a time are objects; the others are numbers.
        vocabulary: dict[bytes, int] = {}
        numbers = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32) for t in texts]
        words = list(vocabulary)
        if not words:
            return self
        parts = [self.rows_of(words[a : a + 20_000]) for a in range(0, len(words), 20_000)]
        rows, chars = np.concatenate([x[0] for x in parts]).astype(np.int32), np.concatenate([x[1] for x in parts]).astype(np.int32)
        sizes = np.concatenate([np.diff(np.append(x[2], len(x[1]))) for x in parts])
        starts = np.cumsum(sizes) - sizes

        def held_by(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
            if not len(ids):
                return None
            ids = np.unique(ids)
            own = sizes[ids]
            at = np.repeat(starts[ids] - np.cumsum(own) + own, own) + np.arange(own.sum())
            return np.unique(rows[ids]), np.unique(chars[at])

        held = [held_by(ids) for ids in numbers]
        rare = {name: np.bincount(np.concatenate([h[k] for h in held if h]), minlength=n) < MIN_TEXTS for k, (name, n) in enumerate((("word_vectors", WORD_ROWS), ("char_vectors", CHAR_ROWS)))}
        fold = rng.integers(0, FOLDS, len(texts))
        whole = self.row_values(held, labels, np.ones(len(texts), bool))
        others = [self.row_values(held, labels, fold != f) for f in range(FOLDS)]
        share = float(labels.mean())
        weight = np.sqrt(0.5 / np.where(labels == 1, share, 1 - share))
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        epochs = max(epochs, -(-steps * batch // len(texts)))
        for epoch in range(epochs):
            order = rng.permutation([i for i, s in enumerate(numbers) if len(s)])
            batches = [(f, own[at : at + batch]) for f in range(FOLDS) for own in [order[fold[order] == f]] for at in range(0, len(own), batch)]
            for j in rng.permutation(len(batches)):
                f, some = batches[j]
                self.p |= others[f]
                ids = np.concatenate([numbers[i] for i in some])
                own, ids = np.unique(ids, return_inverse=True)
                inputs = self.inputs([words[i] for i in own])
                on = rng.random((len(own), 1)) >= DROPPED
                inputs[0][:, 2:] *= on
                gates = self.gates_of(inputs[0])
                at, mask, text = self.laid_out(ids, [len(numbers[i]) for i in some])
                logit = np.concatenate([self.windows(gates, at[:, a : a + 4096], mask[:, a : a + 4096])[0] for a in range(0, at.shape[1], 4096)])
                rank = np.lexsort((logit, text))
                top = rank[np.searchsorted(text[rank], np.arange(len(some)), side="right") - 1]
                logit, memory = self.windows(gates, at[:, top], mask[:, top], True)
                d = ((sigmoid(logit) - labels[some]) * weight[some] / len(some)).astype(np.float32)
                g = self.gradients(at[:, top], mask[:, top], memory, d, inputs, on)
                for name, few in rare.items():
                    g[name][few] = 0
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, value in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * value
                    v[k] = 0.98 * v[k] + 0.02 * value**2
                    size = now * VECTOR_RATE if k.endswith("vectors") else now
                    self.p[k] -= (size * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-7)).astype(np.float32)
                    if k.endswith("vectors"):
                        self.p[k] *= 1 - VECTOR_DECAY * now
        self.p |= whole
        return self

    def scores(self, texts: list[bytes], most: int = 4096) -> np.ndarray:
        """Scores of whole texts; windows go through `most` at a time."""
        split = [words_of(t) for t in texts]
        if self.kept is None or len(self.known) > MOST_WORDS:
            self.known, self.kept = {}, np.zeros((0, 2 + 2 * EMBED), np.float32)
        known = self.known
        new = list(dict.fromkeys(w for s in split for w in s if w not in known))
        if new:
            for i, w in enumerate(new, len(known)):
                known[w] = i
            if len(self.kept) < len(known):
                grown = np.zeros((max(len(known), 2 * len(self.kept)), 2 + 2 * EMBED), np.float32)
                grown[: len(known) - len(new)] = self.kept[: len(known) - len(new)]
                self.kept = grown
            self.kept[len(known) - len(new) : len(known)] = self.inputs(new)[0]
        best = np.full(len(texts), self.p["bias"][0], np.float64)
        some = [i for i, s in enumerate(split) if s]
        if not some:
            return sigmoid(best)
        own, ids = np.unique(np.array([known[w] for i in some for w in split[i]], np.int32), return_inverse=True)
        gates = self.gates_of(self.kept[own])
        at, mask, text = self.laid_out(ids, [len(split[i]) for i in some])
        logits = np.concatenate([self.windows(gates, at[:, a : a + most], mask[:, a : a + most])[0] for a in range(0, at.shape[1], most)])
        best[some] = np.maximum.reduceat(logits, np.searchsorted(text, np.arange(len(some))))
        return sigmoid(best)


def loaded(net: Net) -> Net:
    """The same net, with the inputs of words that this worker has met in earlier tasks."""
    key = xxhash.xxh3_128_hexdigest(b"".join(np.ascontiguousarray(net.p[k]).tobytes() for k in sorted(net.p)))
    return kept(f"net {key}", lambda: net)


def fitted(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (4, 2)) -> Net:
    return Net().train(*sampled(docs, labels, "toxic", held_out, TRAIN_ROWS, TRAIN_BYTES))


def toxicity_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3, held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs, from its whole text alone.

    docs: doc_id and text; other columns are ignored. labels: doc_id and toxic, 1 for toxic. The net is
    trained on the driver on at most TRAIN_ROWS labelled rows that aren't held out. Texts without
    words, null ones too, get the score of the bias; rows without a doc_id are scored too and not
    held out; rows that repeat a doc_id are scored each. Without labels the untrained net scores.
    """
    net = fitted(docs, labels, held_out)

    def run(batches):
        own = loaded(net)
        for batch in pieces(batches, 64):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(texts_of(batch.column(1))), pa.float64())], ["doc_id", "score"])

    out = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")
    held = F.coalesce(crc_mod("doc_id", held_out[0]) == held_out[1], F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that score under cut.

    docs: text and any other columns. Texts without words, null ones too, score as the bias does. Rows without a doc_id, and each
    of those that repeat one, are scored; an empty table gives an empty table, and without labels the untrained net decides.
    """
    net = fitted(docs, labels)
    text = docs.columns.index("text")

    def run(batches):
        own = loaded(net)
        for batch in pieces(batches, 64):
            yield batch.filter(pa.array(own.scores(texts_of(batch.column(text))) < cut))

    return map_batches(docs, run, docs.schema)
