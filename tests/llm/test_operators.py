import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import byte_cnn, common, components, decontaminate, edits, fuzzy_lines, mixing, near_dedup, quality_rules, toxicity, unit_dedup

SMALL = "/root/testdata/sf0.001"
ODD = [(1, None, None), (2, "", "a"), (3, "one two three four", "a"), (3, "one two three four", "a"), (None, "no id", None), (4, "long " * 30_000, "b"), (5, "\n\n \t\n", "b"), (6, "ONE two three four", "a")]
COLUMNS = "doc_id long, text string, source string, lang string, size string, score string, kept string, start string, id string, key string, label string"


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, s, "x", *"abcdefg"[:7]) for i, t, s in rows], COLUMNS)


def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (3, None, 1), (None, 1, 1), (4, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "two, three!"), (2, None), (3, "..."), (4, "")], "item_id long, text string")


def documents(spark, where=SMALL):
    return spark.read.parquet(f"{where}/documents.parquet")


def unite(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


OPERATORS = {
    "toxicity": lambda s, d: toxicity.toxicity_scores(d, labels(s)), "near": lambda s, d: near_dedup.near_duplicates(d, 3, 85), "mix": lambda s, d: mixing.mixed_documents(d),
    "quality": lambda s, d: byte_cnn.quality_scores(d, labels(s)), "lines": lambda s, d: fuzzy_lines.fuzzy_line_dedup(d), "rules": lambda s, d: quality_rules.quality_rules(d, labels(s)),
    "clean": lambda s, d: unit_dedup.without_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    assert OPERATORS[name](spark, odd(spark, [])).count() == 0
    assert Counter(r.doc_id for r in OPERATORS[name](spark, odd(spark)).collect()) == Counter(i for i, _, _ in ODD)


def test_odd_rows_of_searches(spark):
    assert unit_dedup.repeated_units(odd(spark)).count() == 0
    got = decontaminate.contaminations(odd(spark), benchmark(spark)).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.end, r.distance) for r in got) == [(3, 1, 4, 13, 0)] * 2 + [(6, 1, 4, 13, 0)]
    assert decontaminate.contaminations(odd(spark, []), benchmark(spark)).count() == 0 and decontaminate.contaminations(odd(spark), benchmark(spark).limit(0)).count() == 0
    assert decontaminate.decontaminated(odd(spark), benchmark(spark)).columns == odd(spark).columns


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_are_those_of_all_pairs(spark, k, percent):
    rng = np.random.default_rng(0)
    rows = {r.doc_id: r.text for r in documents(spark).collect()}
    base = next(t for t in rows.values() if 120 < len(t.split()) < 400).split()
    for i in range(60):  # a group of copies that differ in a word or more
        copy = list(base)
        for at in rng.integers(0, len(copy), i % 6):
            copy[at] = f"w{rng.integers(9)}"
        rows[10_000 + i] = " ".join(copy)
    sets = {}
    for i, t in rows.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids = sorted(rows)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * (x := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - x)]
    want = unite(ids, links)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (500, 400)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 400: 400, 500: 400}


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**31, 384, dtype=np.int64).astype(np.uint32) * 2 + 1
    b = rng.integers(0, 2**32, 384, dtype=np.int64).astype(np.uint32)
    allowed = near_dedup.most_bits(0.85, 384, 0.1)
    for _ in range(200):
        common, own = rng.integers(0, 2**63, 850, dtype=np.uint64), rng.integers(0, 2**63, (2, 75), dtype=np.uint64)
        mh = near_dedup.samples([np.concatenate([common, own[0]]), np.concatenate([common, own[1]])], a, b)
        x, y = near_dedup.odd_sketch(mh)
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= allowed


def test_repeated_units_are_those_of_a_dictionary(spark):
    rows = {r.doc_id: r.text for r in documents(spark).collect()}
    seen, want, lines = {}, set(), set()
    for i in sorted(rows):
        for line, a, b, unit in unit_dedup.units_of(rows[i], unit_dedup.MIN_WORDS):
            seen.setdefault(unit, []).append((i, a, b, line))
    for places in seen.values():
        for i, a, b, line in sorted(places)[1:]:
            want.add((i, a, b, *sorted(places)[0][:2]))
            if a == line and rows[i][a:].split("\n")[0] == rows[i][a:b]:
                lines.add((i, line, b))
    inside = {w for w in want for (i, line, b) in lines if w[0] == i and line <= w[1] and w[2] <= b and (w[1], w[2]) != (line, b)}
    assert {tuple(r) for r in unit_dedup.repeated_units(documents(spark)).collect()} == want - inside
    passage = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"Intro.\n{passage}\nend"), (2, f"Begin. {passage.upper()}. More text here."), (3, f"x\n{passage}")], "doc_id long, text string")
    cleaned = {r.doc_id: r.text for r in unit_dedup.without_repeats(docs).collect()}
    assert cleaned[1].count("word") == 60 and cleaned[3] == "x\n"


def test_short_lines_and_passages_of_short_sentences_are_units(spark):
    passage = " ".join(f"Word{i} goes here now." for i in range(15))
    rows = [(1, f"Some opening words. {passage} Then an end of its own."), (2, f"Another start. {passage} And so on."), (3, "Read more about this page\nown"), (4, "other\nread more  about this page"), (5, "漢字" * 12), (6, "漢字" * 12)]
    left = {r.doc_id: r.text for r in unit_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {1: rows[0][1], 2: "Another start. And so on.", 3: rows[2][1], 4: "other\n", 5: rows[4][1], 6: ""}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_best_match_is_the_plain_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(60):
        p, t = (bytes(rng.integers(97, 100, n).tolist()) for n in (rng.integers(1, 9), rng.integers(0, 15)))
        plain = min((levenshtein(p, t[a:b]), b) for b in range(len(t) + 1) for a in range(b + 1))
        assert decontaminate.best_match(p, t)[0] == min(plain[0], len(p))


def test_edited_benchmark_passages_are_found(spark):
    items = [r for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()][:5]
    rng = np.random.default_rng(3)
    rows = []
    for n, item in enumerate(items):
        text = list(item.text)
        for at in rng.integers(0, len(text), int(len(decontaminate.normalised(item.text)[0].strip()) * decontaminate.RATE) // 2):
            text[at] = "z"
        rows.append((n, f"É before: {''.join(text).upper()} after"))
    got = decontaminate.contaminations(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(n, x.item_id) for n, x in enumerate(items)}


def test_fuzzy_lines_are_those_of_all_pairs(spark):
    rows = [(r.doc_id, "\n".join(x for x in r.text.split("\n") if len(x) < 300)) for r in documents(spark).collect()]
    base = next(line for _, t in rows for line in t.split("\n") if 20 < len(line.split()) < 60)
    rows += [(9000 + i, base.replace(base[i + 10], "q", 1) + "\nown line") for i in range(20)]
    links, want = similar_groups(rows)
    assert len(links) >= 20
    assert {(r.doc_id, r.line): (r.first_doc_id, r.first_line) for r in fuzzy_lines.line_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def similar_groups(rows):
    """First place of each line's group, of all pairs of edit similarity PERCENT or more."""
    first = {}
    for i, t in sorted(rows):
        for n, words in fuzzy_lines.lines_of(t.encode()):
            first.setdefault(b" ".join(words).decode(), []).append((i, n))
    names = sorted(first, key=lambda x: first[x][0])
    letters = {c: j for j, c in enumerate(sorted(set("".join(names))))}
    held = np.array([np.bincount([letters[c] for c in x], minlength=len(letters)) for x in names])
    links = []
    for n, a in enumerate(names):  # an edit changes the letters held by one each way
        off = held[n + 1 :] - held[n]
        for m in np.nonzero(np.maximum(np.maximum(off, 0).sum(axis=1), np.maximum(-off, 0).sum(axis=1)) * 100 <= np.maximum(held[n].sum(), held[n + 1 :].sum(axis=1)) * (100 - fuzzy_lines.PERCENT))[0] + n + 1:
            b = names[m]
            if levenshtein(a, b) <= max(len(a), len(b)) * (100 - fuzzy_lines.PERCENT) // 100:
                links.append((n, int(m)))
    group = unite(range(len(names)), links)
    return links, {(i, n): first[names[group[k]]][0] for k, x in enumerate(names) for i, n in first[x]}


def test_fuzzy_lines_are_those_of_edit_similarity_alone(spark):
    rng = np.random.default_rng(4)
    rows = []
    for n, words in enumerate((10, 12, 16, 20, 30, 40, 60) * 3):  # a word replaced, or as many letters as the budget holds
        line = ["".join(chr(c) for c in rng.integers(97, 123, rng.integers(4, 9))) for _ in range(words)]
        copy, letters = list(line), list(" ".join(line))
        copy[rng.integers(words)] = "qxqx"
        for at in rng.choice(len(letters), len(letters) // 10, replace=False):
            letters[at] = "é"
        rows += [(10 * n + k, x) for k, x in enumerate((" ".join(line), " ".join(copy), "".join(letters)))]
    links, want = similar_groups(rows)
    assert len(links) >= 40
    assert {(r.doc_id, r.line): (r.first_doc_id, r.first_line) for r in fuzzy_lines.line_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_lines_and_pairs_dealt_in_turns_give_the_same_groups(spark, monkeypatch):
    rng = np.random.default_rng(11)
    lines = [" ".join("".join(chr(c) for c in rng.integers(97, 123, rng.integers(4, 9))) for _ in range(words)) for words in (10, 16, 30, 60) * 3]
    rows = [(10 * n + k, x) for n, line in enumerate(lines) for k, x in enumerate((line, "qx" + line[2:], line[:-2] + "qx", line + " q"))]
    docs, shuffled, tables = spark.createDataFrame(rows, "doc_id long, text string"), [], []
    monkeypatch.setattr(fuzzy_lines, "free_shuffles", lambda *_: None)
    monkeypatch.setattr(fuzzy_lines, "table", lambda df, label: (tables.append(label), common.table(df, label))[1])
    for most in (1 << 40, 1 << 15):
        monkeypatch.setattr(fuzzy_lines, "AT_ONCE", most)
        monkeypatch.setattr(fuzzy_lines, "SHARE", 0)
        shuffled.append(sorted(map(tuple, fuzzy_lines.line_groups(docs).collect())))
        tables.append("end")
    first, later = tables[: tables.index("end")], tables[tables.index("end") + 1 :]
    assert shuffled[0] == shuffled[1] and len({r[3] for r in shuffled[0]}) == len(lines)
    assert first.count("pairs") == 2 and first.count("links") == 2 and later.count("pairs") > 6


def test_short_lines_and_lines_of_few_words_have_near_copies(spark):
    few = " ".join(["lorem ipsum"] * 30)
    rows = list(enumerate(["Contents 2019", "contents 2018", "licence", "license", "Terms of the licence", "Terms of the license", "All rights reserved", "All rigths reserved", "Home | About | Help", "Home | Abuot | Help now", few, few.replace("ipsum", "ipsun", 5), "x" * 9, "x" * 8 + "y", "x" * 10, "ÄÖÜ äöü ß", "ÄÖÜ äöü ßa"]))
    links, want = similar_groups(rows)
    assert len(links) >= 4
    assert {(r.doc_id, r.line): (r.first_doc_id, r.first_line) for r in fuzzy_lines.line_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_banded_distances_are_those_of_whole_columns():
    rng = np.random.default_rng(6)
    for _ in range(150):
        p = rng.integers(97, 97 + rng.integers(2, 20), rng.integers(40, 400)).astype(np.uint32)
        q = np.delete(p, rng.integers(0, len(p), rng.integers(1, 30)))
        q[rng.integers(0, len(q), rng.integers(0, 40))] = 98
        p, q = edits.trimmed(p, q)
        if not len(p):
            continue
        want = edits.distance(p, q)
        assert edits.fewest(p, q) <= want
        for most in {len(q) - len(p) + 1, len(p) // 8, len(p) // 2}:
            if len(q) - len(p) <= most < len(p) and most:
                for got in (edits.band_distance(p, q, most), edits.banded_distances([(p, q)], most)[0]):
                    assert got == want if want <= most else got > most


def test_pairs_that_cannot_hold_are_left_early_and_others_stay():
    rng = np.random.default_rng(7)
    texts = ["".join(map(chr, rng.integers(97, 123, 900))) for _ in range(40)]
    pairs = [(t, texts[(k + 1) % 40] if k % 2 else t[:300] + "#" * (k + 1) + t[340:]) for k, t in enumerate(texts)]
    assert edits.within(pairs, np.full(40, 90)).tolist() == [edits.distance(edits.letters(a), edits.letters(b)) <= 90 for a, b in pairs]


def test_bounds_of_many_pairs_spare_distances_and_lose_no_pair(monkeypatch):
    rng = np.random.default_rng(9)
    syllables = ["the", "er", "on", "an", "re", " ", ". ", "à", "中"]
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice(syllables, rng.integers(1, 200)))
        b = list(a)
        for at in rng.integers(0, len(a), rng.integers(0, max(1, len(a) // 4) + 1)):
            b[at] = str(rng.choice(["", "q", "é", b[at] + "x", "\0"]))
        pairs.append((a, "".join(b)))
    apart = ["".join(map(chr, rng.integers(97, 123, 400))) for _ in range(600)]
    far = list(zip(apart[::2], apart[1::2]))
    want = np.array([levenshtein(a, b) for a, b in pairs])
    for run in edits.RUNS:
        assert (edits.fewest_of(pairs, run) <= want).all()
        assert run == 1 or (edits.fewest_of(far, run) > 40).all()
    budgets = np.array([max(len(a), len(b)) // 10 for a, b in pairs])
    assert edits.within(pairs, budgets).tolist() == (want <= budgets).tolist()
    may, least = edits.possible(pairs + far, np.append(budgets, np.full(300, 40)))
    assert set(may) >= set(np.flatnonzero(want <= budgets)) and may.max() < 300 and (least <= want[may]).all()
    for name in ("banded_distances", "block_distances", "distance"):
        monkeypatch.setattr(edits, name, None)
    assert not edits.within(far, np.full(300, 40)).any()


def test_similar_pairs_of_all_batches_are_found():
    rng = np.random.default_rng(10)
    texts = ["".join(map(chr, rng.integers(97, 123, 60))) for _ in range(5000)]
    near = [t[:30] + "#" * (k % 9) + t[30 + k % 9 :] for k, t in enumerate(texts)]
    ids = pa.array(np.arange(5000))
    batch = pa.RecordBatch.from_arrays([ids, pa.array(np.arange(5000) + 9000), pa.array(texts), pa.array(near)], ["a", "b", "p", "q"])
    got = [x for out in fuzzy_lines.similar(iter([batch.slice(0, 100), batch.slice(100)])) for x in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    assert sorted(got) == [(k, k + 9000) for k in range(5000) if k % 9 <= 6]


def test_keys_of_lines_are_dealt_packed_and_lose_no_member():
    rng = np.random.default_rng(8)
    keys, d1 = (rng.integers(0, (1 << 64) - (1 << 21), 500, dtype=np.uint64) for _ in range(2))
    rows = [x for k in (0, 1) for x in fuzzy_lines.packed(fuzzy_lines.KEY, fuzzy_lines.key_records(keys, d1 + np.uint64(k << 20)), fuzzy_lines.part_of(keys, 7))]
    assert sum(x.num_rows for x in rows) == 14
    (got,) = fuzzy_lines.gathered(iter(rows), fuzzy_lines.KEY)
    got, whose = fuzzy_lines.shared(*fuzzy_lines.keys_of(got))
    assert sorted(zip(got.tolist(), whose.tolist())) == sorted((k >> 16 << 16, (d + (j << 20)) >> 16 << 16) for k, d in zip(keys.tolist(), d1.tolist()) for j in (0, 1))


def test_mix_meets_its_targets(spark):
    rows = mixing.mixed_documents(documents(spark, "/root/testdata/sf0.01")).collect()
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    assert abs(sum(target.values()) - sum(size.values())) < 1e-3 * sum(size.values())
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] and target[s] <= 3 * size[s] + 1e-6 for s in target)
    small = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(1000, "a"), (10, "b"), (10, None), (0, "c")])], "doc_id long, text string, source string")
    got = {r.source: r.target for r in mixing.mixed_documents(small).collect()}
    assert got == {"a": 960.0, "b": 30.0, None: 30.0, "c": 0.0}


def test_bounds_are_exact_and_rules_keep_good_documents(spark):
    assert abs(quality_rules.upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9
    assert abs(quality_rules.log_tail(3, 10, 0.3) - 0.6496107184) < 1e-9
    docs = documents(spark, "/root/testdata/sf0.01")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs, lab).collect()}
    for d in docs.collect():
        w = d.text.encode().split()
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in d.text.encode().split(b"\n") if x.split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(d.text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        r = rows[d.doc_id]
        assert tuple(r[c] for c in quality_rules.COUNTS) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_rules_reach_strata_of_few_labels(spark):
    good = "the quick brown fox jumps over a lazy dog while seven other animals look on from behind some old garden fence today"
    n = {"a": 200, "b": 90, "c": 89, "d": 40}
    rows = [(1000 * k + i, f"{good} {s}{i}", s) for k, s in enumerate(n) for i in range(n[s])]
    junk = [(9000 + k, good.replace(" ", " # "), s) for k, s in enumerate(n)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, 1) for i, _, _ in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, lab).collect()}
    assert all(got[i].kept for i, _, _ in rows)
    assert {s: got[9000 + k].kept for k, s in enumerate(n)} == {"a": False, "b": False, "c": False, "d": True}


@pytest.mark.parametrize("score, label, held, least", [(toxicity.toxicity_scores, "toxic", (4, 2), 0.9), (byte_cnn.quality_scores, "quality", (3, 1), 0.9)])
def test_classifiers_on_held_out_rows(spark, score, label, held, least):
    where = "/root/testdata/sf0.01"
    lab = spark.read.parquet(f"{where}/labels.parquet")
    truth = {r.doc_id: r[label] for r in lab.collect()}
    rows = [r for r in score(documents(spark, where), lab).collect() if r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % held[0] == held[1]) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in own]) >= least


def naive_score(net, words):
    """The toxicity net over one window, word by word."""
    p, h = net.p, toxicity.HIDDEN
    x, rows, chars, starts = net.inputs(words)
    sig = lambda v: 1 / (1 + np.exp(-v))
    states = np.zeros((len(words), 2 * h))
    for d, order, part in (("f", range(len(words)), slice(0, h)), ("b", reversed(range(len(words))), slice(h, 2 * h))):
        s = np.zeros(h)
        for t in order:
            g, u = x[t] @ p[f"in_{d}"] + p[f"b_{d}"], s @ p[f"rec_{d}"]
            z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
            s = z * s + (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :])
            states[t, part] = s
    a = np.exp(states @ p["attend"])
    return sig((a / a.sum()) @ states @ p["out"] + p["bias"][0])


def filled_net(seed=0):
    net, rng = toxicity.Net(), np.random.default_rng(seed)
    for k in ("words", "chars", "word_vectors", "char_vectors"):
        net.p[k] = rng.normal(0, 0.3, net.p[k].shape).astype(np.float32)
    return net


def test_toxicity_net_is_the_plain_recurrence():
    net, rng = filled_net(), np.random.default_rng(1)
    texts = [b" ".join(b"w%d" % i for i in rng.integers(0, 50, n)) for n in (1, 5, 32, 33, 80)]
    want = []
    for t in texts:
        words = t.split()
        want.append(max(naive_score(net, words[a : a + toxicity.WINDOW]) for a in toxicity.window_starts(len(words))))
    assert np.allclose(net.scores(texts), want, atol=1e-5) and net.scores([b""])[0] == pytest.approx(1 / (1 + np.exp(2)))


def test_toxicity_gradients_are_finite_differences():
    net = filled_net(2)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    words = [b"w%d" % i for i in range(9)]
    inputs = net.inputs(words)
    at, mask, _ = net.laid_out(np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 1, 0]), [7, 4])

    def logits():
        return net.windows(net.gates_of(net.inputs(words)[0]), at, mask)[0]

    _, memory = net.windows(net.gates_of(inputs[0]), at, mask, True)
    g = net.gradients(at, mask, memory, np.array([1.0, -0.5]), inputs)
    rng = np.random.default_rng(3)
    for name, value in g.items():
        flat, own = net.p[name].reshape(-1), np.asarray(value).reshape(-1)
        for i in rng.permutation(np.nonzero(own)[0])[:6]:
            kept, step = flat[i], 1e-4
            flat[i] = kept + step
            up = logits() @ [1.0, -0.5]
            flat[i] = kept - step
            down = logits() @ [1.0, -0.5]
            flat[i] = kept
            assert abs((up - down) / (2 * step) - own[i]) < 2e-3 * max(1, abs(own[i])), (name, i)


def test_long_words_are_read_whole():
    a, b = b"x" * 100 + b"one" + b"y" * 100, b"x" * 100 + b"two" + b"y" * 100
    assert len(toxicity.words_of(a)) > 4 and toxicity.words_of(a) != toxicity.words_of(b) and toxicity.words_of(b"A b" + b"c" * 46) == [b"a", b"b" + b"c" * 46]
    pieces = toxicity.words_of(a)
    assert b"".join([pieces[0]] + [x[toxicity.OVERLAP :] for x in pieces[1:]]) == a
    net = filled_net()
    assert net.scores([a])[0] != net.scores([b])[0]


def test_quality_net_is_the_plain_convolution_over_whole_texts():
    net, rng = byte_cnn.Net(), np.random.default_rng(4)
    c, w, s = byte_cnn, byte_cnn.WIDTH, byte_cnn.STRIDE
    for text in (b"", b"a", bytes(rng.integers(97, 123, 3000).tolist())):
        data = c.codes(text)
        out = [sum(net.p["tables"][j][data[at + j]] for j in range(w)) for at in range(0, len(data) - w + 1, s)]
        blocks = -(-len(out) // c.BLOCK)
        tops = []
        for a in range(0, max(1, blocks), c.CHUNK):
            if a == 0 or a + c.SPAN - c.CHUNK < blocks:
                tops.append(np.max(out[a * c.BLOCK : (a + c.SPAN) * c.BLOCK], axis=0))
        t = np.tanh(np.array(tops))
        assert np.allclose(net.features(text), np.concatenate([t.max(axis=0), t.mean(axis=0)]), atol=1e-5)
    half = b" ".join(b"%x" % i for i in rng.integers(0, 1 << 60, 25_000))
    marks = c.codes(half + b" " + half)
    words = [(half + b" " + half)[i + 1 : i + 9] for i in range(2 * len(half) + 1) if (half + b" " + half)[i : i + 1] == b" "]
    assert len(half) > 1 << 18 and (marks == 1).sum() >= 24_990 and len(words) == 49_999
    whole, size = net.features(half), c.PIECE
    try:
        c.PIECE = c.BLOCK * 3
        assert np.allclose(net.features(half), whole, atol=1e-6)
    finally:
        c.PIECE = size


def test_quality_gradients_move_the_loss_down():
    texts, y = [b"good words here and there " * 20, b"###!!! ***### " * 30] * 10, np.array([1.0, 0.0] * 10)
    net = byte_cnn.Net().train(texts, y, epochs=20)
    assert (net.scores(texts[:2]) >= 0.5).tolist() == [True, False]


def test_long_texts_are_learned_from(spark):
    docs = spark.createDataFrame([(1, "a " * 60_000), (2, "b"), (3, None)], "doc_id long, text string")
    known = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    assert [len(t) for t in byte_cnn.sampled(docs, known, "quality", (99, 98), 100, 1 << 20)[0]] == [1, 120_000]
    assert [len(t) for t in byte_cnn.sampled(docs, known, "quality", (99, 98), 100, 1 << 10)[0]] == [1]


def test_columns_of_any_name_stay(spark):
    names = "doc_id long, text string, source string, rate string, seed string, size string, _copy string, target string, copies string, taken string, row string, col string, key string, h string, id string, removed string"
    docs = spark.createDataFrame([(1, "a b", "s", *"0123456789abc"), (2, "c", None, *"0123456789abc")], names)
    for out in (mixing.emitted(docs), near_dedup.without_near_copies(docs), decontaminate.decontaminated(docs, benchmark(spark)), toxicity.without_toxic(docs, labels(spark))):
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
    got = unit_dedup.without_repeats(docs)
    assert got.columns == docs.columns and {r.h: r.id for r in got.collect()} == {"a": "b"}


def test_texts_of_one_id_are_cut_by_their_own_spans(spark):
    line = "a line that stands in several places of this table"
    docs = spark.createDataFrame([(1, f"{line}\nown words of the first row"), (1, "x" * 90), (2, line)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in unit_dedup.without_repeats(docs).collect()) == [(1, f"{line}\nown words of the first row"), (1, "x" * 90), (2, "")]


def test_one_row_of_each_group_stays(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, a), (1, a), (1, b), (2, a + " more"), (None, a), (None, b), (None, "own words of a row without an id"), (None, None), (3, ""), (3, "")]
    got = near_dedup.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = Counter(r.text for r in got)
    assert texts == {b: 1, "own words of a row without an id": 1, None: 1, "": 2, **({a: 1} if a in texts else {a + " more": 1})}


def test_all_places_of_an_item_are_found(spark):
    rng = np.random.default_rng(5)
    item = "".join("abcdefghij"[i % 10] for i in range(300))
    plain = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(20))
    rows = [(1, f"{item} zz {item}"), (2, f"{plain}, {plain}; {plain.replace(plain[7:9], '', 1)}"), (3, plain[:60])]
    items = spark.createDataFrame([(1, item), (2, plain)], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contaminations(spark.createDataFrame(rows, "doc_id long, text string"), items).collect())
    n, m = len(plain), len(item)
    assert [x for x in got if x[0] == 1] == [(1, 1, 0, m, 0), (1, 1, m + 4, 2 * m + 4, 0)]
    assert [x[:3] for x in got if x[0] == 2] == [(2, 2, 0), (2, 2, n + 2), (2, 2, 2 * n + 4)] and [x[4] for x in got if x[0] == 2] == [0, 0, 2]
    assert not [x for x in got if x[0] == 3]


def test_contaminations_are_those_of_plain_distances(spark):
    rng = np.random.default_rng(7)
    items = {i: "".join("ab c"[c] for c in rng.integers(0, 4, n)).strip() or "a" for i, n in enumerate((12, 25, 40, 60, 80))}
    docs = {}
    for d in range(40):
        text = list("".join("abc d"[c] for c in rng.integers(0, 5, 60)) + items[d % 5] + "".join("abd c"[c] for c in rng.integers(0, 5, 60)))
        for at in rng.integers(60, len(text) - 60, d % 6):
            text[at] = "z"
        docs[d] = "".join(text)
    want = set()
    for d, text in docs.items():
        t = decontaminate.normalised(text)[0]
        for i, x in items.items():
            p = decontaminate.normalised(x)[0].strip()
            if p and min(min(levenshtein(p, t[a : a + n]) for a in range(len(t) - n + 1)) for n in range(len(p) - 4, len(p) + 5) if 0 < n <= len(t)) <= int(len(p) * decontaminate.RATE):
                want.add((d, i))
    got = decontaminate.contaminations(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert want and {(r.doc_id, r.item_id) for r in got} == want
    for r in got:
        assert decontaminate.normalised(docs[r.doc_id][r.start : r.end])[0].strip() and r.distance <= int(len(decontaminate.normalised(items[r.item_id])[0].strip()) * decontaminate.RATE)


def test_verdicts_are_those_of_bounds_by_hand(spark):
    """All settings in their order, each bounded by the exact binomial tail in fractions."""
    from fractions import Fraction
    from math import comb

    docs = documents(spark, "/root/testdata/sf0.01")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.quality_rules(docs, lab).collect()
    good = {r.doc_id for r in lab.where("quality = 1").collect()}
    strata = sorted({r.stratum for r in rows if r.doc_id in good})
    chance, risk = Fraction(1, 20) / len(strata), Fraction(1, 20)
    for s in strata:
        own = [r for r in rows if r.stratum == s]
        known, allowed = [r for r in own if r.doc_id in good], {}
        for rules in quality_rules.settings():
            x, n = sum(any(r[m] > c for m, c in rules.items()) for r in known), len(known)
            # The bound is at most the risk where so few at that rate are no likelier than the chance.
            if sum(comb(n, k) * risk**k * (1 - risk) ** (n - k) for k in range(x + 1)) > chance:
                break
            allowed = rules
        for r in own:
            assert r.kept == (not r.base_failed and not any(r[m] > c for m, c in allowed.items()))


def test_pipeline_is_its_stages(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = documents(spark)
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, SMALL).cache()
        assert after.columns == docs.columns and {r.doc_id for r in after.collect()} <= {r.doc_id for r in left.collect()}
        left = after
    rows = corpus_pipeline.run(spark, SMALL).collect()
    encode = Tokenizer.from_file(corpus_pipeline.tokenizer_path()).encode
    want, start = [], 0
    for r in sorted(left.collect(), key=lambda r: r.doc_id):
        ids = np.array(encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in rows) == want


def test_pipeline_of_odd_and_no_rows(spark, tmp_path):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline

    for name, rows in (("some", ODD), ("none", [])):
        where = f"{tmp_path}/{name}"
        odd(spark, rows).write.parquet(f"file://{where}/documents.parquet")
        labels(spark).write.parquet(f"file://{where}/labels.parquet")
        benchmark(spark).write.parquet(f"file://{where}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"file://{where}").collect()
        assert (len(got) == 0) == (name == "none") and {r.doc_id for r in got} <= {i for i, _, _ in ODD}


def test_workers_drop_what_earlier_operators_left(spark, monkeypatch):
    import weakref

    import pyarrow as pa

    net = toxicity.Net()
    net.scores([b"some words"])
    left = weakref.ref(toxicity.loaded(net))
    del net
    runs = []
    monkeypatch.setattr(near_dedup, "map_batches", lambda df, f, schema: runs.append(f))
    near_dedup.full_sets(documents(spark), 2)
    assert left().known
    list(runs[0]([pa.RecordBatch.from_pydict({"id": [1], "text": ["other words"]})]))
    assert left() is None


def test_distances_of_many_pairs_are_the_plain_ones():
    rng = np.random.default_rng(6)
    pairs = []
    for _ in range(300):
        a, b = ("".join(chr(97 + c) for c in rng.integers(0, 3, n)) for n in rng.integers(0, 150, 2))
        if rng.random() < 0.6:
            letters = list(a)
            for at in rng.integers(0, max(1, len(a)), min(len(a), 9)):
                letters[at] = "é"
            b = "".join(letters)[rng.integers(0, 3) :]
        pairs += [(a, b), (b, a)]
    plain = np.array([levenshtein(a, b) for a, b in pairs])
    assert edits.within(pairs, plain).all() and not edits.within(pairs, plain - 1)[plain > 0].any()
    long = "".join(chr(97 + c) for c in rng.integers(0, 26, 5000))
    assert edits.within([(long, long[:2000] + "Q" + long[2003:])], np.array([3])).all() and not edits.within([("x" + long, long[:2000] + "Q" + long[2003:] + "y")], np.array([4])).any()
