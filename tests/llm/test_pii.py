import hashlib
import re

from vellum.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    "", None, "mail a.b@c.d.e, x@y@z.com and a@b.c_d@e.f end", "1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.1 1..2.3.4", "4041894974608795 4041-8949 7460 8795 40418949746087955 0000000000000000",
    "+1 (988) 555-2485 é +12345 +1-2-3-4-5-6-7-8 ++49 30 1234567", "ünï 42.144.35.254 ñ@b.co a@b.c", "7" * 3000 + " " + "1 " * 2000, "a" * 20000 + " x@y.z", "12 34 56 78 90 12 34 56 7" * 3,
]


def rows(spark, texts):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    return {r.doc_id: r for r in pii.personal_data(docs).collect()}


def test_base_spans_are_those_of_plain_matching(spark):
    got = rows(spark, TEXTS)
    for i, t in enumerate(TEXTS):
        want = brute(t)
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].spans == told and got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in want) for k in PATTERNS]


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.personal_data(docs).collect():
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(filter(None, r.spans.split(",")))


def test_patterns_of_seeds_find_unseen_identifiers(spark):
    seeds = [f"word{'abcdefghij'[i]} write to user{i}@mail.example.org today" for i in range(9)]
    got = rows(spark, [*seeds, "please write to someone_at_host9 today", "chapter 12 of it"])
    assert got[9].spans == "email:16:32" and got[9].n_email == 0
    assert got[10].spans == ""


def test_found_identifiers_make_patterns_that_find_more_in_a_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    planted = {10_000 + i: f"{'abcdefghij'[i % 10]} write  to user{i}@mail.example.org, today" for i in range(100)}
    planted |= {20_000 + i: f"write to name{i}_at_host today" for i in range(20)}
    planted |= {30_000 + i: f"first reach name{i}_at_host now" for i in range(20)}
    planted |= {40_000: "never reach another9_at_place now", 40_001: "chapter 12 later", 40_002: "x " * 100 + "w" * 200 + " 77 " + "v" * 300}
    docs = spark.createDataFrame(list((texts | planted).items()), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    spans = {i: {planted[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in got[i].spans.split(",") if x) if k == "email"} for i in planted}
    assert all(spans[20_000 + i] == {f"name{i}_at_host"} == spans[30_000 + i] and got[20_000 + i].n_email == 0 for i in range(20))
    assert spans[40_000] == {"another9_at_place"} and not spans[40_001] and not spans[40_002]
    for i, t in texts.items():
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(t)).encode()).hexdigest()


def test_context_words_of_any_length_and_neighbours_that_are_numbers(spark):
    word = "w" * 500
    rows = [(i, f"{word}a id {i}{i} {word}b") for i in range(3)] + [(7, "77 x@y.zz 12")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", pii.F.xxhash64("text"))
    got = {(r.doc_id, r.value): set(r.patterns) for r in pii.instances(texts, pii.base_spans(texts)).collect()}
    assert got[1, "11"] == {"l:id", f"2:{word}a id", f"r:{word}b", f"b:id {word}b"}
    assert got[7, "77"] == {"l:<s>", "r:<num>", "b:<s> <num>"} and got[7, "12"] == {"l:<num>", "r:</s>", "b:<num> </s>"}


def test_empty_table_and_repeated_rows(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (1, "no"), (None, "a@b.c"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_email, r.spans) for r in pii.personal_data(docs).collect())
    assert got == [(0, 0, ""), (0, 1, "email:0:5"), (1, 0, ""), (1, 1, "email:0:5"), (1, 1, "email:0:5")]
