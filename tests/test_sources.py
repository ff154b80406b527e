import bz2
import io
import json
import os
import tarfile

import pytest

from vellum.sources import files, json_lines, tab_separated
from vellum.streaming import records


def test_text_sources(spark, tmp_path):
    (tmp_path / "s.tsv.bz2").write_bytes(bz2.compress("1\tita\tCiao \"a\"\n2\tita\n3\tdeu\tHallo\tx\n".encode()))
    assert [tuple(r) for r in tab_separated(spark, f"file://{tmp_path}/s.tsv.bz2", ["id", "lang", "text"]).collect()] == [("1", "ita", 'Ciao "a"'), ("3", "deu", "Hallo")]
    (tmp_path / "d.jsonl").write_text('{"word":"a","lang":"it"}\n{"word":"b","lang":"de"}\nno "it"\n')
    assert [r.word for r in json_lines(spark, f"file://{tmp_path}/d.jsonl", "word string, lang string", '"it"').collect() if r.word] == ["a"]
    (tmp_path / "f.txt").write_text("di 500\n e 40 \nbad\na b c\nx 1x\n")
    listed = files.frequency_list(spark, f"file://{tmp_path}/f.txt")
    assert sorted(map(tuple, listed.collect())) == [("di", 500), ("e", 40)]
    zipf = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("c", 1.0)], "word string, zipf double")
    assert [tuple(r) for r in files.zipf_counts(zipf, 2).collect()] == [("b", 3.0, 1000.0), ("a", 2.0, 100.0)]


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "links.tar.bz2", "w:bz2") as tar:
        for name, text in (("x/links.csv", "1\t2\n3\t4\n"), ("x/readme", "no")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    assert [r.value for r in files.archive_lines(spark, f"file://{tmp_path}/links.tar.bz2", "links.csv").collect()] == ["1\t2", "3\t4"]


def test_tagged_sentences_make_the_round_trip(spark, tmp_path):
    rows = [(1, [("Ciao", "ciao", "INTJ", None), ("\"x\\", "é", "X", "A=b|C=d")]), (2, [])]
    docs = spark.createDataFrame(rows, files.tagged_schema())
    files.write_tagged(docs, f"file://{tmp_path}/t")
    assert sorted(tuple(r) for r in files.read_tagged(spark, f"file://{tmp_path}/t").collect()) == sorted(tuple(r) for r in docs.collect())
    assert all(p.name.endswith(".gz") for p in (tmp_path / "t").glob("part-*"))


def test_scripts_reports_and_pages(tmp_path):
    value = {"b": ["</script>", "é"], "a": 1}
    script = files.js_constant("WORDS", value) + files.js_constant("N", 3)
    assert "</" not in script and files.constant_of(script, "WORDS") == value and files.constant_of(script, "N") == 3
    with pytest.raises(KeyError):
        files.constant_of(script, "NONE")
    assert files.sorted_json(value) == '{"a":1,"b":["</script>","é"]}\n' and json.loads(files.sorted_json(value, compact=False)) == value
    at = tmp_path / "w.js"
    assert files.write_if_changed(at, script, check=True) and not at.exists() and files.write_if_changed(at, script) and not files.write_if_changed(at, script)
    first = files.with_manual_part("# Report\n1", None)
    mine = first.replace(files.MANUAL[1], "checked by hand\n" + files.MANUAL[1])
    assert "checked by hand" in files.with_manual_part("# Report\n2", mine) and files.with_manual_part("# Report\n2", mine).startswith("# Report\n2")
    page = "<a>\n<!-- css -->\nold\n<!-- /css -->\n</a>"
    assert files.built_page(page, {"css": r"b{c:'\1'}"}) == "<a>\n<!-- css -->\nb{c:'\\1'}\n<!-- /css -->\n</a>"
    with pytest.raises(ValueError):
        files.built_page(page, {"js": ""})
    assert files.without_fields({"audio": 1, "x": [{"audio": 2, "y": 3}]}, frozenset({"audio"})) == {"x": [{"y": 3}]}


def test_packs_are_tables(spark, tmp_path):
    (tmp_path / "pack.json").write_text(json.dumps({"key": "it", "name": "Italian", "levels": [{"id": "A1", "label": "A1"}], "setSize": 10}))
    (tmp_path / "words.json").write_text(json.dumps([{"id": "w1", "w": "casa", "en": "house", "lv": "A1", "alt": ["case"]}, {"id": "w2", "w": "e"}], indent=1))
    (tmp_path / "sentences.json").write_text(json.dumps([{"id": "s1", "t": "La casa.", "words": ["w1"]}]))
    got = files.pack_tables(spark, f"file://{tmp_path}")
    assert [r.w for r in got["words"].orderBy("id").collect()] == ["casa", "e"] and got["pack"].first().levels[0].id == "A1" and got["sentences"].first().words == ["w1"]
    signed = spark.createDataFrame([("a", None), ("a", ""), ("a", "")], "x string, y string").select(files.signature("x", "y").alias("s")).collect()
    assert signed[0].s != signed[1].s == signed[2].s and len(signed[0].s) == 16


def test_streams_fold_records_over_batches(spark, tmp_path):
    schema = "user_id long, k long, ok boolean, prov boolean, ts timestamp, event_id long"
    batches = [[(1, 1, True, True, 1), (1, 1, True, None, 2), (1, 2, False, True, 3), (None, 1, True, None, 4)], [(1, 1, True, None, 5), (1, 2, True, None, 6), (2, 1, None, None, 7)], [(1, 1, False, None, 8)]]
    want = {}
    for n, rows in enumerate(batches):
        for u, k, ok, prov, e in rows:
            if u is not None and ok is not None:
                record, seen = want.get((u, k), ((0, 0, 0, bool(prov)), 0))
                want[u, k] = records.folded(record, [ok]), seen + 1
        text = "".join(json.dumps({"user_id": u, "k": k, "ok": ok, "prov": prov, "ts": f"2024-01-01T00:00:{e:02d}", "event_id": e}) + "\n" for u, k, ok, prov, e in rows)
        (tmp_path / f"{n}.json").write_text(text)
        os.utime(tmp_path / f"{n}.json", (1_700_000_000 + 60 * n,) * 2)  # files arrive in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}")
    got = {(r.user_id, r.k): ((r.r, r.w, r.s, r.prov), r.n) for r in records.caught_up(records.record_stream(stream)).collect()}
    assert got == want and got[1, 1] == ((3, 1, 0, False), 4) and got[1, 2][0][3] is False


def test_batches_are_folded_without_python(spark, tmp_path):
    import random

    draw, want = random.Random(4), {}
    for n in range(4):
        rows = [{"user_id": draw.choice([1, 2, None]), "k": draw.randrange(12), "ok": draw.choice([True, True, True, False, None]), "prov": draw.choice([True, True, None]), "ts": f"2024-01-01T00:00:{draw.randrange(9):02d}", "event_id": 100 * n + i} for i in range(20)]
        for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
            if r["user_id"] is not None and r["ok"] is not None:
                record, seen = want.get((r["user_id"], r["k"]), ((0, 0, 0, bool(r["prov"])), 0))
                want[r["user_id"], r["k"]] = records.folded(record, [r["ok"]]), seen + 1
        (tmp_path / f"{n}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(tmp_path / f"{n}.json", (1_700_000_000 + 60 * n,) * 2)
    stream = spark.readStream.schema("user_id long, k long, ok boolean, prov boolean, ts timestamp, event_id long").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}")
    got = records.caught_up_records(stream)
    assert {(r.user_id, r.k): ((r.r, r.w, r.s, r.prov), r.n) for r in got.collect()} == want
    assert "user_id long, k long, r long, w long, s long, prov boolean, n long" == ", ".join(f"{f.name} {f.dataType.typeName()}" for f in got.schema)


def test_extra_rows_and_rewritten_json(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("b\tB\nbad\na\tA\n")
    extra = files.extra_rows(spark, f"file://{tmp_path}/x.tsv", ["t", "en"], 95_000)
    assert [tuple(r) for r in extra.orderBy("id").collect()] == [(95_000, "b", "B"), (95_001, "a", "A")]
    corpus = spark.createDataFrame([(1, "c")], "id long, t string")
    assert files.with_extra_rows(corpus, extra).count() == 3
    with pytest.raises(ValueError):
        files.with_extra_rows(spark.createDataFrame([(95_000, "c")], "id long, t string"), extra)
    text = '{\n  "a": {"script": [1,2]},\n "script" : [ 1,\n 2 ],   "z":"}"\n}\n'
    assert files.rewritten_json(text, {"script": {"x": "é"}}) == text.replace("[ 1,\n 2 ]", '{"x": "é"}')
    with pytest.raises(KeyError):
        files.rewritten_json(text, {"none": 1})


def test_command_line(spark, tmp_path, capsys):
    from vellum.__main__ import main

    assert main(["list"]) == 0 and "record_fold" in capsys.readouterr().out
    assert main(["sql", "record_fold"]) == 0 and "GROUP BY" in capsys.readouterr().out
    assert main(["compare", "level_bands", "--data", "/root/testdata/sf0.001"]) == 0
    assert main(["run", "level_bands", "--data", "/root/testdata/sf0.001", "--out", f"file://{tmp_path}/out"]) == 0 and spark.read.parquet(f"file://{tmp_path}/out").count() == 200
    with pytest.raises(SystemExit):
        main(["run"])
