import zlib

import numpy as np
from py4j.java_gateway import get_field

from vellum.llm import tokens
from vellum.llm.queries import tokenizer_path

TEXTS = ["", None, "Plain words, and more!", "İstanbul ΣΑΣ ñandú… ***! it's IT'S 3.14!! <|endoftext|> <|ENDOFTEXT|>! a<|startoftext|>b", "tab\tand\x0bnew\nline\x1cone\xa0two\x85three", "é ́x", "!!! ... a*** 9$ é***", "x" * 3000, "word " * 5000]


def brute(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def test_ids_are_the_tokenizers(spark, tmp_path):
    docs = spark.createDataFrame([(100 - i, t, "x", 7) for i, t in enumerate(TEXTS)], "doc_id int, text string, first string, ids int")
    path = f"file://{tmp_path}/t"
    tokens.write_tokens(docs, path, tokenizer_path())
    want = dict(zip((100 - i for i in range(len(TEXTS))), brute(TEXTS)))
    assert {r.doc_id: r.ids for r in tokens.read_tokens(spark, path).collect()} == want
    start = 0
    for r in sorted(tokens.token_digests(spark, path).collect()):
        ids = np.array(want[r.doc_id], "<u4")
        assert tuple(r) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = tokens.read_tokens(spark, path).where("doc_id = 97")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,97)]" in one._jdf.queryExecution().toString() and one.count() == 1


def test_files_have_bloom_filters_and_row_indexes_that_prune(spark, tmp_path):
    docs = spark.createDataFrame([((1 << 40) + 2 * i, f"text {i}") for i in range(60_000)], "doc_id long, text string").coalesce(1)
    tokens.write_tokens(docs, f"file://{tmp_path}/t", tokenizer_path())
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile
    pruned = 0
    for f in (tmp_path / "t").glob("*.orc"):
        r = reader.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), reader.readerOptions(conf))
        assert r.getRowIndexStride() == tokens.ROWS_IN_INDEX and r.getCompressionKind().toString() == "ZSTD"
        build = jvm.org.apache.hadoop.hive.ql.io.sarg.SearchArgumentFactory.newBuilder
        kind = jvm.org.apache.hadoop.hive.ql.io.sarg.PredicateLeaf.Type.LONG

        def rows_read(doc_id):
            found = r.rows(r.options().searchArgument(build().equals("doc_id", kind, doc_id).build(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)).allowSARGToFilter(False))
            batch, n = r.getSchema().createRowBatch(), 0
            while found.nextBatch(batch):
                n += get_field(batch, "size")
            return n

        whole = r.getNumberOfRows()
        if whole:
            low, high = spark.read.orc(str(f)).selectExpr("min(doc_id)", "max(doc_id)").first()
            inside = low + 2 * (whole // 2)
            # An id that is there costs a row group at most; an odd one within the range is told by the Bloom filter alone.
            assert 0 < rows_read(inside) <= tokens.ROWS_IN_INDEX and rows_read(high + 100) == 0
            pruned += sum(rows_read(inside + k) == 0 for k in (1, 3, 5, 7, 9))
    assert pruned >= 4


def test_ids_of_a_whole_table_are_the_tokenizers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids, start = dict(zip(texts, brute(texts.values()))), 0
    got = {r.doc_id: r for r in tokens.encoded(docs, tokenizer_path()).collect()}
    for i in sorted(texts):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()))
        start += len(ids[i])


def test_files_are_ordered_by_their_numbers(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w " * i) for i in range(12)], "doc_id long, text string")
    tokens.write_tokens(docs.where("doc_id < 6"), f"file://{tmp_path}/a", tokenizer_path())
    tokens.write_tokens(docs.where("doc_id >= 6"), f"file://{tmp_path}/b", tokenizer_path())
    first = [f for f in sorted((tmp_path / "a").glob("part-*.orc"))]
    (tmp_path / "t").mkdir()
    for n, f in enumerate(first):
        f.rename(tmp_path / "t" / f"part-{99_990 + n}-x.zstd.orc")
    for n, f in enumerate(sorted((tmp_path / "b").glob("part-*.orc"))):
        f.rename(tmp_path / "t" / f"part-{100_000 + n}-x.zstd.orc")
    got = sorted(tuple(r)[:2] for r in tokens.token_digests(spark, f"file://{tmp_path}/t").collect())
    sizes = [len(x) for x in brute(["w " * i for i in range(12)])]
    assert got == [(i, sum(sizes[:i])) for i in range(12)]


def test_empty_table_repeated_and_missing_ids(spark):
    assert tokens.encoded(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    got = [tuple(r)[:3] for r in tokens.encoded(docs, tokenizer_path()).collect()]
    assert sorted(got, key=lambda r: r[1]) == [(None, 0, 2), (1, 2, 3), (1, 5, 3), (2, 8, 1)]
