import glob
import os

import duckdb
import pytest

from vellum import catalog
from vellum.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def told(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_rows_are_those_of_the_sql(spark, duck, name):
    df, want = catalog.queries()[name](spark, SF), duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert told(df.columns, df.collect()) == told(want.columns, want.fetchall())


def test_means_that_are_a_half_exactly_round_up(spark, tmp_path):
    # Right answers of all, by item; the mean of the percentages is 37.5, 62.5, 62.5 and, just below a half, 37.4.
    means = [([(1, 6), (2, 12), (3, 9), (10, 12)], 38), ([(3, 6), (3, 11), (5, 12), (9, 11), (10, 11), (10, 12)], 63), ([(1, 6), (9, 12), (9, 12), (10, 12)], 63), ([(187, 500)], 37)]
    users = [(u, items[u % len(items) :] + items[: u % len(items)], score) for u in range(240) for items, score in [means[u % 4]]]
    rows = [(u, f'{{"k": {u * 7 + k}}}', "view" if i < right else "error") for u, items, _ in users for k, (right, n) in enumerate(items) for i in range(n)]
    df = spark.createDataFrame(rows, "user_id long, props string, event_type string").selectExpr("monotonically_increasing_id() AS event_id", "timestamp'2024-01-01' AS ts", "*")
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()["reading_stats"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(u, len(items), score) for u, items, score in users]


def test_spanned_tokens_shuffles_no_row_for_each_word(spark):
    plan = catalog.queries()["spanned_tokens"](spark, SF)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_entry_without_the_training_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def metrics(df, name, kind=""):
    """Sum of a metric over the steps of a query that has run, of those whose name holds kind."""
    steps, total = [df._jdf.queryExecution().executedPlan()], 0
    while steps:
        step = steps.pop()
        if step.nodeName() == "AdaptiveSparkPlan":
            steps.append(step.executedPlan())
        elif "QueryStage" in step.nodeName():
            steps.append(step.plan())
        children = step.children()
        steps += [children.apply(i) for i in range(children.size())]
        found = step.metrics().get(name)
        total += found.get().value() if kind in step.nodeName() and found.isDefined() else 0
    return total


def test_distractors_are_found_without_meeting_all_of_their_class(spark, tmp_path):
    # Few names and types, so that a part's own bar many of the least; sizes and keys that are null, keys that repeat, and a class of one name.
    rows = [(i % 2900 if i % 37 else None, f"n{i * i % 7 if i % 5 else 0}" if i % 41 else None, ["A", "B", None][i * 7 % 1000 // 450], "t" + str(i // 50 % 3), i * 13 % 50 if i % 29 else None) for i in range(3000)]
    rows += [(3000 + i, "same", "C", f"t{i % 4}", i % 9) for i in range(200)]
    df = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    df.write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["distractor_pool"])
    got = catalog.queries()["distractor_pool"](spark, str(tmp_path))
    assert told(got.columns, got.collect()) == told(want.columns, want.fetchall())
    df.selectExpr("p_partkey * 50 AS p_partkey", "p_name", "'A' AS p_brand", "p_type", "p_size % 2 AS p_size").write.parquet(f"{tmp_path}/asking/part.parquet")
    got = catalog.queries()["distractor_pool"](spark, f"{tmp_path}/asking")
    assert len(got.collect()) > 5000 and metrics(got, "numOutputRows", "Join") < 200 * df.count()


@pytest.mark.parametrize("most", [plans.MOST_BROADCAST_HASHES, 1])
def test_overlapping_spans_are_found_without_a_row_for_each_word(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(plans, "MOST_BROADCAST_HASHES", most)
    monkeypatch.setattr(plans, "DOCS_AT_ONCE", 16)
    words = ["Alt", "bach", "Çoban", "dorf", "eis", "Fön", "gut"]
    texts = [" ".join(words[(i * i + j * j * (i % 5 + 1)) % 7] + (". " if j % 9 == i % 9 else "") for j in range(60)) + (f" rar{i}" if i % 3 else "\n!") for i in range(40)]
    # One text twice under an id and another three times, a null id, texts that are empty or null.
    rows = list(enumerate(texts)) + [(3, texts[3]), (7, texts[7]), (7, texts[7]), (None, texts[5]), (50, ""), (51, None), (52, "eis")]
    df = spark.createDataFrame([(i, t, "de", "web") for i, t in rows], "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["span_overlap_violations"])
    got = catalog.queries()["span_overlap_violations"](spark, str(tmp_path))
    assert told(got.columns, got.collect()) == told(want.columns, want.fetchall())
    if most > 1:
        df = spark.createDataFrame([(i, t, "de", "web") for i, t in enumerate(texts * 20)], df.schema)
        df.write.parquet(f"{tmp_path}/more/documents.parquet")
        got = catalog.queries()["span_overlap_violations"](spark, f"{tmp_path}/more")
        assert len(got.collect()) == 800 and metrics(got, "shuffleRecordsWritten", "Exchange") < 2000
