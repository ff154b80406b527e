import pytest

from vellum.functions import lexicon as x
from vellum.functions.sequences import draws


def test_stems_are_attested():
    known = {"make", "stop", "box", "city", "plan", "plane", "study", "walk"}
    assert [x.stem(w, known) for w in ("making", "stopped", "boxes", "cities", "plane", "planes", "studied", "walks", "glass", "went", "zzing")] == ["make", "stop", "box", "city", "plane", "plan", "study", "walk", "glass", "went", "zzing"]
    assert x.stem("went", known, {"went": "go"}) == "go"
    assert x.stems("I can't be making it’s plans, won't I?", known, stop=frozenset(["i", "it", "be"])) == ["can", "not", "make", "plan", "will", "not"]


def test_glosses_and_leads():
    s = x.Sense
    house, home = s("house", 4.0, frozenset(["house"])), s("home", 2.5, frozenset(["home"]))
    assert x.composed_gloss([house, home]) == "house; home" and x.composed_gloss([house, s("home", 1.0)]) == "house" and x.composed_gloss([]) is None
    assert x.composed_gloss([house, s("a house", 3.0, frozenset(["house"])), home]) == "house; home" and x.composed_gloss([house, s("y" * 45, 3.0)]) == "house"
    assert x.main_word("to (quickly) stay, remain; be") == "stay"
    rows = [("essere", "V", [s("to be", 5.0)]), ("stare", "V", [s("to be", 4.0), s("to stay", 3.5)]), ("casa", "N", [s("to be", 1.0)])]
    assert x.distinct_leads(rows) == ["to be", "to stay; to be", "to be"]


def test_articles():
    it, fr = x.LANGUAGES["it"].articles, x.LANGUAGES["fr"].articles
    assert [x.article_length(w, it) for w in ("il gioco", "l'acqua", "l’acqua", "gioco", "il")] == [3, 2, 2, 0, 0] and x.article_length("l'un", fr) == 0
    assert x.cited_articles("le/la médecin", fr) == ["le", "la"] and x.article_before("allons à l'", fr) == "l'" and x.article_before("vamos a la ", x.LANGUAGES["es"].articles) == "la" and x.article_before("vado a ", it) == ""
    assert len(x.LANGUAGES) == 13
    with pytest.raises(KeyError):
        x.register(x.Language("it"))


def test_readings():
    assert x.shown_reading("в", " В") == "" and x.shown_reading("делать", "де́лать") == "де́лать" and x.shown_reading("a", None) == ""
    assert [x.typed_reading(t, "nǐ hǎo") for t in ("nǐ hǎo", "ni3hao3", "NI3 HAO3", "nihao", "ni2hao3", "ni hai", "")] == ["ok", "ok", "ok", "tones", "tonesDiff", "wrong", "wrong"]
    assert x.typed_reading("lv4", "lǜ") == "ok" and x.joined_readings(["Xī", "ān"]) == "Xī'ān" and x.joined_readings(["か", "な"], False) == "かな"
    assert x.span_reading("越来越", "越", "yuè") == [("越", "yuè"), ("来", ""), ("越", "yuè")] and x.span_reading("一下", "下", "xià", {"一": "yí"}.get) == [("一下", "yíxià")]


def test_pools_examples_and_options():
    chosen, gone = x.folded_pool(["a", "b", "c", "d", "e"], 3, {"b": "a", "d": "c", "e": "z"})
    assert chosen == ["a", "c", "e"] and gone == {"b": "a", "d": "c"}
    assert x.folded_pool(["a", "b"], 2, {"a": "b", "b": "a"}) == (["a"], {"b": "a"})
    assert x.refilled(list("abcde"), 3, lambda w: {"a", "d"}, frozenset("b")) == ["a", "b", "d"]
    got = x.two_examples({"w": [(0, 1), (0, 2), (0, 3)], "v": [(0, 3)], "u": [(1, 3), (0, 2)]})
    assert got["v"] == [3] and got["u"] == [2, 3] and got["w"] == [2, 3]
    same = lambda a, b: a[0] == b[0]
    for seed in range(20):
        options = x.picked_options("a1", [["b1", "b2"], ["c1", "d1", "a2"]], same, 3, draws(seed))
        assert len(options) == 3 and {o[0] for o in options} == set("bcd")
    assert x.least_options({"a1": [["b1", "b2", "c1"]], "a2": [["b1", "c1", "d1"]]}, same) == {"a1": 3, "a2": 4}


def test_plans():
    assert sorted(x.review_kinds(15, False, draws(1))) == ["hear"] * 6 + ["read"] * 3 + ["recall"] * 6
    kinds = x.review_kinds(15, True, draws(1))
    assert kinds.count("recall") == 3 and kinds.count("type") == 3
    for seed in range(10):
        words = {f"w{i}": (i % 5, i % 3) for i in range(30)}
        plan = x.unified_plan(words, {"u1": (9, 0), "u2": (0, 9)}, ["w7", "w8"], {"tone": 1, "glyph": 2}, draws(seed))
        items = [i for _, i in plan]
        assert len(plan) == 15 == len(set(items)) and {"u1", "w7", "w8"} <= set(items) and "u2" not in items
        assert sum(k in ("recall", "type") for k, i in plan if i[0] == "w") >= 0.4 * sum(i[0] == "w" for i in items)


def test_groups_of_paths_and_stars(spark):
    from vellum.operators.graph import groups

    links = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 9)] + [(300, 200), (None, 1), (5, 5)]
    got = {r.item: r.root for r in groups(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(9)}, 200: 200, 300: 200}
