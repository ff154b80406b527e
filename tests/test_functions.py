import random
from unicodedata import normalize

import pytest

from vellum.functions import sequences as q
from vellum.functions import text as t


def test_accents_fold_by_script():
    for s, want in {"молоко́": "молоко", "ёж": "еж", "мой": "мой", "कि": "कि", "が": "が", "perché": "perche", "مَـا": "ما", "می\u200cروم": "میروم", "x\u0304": "x", "й\u0301": "й"}.items():
        assert t.fold_accents(s) == want
    assert t.fold_accents("ज़रा") == normalize("NFC", "ज़रा") and t.fold_letters("ज़रा") == "जरा" and t.fold_letters("أمس") == "امس"
    assert t.pointing_key("за́мок") == "замок" and t.pointing_key("está") == "está" and t.pointing_key("أ") == "أ"


def test_typed_answers():
    a = t.Answers({"1": ["perché"], "2": ["l'acqua"], "3": ["sí"], "4": ["si"], "5": ["ماء"], "6": ["ما"], "7": ["за́мок"], "8": ["замо́к"], "9": ["أمس", "gestern"]})
    assert [a.accepts(x, "1") for x in ("perche", "PERCHÉ", "perchè", " ")] == [True, True, True, False]
    assert [a.accepts(x, "1", lenient=False) for x in ("perche", "perchè", "Perché")] == [False, False, True]
    assert a.accepts("l’acqua", "2") and not a.accepts("si", "3") and not a.accepts("s\u200di", "3") and a.accepts("sí", "3")
    assert not any(a.accepts(x, "5") for x in ("مَا", "مـا", "ما")) and a.accepts("امس", "9") and a.accepts("Gestern", "9")
    assert a.accepts("замок", "7") and not a.accepts("замо́к", "7")
    de = t.Answers({"1": ["müde"], "2": ["schon"], "3": ["schön"], "4": ["Straße"]}, german=True)
    assert de.accepts("Muede", "1") and de.accepts("mude", "1") and not de.accepts("schon", "3") and de.accepts("Strasse", "4") and de.accepts("schoen", "3")


def test_search_keys_and_tiers():
    assert t.search_key("धीरे-धीरे") == t.search_key("धीरे धीरे") == t.search_key("धीरे") and t.search_key("едва едва") == "едва" and t.search_key("高高") == "高高"
    assert t.search_key("بڑے") == t.search_key("بڑی") and t.search_key("پھول") != t.search_key("پہول") and t.search_key("kahã") == "kahan"
    assert [t.search_tier(x, ["casa"], ["to house", "home"]) for x in ("Casa", "house", "cas", "hom", "zzz")] == [0, 1, 2, 3, None]
    assert t.search_tier("كتاب", ["الكتاب"], ["book"]) == 0


def test_surfaces_and_blanks():
    assert t.surface_hits("L’acqua e l'acqua; acquario", "acqua") == [(2, 7), (12, 17)] and t.surface_hits("l’acqua", "l'") == [(0, 2)]
    assert t.surface_hits("می\u200cروم می", "می") == [(7, 9)] and t.surface_hits("不不不", "不不", spaced=False) == [(0, 2)]
    assert t.located("Bevo l'acqua.", ["l'acqua", "acqua"]) == (5, 12) and t.located("acqua e acqua", ["acqua"]) is None and t.located("x", ["acqua"]) is None
    assert t.blank_of("Grazie per favore", ["per"], ["per favore"]) is None and t.blank_of("Vado per te", ["per"], ["per favore"]) == (5, 8) and t.blank_of("不客气。", ["不客气"], [], False) is None


def test_runs_marks_and_places():
    assert t.rtl_runs("say کا/کی now (کے).") == [("say ", False), ("کا/کی", True), (" now (", False), ("کے", True), (").", False)] and t.rtl_runs(None) == []
    assert t.utf16_place("a😀b", 2) == 3 and t.with_marks("لطفاً و", 0, 4) == (0, 5) and t.without_marks("ção") == "cao"
    assert t.syllable_tone("nǚ") == ("nü", 3) and t.syllable_tone("ma") == ("ma", 5) and [t.marked_syllable(*x) for x in (("lü", 4), ("gou", 3), ("xiao", 3), ("liu", 2))] == ["lǜ", "gǒu", "xiǎo", "liú"]
    assert t.kana_key("カタカナ") == "かたかな" and all(t.hangul_syllable(*t.hangul_parts(c)) == c for c in "한국말힣가") and t.hangul_parts("a") is None


def test_genders_and_articles():
    assert t.gender_of("f,m<l:archaic>") == ("f", False)
    assert [t.italian_article(*x) for x in (("zio", "m"), ("acqua", "f"), ("collega", "mf"), ("soldi", "m", True), ("studente", "m"), ("casa", "f"), ("amici", "m", True))] == ["lo zio", "l'acqua", "il/la collega", "i soldi", "lo studente", "la casa", "gli amici"]


def test_segmenting_is_the_best_of_all_cuts():
    rng = random.Random(1)
    for _ in range(200):
        words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 3))): 0 for _ in range(4)}
        s = "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))

        def cuts(x):
            if not x:
                yield []
            for k in range(1, len(x) + 1):
                if k == 1 or x[:k] in words:
                    for rest in cuts(x[k:]):
                        yield [(x[:k], x[:k] in words), *rest]

        best = min((sum(not known for _, known in c), len(c)) for c in cuts(s))
        got = q.segmented(s, words)
        assert "".join(p for p, _ in got) == s
        assert (sum(len(p) for p, k in got if k is None), sum(1 if k is not None else len(p) for p, k in got)) == best
        assert not any(x[1] is None and y[1] is None for x, y in zip(got, got[1:]))
    assert [p for p, _ in q.segmented("朋友们很高兴", {"朋友": 0, "们": 1, "很": 0, "高兴": 0})] == ["朋友", "们", "很", "高兴"]


def test_readings_merges_and_phrases():
    lex = {"好": "hǎo", "好看": "hǎokàn", "看": "kàn"}
    assert q.reading_of("好看x", lex) == [("好看", "hǎokàn"), ("x", None)] and q.reading_of("看好", lex, alone=frozenset("好")) == [("看", "kàn"), ("好", None)]
    assert q.merged_tokens("你是不是好", ["你", "是", "不", "是", "好"], {"是不是", "不是"}) == [("你", 0), ("是不是", 1), ("好", 4)]
    assert q.merged_tokens("是 不是", ["是", "不", "是"], {"是不是", "不是"}) == [("是", 0), ("不是", 2)]
    toks = lambda s: [(w, w in ",.") for w in s.split()]
    assert q.phrase_matches(toks("A pesar del mal tiempo , salimos ."), ["a pesar de"], {"del": ("de", "el")}) == (["a pesar de"], {0, 1}, {2: ["el"]})
    assert q.phrase_matches(toks("Por favor toma un descanso por unos días ."), ["por favor"])[:2] == (["por favor"], {0, 1})
    assert q.phrase_matches(toks("Dijo por , favor ."), ["por favor"])[0] == []
    cue = {"de nada": {"welcome"}}
    assert q.phrase_matches(toks("No la conozco de nada ."), ["de nada"], cues=cue, english="not at all")[0] == [] and q.phrase_matches(toks("De nada ."), ["de nada"], cues=cue, english="You're welcome.")[0] == ["de nada"]
    assert q.phrase_matches(toks("Muchas gracias ."), ["gracias", "muchas gracias"])[0] == ["muchas gracias"]


def test_tokens_are_aligned():
    s = "«Buongiorno! L'amico compra le mele.»"
    places = q.aligned(s, ["«", "buongiorno", "!", "l'", "amico", "compra", "le", "mele", ".", "»"])
    assert [s[a:b] for a, b in places] == ["«", "Buongiorno", "!", "L'", "amico", "compra", "le", "mele", ".", "»"]
    assert q.aligned("Vengo del mercato.", ["Vengo", "dello", "mercato", "."]) == [(0, 5), None, (10, 17), (17, 18)]
    assert q.aligned("aa bb", ["bb"]) == [None] and q.aligned("Lui va a casa e va via.", ["Lui", "va", "a", "casa"])[1] == (4, 6)


def test_spans_floors_and_pruning():
    assert q.longest_first("per favore 😀 si", [(4, 10, "b"), (0, 10, "a"), (13, 15, "c"), (10, 11, "d")]) == [(0, 10, "a"), (14, 16, "c")]
    assert q.floored(list("abcde"), {"a": 3}) == list("bcdae") and q.floored(list("abcde"), {"d": 1}) == list("abcde")
    assert q.pruned({"a": set("bcd"), "b": set("acd"), "c": set("abd"), "d": set("abc"), "e": set("ab")}, 3).keys() == set("abcd") and q.pruned({"a": set("bc"), "b": set("ac"), "c": set("ab")}, 3) == {}
    forms = {"gatti": ["gattino", "gatto"], "gattino": ["x"], "a": ["b"], "b": ["c"], "c": ["d"], "d": ["gatto"]}
    assert q.chased("gatti", {"gatto"}.__contains__, forms) == "gatto" and q.chased("a", {"gatto"}.__contains__, forms) is None and q.chased("b", {"gatto"}.__contains__, forms) == "gatto"


def test_seeded_choices():
    assert q.seed_of("a") == 0xE40C292C and q.draws(1)() == pytest.approx(0.6270739405881613)
    for n in range(1, 9):
        for attempt in range(4):
            now = q.heard_questions("p7", attempt, n)
            assert len(now) == -(-n // 2) and now == sorted(set(now)) and (n < 2 or now != q.heard_questions("p7", attempt + 1, n))
    draw = q.draws(5)
    kinds = [q.weighted({"a": 1, "b": 3}, draw) for _ in range(4000)]
    assert 0.7 < kinds.count("b") / 4000 < 0.8 and sorted(q.shuffled(range(9), draw)) == list(range(9))
