from vellum.functions import resolver as x

LEX = x.Lexicon(
    entries={"VERB": {"essere", "portare", "dire", "giurare", "cariare", "crear", "creer", "fare", "vedere"}, "NOUN": {"porta", "ancora", "schiavo", "casa", "fiera", "signora", "giorno"}, "ADJ": {"fiero", "carino"}, "ADV": {"ancora"}, "NUM": {"sei"}},
    forms={("sei", "VERB"): ["essere"], ("sono", "VERB"): ["essere"], ("fiera", "ADJ"): ["fiero"], ("porta", "VERB"): ["portare"], ("giuro", "VERB"): ["giurare"], ("carino", "VERB"): ["cariare"], ("crees", "VERB"): ["creer", "crear"], ("case", "NOUN"): ["casa"], ("giorni", "NOUN"): ["giorno"], ("far", "VERB"): ["fare"], ("vedo", "VERB"): ["vedere"], ("xa", "NOUN"): ["xb"], ("xb", "NOUN"): ["case"]},
    zipf={"essere": 7.0, "portare": 5.0, "carino": 4.5, "cariare": 1.0, "giurare": 4.0, "dire": 6.5, "fare": 6.6, "fiero": 3.5, "casa": 5.5, "porta": 5.0, "ancora": 5.5, "schiavo": 3.4, "giorno": 5.8, "vedere": 6.0, "signora": 4.0, "sei": 5.0, "fiera": 3.6},
    tags={("porta", "portare"): {"Mood=Imp", "Person=2"}, ("crees", "creer"): {"Person=2", "Mood=Ind"}, ("crees", "crear"): {"Person=2", "Mood=Sub"}}, votes={"creer": 40, "crear": 4},
    closed={"contigo": ("tú", "PRON")}, contractions={"sulla": "su", "del": "di"}, articles={"il": frozenset(["il", "lo", "la", "l'", "gli", "i", "le"])}, enclitics=("lo", "la", "mi", "ti", "ci", "gli", "glielo"), clipped={"di": "dire", "fa": "fare"},
    copulas=frozenset(["essere"]), object_clitics=frozenset(["lo", "mi", "ti"]),
)


def sentence(s):
    return [x.Token(*(w.split("/") + [""] * 2)[:4]) if w.count("/") > 1 else x.Token(w.split("/")[0], w.split("/")[0].lower(), w.split("/")[1]) for w in s.split()]


def test_cascade():
    one = lambda *a: LEX.reading(x.Token(*a))
    assert one(".", ".", "PUNCT") is None and one("12", "12", "NUM") is None and one("Contigo", "contigo", "PROPN") == ("tú", "PRON") and one("Roma", "Roma", "PROPN") == ("roma", "PROPN")
    assert one("sulla", "su il", "ADP") == ("su", "ADP") and one("gli", "il", "DET") == ("il", "DET") and one("giorni", "giorno", "NOUN", "Number=Plur") == ("giorno", "NOUN") and one("case", "casa", "NOUN") == ("casa", "NOUN")
    assert one("xa", "?", "NOUN") == ("casa", "NOUN") and one("giuro", "giuro", "NOUN") == ("giurare", "VERB") and one("blabla", "blabla", "NOUN") == ("blabla", "NOUN")


def test_verbs():
    assert LEX.verb_with_enclitics("farlo") == "fare" and LEX.verb_with_enclitics("dimmi") == "dire" and LEX.verb_with_enclitics("fallo") == "fare" and LEX.verb_with_enclitics("casa") is None
    assert LEX.reading(x.Token("carino", "cariare", "VERB")) == ("carino", "ADJ")
    assert LEX.verb_of("crees", "crear", "Mood=Ind|Person=2") == "creer" and LEX.verb_of("crees", "creer", "Mood=Sub|Person=2") == "crear" and LEX.verb_of("crees", "crear", "") == "creer"


def test_rules_of_neighbours():
    first = lambda s, i: x.resolved(LEX, sentence(s))[i]
    assert first("Sei/NUM sicuro/ADJ ?/PUNCT", 0) == ("essere", "VERB") and first("alle/ADP sei/NUM", 1) == ("sei", "NUM") and first("sei/NUM belle/ADJ case/NOUN", 0) == ("sei", "NUM")
    assert first("sono/AUX molto/ADV fiera/NOUN", 2) == ("fiero", "ADJ") and first("una/DET fiera/NOUN", 1) == ("fiera", "NOUN")
    assert first("Lo/PRON schiavo/VERB", 0) == ("il", "DET") and first("Lo/PRON vedo/VERB", 0) != ("il", "DET")
    assert first("Porta/NOUN un/DET ombrello/NOUN", 0) == ("portare", "VERB") and first("la/DET porta/NOUN", 1) == ("porta", "NOUN")
    assert first("Lo/PRON giuro/NOUN", 1) == ("giurare", "VERB") and first("l'/DET ancora/ADV", 1) == ("ancora", "NOUN")
    assert x.resolved(LEX, sentence("casa/NOUN"), lambda r: r + [None]) == [("casa", "NOUN"), None]


def test_links_genders_and_passages():
    toks = [x.Token("la", "il", "DET", "Gender=Fem|Number=Sing"), x.Token("bella", "bello", "ADJ"), x.Token("casa", "casa", "NOUN")]
    assert x.governing_gender(toks, 2) == "f" and x.governing_gender(toks, 0) is None
    assert x.linked([("casa", "NOUN"), None, ("fare", "VERB"), ("casa", "NOUN")], {("casa", "NOUN"): "w1", ("fare", "VERB"): "w2"}) == ["w1", "w2"]
    assert x.reflexive_labels([(["a", "b"], {"a"}), (["a"], set()), (["a", "b"], {"a"})], {"a", "b", "c"}) == {"a"}
    levels = {"a": 0, "b": 1, "c": 2}
    assert x.passage_problems(["a"] * 48 + ["b", None], levels, 0) == [] and x.passage_problems(["a"] * 40 + [None] * 10, levels, 0) == ["coverage"] and x.passage_problems(["a", "c"], levels, 0) == ["length", "coverage", "level"]
    assert x.usage([sentence("la/DET casa/NOUN"), sentence("casa/NOUN")], LEX)["casa"] == {("casa", "NOUN"): 2}
