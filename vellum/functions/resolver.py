"""Readings of tagged tokens: a dictionary with pointers, a cascade for one token, and rules that look at its neighbours."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from .sequences import chased

#: Classes that have no reading; a common reading must be this much commoner (zipf) than a rare one, and how rare that is.
SILENT, RARE, MARGIN = frozenset(["PUNCT", "SYM", "SPACE", "X"]), 2.5, 1.5
#: How much more often a verb must be used to win over the tagger's, and over what the form's person or mood tells.
USED, STRONG = 3.0, 18.0
CLAUSE = frozenset([".", "!", "?", "…", ":", ";"])

Reading = tuple[str, str]


@dataclass(frozen=True)
class Token:
    text: str
    lemma: str
    upos: str
    morph: str = ""


@dataclass
class Lexicon:
    """entries: usable lemmas of each class; forms: (surface, class) to lemmas, best first; tags: (surface, verb) to what the form is."""

    entries: Mapping[str, set[str]]
    forms: Mapping[tuple[str, str], Sequence[str]] = field(default_factory=dict)
    zipf: Mapping[str, float] = field(default_factory=dict)
    tags: Mapping[Reading, set[str]] = field(default_factory=dict)
    votes: Mapping[str, int] = field(default_factory=dict)
    closed: Mapping[str, Reading] = field(default_factory=dict)
    contractions: Mapping[str, str] = field(default_factory=dict)
    articles: Mapping[str, frozenset[str]] = field(default_factory=dict)
    enclitics: tuple[str, ...] = ()
    clipped: Mapping[str, str] = field(default_factory=dict)
    copulas: frozenset[str] = frozenset()
    object_clitics: frozenset[str] = frozenset()

    def candidates(self, surface: str, group: str) -> set[str]:
        """Lemmas of the class that a surface is or points to, over up to three pointers."""
        known = self.entries.get(group, set())
        found = {surface} & known
        pointers = {s: list(t) for (s, g), t in self.forms.items() if g == group}
        return found | {r for t in pointers.get(surface, ()) if (r := chased(t, known.__contains__, pointers))}

    def commonest(self, lemmas) -> str:
        return max(lemmas, key=lambda w: (self.zipf.get(w, 0.0), w))

    def readings(self, surface: str) -> list[Reading]:
        return sorted((w, g) for g in self.entries for w in self.candidates(surface, g))

    def verb_with_enclitics(self, surface: str) -> str | None:
        """The verb of a form with one or two pronouns at its end; a clipped imperative doubles their consonant."""
        rest = surface
        for _ in range(2):
            tail = next((c for c in sorted(self.enclitics, key=len, reverse=True) if rest.endswith(c) and len(rest) > len(c)), None)
            if tail is None:
                return None
            rest = rest[: -len(tail)]
            if rest[-1] == tail[0] and rest[:-1] in self.clipped:
                return self.clipped[rest[:-1]]
            for stem in (rest, rest + "e", rest[:-1] + "re" if rest.endswith("r") else ""):
                if len(stem) > 1 and (verbs := self.candidates(stem, "VERB")):
                    return self.commonest(verbs)
        return None

    def verb_of(self, surface: str, lemma: str, morph: str) -> str:
        """Of the verbs that a surface is a form of: the one whose person, else mood, alone fits, else one used far more often, else the tagger's."""
        verbs = self.candidates(surface, "VERB")
        if len(verbs) < 2 or lemma not in verbs:
            return lemma
        used = lambda v: self.votes.get(v, 0)
        best, pick = max(verbs, key=lambda v: (used(v), self.zipf.get(v, 0.0), v)), None
        if all((surface, v) in self.tags for v in verbs):
            told = [part for part in morph.split("|") if part.split("=")[0] in ("Person", "Mood")]
            for part in sorted(told, reverse=True):
                fits = [v for v in verbs if part in self.tags[surface, v]]
                if len(fits) == 1:
                    pick = fits[0]
                    break
        if pick is None:
            pick = best if used(best) >= USED * max(1, used(lemma)) else lemma
        return best if used(best) >= STRONG * max(1, used(pick)) else pick

    def token_reading(self, t: Token) -> Reading | None:
        """The cascade for one token: closed forms, names, contractions, articles, the class's candidates, enclitics, then other classes."""
        s, lemma, g = t.text.lower(), t.lemma.lower().split(" ")[0], t.upos
        if g in SILENT or not any(c.isalpha() for c in s) or any(c.isdigit() for c in s):
            return None
        if s in self.closed:
            return self.closed[s]
        if g == "PROPN":
            return s, g
        if s in self.contractions:
            return self.contractions[s], "ADP"
        if g == "DET" and s in self.articles.get(lemma, ()):
            return lemma, g
        own = self.candidates(s, g)
        if g == "NOUN" and "Number=Plur" in t.morph and lemma != s and lemma in self.entries.get(g, ()):
            return lemma, g
        for choice in ([s] if g in ("NOUN", "VERB") else []) + [lemma]:
            if choice in own:
                return choice, g
        if own:
            return self.commonest(own), g
        if verb := self.verb_with_enclitics(s):
            return verb, "VERB"
        if lemma in self.entries.get(g, ()):
            return lemma, g
        other = self.readings(s)
        return max(other, key=lambda r: (self.zipf.get(r[0], 0.0), r)) if other else (lemma or s, g)

    def reading(self, t: Token) -> Reading | None:
        """token_reading(), verb homographs settled, and a rare reading given up for a far commoner one of another class."""
        r = self.token_reading(t)
        if r and r[1] == "VERB":
            r = self.verb_of(t.text.lower(), r[0], t.morph), "VERB"
        if r and r[1] != "PROPN" and self.zipf.get(r[0], 0.0) < RARE:
            others = [x for x in self.readings(t.text.lower()) if x[1] != r[1] and self.zipf.get(x[0], 0.0) >= self.zipf.get(r[0], 0.0) + MARGIN]
            r = max(others, key=lambda x: (self.zipf.get(x[0], 0.0), x), default=r)
        return r


def _verbs(lex: Lexicon, t: Token) -> Reading | None:
    verbs = lex.candidates(t.text.lower(), "VERB")
    return (lex.commonest(verbs), "VERB") if verbs else None


def numeral_or_verb(lex: Lexicon, toks: Sequence[Token], i: int) -> Reading | None:
    """A numeral that is a verb form, with no noun after it or a pronoun before it, is the verb."""
    t = toks[i]
    if t.upos != "NUM" or not t.text.isalpha():
        return None
    before = next((x.upos for x in reversed(toks[:i]) if x.upos != "PUNCT"), None)
    after = next((x.upos for x in toks[i + 1 :] if x.upos not in ("PUNCT", "ADJ")), None)
    asked = (i == 0 or toks[i - 1].text in CLAUSE) and next((x.text for x in toks[i:] if x.text in CLAUSE), "") == "?"
    counts = after in ("NOUN", "NUM", "PROPN")
    return _verbs(lex, t) if before not in ("ADP", "DET") and (before == "PRON" or not counts or asked) else None


def adjective_after_copula(lex: Lexicon, toks: Sequence[Token], i: int) -> Reading | None:
    """A noun right after a copula, adverbs aside, is the adjective that it may be."""
    j = i - 1
    while j >= 0 and toks[j].upos == "ADV":
        j -= 1
    adjectives = lex.candidates(toks[i].text.lower(), "ADJ") if toks[i].upos == "NOUN" and j >= 0 and toks[j].upos in ("AUX", "VERB") else ()
    verb = lex.reading(toks[j]) if adjectives else None
    return (lex.commonest(adjectives), "ADJ") if verb and verb[0] in lex.copulas else None


def article_for_pronoun(lex: Lexicon, toks: Sequence[Token], i: int) -> Reading | None:
    """A pronoun in an article's form before a word that is a noun and no verb is the article."""
    low = toks[i].text.lower()
    lemma = next((a for a, forms in lex.articles.items() if low in forms), None)
    follower = next((x for x in toks[i + 1 : i + 3] if x.upos != "ADJ"), None)
    if toks[i].upos != "PRON" or lemma is None or follower is None or follower.upos == "PUNCT":
        return None
    noun, verb = (lex.candidates(follower.text.lower(), g) for g in ("NOUN", "VERB"))
    return (lemma, "DET") if noun and not verb else None


def imperative_at_start(lex: Lexicon, toks: Sequence[Token], i: int) -> Reading | None:
    """A noun that begins a clause before a determiner is the imperative that it may be."""
    starts = i == 0 or toks[i - 1].text in CLAUSE
    if toks[i].upos != "NOUN" or not starts or i + 1 >= len(toks) or toks[i + 1].upos != "DET":
        return None
    verbs = [v for v in lex.candidates(toks[i].text.lower(), "VERB") if {"Mood=Imp", "Person=2"} <= lex.tags.get((toks[i].text.lower(), v), set())]
    return (lex.commonest(verbs), "VERB") if verbs else None


def verb_after_clitic(lex: Lexicon, toks: Sequence[Token], i: int) -> Reading | None:
    """No noun follows an object pronoun: it is the verb, if it is no adjective either."""
    if toks[i].upos != "NOUN" or not i or toks[i - 1].upos != "PRON" or toks[i - 1].text.lower() not in lex.object_clitics:
        return None
    return None if lex.candidates(toks[i].text.lower(), "ADJ") else _verbs(lex, toks[i])


def noun_after_article(lex: Lexicon, toks: Sequence[Token], i: int) -> Reading | None:
    """Right after an article a word is the noun that it may be."""
    forms = frozenset().union(*lex.articles.values()) if lex.articles else frozenset()
    if toks[i].upos not in ("ADV", "VERB") or not i or toks[i - 1].upos != "DET" or toks[i - 1].text.lower() not in forms:
        return None
    nouns = lex.candidates(toks[i].text.lower(), "NOUN")
    return (lex.commonest(nouns), "NOUN") if nouns else None


#: In their order; the first that tells decides.
RULES: tuple[Callable[[Lexicon, Sequence[Token], int], Reading | None], ...] = (
    numeral_or_verb, adjective_after_copula, article_for_pronoun, imperative_at_start, verb_after_clitic, noun_after_article,
)


def resolved(lex: Lexicon, toks: Sequence[Token], post: Callable[[list], list] = lambda readings: readings) -> list[Reading | None]:
    """Readings of a sentence: the first rule that tells, else the token's own; then what a language does with them all."""
    out = []
    for i, t in enumerate(toks):
        out.append(next((r for rule in RULES if (r := rule(lex, toks, i))), None) or lex.reading(t))
    return post(out)


def governing_gender(toks: Sequence[Token], i: int) -> str | None:
    """m or f, as the determiner or preposition before a noun tells, adjectives between them aside."""
    j = i - 1
    while j >= 0 and toks[j].upos == "ADJ":
        j -= 1
    if j < 0 or toks[j].upos not in ("DET", "ADP"):
        return None
    return {"Gender=Masc": "m", "Gender=Fem": "f"}.get(next((p for p in toks[j].morph.split("|") if p.startswith("Gender=")), ""))


def linked(readings: Sequence[Reading | None], ids: Mapping[Reading, str]) -> list[str]:
    """Ids of the words that a sentence links, once each, in order."""
    return list(dict.fromkeys(ids[r] for r in readings if r in ids))


def reflexive_labels(sentences: Sequence[tuple[Sequence[str], set[str]]], labelled: set[str], share: float = 0.6) -> set[str]:
    """The words that keep a reflexive label: reflexive in this share of the sentences that link them. sentences: (links, reflexive ones)."""
    seen, reflexive = Counter(), Counter()
    for links, own in sentences:
        seen.update(w for w in links if w in labelled)
        reflexive.update(w for w in links if w in labelled and w in own)
    return {w for w in labelled if seen[w] and reflexive[w] >= share * seen[w]}


def passage_problems(words: Sequence[str | None], level_of: Mapping[str, int], level: int, coverage: float = 0.95, budget: int = 3, sizes: tuple[int, int] = (40, 120)) -> list[str]:
    """What a passage breaks: too few words known at its level, too many distinct ones of the next, or a wrong length. Unlinked words are None."""
    known = sum(w is not None and level_of[w] <= level for w in words)
    above = {w for w in words if w is not None and level_of[w] == level + 1}
    far = {w for w in words if w is not None and level_of[w] > level + 1}
    out = ["length"] if not sizes[0] <= len(words) <= sizes[1] else []
    out += ["coverage"] if known + len([w for w in words if w in above]) < coverage * len(words) else []
    return out + (["budget"] if len(above) > budget else []) + (["level"] if far else [])


def usage(sentences: Sequence[Sequence[Token]], lex: Lexicon) -> dict[str, Counter]:
    """Counts of each surface's readings, which the next pass may read."""
    out: dict[str, Counter] = defaultdict(Counter)
    for toks in sentences:
        for t, r in zip(toks, resolved(lex, toks)):
            if r:
                out[t.text.lower()][r] += 1
    return out
