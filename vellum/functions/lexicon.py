"""Word lists of a pack: stems, glosses, articles, readings, examples and options. Pure functions over a few thousand words."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from unicodedata import normalize

from .sequences import draws, shuffled, weighted
from .text import syllable_tone, typed_key

#: Letters of a gloss, and the share of the best score that a second sense or a swapped lead needs.
MOST_LETTERS, SECOND_SENSE, LEAD_SUPPORT = 45, 0.5, 0.75


def stem(word: str, vocabulary: set[str], irregular: Mapping[str, str] | None = None) -> str:
    """The base of an inflected English word, but only one that the vocabulary attests."""
    if irregular and word in irregular:
        return irregular[word]
    undoubled = lambda b: b[:-1] if len(b) > 2 and b[-1] == b[-2] else ""
    bases: tuple[str, ...] = ()
    if word.endswith("ies") and len(word) > 4:
        bases = (word[:-3] + "y",)
    elif word.endswith("es") and len(word) > 3:
        bases = (word[:-2], word[:-1])
    elif word.endswith("s") and not word.endswith("ss") and len(word) > 3:
        bases = (word[:-1],)
    elif word.endswith("ing") and len(word) > 5:
        bases = (word[:-3] + "e", word[:-3], undoubled(word[:-3]))
    elif word.endswith("ed") and len(word) > 4:
        bases = (word[:-1], word[:-2], undoubled(word[:-2]), word[:-3] + "y" if word.endswith("ied") else "")
    return next((b for b in bases if b and b in vocabulary), word)


def stems(text: str, vocabulary: set[str], irregular: Mapping[str, str] | None = None, stop: frozenset[str] = frozenset()) -> list[str]:
    """Stems of a text's words, contractions taken apart."""
    plain = re.sub(r"\bcan't\b", "can not", re.sub(r"\bwon't\b", "will not", text.lower().replace("’", "'")))
    plain = re.sub(r"'(s|re|ll|ve|m|d)\b", " ", re.sub(r"n't\b", " not", plain))
    return [stem(w, vocabulary, irregular) for w in re.findall("[a-z]+", plain) if w not in stop]


@dataclass(frozen=True)
class Sense:
    gloss: str
    score: float
    stems: frozenset[str] = frozenset()
    marked: bool = False


def composed_gloss(senses: Sequence[Sense]) -> str | None:
    """The best sense, and the next of half its score or more if it says something else and both fit."""
    if not senses:
        return None
    top = senses[0]
    for s in senses[1:]:
        if not s.marked and top.score > 0 and s.score >= SECOND_SENSE * top.score and not s.stems & top.stems and s.gloss.lower() != top.gloss.lower():
            return f"{top.gloss}; {s.gloss}" if len(top.gloss) + len(s.gloss) + 2 <= MOST_LETTERS else top.gloss
    return top.gloss


def main_word(gloss: str) -> str:
    """What a gloss leads with, without brackets and small words before it."""
    lead = re.split("[;,]", re.sub(r"\([^)]*\)", " ", gloss))[0].lower()
    return re.sub("^(to|an?|the) ", "", " ".join(lead.split()))


def distinct_leads(words: Sequence[tuple[str, str, Sequence[Sense]]]) -> list[str]:
    """Glosses of (word, class, senses) in the order of rank: a word whose lead a word of its class before it has leads with its next
    sense of LEAD_SUPPORT of the best score or more whose lead is free, if there is one."""
    taken: dict[str, set[str]] = defaultdict(set)
    out = []
    for _, group, senses in words:
        gloss = composed_gloss(senses) or ""
        if gloss and main_word(gloss) in taken[group]:
            free = (s for s in senses[1:] if not s.marked and s.score >= LEAD_SUPPORT * senses[0].score > 0 and main_word(s.gloss) not in taken[group] and main_word(gloss) not in s.gloss.lower())
            if swap := next(free, None):
                both = f"{swap.gloss}; {senses[0].gloss}"
                gloss = both if len(both) <= MOST_LETTERS else swap.gloss
        taken[group].add(main_word(gloss))
        out.append(gloss)
    return out


def article_length(text: str, articles: set[str]) -> int:
    """Letters of the article, or of several joined by slashes, that a word begins with; 0 if what is left is an article too."""
    m = re.match(r"(\S+?)(\s+|(?<=['’ʼ]))(?=\S)", text)
    if not m or not all(typed_key(a) in articles for a in m[1].split("/")) or typed_key(text[m.end() :]) in articles:
        return 0
    return m.end()


def cited_articles(text: str, articles: set[str]) -> list[str]:
    return [typed_key(a) for a in text[: article_length(text, articles)].strip().split("/") if a]


def article_before(text: str, articles: set[str]) -> str:
    """The article that ends the text before a blank, or nothing."""
    m = re.search(r"([^\W\d_]+['’ʼ])$", text) or re.search(r"([^\W\d_]+)\s+$", text)
    return typed_key(m[1]) if m and typed_key(m[1]) in articles else ""


def shown_reading(word: str, reading: str | None) -> str:
    """A reading that says more than the word does, else nothing."""
    same = lambda s: normalize("NFC", s).strip().lower()
    return "" if not reading or same(reading) == same(word) else reading


def reading_letters(reading: str) -> tuple[str, tuple[int, ...], bool]:
    """Letters of a reading without tones, the tones of its syllables as digits or marks tell them, and whether any are told."""
    letters = normalize("NFC", reading).lower().replace("u:", "ü").replace("v", "ü")
    tones, out = [], []
    for part in re.findall(r"[^\W\d_]+[0-5]?", letters):
        bare, tone = syllable_tone(part.rstrip("012345"))
        digit = part[-1] if part[-1].isdigit() else ""
        told = int(digit) or 5 if digit else tone
        out.append(bare)
        tones.append(told)
    return "".join(out), tuple(t for t in tones if t != 5), any(t != 5 for t in tones)


def typed_reading(typed: str, reading: str) -> str:
    """ok, tones (right letters, no tones told), tonesDiff (other tones) or wrong."""
    (a, s, told), (b, t, _) = reading_letters(typed), reading_letters(reading)
    if not a or a != b:
        return "wrong"
    return "ok" if s == t else "tonesDiff" if told else "tones"


def joined_readings(parts: Iterable[str], tonal: bool = True) -> str:
    """Readings as one word; an apostrophe goes before a syllable that begins with a, e or o."""
    out = ""
    for p in parts:
        apart = tonal and out and p and out[-1].isalpha() and syllable_tone(p)[0][:1].lower() in ("a", "e", "o")
        out += ("'" if apart else "") + p
    return out


def span_reading(text: str, word: str, reading: str, of: Callable[[str], str] = lambda c: "") -> list[tuple[str, str]]:
    """(piece, reading) of a span that holds a word: each place of the word has its reading, others what `of` tells or none."""
    out: list[tuple[str, str]] = []
    for piece in re.split(f"({re.escape(word)})", text) if word else [text]:
        for part, r in [(piece, reading)] if piece == word else [(c, of(c)) for c in piece]:
            if out and bool(out[-1][1]) == bool(r):
                part, r = out[-1][0] + part, joined_readings([out[-1][1], r])
                out.pop()
            out.append((part, r))
    return out


def folded_pool(ranked: Sequence[str], need: int, folds: Mapping[str, str]) -> tuple[list[str], dict[str, str]]:
    """The first `need` words that no other word of the choice takes in, and who takes in whom; repeated until nothing changes."""
    gone: dict[str, str] = {}
    while True:
        chosen = [w for w in ranked if w not in gone][:need]
        new = {w: folds[w] for w in chosen if folds.get(w, w) != w and folds[w] in chosen}
        # Of two that would take in each other, the one ranked first stays.
        new = {w: to for w, to in new.items() if to not in new or chosen.index(to) < chosen.index(w)}
        if not new:
            return chosen, gone
        gone |= new


def refilled(ranked: Sequence[str], need: int, exampled: Callable[[Sequence[str]], set[str]], forced: frozenset[str] = frozenset()) -> list[str]:
    """The first `need` words; those without an example, if not forced, give their place once to the next."""
    first = list(ranked[:need])
    shown = exampled(first)
    dropped = {w for w in first if w not in shown and w not in forced}
    return [w for w in ranked if w not in dropped][:need]


def two_examples(candidates: Mapping[str, Sequence[tuple]], most: int = 2) -> dict[str, list[object]]:
    """Examples of each word, words of few candidates first. A candidate is a tuple of qualities, the better the smaller, and the
    sentence last; among equals, a sentence that a word before uses goes first."""
    used: Counter = Counter()
    out = {}
    for word in sorted(candidates, key=lambda w: (len(candidates[w]), w)):
        best = sorted(candidates[word], key=lambda c: (c[:-1], used[c[-1]] == 0, c[-1]))[:most]
        out[word] = [c[-1] for c in best]
        used.update(out[word])
    return out


def picked_options(target: str, tiers: Sequence[Sequence[str]], clash: Callable[[str, str], bool], n: int, draw: Callable[[], float]) -> list[str]:
    """n options beside the target, of the first tiers first, none a second right answer to the target or to another."""
    out: list[str] = []
    for tier in tiers:
        for x in shuffled(tier, draw):
            if len(out) < n and x != target and not any(clash(x, y) for y in (target, *out)):
                out.append(x)
    return out


def least_options(units: Mapping[str, Sequence[Sequence[str]]], clash: Callable[[str, str], bool], n: int = 3, tries: int = 24) -> dict[str, int]:
    """The fewest options that a unit got, the unit itself counted, over so many seeded shuffles."""
    return {u: min(1 + len(picked_options(u, tiers, clash, n, draws(seed))) for seed in range(tries)) for u, tiers in units.items()}


def review_kinds(n: int, typing: bool, draw: Callable[[], float], share: float = 0.4) -> list[str]:
    """Kinds of n slots: a share, rounded up, is production, recall and typing by turns; of the others two hear and one reads."""
    made = -int(-(n * share - 1e-9) // 1)
    kinds = ["type" if typing and i % 2 else "recall" for i in range(made)] + ["read" if i % 3 == 2 else "hear" for i in range(n - made)]
    return shuffled(kinds, draw)


def unified_plan(words: Mapping[str, tuple[int, int]], units: Mapping[str, tuple[int, int]], provisional: Sequence[str], weights: Mapping[str, float], draw: Callable[[], float], size: int = 15, most_provisional: int = 5, typing: bool = False) -> list[tuple[str, str]]:
    """(kind, item) of a review over words and units, whose records are (wrong, streak): some provisional words, then the weakest."""
    first = shuffled([w for w in provisional if w in words], draw)[: min(most_provisional, size)]
    weak = sorted([(3 * w - s, "u", i) for i, (w, s) in units.items()] + [(3 * w - s, "w", i) for i, (w, s) in words.items() if i not in first], key=lambda x: (-x[0], x[2]))
    pool = shuffled([("w", i) for i in first] + [(k, i) for _, k, i in weak[: size - len(first)]], draw)
    kinds = iter(review_kinds(sum(k == "w" for k, _ in pool), typing, draw))
    return [(next(kinds) if k == "w" else weighted(dict(weights), draw), i) for k, i in pool]


@dataclass(frozen=True)
class Language:
    """What differs by language, and the hooks that its rules are given by; each hook leaves its argument as it is by default."""

    key: str
    spaced: bool = True
    right_to_left: bool = False
    german_digraphs: bool = False
    articles: frozenset[str] = frozenset()
    contractions: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    phrases: frozenset[str] = frozenset()
    fix_token: Callable[[tuple], tuple] = lambda token: token
    fix_sentence: Callable[[list], list] = lambda tokens: tokens
    post_resolve: Callable[[list], list] = lambda links: links
    check_word: Callable[[dict], list[str]] = lambda word: []


LANGUAGES: dict[str, Language] = {}


def register(language: Language) -> Language:
    """Adds a language; a key that is there already is an error."""
    if language.key in LANGUAGES:
        raise KeyError(f"{language.key} is registered")
    LANGUAGES[language.key] = language
    return language


# Definite and indefinite articles.
register(Language("it", articles=frozenset(["il", "lo", "la", "l'", "i", "gli", "le", "un", "uno", "una", "un'"]), contractions={"del": ("di", "il"), "della": ("di", "la"), "al": ("a", "il")}))
register(Language("es", articles=frozenset(["el", "la", "los", "las", "un", "una", "unos", "unas"]), contractions={"del": ("de", "el"), "al": ("a", "el")}))
register(Language("fr", articles=frozenset(["le", "la", "l'", "les", "un", "une", "des"]), contractions={"du": ("de", "le"), "au": ("à", "le")}))
register(Language("de", german_digraphs=True, articles=frozenset(["der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "eines"])))
register(Language("zh", spaced=False))
register(Language("ja", spaced=False))
for _key in ("fa", "ur", "ar"):
    register(Language(_key, right_to_left=True))
for _key in ("ru", "ko", "hi", "id"):
    register(Language(_key))
