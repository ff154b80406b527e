"""Spelling keys: folds, typed answers, search, surfaces and their places. Pure functions; arrow_column() makes columns of them."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from unicodedata import category, normalize

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.workers import importable

# Marks that folding drops, by script, as first and last code points.
LATIN_MARKS = ((0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))
HEBREW_MARKS = ((0x591, 0x5BD), (0x5BF, 0x5BF), (0x5C1, 0x5C2), (0x5C4, 0x5C5), (0x5C7, 0x5C7))
ARABIC_MARKS = ((0x610, 0x61A), (0x64B, 0x652), (0x656, 0x65F), (0x670, 0x670), (0x6D6, 0x6DC), (0x6DF, 0x6E4), (0x6E7, 0x6E8), (0x6EA, 0x6ED), (0x640, 0x640))
JOINERS = ((0x200C, 0x200D),)
# Letters whose marks belong to them.
KEPT = "йЙїЇўЎ"
# Keyboard variants, and the letters that lenient typing takes for one another.
VARIANTS = {"ك": "ک", "ي": "ی"}
LENIENT = {"ٱ": "ا", "ٲ": "ا", "ٳ": "ا", "ٵ": "ا", "ٶ": "و", "ٷ": "و", "ٸ": "ی", "ء": "", "ة": "ه", "ۃ": "ہ", "ى": "ی", "ھ": "ہ", "ە": "ه", "\u0901": "\u0902", "\u093c": ""}
# What search folds in Arabic script.
SEARCHED = {"ٱ": "ا", "ٲ": "ا", "ٳ": "ا", "ٵ": "ا", "ٶ": "و", "ٷ": "و", "ٸ": "ی", "ة": "ہ", "ى": "ی", "ۀ": "ہ", "ۃ": "ہ", "ه": "ہ"}
# German letters in ASCII.
DIGRAPHS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"}
APOSTROPHES = "'’ʼ"


def _points(*ranges: Iterable[tuple[int, int]]) -> dict[int, None]:
    return {c: None for some in ranges for a, b in some for c in range(a, b + 1)}


_FOLDED = _points(LATIN_MARKS, HEBREW_MARKS, ARABIC_MARKS, JOINERS)
_POINTING = _points(HEBREW_MARKS, ARABIC_MARKS, JOINERS)
_HAMZA = _points(((0x653, 0x655),))
_KEPT = re.compile(f"([{KEPT}])")
_STRESS = re.compile(r"([Ѐ-ӿ][\u0300-\u036f]*)\u0301")


def arrow_column(f: Callable, returns: str, *columns: str) -> Column:
    """f over columns, in Arrow batches; nulls come as None. There must be an active session."""
    importable(SparkSession.active())

    def run(rows: pd.DataFrame) -> pd.Series:
        values = rows.astype(object).where(rows.notna(), None)
        return pd.Series([f(*row) for row in values.itertuples(index=False, name=None)], dtype=object)

    return F.pandas_udf(run, returns)(F.struct(*columns))


def fold_accents(s: str) -> str:
    """Without the marks that writers may leave out; letters of KEPT, kana voicing and Indic signs stay."""
    parts = _KEPT.split(normalize("NFC", s))
    return "".join(p if k % 2 else normalize("NFC", normalize("NFD", p).translate(_FOLDED)) for k, p in enumerate(parts))


def fold_letters(s: str) -> str:
    """Arabic and Devanagari letters that are typed for one another as one."""
    bare = normalize("NFD", s).translate(_HAMZA)
    return normalize("NFC", bare.translate(str.maketrans(LENIENT)).translate(str.maketrans(VARIANTS)))


def german_ascii(s: str) -> str:
    return s.translate(str.maketrans(DIGRAPHS))


def typed_key(s: str | None, fold: bool = False, german: bool = False, cased: bool = False, letters: bool = True) -> str:
    """What a typed answer is compared by: blanks, apostrophes and keyboard variants as one; small letters; folded if asked."""
    out = normalize("NFC", s or "").translate(str.maketrans(dict.fromkeys("‘’ʼ`", "'") | VARIANTS))
    out = " ".join(out.split())
    out = out if cased else out.lower()
    if fold:
        out = fold_accents(german_ascii(out) if german else out)
        out = " ".join(fold_letters(out).split()) if letters else out
    return out


def pointing_key(key: str) -> str:
    """A key without the marks that never tell two written words apart: pointing, joiners, and stress on Cyrillic letters."""
    return normalize("NFC", _STRESS.sub(r"\1", normalize("NFD", key).translate(_POINTING)))


class Answers:
    """Words that are asked for, and who else is spelled as what is typed. entries: id to its spellings, the word first."""

    def __init__(self, entries: dict[str, list[str]], german: bool = False, cased: bool = False):
        self.entries, self.german, self.cased = entries, german, cased
        self.spelled, self.pointed = defaultdict(set), defaultdict(set)
        for i, forms in entries.items():
            for f in forms:
                key = typed_key(f, cased=cased)
                self.spelled[key].add(i)
                self.pointed[pointing_key(key)].add(i)

    def accepts(self, typed: str, entry: str, lenient: bool = True, extra: tuple[str, ...] = ()) -> bool:
        """A spelling of the entry is right; if lenient, what folds to one, unless it spells another entry, marks that tell nothing apart aside."""
        key, forms = typed_key(typed, cased=self.cased), [*self.entries[entry], *extra]
        exact = {typed_key(f, cased=self.cased) for f in forms}
        if not key or key in exact or not lenient:
            return bool(key) and key in exact
        loose = typed_key(typed, fold=True, cased=self.cased)
        folded = {typed_key(f, fold=True, german=g, cased=self.cased) for f in forms for g in ((False, True) if self.german else (False,))}
        if not loose or loose not in folded or self.spelled[key] - {entry}:
            return False
        pointing = pointing_key(key)
        return pointing in map(pointing_key, exact) or not self.pointed[pointing] - {entry}


def search_key(s: str | None) -> str:
    """What search compares: nasal tildes as n, hyphens as blanks, scripts folded, a doubled word once."""
    spelled = normalize("NFC", normalize("NFD", s or "").replace("\u0303", "n")).replace("-", " ")
    key = typed_key(spelled, fold=True, letters=False)
    key = normalize("NFC", normalize("NFD", key).replace("\u093c", "").replace("\u0901", "\u0902")) if re.search("[\u0900-ॿ]", key) else key
    if re.search("[\u0600-ۿ]", key):
        bare = normalize("NFD", key.translate(str.maketrans(SEARCHED))).translate(_HAMZA).translate(str.maketrans(VARIANTS))
        key = normalize("NFC", re.sub(r"ے(?=\s|$)", "ی", bare))
    words = key.split(" ")
    return " ".join(w for k, w in enumerate(words) if not k or w != words[k - 1])


def without_article(key: str) -> str:
    """A search key without the Arabic article where two letters or more follow it."""
    return re.sub(r"(^|\s)ال(?=\S{2,})", r"\1", key)


def search_tier(query: str, targets: list[str], senses: list[str]) -> int | None:
    """0: the query is a target; 1: it is a sense; 2: a target begins with it; 3: it is in either; None: in neither."""

    def forms(x: str) -> set[str]:
        return {k for k in (search_key(x), without_article(search_key(x))) if k}

    asked, own = forms(query), {k for t in targets for k in forms(t)}
    meant = {k for s in senses for k in forms(re.sub(r"^\s*to\s+", "", s))} | {k for s in senses for k in forms(s)}
    close = lambda keys: {k.replace(" ", "") for k in keys}
    if not asked or not any(q in k or q.replace(" ", "") in k.replace(" ", "") for q in asked for k in own | meant):
        return None
    if asked & own or close(asked) & close(own):
        return 0
    if asked & meant or close(asked) & close(meant):
        return 1
    return 2 if any(k.startswith(q) for k in own for q in asked) else 3


def surface_hits(text: str, surface: str, spaced: bool = True) -> list[tuple[int, int]]:
    """Places of a surface in a text: whole words in any case where words are spaced, else each place that doesn't overlap the one before."""
    if not surface:
        return []
    if not spaced:
        return [m.span() for m in re.finditer(re.escape(surface), text)]
    word = lambda c: category(c)[0] in "LMN" or c in "\u200c\u200d"
    body = "".join(f"[{APOSTROPHES}]" if c in APOSTROPHES else re.escape(c) for c in surface)
    hits, at = [], 0
    pattern = re.compile(body, re.IGNORECASE)
    while m := pattern.search(text, at):
        a, b = m.span()
        before = surface[0] not in APOSTROPHES and a and word(text[a - 1])
        after = surface[-1] not in APOSTROPHES and b < len(text) and word(text[b])
        if before or after:
            at = a + 1
        else:
            hits.append((a, b))
            at = b
    return hits


def located(text: str, forms: list[str], spaced: bool = True) -> tuple[int, int] | None:
    """The widest hit of the forms if all their hits are one place, overlaps counting as one."""
    hits = sorted({h for f in forms for h in surface_hits(text, f, spaced)})
    reach = 0
    for k, (a, b) in enumerate(hits):
        if k and a >= reach:
            return None
        reach = max(reach, b)
    return max(hits, key=lambda h: (h[1] - h[0], -h[0]), default=None)


def blank_of(text: str, forms: list[str], surfaces: Iterable[str], spaced: bool = True) -> tuple[int, int] | None:
    """The place to blank for a word: where it is located, inside no longer surface, with a letter or digit left outside."""
    place = located(text, forms, spaced)
    if place is None:
        return None
    a, b = place
    own = text[a:b].lower()
    if any(len(s) > b - a and own in s.lower() and any(x <= a and y >= b for x, y in surface_hits(text, s, spaced)) for s in surfaces):
        return None
    return place if any(category(c)[0] in "LN" for c in text[:a] + text[b:]) else None


def rtl_runs(s: str | None) -> list[tuple[str, bool]]:
    """The text cut into runs and whether they run from right to left; neutral characters between two such letters belong to their run."""
    kind = [("\u0590" <= c <= "\u08ff" or "\ufb1d" <= c <= "\ufdff" or "\ufe70" <= c <= "\ufeff", category(c)[0] in "LM") for c in s or ""]
    out, at, k = [], 0, 0
    while k < len(kind):
        if not kind[k][0]:
            k += 1
            continue
        last = j = k
        while j < len(kind) and (kind[j][0] or not kind[j][1]):
            last = j if kind[j][0] else last
            j += 1
        if k > at:
            out.append((s[at:k], False))
        out.append((s[k : last + 1], True))
        at = k = last + 1
    if at < len(kind):
        out.append((s[at:], False))
    return out


def without_marks(s: str) -> str:
    return normalize("NFC", "".join(c for c in normalize("NFD", s) if category(c) != "Mn"))


def utf16_place(text: str, at: int) -> int:
    """The place of a character in UTF-16 units."""
    return at + sum(c > "\uffff" for c in text[:at])


def with_marks(text: str, a: int, b: int) -> tuple[int, int]:
    """A span that holds the marks of its last letter and begins with none."""
    mark = lambda k: category(text[k]) in ("Mn", "Mc")
    while b < len(text) and mark(b):
        b += 1
    while a < b and mark(a):
        a += 1
    return a, b


# Tone marks of pinyin, in the order of the tones.
TONES = "\u0304\u0301\u030c\u0300"


def syllable_tone(syllable: str) -> tuple[str, int]:
    """A pinyin syllable without its tone mark, and the tone; 5 without one."""
    letters = normalize("NFD", syllable)
    tone = next((TONES.index(c) + 1 for c in letters if c in TONES), 5)
    return normalize("NFC", "".join(c for c in letters if c not in TONES)), tone


def marked_syllable(syllable: str, tone: int) -> str:
    """The syllable with its tone mark: on a or e, on the o of ou, else on the last vowel."""
    vowels = [k for k, c in enumerate(syllable) if c.lower() in "aeiouü"]
    if not 1 <= tone <= 4 or not vowels:
        return syllable
    low = syllable.lower()
    at = next((low.index(x) for x in ("a", "e", "ou") if x in low), vowels[-1])
    return normalize("NFC", syllable[: at + 1] + TONES[tone - 1] + syllable[at + 1 :])


def kana_key(s: str) -> str:
    """Katakana as hiragana, widths as one."""
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in normalize("NFKC", s))


def hangul_parts(syllable: str) -> tuple[int, int, int] | None:
    """Initial, vowel and final of a Hangul syllable, by number; None for other characters."""
    n = ord(syllable) - 0xAC00
    return (n // 588, n % 588 // 28, n % 28) if 0 <= n < 11172 else None


def hangul_syllable(initial: int, vowel: int, final: int = 0) -> str:
    return chr(0xAC00 + (initial * 21 + vowel) * 28 + final)


def gender_of(spec: str) -> tuple[str, bool]:
    """Genders of a dictionary's field (m, f, n in their order, labels left out), and whether the word is plural only."""
    marks = [re.sub(r"<[^>]*>", "", part).strip() for part in spec.split(",")]
    labels = re.findall(r"<l:([^>]*)>", spec)
    whole = "".join(dict.fromkeys(m[0] for part, m in zip(spec.split(","), marks) if m and m[0] in "mfn" and "<l:archaic>" not in part))
    return whole, any(m.endswith("-p") for m in marks) or "plural only" in labels


def italian_article(noun: str, gender: str, plural: bool = False) -> str:
    """The noun with its definite article."""
    low = fold_accents(noun.lower())
    vowel = low[:1] in "aeiou"
    hard = re.match(r"(s[^aeiou]|z|gn|ps|pn|x|y|i[aeou])", low) is not None
    if gender == "mf" and not vowel:
        return f"{'lo' if hard else 'il'}/la {noun}"
    if plural:
        return f"{'le' if gender == 'f' else 'gli' if vowel or hard else 'i'} {noun}"
    if vowel and not hard:
        return f"l'{noun}"
    return f"{'la' if gender == 'f' else 'lo' if hard else 'il'} {noun}"
