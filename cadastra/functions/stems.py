"""English stems by the public Porter2 rules, and the words of a text with their stems and positions."""

from __future__ import annotations

import re

# English words that a text search leaves out.
STOP_WORDS = frozenset(
    """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing
a an the and but if or because as until while of at by for with about against between into through during before after above below to
from up down in out on off over under again further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now
""".split()
)
# Words whose stem the rules don't give, and words that stay after the first step.
EXCEPTIONS = dict(x.split(":") for x in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes".split())
STAYING = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Endings of the second, third and fourth step with what they become.
STEP_2 = dict(x.split(":") for x in "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble ogi:og fulli:ful lessli:less li:".split())
STEP_3 = dict(x.split(":") for x in "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:".split())
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

#: A word of a search: letters and digits.
WORD = re.compile(r"[^\W_]+")
_REGION = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]")
_HEAD = re.compile(r"gener|commun|arsen")
_SHORT = re.compile(r"(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", re.S)
_VOWEL = re.compile(r"[aeiouy]")
_BY_SIZE = {n: sorted(table, key=len, reverse=True) for n, table in ((2, STEP_2), (3, STEP_3), (4, STEP_4))}


def _ending(word: str, step: int) -> str | None:
    return next((x for x in _BY_SIZE[step] if word.endswith(x)), None)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    for end in ("eedly", "eed"):
        if w.endswith(end):
            return w[: len(w) - len(end)] + "ee" if len(w) - len(end) >= r1 else w
    end = next((x for x in ("ingly", "edly", "ing", "ed") if w.endswith(x)), None)
    if not end or not _VOWEL.search(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
        return w[:-1]
    return w + "e" if r1 >= len(w) and _SHORT.match(w) else w


def stem(word: str) -> str:
    """The stem of a lower-cased word. Words of two letters or fewer stay; letters beyond a-z are consonants."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    # a y at the start or behind a vowel is a consonant, written Y
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    found = _HEAD.match(w) or _REGION.match(w)
    r1 = found.end() if found else len(w)
    found = _REGION.match(w, r1)
    r2 = found.end() if found else len(w)
    w = _plural(w)
    if w in STAYING:
        return w
    w = _past(w, r1)
    if w[-1] in "yY" and len(w) > 2 and not _VOWEL.match(w[-2]):
        w = w[:-1] + "i"
    end = _ending(w, 2)
    if end and len(w) - len(end) >= r1:
        rest = w[: -len(end)]
        if not (end == "ogi" and rest[-1:] != "l") and not (end == "li" and rest[-1:] not in tuple("cdeghkmnrt")):
            w = rest + STEP_2[end]
    end = _ending(w, 3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP_3[end]
    end = _ending(w, 4)
    if end:
        rest = w[: -len(end)]
        if len(rest) >= r2 and (end != "ion" or rest[-1:] in ("s", "t")):
            w = rest
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.match(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower() if "Y" in w else w


class Stems(dict):
    """Stems of words, None for stop words, kept up to a number of words and then forgotten as a whole."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.most:
            self.clear()
        self[word] = s = None if word in STOP_WORDS else stem(word)
        return s


def positions(text: str | None, stems: Stems, wanted: frozenset[str] | None = None) -> dict[str, list[int]]:
    """Each stem of a text (of those wanted) with the places of its words from 1 on; stop words have places, too."""
    out: dict[str, list[int]] = {}
    for at, word in enumerate(WORD.findall((text or "").lower()), 1):
        s = stems[word]
        if s is not None and (wanted is None or s in wanted):
            out.setdefault(s, []).append(at)
    return out


def search_stems(text: str) -> list[str]:
    """The stems of what a search text asks for, each once, stop words left out."""
    return list(positions(text, Stems()))
