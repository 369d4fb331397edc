"""English lexemes with positions, and their cover density."""

from __future__ import annotations

import re
from functools import lru_cache

from .text import STOP_WORDS

_STOP = frozenset(STOP_WORDS)
#: Numbers with points, words with hyphens (which count whole and in parts), other runs of letters and digits.
TOKEN = re.compile(r"\d+(?:\.\d+)+|[^\W\d_][^\W_]*(?:-[^\W_]+)+|[^\W_]+")
#: Occurrences of one lexeme that count, and the greatest position; later ones are left out, or stand at it.
MAX_POSITIONS, LAST_POSITION = 256, 16_383

# Fixed values of the published second version of Porter's stemmer for English: whole words with stems of their own,
# words left alone, words left alone after their plural is off, beginnings after which the first region starts.
OWN_STEMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
LEFT_ALONE = frozenset(("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"))
LEFT_AS_SINGULAR = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
OPENINGS = ("gener", "commun", "arsen")
# Endings of the second, third and fourth step, and what takes their place.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_VOWEL = re.compile("[aeiouy]")
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT_END = re.compile("(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin: each after the first vowel and non-vowel, the second counted inside the first."""
    first = next((len(o) for o in OPENINGS if word.startswith(o)), None)
    if first is None:
        found = _REGION.search(word)
        first = found.end() if found else len(word)
    found = _REGION.search(word, first)
    return first, found.end() if found else len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _singular(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _without_tense(word: str, first: int) -> str:
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending is None:
        return word
    base = word[: -len(ending)]
    if ending.startswith("eed"):
        return base + "ee" if len(base) >= first else word
    if not _VOWEL.search(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if _DOUBLE.search(base):
        return base[:-1]
    return base + "e" if len(base) <= first and _SHORT_END.match(base) else base


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-cased English word, by the published second version of Porter's algorithm."""
    if len(word) <= 2 or word in LEFT_ALONE:
        return word
    if word in OWN_STEMS:
        return OWN_STEMS[word]
    word = re.sub("(?:^|(?<=[aeiouy]))y", "Y", word)
    first, second = _regions(word)
    word = _singular(word)
    if word in LEFT_AS_SINGULAR:
        return word
    word = _without_tense(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    ending = _longest(word, SECOND)
    if ending is not None and len(word) - len(ending) >= first:
        base = word[: -len(ending)]
        if (ending != "ogi" or base.endswith("l")) and (ending != "li" or base[-1:] in tuple("cdeghkmnrt")):
            word = base + SECOND[ending]
    ending = _longest(word, THIRD)
    if ending is not None and len(word) - len(ending) >= (second if ending == "ative" else first):
        word = word[: -len(ending)] + THIRD[ending]
    ending = _longest(word, FOURTH)
    if ending is not None and len(word) - len(ending) >= second and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(ending)]
    if word.endswith("e"):
        if len(word) > second or (len(word) > first and not _SHORT_END.match(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) > second:
        word = word[:-1]
    return word.lower()


def hint(lexeme: str) -> str:
    """Characters that every word with this stem holds at its start: a cheap test before words are stemmed."""
    return lexeme[:1] if lexeme in OWN_STEMS.values() else lexeme[:-1] if len(lexeme) > 2 else lexeme


def tokens(text: str) -> list[str]:
    """Lower-cased words in order; a word with hyphens is followed by its parts."""
    out = []
    for token in TOKEN.findall(text.lower()):
        out.append(token)
        if "-" in token:
            out += token.split("-")
    return out


def stems(text: str) -> list[str]:
    """Stems in order, without stop words."""
    return [stem(w) for w in tokens(text) if w not in _STOP]


def positions(fields: list[tuple[str | None, float]]) -> dict[str, list[tuple[int, float]]]:
    """Lexeme -> its (position, weight) in weighted fields after each other.

    Stop words have positions but are no lexemes; a field's positions begin after the last lexeme of those before it.
    """
    found: dict[str, list[tuple[int, float]]] = {}
    offset = last = 0
    for text, weight in fields:
        for place, word in enumerate(tokens(text or ""), 1):
            if word in _STOP:
                continue
            last = min(offset + place, LAST_POSITION)
            own = found.setdefault(stem(word), [])
            if len(own) < MAX_POSITIONS:
                own.append((last, weight))
        offset = last
    return found


def cover_density(asked: list[str], fields: list[tuple[str | None, float]]) -> float:
    """0 unless every asked stem occurs. Each least span that holds all of them adds the harmonic mean of the weights
    in it, divided by one more than its positions of no asked stem; of a single stem each occurrence adds its weight."""
    held = positions(fields)
    if not asked or not all(a in held for a in asked):
        return 0.0
    found = sorted((position, own, weight) for own in set(asked) for position, weight in held[own])
    total, count, start = 0.0, dict.fromkeys(asked, 0), 0
    for end, (_, own, _) in enumerate(found):
        count[own] += 1
        if not all(count.values()):
            continue
        while count[found[start][1]] > 1:
            count[found[start][1]] -= 1
            start += 1
        cover = found[start : end + 1]
        noise = cover[-1][0] - cover[0][0] - (len(cover) - 1)
        if noise < 0:  # positions that all stand at the last one
            noise = (len(cover) - 1) // 2
        total += len(cover) / sum(1 / w for _, _, w in cover) / (1 + noise)
        count[found[start][1]] -= 1
        start += 1
    return total
