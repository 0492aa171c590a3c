"""The Porter stemmer (Porter, "An algorithm for suffix stripping", 1980), with
the usual extensions for short words and irregular forms."""

from __future__ import annotations

from functools import lru_cache

#: Irregular forms.
IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
#: Suffixes and what they become, by step.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _vowels(word: str) -> list[bool]:
    found: list[bool] = []
    for i, c in enumerate(word):
        found.append(c in "aeiou" or (c == "y" and i > 0 and not found[-1]))
    return found


def _measure(stem: str) -> int:
    v = _vowels(stem)
    return sum(a and not b for a, b in zip(v, v[1:]))


def _has_vowel(stem: str) -> bool:
    return any(_vowels(stem))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _vowels(word)[-1]


def _cvc(word: str) -> bool:
    v = _vowels(word)
    if len(word) >= 3 and not v[-3] and v[-2] and not v[-1]:
        return word[-1] not in "wxy"
    return len(word) == 2 and v[0] and not v[1]


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    # Plurals.
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # Participles.
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and _has_vowel(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _cvc(word):
                word += "e"
    if word.endswith("y") and len(word) > 2 and not _vowels(word[:-1])[-1]:
        word = word[:-1] + "i"
    if word.endswith("logi") and _measure(word[:-3]) > 0:
        word = word[:-1]
    else:
        word = _replaced(word, STEP2)
        if word.endswith("alli") and _measure(word[:-4]) > 0:
            word = _replaced(word[:-4] + "al", STEP2)
    word = _replaced(word, STEP3)
    for s in sorted(STEP4, key=len, reverse=True):
        if word.endswith(s):
            rest = word[: -len(s)]
            if _measure(rest) > 1 and (s != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _cvc(rest)):
            word = rest
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def _replaced(word: str, pairs: tuple) -> str:
    for a, b in sorted(pairs, key=lambda p: len(p[0]), reverse=True):
        if word.endswith(a):
            return word[: -len(a)] + b if _measure(word[: -len(a)]) > 0 else word
    return word
