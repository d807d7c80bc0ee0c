"""Porter stemming of single words, with the usual extensions for irregular and short forms.

A small helper for the metric kernels; results are cached per Python worker, so each distinct word
of a task is stemmed once.
"""

from __future__ import annotations

from functools import lru_cache

# Irregular forms.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
# Suffix rules of steps 1a, 2, 3 and 4, in the order they are tried.
STEP_1A = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"), ("logi", "log"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
    ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """One letter per character: ``c`` consonant, ``v`` vowel; ``y`` is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _cvc(word: str) -> bool:
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _suffix(word: str, rules, minimum: int) -> str:
    """Apply the first rule whose suffix matches, if what is left measures more than ``minimum``."""
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            measured = stem + "l" if suffix == "logi" else stem
            return stem + new if _measure(measured) > minimum else word
    return word


def _past_and_gerund(word: str) -> str:
    if word.endswith("ied"):
        return word[:-3] + ("ie" if len(word) == 4 else "i")
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
            stem = word[: -len(suffix)]
            break
    else:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _cvc(stem) else stem


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    else:
        word = _suffix(word, STEP_1A, -1)
    word = _past_and_gerund(word)
    if word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "c":
        word = word[:-1] + "i"
    while word.endswith("alli") and _measure(word[:-4]) > 0:
        word = word[:-2]
    word = _suffix(word, STEP_2, 0)
    word = _suffix(word, STEP_3, 0)
    for suffix in STEP_4:
        if word.endswith(suffix):
            left = word[: len(word) - len(suffix)]
            if _measure(left) > 1 and (suffix != "ion" or left[-1] in "st"):
                word = left
            break
    if word.endswith("e"):
        left = word[:-1]
        m = _measure(left)
        if m > 1 or (m == 1 and not _cvc(left)):
            word = left
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
