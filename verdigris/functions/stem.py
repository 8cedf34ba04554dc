"""The published English suffix stemmer (Porter's second), for terms of retrieval.

Spark has no stemmer, so this runs in Arrow batches; each distinct word of a
batch is stemmed once.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values of the algorithm: vowels are aeiouy; y counts as a consonant (written Y) at the head and after a vowel.
VOWEL, DOUBLE, LI_ENDING = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
INVARIANT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
HEADS = ("gener", "commun", "arsen")
DERIVED = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
REDUCED = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
DROPPED = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and that again."""
    after = re.compile(f"[{VOWEL}][^{VOWEL}]")

    def start(since: int) -> int:
        found = after.search(word, since)
        return found.end() if found else len(word)

    head = next((len(h) for h in HEADS if word.startswith(h)), None)
    r1 = start(0) if head is None else head
    return r1, start(r1)


def _ends_short(word: str) -> bool:
    """Does the word end in a short syllable."""
    return bool(re.search(f"[^{VOWEL}][{VOWEL}][^{VOWEL}wxY]$", word) or re.fullmatch(f"[{VOWEL}][^{VOWEL}]", word))


def _longest(word: str, suffixes: object) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(word: str) -> str:
    suffix = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if suffix == "sses":
        return word[:-2]
    if suffix in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    return word[:-1] if suffix == "s" and re.search(f"[{VOWEL}]", word[:-2]) else word


def _past(word: str, r1: int) -> str:
    suffix = _longest(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if suffix in ("eed", "eedly"):
        return word[: -len(suffix)] + "ee" if len(word) - len(suffix) >= r1 else word
    if suffix is None or not re.search(f"[{VOWEL}]", word[: -len(suffix)]):
        return word
    stem = word[: -len(suffix)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem.endswith(DOUBLE):
        return stem[:-1]
    return stem + "e" if r1 >= len(stem) and _ends_short(stem) else stem


def _derived(word: str, r1: int) -> str:
    suffix = _longest(word, DERIVED)
    if suffix is None or len(word) - len(suffix) < r1:
        return word
    stem = word[: -len(suffix)]
    if suffix == "li" and not stem.endswith(tuple(LI_ENDING)) or suffix == "ogi" and not stem.endswith("l"):
        return word
    return stem + DERIVED[suffix]


def _reduced(word: str, r1: int, r2: int) -> str:
    suffix = _longest(word, REDUCED)
    at = len(word) - len(suffix or "")
    return word if suffix is None or at < r1 or suffix == "ative" and at < r2 else word[:at] + REDUCED[suffix]


def _dropped(word: str, r2: int) -> str:
    suffix = _longest(word, DROPPED)
    at = len(word) - len(suffix or "")
    return word if suffix is None or at < r2 or suffix == "ion" and word[at - 1] not in "st" else word[:at]


def _last(word: str, r1: int, r2: int) -> str:
    at = len(word) - 1
    if word.endswith("e"):
        return word[:at] if at >= r2 or at >= r1 and not _ends_short(word[:at]) else word
    return word[:at] if word.endswith("ll") and at >= r2 else word


def stem(word: str) -> str:
    """The stem of a lower-cased word; words of two characters or fewer are their own."""
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = re.sub(f"(?<=[{VOWEL}])y", "Y", "Y" + word[1:] if word.startswith("y") else word)
    r1, r2 = _regions(word)
    word = _plural(re.sub("('s'|'s|')$", "", word))
    if word in INVARIANT:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWEL:
        word = word[:-1] + "i"
    word = _reduced(_derived(word, r1), r1, r2)
    return _last(_dropped(word, r2), r1, r2).lower()


@F.pandas_udf(ArrayType(StringType()))
def stem_words(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def of(word: str) -> str:
        if word not in known:
            known[word] = stem(word)
        return known[word]

    return words.map(lambda ws: [of(w) for w in ws], na_action="ignore")
