"""The two text functions Spark SQL lacks, as Arrow helpers."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latin spellings of Cyrillic and Greek letters, and of Latin letters that NFKD leaves whole.
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюя", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch # y # e iu ia".replace("#", "").split(" ")))
OTHER = {"ё": "e", "є": "ie", "і": "i", "ї": "yi", "ґ": "g", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "«": "<<", "»": ">>", "№": "No", "…": "..."}
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(" ")))
TABLE = {ord(k): v for k, v in (CYRILLIC | GREEK | OTHER).items()}
TABLE |= {ord(k.upper()): v.capitalize() for k, v in (CYRILLIC | GREEK | OTHER).items() if k.upper() != k and len(k.upper()) == 1}


#: Sounds that Unicode's names of kana spell another way than Latin letters do.
KANA = {"si": "shi", "ti": "chi", "tu": "tsu", "hu": "fu", "zi": "ji", "di": "ji", "du": "zu"}


def _spelled(x: str) -> str:
    """Kana and Hangul syllables as their Unicode names spell them; other characters as they are."""
    if "\u3041" <= x <= "\u30fa" or "\uac00" <= x <= "\ud7a3":
        name = unicodedata.name(x, "").lower()
        if " letter " in name or name.startswith("hangul syllable "):
            sound = name.rsplit(" ", 1)[1]
            return KANA.get(sound, sound) if " letter " in name else sound
    return x


def to_ascii(s: str | None) -> str | None:
    """ASCII spelling of a text; letters without one are dropped."""
    if s is None or s.isascii():
        return s
    # Accents come off first where a letter has its own spelling without them (Greek), but й and ё keep theirs.
    bare = "".join(unicodedata.normalize("NFD", x)[0] if "Ͱ" <= x <= "Ͽ" or "ἀ" <= x <= "῿" else x for x in unicodedata.normalize("NFC", s))
    plain = unicodedata.normalize("NFKD", "".join(map(_spelled, bare.translate(TABLE))))
    return plain.encode("ascii", "ignore").decode()


@F.pandas_udf(T.StringType())
def transliterate(s: pd.Series) -> pd.Series:
    return s.map(to_ascii)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of the longest-matching-blocks comparison, first argument first; null scores 0."""
    return pd.Series([0.0 if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")
