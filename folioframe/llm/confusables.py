"""Visually identical text with different characters: one consistent form for every value.

For every token the resolved script set is the intersection of its characters' script sets. An
empty intersection means mixed scripts: the token is respelled in the script in which all its
letters have a look-alike. A token of one script whose letters all have look-alikes in the
script of the text around it is a whole-script confusable and is respelled likewise. Words that
are properly in another alphabet have letters without look-alikes and stay. What remains is
normalised: composed accents, ordinary spaces, nothing invisible, ordinary width, separate letters
for ligatures, plain digits, and in page ranges the hyphen-minus (the en dash is kept).

Kept as they are: typographic quotes, dashes other than the hyphen-minus in titles, superscripts,
fractions and signs. Defined results: null stays null and is never reported; an empty text stays
empty; the work per value is linear in its length; values are independent rows, so the stage is
narrow. ``changed`` is true exactly where the plain form differs.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters of three alphabets, as (latin, cyrillic, greek); "" has none.
LOOK_ALIKES = [
    ("A", "А", "Α"), ("B", "В", "Β"), ("C", "С", "Ϲ"), ("E", "Е", "Ε"), ("H", "Н", "Η"), ("I", "І", "Ι"),
    ("J", "Ј", "Ϳ"), ("K", "К", "Κ"), ("M", "М", "Μ"), ("N", "", "Ν"), ("O", "О", "Ο"), ("P", "Р", "Ρ"),
    ("S", "Ѕ", ""), ("T", "Т", "Τ"), ("X", "Х", "Χ"), ("Y", "У", "Υ"), ("Y", "Ү", ""), ("Z", "", "Ζ"),
    ("Q", "Ԛ", ""), ("W", "Ԝ", ""), ("a", "а", "α"), ("c", "с", "ϲ"), ("d", "ԁ", ""), ("e", "е", ""),
    ("h", "һ", ""), ("i", "і", "ι"), ("j", "ј", "ϳ"), ("k", "", "κ"), ("l", "ӏ", ""), ("o", "о", "ο"),
    ("p", "р", "ρ"), ("q", "ԛ", ""), ("s", "ѕ", ""), ("u", "", "υ"), ("v", "ѵ", "ν"), ("w", "ԝ", ""),
    ("x", "х", "χ"), ("y", "у", "γ"), ("y", "ү", ""),
    ("é", "", "έ"), ("ó", "", "ό"), ("í", "", "ί"), ("ï", "ї", "ϊ"), ("Ï", "Ї", "Ϊ"), ("ë", "ё", ""), ("Ë", "Ё", ""),
]
#: Letters that stand for digits between digits (fixed values).
DIGIT_LIKE = {"O": "0", "o": "0", "I": "1", "l": "1"}
_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
#: Greek look-alikes that count only in mixed tokens, not as whole words: they are common symbols.
_SYMBOLS = frozenset("αγικνρυχ")


def _table() -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {s: {} for s in _SCRIPTS}
    for row in LOOK_ALIKES:
        for i, s in enumerate(_SCRIPTS):
            for j, ch in enumerate(row):
                if j != i and ch and row[i]:
                    out[s].setdefault(ch, row[i])
    return out


_TO = _table()


@lru_cache(maxsize=4096)
def script_set(ch: str) -> frozenset[str] | None:
    """Scripts of a letter (augmented for Han and the kana); None for common and inherited characters."""
    if not unicodedata.category(ch).startswith("L"):
        return None
    name = unicodedata.name(ch, "")
    first = name.split(" ", 1)[0]
    if first in ("FULLWIDTH", "HALFWIDTH", "MATHEMATICAL", "MODIFIER", "FEMININE", "MASCULINE", "MICRO"):
        return None
    if first == "CJK":
        return frozenset(("HAN", "JAPANESE", "KOREAN"))
    if first in ("HIRAGANA", "KATAKANA"):
        return frozenset((first, "JAPANESE"))
    if first == "HANGUL":
        return frozenset(("HANGUL", "KOREAN"))
    return frozenset((first,))


@lru_cache(maxsize=4096)
def plain_char(ch: str) -> str:
    """Plain form of one character outside the question of alphabets."""
    if ch in "\n\r\t" or " " <= ch <= "~":
        return ch
    cat = unicodedata.category(ch)
    if cat == "Zs":
        return " "
    if cat in ("Zl", "Zp") or ch == "\x85":
        return "\n"
    if cat in ("Cf", "Cc") or 0xFE00 <= ord(ch) <= 0xFE0F or ch in "ᅟᅠㅤﾠ͏":
        return ""
    if cat == "Nd":
        return str(unicodedata.decimal(ch))
    kind = unicodedata.decomposition(ch)
    if kind.startswith(("<wide>", "<narrow>", "<small>", "<font>")):
        return "".join(plain_char(c) for c in unicodedata.normalize("NFKC", ch))
    if kind.startswith("<compat>") and cat[0] == "L" and ch != "µ":
        return unicodedata.normalize("NFKC", ch)
    return ch


def resolved(token: str) -> tuple[frozenset[str] | None, Counter]:
    """Resolved script set of a token (None: no letters; empty: mixed) and its letters by script."""
    out, seen = None, Counter()
    for ch in token:
        s = script_set(ch)
        if s is not None:
            out = s if out is None else out & s
            seen[min(s)] += 1
    return out, seen


def _respell(token: str, script: str) -> str | None:
    """The token in ``script``, or None where a letter of another script has no look-alike."""
    to, out = _TO.get(script), []
    if to is None:
        return None
    for ch in token:
        s = script_set(ch)
        if s is None or script in s:
            out.append(ch)
        elif ch in to:
            out.append(to[ch])
        else:
            return None
    return "".join(out)


_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*", re.U)
_ROMAN = re.compile(r"[IVXLCDM]+$")
_DASHES = re.compile("[‐‑‒—―⁃−﹘﹣－˗۔➖⸺⸻]")
_BETWEEN_DIGITS = re.compile(r"(?<=\d)[OoIl]+(?=[\dOoIl]*(?:\b|\d))|\b[OIl](?=\d)")

#: A word that is a number of three and more digits but for look-alikes: 19O4, but neither H2O, O157 nor 5l.
_NUMBER = re.compile(r"(?<![^\W_])(?!O)(?=[OoIl]*\d[OoIl]*\d)(?=\d*[OoIl])[\dOoIl]{3,}(?![^\W_])")

#: Text of composed Latin letters, ordinary spaces and typographic marks is plain as it stands.
_LATIN = re.compile("[\n\r\t -~¡-¬®-ıĴ-ľŁ-ňŊ-ž‘-‟–—…]*")


def plain_text(text: str, field: str = "title") -> str:
    """The consistent form of a value; ``field`` is 'title' or 'pages'."""
    if text.isascii():
        if not re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text) and not (_BETWEEN_DIGITS if field == "pages" else _NUMBER).search(text):
            return text
    elif field == "title" and _LATIN.fullmatch(text) and not _NUMBER.search(text):
        return text
    out = unicodedata.normalize("NFC", text)
    out = unicodedata.normalize("NFC", "".join(map(plain_char, out)))
    if field == "pages":
        out = _DASHES.sub("-", out)
    if not out.isascii():
        around: Counter = Counter()
        for m in _WORD.finditer(out):
            s, seen = resolved(m[0])
            if s:
                around[min(s)] += sum(seen.values())
        main = around.most_common(1)[0][0] if around else "LATIN"

        def fix(m: re.Match) -> str:
            token = m[0]
            s, seen = resolved(token)
            if s is None:
                return token
            if not s:  # mixed: the script in which the whole token can be spelled, the most frequent first
                order = sorted(seen, key=lambda x: (-seen[x], x != main, x))
                for script in [*order, main]:
                    new = _respell(token, script)
                    if new is not None:
                        return new
                return token
            if main not in s and around[min(s)] < around[main] and not (_ROMAN.match(token) or set(token) <= _SYMBOLS):
                new = _respell(token, main)
                if new is not None and (main == "LATIN" or len(token) == 1 or not token.isascii()):
                    return new
            return token

        if field == "pages":  # page ranges are Latin letters and digits
            out = "".join(_TO["LATIN"].get(ch, ch) for ch in out)
        else:
            out = _WORD.sub(fix, out)
    return _BETWEEN_DIGITS.sub(_digits, out) if field == "pages" else _NUMBER.sub(_digits, out)


def _digits(m: re.Match) -> str:
    return "".join(DIGIT_LIKE.get(c, c) for c in m[0])


def plain_column(column: Column | str, field: str) -> Column:
    """Consistent form of a column; null stays null."""

    @F.pandas_udf(T.StringType())
    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([None if v is None else plain_text(v, field) for v in values], dtype=object)

    return plain(F.col(column) if isinstance(column, str) else column)


#: Values that may need work; all others are plain by inspection in the JVM.
_SUSPECT = r"[^\n\r\t -~]|\d[OoIl]|\b[OIl]\d"


def consistent(records: DataFrame, fields: tuple[str, ...] = ("title", "pages")) -> DataFrame:
    """(entry_id, field_key, value, plain, changed) of every title and page range.

    Plain ASCII values, the great majority, never cross to Python: a null is sent instead.
    """
    long = records.select(
        "entry_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field_key"), F.col(f).alias("value")) for f in fields))).alias("f")
    ).select("entry_id", "f.field_key", "f.value").filter("value IS NOT NULL")
    suspect = F.col("value").rlike(_SUSPECT)
    for f in fields:
        long = long.withColumn(f"__{f}", F.when(suspect & (F.col("field_key") == f), F.col("value")))
    fixed = F.coalesce(*(plain_column(f"__{f}", f) for f in fields), F.col("value"))
    return long.withColumn("plain", fixed).withColumn("changed", F.col("plain") != F.col("value")).drop(*(f"__{f}" for f in fields))
