"""Text normalisers as Column expressions; Python runs only on rows with markup in them."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters without a decomposition and what they fold to.
FOLDS = {
    "ß": "ss", "ẞ": "ss", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "æ": "ae", "Æ": "AE",
    "œ": "oe", "Œ": "OE", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ı": "i", "ŧ": "t",
}
# LaTeX accent macros and the combining marks they stand for.
ACCENTS = {
    "`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", '"': "\u0308", "=": "\u0304", ".": "\u0307", "u": "\u0306",
    "r": "\u030a", "H": "\u030b", "v": "\u030c", "d": "\u0323", "c": "\u0327", "k": "\u0328", "b": "\u0331",
}
# LaTeX macros that name a letter.
GLYPHS = {
    "ss": "ß", "aa": "å", "AA": "Å", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "dh": "ð", "DH": "Ð", "th": "þ", "TH": "Þ",
    "dj": "đ", "DJ": "Đ", "l": "ł", "L": "Ł", "o": "ø", "O": "Ø", "i": "ı", "j": "ȷ",
}

WHITE = r"(?U)\s+"


def blank(c: Column) -> Column:
    """'' for null, otherwise trimmed."""
    return F.trim(F.coalesce(c, F.lit("")))


def safe_lower(c: Column) -> Column:
    return F.lower(blank(c))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WHITE, " "))


@lru_cache(1)
def _fold_tables() -> tuple[str, str, str, dict[str, str]]:
    """(letters, bases, marks, longer): single letters and their bases, combining marks, and letters of several bases."""
    letters, bases, longer = [], [], dict.fromkeys(())
    longer = {k: v for k, v in FOLDS.items() if len(v) > 1}
    for k, v in FOLDS.items():
        if len(v) == 1:
            letters.append(k)
            bases.append(v)
    for code in [*range(0xA0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c in FOLDS or plain == c or not plain:
            continue
        if len(plain) == 1:
            letters.append(c)
            bases.append(plain)
        elif plain.isalpha():
            longer[c] = plain
    marks = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))
    return "".join(letters), "".join(bases), marks, longer


def fold(c: Column) -> Column:
    """Letters without their diacritics."""
    letters, bases, marks, longer = _fold_tables()
    out = F.translate(c, letters + marks, bases)
    rare = "[" + "".join(longer) + "]"
    full = out
    for k, v in longer.items():
        full = F.replace(full, F.lit(k), F.lit(v))
    return F.when(out.rlike(rare), full).otherwise(out)


#: Accents go on letters that have lost their dot.
DOTLESS = {"ı": "i", "ȷ": "j"}


def _macro(text: str, at: int) -> tuple[str, int]:
    """Name of the macro whose backslash is at `at`, and the place behind it: a run of letters, or any one character."""
    stop = at + 1
    while stop < len(text) and text[stop].isascii() and text[stop].isalpha():
        stop += 1
    stop = max(stop, at + 2)
    return text[at + 1 : stop], stop


def _letter_at(text: str, at: int) -> tuple[str, int] | None:
    """The one letter that a macro's argument at `at` comes to (bare, in braces or a macro itself), and the place behind."""
    while text[at : at + 1].isspace():
        at += 1
    match text[at : at + 1]:
        case "{":
            if (inner := _letter_at(text, at + 1)) is None:
                return None
            letter, stop = inner
            while text[stop : stop + 1].isspace():
                stop += 1
            return (letter, stop + 1) if text[stop : stop + 1] == "}" else None
        case "\\":
            return _decoded(text, at)
        case c:
            return (c, at + 1) if c.isalpha() else None


def _decoded(text: str, at: int) -> tuple[str, int] | None:
    """What the macro at `at` stands for, and the place behind it; None for other macros than letters and accents."""
    name, stop = _macro(text, at)
    if name in GLYPHS:
        return GLYPHS[name], stop
    if name not in ACCENTS or (argument := _letter_at(text, stop)) is None:
        return None
    letter, stop = argument
    return unicodedata.normalize("NFC", DOTLESS.get(letter, letter) + ACCENTS[name]), stop


def decode_accents_py(text: str) -> str:
    """LaTeX accent and letter macros as Unicode letters, from left to right; other macros stay."""
    out, done = [], 0
    while (at := text.find("\\", done)) >= 0:
        letter, stop = _decoded(text, at) or (text[at : _macro(text, at)[1]], _macro(text, at)[1])
        out += [text[done:at], letter]
        done = stop
    return "".join([*out, text[done:]])


def to_plain_py(text: str) -> str:
    """Entities and accents decoded; formulas, commands and braces removed; white space collapsed."""
    t = re.sub(r"\$[^$]*\$", " ", html.unescape(text))
    t = re.sub(r"\\[a-zA-Z]+(\s*\[[^\]]*\])?(\s*\{[^}]*\})?", " ", decode_accents_py(t))
    return " ".join(re.sub(r"[{}]", "", t).split())


@F.pandas_udf(T.StringType())
def _to_plain(s: pd.Series) -> pd.Series:
    return s.map(to_plain_py, na_action="ignore")


@F.pandas_udf(T.StringType())
def _decode_accents(s: pd.Series) -> pd.Series:
    return s.map(decode_accents_py, na_action="ignore")


def to_plain(c: Column) -> Column:
    """Plain text of a field; '' for null. Fields without markup never reach Python."""
    c = F.coalesce(c, F.lit(""))
    marked = c.rlike(r"[\\&${}]")
    return F.when(marked, _to_plain(F.when(marked, c))).otherwise(squeeze(c))


def decode_accents(c: Column) -> Column:
    marked = F.contains(c, F.lit("\\"))
    return F.when(marked, _decode_accents(F.when(marked, c))).otherwise(c)


def title_key(c: Column, markup: bool = True) -> Column:
    """The form in which titles are compared. markup=False: the field is known to hold none."""
    plain = to_plain(c) if markup else F.coalesce(c, F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold(plain)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def word_tokens(c: Column) -> Column:
    """Words between white space; none for null or ''."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), WHITE), "")


def near_miss_title(a: Column, b: Column, score: Column, threshold: float = 0.90, edits: int = 3) -> Column:
    """Titles so alike that they pass, yet several edits apart."""
    return (score >= threshold) & (F.levenshtein(a, b) >= edits)


def word_diff(a: Column, b: Column) -> Column:
    """struct(added, removed, common, substitutions) of two texts' word sets; added are b's."""
    x, y = F.array_distinct(word_tokens(a)), F.array_distinct(word_tokens(b))
    added, removed = F.array_sort(F.array_except(y, x)), F.array_sort(F.array_except(x, y))
    return F.struct(added.alias("added"), removed.alias("removed"), F.array_sort(F.array_intersect(x, y)).alias("common"), F.least(F.size(added), F.size(removed)).alias("substitutions"))


def truncate_abstract(c: Column, limit: int = 2000) -> Column:
    """At most limit characters, cut back to a space beyond four fifths of it, with an ellipsis."""
    head = F.substring(c, 1, limit)
    back = F.length(F.regexp_extract(head, r"^(?s)(.*)\s", 1))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.when(back > 0.8 * limit, F.rtrim(F.substring(head, F.lit(1), back))).otherwise(head), F.lit("...")))


def levenshtein_within(a: Column, b: Column, most: int) -> Column:
    return F.levenshtein(a, b) <= most
