"""Text normalisation and similarity as column expressions; Arrow UDFs only where Spark has no function."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import common_length, edit_distance, edit_distances

LEVELS = ("L0", "L1", "L2")

# Single characters folded at L1 and L2, and what they become.
FOLD_ONE = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'",
    "“": '"', "”": '"', "„": '"', "‟": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-",
    "—": "-", "―": "-", "−": "-",
    "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\u2009": " ", "\u200a": " ",
    "¹": "1", "²": "2", "³": "3",
    "⁰": "0", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9",
}
FOLD_MANY = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "…": "..."}
FOLD_GONE = "\u2022\uf0b7"
_FOLD = str.maketrans({**FOLD_ONE, **FOLD_MANY, **dict.fromkeys(FOLD_GONE)})

_SPACE = r"(?U)[\s\x1c-\x1f]+"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


def collapse(c: Column) -> Column:
    """Runs of Unicode white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def fold(c: Column) -> Column:
    out = F.translate(c, "".join(FOLD_ONE) + FOLD_GONE, "".join(FOLD_ONE.values()))
    for one, many in FOLD_MANY.items():
        out = F.replace(out, F.lit(one), F.lit(many))
    return out


def normalize(c: Column, level: str = "L1") -> Column:
    """L0: NFC and white space; L1: typography folded as well; L2: and case. Null and empty become empty."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}; one of {LEVELS}")
    out = nfc(F.coalesce(c, F.lit("")))
    out = collapse(out if level == "L0" else fold(out))
    return casefold(out) if level == "L2" else out


def tokens(c: Column, level: str = "L1") -> Column:
    text = normalize(c, level)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def norm_cell(c: Column, level: str = "L1") -> Column:
    """A cell's text; nothing but dashes and spaces counts as empty."""
    text = normalize(c, level)
    return F.when(text.rlike("^[-–— ]+$"), F.lit("")).otherwise(text)


def ws_lines(c: Column) -> Column:
    """No-break spaces to spaces and runs of blanks to one in each line; line breaks stay."""
    lines = F.transform(F.split(F.replace(c, F.lit("\u00a0"), F.lit(" ")), "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def norm_chars(c: Column) -> Column:
    """All but white space and list markers."""
    return F.regexp_replace(c, "(?U)[\\s\x1c-\x1f\u2022\uf0b7]", "")


def strip_marker(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^[\u2022\uf0b7][\\s\x1c-\x1f]*", "")


def is_tick(c: Column) -> Column:
    return c.rlike(r"^[-+]?\d+(\.\d+)?%?$")


@F.pandas_udf(T.StringType())
def _three_decimals(x: pd.Series) -> pd.Series:
    return x.map(lambda v: f"{v:.3f}")


def fmt3(c: Column) -> Column:
    """Three decimals, or a dash for null. The double's exact value is rounded, a tie to the even digit; Java's formats round its shortest decimals, up."""
    return F.when(c.isNull(), "—").otherwise(_three_decimals(c.cast("double")))


#: Texts of at most so many characters are compared in the JVM.
SHORT = 200


@F.pandas_udf(T.LongType())
def _long_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    out = [0] * len(a)
    long = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None and max(len(x), len(y)) > SHORT]
    for k, n in zip(long, edit_distances([(a.iloc[k], b.iloc[k]) for k in long]), strict=True):
        out[k] = n
    return pd.Series(out, dtype="int64")


def char_distance(a: Column, b: Column) -> Column:
    """Edit distance in code points: in the JVM for short texts, bit-parallel over whole texts for others."""
    short = F.greatest(F.length(a), F.length(b)) <= SHORT
    long = (a != b) & ~short
    return F.when(a == b, F.lit(0).cast("long")).when(short, F.levenshtein(a, b).cast("long")).otherwise(_long_distance(F.when(long, a), F.when(long, b)))


@F.pandas_udf(T.LongType())
def token_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0 if x == y else edit_distance(x.split(), y.split()) for x, y in zip(a, b, strict=True)], dtype="int64")


@F.pandas_udf(T.LongType())
def common_chars(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(x) if x == y else common_length(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def plain(text: str | None, level: str = "L1") -> str:
    """`normalize` of one text, for code that runs in Python anyway."""
    out = text or ""
    if not out.isascii():  # what is folded is outside ASCII
        out = unicodedata.normalize("NFC", out)
        if level != "L0":
            out = out.translate(_FOLD)
    out = " ".join(out.split())
    return out.casefold() if level == "L2" else out


@lru_cache(maxsize=100_000)
def plain_cell(text: str | None, level: str = "L1") -> str:
    """`norm_cell` of one text."""
    out = plain(text, level)
    return "" if out and not out.strip("-–— ") else out


def rate(distance: Column, size: Column, other: Column) -> Column:
    return F.when(size == 0, F.when(other == 0, 0.0).otherwise(1.0)).otherwise(distance.cast("double") / size)


def cer(gold: Column, pred: Column) -> Column:
    """Character error rate of normalised texts; may exceed 1."""
    return rate(char_distance(gold, pred), F.length(gold), F.length(pred))


def wer(gold: Column, pred: Column) -> Column:
    """Word error rate of normalised texts."""
    count = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))
    return rate(token_distance(gold, pred), count(gold), count(pred))


def similarity(a: Column, b: Column) -> Column:
    """Twice the common subsequence over both lengths of normalised texts; 1 for two empty ones."""
    size = F.length(a) + F.length(b)
    return F.when(size == 0, 1.0).otherwise(2.0 * common_chars(a, b) / size)


def accuracy(error: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), error))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def prf(tp: Column, gold: Column, pred: Column) -> list[Column]:
    """Precision, recall and F1 of counts; an empty side is right only if the other is empty."""
    p = F.when(pred > 0, tp / pred).otherwise(F.when(gold == 0, 1.0).otherwise(0.0))
    r = F.when(gold > 0, tp / gold).otherwise(F.when(pred == 0, 1.0).otherwise(0.0))
    return [p, r, f1(p, r)]


def count_accuracy(gold: Column, pred: Column, tolerance: float = 0.10) -> Column:
    """1 within the tolerance, falling to 0 at three times it."""
    error = F.abs(pred - gold) / gold
    return F.when(gold == 0, F.when(pred == 0, 1.0).otherwise(0.0)).when(error <= tolerance, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (error - tolerance) / (2 * tolerance)))
