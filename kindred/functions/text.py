"""Names and text: Unicode normalisation needs Python; everything else is built in."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_WORD = re.compile(r"[^\w]+")
#: What str.strip() takes off: Unicode white space and the separators 0x1C-0x1F.
_EDGE = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"
#: Hint tokens: three or more ASCII letters, or two or more kana or CJK characters (fixed values).
HINT_TOKEN = "([A-Za-z]{3,}|[\u3040-\u30ff\u3400-\u9fff]{2,})"
_TOKEN = re.compile(HINT_TOKEN)


def normal(value: str) -> str:
    """NFKC, case folded, without anything but letters, digits and underscores."""
    return _NOT_WORD.sub("", unicodedata.normalize("NFKC", value).casefold())


def _each(f):
    """A series function that works out equal values of a batch once; null stays null."""

    def run(values: pd.Series) -> pd.Series:
        known = {x: f(x) for x in values.dropna().unique()}
        return values.map(known).astype(object).where(values.notna(), None)

    return run


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _ascii(value: Column) -> Column:
    return value.rlike(r"\A[\x00-\x7F]*\z")


def _plain(value: Column) -> Column:
    """``normal`` of ASCII text, by built-in functions."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9_]+", "")


def _fast(value: Column, built_in: Column, slow, kind: str, is_ascii: Column) -> Column:
    """The built-in form of ASCII values; only the others go to Python (as nulls, ASCII ones cost nothing there)."""
    return F.when(is_ascii, built_in).otherwise(F.pandas_udf(slow, kind)(F.when(~is_ascii, value)))


def normalize_name(name: Column | str) -> Column:
    name = _column(name)
    return _fast(name, _plain(name), _each(normal), "string", _ascii(name))


def casefold(value: Column | str) -> Column:
    value = _column(value)
    return _fast(value, F.lower(value), _each(str.casefold), "string", _ascii(value))


def normalize_names(names: Column | str) -> Column:
    """An array of names, normalised."""
    names = _column(names)

    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: None if xs is None else [normal(x) for x in xs if x is not None])

    known = F.filter(names, lambda x: x.isNotNull())
    return _fast(names, F.transform(known, _plain), run, "array<string>", F.forall(known, _ascii))


def hinted(hint: str, comment: str) -> bool:
    """Whether a comment has the hint, both normalised, or any of the hint's tokens; an empty hint fits every comment."""
    plain = normal(hint)
    if not plain or plain in normal(comment):
        return True
    folded = comment.casefold()
    return any(t.casefold() in folded for t in _TOKEN.findall(hint))


def hint_match(hint: Column, comment: Column) -> Column:
    def run(hints: pd.Series, comments: pd.Series) -> pd.Series:
        known = {x: hinted(x[0] or "", x[1] or "") for x in set(zip(hints, comments, strict=True))}
        return pd.Series([known[x] for x in zip(hints, comments, strict=True)], dtype=bool)

    hint, comment = F.coalesce(hint, F.lit("")), F.coalesce(comment, F.lit(""))
    is_ascii, plain = _ascii(F.concat(hint, comment)), _plain(hint)
    built_in = (plain == "") | F.contains(_plain(comment), plain) | F.exists(hint_tokens(hint), lambda t: F.contains(F.lower(comment), F.lower(t)))
    other = lambda c: F.when(~is_ascii, c)
    return F.when(is_ascii, built_in).otherwise(F.pandas_udf(run, "boolean")(other(hint), other(comment)))


def strip(value: Column) -> Column:
    return F.regexp_replace(value, _EDGE, "")


def parse_optional_bool(value: Column) -> Column:
    """true/1/yes and false/0/no in any case; blank or null is null; anything else is an error."""
    word = F.lower(F.translate(strip(value), "ſ", "s"))
    return (
        F.when(value.isNull() | (word == ""), F.lit(None).cast("boolean"))
        .when(word.isin("true", "1", "yes"), F.lit(True))
        .when(word.isin("false", "0", "no"), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("Unsupported boolean value: "), value)).cast("boolean"))
    )


#: The decimal digits of every script but ASCII, in order.
DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.decimal(c, None) is not None)


def safe_int(value: Column, default: int = 0) -> Column:
    """The whole number that a text spells (signs, single underscores and digits of any script are fine), else the default.
    What a bigint cannot hold becomes its largest or smallest value."""
    plain = F.translate(strip(value.cast("string")), DIGITS, "".join(str(unicodedata.decimal(c)) for c in DIGITS))
    digits = F.when(plain.rlike(r"\A[+-]?[0-9]+(_[0-9]+)*\z"), F.translate(plain, "_", ""))
    beyond = F.when(F.startswith(digits, F.lit("-")), F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1))
    return F.when(digits.isNull(), F.lit(default)).otherwise(F.coalesce(digits.try_cast("bigint"), beyond)).cast("bigint")


def hint_tokens(hint: Column) -> Column:
    """Distinct tokens of a hint; case is folded by the caller where it matters."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(hint, F.lit("")), F.lit(HINT_TOKEN), 1))


def last_part(url: Column) -> Column:
    """What follows the last slash; empty stays empty, null becomes empty."""
    return F.coalesce(F.substring_index(url, "/", -1), F.lit(""))


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of a text padded as two blanks before and one after."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substr(padded, i, F.lit(3))))
