"""Character-level rules as Column expressions (all JVM side but NFKC)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# --- fixed values: character classes ---------------------------------------
# Every character str.isspace() accepts.
WS_SET = (r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
          r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS = f"[{WS_SET}]"
NOT_WS = f"[^{WS_SET}]"
# Letters and numbers; a word character adds the underscore.
ALNUM_SET = r"\p{L}\p{N}"
ALNUM = f"[{ALNUM_SET}]"
WORD_SET = ALNUM_SET + "_"
WORD = f"[{WORD_SET}]"
# Decimal digits plus the superscript, subscript and circled digits.
DIGIT_SET = (
    r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}"
    r"\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"
)
# Closing quotes and brackets that stay with the sentence they end.
CLOSER_SET = r"”\"'）)\]»"
# --- end of fixed values ----------------------------------------------------

WORD_START = f"(?<!{WORD})"
WORD_END = f"(?!{WORD})"

# Characters for which compatibility normalisation changes nothing when the
# whole string is made of them: printable ASCII, precomposed Latin letters and
# the usual quotes and dashes. Other strings take the NFKC function.
_NFKC_SAFE = (
    r"\A(?:[\x00-\x7f]++|[\x{bf}-\x{131}]++|[\x{a1}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}"
    r"\x{b7}\x{bb}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{2010}\x{2012}-\x{2015}"
    r"\x{2018}-\x{2022}]++)*+\z"
)

# Strings that the comparison form only lower-cases: of characters as above, without
# marks that it replaces, in words with one space between them.
_PLAIN = (
    r"\A(?:(?:[!-_a-~]++|[\x{bf}-\x{131}]++|[\x{a1}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}"
    r"\x{b7}\x{bb}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}]++)++(?: (?! |\z))?+)*+\z"
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _only_where(c: Column, pattern: str, changed: Column) -> Column:
    """``changed`` for the strings that hold ``pattern``, the rest untouched.

    A search is several times cheaper than a rewrite that finds nothing.
    """
    return F.when(c.rlike(pattern), changed).otherwise(c)


# Cheap superset of the whitespace other than the space itself.
_MAYBE_SPACE = r"[\t-\x1f\x{1680}-\x{3000}]|[\x85\xa0]"


def collapse(c: Column) -> Column:
    """Whitespace runs become one space, ends trimmed."""
    changed = F.regexp_replace(c, WS + "+", " ")
    return F.trim(F.when(F.contains(c, F.lit("  ")) | c.rlike(_MAYBE_SPACE), changed).otherwise(c))


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    ends = F.left(c, F.lit(1)).rlike(WS) | F.right(c, F.lit(1)).rlike(WS)
    return F.when(ends, F.regexp_replace(c, rf"\A{WS}++|(?<!{WS}){WS}++\z", "")).otherwise(c)


def words(c: Column) -> Column:
    """Tokens of a text whose only whitespace is the space (any block text)."""
    return F.array_remove(F.split(c, " "), "")


def word_count(c: Column) -> Column:
    plain = F.size(F.split(c, " "))
    return F.when(F.contains(c, F.lit("  ")), F.size(words(c))).otherwise(plain)


def has_alnum(c: Column) -> Column:
    return c.rlike(ALNUM)


def digit_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"[^{DIGIT_SET}]", ""))


def ascii_lower(c: Column) -> Column:
    """Lower-case the 26 ASCII letters only, as LIKE does."""
    return F.translate(c, _UPPER, _UPPER.lower())


def _ascii_lower_str(s: str) -> str:
    return s.translate(str.maketrans(_UPPER, _UPPER.lower()))


def contains_ci(c: Column, needle: str) -> Column:
    """Literal substring test, ASCII case-insensitive (escaped LIKE)."""
    return F.contains(ascii_lower(c), F.lit(_ascii_lower_str(needle)))


def like_ci(c: Column, needle: str) -> Column:
    """``%needle%`` with live wildcards, ASCII case-insensitive."""
    pattern = "%" + _ascii_lower_str(needle) + "%"
    return F.like(ascii_lower(c), F.lit(pattern), F.lit("\x00"))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    present = s.notna()
    if present.any():
        s = s.copy()
        s[present] = [unicodedata.normalize("NFKC", x) for x in s[present]]
    return s


def nfkc(c: Column) -> Column:
    """Compatibility normalisation; strings it cannot change never leave the JVM."""
    return F.coalesce(_nfkc(F.when(~c.rlike(_NFKC_SAFE), c)), c)


_FROM, _TO = "\t“”‘’`–—", " \"\"'''--"


def _compared(t: Column) -> Column:
    """Comparison form of a text that is compatibility-normalised."""
    return F.lower(collapse(_only_where(t, f"[{_FROM}]", F.translate(t, _FROM, _TO))))


def normalize(c: Column) -> Column:
    """Comparison form of a text: NFKC, straight quotes, plain dashes, lower case.

    Most strings take one search and no rewrite.
    """
    c = F.coalesce(c, F.lit(""))
    t = nfkc(F.when(~c.rlike(_PLAIN), c))
    return F.when(c.rlike(_PLAIN), F.lower(c)).otherwise(_compared(t))


def normalize_safe(c: Column) -> Column:
    """As ``normalize``, but NULL for strings that NFKC may change: no row goes to Python."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike(_PLAIN), F.lower(c)).when(c.rlike(_NFKC_SAFE), _compared(c))


def tokens(norm: Column) -> Column:
    """Distinct tokens of a normalised text."""
    return F.array_distinct(words(norm))


def text_key(t: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text where equal ones are counted."""
    return [F.xxhash64(t).alias("_h1"), F.xxhash64(F.lit("second"), t).alias("_h2")]
