"""Rule-based sentence splitting as one regular expression per block."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spanloom.functions.text import (
    ALNUM_SET, CLOSER_SET, DIGIT_SET, WORD_SET, WS_SET, collapse, has_alnum,
)

# --- fixed values: abbreviations that do not end a sentence -----------------
ABBREVIATIONS = (
    "mr mrs ms miss dr prof rev capt col gen lt sgt gov sen rep dept est inc ltd "
    "corp co jr sr etc vs no nos fig vol st mt ft sec min hrs approx esq univ "
    "calif ave blvd ct rd am pm jan feb mar apr jun jul aug sep sept oct nov dec "
    "mon tue wed thu fri sat sun"
).split()
# --- end of fixed values ----------------------------------------------------

# Markers are Unicode noncharacters, which never occur in exchanged text.
LINK = chr(0xFDD0)     # around a protected link
CUT = chr(0xFDD1)      # after a sentence
ANCHOR = chr(0xFDD2)   # counts as the last character of a protected link
_MARKS = ".!?"
_HIDDEN = "".join(map(chr, (0xFDD3, 0xFDD4, 0xFDD5)))  # . ! ? inside a link

_LINK_BODY = f"[^{WS_SET},;()]+"
_LOCAL = f"[{WORD_SET}.+-]"
# The local part of an address is taken whole from its first character; the
# possessive run keeps long unbroken words linear.
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[{WORD_SET}.-]+\.[a-zA-Z]{{2,}}"
_LINKS = rf"(?i:https?://){_LINK_BODY}|(?i:www\.){_LINK_BODY}|{_EMAIL}"
_MAY_HAVE_LINK = r"(?i)@|https?://|www\."

_GAP = rf"[ \t\n{CLOSER_SET}]"
_WORDLIKE = f"[{ALNUM_SET}{ANCHOR}]"
_BEFORE_STOP = rf"{_WORDLIKE}++{_GAP}*+\."
_SENTENCE_END = (
    # ! and ? always end one, at the last of a run
    rf"(?:[!?](?![!?])"
    # a full stop ends one after a word that is neither an abbreviation nor a
    # single letter, unless a digit or a lower-case letter follows
    rf"|(?<!{_WORDLIKE})(?={_BEFORE_STOP})"
    rf"(?!(?i:{'|'.join(ABBREVIATIONS)})(?!{_WORDLIKE}))"
    rf"(?!\p{{L}}(?!{_WORDLIKE}))"
    rf"{_BEFORE_STOP}(?!\.)(?= *+(?:\z|[^ {DIGIT_SET}\p{{IsLowercase}}])))"
    rf"[{CLOSER_SET}]*+"
)


def _protect(text: Column) -> Column:
    """Hide the marks inside links so that they cannot end a sentence.

    One trailing mark of a link is put back behind it: it belongs to the text.
    """
    pieces = F.split(F.regexp_replace(text, _LINKS, f"{LINK}$0{LINK}"), LINK)

    def shield(piece: Column, i: Column) -> Column:
        last = F.substring(piece, -1, 1)
        ends = last.isin(*_MARKS)
        kept = F.when(ends, F.substring(piece, F.lit(1), F.length(piece) - 1)).otherwise(piece)
        hidden = F.concat(F.lit(" " + LINK), F.translate(kept, _MARKS, _HIDDEN),
                          F.lit(LINK + ANCHOR + " "), F.when(ends, last).otherwise(""))
        return F.when(i % 2 == 1, hidden).otherwise(piece)

    return F.array_join(F.transform(pieces, shield), "")


def split_sentences(text: Column) -> Column:
    """Array of the sentence candidates of one block, in order."""
    def mark(t: Column) -> Column:
        return F.regexp_replace(t, _SENTENCE_END, f"$0{CUT}")

    marked = F.when(
        text.rlike(_MAY_HAVE_LINK),
        F.translate(mark(_protect(text)), _HIDDEN + LINK + ANCHOR, _MARKS)).otherwise(mark(text))
    return F.filter(F.transform(F.split(marked, CUT), lambda p: F.trim(p)), lambda p: p != "")


def block_lines(text: Column) -> Column:
    """Blocks of a plain text: its lines, collapsed, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), collapse), has_alnum)
