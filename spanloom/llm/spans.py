"""Places of regular-expression matches in texts, as native columns.

Spark gives the matches of an expression but not where they are. The pieces that
``split`` leaves between the same matches have the missing lengths: a match
begins behind the pieces and matches before it. Both walk a text once.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def matches(text: Column, regex: str, may: Column, group: int | None = None) -> Column:
    """Array of (start, text, part) of all leftmost matches; offsets in code points.

    ``regex`` must not match the empty string. ``may`` is a cheap necessary
    condition: where it is false, the text is not searched. ``part`` is a group.
    """
    pattern = F.lit(regex)
    found = F.regexp_extract_all(text, pattern, 0)
    parts = F.regexp_extract_all(text, pattern, group) if group else found
    pieces = F.split(text, regex, -1)
    rows = F.arrays_zip(found.alias("m"), parts.alias("p"), pieces.alias("gap"))
    start = F.struct(F.lit(0).alias("at"),
                     F.array().cast("array<struct<start:int,text:string,part:string>>").alias("out"))
    walked = F.aggregate(rows, start, _step, lambda acc: acc["out"])
    nothing = F.array().cast("array<struct<start:int,text:string,part:string>>")
    return F.when(may & text.rlike(regex), walked).otherwise(nothing)


def _step(acc: Column, row: Column) -> Column:
    begin = acc["at"] + F.length(row["gap"])
    return F.struct(
        (begin + F.coalesce(F.length(row["m"]), F.lit(0))).alias("at"),
        F.when(row["m"].isNull(), acc["out"]).otherwise(F.array_append(
            acc["out"], F.struct(begin.alias("start"), row["m"].alias("text"),
                                 row["p"].alias("part")))).alias("out"))


def spans(found: Column, kind: str, rank: int) -> Column:
    """(start, rank, stop, kind) of matches, ready to be sorted by start, then kind."""
    return F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"),
        (x["start"] + F.length(x["text"])).alias("stop"), F.lit(kind).alias("kind")))


def written(found: Column) -> Column:
    """``kind:start:stop`` of the spans, comma-joined, in the given order."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
