"""Exact substring join of two text collections, group by group.

Two ways, chosen per group by its measured size; both give the same pairs.

*Few texts on one side* (up to FEW_TEXTS of them, FEW_CHARS characters): they
travel as one array to the rows of the other side, which test each of them. The
other side may be of any size: its rows are shuffled once and a hot group can be
split, because the array is one row.

*Otherwise* an index join that never compares all pairs. A needle inside a longer text is cut off at its first and last token only; every
token between them is a whole token of that text, in the same order. So a needle
needs just one *anchor* - a short run of its inner tokens plus the characters
touching it - and can only lie in texts that hold the same anchor. The join runs
on (group keys, anchor hash), which spreads a hot group over all partitions, and
candidates are confirmed with ``contains``.

==========  ===================================================================
tokens      anchor
==========  ===================================================================
6 or more   the four tokens after the first
3 to 5      the longest inner token
2           the end of the first and the start of the second, 3 or 1 characters
1           a 3-, 2- or 1-character piece, looked up in the group's vocabulary
==========  ===================================================================
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.functions.rows import exploded
from spanloom.session import write_and_read

FEW_TEXTS = 128
FEW_CHARS = 1 << 18
LONG_RUN = 4
PIECES = (3, 1)


def _run(tokens: Column, start: Column, length) -> Column:
    """Anchor of ``length`` tokens from ``start`` with the touching characters."""
    length = F.lit(length)
    return F.xxhash64(
        length, F.right(F.get(tokens, start - 2), F.lit(1)),
        F.array_join(F.slice(tokens, start, length), " "),
        F.left(F.get(tokens, start + length - 1), F.lit(1)))


def _seam(left: Column, right: Column, a: int, b: int) -> Column:
    """Anchor around the space between two tokens."""
    return F.xxhash64(F.lit(-a), F.lit(-b), F.right(left, F.lit(a)), F.left(right, F.lit(b)))


def _piece_size(token: Column) -> Column:
    return F.when(F.length(token) >= PIECES[0], PIECES[0]).otherwise(PIECES[1])


def _needle_anchor(tokens: Column, n: Column) -> Column:
    inner = F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2)))
    longest = F.array_max(F.transform(inner, lambda i: F.struct(
        F.length(F.get(tokens, i - 1)).alias("size"), (-i).alias("at"))))["at"] * -1
    first, second = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
    seam = F.lit(None).cast("long")
    for a in PIECES:
        for b in PIECES:
            seam = F.when((_piece_size(first) == a) & (_piece_size(second) == b),
                          _seam(first, second, a, b)).otherwise(seam)
    return (F.when(n >= LONG_RUN + 2, _run(tokens, F.lit(2), LONG_RUN))
            .when(n >= 3, _run(tokens, longest, 1))
            .otherwise(seam))


def _inner_starts(n: Column, length: int) -> Column:
    return F.when(n >= length + 2, F.sequence(F.lit(2), n - length)).otherwise(
        F.array().cast("array<int>"))


def _run_anchors(tokens: Column, n: Column, lengths: list[int]) -> Column:
    def of_length(length: int) -> Column:
        return F.transform(_inner_starts(n, length), lambda i: _run(tokens, i, length))
    return F.array_distinct(F.concat(*map(of_length, lengths)))


def _seam_anchors(tokens: Column, n: Column) -> Column:
    def around(i: Column) -> Column:
        left, right = F.get(tokens, i - 1), F.get(tokens, i)
        return F.array(*[
            F.when((F.length(left) >= a) & (F.length(right) >= b), _seam(left, right, a, b))
            for a in PIECES for b in PIECES])
    seams = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), around))
    return F.array_distinct(F.array_compact(F.when(n >= 2, seams)))


def _pieces(token: Column, size: int) -> Column:
    """All distinct substrings of ``size`` characters."""
    starts = F.sequence(F.lit(1), F.length(token) - size + 1)
    found = F.transform(starts, lambda i: F.substring(token, i, F.lit(size)))
    return F.when(F.length(token) >= size, F.array_distinct(found))


def _only_groups_of(df: DataFrame, needles: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(needles.select(*keys).distinct(), keys, "left_semi") if keys else df


def contained_pairs(needles: DataFrame, hay: DataFrame, keys: list[str],
                    fold: str = "needle", few: int = FEW_TEXTS, hashed: bool = False) -> DataFrame:
    """Every (needle, hay) pair of one group where ``hay_text`` contains ``needle_text``.

    ``needles`` has keys, ``needle_id`` and ``needle_text``; ``hay`` has keys,
    ``hay_id``, ``hay_text`` and any further columns, which are kept. Texts are
    normalised (single spaces, trimmed, not empty); ids are unique in a group.
    Repeated texts should be folded by the caller first. ``fold`` names the side
    ("needle" or "hay") that usually has few texts per group. ``hashed`` says that the
    arrays of a task fit a hash table.
    """
    if not keys:
        return _pairs_without_groups(needles, hay)
    folded, other = (needles, hay) if fold == "needle" else (hay, needles)
    text = f"{fold}_text"
    small = (folded.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(F.length(text)).alias("_c"))
             .where((F.col("_n") <= few) & (F.col("_c") <= FEW_CHARS)).select(*keys))
    columns = [c for c in folded.columns if c not in keys]
    arrays = folded.join(small, keys, "left_semi").groupBy(*keys).agg(
        F.collect_list(F.struct(*columns)).alias("_few"))          # bounded by ``small``
    contains = ((lambda x: F.contains(F.col("hay_text"), x[text])) if fold == "needle"
                else (lambda x: F.contains(x[text], F.col("needle_text"))))
    arrays = arrays.hint("shuffle_hash") if hashed else arrays
    tested = exploded(other.join(arrays, keys), other.columns, F.filter("_few", contains), "_x")
    direct = tested.select(*other.columns, *[F.col(f"_x.{c}").alias(c) for c in columns])

    # written, so that the index reads the groups of many texts alone, as often as it does
    many = write_and_read(folded.join(small, keys, "left_anti"), "many_texts")
    if many.isEmpty():
        return direct
    others = write_and_read(_only_groups_of(other, many, keys), "texts_beside_many")
    needles, hay = (many, others) if fold == "needle" else (others, many)
    indexed = _indexed_pairs(needles, hay, keys, _shapes(needles))
    return direct.unionByName(indexed.select(*direct.columns))


def _pairs_without_groups(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """Any needle in any text. The needles are written: their size is then known to
    the optimizer, and only anchors of the lengths that they have are made of the texts.
    """
    needles = write_and_read(needles, "needles")
    return _indexed_pairs(needles, hay, [], _shapes(needles))


def _shapes(needles: DataFrame) -> set[int]:
    size = F.size(F.split("needle_text", " "))
    shape = (F.when(size >= LONG_RUN + 2, LONG_RUN + 2).when(size > 2, 3).otherwise(size))
    return {r[0] for r in needles.select(shape).distinct().collect()} or {2}        # four at most


def _indexed_pairs(needles: DataFrame, hay: DataFrame, keys: list[str],
                   shapes: set[int] = frozenset({1, 2, 3, LONG_RUN + 2})) -> DataFrame:
    """``shapes`` are the token counts that needles may have: 1, 2, 3 (to 5), 6 (or more)."""
    needles = (needles.withColumn("_tokens", F.split("needle_text", " "))
               .withColumn("_n", F.size("_tokens")))
    many = needles.where("_n >= 2").withColumn(
        "_anchor", _needle_anchor(F.col("_tokens"), F.col("_n")))
    single = needles.where("_n = 1")

    split_hay = (hay.select(*keys, "hay_id", F.split("hay_text", " ").alias("_tokens"))
                 .withColumn("_n", F.size("_tokens")))
    hay_id = [*keys, "hay_id"]
    id_cols = [*keys, "needle_id", "needle_text", "hay_id"]
    found = []
    if shapes & {3, LONG_RUN + 2}:
        lengths = [n for n, shape in ((1, 3), (LONG_RUN, LONG_RUN + 2)) if shape in shapes]
        runs = exploded(split_hay, hay_id, _run_anchors(F.col("_tokens"), F.col("_n"), lengths), "_anchor")
        found.append(many.where("_n > 2").join(runs, [*keys, "_anchor"]).select(*id_cols))
    if 2 in shapes:
        found.append(_pairs_of_two(split_hay, many.where("_n = 2"), keys))
    if 1 in shapes:
        found.append(_pairs_of_one(split_hay, single, keys))
    candidates = reduce(DataFrame.unionByName, found)
    return candidates.join(hay, [*keys, "hay_id"]).where(F.contains("hay_text", "needle_text"))


def _pairs_of_two(split_hay: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    hay_id = [*keys, "hay_id"]
    seams = exploded(_only_groups_of(split_hay, pairs, keys), hay_id,
                     _seam_anchors(F.col("_tokens"), F.col("_n")), "_anchor")
    return pairs.join(seams, [*keys, "_anchor"]).select(*keys, "needle_id", "needle_text", "hay_id")


def _pairs_of_one(split_hay: DataFrame, single: DataFrame, keys: list[str]) -> DataFrame:
    """One-token needles match the vocabulary of the group, then its texts."""
    hay_id = [*keys, "hay_id"]
    texts_of_token = exploded(_only_groups_of(split_hay, single, keys), hay_id,
                              F.array_distinct("_tokens"), "_token")
    vocabulary = texts_of_token.select(*keys, "_token").distinct()
    tokens_with = None
    for size in (1, 2, 3):
        sized = single.where(F.least(F.length("needle_text"), F.lit(3)) == size)
        pieces = exploded(_only_groups_of(vocabulary, sized, keys), [*keys, "_token"],
                          _pieces(F.col("_token"), size), "_piece")
        found = (sized.withColumn("_piece", F.left("needle_text", F.lit(size)))
                 .join(pieces, [*keys, "_piece"]).where(F.contains("_token", "needle_text"))
                 .select(*keys, "needle_id", "needle_text", "_token"))
        tokens_with = found if tokens_with is None else tokens_with.unionByName(found)
    return tokens_with.join(texts_of_token, [*keys, "_token"]).select(
        *keys, "needle_id", "needle_text", "hay_id").distinct()
