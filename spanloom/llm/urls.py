"""URL filter: a blocked Bloom filter in front of an exact hash join.

Listed canonical URLs and host-and-path rules are keys. Every address gives the
keys that could be listed for it; each key is looked up in one block of 256 bits
of the filter, and only keys whose eight bits are set go on to the hash join
with the list, which removes false positives. The filter is a table of blocks
built by a bitwise aggregate; it is broadcast while its number of blocks, known
beforehand, is small, and joined by shuffle beyond.

Rows: a null url, or one without ``://``, has an empty host and path and is
allowed; repeated rows are judged each; null listed URLs are left out; the
columns that are added replace others of these names. Of rules that are equally
long the later one wins. Empty tables give empty results, an empty list lists
nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.llm.common import ascii_lower, staged

#: Blocks of the filter (a row of five longs each) that are broadcast at most.
BROADCAST_BLOCKS = 1 << 16
#: Rules that are broadcast at most.
BROADCAST_RULES = 1 << 14
WORDS = 4


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @staticmethod
    def of(verdict: str, text: str) -> "Rule":
        host, slash, path = text.partition("/")
        return Rule(verdict, host, slash + path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host after the first ``://`` and the path after it; empty if there is none."""
    url = F.coalesce(url, F.lit(""))
    cut = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, cut, 1)), F.regexp_extract(url, cut, 2)


def canonical(host: Column, path: Column) -> Column:
    """Address without scheme, ``www.`` or ``m.``, query, fragment, ``.html`` and last slashes."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""),
                    F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), "/+$", ""))


def _block(key: Column, blocks: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(blocks - 1)).alias("block")


def _bits(key: Column) -> list[Column]:
    """Two bits in each word of a block, from 48 bits of a second hash."""
    h = F.xxhash64(F.lit("bits"), key)
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"),
                           F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
           for i in range(2 * WORDS)]
    return [bit[2 * i].bitwiseOR(bit[2 * i + 1]) for i in range(WORDS)]


def blocked_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 ..): the filter over column ``key``; ``blocks`` is a power of two."""
    rows = keys.select(_block(F.col("key"), blocks),
                       *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_hits(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows whose ``key`` has all its bits set."""
    bits = _bits(F.col("key"))
    asked = rows.withColumns({"block": _block(F.col("key"), blocks)}
                             | {f"b{i}": b for i, b in enumerate(bits)})
    held = F.lit(True)
    for i in range(WORDS):
        held = held & (bloom[f"w{i}"].bitwiseAND(asked[f"b{i}"]) == asked[f"b{i}"])
    side = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom
    return asked.join(side, (asked["block"] == bloom["block"]) & held).select(
        *[asked[c] for c in rows.columns])


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, url: str = "url",
          bits_per_key: int = 16) -> DataFrame:
    """``pages`` with host, path, listed, rule and verdict.

    ``listed`` has blocked canonical URLs in a column ``canonical``. The longest rule
    that fits decides; without one a listed URL is blocked and any other is allowed.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    named = pages.drop("host", "path", "listed", "rule", "verdict").withColumns(
        {"host": host, "path": path})
    fixed = spark.createDataFrame(
        [("/" + r.host + r.path, (len(r.host) + len(r.path) << 32) + i) for i, r in enumerate(rules)],
        "key string, weight long")
    names = staged(listed.where(F.col("canonical").isNotNull()).select(
        F.concat(F.lit("="), "canonical").alias("key")).distinct(), "listed_urls")
    keys = names.unionByName(fixed.select("key"))
    wanted, blocks = (names.count() + len(rules)) * bits_per_key, 16
    while blocks * 64 * WORDS < wanted:
        blocks *= 2
    bloom = staged(blocked_filter(keys, blocks), "url_filter")
    # each address once, with the keys that could be in the list
    asked = named.select("host", "path").where("host <> '' OR path <> ''").distinct()
    asked = asked.select("host", "path", F.explode(_keys(rules)).alias("key"))
    hits = staged(possible_hits(asked.where(F.col("key").isNotNull()), bloom, blocks), "url_hits")
    fits = hits.join(F.broadcast(fixed) if len(rules) <= BROADCAST_RULES else fixed, "key")
    found = hits.join(names.hint("shuffle_hash"), "key")
    best = fits.select("host", "path", "weight", F.lit(0).alias("listed")).unionByName(
        found.select("host", "path", F.lit(None).cast("long").alias("weight"), F.lit(1).alias("listed")))
    best = best.groupBy("host", "path").agg(F.max("weight").alias("_weight"),
                                            F.max("listed").alias("_listed"))
    at = best["_weight"].bitwiseAND(F.lit((1 << 32) - 1)).cast("int") + 1
    texts = F.array(*[F.lit(r.host + r.path) for r in rules]).cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]).cast("array<string>")
    listed_here = F.coalesce(best["_listed"] == 1, F.lit(False))
    return named.join(best, ["host", "path"], "left").select(
        *[named[c] for c in named.columns], listed_here.alias("listed"),
        F.when(best["_weight"].isNotNull(), F.element_at(texts, at)).alias("rule"),
        F.when(best["_weight"].isNotNull(), F.element_at(verdicts, at))
        .when(listed_here, "block").otherwise("allow").alias("verdict"))


def _keys(rules: list[Rule]) -> Column:
    """The canonical name, and host suffix with path prefix for each shape a rule has."""
    host, path = F.col("host"), F.col("path")
    labels = F.split(host, r"\.")
    keys = [F.when(host != "", F.concat(F.lit("="), canonical(host, path)))]
    for n, length in sorted({(r.host.count(".") + 1, len(r.path)) for r in rules}):
        keys.append(F.when(
            (F.size(labels) >= n) & (F.length(path) >= length),
            F.concat(F.lit("/"), F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, length))))
    return F.array(*keys)
