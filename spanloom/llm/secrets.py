"""Secret scan with a trigram inverted index over the documents.

Each rule's expression is turned into a Boolean query: alternatives of trigrams
that all must occur in a matching text. The index holds postings of the trigrams
that the rule set asks for, found in one pass over the lower-cased texts. The
postings of an alternative are intersected per document, and only documents that
pass are searched for the rule. Rules without mandatory trigrams search all texts.

Rows: a null text counts as empty; rows with the same id share their candidates
and are searched each; rows without an id likewise; extra columns are not read.
Empty tables give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.llm.common import NULL_ID, ascii_lower, staged
from spanloom.llm.spans import matches, spans

#: Strings that a part of an expression may stand for while they are still listed.
LISTED = 64


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``regex`` whose ``group`` has at least ``least`` code points."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The first three are the base; a possessive count drops short runs without retries.
RULES = [
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                   r"([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}+"),
    Rule("hex", r"[0-9a-f]{16,}+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
]

Query = set[frozenset[str]] | None      # alternatives; None: any text may match


def trigram_query(regex: str) -> Query:
    """Alternatives of lower-cased trigrams, one of which every match contains."""
    query, run = _sequence(re._parser.parse(regex))
    query = _both(query, _listed(run))
    # an alternative that asks for more than another one adds nothing
    return query and {x for x in query if not any(y < x for y in query)}


def _lower(code: int) -> str:
    """As the index has it: A-Z only."""
    return chr(code + 32) if 65 <= code <= 90 else chr(code)


def _listed(strings: set[str]) -> Query:
    if not strings or min(map(len, strings)) < 3:
        return None
    return {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > LISTED:
        return min(a, b, key=len)
    return {x | y for x, y in product(a, b)}


def _sequence(items) -> tuple[Query, set[str]]:
    """The query of what is behind, and the strings of the run that is still open."""
    query, run = None, {""}
    for op, value in items:
        own, strings = _item(str(op), value)
        query = _both(query, own)
        if strings is not None and len(run) * len(strings) <= LISTED:
            run = {a + b for a, b in product(run, strings)}
        else:                      # the run ends here; a listed item begins the next one
            query = _both(query, _listed(run))
            run = strings or {""}
    return query, run


def _item(op: str, value) -> tuple[Query, set[str] | None]:
    """Query of one item, and all strings it stands for if they can be listed."""
    if op == "LITERAL":
        return None, {_lower(value)}
    if op == "AT":
        return None, {""}
    if op == "IN":
        literal = all(str(o) == "LITERAL" for o, _ in value)
        return None, {_lower(v) for _, v in value} if literal else None
    if op == "SUBPATTERN":
        return _closed(value[-1])
    if op == "BRANCH":
        parts = [_closed(x) for x in value[1]]
        if all(s is not None for _, s in parts):
            return None, set().union(*[s for _, s in parts])
        queries = [q if s is None else _both(q, _listed(s)) for q, s in parts]
        return None if None in queries else set().union(*queries), None
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = value
        query, strings = _closed(inner)
        if (low, high) == (0, 1) and strings is not None:
            return None, strings | {""}
        if low == 0:
            return None, None
        return (query if strings is None else _both(query, _listed(strings))), None
    return None, None


def _closed(items) -> tuple[Query, set[str] | None]:
    """As an item: its strings if the whole can be listed, else its query alone."""
    query, run = _sequence(items)
    whole = all(_item(str(o), v)[1] is not None for o, v in items) and len(run) <= LISTED
    if whole and query is None:
        return None, run
    return _both(query, _listed(run)), None


def _key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))


def trigram_index(docs: DataFrame, trigrams: set[str], doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """The written postings (trigram, doc) of ``trigrams``, sorted by trigram in each file."""
    names = sorted(trigrams)
    classes = ["[" + "".join(rf"\x{ord(c):02x}" if ord(c) < 256 else c for c in sorted(set(x))) + "]"
               for x in zip(*names)]
    # letters are tested place by place before the list is tried
    regex = f"(?={''.join(classes)})(?=({'|'.join(map(re.escape, names))}))"
    found = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(regex), 1))
    rows = docs.select(_key(doc_id).alias("doc"), F.explode(found).alias("trigram"))
    return staged(rows.select("trigram", "doc").sortWithinPartitions("trigram"), "trigram_index")


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(doc, rules): the queries that a document's trigrams satisfy, by number."""
    rows, full = [], []
    for rule, query in queries.items():
        for alternative in query:
            full.append((len(full), rule, len(alternative)))
            rows += [(t, full[-1][0]) for t in sorted(alternative)]
    spark = index.sparkSession
    asked = spark.createDataFrame(rows, "trigram string, branch int")
    wanted = spark.createDataFrame(full, "branch int, rule int, full long")
    # both tables are made of the rules, and so as small as these
    met = index.join(F.broadcast(asked), "trigram").groupBy("doc", "branch").agg(
        F.count_distinct("trigram").alias("met"))
    hits = met.join(F.broadcast(wanted), "branch").where("met = full")
    return hits.groupBy("doc").agg(F.collect_set("rule").alias("rules"))


def find(docs: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(doc_id, spans): all spans of a text by start, then by the order of the rules.

    A span is (start, rank, stop, kind); rank is the place of its rule. Offsets are
    code points, the stop is exclusive.
    """
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.regex)) is not None}
    rows = docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if queries:
        trigrams = set().union(*[t for q in queries.values() for t in q])
        hits = staged(candidates(trigram_index(rows, trigrams, doc_id, "_text"), queries), "candidates")
        rows = rows.join(hits, _key(doc_id) == hits["doc"], "left")
    else:
        rows = rows.withColumn("rules", F.array().cast("array<int>"))
    found = []
    for i, r in enumerate(rules):
        may = F.coalesce(F.array_contains("rules", i), F.lit(False)) if i in queries else F.lit(True)
        own = matches(F.col("_text"), r.regex, may, r.group or None)
        if r.least > 1:
            own = _long(own, r.least)
        found.append(spans(own, r.kind, i))
    return rows.select(doc_id, F.array_sort(F.concat(*found)).alias("spans"))


def _long(found: Column, least: int) -> Column:
    return F.filter(found, lambda x: F.length(x["part"]) >= least)
