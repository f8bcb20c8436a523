"""Personal data: labelers vote on spans, and a classifier learns from their votes.

Expressions propose spans: the strict forms of each kind, and looser forms that
may be personal data. Labelers (form, check, gazetteer, context, edges) vote for,
against or not at all. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, without labelled data; a logistic model
over features of the spans is then trained on the resulting probabilities, and
decides about the looser ones. Strict spans always stay. All that grows with the
texts runs in DataFrame operations; what reaches the driver are counts of vote
and feature patterns, whose number is fixed by the labelers.

Rows: a null text counts as empty; repeated rows and rows without an id are
searched each; extra columns are not read. Empty tables give empty results, and
a model without spans to learn from keeps the strict ones only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.llm.common import ascii_lower, staged
from spanloom.llm.spans import matches

KINDS = ["email", "ip", "card", "phone"]

#: Linear forms of the strict expressions: a run is only entered at its beginning
#: or where the last match ended, which changes no match.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?"
             r"[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}){1,8}",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
}

#: Fixed word lists of the gazetteer and context labelers.
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us"]
CARD_PREFIXES = ["4", "51", "52", "53", "54", "55", "34", "37", "35", "60", "62", "65"]
CALLING_CODES = ["1", "33", "34", "44", "49", "39", "31", "41", "43", "7", "81", "86", "91"]
CUES = {
    "email": ["mail", "contact", "kontakt", "correo", "courriel", "write to"],
    "ip": ["ip", "host", "server", "address", "adresse", "dirección"],
    "card": ["card", "visa", "master", "karte", "tarjeta", "carte", "payment"],
    "phone": ["tel", "phone", "call", "fax", "mobil", "fon", "llam", "appel"],
}
AGAINST = ["version", "isbn", "order", "invoice", "serial", "build", "release"]

#: Labelers with the reliability that is assumed before any data.
LABELERS = {"form": 0.75, "check": 0.95, "gazetteer": 0.7, "context": 0.8, "edges": 0.6}
#: Spans and the text around them that labelers see, in code points.
AROUND = 24


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits of a number pass the check sum; from the right, every second is doubled."""
    values = F.transform(F.split(F.reverse(number), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    places = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, text: Column) -> Column:
    """The check that a match of the strict expression must pass."""
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3)
                        & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits(text)).between(13, 19) & luhn(digits(text))
    if kind == "phone":
        return F.length(digits(text)).between(9, 15)
    return F.lit(True)


def _gazetteer(kind: str, text: Column) -> Column:
    number = digits(text)

    def starts(prefixes: list[str]) -> Column:
        return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: number.startswith(p))

    if kind == "email":
        return F.when(ascii_lower(F.element_at(F.split(text, r"[.\])]\x20?"), -1)).isin(TOP_DOMAINS), 1).otherwise(-1)
    if kind == "ip":
        return F.when(text.rlike(r"^(0|127|255|22[4-9]|23\d)\."), -1).otherwise(0)
    if kind == "card":
        return F.when(starts(CARD_PREFIXES), 1).otherwise(0)
    return F.when(starts(CALLING_CODES), 1).otherwise(0)


def _context(kind: str, before: Column) -> Column:
    """Words before a span speak for or against it."""
    low = ascii_lower(before)

    def any_of(words: list[str]) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))

    return F.when(any_of(AGAINST), -1).when(any_of(CUES[kind]), 1).otherwise(0)


def _span(kind: str, text: Column, x: Column, strict: bool) -> Column:
    stop = x["start"] + F.length(x["text"])
    begin = F.greatest(x["start"] - AROUND, F.lit(0))
    before = text.substr(begin + 1, x["start"] - begin)
    after = text.substr(stop + 1, F.lit(1))
    good = passes(kind, x["text"]) if strict else F.lit(False)
    check = F.when(passes("phone", x["text"]) if kind == "phone" else good, 1).otherwise(-1) \
        if kind != "email" else F.lit(0)
    tight = before.rlike(r"[\p{L}0-9]$") | after.rlike(r"^[\p{L}0-9]")
    votes = F.array(F.lit(1 if strict else -1), check, _gazetteer(kind, x["text"]),
                    _context(kind, before), F.when(tight, -1).otherwise(1))
    shape = F.concat_ws("|", F.when(tight, "tight").otherwise("free"),
                        F.when(x["text"].rlike(r"[ ().\[\]-]"), "parted").otherwise("plain"),
                        F.least(F.length(x["text"]).bitwiseAND(F.lit(-4)), F.lit(32)).cast("string"),
                        F.least(F.length(digits(x["text"])).bitwiseAND(F.lit(-4)), F.lit(20)).cast("string"),
                        F.when(_context(kind, before) > 0, "cue").otherwise("none"))
    return F.struct(F.lit(KINDS.index(kind)).alias("rank"), x["start"].alias("start"),
                    stop.alias("stop"), F.lit(kind).alias("kind"), good.alias("base"),
                    votes.alias("votes"), shape.alias("shape"))


def proposals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found): all proposed spans with votes and shape, by kind and start."""
    text_ = F.coalesce(F.col(text), F.lit(""))
    lists = []
    may = {"email": text_.contains("@"), "phone": text_.contains("+"),
           "ip": text_.rlike(r"[0-9]\.[0-9]"), "card": text_.rlike("[0-9](?:[ -]?[0-9]){12}")}
    may_loosely = {"email": text_.contains("at)") | text_.contains("at]"),
                   "phone": text_.rlike(r"[0-9][\x20.-][0-9]{3}")}
    for kind in KINDS:
        lists.append(_spans(kind, text_, STRICT[kind], may[kind], True))
        if kind in LOOSE:
            lists.append(_spans(kind, text_, LOOSE[kind], may_loosely[kind], False))
    return docs.select(doc_id, F.array_sort(F.concat(*lists)).alias("found"))


def _spans(kind: str, text: Column, regex: str, may: Column, strict: bool) -> Column:
    return F.transform(matches(text, regex, may), lambda x: _span(kind, text, x, strict))


@dataclass
class Model:
    """Reliabilities of the labelers by kind, and weights of the span classifier."""

    reliability: dict[str, dict[str, float]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)

    def probability(self, span: Column) -> Column:
        if not self.weights:
            return F.lit(0.0)
        known = F.create_map(*[F.lit(x) for k, v in sorted(self.weights.items()) for x in (k, v)])
        score = F.aggregate(_features(span), F.lit(0.0),
                            lambda a, f: a + F.coalesce(F.element_at(known, f), F.lit(0.0)))
        return 1 / (1 + F.exp(-score))


def _features(span: Column) -> Column:
    """A span's kind, and its kind with each part of its shape."""
    return F.concat(F.array(span["kind"]), F.transform(
        F.split(span["shape"], r"\|"), lambda v, i: F.concat_ws(
            ":", span["kind"], i.cast("string"), v)))


def expectation_maximisation(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50,
                             prior: float = 0.7) -> tuple[dict, dict]:
    """Probability of each (kind, votes) to be real, and the labelers' reliabilities.

    A labeler is right with one probability where it votes; votes are independent
    given the truth. What is assumed of a labeler weighs as much as its votes, so
    that labelers that mostly agree cannot outvote a good one altogether.
    """
    truth, reliability = {}, {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = [(v, n) for k, v, n in patterns if k == kind]
        assumed, share = list(LABELERS.values()), prior
        right = list(assumed)
        for _ in range(rounds):
            odds = {}
            for votes, _ in own:
                z = math.log(share / (1 - share))
                for vote, r in zip(votes, right):
                    z += vote * math.log(r / (1 - r))
                odds[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            total = sum(n for _, n in own)
            share = (sum(n * odds[v] for v, n in own) + 2 * prior) / (total + 2)
            for i in range(len(assumed)):
                votes = [(v, n) for v, n in own if v[i]]
                agree = sum(n * (odds[v] if v[i] > 0 else 1 - odds[v]) for v, n in votes)
                total = sum(n for _, n in votes)
                right[i] = min(0.99, max(0.5, (agree + assumed[i] * (total + 4)) / (2 * total + 4)))
        truth |= {(kind, v): p for v, p in odds.items()}
        reliability[kind] = dict(zip(LABELERS, right))
    return truth, reliability


def logistic(rows: list[tuple[list[str], float, float]], rounds: int = 300, rate: float = 0.5,
             penalty: float = 1e-3) -> dict[str, float]:
    """Weights of features by gradient descent; rows are (features, wanted, weight)."""
    weights: dict[str, float] = {f: 0.0 for features, _, _ in rows for f in features}
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        slope = {f: penalty * w for f, w in weights.items()}
        for features, wanted, n in rows:
            p = 1 / (1 + math.exp(-sum(weights[f] for f in features)))
            for f in features:
                slope[f] += (p - wanted) * n / total
        for f, s in slope.items():
            weights[f] -= rate * s
    return weights


def train(found: DataFrame) -> Model:
    """A model from the proposals' counts by kind, votes and shape."""
    span = found.select(F.explode("found").alias("x"))
    counts = span.groupBy("x.kind", "x.votes", "x.shape", _features(F.col("x")).alias("features")) \
        .agg(F.count("*").alias("n")).collect()
    if not counts:
        return Model()
    patterns: dict[tuple, int] = {}
    for r in counts:
        key = (r["kind"], tuple(r["votes"]))
        patterns[key] = patterns.get(key, 0) + r["n"]
    truth, reliability = expectation_maximisation([(k, v, n) for (k, v), n in sorted(patterns.items())])
    rows = [(r["features"], truth[r["kind"], tuple(r["votes"])], float(r["n"]))
            for r in sorted(counts, key=lambda r: (r["kind"], r["votes"], r["shape"]))]
    return Model(reliability, logistic(rows))


def find(docs: DataFrame, sure: float = 0.9, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans): strict spans, and these with the others of probability ``sure``.

    An added span does not overlap a strict one. Spans are (rank, start, stop, kind).
    """
    found = staged(proposals(docs, doc_id, text), "proposed_spans")
    model = train(found)
    base = F.filter("found", lambda x: x["base"])
    rows = found.select(doc_id, "found", base.alias("base"))
    added = F.filter("found", lambda x: ~x["base"] & (model.probability(x) >= sure) & ~F.exists(
        "base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return rows.select(doc_id, "base", F.array_sort(F.concat("base", added)).alias("spans"))
