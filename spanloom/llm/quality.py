"""Quality scores learned from preference pairs (Bradley-Terry).

A document's worth is a weighted sum of features of its text. Pairs of labelled
documents, a good and a poor one, say which is preferred; the weights maximise
the likelihood of these preferences, a logistic loss on feature differences. A
quantile of the labelled documents' worth, the share that the labels call poor,
is the threshold; the score is a logistic curve that has ``cut`` there.

Features of all texts are computed once and written; the weights are fitted on at
most ``sample`` labelled rows, those with the smallest hashes of their ids. Means and
scales of the features and the threshold are aggregates over all labelled rows, and
scoring is plain arithmetic on the written features.

Rows: null and empty texts have zero features and a score like any other;
repeated rows and rows without an id are scored each. Labels that are null, or
that contradict each other for one id, are not learned from. Without labels of
both kinds every score is ``cut``, so nothing is rejected. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq
from typing import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField

from spanloom.llm.common import NULL_ID, per_row, staged

#: Features of a text, all of them shares or bounded means.
FEATURES = ["upper", "digits", "marks", "symbols", "bars", "bangs", "stops", "other", "repeats",
            "variety", "word_length", "long_words", "line_length", "marked_words", "same_lines"]
#: Labelled rows that weights are fitted on at most.
SAMPLE = 20_000
#: Poor partners that each labelled document is paired with.
PARTNERS = 8

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def features(text: str | None) -> tuple[float, ...]:
    raw = (text or "").encode()
    size = len(raw)
    words = raw.split()
    if not words:
        return (0.0,) * len(FEATURES)
    n = len(words)

    def share(chars: bytes) -> float:
        return (size - len(raw.translate(None, chars))) / size

    letters = size - len(raw.translate(None, _LETTERS)) or 1
    lines = raw.split(b"\n")
    lengths = list(map(len, words))
    return ((size - len(raw.translate(None, _UPPER))) / letters, share(_DIGITS), share(_MARKS),
            share(b"#$%&*@^~=+<>"), raw.count(b"|") / n, raw.count(b"!") / n,
            (raw.count(b".") + raw.count(b",")) / n, share(b"{}[]()_/\\;:"),
            sum(map(eq, words, words[1:])) / n, len(set(words)) / n ** 0.75,
            min(sum(lengths) / n, 40.0) / 10, sum(map((20).__lt__, lengths)) / n,
            min(n / len(lines), 400.0) / 100, sum(map(_MARKED.__contains__, [w[-2:] for w in words])) / n,
            1 - len(set(lines)) / len(lines))


#: Two marks at the end of a word.
_MARKED = {bytes((a, b)) for a in _MARKS for b in _MARKS}


def feature_table(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and one column for each feature."""
    def run(texts: Iterable[str | None]) -> Iterator[tuple]:
        return map(features, texts)
    return per_row(docs, keep, text, [StructField(f"f_{x}", DoubleType()) for x in FEATURES], run)


@dataclass
class Ranking:
    """Weights of the scaled features, and the worth that ``cut`` stands for."""

    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float

    def worth(self) -> Column:
        worth = F.lit(0.0)
        for name, m, s, w in zip(FEATURES, self.means, self.scales, self.weights):
            worth = worth + (F.col(f"f_{name}") - F.lit(float(m))) * F.lit(float(w / s))
        return worth

    def score(self) -> Column:
        return 1 / (1 + F.exp(F.lit(self.threshold - float(np.log(self.cut / (1 - self.cut)))) - self.worth()))


def bradley_terry(good: np.ndarray, poor: np.ndarray, partners: int = PARTNERS,
                  penalty: float = 1e-3, rounds: int = 40, seed: int = 7) -> np.ndarray:
    """Weights by Newton steps on the loss of the preferences of good over poor rows."""
    deal = np.random.default_rng(seed)
    pairs = max(len(good), len(poor)) * partners
    x = good[deal.permutation(pairs) % len(good)] - poor[deal.permutation(pairs) % len(poor)]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))        # of the wrong preference
        slope = x.T @ p / pairs - penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / pairs + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(table: DataFrame, labels: DataFrame, cut: float = 0.7, sample: int = SAMPLE,
        doc_id: str = "doc_id") -> Ranking:
    """A ranking from ``labels`` (doc_id, label 0 or 1) of documents in a feature table.

    The weights are learned from at most ``sample`` labelled rows, chosen by the hash of
    their id; means, scales, the share of poor labels and the threshold are of all rows.
    """
    known = labels.where("label IS NOT NULL").groupBy(doc_id).agg(
        F.min("label").alias("label"), F.max("label").alias("most")).where("label = most") \
        .select(doc_id, "label")
    names = [f"f_{x}" for x in FEATURES]
    rows = staged(table.join(known, doc_id).select(doc_id, "label", *names), "labelled")
    one = np.ones(len(FEATURES))
    none = Ranking(one, one, np.zeros(len(FEATURES)), 0.0, cut)
    # decimal sums do not depend on the order of the rows
    exact = [F.sum(c.cast("decimal(28,18)")) for x in names for c in (F.col(x), F.col(x) * F.col(x))]
    n, good, poor, *sums = rows.agg(
        F.count("*"), F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0), *exact).first()
    if not good or not poor:
        return none
    means = np.array([float(x / n) for x in sums[::2]])
    scales = np.array([float(max(y / n - (x / n) ** 2, 0)) for x, y in zip(sums[::2], sums[1::2])]) ** 0.5
    scales[scales < 1e-9] = 1.0
    got = np.array(rows.orderBy(F.xxhash64(doc_id), doc_id).limit(sample)
                   .select("label", *names).collect(), float)              # at most ``sample``
    y, z = got[:, 0], (got[:, 1:] - means) / scales
    if not (y == 1).any() or not (y == 0).any():
        return none
    ranking = Ranking(means, scales, bradley_terry(z[y == 1], z[y == 0]), 0.0, cut)
    ranking.threshold = quantile_gap_of(rows.select(ranking.worth().alias("worth")), n, poor / n)
    return ranking


def _close(n: int, share: float, around: float) -> tuple[int, int]:
    """Places, among ``n`` sorted values, between which a gap may end."""
    low = min(max(1, int(share * (1 - around) * n)), n - 1)
    return low, min(max(low, int(round(share * (1 + around / 5) * n))), n - 1)


def quantile_gap(worth: np.ndarray, share: float, around: float = 0.05) -> float:
    """The ``share`` quantile of sorted values, put into the widest gap close to it.

    Close means within ``around`` of the share: a few wrong labels move the share
    of poor rows a little, and the threshold should not cut through good ones.
    """
    low, high = _close(len(worth), share, around)
    gaps = worth[low:high + 1] - worth[low - 1:high]
    at = low + int(np.argmax(gaps))
    return float(worth[at - 1:at + 1].mean())


def quantile_gap_of(rows: DataFrame, n: int, share: float, around: float = 0.05) -> float:
    """``quantile_gap`` of the ``n`` values of a column ``worth``.

    Values are dealt out by ranges; the driver gets the count and ends of each range.
    """
    low, high = _close(n, share, around)
    dealt = staged(rows.repartitionByRange("worth").withColumn("part", F.spark_partition_id()), "worth")
    ends = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min("worth").alias("least"),
                                     F.max("worth").alias("most")).collect()
    before, last, ranges = 0, None, []
    for part in sorted(ends, key=lambda r: r["least"]):
        ranges.append((part["part"], before, last))
        before, last = before + part["n"], part["most"]
    ranges = rows.sparkSession.createDataFrame(ranges, "part int, before long, last double")
    own = Window.partitionBy("part").orderBy("worth")
    placed = dealt.withColumn("own", F.row_number().over(own)) \
        .withColumn("previous", F.lag("worth").over(own)).join(F.broadcast(ranges), "part") \
        .select("worth", (F.col("before") + F.col("own") - 1).alias("at"),
                F.coalesce("previous", "last").alias("previous"))
    widest = placed.where(F.col("at").between(low, high)).agg(F.max(F.struct(
        (F.col("worth") - F.col("previous")).alias("gap"), (-F.col("at")).alias("first"),
        "worth", "previous"))).first()[0]
    return (widest["previous"] + widest["worth"]) / 2


def scores(docs: DataFrame, labels: DataFrame, cut: float = 0.7, sample: int = SAMPLE,
           doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, score): one row for each row of ``docs``, fitted on ``labels``."""
    table = staged(feature_table(docs, [doc_id, *keep], text), "features")
    ranking = fit(table, labels, cut, sample, doc_id)
    return table.select(doc_id, *keep, ranking.score().alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.7, doc_id: str = "doc_id",
              text: str = "text") -> DataFrame:
    """Rows of ``docs`` of score ``cut`` or more; rows with one id have the best of their scores."""
    own = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    rejected = staged(scores(docs, labels, cut, doc_id=doc_id, text=text)
                      .groupBy(own.alias("_rejected")).agg(F.max("score").alias("best"))
                      .where(F.col("best") < cut).select("_rejected"), "rejected")
    return docs.join(rejected, F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID))
                     == rejected["_rejected"], "left_anti")


def held_out(doc_id: Column) -> Column:
    """Whether labels of the document are kept for testing: a quarter, by checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of ``labels.quality`` outside the held-out quarter."""
    return labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
