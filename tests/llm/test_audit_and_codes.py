import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import audit, countfilter, vectorcodes

# ---- filter interaction ----------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_audit(rows, labels):
    """rows (id, text, part), labels (id, quality, toxic): one order after the other."""
    big = float("inf")
    key = [big if i is None else i for i, _, _ in rows]
    fails = []
    for n, (i, t, _) in enumerate(rows):
        t = t or ""
        w = WORD.findall(t)
        fails.append({
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": any((u or "") == t and key[m] < key[n] for m, (_, u, _) in enumerate(rows))})
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, shapley = {}, {}
    for part in {p or "" for _, _, p in rows}:
        own = [n for n, r in enumerate(rows) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = set(own)
            for step, f in enumerate(order, 1):
                lost = {n for n in left if fails[n][f]}
                hit = {n for n in own if fails[n][f]}
                only = {n for n in hit if sum(fails[n].values()) == 1}
                shapley[part, f] = shapley.get((part, f), 0) + len(lost)
                redundant = len(hit - left)
                left -= lost
                out[part, "".join(order), step] = [
                    len(left), len(lost), redundant, len(only),
                    len([n for n in lost if rows[n][0] in good]),
                    len([n for n in lost if rows[n][0] in toxic])]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def sample_documents(rnd, n=300):
    made = ["", None, " \t\n", "a" * 50, " ".join(f"w{i}" for i in range(250)), "Y" * 30 + " $"]
    for _ in range(n):
        k = rnd.choice([3, 199, 200, 201, 260])
        t = " ".join(rnd.choice(["x", "y", f"w{rnd.randrange(400)}", f"W{rnd.randrange(400)}"])
                     for _ in range(k)) + rnd.choice(["", " 5%", "|", "\x0b\x1f Éa"])
        made.append(rnd.choice(made) if rnd.random() < 0.4 else t)
    return [(None if rnd.random() < 0.05 else rnd.randrange(n), t, rnd.choice(["hot", "hot", "b", None]))
            for t in made]


@pytest.mark.parametrize("options", [
    {}, {"max_bytes": 1}, {"text_hash": lambda t: F.length(t).cast("long")}])
def test_interaction_of_filters(spark, options):
    rnd = random.Random(3)
    rows = sample_documents(rnd)
    labels = [(rnd.choice([None, rnd.randrange(300)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None]))
              for _ in range(250)]
    docs = spark.createDataFrame([(i, t, p, 7, "m", 1) for i, t, p in rows],
                                 "doc_id long, text string, source string, n long, mask string, h int").repartition(5)
    found = audit.interaction(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **options)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                             "good_lost", "toxic_lost", "shapley"]
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in found.collect()}
    assert len(got) == 3 * 600 and got == slow_audit(rows, labels)


def test_interaction_of_no_rows_and_of_one_long_text(spark):
    docs = spark.createDataFrame([(1, "Éa b " * 300000, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interaction(docs.limit(0), labels).count() == 0
    assert [r.mask for r in audit.masks(docs).collect()] == [2]


def test_only_possible_repeats_keep_their_text(spark):
    rows = [(i, f"text {i if i < 4000 else i % 40}") for i in range(5000)]
    hashes = spark.createDataFrame(rows, "id long, text string").repartition(7).select(
        F.xxhash64("text").alias("h"))
    bits = countfilter.filter_bits(hashes, 2)
    values = np.array([r.h for r in hashes.distinct().collect()], np.int64)
    several = countfilter.hits(bits, values)
    often = {r.h for r in hashes.groupBy("h").count().where("count > 1").collect()}
    flagged = set(values[several].tolist())
    assert often <= flagged and len(flagged) <= 40 + 0.02 * len(values)
    assert countfilter.hits(countfilter.filter_bits(hashes, 1), values).all()


# ---- vector codes ---------------------------------------------------------------------

def slow_codes(rows, parts, entries, rounds):
    """rows (id, label, vector): plain Lloyd rounds over lists."""
    big = float("inf")
    kept = [(i, lab, [int(np.floor(float(np.float32(x)) * 256)) for x in v]) for i, lab, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (big if r[0] is None else r[0], r[2]))[:entries]
    wide = len(kept[0][2]) // parts

    def cut(q, p):
        return q[p * wide:(p + 1) * wide]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)
    books = [[cut(q, p) for _, _, q in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, _, q in kept:
                own.setdefault(nearest(cut(q, p), books[p])[0], []).append(cut(q, p))
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out, errors = [], {}
    for i, lab, q in kept:
        found = [nearest(cut(q, p), books[p]) for p in range(parts)]
        error = sum(d for _, d in found)
        errors[lab] = errors.get(lab, 0) + error
        out.append((i, "".join(f"{e:02x}" for e, _ in found), error, lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, errors[lab], sha) for i, c, e, lab in out), key=str)


@pytest.mark.parametrize("n, parts, wide, entries, spread", [
    (400, 4, 3, 16, 1.0), (700, 16, 4, 64, 0.02), (20, 2, 2, 64, 1.0), (300, 2, 1, 5, 0.005), (1, 16, 1, 64, 1.0)])
def test_codes_equal_plain_rounds(spark, n, parts, wide, entries, spread):
    rnd = random.Random(n)
    rows = []
    for i in range(n):
        v = [rnd.gauss(rnd.choice([-1, 0, 1]), spread) for _ in range(parts * wide)]
        rows.append((i if rnd.random() < 0.9 else rnd.choice([None, 3]), rnd.choice([None, 1, 1, 1, 2]), v))
    rows += [rows[0], rows[-1], (5000, 1, None), (5001, None, [None] * parts * wide),
             (5002, 1, [float("nan")] * parts * wide), (5003, 1, [float("-inf")] * parts * wide)]
    frame = spark.createDataFrame([(*r, "x") for r in rows],
                                  "vec_id long, label int, embedding array<float>, code string").repartition(3)
    found = vectorcodes.compress(frame, parts, entries)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found.collect()), key=str)
    assert got == slow_codes(rows, parts, entries, 2)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, label string, embedding array<float>"
    assert vectorcodes.compress(spark.createDataFrame([], schema)).count() == 0
    assert vectorcodes.compress(spark.createDataFrame([(1, "a", None)], schema)).count() == 0
    with pytest.raises(ValueError):
        vectorcodes.compress(spark.createDataFrame([(1, "a", [1.0] * 17)], schema))
    empty = vectorcodes.compress(spark.createDataFrame([(1, "a", [])], schema)).first()
    assert (empty.code, empty.error) == ("00" * 16, 0)


def test_trees_assign_whole_nodes():
    rnd = np.random.default_rng(1)
    centres = rnd.integers(-4000, 4000, (64, 4))
    points = centres[rnd.integers(0, 64, 20000)] + rnd.integers(-30, 30, (20000, 4))
    got = vectorcodes.Assigned(vectorcodes.Tree(points, 32), points, centres)
    d = ((points[:, None] - centres) ** 2).sum(axis=2)
    assert (got.code == d.argmin(axis=1)).all() and got.count.sum() == 20000
    assert (got.total == np.stack([points[got.code == e].sum(axis=0) for e in range(64)])).all()
    assert got.taken < 0.1 * d.size             # of all distances
