"""Containment join and alignment against plain nested loops."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators.align import align
from spanloom.operators.containment import contained_pairs
from spanloom.operators import evidence

WORDS = "the a an of privacy policy data we collect your information other there then x yz".split()


def sample(n, longest, seed):
    r = random.Random(seed)
    texts = set()
    while len(texts) < n:
        texts.add(" ".join(r.choice(WORDS) for _ in range(r.randint(1, longest))))
    return sorted(texts)


def cut(texts, seed):
    """Needles: pieces of the texts that may start and end inside a word."""
    r = random.Random(seed)
    out = set()
    for t in texts:
        i = r.randrange(len(t))
        piece = " ".join(t[i:i + r.randint(1, 40)].split())
        if piece:
            out.add(piece)
    return sorted(out | {"the", "e", "en", "of t", "zzz"})


@pytest.mark.parametrize("keys,few,fold", [(["g"], 0, "needle"), (["g"], 1000, "needle"),
                                           (["g"], 60, "hay"), ([], 0, "needle")])
def test_contained_pairs(spark, keys, few, fold):
    hay, needles = [], []
    for g, size in (("hot", 120), ("small", 15)):
        texts = sample(size, 12, size)
        hay += [(g, f"{g}{i}", t) for i, t in enumerate(texts)]
        needles += [(g, f"{g}{i}", t) for i, t in enumerate(cut(texts, 7))]
    want = {(n[1], h[1]) for n in needles for h in hay if n[2] in h[2] and (not keys or n[0] == h[0])}
    nd = spark.createDataFrame(needles, "g string, needle_id string, needle_text string")
    hd = spark.createDataFrame(hay, "g string, hay_id string, hay_text string")
    if not keys:
        nd, hd = nd.drop("g"), hd.drop("g")
    rows = contained_pairs(nd, hd, keys, fold=fold, few=few).select("needle_id", "hay_id").collect()
    assert len(rows) == len(set(rows))
    assert {tuple(r) for r in rows} == want


def model(units, spans):
    """units: [(position, text)], spans: {row: text} of one document."""
    out = {}
    for row, s in spans.items():
        a = [p for p, u in units if u and s in u]
        if a:
            out[row] = ("aligned" if len(a) == 1 else "ambiguous", a)
            continue
        b = [p for p, u in units if len(u) > 10 and u in s]
        if b:
            out[row] = ("aligned", b)
            continue
        st = set(s.split())
        best = (0, None)
        for p, u in units:
            n = len(st & set(u.split()))
            if len(st) >= 3 and n / len(st) >= 0.55 and n > best[0]:
                best = (n, p)
        out[row] = ("aligned", [best[1]]) if best[1] else ("unmatched", [])
    return out


def test_align_against_loops(spark):
    r = random.Random(3)
    units, spans, want = [], [], {}
    for d in range(6):
        texts = [r.choice(sample(30, 9, d)) for _ in range(25)]
        own = [(i + 1, t) for i, t in enumerate(texts)]
        cuts = cut(texts, d) + [" ".join(texts[i:i + 2]) for i in range(0, 20, 3)] + sample(20, 7, d + 50)
        mine = {i: t for i, t in enumerate(r.choices(cuts, k=50))}
        units += [(f"d{d}", p, f"d{d}_U{p}", "sentence", t) for p, t in own]
        spans += [(f"d{d}_A{i}", f"d{d}", i, t, "L", "ra1") for i, t in mine.items()]
        want.update({f"d{d}_A{i}": v for i, v in model(own, mine).items()})
    res = align(spark.createDataFrame(units, "doc_id string, position int, unit_id string, unit_kind string, unit_text string"),
                spark.createDataFrame(spans, "annotation_id string, doc_id string, src_row int, text string, label string, ranumb string"))
    status = {r.annotation_id: r.status for r in res.spans.collect()}
    assert status == {k: v[0] for k, v in want.items()}
    got = {}
    for row in res.alignment.collect():
        got.setdefault(row.annotation_id, []).append(int(row.unit_id.split("_U")[1]))
    texts = res.spans.select("doc_id", "span_rep", "annotation_id")      # spans of one text share a row set
    for row in res.ambiguous.join(texts, ["doc_id", "span_rep"]).collect():
        got.setdefault(row.annotation_id, []).append(row.position)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v[1]) for k, v in want.items() if v[1]}


def test_alignment_limits(spark):
    words = [f"w{i:02d}" for i in range(20)]
    units = [("d", 1, "d_U1", "sentence", " ".join(words[:11])), ("e", 1, "e_U1", "sentence", " ".join(words[:10])),
             ("f", 1, "f_U1", "sentence", "abcdefghij"), ("g", 1, "g_U1", "sentence", "one two")]
    rev = " ".join(reversed(words))
    spans = [("a", "d", 0, rev, "L", "r"), ("b", "e", 0, rev, "L", "r"),
             ("c", "f", 0, "x abcdefghij y", "L", "r"), ("d", "g", 0, "two one", "L", "r")]
    res = align(spark.createDataFrame(units, "doc_id string, position int, unit_id string, unit_kind string, unit_text string"),
                spark.createDataFrame(spans, "annotation_id string, doc_id string, src_row int, text string, label string, ranumb string"))
    assert {r.annotation_id: r.status for r in res.spans.collect()} == {
        "a": "aligned", "b": "unmatched", "c": "unmatched", "d": "unmatched"}


def test_support_tiers(spark):
    votes = [("u1", "d", "L", "r1"), ("u2", "e", "L", "r1"), ("u2", "e", "L", "r2"),
             ("u3", "f", "L", "r1"), ("u3", "f", "L", "r2"), ("u3", "f", "L", "r2")]
    v = spark.createDataFrame(votes, "unit_id string, doc_id string, label string, ranumb string")
    pool = spark.createDataFrame([("d", 1), ("e", 6), ("f", 2)], "doc_id string, pool long")
    s = evidence.unit_support(v, pool, 1)
    assert {(r.unit_id, r.k, r.stars) for r in s.collect()} == {("u1", 1, 3), ("u2", 2, 1), ("u3", 2, 3)}
    assert {r.unit_id for r in evidence.unit_support(v, pool, 2).collect()} == {"u3"}

    def ids(tier, mode):
        return {r[0] for r in evidence.support_gate(s, tier, mode).collect()}
    assert ids(1, "at_least") == ids(1, "exact") | ids(2, "exact") | ids(3, "exact")
    assert ids(3, "exact") == {"u1", "u3"} and ids(1, "exact") == {"u2"}
    assert ids(9, "at_least") == {"u1", "u2", "u3"}
    hist = s.groupBy("stars").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in hist.collect()} == {(3, 2), (1, 1)}


def test_groups_of_few_texts_are_not_indexed(spark, monkeypatch):
    from spanloom.operators import containment
    indexed = []

    def counted(needles, hay, keys, *more):
        indexed.append((needles.count(), {r.g for r in hay.select("g").distinct().collect()}))
        return index(needles, hay, keys, *more)
    index = containment._indexed_pairs
    monkeypatch.setattr(containment, "_indexed_pairs", counted)
    texts = ["a b", "b", "a b c d e f g", "the b c d", "xa by"]
    needles = spark.createDataFrame([(g, i, t) for g, n in (("few", 2), ("many", 5)) for i, t in enumerate(texts[:n])],
                                    "g string, needle_id int, needle_text string")
    hay = spark.createDataFrame([(g, i, t) for g in ("few", "many", "none") for i, t in enumerate(texts)],
                                "g string, hay_id int, hay_text string")
    wanted = {(g, a, b) for g, n in (("few", 2), ("many", 5)) for a, x in enumerate(texts[:n])
              for b, y in enumerate(texts) if x in y}

    def found(**options):
        return {(r.g, r.needle_id, r.hay_id) for r in containment.contained_pairs(needles, hay, ["g"], **options).collect()}
    assert found() == wanted and not indexed
    assert found(few=2) == wanted and indexed == [(5, {"many"})]


def test_comparison_form_of_plain_and_other_texts(spark):
    from spanloom.functions.text import normalize
    cases = {"The End": "the end", "": "", None: "", " a": "a", "a ": "a", "a  b": "a b", "a\tb": "a b", "a`b": "a'b",
             "É É": "é é", "ﬁne – “X”": 'fine - "x"', "­½": "­1⁄2", "Ünï çödé": "ünï çödé", "é": "é"}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r.i: r.n for r in rows.select("i", normalize(rows.t).alias("n")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_build_broadcasts_no_table(spark, monkeypatch):
    from spanloom.plans import catalog, corpus
    seen = []

    def watched(*given):
        seen.append(spark.conf.get(corpus.BROADCAST))
        raise InterruptedError
    monkeypatch.setattr(corpus, "align", watched)
    before = spark.conf.get(corpus.BROADCAST)
    blocks = catalog.blocks(spark, "/root/testdata/sf0.001")
    with pytest.raises(InterruptedError):
        corpus.build(catalog.document_rows(blocks), blocks, catalog.derived_spans(blocks))
    assert seen == ["-1"] and spark.conf.get(corpus.BROADCAST) == before


def test_comparison_form_without_python_is_null_where_nfkc_may_change(spark):
    from spanloom.functions.text import normalize, normalize_safe
    texts = ["The End", "", None, " a", "a  b", "a\tb", "a`b", "É É", "– “X”", "ﬁne", "½", "Ünï çödé", "é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    safe = rows.select(normalize_safe(rows.t).alias("safe"))
    plan = safe._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
    found = rows.select("t", normalize_safe(rows.t).alias("safe"), normalize(rows.t).alias("n")).collect()
    assert {r.t for r in found if r.safe is None} == {"ﬁne", "½", "é"}
    assert all(r.safe == r.n for r in found if r.safe is not None)


def test_norms_are_written_again_only_for_texts_that_need_it(spark):
    from spanloom.functions.text import normalize
    from spanloom.operators.align import with_norms
    from spanloom.session import write_and_read

    def norms(*texts):
        names, rows = [], spark.createDataFrame(list(enumerate(texts)), "i int, t string")

        def keep(df, name):
            names.append(name)
            return write_and_read(df, name)
        found = with_norms(rows, "t", keep, "x").orderBy("i").collect()
        assert [r.norm for r in found] == [r.n for r in rows.orderBy("i").select(normalize(rows.t).alias("n")).collect()]
        return names
    assert norms("A b", "c", None) == ["x"]
    assert norms("A b", "ﬁne", "½ É", None) == ["x", "x_nfkc"]


@pytest.mark.parametrize("limit", [-1, 1 << 26])
def test_overlap_by_hashes_and_by_sorts(spark, monkeypatch, limit):
    """Joins hash the texts of a task up to a measured limit; beyond it they sort, with the same result."""
    from spanloom.operators import align as A
    monkeypatch.setattr(A, "HASH_CHARS", limit)
    texts = {f"d{d}": (sample(25, 9, d), sample(25, 7, d + 70)) for d in range(4)}
    units = [(d, i + 1, "sentence", t) for d, (u, _) in texts.items() for i, t in enumerate(u)]
    spans = [(d, i, t) for d, (_, s) in texts.items() for i, t in enumerate(s)]
    want = set()
    for d, (u, s) in texts.items():
        for i, t in enumerate(s):
            st = set(t.split())
            n, p = max((len(st & set(x.split())), -j - 1) for j, x in enumerate(u))
            if len(st) >= 3 and n * 20 >= len(st) * 11:
                want.add((d, i, -p))
    kept = []

    def keep(df, name):
        kept.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return A.write_and_read(df, name)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = A.best_overlap(spark.createDataFrame(spans, "doc_id string, span_rep int, norm string"),
                               spark.createDataFrame(units, "doc_id string, unit_rep int, first_kind string, norm string"), keep)
        assert {(r.doc_id, r.span_rep, r.unit_rep) for r in found.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plans = dict(kept)
    assert ("SortMergeJoin" in plans["unit_tokens"]) == (limit < 0)
    assert plans["unit_tokens"].count("array_distinct") <= 2      # tokens of a unit once, not in filters too


def test_terms_are_matched_without_a_corpus(spark, monkeypatch):
    from spanloom.plans import catalog

    def never(*_):
        raise AssertionError("built")
    monkeypatch.setattr(catalog, "built", never)
    rows = catalog.QUERIES["match_term_table"](spark, "/root/testdata/sf0.001")
    assert rows.columns == ["term_id", "unit_id"]
    rows.count()


def test_corpus_of_documents_moves_them_once(spark, monkeypatch):
    """Blocks are dealt out once; units and spans are made of them without a shuffle, or Python."""
    from spanloom.plans import catalog, corpus
    moved, plans, real, sc = {}, {}, corpus.write_buckets, spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    def written(df, path, *rest):
        name, before = path.rsplit("/", 1)[1], shuffled()
        if name == "unit_texts":
            raise InterruptedError
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        found = real(df, path, *rest)
        moved[name] = shuffled() - before
        return found
    monkeypatch.setattr(corpus, "write_buckets", written)
    monkeypatch.setattr(catalog, "_BUILT", {})
    with pytest.raises(InterruptedError):
        catalog.built(spark, "/root/testdata/sf0.001")
    assert moved == {"units": 0, "span_norms": 0}
    assert not any("ArrowEvalPython" in p for p in plans.values())


def test_unit_texts_are_grouped_by_hashes(spark):
    from spanloom.operators.align import unit_texts
    rows = [("d", 1, "fragment", "a"), ("d", 2, "sentence", "a"), ("d", 3, "sentence", "b"), ("d", 4, "fragment", "b"),
            ("e", 1, "fragment", "b"), ("e", 2, "fragment", ""), ("e", 3, "sentence", "a")]
    found = unit_texts(spark.createDataFrame(rows, "doc_id string, position int, unit_kind string, norm string"))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.norm, r.unit_rep, r.first_kind, r.n_units) for r in found.collect()} == {
        ("d", "a", 1, "fragment", 2), ("d", "b", 3, "sentence", 2), ("e", "b", 1, "fragment", 1), ("e", "a", 3, "sentence", 1)}


def test_build_learns_whether_texts_fit(spark, monkeypatch):
    from spanloom.operators import align as A

    def stop(_):
        raise InterruptedError
    monkeypatch.setattr(A, "unit_texts", stop)
    u = spark.createDataFrame([("d", 1, "d_U1", "sentence", "a text")], "doc_id string, position int, unit_id string, unit_kind string, norm string")
    s = spark.createDataFrame([("a", "d", 0, "text", "Others", "ra1")], "annotation_id string, doc_id string, src_row int, text string, label string, ranumb string")
    found = []
    for fit in (True, False):
        monkeypatch.setattr(A, "hashes", lambda *_, fit=fit, **__: fit)
        with pytest.raises(InterruptedError):
            A.align(u, s, keep=lambda df, _: df, fits=lambda fit=fit: found.append(fit))
    assert found == [True]
