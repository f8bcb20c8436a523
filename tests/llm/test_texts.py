import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer as Library

from spanloom.llm import bpe, lines, posindex
from spanloom.session import configure

LIBRARY = Library.from_file(bpe.DEFAULT_VOCABULARY)
OWN = bpe.Tokenizer(bpe.DEFAULT_VOCABULARY)
SPACES = " \t\n\r\x0b\x0c"


def low(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


# ---- tokens ----------------------------------------------------------------

@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(
    st.characters(max_codepoint=0x24F), st.sampled_from("thanestio'sΣσİ日本ñé́  \n<|>"))))
def test_encodes_as_the_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_long_words_and_special_tokens():
    for text in ["a" * 3000, "thinking" * 200, "é" * 700, "x" * 127, "x" * 128, "!" * 900,
                 "a<|endoftext|>B <|startoftext|><|EndOfText|>"]:
        assert OWN.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    word = "internationalisation" * 5
    parts = [OWN.inner[b] for b in word.encode()]
    assert OWN._scan(list(parts)) == OWN._heap(list(parts))


def test_token_frames(spark):
    rows = [(1, None), (2, ""), (3, "Hello  wörld"), (3, "Hello  wörld"), (None, "x")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, ids string")
    found = bpe.round_trip(docs, ["doc_id", "ids"]).collect()
    for (i, t), r in zip(rows, found):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
            " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False))]
        assert (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) == (i, len(ids), *sha)
    back = bpe.decode(bpe.encode(docs, ["doc_id"]), ["doc_id"]).collect()
    assert back[2].text == "hello</w> w Ã¶ r ld</w>" or back[2].text == OWN.decode(OWN.encode("Hello wörld"))
    assert bpe.encode(docs.limit(0), ["doc_id"]).count() == 0


# ---- lines -----------------------------------------------------------------

def slow_lines(docs, least=10, min_docs=2):
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            held[low(x.strip(SPACES))].add(i)
    out = []
    for i, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(k := low(x.strip(SPACES))) >= least
                                       and len(held[k]) >= min_docs and i != min(held[k]))]
        out.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out)


def test_line_dedup(spark):
    rnd = random.Random(2)
    pool = ["Same line here", " same LINE here\t", "short", "ééééééééé", "éééééééééé", "", "  ",
            "unique {}", "another shared line", "x" * 10]
    docs = [(i, "\n".join(rnd.choice(pool).format(i) for _ in range(rnd.randrange(1, 9))))
            for i in range(120)] + [(200, None), (201, ""), (202, "\n\n"), (5, "Same line here")]
    frame = spark.createDataFrame([(i, t, i, "g", 1) for i, t in docs],
                                  "doc_id long, text string, d long, gone string, n_lines int")
    found = lines.dedup_lines(frame)
    assert found.columns == ["doc_id", "text", "d", "gone", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()) == slow_lines(docs)
    assert lines.dedup_lines(frame.limit(0)).count() == 0
    for least in (3, 40):
        found = lines.dedup_lines(frame, min_docs=least)
        assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()) == slow_lines(
            docs, min_docs=least)


def test_lines_of_a_very_long_text(spark):
    docs = [(2, "\n".join(f"line number {i}" for i in range(60_000))), (1, "line number 7\nline number 59999"),
            (3, "x" * 2_000_000), (4, "x" * 2_000_000)]
    found = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()) == slow_lines(docs)


def test_lines_without_id(spark):
    frame = spark.createDataFrame([(None, "a line of text"), (None, "a line of text"), (1, "a line of text")],
                                  "doc_id long, text string")
    found = lines.dedup_lines(frame).collect()
    assert sorted((r.doc_id or 0, r.text) for r in found) == [(0, ""), (0, ""), (1, "a line of text")]


# ---- phrases ---------------------------------------------------------------

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_hits(docs, items, size):
    out = []
    for i, t in docs:
        words, hit, found = WORD.findall(low(t or "")), set(), set()
        for item, x in items:
            own = WORD.findall(low(x or ""))
            for w in [own[k:k + size] for k in range(max(1, len(own) - size + 1))] if own else []:
                for p in range(len(words) - len(w) + 1):
                    if words[p:p + len(w)] == w:
                        hit.update(range(p, p + len(w)))
                        found.add(str(item))
        out.append((i, len(words), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_contamination(spark):
    rnd = random.Random(3)
    words = ["a", "b", "c", "d", "É", "x9"]

    def some(n):
        return rnd.choice([" ", ", "]).join(rnd.choice(words) for _ in range(n))
    items = [(10, some(7)), (9, some(5)), (11, "B a"), (12, None), (13, "..."), (9, some(6)), (14, "zz zz")]
    docs = [(i, some(rnd.randrange(0, 60))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (103, "a b " * 3000)]
    d = spark.createDataFrame([(i, t, "s", 1) for i, t in docs],
                              "doc_id long, text string, segment string, n long")
    b = spark.createDataFrame(items, "item_id long, text string")
    wanted = slow_hits(docs, items, 4)

    def rows(found):
        return sorted([(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in found.collect()], key=str)
    assert rows(posindex.contamination(d, b, window=4)) == wanted
    index = posindex.build_index(d, segment_tokens=50)           # many segments, blocks of one window
    small = posindex.search(index, b, window=4, block_bytes=1)
    whole = posindex.search(index, b, window=4)

    def hit_words(spans):
        return {(r.segment, r.place, r.item_id, w) for r in spans.collect() for w in range(r.begin, r.end)}
    assert hit_words(small) == hit_words(whole)
    by_doc = posindex.documents(index).collect()
    assert sum(r.n_words for r in by_doc) == sum(x[1] for x in wanted) and len(by_doc) == len(docs)
    _, phrases, blocks = posindex.phrases(index, b, 4, "item_id", "text", 1 << 23)
    assert blocks == 1 and all(len({t.place for t in r.terms}) == len(r.terms) and r.rarest == r.terms[0].id
                               for r in phrases.collect())
    assert phrases.where("item_id = 14").count() == 0            # terms that no document holds
    kept = posindex.keep_clean(d, b, window=4)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x[0] for x in wanted if not x[2])
    assert posindex.contamination(d.limit(0), b).count() == 0
    assert all(r.n_hit == 0 for r in posindex.contamination(d, b.limit(0)).collect())


def test_proximity(spark):
    d = spark.createDataFrame([(1, "red fox jumps over"), (2, "red big fox jumps over"),
                               (3, "red big bad old fox jumps"), (4, "jumps fox red"),
                               (5, "the red fox"), (6, "jumps")],
                              "doc_id long, text string")
    b = spark.createDataFrame([(7, "red fox jumps")], "item_id long, text string")
    index = posindex.build_index(d)

    def docs(slop):
        spans = posindex.search(index, b, 10, slop)
        return {r.doc_id for r in posindex.documents(index).join(spans, ["segment", "place"]).collect()}
    assert docs(0) == {1} and docs(1) == {1, 2} and docs(3) == {1, 2, 3} and docs(4) == {1, 2, 3, 4}


def test_whole_texts_go_to_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])
    configure(spark)
    texts = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('some text ', 1000) AS text")
    found = texts.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 3000 and max(r.size for r in found) < 5 << 20
