"""Golden cases of splitting, classification and page blocks."""

from pyspark.sql import functions as F

from spanloom.functions.rules import VERBS
from spanloom.operators import units as U
from spanloom.operators.html_blocks import is_chrome, page_blocks, parse_pages

PROSE = [
    ("We use cookies, e.g. for analytics. The rate is 3.5 percent. You can reach us at "
     "privacy@example.com. We may update this policy.",
     [("We use cookies, e.g. for analytics.", None), ("The rate is 3.5 percent.", None),
      ("You can reach us at  privacy@example.com .", None), ("We may update this policy.", None)]),
    ("Learn more about our privacy practices at example.com/privacy .",
     [("Learn more about our privacy practices at example.com/privacy .", None)]),
    ("Learn more about our privacy practices at example.com/privacy",
     [("Learn more about our privacy practices at example.com/privacy", None)]),
    ("Learn more about our privacy practices at https://example.com/privacy .",
     [("Learn more about our privacy practices at  https://example.com/privacy  .", "other")]),
    ("How We Collect and Use Information", [("How We Collect and Use Information", None)]),
    ("SHARING OF PERSONAL DATA", [("SHARING OF PERSONAL DATA", "heading")]),
    ("Our partners perform audits.", [("Our partners perform audits.", "heading")]),
    ("Personal Data.", [("Personal Data.", "heading")]),
    ("Effective Date", [("Effective Date", "short")]),
    ("We share data with vendors, etc. You can opt out.",
     [("We share data with vendors, etc. You can opt out.", None)]),
    ("Wait... Then continue.", [("Wait... Then continue.", "heading")]),
    ("and/or. Next sentence.", [("and/or.", "other"), ("Next sentence.", "heading")]),
    ("We collect data.", [("We collect data.", "other")]),
    ("I share your data with partners.", [("I share your data with partners.", "heading")]),
    ('He said "stop." and left?! Yes', [('He said "stop."', "heading"), ("and left?!", "other"),
                                       ("Yes", "short")]),
    ("the right to access; and", [("the right to access; and", "list_item")]),
    ("You may have these rights:", [("You may have these rights:", "lead_in")]),
    ("+1 (800) 555-1234", [("+1 (800) 555-1234", "phone")]),
    ("© 2020 Example Inc", [("© 2020 Example Inc", "copyright")]),
    ("Privacy Policy", [("Privacy Policy", "nav")]),
    ("When you visit the site", [("When you visit the site", "other")]),
]


def test_prose_goldens(spark):
    docs = spark.createDataFrame([(str(i), "x", [("prose", t)]) for i, (t, _) in enumerate(PROSE)],
                                 "doc_id string, subset string, blocks array<struct<kind:string,text:string>>")
    got = {}
    for r in U.units_from_blocks(docs).orderBy("doc_id", "position").collect():
        assert (r.unit_kind == "sentence") == (r.fragment_type is None)
        got.setdefault(int(r.doc_id), []).append((r.unit_text, r.fragment_type))
    for i, (_, want) in enumerate(PROSE):
        assert got[i] == want


def test_full_url_switch(spark):
    docs = spark.createDataFrame(
        [("d", "x", [("prose", "Learn more about our practices at https://example.com/privacy .")])],
        "doc_id string, subset string, blocks array<struct<kind:string,text:string>>")
    assert U.units_from_blocks(docs).first().unit_kind == "fragment"
    assert U.units_from_blocks(docs, full_urls=True).first().unit_kind == "sentence"


def test_verb_forms(spark):
    import oracle
    assert len(set(VERBS)) == 297 and set(VERBS) == set(oracle.VERBS)
    assert {"corrects", "represented", "reserved", "applies", "means"} <= set(VERBS)
    assert not {"permitting", "perform", "took"} & set(VERBS)
    texts = ["Legal counsel represented several other parties there yesterday afternoon",
             "This corrects several other errors there yesterday afternoon",
             "Seats reserved several other parties there yesterday afternoon",
             "Legal counsel for several other parties there yesterday afternoon"]
    docs = spark.createDataFrame([(f"d{i}", "x", [("prose", t)]) for i, t in enumerate(texts)],
                                 "doc_id string, subset string, blocks array<struct<kind:string,text:string>>")
    kinds = {r.doc_id: r.unit_kind for r in U.units_from_blocks(docs).collect()}
    assert kinds == {"d0": "sentence", "d1": "sentence", "d2": "sentence", "d3": "fragment"}


def body(inner):
    return f"<html><body>{inner}</body></html>"


def test_page_structure():
    def blocks(inner):
        return page_blocks(body(inner))[1]
    assert page_blocks("<p>x</p>")[1] == []
    assert blocks("<ul><li>a<ul><li>b</li></ul></li></ul>") == [("list", "a b b")]
    assert blocks("<div>one <b>two</b><p>three</p>four</div>") == [("prose", "one two four"), ("prose", "three")]
    assert blocks("<p>a<b>b</b>.</p>") == [("prose", "a b .")]
    assert blocks("<table><tr><td>c1</td><th>c2</th></tr></table>") == [("prose", "c1"), ("prose", "c2")]
    assert blocks("<p>a &amp; b &nbsp; c&eacute;</p><!-- no --><span>skip</span>") == [("prose", "a & b cé")]
    assert blocks("<p><b>t<br><p>u</p><p>v</p>") == [("prose", "t u v")]
    assert blocks("<h2>H</h2><nav>n</nav><li>x</li><p>***</p>") == [("heading", "H"), ("list", "x")]
    assert blocks("<p>a<script>var t='</p>';</script>b</p>") == [("prose", "a b")]
    assert page_blocks("<head><title> A \n b</title></head><body></body>")[0] == "A b"
    deep = page_blocks(body("<p>" * 3000 + "x"))
    assert deep[1] == [("prose", "x")]


def test_chrome():
    assert is_chrome("div", "site footer")
    assert not is_chrome("div", "no-header-paragraph")
    assert not is_chrome("div", "header-wrapper")
    assert not is_chrome("div", "body_wrapper header_topbar")
    assert is_chrome("div", "", "cookie-bar") and is_chrome("nav")
    assert not is_chrome("div", "article header__small")


def test_lead_in_joins_its_list(spark):
    page = body("<p>You may have the following additional rights:</p><ul><li>the right to access;</li>"
                "<li>the right to rectification; and</li><li>the right to complain.</li></ul><ul><li>z</li></ul>")
    pages = spark.createDataFrame([("d", "x", page)], "doc_id string, subset string, html string")
    units = U.units_from_blocks(parse_pages(pages)).orderBy("position").collect()
    assert [(u.block_seq, u.block_kind, u.unit_kind) for u in units] == [
        (0, "prose", "sentence"), (1, "list", "fragment")]
    assert units[0].unit_text.endswith("rights: the right to access; the right to rectification; and the right to complain.")


def test_order_of_rows_does_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from spanloom.sources.tables import document_blocks

    def digest(df):
        return U.units_from_blocks(document_blocks(df)).agg(
            F.count("*"), F.expr("bit_xor(xxhash64(unit_id, unit_text, unit_kind))")).first()
    assert digest(docs) == digest(docs.orderBy(F.desc("doc_id")).repartition(3))


def test_only_the_named_references_are_decoded(spark):
    pages = spark.createDataFrame([(1, "<title>a&&amp</title><body><h1>R&amp;D &amp&lt; AT&T &quot;&#33;&#33</h1></body>")],
                                  "page_id int, html string")

    def texts(**options):
        row = parse_pages(pages, **options).first()
        return row.title, [b.text for b in row.blocks]
    assert texts(references=("amp", "lt")) == ("a&&amp", ["R&D &amp< AT&T &quot;&#33;&#33"])
    assert texts()[1] == ['R&D &< AT&T "!!']
