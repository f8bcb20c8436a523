import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.llm import pii, secrets, urls
from spanloom.llm.spans import matches, written
from spanloom.llm.urls import Rule

RULES = [Rule.of("allow", "com/"), Rule.of("block", "example.com/en/"),
         Rule.of("allow", "www.example.com/en/"), Rule.of("block", "net/es/"), Rule.of("block", "net/fr"),
         Rule.of("block", "x.org/a"), Rule.of("allow", "org/abcdef")]


# ---- URLs ------------------------------------------------------------------

def slow_url(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.host + r.path), default=None)
    name = re.sub(r"^(www|m)\.", "", host) + re.sub("/+$", "", re.sub(r"\.html$", "", path))
    here = bool(host) and name in listed
    verdict = best.verdict if best else "block" if here else "allow"
    return host, path, here, best and best.host + best.path, verdict


def test_url_filter(spark):
    rnd = random.Random(4)
    made = [None, "", "no scheme", "://", "http://", "http://EXAMPLE.com/en/1", "a://b://c.com/x",
            "http://com/", "http://xcom/", "http://a.com", "http://a.net/fr2", "http://net/es/?q#f",
            "http://x.org/abcdefg", "http://.net/es/", "http://a..com/", "http://é.com/\n/x"]
    made += [rnd.choice(["http", "https"]) + "://" + rnd.choice(["www.", "m.", "", "b."])
             + rnd.choice(["example.com", "q.net", "x.org", "Site.io"])
             + rnd.choice(["", "/", "/en/", "/es/", "/fr/", "/a", "/abcdef"]) + str(rnd.randrange(9))
             + rnd.choice(["", ".html", "/", "?a=1", "#t"]) for _ in range(300)]
    listed = {"site.io/3", "site.io/en/4", "q.net/5", "x.org7", "nowhere/1"}
    pages = spark.createDataFrame([(i, u, "h", "k", "b") for i, u in enumerate(made)],
                                  "page_id long, url string, host string, key string, _listed string")
    names = spark.createDataFrame([(x,) for x in [*listed, *listed, None]], "canonical string")
    found = urls.judge(pages, RULES, names)
    assert found.columns == ["page_id", "url", "key", "_listed", "host", "path", "listed", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.listed, r.rule, r.verdict) for r in found.collect()}
    assert got == {i: slow_url(u, listed) for i, u in enumerate(made)}
    assert urls.judge(pages.limit(0), RULES, names).count() == 0
    assert {r.verdict for r in urls.judge(pages, [], names.limit(0)).collect()} == {"allow"}


def test_filter_has_no_false_negatives_and_few_false_hits(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(4000, 24000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = urls.blocked_filter(keys, 256)                   # 16 bits a key
    assert urls.possible_hits(keys, bloom, 256).count() == 4000
    assert urls.possible_hits(others, bloom, 256).count() < 400


# ---- secrets ---------------------------------------------------------------

SECRETS = [("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                      r"([A-Za-z0-9+/_.=-]+)", 12), ("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16)]


def slow_secrets(text):
    out = []
    for k, (kind, regex, least) in enumerate(SECRETS):
        for m in re.finditer(regex, text or ""):
            if len(m.group(2) if k == 0 else m.group()) >= least:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(6)
    bits = ["token", "Secret", "PASSWORD", "passwd", "api_key", "apikey", "=", ": ", '"', "'", " ", "AKIA",
            "ABCDEFGH12", "0123456789abcdef", "deadbeef", "é", "😀", "tok", "en", "abcdefghijkl", "\n", "AKI",
            "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "a1B2c3D4e5F6" * 3]
    return [None, "", " "] + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 14))) for _ in range(600)]


def test_secrets(spark, odd_texts):
    docs = spark.createDataFrame([(i if i % 50 else None, i, t, "r") for i, t in enumerate(odd_texts)],
                                 "doc_id long, n long, text string, rules string")
    docs = docs.withColumn("doc", F.lit(1))
    found = secrets.find(docs.select("doc_id", "rules", "doc", F.concat_ws("|", "n", F.lit("")).alias("x"), "text"))
    got = sorted([sorted((s.start, s.rank, s.stop, s.kind) for s in r.spans if s.rank < 3)
                  for r in found.collect()])
    assert got == sorted(slow_secrets(t) for t in odd_texts)
    assert secrets.find(docs.limit(0)).count() == 0


def test_trigram_queries():
    ask = secrets.trigram_query
    assert ask("AKIA[A-Z0-9]{14,}+") == {frozenset({"aki", "kia"})}
    assert ask("[0-9a-f]{16,}") is None and ask("ab") is None and ask("(abc)?") is None
    assert ask("x[yz]w|longer") == {frozenset({"xyw"}), frozenset({"xzw"}),
                                    frozenset({"lon", "ong", "nge", "ger"})}
    assert ask("(?:abc)+.def") == {frozenset({"abc", "def"})}
    assert ask("abc|d") is None
    rnd = random.Random(7)                     # no match without one of the alternatives
    for rule in secrets.RULES:
        query = ask(rule.regex)
        for _ in range(200):
            text = "".join(rnd.choice(["token", "Secret", "api_key", "passwd", "=", '"', " ", "AKIA", "Z9" * 9,
                                       "abc" * 5, "xoxb-", "gho_", "-----BEGIN PRIVATE KEY-----"]) for _ in range(6))
            if re.search(rule.regex, text) and query:
                assert any(all(t in text.lower() for t in x) for x in query)


# ---- personal data ---------------------------------------------------------

def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(p) < 256 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 13 <= len(d) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15)]


def slow_personal(text):
    return [(k, m.start(), m.end(), kind) for k, (kind, regex, good) in enumerate(PERSONAL)
            for m in re.finditer(regex, text or "") if good(m.group(), re.sub("[^0-9]", "", m.group()))]


def test_personal_data(spark):
    rnd = random.Random(8)
    bits = ["a", "b@", "@", "x.com", ".", "1", "23", "255", "256", "4111 1111 1111 1111", "4111-1111", " ",
            "-", "+", "+49", " (0", "12", "é", "😀", "_", "0001"]
    made = [None, "", "mail joe (at) mail.com now"] + [
        "".join(rnd.choice(bits) for _ in range(rnd.choice([3, 12, 40]))) for _ in range(500)]
    made.append("1" * 20000 + " " + "a.b" * 9000 + "@" + "x.y" * 3000 + " " + "1 " * 9000 + "+1" + " 2" * 9000)
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(made)], "doc_id long, text string, found string")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(rows) == len(made)
    for i, t in enumerate(made):
        base = [(s.rank, s.start, s.stop, s.kind) for s in rows[i].base]
        assert base == slow_personal(t)
        every = [(s.rank, s.start, s.stop, s.kind) for s in rows[i].spans]
        assert set(base) <= set(every) and every == sorted(every)
    assert pii.find(docs.limit(0)).count() == 0
    plain = spark.createDataFrame([(1, "no data here")], "doc_id long, text string")
    assert [len(r.spans) for r in pii.find(plain).collect()] == [0]


def test_label_model_trusts_the_checks():
    patterns = [("card", (1, 1, 1, 0, 1), 300), ("card", (1, -1, 0, 0, 1), 900), ("card", (1, -1, -1, -1, -1), 50)]
    truth, reliability = pii.expectation_maximisation(patterns)
    assert truth["card", (1, 1, 1, 0, 1)] > 0.9 > 0.5 > truth["card", (1, -1, -1, -1, -1)]
    assert reliability["card"]["check"] > reliability["card"]["form"]
    weights = pii.logistic([(["a", "x"], 0.95, 30.0), (["a", "y"], 0.05, 30.0)])
    assert weights["x"] > 0 > weights["y"]


def test_places_of_matches(spark):
    rows = spark.createDataFrame([("😀ab ab", ), ("abab",), ("", ), ("none",)], "t string")
    got = rows.select(matches(F.col("t"), "ab", F.lit(True)).alias("m")).collect()
    assert [[x.start for x in r.m] for r in got] == [[1, 4], [0, 2], [], []]
    assert rows.select(written(F.array().cast("array<struct<kind:string,start:int,stop:int>>")).alias("w")).first().w == ""


def test_secrets_of_many_rules_and_long_literals(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(90))
    rules = [secrets.Rule(f"r{i}", f"key{i:03d}[0-9]+") for i in range(70)] + [
        secrets.Rule("long", long), secrets.Rule("accent", "Éabcd"), secrets.Rule("sign", "\u212aelvin"),
        secrets.Rule("either", "(?:ÀÉx|ÈÊy)z+")]
    texts = ["key0691 key0022 KEY0033", f"x{long}y {long[:80]}", "Éabcd éabcd ÉABCD", "\u212aelvin kelvin", "ÀÉxzz ÈÊyz", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(x["kind"], x["start"]) for x in r.spans] for r in secrets.find(docs, rules).collect()}
    assert found == {0: [("r69", 0), ("r2", 8)], 1: [("long", 1)], 2: [("accent", 0)], 3: [("sign", 0)],
                     4: [("either", 0), ("either", 6)], 5: [], 6: []}
