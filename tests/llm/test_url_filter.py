import re
from itertools import combinations

from pyspark.sql import functions as F

from cardwright.llm.queries import URL_RULES
from cardwright.llm.url_filter import MiningParams, filter_urls, url_parts

LABELS, PAGES = "doc_id long, quality int, toxic int", "page_id long, url string, html string, rule string, token string"


def run(spark, urls, labels, **params):
    pages = spark.createDataFrame([(i, u, None, "x", "y") for i, u in urls], PAGES)
    return filter_urls(pages, spark.createDataFrame(labels, LABELS), URL_RULES, MiningParams(**params)).collect()


def test_listed_rules(spark):
    urls = [
        (1, "http://A.Example.ORG/es/x"), (2, "http://example.org/en/1"), (3, "http://example.org/en/21"), (4, "http://x.com/fr/?q"), (5, "http://x.com/de/1#f"),
        (6, "http://x.com/De/1"), (7, None), (8, "no scheme"), (9, "http://notexample.org"), (10, "http://badexample.org/es/"), (11, "a://b.net?x=/p"), (12, "http://x.org://y/z"),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in run(spark, urls, [])}
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/1", "example.org/en/1", "block"),
        3: ("example.org", "/en/21", "org/", "allow"), 4: ("x.com", "/fr/", "com/fr/", "allow"), 5: ("x.com", "/de/1", "com/de/", "block"),
        6: ("x.com", "/De/1", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("notexample.org", "", None, "allow"),
        10: ("badexample.org", "/es/", "org/", "allow"), 11: ("b.net", "", None, "allow"), 12: ("x.org:", "//y/z", None, "allow"),
    }


def test_mined_rules_equal_brute_force(spark):
    hosts = ["spam.net", "good.net", "mixed.net"]
    urls, labels, items = [], [], {}
    for i in range(120):
        host, word = hosts[i % 3], ["buy", "read"][i // 3 % 2]
        bad = host == "spam.net" or host == "mixed.net" and word == "buy"
        urls.append((i, f"http://{host}/{word}/{i}"))
        labels.append((i, 1, int(bad)))
        items[i] = ({f"h:{host}", f"l:{host[:-4]}", "l:net", f"p:{word}"}, bad)
    labels += [(5000, 0, 1), (None, 0, 1), (1, None, None)]
    urls += [(1000, "http://spam.net/new"), (1001, "http://sub.mixed.net/buy"), (1002, "http://mixed.net/other"), (1003, None), (1000, "http://spam.net/new")]
    got = {r["page_id"]: (r["verdict"], r["mined_rule"]) for r in run(spark, urls, labels, min_count=5)}
    base = sum(b for _, b in items.values()) / len(items)
    rules = {}
    for size in (1, 2, 3):
        for combo in {c for own, _ in items.values() for c in combinations(sorted(own), size)}:
            hits = [b for own, b in items.values() if set(combo) <= own]
            confidence = sum(hits) / len(hits)
            if sum(hits) >= 5 and confidence >= 0.6 and confidence / base >= 1.5:
                rules[combo] = confidence
    rules = {c: f for c, f in rules.items() if not any(set(o) < set(c) and g >= f for o, g in rules.items())}
    def judge(own):
        fits = sorted((-f, " ".join(c)) for c, f in rules.items() if set(c) <= own)
        return ("block", fits[0][1]) if fits else ("allow", None)
    for i, (own, _) in items.items():
        assert got[i] == judge(own)
    assert got[1000][0] == "block" and got[1002][0] == "allow" and got[1003] == ("allow", None)


def test_no_rows(spark):
    assert run(spark, [], []) == []


def test_rules_where_most_pages_are_bad(spark):
    urls = [(i, f"http://{'spam' if i < 60 else 'mixed'}.net/{i}") for i in range(120)]
    labels = [(i, 1, int(i < 60 or i % 5 < 2)) for i in range(120)]
    got = {r["page_id"]: (r["verdict"], r["mined_rule"]) for r in run(spark, urls + [(500, "http://spam.net/new"), (501, "http://else.com/")], labels)}
    assert got[0] == got[500] == ("block", "h:spam.net") and got[119] == got[501] == ("allow", None)


def test_rules_of_four_tokens(spark):
    words = ["red", "big", "new", "hot"]
    urls, labels = [], []
    for i in range(200):
        own = [w for k, w in enumerate(words) if i < 40 or k != i % 4]
        urls.append((i, f"http://h{i}.c{i}/{'/'.join(own)}"))
        labels.append((i, 1, int(i < 40)))
    got = {r["page_id"]: (r["verdict"], r["mined_rule"]) for r in run(spark, urls, labels)}
    assert got[0] == ("block", "p:big p:hot p:new p:red") and got[100] == ("allow", None)


def test_tokens_that_always_meet_do_not_multiply(spark):
    """25 fixed words in a site's paths: without merging, FP-growth would list 2**25 combinations."""
    fixed = "/".join(chr(97 + k // 5) + chr(97 + k % 5) for k in range(25))
    urls = [(i, f"http://spam.net/{fixed}/{i}" if i < 60 else f"http://fine.net/x/{i}") for i in range(200)]
    labels = [(i, 1, int(i < 60)) for i in range(200)]
    got = {r["page_id"]: (r["verdict"], r["mined_rule"]) for r in run(spark, [*urls, (900, "http://other.net/cc"), (901, "http://other.net/zz")], labels)}
    assert got[0] == ("block", "h:spam.net") and got[100] == ("allow", None)
    assert got[900] == ("block", "p:cc") and got[901] == ("allow", None)


def test_parts_of_a_column_of_any_name(spark):
    df = spark.createDataFrame([("https://A.b/C?d",), (None,)], "address string")
    assert [tuple(r) for r in df.select(*url_parts(F.col("address"))).collect()] == [("a.b", "/C"), ("", "")]


def test_planted_labels_on_the_pages_of_the_test_tables(spark):
    """Most pages of one path are called bad: the operator blocks all pages of that path, labelled or not, and no others."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hosts = [r for r in pages.select("page_id", url_parts(F.col("url"))[0].alias("host"), url_parts(F.col("url"))[1].alias("path")).collect()]
    words = {r["page_id"]: set(re.findall("[a-z]+", r["path"].lower())) for r in hosts}
    rows = [(r["page_id"], 1, int("es" in words[r["page_id"]] and r["page_id"] % 20 != 0)) for r in hosts if r["page_id"] % 2 == 0]
    got = filter_urls(pages, spark.createDataFrame(rows, LABELS), [], MiningParams(min_count=5)).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {p for p, own in words.items() if "es" in own}
    assert all("p:es" in r["mined_rule"].split() for r in got if r["mined_rule"])
