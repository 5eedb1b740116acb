"""URL filters: the trie and the join against each other and a plain loop, and odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from docintake.llm import urlrules
from tools.compare import compare, connect

URLS = [
    (1, "http://a.Example.COM/en/1?x=/fr/"),
    (2, "https://www.example.com/en/2#top"),
    (3, "https://x.www.example.com/en/"),
    (4, "http://com/"),
    (5, "http://notexample.com"),
    (6, "http://b.net/es/x"),
    (7, "http://b.net/es"),
    (8, "http://b.net?/es/"),
    (9, "mailto:me@b.net/fr/"),
    (10, None),
    (11, ""),
    (12, "http://b.net:80/fr/1"),
    (13, "a://b://net/fr/"),
    (14, "http://É.net/fr/é"),
    (15, "http://a.net/FR/1"),
    (16, "http://" + "x." * 3000 + "net/fr/" + "y/" * 3000),
    (16, "http://b.net/fr/"),
    (None, "http://b.net/fr/"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, "h", "r", "v") for i, u in URLS], "page_id bigint, url string, host string, rule string, key string")


def plain(url, rules, default="allow"):
    _, mark, rest = (url or "").partition("://")
    rest = rest if mark else ""
    cut = lambda s, marks: min([len(s), *(s.find(m) for m in marks if m in s)])
    n = cut(rest, "/?#")
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
    path = rest[: cut(rest, "?#")]
    fits = [(len(h), len(p), a == "block", h + p) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], ("block" if best[2] else "allow") if best else default


def test_rules_of_the_query(spark, pages):
    rules = spark.createDataFrame(urlrules.RULES, "host string, path string, action string")
    got = sorted(map(repr, (tuple(r) for r in urlrules.judge(pages, rules).collect())))
    assert got == sorted(repr((i, *plain(u, urlrules.RULES))) for i, u in URLS)
    assert sorted(map(repr, (tuple(r) for r in urlrules.judge_by_join(pages, rules).collect()))) == got


def test_trie_join_and_loop_agree_on_random_rules(spark):
    r = random.Random(5)
    label = lambda: r.choice(["a", "b", "ab", "", "c"])
    host = lambda: ".".join(label() for _ in range(r.randint(1, 4)))
    path = lambda: "".join(r.choice(["/", "/a", "/ab", "a", "//"]) for _ in range(r.randint(0, 4)))
    rules = [(h, path(), r.choice(["allow", "block"])) for _ in range(150) if (h := host())]
    urls = [(i, f"http://{host()}{path()}") for i in range(600)]
    df = spark.createDataFrame(urls, "page_id bigint, url string")
    want = sorted(repr((i, *plain(u, rules, "block"))) for i, u in urls)
    assert sorted(repr(tuple(x)) for x in urlrules.judge_by_trie(df, rules, default="block").collect()) == want
    frame = spark.createDataFrame(rules, "host string, path string, action string")
    assert sorted(repr(tuple(x)) for x in urlrules.judge_by_join(df, frame, default="block").collect()) == want


def test_large_rule_sets_are_joined(spark, pages, monkeypatch):
    rules = spark.createDataFrame([*urlrules.RULES, (None, "/", "block"), ("", "/", "block"), ("B.net", None, "block")], "host string, path string, action string")
    small = sorted(repr(tuple(x)) for x in urlrules.judge(pages, rules).collect())
    monkeypatch.setattr(urlrules, "MAX_RULES", 2)
    assert sorted(repr(tuple(x)) for x in urlrules.judge(pages, rules).collect()) == small
    assert any("'b.net'" in x and "'block'" in x for x in small)


def test_empty_tables(spark, pages):
    rules = spark.createDataFrame(urlrules.RULES, "host string, path string, action string")
    assert urlrules.judge(pages.filter(F.lit(False)), rules).count() == 0
    got = urlrules.judge(pages, rules.filter(F.lit(False)), default="block").select("rule", "verdict").distinct().collect()
    assert [tuple(x) for x in got] == [(None, "block")]


def test_query_gives_what_sql_gives(spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, "op13", urlrules.query, urlrules.SQL) == ""
