"""The trie against all rules one by one."""

import random

import pytest

from postlab.llm import url_filter as uf
from tests.llm.fixture import CLASHING

RULES = [
    uf.Rule("com", "/", "allow"), uf.Rule("example.com", "/en/", "block"), uf.Rule("www.example.com", "/en/", "allow"),
    uf.Rule("net", "/es/", "block"), uf.Rule("net", "/e", "allow"), uf.Rule("example.com", "/en/a", "allow"),
    uf.Rule("example.com", "", "block"), uf.Rule("org", "/x/", "allow"), uf.Rule("org", "/x/", "block"),
]


def by_rules(host, path):
    def fits(rule):
        return (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)

    return max((r for r in RULES if fits(r)), key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)


def test_split():
    assert uf.split_url("HTTP://WWW.Example.COM/En/a?b#c") == ("www.example.com", "/En/a")
    assert uf.split_url("http://é.DE?x=/y") == ("é.de", "")
    assert uf.split_url("a://b://c/d") == ("b:", "//c/d")
    assert uf.split_url("no scheme") == uf.split_url(None) == uf.split_url("") == ("", "")
    assert uf.split_url("x://host\nname/p\nq#") == ("host\nname", "/p\nq")


def test_every_rule(spark):
    rng = random.Random(3)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "wwwexample.com", "net", "b.net", "org", "", "de", ".com"]
    paths = ["", "/", "/en", "/en/", "/en/a", "/en/ab/c", "/es/", "/est", "/x/y", "/x", "//en/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', '#en/'])}" for _ in range(400)]
    table = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, None, "", "com/en/"])], "page_id long, url string")
    rows = uf.judge_urls(table, RULES, default="neither").collect()
    assert len(rows) == 403
    for r in rows:
        host, path = uf.split_url(r.url)
        rule = by_rules(host, path)
        want = (host, path, rule and rule.host + rule.path, rule.verdict if rule else "neither")
        assert tuple(r.judged) == want, r.url


def test_names_empty_table_and_bound(spark, monkeypatch):
    table = spark.createDataFrame([(1, "http://a.com/")], "judged int, url string").select(
        "*", *[uf.F.lit(1).alias(c) for c in CLASHING])
    assert uf.judge_urls(table, RULES).first().judged.rule == "com/"
    assert uf.judge_urls(table.limit(0), RULES).collect() == []
    monkeypatch.setattr(uf, "MAX_RULES", 2)
    with pytest.raises(ValueError):
        uf.judge_urls(table, RULES)
