"""Rules fetched by their rarest tokens against all rules tried on all URLs."""

import random
import re

import pytest

from corpuscle.llm import url_filter as uf

URLS = [
    None, "", "no scheme.org/es/", "http://example.org/", "http://example.org", "https://EXAMPLE.org/es/1", "https://a.b.Example.ORG/en/12?x#y", "http://example.org/EN/1", "http://notexample.org/es/",
    "http://x.com/fr/1", "http://com/de/", "http://x.com:80/de/1", "http://x.com/de", "http://x.com?/de/1", "http://x.com#/de/", "http://x.net/a://b.com/de/", "://org/", "http://", "http://u@x.org/p q",
    "http://blog.casino-win.example.net/en/1", "http://casinos.net/", "http://x.net/adult/education/", "http://x.net/Adult", "http://x.net/login", "http://x.net/login/2", "http://x.net/a?sessionid=3", "http://x.net/a.EXE", "http://x.net/a.exe?x",
    "http://x.net/" + "long/" * 50_000 + "casino", "http://x.net/é-casino-é", "http://casino.org/",
]


def expression(pattern, any_case):
    start = r"\A//([^/?#]*\.)?" if pattern.startswith("||") else r"\A" if pattern.startswith("|") else ""
    body = pattern.lstrip("|").removesuffix("|") if pattern.startswith("|") else pattern.removesuffix("|").lstrip("*")
    body = "".join(".*" if c == "*" else r"([^a-zA-Z0-9]|\Z)" if c == "^" else re.escape(c) for c in body)
    return re.compile(start + body + (r"\Z" if pattern.endswith("|") else ""), re.S | (re.I | re.A if any_case else 0))


def plain(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host, after = re.fullmatch(r"([^/?#]*)(.*)", rest, re.S).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(rank, len(rule), verdict, rule) for rule, pattern, verdict, rank, any_case in rules if expression(pattern, any_case).search("//" + host + after)]
    best = max(fits, default=(None, 0, default, None))
    return host, re.match(r"[^?#]*", after)[0], best[3], best[2]


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame([(k % 7 if k % 5 else None, u, "x", "y") for k, u in enumerate(urls)], "page_id int, url string, token string, row string")
    got = uf.judge(pages, rules, **more)
    return sorted(map(repr, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect())))


@pytest.mark.parametrize("more", [{}, {"many": 0}, {"many": 0, "part": 3}])
def test_same_as_all_rules_on_all_urls(spark, more):
    rules = uf.site_rules(spark, uf.SITES).unionByName(uf.pattern_rules(spark, uf.PATTERNS))
    listed = [tuple(r) for r in rules.collect()]
    want = sorted(map(repr, ((k % 7 if k % 5 else None, *plain(u, listed)) for k, u in enumerate(URLS))))
    assert judged(spark, URLS, rules, **more) == want


@pytest.mark.parametrize("more", [{}, {"many": 5, "part": 10}])
def test_random_patterns(spark, more):
    rng = random.Random(4)
    piece = lambda n: "".join(rng.choice(["ab", "c", "9", ".", "/", "-", "B"]) for _ in range(n))
    patterns = {(rng.choice(["block", "allow"]), rng.choice(["", "|//", "||", "*", "|*"]) + piece(rng.randint(1, 3)) + rng.choice(["", "^", "*", "|", "^c", "*/ab"])) for _ in range(150)}
    rules = uf.pattern_rules(spark, tuple(sorted(patterns)))
    listed = [tuple(r) for r in rules.collect()]
    urls = ["http://" + piece(rng.randint(1, 9)) for _ in range(300)] + ["http://ab/c"] * 200
    want = sorted(map(repr, ((k % 7 if k % 5 else None, *plain(u, listed)) for k, u in enumerate(urls))))
    assert judged(spark, urls, rules, **more) == want


def test_index_takes_the_rarest_token(spark):
    counts = spark.createDataFrame([("org", 90), ("example", 80), ("es", 3), ("ads", 3)], "token string, n long")
    rules = uf.site_rules(spark, uf.SITES).unionByName(uf.pattern_rules(spark, (("block", "*part"), ("block", "/ads^es/"), ("block", "^ads"))))
    got = {r.rule: r.token for r in uf.index(rules, counts).collect()}
    # "com/fr/" and "com/de/" have tokens that no URL has; open ends are no tokens
    assert got == {"org/": "org", "example.org/es/": "es", "example.org/en/1": "en", "com/fr/": "com", "com/de/": "com", "*part": "", "/ads^es/": "ads", "^ads": ""}


def test_only_rules_of_shared_tokens_run(spark):
    rules = uf.site_rules(spark, uf.SITES)
    listed = uf.index(rules, spark.createDataFrame([("org", 5), ("example", 5), ("com", 5)], "token string, n long"))
    rows = spark.createDataFrame([(1, "//a.net/es/", ["a", "net", "es"]), (2, "//b.org/x", ["b", "org", "x"])], "row long, target string, tokens array<string>")
    assert sorted((r.row, r.rule) for r in uf.candidates(rows, listed, True).collect()) == [(1, "example.org/es/"), (2, "org/")]


def test_odd_rules_and_tables(spark):
    with pytest.raises(ValueError):
        uf.site_rules(spark, (("allow", "a.org", "x"),))
    with pytest.raises(ValueError):
        judged(spark, URLS, uf.pattern_rules(spark, (("block", "x" * 1001),)))
    none = uf.pattern_rules(spark, (("block", "x"),)).where("false")
    assert judged(spark, ["http://a.org/b", None], none, default="block") == sorted(["(None, 'a.org', '/b', None, 'block')", "(1, '', '', None, 'block')"])
    assert judged(spark, ["http://a/ads", "http://a/b"], uf.pattern_rules(spark, (("block", "^ads^"),) * 2)) == sorted(["(None, 'a', '/ads', '^ads^', 'block')", "(1, 'a', '/b', None, 'allow')"])
    pages = spark.createDataFrame([], "page_id string, url string")
    assert uf.verdicts(pages).count() == 0


def test_native(spark, sf):
    plan = uf.verdicts(spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan)
