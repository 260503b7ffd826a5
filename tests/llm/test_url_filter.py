import random
from collections import Counter

import pytest

from leafweave.llm import queries
from leafweave.llm import url_filter as U

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"), ("block", "net/fr/a"), ("allow", "b.net/fr/ab/")]


def brute(url, rules, default="allow"):
    """(host, path, rule, verdict) by trying every rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        for c in "?#":
            rest = rest.split(c)[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or (len(h), len(p)) > best[0]):
            best = (len(h), len(p)), rule, verdict
    return host, path, best and best[1], best[2] if best else default


AWKWARD = [None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.com/en/x?y#z", "http://example.com", "http://example.com?/en/", "http://example.com#/en/", "x://com/", "x://.com/", "x://a..com/en/", "x://example.com/en", "x://ÄB.net/fr/", "x://net//fr/", "a://b://net/es/", "x://www.example.com/en//", "x://" + "a." * 5000 + "net/es/" + "y/" * 20000]


@pytest.fixture(scope="module")
def pages(spark):
    def make(urls, *extra):
        df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(3)
        for c in extra:
            df = df.selectExpr("*", f"url AS {c}")
        return df

    return make


def test_against_every_rule(pages):
    r = random.Random(1)
    part = lambda of, k: ".".join(r.choice(of) for _ in range(r.randrange(1, k)))
    urls = AWKWARD + [f"{r.choice(['http', 'ftp'])}://{part(['www', 'example', 'b', 'com', 'net', 'Net', ''], 5)}{r.choice(['', '/', '/en/', '/fr/', '/fr/a', '/fr/ab/c', '/es/', '/EN/'])}{r.choice(['', 'x', '?q=/', '#f'])}" for _ in range(3000)]
    got = sorted((x.page_id, x.host, x.path, x.rule, x.verdict) for x in U.filter_urls(pages(urls, "host", "path", "rule", "verdict", "id"), RULES).collect())
    assert got == [(i, *brute(u, RULES)) for i, u in enumerate(urls)]
    assert len({g[3] for g in got}) == len(RULES) + 1


def test_repeats_ties_and_empty_tables(pages, spark):
    same = spark.createDataFrame([(1, "x://a.net/es/")] * 3 + [(None, None)] * 2, "page_id long, url string")
    assert Counter(x.verdict for x in U.filter_urls(same).collect()) == {"block": 3, "allow": 2}
    twice = [("block", "net/"), ("allow", "net/")]  # of a rule given twice the first holds
    assert [x.verdict for x in U.filter_urls(pages(["x://net/"]), twice).collect()] == ["block"]
    assert U.filter_urls(pages(["x://net/"]).where("page_id < 0")).collect() == []
    assert U.filter_urls(pages(["x://net/"]), []).collect()[0].rule is None
    with pytest.raises(ValueError):
        U.filter_urls(pages([None]), [("maybe", "net/")]).collect()


def test_rules_are_refused_past_their_bound(pages, monkeypatch):
    monkeypatch.setattr(U, "MAX_RULE_BYTES", 10)
    with pytest.raises(ValueError):
        U.filter_urls(pages([None]), RULES)


def test_query(pages, tmp_path, spark):
    pages(AWKWARD, "html").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((x.page_id, x.host, x.path, x.rule, x.verdict) for x in queries.op3_url_filter(spark, str(tmp_path)).collect())
    assert got == [(i, *brute(u, U.RULES)) for i, u in enumerate(AWKWARD)]
