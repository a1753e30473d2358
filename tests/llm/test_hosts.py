"""URL parts, rules and host reputations."""

import re
from collections import defaultdict

import pytest

from pulsegrid.llm import hosts, queries

PAGES = "page_id long, url string"
LABELS = "doc_id long, quality int, toxic int"


def cut(url):
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [
        (len(r), r, v) for r, v in queries.URL_RULES
        if ("." + host).endswith("." + r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])
    ]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "example.com/en/", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://example.com/en",
    "http://example.com", "http://example.com?x=/en/", "http://example.com#/en/", "http://badexample.com/en/", "http://a.b.example.com/en//",
    "http://x.www.example.com/en/q", "http://a.net/es/1", "http://net/fr/", "http://a.net/ES/", "http://a.net/es", "ftp://a.net/fr/://com/",
    "x://com/", "http://user@example.com/en/", "http://example.com:80/en/", "http://a.net\n/es/", "http://ÄB.net/es/", "http://a.de/'\\/",
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(3, "http://again.net/fr/")] * 2 + [(None, "http://n.net/es/")], PAGES)
    got = hosts.judge(pages, spark.createDataFrame([], LABELS), queries.URL_RULES).collect()
    assert len(got) == len(URLS) + 3
    for r in got:
        host, path = cut(r.url)
        assert (r.host, r.path) == (host, path), r.url
        rule, verdict = rule_of(host, path)
        assert (r.rule, r.verdict) == (rule, verdict or "allow"), r.url


@pytest.mark.parametrize(
    "host,domain,suffix",
    [("a.b.example.com", "example.com", "com"), ("example.com", "example.com", "com"), ("com", "com", "com"), ("x.y.co.uk", "y.co.uk", "co.uk"),
     ("co.uk", "co.uk", "co.uk"), ("me@h.org:81", "h.org", "org"), ("a.b.org.", "b.org", "org"), ("10.0.0.7:80", "10.0.0.7", "ip"), ("", "", "")],
)
def test_domains(spark, host, domain, suffix):
    r = hosts.domains(spark.createDataFrame([(host,)], "host string")).first()
    assert (r.domain, r.suffix) == (domain, suffix)


def weight(children):
    """``children``: ``n, k, pn, pk``."""
    use = [c for c in children if c[0] >= 2 and c[2] > c[0]]
    same = sum(int(1e9 * (k * (k - 1) / (n * (n - 1)))) for n, k, _, _ in use)
    apart = sum(int(1e9 * (k / n * ((pk - k) / (pn - n)))) for n, k, pn, pk in use)
    one = sum(int(1e9 * (k / n)) for n, k, _, _ in use)
    if not use or one <= apart:
        return 10.0
    return 1000.0 if same <= apart else min(max(1 / ((same - apart) / (one - apart)) - 1, 1.0), 1000.0)


def bounds(counts):
    """Upper bounds of hosts ``(suffix, domain, host) -> (n, k)``, level by level."""
    levels = []
    for depth in range(4):
        level = defaultdict(lambda: [0, 0])
        for key, (n, k) in counts.items():
            level[key[:depth]][0] += n
            level[key[:depth]][1] += k
        levels.append(level)
    prior, own = {(): 0.5}, {(): 2.0}
    for depth in (1, 2, 3):
        up = levels[depth - 1]
        w = weight([(n, k, *up[key[:-1]]) for key, (n, k) in levels[depth].items()])
        for key, (n, k) in levels[depth].items():
            pn, pk = up[key[:-1]]
            a = own[key[:-1]]
            prior[key], own[key] = (pk - k + a * prior[key[:-1]]) / (pn - n + a), w
    out = {}
    for key, (n, k) in counts.items():
        rate = (own[key] * prior[key] + k) / (own[key] + n)
        out[key[2]] = rate + 1.645 * (rate * (1 - rate) / (own[key] + n + 1)) ** 0.5
    return out


@pytest.mark.parametrize("few", [0, 1000])
def test_reputations(spark, monkeypatch, few):
    monkeypatch.setattr(hosts, "FEW_HOSTS", few)
    good = {"a.fine.org": (40, 38), "b.fine.org": (9, 9), "c.fine.org": (0, 0), "a.bad.org": (60, 1), "b.bad.org": (25, 2), "c.bad.org": (0, 0),
            "x.mixed.net": (30, 1), "y.mixed.net": (30, 29), "z.mixed.net": (2, 0), "one.com": (1, 0), "w.fine.net": (12, 10)}
    pages, labels, counts = [], [], {}
    for host, (n, k) in good.items():
        counts[(host.rpartition(".")[2], ".".join(host.split(".")[-2:]), host)] = (n, k)
        for i in range(n):
            pages.append((len(pages), f"http://{host}/{i}"))
            labels.append((len(pages) - 1, int(i < k), 0))
        pages.append((10_000 + len(pages), f"https://{host}/unlabelled"))
    labels += [(0, 1, 0), (50_000, 0, 1), (None, 0, 1), (10_041, None, None)]
    extra = spark.createDataFrame(pages, PAGES).selectExpr("*", "'x' AS host", "1 AS n", "2 AS bound", "'y' AS quality")
    got = hosts.judge(extra, spark.createDataFrame(labels, LABELS), []).collect()
    assert len(got) == len(pages)
    want = bounds(counts)
    for r in got:
        assert r.bound == pytest.approx(want[r.host], abs=1e-9)
        assert r.verdict == ("block" if want[r.host] < 0.5 else "allow") and r.rule is None
    blocked = {r.host for r in got if r.verdict == "block"}
    assert {"a.bad.org", "b.bad.org", "x.mixed.net"} <= blocked and not blocked & {"a.fine.org", "y.mixed.net", "one.com", "w.fine.net"}


def test_empty(spark):
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert hosts.judge(spark.createDataFrame([], PAGES), labels, queries.URL_RULES).collect() == []
