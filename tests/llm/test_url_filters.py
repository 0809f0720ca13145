from __future__ import annotations

import re
from collections import defaultdict

import pytest

from terrane.llm import url_filters as U

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_of(host, path):
    fit = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


def plain(rows):
    pages, links = [], defaultdict(int)
    for key, url, html in rows:
        host, path = parts(url)
        rule = rule_of(host, path)
        pages.append((key, host, path, rule))
        for target in {m.translate(LOWER) for m in re.findall(r"""(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)""", html or "", re.I)}:
            if host and target != host:
                links[host, target] += 1
    seeds = defaultdict(lambda: [0, 0, 0])
    for _, host, _, rule in pages:
        if host:
            seeds[host][2] += 1
            if rule:
                seeds[host][0 if rule.action == "allow" else 1] += 1
    start = {h: [int(a / n * U.WHOLE), int(b / n * U.WHOLE)] for h, (a, b, n) in seeds.items()}
    out, into = defaultdict(int), defaultdict(int)
    for (a, b), n in links.items():
        out[a] += n
        into[b] += n
    ranks = {h: list(v) for h, v in start.items()}
    for _ in range(U.ROUNDS if links else 0):
        fresh = defaultdict(lambda: [0, 0], {h: list(v) for h, v in start.items()})
        for (a, b), n in links.items():
            fresh[b][0] += int(ranks.get(a, (0, 0))[0] * (n / out[a]) * U.FOLLOW)
            fresh[a][1] += int(ranks.get(b, (0, 0))[1] * (n / into[b]) * U.FOLLOW)
        ranks = fresh
    found = []
    for key, host, path, rule in pages:
        trust, distrust = ranks.get(host, (0, 0))
        verdict = rule.action if rule else "block" if distrust - trust > U.THRESHOLD * U.WHOLE else "allow"
        found.append((key, host, path, rule.text if rule else None, verdict))
    return found


ROWS = [
    (1, "https://Www.Example.COM/en/1?x#y", '<a href="http://bad.net/es/1">x</a>'),
    (2, "https://www.example.com/fr/1", None),
    (3, "https://a.example.com/en/", '<a href="//www.example.com/en/">x</a>'),
    (4, "http://bad.net/es/1", ""),
    (5, "http://bad.net/fr/2", "<a href='http://worse.org/'>"),
    (6, "http://bad.net/de/3", None),
    (7, "http://friend.org/a", '<a href="http://bad.net/es/1"><img src=//bad.net/x.png>'),
    (8, "http://good.org", '<a href="http://a.com/x">'),
    (9, "http://a.com", '<A HREF = "HTTP://Good.ORG/x">'),
    (10, "http://a.com/", '<a href="/local">'),
    (11, None, '<a href="http://bad.net/">'),
    (12, "no scheme", None),
    (13, "x://y://net/es/", None),
    (14, "http://notnet/es/1", None),
    (15, "http://net/es/1", None),
    (15, "http://net/es/1", None),
    (16, "http://x.net?q=/es/", None),
    (17, "http://h.org/a\nb?c", None),
    (18, "\nhttp://h.org/\u00e9", "x" * 100_000),
]


@pytest.mark.parametrize("rows", [ROWS, [], [r for r in ROWS if r[0] in (10, 12)]])
def test_against_plain_propagation(spark, rows):
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, trust int")
    got = [tuple(r)[:5] for r in U.judge_pages(pages, U.RULES).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_distrust_reaches_who_links_there(spark):
    rows = [r for r in ROWS if 4 <= r[0] <= 9]
    got = {r.page_id: r.verdict for r in U.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), U.RULES).collect()}
    assert got[6] == "block" and got[7] == "block" and got[8] == "allow"
