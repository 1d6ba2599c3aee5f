from __future__ import annotations

from collections import defaultdict

import pytest

from rookery.llm import url_filter
from rookery.llm.common import read


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path


def rule(host, path):
    best = None
    for r in url_filter.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.pattern) > len(best.pattern)):
            best = r
    return best


def ranks(edges, seeds):
    out = defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    total = sum(seeds.values()) or 1.0
    start = {h: s / total for h, s in seeds.items()}
    now = dict(start)
    for _ in range(url_filter.ROUNDS):
        new = defaultdict(float, {h: 0.15 * r for h, r in start.items()})
        for (a, b), w in edges.items():
            new[b] += 0.85 * now.get(a, 0.0) * w / out[a]
        now = new
    return now


def brute(rows):
    edges, seen = defaultdict(float), defaultdict(lambda: [0, 0, 0])
    for _, url, links in rows:
        host, path = parts(url)
        if host:
            r = rule(host, path)
            seen[host][0] += 1
            seen[host][1] += bool(r and r.verdict == "allow")
            seen[host][2] += bool(r and r.verdict == "block")
        for t in links:
            if host and t and t != host:
                edges[host, t] += 1
    for host in seen:
        p = host.split(".", 1)[-1]
        if "." in host and "." in p:
            edges[host, p] += 1
            edges[p, host] += 1
    trust = ranks(edges, {h: a / n for h, (n, a, _) in seen.items() if a})
    distrust = ranks({(b, a): w for (a, b), w in edges.items()}, {h: b / n for h, (n, _, b) in seen.items() if b})
    found = []
    for page, url, _ in rows:
        host, path = parts(url)
        r = rule(host, path)
        verdict = r.verdict if r else "block" if distrust.get(host, 0) > trust.get(host, 0) else "allow"
        found.append((page, host, path, r.pattern if r else None, verdict, trust.get(host, 0.0), distrust.get(host, 0.0)))
    return found


def same(got, want):
    assert len(got) == len(want)
    order = lambda x: str(x[:4])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-9)


def test_table_equals_brute_force(spark, small):
    pages = read(spark, small, "pages")
    same(url_filter.judge(pages).collect(), brute([(r["page_id"], r["url"], []) for r in pages.collect()]))


def test_links_spread_trust_and_distrust(spark):
    rows = [
        (1, "http://good.org/x", ["shop.net"]), (2, "http://shop.net/", []), (3, "http://farm.net/a", ["bad.com"]), (4, "HTTP://BAD.com/de/1", []),
        (5, "http://bad.com/other", ["shop.net"]), (6, "http://a.example.org/es/1", []), (7, "http://a.example.org/en/12?x", []), (8, "http://a.example.org/en/2", []),
        (9, None, []), (10, "no address", []), (11, "://", []), (12, "http://org", []), (13, "http://x.com/fr/#", []), (13, "http://x.com/fr/#", []), (14, "http://quiet.net/", []), (15, "x://Ü.Org/?/", []),
    ]
    html = lambda links: "".join(f"<a class=x HREF='https://{t.upper()}/p?q'>t</a> <a href=\"/own\">" for t in links)
    pages = spark.createDataFrame([(i, u, html(t) if t else None, "clash", 1.0) for i, u, t in rows], "page_id long, url string, html string, host string, rank double")
    got = url_filter.judge(pages).collect()
    want = brute(rows)
    same(got, want)
    verdicts = {r[0]: r[4] for r in want}
    assert verdicts[3] == "block" and verdicts[2] == "allow" and verdicts[5] == "block" and verdicts[14] == "allow" and verdicts[6] == "block"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/", "<a href='//d.e/x'>")], "page_id long, url string, html string")
    assert [tuple(r)[:5] for r in url_filter.judge(pages, ()).collect()] == [(1, "a.b.c", "/", None, "allow")]
