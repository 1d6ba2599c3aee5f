from __future__ import annotations

import math
import re

import pytest

from rookery.llm import licenses as L
from rookery.llm.common import read


def toks(text):
    return [t for t in (x.strip(".") for x in re.split(r"[^0-9a-z.]+", text.lower())) if t]


def brute(texts):
    """{id: (licence, score)} over all lines and templates, without anchors."""
    known = {t for _, s in L.TEMPLATES for t in toks(s)}
    df = {t: sum(t in set(toks(x or "")) for x in texts.values()) for t in known}
    n = len(texts)
    idf = lambda t: math.log((1 + n) / (1 + df.get(t, 0))) + 1
    vector = lambda ts: {t: ts.count(t) * idf(t) for t in ts}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    found = {}
    for i, text in texts.items():
        best = (0.0, "")
        for line in set((text or "").split("\n")):
            v = vector(toks(line))
            for name, s in L.TEMPLATES:
                u = vector(toks(s))
                score = round(sum(w * u.get(t, 0.0) for t, w in v.items()) / (norm(v) * norm(u)), 9) if v else 0.0
                if (score, [-ord(c) for c in name]) > (best[0], [-ord(c) for c in best[1]]):
                    best = (score, name)
        if best[0] >= L.THRESHOLD:
            found[i] = (best[1], best[0])
    return found


def test_headers_equal_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    want = brute({r["doc_id"]: r["text"] for r in docs.collect()})
    got = {r["doc_id"]: (r["license"], r["score"]) for r in L.headers(docs.select("doc_id", "text")).collect()}
    assert got.keys() == want.keys() and len(want) > 10
    assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=1e-6) for i in want)


def test_nearest_directory_wins(spark):
    mit, gpl, other = "Released under the MIT License.", "code\n// This work is licensed under the GNU General Public License version 3", "nothing here"
    rows = [
        (1, "r/LICENSE", mit), (2, "r/a/COPYING.txt", gpl), (3, "r/a/x.c", other), (4, "r/a/b/c/y.c", other), (5, "r/z.c", other), (6, "s/z.c", other),
        (7, "r/a/own.c", "/* Licensed under the Apache License, Version 2.0 */"), (8, None, other), (9, "r/n.c", None), (10, "r/LICENSE.d/q.c", ""), (11, "top.c", other), (9, "r/n.c", None),
        (12, "r/licensed.c", other), (13, "ra/x.c", other),
    ]
    files = spark.createDataFrame([(*r, "clash", 0.0) for r in rows], "doc_id long, path string, text string, license string, score double")
    got = {r["doc_id"]: (r["license"], r["origin"], r["inherited_from"]) for r in L.scan(files).collect()}
    assert L.scan(files).count() == len(rows)
    assert got[1][:2] == ("MIT", "header") and got[7][:2] == ("Apache-2.0", "header")
    assert got[3] == got[4] == ("GPL-3.0", "inherited", "r/a/COPYING.txt")
    assert got[5] == got[9] == got[10] == ("MIT", "inherited", "r/LICENSE")
    assert got[6] == got[8] == got[11] == got[13] == (None, "none", None)
    assert L.scan(files.limit(0)).count() == 0


def test_odd_rows(odd_docs, no_docs):
    assert L.scan(L.paths_of(odd_docs)).count() == odd_docs.count()
    assert L.scan(L.paths_of(no_docs)).count() == 0
