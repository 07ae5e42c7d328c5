from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from statistics import fmean, pstdev

import pytest

from trialmart.llm.queries import op3_urls
from trialmart.llm.urls import RULES, judge_urls


def parts(url):
    if url is None or "://" not in url:
        return "", "", url or ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, after = rest[:cut], rest[cut:]
    path = after.split("?")[0].split("#")[0]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host.translate(lower), path, rest


def rule(host, path):
    fits = [
        (len(r), r, verdict)
        for verdict, r in RULES
        for name, start in [r.split("/", 1)]
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start)
    ]
    return max(fits)[1:] if fits else (None, None)


class Markov:
    """Witten-Bell interpolation by its definition."""

    def __init__(self, texts, symbols, order=4):
        self.order, self.symbols, self.next = order, symbols, defaultdict(Counter)
        for text in texts:
            padded = "\x02" * order + text + "\x03"
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    self.next[padded[i - k : i]][padded[i]] += 1

    def p(self, context, c):
        lower = self.p(context[1:], c) if context else 1 / self.symbols
        seen = self.next.get(context)
        if not seen:
            return lower
        return (seen[c] + len(seen) * lower) / (seen.total() + len(seen))

    def mean(self, text):
        padded = "\x02" * self.order + text + "\x03"
        places = range(self.order, len(padded))
        return [math.log(self.p(padded[i - self.order : i], padded[i])) for i in places]


def slow(urls):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = []
    for url in urls:
        host, path, rest = parts(url)
        text = rest.translate(lower)
        rows.append((host, path, text, *rule(host, path), zlib.crc32(text.encode()) % 5 == 0))
    symbols = len({c for row in rows for c in row[2] + "\x03"})
    models = [
        Markov([r[2] for r in rows if r[4] == side and not r[5]], symbols)
        for side in ("allow", "block")
    ]
    ratios = [
        fmean(a - b for a, b in zip(models[0].mean(r[2]), models[1].mean(r[2]), strict=True))
        for r in rows
    ]
    sides = [
        [x for x, r in zip(ratios, rows, strict=True) if r[4] == side and r[5]]
        for side in ("allow", "block")
    ]
    (ma, mb), (sa, sb) = map(fmean, sides), map(pstdev, sides)
    limit = (ma * sb + mb * sa) / (sa + sb)
    return [
        (r[0], r[1], r[3], r[4] or ("allow" if x >= limit else "block"), x)
        for r, x in zip(rows, ratios, strict=True)
    ]


def test_query_equals_brute_force(llm, sf_dir):
    pages = llm.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()
    want = dict(zip([p["page_id"] for p in pages], slow([p["url"] for p in pages]), strict=True))
    found = op3_urls(llm, sf_dir).collect()
    assert len(found) == len(pages)
    for row in found:
        *exact, ratio = want[row["page_id"]]
        assert [row[c] for c in ("host", "path", "rule", "verdict")] == exact
        assert row["ratio"] == pytest.approx(ratio)


URLS = [
    ("HTTP://A.Example.ORG/ES/x", "a.example.org", "/ES/x", "org/", "allow"),
    ("http://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
    ("http://x.example.org/en/17?a#b", "x.example.org", "/en/17", "example.org/en/1", "block"),
    ("http://badexample.org/en/1", "badexample.org", "/en/1", "org/", "allow"),
    ("http://org?q=/a", "org", "", None, None),
    ("http://b.com/de/?x=://y/z", "b.com", "/de/", "com/de/", "block"),
    ("http://b.com#/de/", "b.com", "", None, None),
    ("no scheme.org/es/", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("://", "", "", None, None),
]


def test_hosts_paths_and_rules(llm):
    rows = [(i, url[0], "x", "y") for i, url in enumerate(URLS)]
    rows.append((None, "http://b.com/fr/" + "long/" * 5000, None, None))
    df = llm.createDataFrame(rows, "page_id int, url string, host string, rule string")
    found = judge_urls(df).collect()
    assert len(found) == len(rows)
    for row in found:
        if row["page_id"] is not None:
            want = URLS[row["page_id"]]
            assert (row["host"], row["path"], row["rule"]) == want[1:4]
            assert row["verdict"] == want[4] or want[4] is None
        assert row["verdict"] in ("allow", "block")


@pytest.mark.parametrize(
    ("urls", "verdicts"),
    [
        (["http://a.org/", "http://a.net/", None], {"allow"}),
        (["http://a.net/"], {"allow"}),
        ([], set()),
    ],
)
def test_without_one_of_the_classes(llm, urls, verdicts):
    df = llm.createDataFrame([(u,) for u in urls], "url string").selectExpr("1 AS page_id", "url")
    assert {row["verdict"] for row in judge_urls(df).collect()} == verdicts
    blocked = llm.createDataFrame(
        [(i, f"http://b{i}.com/de/") for i in range(20)] + [(99, "http://x.net/")],
        "page_id int, url string",
    )
    assert {row["verdict"] for row in judge_urls(blocked).collect()} == {"block"}
