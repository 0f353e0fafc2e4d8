"""URL filter against per-character loops, its rules by hand, and its accuracy on URLs it didn't learn from."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from structex.llm import url_filter
from structex.llm.ngrams import mix

MASK = 2**64 - 1

URLS = [
    ("http://shop.Example.COM/en/1?x=/fr/", "shop.example.com", "/en/1", "example.com/en/", "block"),
    ("http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://example.com/de/", "example.com", "/de/", "com/", "allow"),
    ("http://example.com", "example.com", "", None, None),
    ("http://example.com#/en/", "example.com", "", None, None),
    ("http://notcom/", "notcom", "/", None, None),
    ("com/x", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("://NET/es/a#b", "net", "/es/a", "net/es/", "block"),
    ("x://a.net/es", "a.net", "/es", None, None),
    ("x://a.net/fr/://b.com/", "a.net", "/fr/://b.com/", "net/fr/", "block"),
    ("x://ÄB.com/ü?", "Äb.com", "/ü", "com/", "allow"),
    ("x://a.com\n.net/q\nr", "a.com\n.net", "/q\nr", None, None),
]


def _pages(spark, urls):
    rows = [(k, u, "fold", 7) for k, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, known string, units int")


def test_hosts_paths_and_rules(spark):
    got = sorted(map(tuple, url_filter.judge(_pages(spark, [u[0] for u in URLS])).collect()))
    for (_, host, path, rule, known), row in zip(URLS, got, strict=True):
        assert row[1:4] == (host, path, rule)
        assert row[4] in ("allow", "block") if known is None else row[4] == known


def _made(n, seed):
    """URLs whose classes differ in how hosts and paths are spelt."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        good = rng.random() < 0.5
        host = "".join(rng.choice(("ba", "li", "no") if good else ("xq", "zz", "vk")) for _ in range(4))
        if rng.random() < 0.6:
            out.append((f"https://{host}.com/p/{rng.randint(0, 99)}" if good else f"https://{host}.net/fr/{rng.randint(0, 99)}", None))
        else:
            out.append((f"https://{host}.org/de/{rng.randint(0, 99)}", "allow" if good else "block"))
    return out


def _slot(values, slots):
    x = np.zeros(1, np.uint64)
    x[0] = values & MASK
    return mix(x)[0]


class Plain:
    """The same model with a dict of counters and a loop over characters."""

    def __init__(self, order, slots):
        self.order, self.slots, self.counts = order, slots, {}

    def _symbols(self, url):
        padded = b"\0" * self.order + url.encode() + b"\0"
        for at in range(self.order, len(padded)):
            yield padded[at], [padded[at - k : at] for k in range(self.order + 1)]

    def _keys(self, symbol, context):
        k, value = len(context), 0
        for byte in reversed(context):
            value = value << 8 | byte
        level = int(_slot(int(_slot(value + k, 0)) + (k << 8), 0))
        return ("pair", k, int(_slot(level + symbol + 1, 0)) % self.slots), ("context", k, level % self.slots)

    def learn(self, url, side):
        for symbol, contexts in self._symbols(url):
            for context in contexts:
                for key in self._keys(symbol, context):
                    self.counts[side, key] = self.counts.get((side, key), 0) + 1

    def score(self, url, weight):
        total = n = 0
        for symbol, contexts in self._symbols(url):
            n += 1
            for sign, side in ((1, "allow"), (-1, "block")):
                p = 1 / 256
                for context in contexts:
                    pair, whole = self._keys(symbol, context)
                    p = (self.counts.get((side, pair), 0) + weight * p) / (self.counts.get((side, whole), 0) + weight)
                total += sign * round(1e6 * math.log(p))
        return total // n


@pytest.mark.parametrize("slots", [1 << 17, 1 << 7])
def test_scores_equal_a_plain_model(spark, slots):
    urls = [u for u, _ in _made(60, 1)] + ["https://www.example.com/en/" + "lang" * 300, "ü://日本.com/"]
    pages = _pages(spark, urls).repartition(3)
    learned = url_filter.judge(pages, order=3, slots=slots, weights=(2.0,))
    rows = {r["url"]: r for r in learned.join(pages.select("page_id", "url"), "page_id").collect()}
    folds = {r[0]: r[1] for r in pages.selectExpr("url", "pmod(xxhash64(url), 5)").collect()}
    plain = Plain(3, slots)
    for url in urls:
        if rows[url]["rule"] is not None and folds[url] != 0:
            plain.learn(url, rows[url]["verdict"])
    for url in urls:
        score = plain.score(url, 2.0)
        assert rows[url]["score"] == score / 1e6
        if rows[url]["rule"] is None:
            assert rows[url]["verdict"] == ("allow" if rows[url]["score"] >= rows[url]["threshold"] else "block")


def test_urls_without_a_rule_follow_the_spelling(spark):
    made = _made(1_500, 2)
    got = url_filter.judge(_pages(spark, [u for u, _ in made])).orderBy("page_id").collect()
    right = [row["verdict"] == verdict for row, (_, verdict) in zip(got, made, strict=True) if verdict]
    assert len(right) > 400 and sum(right) >= 0.98 * len(right)


def test_calibration_takes_the_best_cut():
    rng = np.random.default_rng(3)
    for _ in range(20):
        scores = rng.integers(-6, 7, 40)
        good = rng.random(40) < 0.4
        bins = np.zeros((2, 2 * url_filter.BINS + 1), np.int64)
        for score, g in zip(scores, good, strict=True):
            bins[0 if g else 1, score + url_filter.BINS] += 1
        rate, cut = url_filter.best_cut(*bins)
        rates = {c: ((scores[good] >= c).mean() + (scores[~good] < c).mean()) / 2 for c in range(-8, 9)}
        assert rate == pytest.approx(max(rates.values())) and rates[cut] == pytest.approx(rate)


@pytest.mark.parametrize("urls", [[], [None, ""], ["http://a.com/"] * 9, ["http://a.net/fr/"] * 9 + [None]])
def test_too_few_examples(spark, urls):
    got = url_filter.judge(_pages(spark, urls)).collect()
    assert len(got) == len(urls)
    assert all(r["verdict"] == "allow" and r["score"] == 0 for r in got if r["rule"] is None)


def test_repeated_and_common_urls(spark):
    made = [u for u, _ in _made(200, 3)]
    got = url_filter.judge(_pages(spark, made + made[:1] * 3_000)).collect()
    assert len({(r["verdict"], r["score"]) for r in got if r["page_id"] >= 200 or r["page_id"] == 0}) == 1
