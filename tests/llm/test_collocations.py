"""Collocations against plain counting, with tables so small that buckets are shared."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from structex.llm import collocations

WORDS = "oil gas New YORK city of the a state, tax law; court: judge. naïve\tsea\nbank! river? old_ # x".split(" ")


def _rows(n, seed):
    import random

    rng = random.Random(seed)
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60)))) for _ in range(n)]
    rows += [("en", None), ("en", ""), ("xx", "..,;"), ("yy", "one two"), ("", "empty lang " * 12)]
    return rows + [("long", "so it goes, and so on; " * 500 + "same same same " * 400)] + [("en", "new york city hall of fame")] * 15


def _expected(rows, max_words, least, inside, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, max_words + 1):
                counts[lang].update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        best = []
        for phrase, a in candidates.items():
            held = any(
                len(q) > len(phrase) and 100 * b >= inside * a and any(q[k : k + len(phrase)] == phrase for k in range(len(q)))
                for q, b in candidates.items()
            )
            if not held:
                cuts = [(1_000_000 * a * a // (found[phrase[:k]] * found[phrase[k:]]), k) for k in range(1, len(phrase))]
                score, k = min(cuts)
                best.append((-score, -a, " ".join(phrase).encode(), found[phrase[:k]], found[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(
    ("max_words", "least", "inside", "top", "slots", "held"),
    [(3, 10, 50, 2000, 1 << 24, 400_000), (3, 3, 50, 25, 1 << 10, 20), (4, 5, 80, 2000, 1 << 16, 400_000), (2, 300, 50, 2000, 1 << 12, 7)],
)
def test_collocations_equal_plain_counting(spark, max_words, least, inside, top, slots, held, monkeypatch):
    monkeypatch.setattr(collocations, "PIECES", 1_000)
    rows = _rows(400, 5)
    docs = spark.createDataFrame([(b, "x", 1, a) for a, b in rows], "text string, phrase string, n int, lang string").repartition(5)
    got = collocations.collocations(docs, max_words=max_words, least=least, inside=inside, top=top, slots=slots, held=held)
    assert sorted(map(tuple, got.collect())) == _expected(rows, max_words, least, inside, top)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).count() == 0
    docs = spark.createDataFrame([(None, None), ("", "en"), ("too few", "en")], "text string, lang string")
    assert collocations.collocations(docs).count() == 0


def test_products_beyond_64_bits(spark):
    big = 3_000_000_001
    levels = [
        spark.createDataFrame([("en", "p", big + 7), ("en", "q", big + 1)], "lang string, phrase string, f long"),
        spark.createDataFrame([("en", "p q", big)], "lang string, phrase string, f long"),
    ]
    row = collocations._scored(levels).first()
    assert row["score"] == 1_000_000 * big * big // ((big + 7) * (big + 1))


def test_long_texts_are_cut_where_phrases_end():
    text = b"aa bb, cc dd ee. " * 50 + b"x" * 500
    parts = collocations.in_pieces(text, 40)
    assert b"".join(parts) == text and all(p[-1:] in b",." for p in parts[:-1]) and max(map(len, parts[:-1])) < 60
    assert collocations.in_pieces(b"x" * 100, 10) == [b"x" * 100]
