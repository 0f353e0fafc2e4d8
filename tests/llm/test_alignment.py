"""Alignment of two tokenizers against plain loops over whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from structex.llm import alignment

EDGE = [
    (1, "The quick brown fox, 12.5% naïve — 日本語 🙂\nnext  line\t\tend"),
    (2, "The quick brown fox, 12.5% naïve — 日本語 🙂\nnext  line\t\tend"),
    (3, None),
    (4, ""),
    (5, "a"),
    (5, "a"),
    (5, "another text of the same id"),
    (None, "no id"),
    (None, "no id"),
    (6, "<|endoftext|> </s> <unk> <0x41>"),
    (7, "▁ is given back as a space"),
    (8, " " * 300 + "x" * 5_000 + " " * 7),
    (9, "lorem ipsum dolor " * 9_000),
]


_tokenizers = []


def _sides(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not _tokenizers:
        _tokenizers.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
        _tokenizers[0].encode_special_tokens = True
    a_ids = _tokenizers[0].encode(" " + text, add_special_tokens=False).ids
    strings = alignment.encoder().strings()
    model, pieces = alignment._pieces(None)
    b_ids = model.encode(text)
    return [(i, strings[i]) for i in a_ids], [(i, pieces[i]) for i in b_ids]


def _plain(text):
    """(number of A ids, of B ids, groups, links with their ids) by a loop over bytes."""
    if not text:
        return 0, 0, [], []
    sides = _sides(text)
    if any(b"".join(s for _, s in side) != (" " + text).encode() for side in sides):
        return 0, 0, [], []
    owner, ends = [], []
    for side in sides:
        owner.append([k for k, (_, s) in enumerate(side) for _ in s])
        ends.append({0} | {sum(len(s) for _, s in side[: k + 1]) for k in range(len(side))} if len(side) < 3_000 else _ends(side))
    pairs = sorted(set(zip(*owner, strict=True)))
    links = [(sides[0][a][0], sides[1][b][0]) for a, b in pairs]
    bounds = sorted(ends[0] & ends[1])
    groups = []
    for begin, stop in zip(bounds, bounds[1:], strict=False):
        groups.append([[side[k][0] for k in range(own[begin], own[stop - 1] + 1)] for side, own in zip(sides, owner, strict=True)])
    return len(sides[0]), len(sides[1]), groups, links


def _ends(side):
    at, found = 0, {0}
    for _, s in side:
        at += len(s)
        found.add(at)
    return found


def _expected(rows):
    plain = [(doc_id, *_plain(text)) for doc_id, text in rows]
    counts = Counter(pair for row in plain for pair in set(row[4]))
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    out = []
    for doc_id, n_a, n_b, groups, links in plain:
        digest = ";".join("|".join(",".join(map(str, ids)) for ids in group) for group in groups)
        sha = hashlib.sha256(digest.encode()).hexdigest() if links else ""
        n_best = sum(counts[pair] == highest[pair[0]] for pair in links)
        out.append((doc_id, n_a, n_b, len(groups), len(links), n_best, sum(counts[pair] for pair in links), sha))
    return sorted(out, key=str)


def _frame(spark, rows):
    return spark.createDataFrame([(t, 0, i, "k") for i, t in rows], "text string, pair int, doc_id int, key string")


@pytest.mark.parametrize(("window", "most"), [(1 << 16, 1 << 21), (7, 1 << 21), (64, 0)])
def test_alignment_equals_plain_loops(spark, window, most):
    rows = alignment.aligned(_frame(spark, EDGE).repartition(3), window=window)
    got = sorted(map(tuple, alignment.digest(rows, most).collect()), key=str)
    assert got == _expected(EDGE)


def test_alignment_of_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, alignment.digest(alignment.aligned(docs)).collect()), key=str)
    assert got == _expected(texts)


def test_groups_and_links_are_rows(spark):
    rows = alignment.aligned(_frame(spark, EDGE[:1] + EDGE[-1:]), window=50)
    for doc_id, text in (EDGE[0], EDGE[-1]):
        _, _, groups, links = _plain(text)
        got = alignment.groups(rows).filter(F.col("doc_id") == doc_id).orderBy("start").collect()
        assert [[r["a_ids"], r["b_ids"]] for r in got] == groups
        assert got[0]["start"] == 0 and all(x["stop"] == y["start"] for x, y in zip(got, got[1:], strict=False))
        assert got[-1]["stop"] == len(text.encode()) + 1
        got = alignment.links(rows).filter(F.col("doc_id") == doc_id).orderBy("start").collect()
        assert [(r["a_id"], r["b_id"]) for r in got] == links


def test_alignment_of_nothing(spark):
    rows = alignment.aligned(_frame(spark, EDGE).limit(0))
    assert alignment.digest(rows).count() == 0
    assert alignment.groups(rows).count() == alignment.links(rows).count() == 0


@settings(max_examples=300, deadline=None)
@given(
    st.lists(
        st.sampled_from(["a", "don't", "  ", " ", "\n", "\n\n", "\t", "\xa0", "\u2003", "12", "é", "e\u0301", "日本", "🙂", "▁", "!?", "'s", "<|endoftext|>", "</s>", "\r\n", "\x1c", "ﬁ", "The"])
        | st.text(max_size=4),
        max_size=30,
    )
)
def test_ids_are_those_of_both_libraries(parts):
    text = "".join(parts) or "a"
    for side, plain in enumerate(_sides(text)):
        (got,) = alignment._side(side, None).ids([text])
        if b"".join(s for _, s in plain) == (" " + text).encode():
            assert got is not None and got.tolist() == [i for i, _ in plain]
        else:
            assert got is None
