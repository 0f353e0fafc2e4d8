"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from structex.llm import (
    attention_lm,
    components,
    license_scan,
    line_dedup,
    media,
    mixing,
    packing,
    quality_model,
    quality_rules,
    queries,
    role_repair,
    similarity_join,
    webp,
)
from structex.llm.license_templates import TEMPLATES

DATA = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _size string, h int"
EDGE = [
    (1, None, "en", "a", None, "x", 1),
    (2, "", "en", None, 0, "x", 1),
    (3, "one two", None, "a", 7, None, None),
    (3, "one two", None, "a", 7, None, None),
    (None, "some words that have no id at all", "en", "b", 1, "x", 2),
    (5, "word " * 30_000, "en", "b", 1, "x", 2),
    (6, " \t\n \x0b", "en", "b", 1, "x", 2),
    (7, "All rights reserved.", "en", "b", 1, "x", 2),
    (8, "éß 漢字 🙂 " * 40, "de", "c", 1, "x", 2),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_rules_equal_brute_force(spark, rows):
    got = {r.doc_id: r for r in queries.op10_quality_rules(spark, DATA).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        w = words(text)
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if seen[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        )
        assert g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (g.base_failed and g.kept)


def test_rules_order_never_changes_the_verdict(docs):
    for order in (quality_rules.DEFAULT_RULES, quality_rules.DEFAULT_RULES[::-1]):
        f = quality_rules._getter(F.col("t"), F.col("w"))
        rows = docs.select("doc_id", F.col("text").alias("t")).withColumn("w", quality_rules.words_of(F.col("t")))
        kept = {r.doc_id for r in rows.filter(F.isnull(quality_rules.cascade(order, f))).collect()}
        assert kept == {r.doc_id for r in quality_rules.keep_good(docs).collect()}


def test_rules_sample_is_of_all_files(spark, tmp_path):
    """Files of a sorted table: the sample is of few of them, wherever they are, and its size is bounded."""
    path = str(tmp_path / "many")
    spark.range(6_000).selectExpr("id as doc_id", "concat('text ', id) as text").repartitionByRange(30, "doc_id").write.parquet(path)
    docs = spark.read.parquet(path)
    ids = [int(r.t.split()[1]) for r in quality_rules.sample_of(docs, sample_rows=200).collect()]
    assert 150 < len(ids) < 400 and max(ids) - min(ids) > 2_000
    assert quality_rules.sample_of(docs.select("text").distinct(), sample_rows=200).count() > 100
    plan = quality_rules.plan_cascade(docs, quality_rules.DEFAULT_RULES)
    assert plan.rules[0].name == "too_few_words" and plan.measured["too_few_words"][0] == 1


def test_rules_edges(edge, empty):
    got = {r.doc_id: r for r in quality_rules.assess(edge).collect()}
    assert got[1].n_words == got[2].n_words == got[6].n_words == 0 and got[1].base_failed
    assert got[5].n_repeat_words == 30_000
    assert quality_rules.assess(empty).count() == 0
    assert quality_rules.keep_good(edge).columns == edge.columns


def test_classifier_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = queries.op1_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) >= 0.95


def test_classifier_interactions_equal_pairs():
    model = quality_model.Machine()
    model.v = np.random.default_rng(0).normal(size=model.v.shape).astype(np.float32)
    index, value, numbers = quality_model.features([b"a b c a", b""])
    plain = []
    for part_i, part_v in zip(np.split(index, np.cumsum(numbers)[:-1]), np.split(value, np.cumsum(numbers)[:-1])):
        plain.append(sum(float(model.v[i] @ model.v[j]) * x * y for a, (i, x) in enumerate(zip(part_i, part_v)) for j, y in list(zip(part_i, part_v))[:a]))
    assert np.allclose(model.margin(index, value, numbers), plain, rtol=1e-3, atol=1e-3)


def test_classifier_learns_from_a_repeated_id_once(spark, docs):
    """Rows that repeat a labelled id don't grow what is learned from, and equal texts score alike."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    plain = {r.doc_id: r.score for r in quality_model.score(docs, labels).collect()}
    again = quality_model.score(docs.unionByName(docs).unionByName(docs.withColumn("quality", F.lit(0)).drop("quality")), labels.unionByName(labels)).collect()
    assert len(again) == 3 * len(plain) and all(math.isclose(r.score, plain[r.doc_id], rel_tol=1e-6) for r in again)


def test_classifier_edges(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_model.score(edge, none).collect()
    assert len(got) == len(EDGE) and all(abs(r.score - 0.5) < 0.5 for r in got)
    assert quality_model.score(empty, none).count() == 0


def test_packing_ids_and_places(spark, rows):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries.op2_best_fit_packing(spark, DATA).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in pieces] == [a for a, _ in packing.cut(len(ids), 2048)]
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
        assert sum(r.length for r in pieces) == len(ids)
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_bin) <= math.ceil(sum(r.length for r in got) / 2048) + 2


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="ab 'sß\n\t 1.,<|>endoftx", max_size=12), st.just("<|endoftext|>"), st.text(max_size=4)), max_size=8).map("".join))
def test_ids_equal_the_tokenizer(tokenizer, text):
    from structex.llm.tokens import encoder

    assert encoder().packed(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit(lengths):
    bins = packing.best_fit(lengths, 64)
    assert sorted(p for b in bins for p in b) == list(range(len(lengths)))
    assert all(sum(lengths[p] for p in b) <= 64 for b in bins)


def test_ids_of_very_long_texts(tokenizer, monkeypatch):
    from structex.llm import tokens

    e = tokens.encoder()
    texts = ["a" + " " * 60 + "b \n" + "\n" * 55 + "c", " " * 70, "\t" * 51 + "x" * 80, "word " * 40]
    plain = [e.packed(t) for t in texts]
    monkeypatch.setattr(tokens, "LONG", 50)
    monkeypatch.setattr(tokens, "_RUN", re.compile(tokens._RUN.pattern.replace("50000", "50")))
    assert [e.packed(t) for t in texts] == plain
    monkeypatch.undo()
    assert len(e.packed(" " * 1_500_000 + "x")) > 0 and len(e.packed("x" * 400_000)) > 0


def test_packing_tasks_stay_bounded(spark):
    """Lengths of which no two fit together, and one that fits any: no round gathers them."""
    for lengths in ([1200] * 900, [1200] * 900 + [5], [700, 900, 1100] * 300, [1] * 2000):
        docs = spark.createDataFrame([(i, "a " * (n - 2) + "a") for i, n in enumerate(lengths)], "doc_id long, text string")
        rounds: list = []
        got = packing.pack(docs, items_per_task=50, rounds=rounds).collect()
        assert Counter(r.length for r in got) == Counter(lengths if lengths[0] > 1 else [2] * 2000)
        assert all(n <= 50 * tasks for n, tasks in rounds) and len(rounds) < 12
        totals = Counter()
        for r in got:
            totals[r.sequence_id] += r.length
        assert max(totals.values()) <= 2048 and len(totals) <= math.ceil(sum(totals.values()) / 2048) * (1.75 if lengths[0] == 1200 else 1.25) + 3


def test_packing_rounds_and_edges(edge, empty, docs):
    many = packing.pack(docs, items_per_task=20).collect()
    assert sum(r.length for r in many) == sum(r.length for r in packing.pieces_of(docs).collect())
    by_bin = Counter()
    for r in many:
        by_bin[r.sequence_id] += r.length
    assert max(by_bin.values()) <= 2048
    got = packing.pack(edge).collect()
    assert [r.length for r in got if r.doc_id in (1, 2)] == [1, 1] and len([r for r in got if r.doc_id == 3]) == 2
    assert packing.pack(empty).count() == 0


def test_lm_base_and_normalisation(spark, rows):
    got = {r.doc_id: r for r in queries.op3_attention_lm(spark, DATA).collect()}
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = {i: [*text.encode().translate(lower).split(), "end"] for i, text in rows}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2}
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (i not in train, len(w), sum(x in c for x in w), n)
        assert math.isclose(g.base_score, base, rel_tol=1e-9) and g.score < 0


def _flat(texts):
    x, numbers, _, _ = attention_lm.ids_of([attention_lm.normal(t) for t in texts], attention_lm.Units())
    return x.astype(np.int64), numbers


def _fitted(x, numbers):
    unigrams = np.bincount(x, minlength=attention_lm.N_IDS).astype(float)
    known, size = attention_lm.known_of(unigrams), attention_lm.KNOWN
    pairs = np.zeros((3, size * size))
    for k, cells in attention_lm.count_pairs(known[x], *(known[h] for h in attention_lm.before(x, numbers)), numbers):
        pairs[k] += np.bincount(cells, minlength=size * size)
    model = attention_lm.Attention(pairs.reshape(3, size, size), unigrams)
    rng = np.random.default_rng(2)
    model.w["oc"] += rng.normal(0, 0.3, model.w["oc"].shape).astype(np.float32)
    model.w["om"] += rng.normal(0, 0.3, model.w["om"].shape).astype(np.float32)
    return model


def test_lm_ids_equal_the_tokenizer(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [attention_lm.normal(t) for _, t in rows[:60]] + [b"", b" \n ", b"one"]
    x, numbers, _, _ = attention_lm.ids_of(texts, attention_lm.Units(most=5))
    for own, t in zip(np.split(x, np.cumsum(numbers)[:-1]), texts, strict=True):
        plain = "".join(" " + w for w in re.findall(r"[^\x20\x09-\x0D]+", t.decode()))
        assert own.tolist() == [*tokenizer.encode(plain, add_special_tokens=False).ids, attention_lm.END]


def test_lm_new_words_are_encoded_in_rows():
    odd = ["a\xa0b", "\x85", "x\u3000", "\u2028y", "'s", "x'll", "'", "\x1c\x1f", "a\x1eb", "\x00", "<|endoftext|>", "é" * 24, "é" * 60, "w" * 99, "語", "\u200b", "12", "_", "\ud800"]
    words = [w.encode("utf-8", "surrogatepass") for w in [f"w{i}é-{i * i}" if i % 3 else f"w{i}" for i in range(3000)] + odd]
    alone = attention_lm.Units()
    calls, encode = [], alone.encode
    for most in (attention_lm.MAX_UNITS, 5):
        units = attention_lm.Units(most)
        units.encode = lambda text: calls.append(1) or encode(text)
        assert units.of(words) == units.of(words) == [alone[w] for w in words] and len(units) <= most
    # 4 rows, odd words one by one: the first time, and three times more by the one that remembers 5
    assert len(calls) < 4 * (4 + len(odd))


def test_lm_is_a_distribution_and_causal():
    x, numbers = _flat(["The cat sat on the mat and the cat ran " * 5])
    scorer = _fitted(x, numbers).scorer()
    place = 7
    # every id after the same ids: its probabilities sum to 1
    every = np.arange(attention_lm.N_IDS)
    heads = np.tile(x[: place + 1], (len(every), 1))
    heads[:, -1] = every
    got = scorer.log_probability(heads.ravel(), np.full(len(every), place + 1)).reshape(len(every), -1)
    assert math.isclose(np.exp(got[:, -1]).sum(), 1, rel_tol=1e-4)
    assert np.allclose(got[:, :-1], got[0, :-1], atol=1e-4)  # the last id changes nothing before it


def test_lm_scores_equal_a_plain_loop():
    """Window by window and place by place, without batches, masks, classes sorted or tables."""
    x, numbers = _flat(["a dog sat on a mat, and a cat " * 12, "", "one", "the end of the road " * 9])
    model = _fitted(x, numbers)
    got, w = model.scorer().log_probability(x, numbers), model.w
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    at = 0
    for n in numbers:
        ids = [attention_lm.END, attention_lm.END, *x[at : at + n]]
        e = model.known[ids]
        for t in range(n):
            windows = 0 if t < attention_lm.LENGTH else 1 + (t - attention_lm.LENGTH) // attention_lm.STRIDE
            begin = windows * attention_lm.STRIDE
            seen = [(w["e"][e[j + 1]], w["e"][e[j]], t - j) for j in range(begin, t + 1)]
            q = seen[-1][0] @ w["q"]
            a = soft(np.array([q @ (s @ w["k"] + s2 @ w["k2"]) / math.sqrt(attention_lm.KEY) + w["d"][g] for s, s2, g in seen]))
            h = np.tanh(seen[-1][0] @ w["r"] + seen[-1][1] @ w["r2"] + sum(p * (s @ w["v"]) for p, (s, _, _) in zip(a, seen)))
            one, two, (c, m) = e[t + 1], e[t], divmod(e[t + 2], attention_lm.MEMBERS)
            pc = soft(h @ w["oc"] + model.class1[one] + w["gc"] * model.class2[two])
            pm = soft(h @ w["om"][c] + model.member1[one * attention_lm.CLASSES + c] + w["gm"][c] * model.member2[two * attention_lm.CLASSES + c])
            assert math.isclose(got[at + t], math.log(pc[c] * pm[m]) + model.within[ids[t + 2]], rel_tol=1e-3, abs_tol=1e-3)
        at += n


def test_lm_gradient():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 40)
    model = _fitted(x, np.array([40]))
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    one, two = attention_lm.before(x, np.array([40]))
    windows = [model.known[v][None, :] for v in (one, two, x)]
    windows[2][0, 3] = -1
    _, g = model.step(*windows)
    for k in model.w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep, e = model.w[k][at], 1e-4
        model.w[k][at] = keep + e
        up = model.step(*windows)[0]
        model.w[k][at] = keep - e
        down = model.step(*windows)[0]
        model.w[k][at] = keep
        assert math.isclose((up - down) / (2 * e), float(g[k][at]), rel_tol=2e-2, abs_tol=1e-5), k


def _some_windows(seed=2, rows=6):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, attention_lm.KNOWN, 4000)
    model = _fitted(x, np.array([4000]))
    windows = [rng.integers(0, attention_lm.KNOWN, (rows, attention_lm.LENGTH)) for _ in range(3)]
    windows[2][0, 9:] = -1
    return model, windows


def test_lm_step_takes_powers_of_all_classes_at_once(monkeypatch):
    model, windows = _some_windows()
    assert len(np.unique(windows[2] // attention_lm.MEMBERS)) > attention_lm.CLASSES
    calls, power = [], np.exp
    monkeypatch.setattr(np, "exp", lambda *a, **k: calls.append(1) or power(*a, **k))
    model.step(*windows)
    assert len(calls) == 3  # weights, classes, members


def test_lm_step_with_large_exponents(monkeypatch):
    model, windows = _some_windows()
    model.w["oc"][:] = np.linspace(-200, 200, model.w["oc"].size).reshape(model.w["oc"].shape)
    model.w["q"] *= 300
    loss, g = model.step(*windows)
    monkeypatch.setattr(attention_lm, "LARGE", -1)  # the greatest is always taken off
    plain_loss, plain = model.step(*windows)
    assert math.isfinite(loss) and math.isclose(loss, plain_loss, rel_tol=1e-5)
    assert all(np.isfinite(v).all() and np.allclose(v, plain[k], atol=1e-5) for k, v in g.items())
    model, windows = _some_windows()
    plain_loss, plain = model.step(*windows)
    monkeypatch.undo()
    loss, g = model.step(*windows)
    assert math.isclose(loss, plain_loss, rel_tol=1e-5)
    assert all(np.allclose(v, plain[k], atol=1e-5) for k, v in g.items())


def test_lm_weights_in_a_row():
    model, _ = _some_windows()
    row = attention_lm._packed(model.w)
    parts = attention_lm._unpacked(row, model.w)
    assert all((parts[k] == v).all() and parts[k].shape == v.shape for k, v in model.w.items())
    row += 1  # the weights are parts of the row, not copies
    assert all((parts[k] == v + 1).all() for k, v in model.w.items())


def test_lm_windows_score_each_id_once():
    numbers = np.array([1, 31, 64, 65, 104, 105, 300])
    count = np.zeros(numbers.sum(), int)
    for start, size, skip in attention_lm.windows_of(numbers):
        for a, n in zip(start, size):
            count[a + skip : a + n] += 1
    assert (count == 1).all()


def test_lm_every_row_is_trained_on(spark, monkeypatch):
    rng = np.random.default_rng(0)
    for n in (1, 64, 65, 64 * 31, 64 * 500 + 3):
        ids = rng.integers(0, 1000, n).astype("<u2")
        chosen = attention_lm.chosen_windows(ids.tobytes(), attention_lm.SHARE)
        total = -(-n // attention_lm.LENGTH)
        assert 1 <= len(chosen) and abs(len(chosen) - total / attention_lm.SHARE) <= 1
        for w, part in chosen:
            head = np.concatenate(([attention_lm.END] * 2, ids))[w * 64 : w * 64 + 66]
            assert np.frombuffer(part, "<u2").tolist() == head.tolist()
    # equal rows don't end up in one part, and the mean of the copies is what the model becomes
    monkeypatch.setattr(attention_lm, "PART_WINDOWS", 40)
    monkeypatch.setattr(attention_lm, "LEVEL", 3)
    one = rng.integers(0, 1000, 60).astype("<u2").tobytes()
    train = spark.createDataFrame([(bytearray(one),)] * 400, "ids binary")
    x = np.frombuffer(one, "<u2").astype(np.int64)
    model = _fitted(x, np.array([60]))
    before = {k: v.copy() for k, v in model.w.items()}
    attention_lm.train_attention(model, train)
    assert any((model.w[k] != before[k]).any() for k in before) and all(np.isfinite(v).all() for v in model.w.values())


@pytest.mark.parametrize("rows", [3, 1100])
def test_lm_trains_once_on_every_window_at_every_size(spark, monkeypatch, rows):
    class Counting:
        """Counts the windows of its passes instead of learning, and adds up their first entries."""

        known = np.arange(attention_lm.N_IDS)

        def __init__(self):
            self.w = {"sum": np.zeros(1), "windows": np.zeros(1)}

        def train(self, windows, rate, batch=1, epochs=1):
            self.w["windows"] = self.w["windows"] + epochs * len(windows)
            self.w["sum"] = self.w["sum"] + epochs * windows[:, 2].sum()

    monkeypatch.setattr(attention_lm, "PART_WINDOWS", 1 << 30)  # one part: its copy is the mean
    ids = [np.arange(64 * 70 - 5) // 64 % 2 + i % 2 for i in range(rows)]  # 1,100 rows: 77,000 windows
    train = spark.createDataFrame([(bytearray(x.astype("<u2").tobytes()),) for x in ids], "ids binary")
    model = Counting()
    attention_lm.train_attention(model, train)
    assert (model.w["windows"][0], model.w["sum"][0]) == (70 * rows, sum(int(x[::64].sum()) for x in ids))


def test_lm_beats_the_base_on_held_out_rows(spark):
    got = [r for r in queries.op3_attention_lm(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in got) > 0.95 * sum(r.base_score for r in got)


def test_lm_edges(spark, edge, empty):
    got = {r.doc_id: r for r in attention_lm.score(edge).collect()}
    assert got[1].n_tokens == got[2].n_tokens == got[6].n_tokens == 1
    assert math.isclose(got[1].score, got[2].score, rel_tol=1e-5) and math.isclose(got[1].score, got[6].score, rel_tol=1e-5)
    assert attention_lm.score(empty).count() == 0
    same = [r for r in attention_lm.score(edge).collect() if r.doc_id == 3]
    assert len(same) == 2 and same[0].base_score == same[1].base_score and math.isclose(same[0].score, same[1].score, rel_tol=1e-5)
    # nothing to learn from: all ids are equally likely
    (r,) = attention_lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), held_out=F.lit(True)).collect()
    assert math.isclose(r.score, -3 * math.log10(attention_lm.N_IDS), rel_tol=1e-4) and r.n_known == 0


def test_lm_base_does_not_depend_on_what_tasks_remember(docs, monkeypatch):
    some = docs.filter("doc_id % 4 = 0").cache()
    whole = {r.doc_id: (r.base_score, r.n_known) for r in attention_lm.score(some).collect()}
    monkeypatch.setattr(attention_lm, "MAX_WORDS", 50)
    few = {r.doc_id: (r.base_score, r.n_known) for r in attention_lm.score(some).collect()}
    assert whole.keys() == few.keys()
    assert all(math.isclose(whole[i][0], few[i][0], rel_tol=1e-9) and whole[i][1] == few[i][1] for i in whole)


def test_license_templates_find_themselves(spark, empty):
    texts = [(i, f"Some prose first.\n{t}\nAnd more prose.") for i, t in enumerate(TEMPLATES.values())] + [(99, None), (98, "no marks"), (97, "a license to drive is needed")]
    got = license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    by_doc = defaultdict(set)
    for r in got:
        by_doc[r.doc_id].add(r.license)
        assert texts[r.doc_id][1][r.start : r.end].strip()
    for i, name in enumerate(TEMPLATES):
        assert name in by_doc[i], name
    assert not {97, 98, 99} & set(by_doc)
    assert license_scan.scan(empty).count() == 0


def test_license_published_forms(spark):
    split = {
        "MIT": " subject to the following conditions: ",
        "Apache-2.0": " Unless required",
        "GPL-3.0": " This program is distributed",
        "BSD-3-Clause": " 2. Redistributions",
    }
    prose = "The river rose in spring and the fields were under water for weeks "
    texts, expected = [], {}
    for name, mark in split.items():
        a, b = TEMPLATES[name].split(mark)
        wrapped = "\n".join(re.findall(r".{1,60}(?:\s|$)", TEMPLATES[name]))
        forms = [
            f"{a}{mark.rstrip()}\n\n{b}" if name == "MIT" else f"{a}\n\n{mark.strip()}{b}",
            f"{prose * 5}{TEMPLATES[name]} {prose * 5}",
            f"Copyright (c) 2001 Some One\n{wrapped}\nTHE SOFTWARE IS PROVIDED AS IS, and the authors are not liable for {prose * 4}",
            "\n".join(f" * {line}" for line in wrapped.split("\n")),
        ]
        for form in forms:
            expected[len(texts)] = name
            texts.append((len(texts), form))
    found = defaultdict(list)
    for r in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        found[r.doc_id].append(r)
    for i, name in expected.items():
        (r,) = [r for r in found[i] if r.license == name]
        assert (r.missing_words, r.extra_words) == (0, 0), (name, i)
        assert license_scan.words(texts[i][1][r.start : r.end]) == license_scan.words(TEMPLATES[name])


#: The notices as their publishers print them (fixed values): lines, blank lines and all.
PUBLISHED = {
    "MIT": """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
""",
    "Apache-2.0": """   Copyright 2020 Some Body

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
""",
    "GPL-3.0": """    <one line to give the program's name and a brief idea of what it does.>
    Copyright (C) <year>  <name of author>

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
""",
    "BSD-3-Clause": """Copyright 2020 Some Body

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
""",
}


def test_license_published_notices(spark, edge):
    texts = [(i, t) for i, t in enumerate(PUBLISHED.values())]
    texts += [(9, "no word of it\n" * 60_000 + PUBLISHED["MIT"]), (0, texts[0][1])]  # very long, and repeated
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("license", F.lit("x")).withColumn("start", F.lit(1))
    found = Counter((r.doc_id, r.license) for r in license_scan.scan(docs).collect())
    for i, name in enumerate(PUBLISHED):
        assert found[i, name] == (2 if i == 0 else 1), (name, found)
    assert found[9, "MIT"] == 1
    assert {r.doc_id for r in license_scan.scan(edge).collect()} == {7}


def test_license_markers_leave_no_block_out():
    """More of a template's words are markers than may be missing."""
    for templates in (TEMPLATES, {"a": "x y z", "b": "x x x x x x x x x q"}):
        markers = license_scan.markers_of(templates)
        for text in templates.values():
            w = license_scan.words(text)
            assert sum(x in markers for x in w) > license_scan.slack(len(w))


def _license_plainly(block):
    """The winner of a block: every template compressed with, ranked by its saving, confirmed by alignment.

    Nothing is left out and no template's saving has a lower bound.
    """
    from difflib import SequenceMatcher

    scanner = license_scan.Scanner(TEMPLATES)
    own, confirmed = license_scan.words(block), []
    data = " ".join(own).encode()
    for name, text in sorted(TEMPLATES.items()):
        goal = license_scan.words(text)
        parts = [o for o in SequenceMatcher(None, goal, own, autojunk=False).get_opcodes() if o[0] != "equal"]
        missing, extra = sum(o[2] - o[1] for o in parts), sum(o[4] - o[3] for o in parts)
        if max(missing, extra) <= 0.15 * len(goal):
            confirmed.append((len(scanner.plain.compress(data)) - len(scanner.given[name].compress(data)), missing + extra, name))
    first = max((c[0] for c in confirmed), default=None)
    near = [c for c in confirmed if c[0] > first - license_scan.TIE]
    return min(near, key=lambda c: (c[1], -c[0], c[2]))[2] if near else None


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(TEMPLATES)), st.randoms(use_true_random=False), st.integers(0, 18), st.sampled_from(["river", "of", "0123456789abcdefghijklmnopqrstuv" * 4]))
def test_license_blocks_equal_every_template_tried(name, rng, changes, word):
    w = TEMPLATES[name].split()
    for _ in range(changes):
        at = rng.randrange(len(w) + 1)
        w[at : at + rng.choice((0, 1))] = rng.choice(([], [word]))
    block = " ".join(w)
    got = license_scan.Scanner(TEMPLATES)._judge(block)
    assert (got and got[0]) == _license_plainly(block)
    if got is not None and "\n" not in block:
        assert license_scan.Scanner(TEMPLATES).scan("Some prose. " + block + "\nmore of it")


def test_license_candidates_meet_every_template():
    scanner = license_scan.Scanner(TEMPLATES)
    prose = "The license of this software, the river said, is reserved for the one under the bridge.\n" * 30
    text = f"{prose}All rights reserved.\n{prose}"
    used = defaultdict(set)

    class Counting:
        def __init__(self, name, own):
            self.name, self.own = name, own

        def compress(self, data):
            used[data].add(self.name)
            return self.own.compress(data)

    scanner.given = {k: Counting(k, c) for k, c in scanner.given.items()}
    assert [r[0] for r in scanner.scan(text)] == ["All-rights-reserved"]
    assert b"all rights reserved" in used and len(used) > 1
    # the others are compressed with all templates at once, and then with all that could still save enough
    fits = [license_scan._normal(license_scan.words(text[a:b])) for a, b in license_scan.blocks(text, scanner.marked)]
    for data in {d for d in fits if d.count(b" ") + 1 in scanner.sizes}:
        together = len(scanner.plain.compress(data)) - len(scanner.every.compress(data))
        assert used[data] == {k for k, most in scanner.most.items() if together + license_scan.NEARLY >= license_scan.LEAST_SAVING * most}


def test_license_the_greatest_saving_is_confirmed_first():
    """Both wordings can be confirmed; the one that saves more wins, though more words differ."""
    long = "unmistakably characteristic responsibilities notwithstanding interchangeability"
    templates = {
        "a": f"{long} one two three four five six seven eight nine ten eleven twelve thirteen fourteen",
        "b": "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen",
    }
    scanner = license_scan.Scanner(templates)
    block = f"{' '.join(long.split()[:3])} one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    name, plain, saved, missing, extra, _ = scanner._judge(block)
    data = block.encode()
    savings = {k: len(scanner.plain.compress(data)) - len(c.compress(data)) for k, c in scanner.given.items()}
    assert name == max(savings, key=savings.get) == "a" and saved == savings["a"] and plain == len(scanner.plain.compress(data))
    assert (missing, extra) == (2, 0)


@settings(max_examples=12, deadline=None)
@given(st.sampled_from([k for k, v in sorted(TEMPLATES.items()) if len(v.split()) < 20]), st.randoms(use_true_random=False), st.integers(0, 3))
def test_license_whole_texts_equal_every_stretch_tried(name, rng, changes):
    """A text has a finding exactly if one of all its stretches of words can be confirmed, and there."""
    from difflib import SequenceMatcher

    w = TEMPLATES[name].split()
    for _ in range(changes):
        at = rng.randrange(len(w) + 1)
        w[at : at + rng.choice((0, 1))] = rng.choice(([], ["river"]))
    sep = rng.choice((" ", "\n", ". "))
    text = f"the old mill{sep}{' '.join(w)}{sep}by the sea and more"
    own, good = license_scan.words(text), set()
    for k, goal in ((k, license_scan.words(v)) for k, v in TEMPLATES.items()):
        n = len(goal)
        for size in range(n - license_scan.slack(n), n + license_scan.slack(n) + 1):
            for i in range(len(own) - size + 1):
                parts = [o for o in SequenceMatcher(None, goal, own[i : i + size], autojunk=False).get_opcodes() if o[0] != "equal"]
                if max(sum(o[2] - o[1] for o in parts), sum(o[4] - o[3] for o in parts)) <= license_scan.slack(n):
                    good.add(k)
    found = license_scan.Scanner(TEMPLATES).scan(text)
    assert {f[0] for f in found} <= good and bool(found) == bool(good)


def test_license_differences(spark):
    text = TEMPLATES["GPL-3.0-notice"].replace("work", "book")
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.license, r.missing_words, r.extra_words, r.differences) == ("GPL-3.0-notice", 1, 1, "-work +book")


def test_webp_query(spark, rows):
    got = {r.doc_id: r for r in queries.op5_lossless_webp(spark, DATA).collect()}
    for i, text in rows:
        payload = media.payload_of(text)
        g = got[i]
        assert (g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.integers(1, 40))
def test_webp_round_trip(data, reach):
    samples = bytes(b % reach for b in data) + b"\xff" * (-len(data) % 24)
    image = webp.encode(samples, 24)
    assert webp.decode(image)[..., 1].tobytes() == samples
    assert webp.decode_green([image] * 45)[44].tobytes() == samples


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40), st.integers(0, 6), st.integers(0, 255), st.integers(0, 2**32 - 1))
def test_webp_smooth_samples_are_predicted(rows, noise, start, seed):
    """A slow wave: its differences take fewer bits, so the stored row has the predictor."""
    rng = np.random.default_rng(seed)
    wave = (start + np.cumsum(rng.integers(-1, 2 + noise % 2, rows * 48))).astype(np.uint8).tobytes()
    image = webp.encode(wave, 48)
    assert webp.decode(image)[..., 1].tobytes() == wave and webp.decode_green([image, image])[1].tobytes() == wave
    if len(set(wave)) > 40:
        # the bits behind the header: a transform, and its type 0
        assert (image[20 + 5] & 0b111) == 0b001 and len(image) < 0.8 * len(wave) + 300


def _hand_made(pixels, width, height, prelude, cache_bits=0):
    """An image with uniform 8-bit codes, behind transforms that are written by prelude."""
    w = webp.Writer()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    prelude(w)
    w.put(0, 1)
    _plain_pixels(w, pixels, cache_bits, True)
    stream = b"\x2f" + w.bytes() + b"\0\0"
    stream += b"\0" * (len(stream) & 1)
    import struct

    return b"RIFF" + struct.pack("<I", 12 + len(stream)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream


def _plain_pixels(w, pixels, cache_bits=0, main=False):
    """Literals, and with a cache its index for every pixel that the cache holds."""
    w.put(1 | (cache_bits << 1), 5) if cache_bits else w.put(0, 1)
    if main:
        w.put(0, 1)
    green = np.zeros(280 + (1 << cache_bits if cache_bits else 0), np.int64)
    green[:256] = 9 if cache_bits else 8
    if cache_bits:
        green[280:] = 1 + cache_bits
    for lengths in (green, *[np.full(256, 8, np.int64)] * 3, np.zeros(40, np.int64)):
        webp.put_code(w, lengths)
    codes, byte = webp.codes(green), webp.codes(np.full(256, 8, np.int64))
    cache = {}
    for a, r, g, b in pixels:
        argb = (int(a) << 24) | (int(r) << 16) | (int(g) << 8) | int(b)
        slot = ((0x1E35A7BD * argb) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if cache_bits and cache.get(slot) == argb:
            w.put(int(codes[280 + slot]), 1 + cache_bits)
        else:
            w.put(int(codes[g]), int(green[g]))
            for v in (r, b, a):
                w.put(int(byte[v]), 8)
        cache[slot] = argb


@pytest.fixture(scope="module")
def picture():
    rng = np.random.default_rng(4)
    return rng.integers(0, 256, (6, 9, 4)) & 0xF0  # ARGB


def test_webp_colour_cache_and_subtract_green(picture):
    pixels = picture.reshape(-1, 4).repeat(2, axis=0)
    plain = webp.decode(_hand_made(pixels, 18, 6, lambda w: None, cache_bits=4))
    assert np.array_equal(plain[..., [3, 0, 1, 2]].reshape(-1, 4), pixels)
    shifted = pixels.copy()
    shifted[:, 1], shifted[:, 3] = (pixels[:, 1] - pixels[:, 2]) & 255, (pixels[:, 3] - pixels[:, 2]) & 255
    got = webp.decode(_hand_made(shifted, 18, 6, lambda w: w.put(1 | (2 << 1), 3)))
    assert np.array_equal(got[..., [3, 0, 1, 2]].reshape(-1, 4), pixels)


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors(picture, mode):
    """Differences to predictions made pixel by pixel here must decode to the picture."""
    height, width, _ = picture.shape
    half = lambda a, b: (a + b) // 2
    out = np.zeros_like(picture)
    for y in range(height):
        for x in range(width):
            if y == 0 and x == 0:
                p = np.array([255, 0, 0, 0])
            elif y == 0:
                p = picture[0, x - 1]
            elif x == 0:
                p = picture[y - 1, 0]
            else:
                left, top, corner = picture[y, x - 1], picture[y - 1, x], picture[y - 1, x - 1]
                right = picture[y - 1, x + 1] if x + 1 < width else picture[y, 0]
                closer = np.abs(top - corner).sum() < np.abs(left - corner).sum()
                mean = half(left, top)
                p = [
                    np.array([255, 0, 0, 0]), left, top, right, corner, half(half(left, right), top), half(left, corner), half(left, top), half(top, corner),
                    half(top, right), half(half(left, corner), half(top, right)), left if closer else top, np.clip(left + top - corner, 0, 255),
                    np.clip(mean + np.trunc((mean - corner) / 2).astype(int), 0, 255),
                ][mode]
            out[y, x] = (picture[y, x] - p) & 255

    def prelude(w):
        w.put(1 | (0 << 1) | (0 << 3), 6)
        _plain_pixels(w, [(255, 0, mode, 0)] * (((height + 3) // 4) * ((width + 3) // 4)))

    got = webp.decode(_hand_made(out.reshape(-1, 4), width, height, prelude))
    assert np.array_equal(got[..., [3, 0, 1, 2]], picture)


def test_webp_cross_colour(picture):
    height, width, _ = picture.shape
    signed = lambda v: (v ^ 128) - 128
    to_blue_red, to_blue, to_red = 37, 200, 91
    out = picture.copy()
    green, red = signed(picture[..., 2]), signed(picture[..., 1])
    out[..., 1] = (picture[..., 1] - ((signed(to_red) * green) >> 5)) & 255
    out[..., 3] = (picture[..., 3] - ((signed(to_blue) * green) >> 5) - ((signed(to_blue_red) * red) >> 5)) & 255

    def prelude(w):
        w.put(1 | (1 << 1) | (0 << 3), 6)
        _plain_pixels(w, [(255, to_blue_red, to_blue, to_red)] * (((height + 3) // 4) * ((width + 3) // 4)))

    got = webp.decode(_hand_made(out.reshape(-1, 4), width, height, prelude))
    assert np.array_equal(got[..., [3, 0, 1, 2]], picture)


def test_webp_rows_never_end_the_job(spark, monkeypatch):
    good = webp.encode(media.payload_of("some text"), media.ROW)
    rows = [(1, 9, bytearray(good), "ok"), (2, 9, bytearray(good[:40]), "ok"), (3, 9, None, "not stored: too long"), (4, 9, bytearray(b"nonsense" * 9), "ok")]
    stored = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary, status string")
    got = {r.doc_id: r for r in media.digest(stored).collect()}
    assert got[1].status == "ok" and got[1].payload_bytes == 576 and got[2].status.startswith("broken") and got[4].payload_sha256 is None and got[3].status.startswith("not")
    read = {r.doc_id: r for r in media.read(stored).collect()}
    assert bytes(read[1].samples) == media.payload_of("some text") and read[2].samples is None
    # feature and media_sha256 by hand
    image = media.store(spark.createDataFrame([(1, "some text")], "doc_id long, text string")).first()
    payload = media.payload_of("some text")
    g = media.digest(media.store(spark.createDataFrame([(1, "some text")], "doc_id long, text string"))).first()
    mean = sum(payload) // len(payload)
    parts = [payload[k * 576 // 64 : (k + 1) * 576 // 64] for k in range(64)]
    bits = "".join("1" if sum(p) * 576 > sum(payload) * len(p) else "0" for p in parts)
    variance = (576 * sum(b * b for b in payload) - sum(payload) ** 2) // 576**2
    assert g.feature == f"{mean}:{variance}:{int(bits, 2):016x}" and g.media_sha256 == hashlib.sha256(image.media).hexdigest()


def test_webp_edges(edge, empty):
    got = {r.doc_id: r for r in media.digest(media.store(edge)).collect()}
    assert got[1].payload_bytes == got[2].payload_bytes == 576 and got[1].media_sha256 == got[2].media_sha256
    assert media.digest(media.store(empty)).count() == 0
    with pytest.raises(webp.WebPError):
        webp.decode(b"RIFF nonsense that is long enough")


def lines_by_brute_force(rows):
    seen, gone = set(), {}
    for i, text in sorted(rows):
        lines = [(k, x.strip(SPACE)) for k, x in enumerate(text.split("\n"))]
        lines = [(k, x) for k, x in lines if x]
        cut = set()
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(words(lines[b][1]))
                if n >= 50:
                    key = tuple(x for _, x in lines[a : b + 1])
                    if key in seen:
                        cut |= set(range(lines[a][0], lines[b][0] + 1))
                    else:
                        seen.add(key)
                    if n >= 300:
                        break
        gone[i] = cut
    return gone


def test_lines_equal_brute_force(spark, rows):
    gone = lines_by_brute_force(rows)
    got = {r.doc_id: r for r in queries.op6_line_dedup(spark, DATA).collect()}
    for i, text in rows:
        assert {k for s in got[i].spans for k in range(s.a, s.b + 1)} == gone[i]
        assert got[i].text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[i])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=25), st.integers(1, 20))
def test_windows_are_shortest(sizes, least):
    got = set(line_dedup.windows(sizes, least))
    expected = set()
    for i in range(len(sizes)):
        expected |= {(i, j) for j in range(i, len(sizes)) if sum(sizes[i : j + 1]) >= least and sum(sizes[i:j]) < least}
        expected |= {(j, i) for j in range(i + 1) if sum(sizes[j : i + 1]) >= least and sum(sizes[j + 1 : i + 1]) < least}
    assert got == expected


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 9)), min_size=1, max_size=40), st.integers(1, 25))
def test_winnowing_selects_for_every_window(lines, least):
    """Each window's least line is selected, once for all windows that share it, and windows are found again around it."""
    import pyarrow as pa

    hashes, sizes = [h for h, _ in lines], [w for _, w in lines]
    found = line_dedup.winnow(hashes, sizes, least)
    assert len(found) <= len(lines)
    rows = []
    for at, (a, b) in found.items():
        around = b"".join(struct.pack(line_dedup.LINE, hashes[i], sizes[i], i) for i in range(a, b + 1))
        rows.append((1, 2, at - a, around))
    names = ["id", "th", "at", "around"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows]) if rows else None
    got = [(r["a"], r["b"]) for out in line_dedup._extend(least)(iter([batch])) for r in out.to_pylist()] if batch else []
    assert sorted(got) == line_dedup.windows(sizes, least)


def test_winnowing_thins(rows):
    n_lines = n_selected = 0
    for _, text in rows:
        hashes, sizes, _ = line_dedup.lines_of(text)
        n_lines += len(hashes)
        n_selected += len(line_dedup.winnow(hashes, sizes, 50))
    assert n_selected < 0.7 * n_lines


def test_lines_hot_runs_and_any_names(spark):
    """A run that very many documents share, and columns with the names that are used inside."""
    run = "\n".join(f"line {k} of the shared part has some words in it" for k in range(7))
    docs = spark.range(3_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("own "), F.col("id"), F.lit("\n" + run + "\nend "), F.col("id")).alias("text"),
        *[F.lit(i).alias(c) for i, c in enumerate(("_id", "_th", "_spans", "_lines", "_removed", "id", "th", "row", "own_id", "spans", "n"))],
    )
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "__lines", "__removed", "__spans"]
    assert got.filter("__removed = 7 and _removed = 4 and th = 6").count() == 2_999
    assert got.filter("__removed = 0").select("doc_id").collect()[0][0] == 0
    kept = similarity_join.keep_one(docs.filter("doc_id < 3"))
    assert kept.columns == docs.columns and kept.count() >= 1


def test_lines_edges(edge, empty):
    got = line_dedup.dedup_lines(edge)
    assert got.count() == len(EDGE) and got.columns[:7] == edge.columns
    assert line_dedup.dedup_lines(empty).count() == 0


def test_mix_targets_and_caps(spark, docs):
    got = queries.op7_source_mixing(spark, "/root/testdata/sf0.01").collect()
    source = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[source[r.doc_id]] += r.taken
        size[source[r.doc_id]] += r.size
        target[source[r.doc_id]] = r.target
    assert math.isclose(sum(target.values()), sum(size.values()))
    for s, t in target.items():
        assert t <= 3 * size[s] + 1e-6 and abs(taken[s] - t) <= 0.05 * t
    assert sorted(got) == sorted(queries.op7_source_mixing(spark, "/root/testdata/sf0.01").collect())


def test_mix_targets_by_hand(spark):
    rows = [("a", 1, 1), ("b", 100, 2), ("c", 100, 3)]
    got = mixing.targets(spark.createDataFrame(rows, "source string, size long, weight long")).collect()
    assert {r.source: round(r.goal, 9) for r in got} == {"a": 3.0, "b": 79.2, "c": 118.8}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.booleans(), st.integers(0, 4)), min_size=1, max_size=3), st.lists(st.integers(0, 7), min_size=2, max_size=2))
def test_flow_equals_every_flow_tried(raw, quota):
    """Most words, then least cost, over all whole-numbered flows of small networks."""
    patterns = {}
    for s, both, n in raw:
        patterns[("a", "b") if both else (("a",), ("b",), ("a", "b"))[s]] = n
    quotas = dict(zip("ab", quota))
    names = sorted(patterns)
    best = None

    def go(i, need, cost, sent):
        nonlocal best
        if i == len(names):
            if best is None or (-sent, cost) < best:
                best = (-sent, cost)
            return
        n = patterns[names[i]]
        for x in range(min(need["a"], 3 * n) + 1 if "a" in names[i] else 1):
            for y in range(min(need["b"], 3 * n - x) + 1 if "b" in names[i] else 1):
                go(i + 1, {"a": need["a"] - x, "b": need["b"] - y}, cost + max(0, x + y - n) + max(0, x + y - 2 * n), sent + x + y)

    go(0, quotas, 0, 0)
    flow = mixing.route(patterns, quotas)
    by_pattern, by_source = Counter(), Counter()
    for (p, s), v in flow.items():
        assert s in p and v > 0
        by_pattern[p] += v
        by_source[s] += v
    assert all(v <= quotas[s] for s, v in by_source.items()) and all(v <= 3 * patterns[p] for p, v in by_pattern.items())
    cost = sum(max(0, v - patterns[p]) + max(0, v - 2 * patterns[p]) for p, v in by_pattern.items())
    assert (-sum(by_pattern.values()), cost) == best


def test_mix_rows_that_repeat(spark):
    """Rows of one id and size, over several tasks: within a document of each target, either way."""
    rows = [(7, "w " * 10, s) for s in ("a", "b", "c") for _ in range(100)] + [(8, "w " * 3, "b")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix(docs.withColumn("n", F.lit(1)))
    taken = Counter()
    rows_out = mixing.mix(docs, repeat_rows=True).collect()
    for r in rows_out:
        taken[r.source] += len(words(r.text))
    total = 3015
    for s, w in zip("abc", (1, 2, 3)):
        assert abs(taken[s] - total * w / 6) <= 10, (s, taken)
    assert got.agg(F.sum("taken")).first()[0] == sum(taken.values())
    again = mixing.mix(docs.repartition(3), repeat_rows=True).collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r) for r in rows_out)


def test_mix_many_sources_and_overlap(spark):
    """More sources than a broadcast takes, and overlapping ones, give what the plain rules give."""
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 9), [f"s{j}" for j in sorted(rng.sample(range(40), rng.choice((1, 1, 2))))]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got = {r.doc_id: r for r in mixing.mix(docs, members=F.col("sources")).collect()}
    assert len(got) == 900 and all(r.taken <= 3 * r.size for r in got.values())
    total = sum(r.size for r in got.values())
    assert abs(sum(r.taken for r in got.values()) - total) <= 0.1 * total
    before = mixing.MAX_BROADCAST
    try:
        mixing.MAX_BROADCAST = 3
        assert {r.doc_id: r for r in mixing.mix(docs, members=F.col("sources")).collect()} == got
    finally:
        mixing.MAX_BROADCAST = before


def test_flow_repeats_as_little_as_it_can():
    flow = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 10, "b": 10})
    assert sum(v for (p, s), v in flow.items() if s == "a") == 10 and sum(v for (p, s), v in flow.items() if s == "b") == 10
    by_pattern = Counter()
    for (p, _), v in flow.items():
        by_pattern[p] += v
    assert all(v <= n for (p, v), n in zip(sorted(by_pattern.items()), [10, 10, 2]))  # nothing twice
    again = mixing.route({("a",): 1, ("a", "b"): 4}, {"a": 5, "b": 6})
    assert sum(again.values()) == 11


def test_mix_overlap_and_edges(spark, edge, empty):
    members = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 7).alias("text"))
    got = mixing.mix(docs, members=members).collect()
    assert sum(r.taken for r in got) == pytest.approx(2800, rel=0.02)
    assert {r.doc_id: r.taken for r in mixing.mix(edge).collect()}[1] == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(edge, repeat_rows=True).columns == edge.columns


def cheapest(roles):
    """Exhaustive: choices of each turn, by recursion over states."""
    best = None

    def go(i, state, cost):
        nonlocal best
        if best is not None and cost >= best:
            return
        if i == len(roles):
            best = cost
            return
        for a, b, c, _ in role_repair._STEPS[roles[i]]:
            if a == state:
                go(i + 1, b, cost + c)

    go(0, role_repair.START, 0)
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([None, 1, 2, 3]), min_size=1, max_size=6))
def test_repair_is_cheapest_and_splits(roles):
    path, (cost, turns) = role_repair.repair(roles)
    assert cost == cheapest(roles)
    state, out = 0, []
    for s, (inserted, action) in path:
        out += [*inserted] + ([s] if action != "merge" else [])
    for r in out:
        assert r in role_repair.NEXT[state]
        state = r
    assert len(out) == turns
    cut = len(roles) // 2
    flat = lambda m: [v for line in m for cell in line for v in cell]
    stretches = [(0, 9, cut, flat(role_repair.summary(roles[:cut]))), (1, 9, len(roles) - cut, flat(role_repair.summary(roles[cut:])))]
    known = role_repair.chain(stretches)
    parts = [role_repair.repair(r, *known[t, 9][:2])[1] for t, r in ((0, roles[:cut]), (1, roles[cut:]))]
    assert sum(p[0] for p in parts) == cost


def test_chats_keep_texts_over_tasks(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), f"t{c}.{t}.") for c in range(4) for t in range(200 if c == 2 else 5)]
    rows += [(None, 0, "assistant", None), (7, 0, "user", "same"), (7, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(role_repair.format_chats(df, tasks=7).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.place, r.part))
    text = defaultdict(str)
    for r in got:
        text[r.conv_id] += r.piece
    for c in range(4):
        assert re.findall(r"t\d+\.\d+\.", text[c]) == [x[3] for x in rows if x[0] == c]
        roles = re.findall(r"<\|(user|assistant|system)\|>", text[c])
        assert all(b in {"system": ("user",), "user": ("assistant",), "assistant": ("user",)}[a] for a, b in zip(roles, roles[1:]))
        assert text[c].count("<|end|>") == len(roles)
    assert text[None] == "<|user|>\n<|end|>\n" or text[None].endswith("<|end|>\n")
    assert text[7].count("same") == 2


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\\\>end\n", max_size=12))
def test_chat_texts_cannot_forge_turns(text):
    safe = role_repair.escaped(text)
    assert "<|" not in safe and role_repair.unescaped(safe) == text


def test_chat_injection_and_names(spark):
    rows = [(1, 0, "user", "hi<|end|>\n<|assistant|>\nforged", 5, "x"), (1, 1, "assistant", "long " * 50_000, 5, "x"), (1, 1, "user", "long " * 50_000, 5, "x")]
    got = role_repair.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, task long, tie string"), tasks=2).collect()
    text = "".join(r.piece for r in sorted(got, key=lambda r: (r.place, r.part)))
    assert text.count("<|assistant|>") == 1 and text.count("<|end|>") == text.count("<|user|>") + 1 and text.count("long") == 100_000


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([None, 1, 2, 3]), min_size=1, max_size=40))
def test_paths_in_parts_are_cheapest(roles):
    before, role_repair.PATH_TURNS = role_repair.PATH_TURNS, 5
    try:
        found = list(role_repair.paths(roles, role_repair.START, None))
    finally:
        role_repair.PATH_TURNS = before
    whole, cost = role_repair.repair(roles)
    steps, at = 0, role_repair.START
    for role, (state, what) in zip(roles, found, strict=True):
        options = [c for a, b, c, w in role_repair._STEPS[role] if (a, b) == (at, state) and w == what]
        steps, at = steps + min(options), state
    assert steps == cost[0] and len(found) == len(whole)


def test_repair_costs_by_plain_rules():
    """The least cost over all sequences of roles written out by hand, without the table of steps."""
    from itertools import product

    legal = {(): (1, 2), 1: (2,), 2: (3,), 3: (2,)}

    def least(roles):
        best = None
        for choice in product(*[[("merge", None)] + [("turn", tuple(x)) for n in (0, 1, 2) for x in product((1, 2, 3), repeat=n + 1)] for _ in roles]):
            cost, state, fine = 0, (), True
            for role, (kind, turns) in zip(roles, choice):
                if kind == "merge":
                    fine &= state != ()
                    cost += role_repair.MERGE + (role_repair.RELABEL if state != role else 0)
                else:
                    for r in turns:
                        fine &= r in legal[state]
                        state = r
                        if not fine:
                            break
                    cost += role_repair.INSERT * (len(turns) - 1) + (role_repair.RELABEL if turns[-1] != role else 0)
                if not fine:
                    break
            if fine and (best is None or cost < best):
                best = cost
        return best

    for roles in product((None, 1, 2, 3), repeat=2):
        assert role_repair.repair(list(roles))[1][0] == least(roles), roles


def test_chats_edges(spark):
    assert role_repair.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert queries.op8_chat_role_repair(spark, DATA).count() > 0


def links_by_brute_force(rows, n=5):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    links, parent = Counter(), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (find(i), links[i]) for i in sets}


def _graph(kind: str) -> list[tuple[int, int]]:
    rng = random.Random(4)
    if kind == "random":  # some large components, many small ones, loops and repeated edges
        return [(rng.randrange(-900, 900), rng.randrange(-900, 900)) for _ in range(900)] + [(5, 5), (7, 8), (8, 7), (5000, 5000)]
    if kind == "chain":
        order = rng.sample(range(3000), 3000)
        return list(zip(order, order[1:], strict=False))
    return [(-(1 << 63), n) for n in range(1, 500)] + [((1 << 63) - 1, 1000)]


def _plain_components(edges: list[tuple[int, int]]) -> dict[int, int]:
    parts: dict[int, set[int]] = {}
    for u, v in edges:
        if u != v:
            both = parts.get(u, {u}) | parts.get(v, {v})
            parts |= dict.fromkeys(both, both)
    return {n: min(part) for n, part in parts.items()}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components_equal_plain_ones(spark, kind):
    edges = spark.createDataFrame(_graph(kind), "u long, v long").repartition(7)
    want = _plain_components(_graph(kind))
    spark.sparkContext.setJobGroup(f"components-{kind}", "")
    found = [(r["node"], r["label"]) for r in components.components(edges).collect()]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{kind}")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == len(want) and dict(found) == want
    assert len(jobs) <= 8  # not a few for each round: the driver keeps something of each

@pytest.mark.parametrize("kind", ["random", "star"])
def test_components_by_rounds_equal_plain_ones(spark, monkeypatch, kind):
    monkeypatch.setattr(components, "ALONE", 0)
    edges = _graph(kind)[-40:]
    found = [(r["node"], r["label"]) for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()]
    want = _plain_components(edges)
    assert len(found) == len(want) and dict(found) == want


@pytest.mark.parametrize("held", [1, 50, 5000])
def test_forests_hold_few_edges_and_keep_components(monkeypatch, held):
    monkeypatch.setattr(components, "HELD", held)
    edges = _graph("random") + _graph("chain")
    edges = [(u, v) for u, v in edges if u != v]
    batches = [pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in edges[a : a + 40]]) for a in range(0, len(edges), 40)]
    forest = [(r["u"], r["v"]) for batch in components._forest(iter(batches)) for r in batch.to_pylist()]
    assert _plain_components(forest) == _plain_components(edges)
    assert held < 5000 or len(forest) < len(_plain_components(edges))


def test_long_chains_take_few_rounds(spark):
    edges = _graph("chain")[:600]
    spark.sparkContext.setJobGroup("rounds", "")
    found = {r["node"]: r["label"] for r in components._by_rounds(spark.createDataFrame(edges, "u long, v long"), 4).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == _plain_components(edges)
    assert len(jobs) <= 250  # a round for every third node would take many more


@pytest.mark.parametrize("alone", [0, 1 << 20])
def test_components_of_no_edges(spark, monkeypatch, alone):
    monkeypatch.setattr(components, "ALONE", alone)
    assert components.components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def test_join_equals_brute_force(spark, rows):
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op9_ngram_jaccard_join(spark, DATA).collect()}
    assert got == links_by_brute_force(rows)


def test_join_in_blocks_equals_brute_force(spark):
    """A large group of near copies, dealt as pairs of small blocks."""
    rng = random.Random(5)
    core = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        own = list(core)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(120)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in similarity_join.jaccard_classes(df, block_size=8).collect()}
    assert got == links_by_brute_force(rows)


def test_join_bands_reach_the_recall():
    bands, rows = similarity_join.choose_bands(0.8, 0.999, 160)
    assert (bands, rows) == (23, 6) and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_join_edges(edge, empty):
    got = {r.doc_id: r for r in similarity_join.jaccard_classes(edge).collect()}
    assert got[1].n_links == got[2].n_links == got[6].n_links == 0 and got[3].n_links == 1
    assert similarity_join.jaccard_classes(empty).count() == 0
    assert similarity_join.keep_one(edge).columns == edge.columns


def test_keep_one_counts_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " end"
    rows = [
        *[(1, text)] * 5, (2, near),  # one class, its least id repeated
        *[(None, "no id " + near[::-1])] * 3,  # null ids, one text
        (7, "other " + text.upper()), (7, "other " + text.upper() + " END"),  # one id, near copies
        (8, "first of two texts under an id"), (8, "quite another text with the same number"),  # two classes
        *[(9, "")] * 2, (10, ""), (11, None),  # in no class
    ]
    kept = similarity_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in kept) == {1: 1, None: 1, 7: 1, 8: 2, 9: 1, 10: 1, 11: 1}


def test_pipeline_edges(spark, edge, empty):
    """Every stage on nulls, empty texts, repeated rows, a very long text, other columns; and on no rows."""
    import corpus_pipeline

    long = "\n".join(f"a line {k} with some more words of its own in it" for k in range(5_000))
    rows = [(1, None, None, "a", None), (2, "", "en", None, 0), (3, long, "en", "a", 1), (3, long, "en", "a", 1), (None, long + " end", "en", "b", 1), (4, "few words", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_id", F.lit(1)).withColumn("n", F.lit(1)).withColumn("row", F.lit("x"))
    for table in (docs, edge, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, DATA)
            n = out.count()
            assert n == 0 if table is empty else n >= 0, name
            if name != "best_fit_packing":
                assert out.columns == corpus_pipeline.COLUMNS, name
    kept = corpus_pipeline.STAGES[2][1](spark, docs.select(*corpus_pipeline.COLUMNS), DATA).collect()
    assert Counter(r.doc_id for r in kept)[3] + Counter(r.doc_id for r in kept)[None] == 1


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, DATA).cache()
        assert out.columns == corpus_pipeline.COLUMNS, name
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules.assess(at).filter("kept").collect()}
            assert {r.doc_id for r in out.collect()} == kept
        if name == "line_dedup":
            before = {r.doc_id: r.text for r in at.collect()}
            gone = lines_by_brute_force(list(before.items()))
            plain = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in before.items()}
            assert {r.doc_id: r.text for r in out.collect()} == {i: t for i, t in plain.items() if not gone[i] or words(t)}
            assert all(r.n_chars == len(r.text) for r in out.collect() if gone[r.doc_id])
        if name == "source_mixing":
            whole, taken, most = Counter(), Counter(), 0
            for r in at.collect():
                whole[r.source] += len(words(r.text))
                most = max(most, len(words(r.text)))
            for r in out.collect():
                taken[r.source] += len(words(r.text))
            assert max(Counter(r.doc_id for r in out.collect()).values()) <= 3
            names = sorted(whole, key=lambda s: (s is None, s))
            weight = {s: k % 3 + 1 for k, s in enumerate(names)}
            goal, total = {}, sum(whole.values())
            while True:  # shares of the rest, and what is above three times a source is set
                left = [s for s in names if s not in goal]
                share = {s: (total - sum(goal.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
                above = {s: 3 * whole[s] for s in left if share[s] > 3 * whole[s]}
                if not above:
                    break
                goal |= above
            assert all(abs(taken[s] - (goal | share)[s]) <= most for s in names)
        if name == "ngram_jaccard_join":
            expected = {i for i, (c, _) in links_by_brute_force([(r.doc_id, r.text) for r in at.collect()]).items() if c == i}
            assert {r.doc_id for r in out.collect()} == expected
        at = out
    ids = Counter(r.doc_id for r in at.collect())
    got = corpus_pipeline.STAGES[-1][1](spark, at, DATA).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == ids
    in_bin, n_ids = defaultdict(list), Counter()
    for r in got:
        in_bin[r.sequence_id].append((r.offset, r.length))
        n_ids[r.doc_id] += r.length
    for places in in_bin.values():
        at_ = 0
        for offset, length in sorted(places):
            assert offset == at_
            at_ += length
        assert at_ <= 2048
    from structex.llm.tokens import encoder

    for r in at.dropDuplicates(["doc_id"]).collect():
        assert n_ids[r.doc_id] == ids[r.doc_id] * (len(encoder().packed(r.text)) // 4 + 1)
