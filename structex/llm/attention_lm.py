"""Language-model scores of texts: causal self-attention over subword ids, in numpy.

A text is lower-cased (A-Z) and read as its words and one end. Its words, joined by spaces, become
ids of the public byte-level BPE, closed by an end id; the score is the log10 probability of this
sequence under the attention model alone. The texts are read twice: once to count words, once to
become ids, which are kept as 16-bit numbers for all that follows.

The model is one layer of causal self-attention with learned distances, whose keys carry the id
before as well as the id itself, so that a place can attend to what followed the same id earlier.
Its output layer covers the KNOWN - 1 most frequent ids one by one, as classes and members of
classes, and all others as one entry, inside which ids have their corpus frequency. The output
bias of a place is looked up by the last id and, with learned gates, by the one before it, in
tables counted over all training rows. A third table counts which entries occur FAR places apart;
its principal parts are what embeddings, values and outputs begin with, so that attention over a
window tells from the start what kind of text it is in.

Attention, embeddings, gates and outputs are trained by Adam, once over every window of every
training row, however many there are. The windows are dealt evenly into parts, each part trains a
copy over its windows of a round, and the copies' mean, summed up in a tree of tasks, starts the
next round. So no task or driver holds more than a part or a few models.

Overlapping windows of context + stride ids are scored with batched masked attention: each window
scores its last stride ids only (a text's first window: all), so each id is scored once and sees
at least context ids before it, where there are so many.

base_score is the add-one unigram over words and the end. Word counts are gathered over all
training rows by 64-bit word hash. Counts of the most frequent words (at most max_words) go to
every task; the other words of each document are joined with the full table of counts.

Defined cases: a null text is an empty text: one end; a null id is trained on; repeated rows are
trained on and scored each on its own; an empty table gives no rows; without training rows all
ids are equally likely; other columns are ignored.
"""

from __future__ import annotations

import array
import copy
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structex.llm.common import durable, in_parts
from structex.llm.ngrams import mix, slices, word_hashes, word_places

N_IDS, END = 50_257, 50_256
#: Hash that stands for the end among words.
END_HASH = 1
#: Entries of the tables (the last one: all rarer ids), their classes, and members of a class.
KNOWN, CLASSES = 1024, 32
MEMBERS = KNOWN // CLASSES
DIM, KEY = 16, 8
CONTEXT, STRIDE = 24, 40
LENGTH = CONTEXT + STRIDE
MAX_WORDS = 1 << 20
#: Words whose ids a worker remembers (about 200 bytes each), and words encoded at once.
MAX_UNITS, ROW_WORDS = 300_000, 1_000
#: Of a training row's windows one of SHARE is trained on (1: all); windows of a part.
SHARE, PART_WINDOWS, ROUNDS, RATE, BATCH = 1, 8_192, 2, 0.02, 32
#: Models that a task of the tree, or the driver, adds up (more in a task whose parts meet by their hash).
LEVEL = 64
#: Sums of powers whose exponents are smaller than this are exact without their greatest being taken off.
LARGE = 60
#: Distances whose counts the third table adds up.
FAR = (3, 6, 12, 24)
#: Bytes of texts and numbers of ids that are handled at once.
TEXT_BYTES, MANY_IDS = 1 << 21, 1 << 18
#: What stands before a text's ids, as they are kept.
_HEAD = np.array([END, END], "<u2").tobytes()
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def _without_spaces(word: bytes) -> bool:
    """Whether a word has no white space of Unicode and no lone surrogate."""
    try:
        text = word.decode()
    except UnicodeDecodeError:
        return False
    return text.split() == [text]


class Units(dict):
    """Ids of a word behind a space, as 16-bit numbers."""

    def __init__(self, most: int = MAX_UNITS):
        super().__init__()
        from structex.llm.tokens import encoder

        self.encode, self.most = encoder().encode, most
        #: Ids that begin with a space: of an encoded row of words, the first of each word.
        self.begins = np.array([t[:1] == b" " for t in encoder().strings()])

    def __missing__(self, word: bytes) -> bytes:
        ids = array.array("H", self.encode(" " + word.decode("utf-8", "surrogatepass"))).tobytes()
        if len(self) < self.most and len(word) <= 48:
            self[word] = ids
        return ids

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; short words that aren't remembered are encoded as rows of words.

        Where single spaces between words are the only white space, a piece that the encoder cuts
        holds a space only as its first character, so a row has the ids of its words one by one.
        """
        found = [*map(self.get, words)]
        new = [i for i, ids in enumerate(found) if ids is None]
        plain = [i for i in new if len(words[i]) <= 48 and (words[i].isascii() or _without_spaces(words[i]))]
        for a in range(0, len(plain), ROW_WORDS):
            row = plain[a : a + ROW_WORDS]
            ids = np.array(self.encode(" " + b" ".join([words[i] for i in row]).decode()), np.uint16)
            data, cuts = ids.tobytes(), (2 * np.flatnonzero(self.begins[ids])).tolist()
            for i, p, q in zip(row, cuts, [*cuts[1:], len(data)], strict=True):
                found[i] = data[p:q]
        for i in plain[: max(0, self.most - len(self))]:
            self[words[i]] = found[i]
        for i in new:
            if found[i] is None:
                found[i] = self[words[i]]
        return found


def ids_of(texts: list[bytes], units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ids of the texts in a row, each text's number of ids, word hashes and numbers of words."""
    x, numbers, different, back, n_words = ids_and_words(texts, units)
    return x, numbers, different[back], n_words


def ids_and_words(texts: list[bytes], units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids_of with hashes of the different words, in order, and each word's place among them.

    Each different word is encoded once; the ids of its other places are copied.
    """
    hashes, n_words, starts, ends = word_places(texts)
    joined = b"".join(texts)
    different, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    packed = units.of([joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) >> 1
    all_ids = np.frombuffer(b"".join(packed), np.uint16)
    n = sizes[back]
    upto = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat((np.cumsum(sizes) - sizes)[back] - upto[:-1], n) + np.arange(upto[-1])
    bounds = np.concatenate(([0], np.cumsum(n_words)))
    by_text = np.diff(upto[bounds])
    out = np.full(len(at) + len(texts), END, np.uint16)
    out[np.arange(len(at)) + np.repeat(np.arange(len(texts)), by_text)] = all_ids[at]
    return out, by_text + 1, different, back, n_words


def before(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids one and two before each, END before a text's beginning."""
    first = np.cumsum(numbers) - numbers
    one, two = np.full(len(x), END, x.dtype), np.full(len(x), END, x.dtype)
    one[1:], two[2:] = x[:-1], x[:-2]
    one[first] = END
    two[first] = END
    second = first + 1
    two[second[second < len(x)]] = END
    return one, two


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): counts of a batch's words and ends."""
    for batch in batches:
        texts = [normal(t) for t in batch.column(0).to_pylist()]
        for a, b in slices(texts, 1 << 24):
            found = [word_hashes(texts[a + c : a + d])[0] for c, d in slices(texts[a:b])]
            keys, n = np.unique(np.concatenate([*found, np.full(b - a, END_HASH, np.uint64)]).view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], names=["key", "n"])


READ_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare array<long>, ids binary"


def _read(words: np.ndarray, counts: np.ndarray, n_train: int, v: int):
    """Texts to ids, and to everything of base_score but what rare words and the end add."""
    log_all = np.log10(n_train + v + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, units = np.log10(counts + 1.0), Units()
        for batch in in_parts(batches):
            texts = [normal(t) for t in batch.column(2).to_pylist()]
            for a, b in slices(texts, TEXT_BYTES):
                x, numbers, different, back, n_words = ids_and_words(texts[a:b], units)
                owner = np.repeat(np.arange(b - a), n_words)
                at = np.minimum(np.searchsorted(words, different), max(0, len(words) - 1))
                known = words[at] == different if len(words) else np.zeros(len(different), bool)
                log = np.where(known, logs[at], 0.0) if len(words) else np.zeros(len(different))
                found, base = known[back], np.bincount(owner, log[back], b - a)
                rare = np.bincount(owner[~found], minlength=b - a)
                data, ends = x.astype("<u2").tobytes(), np.cumsum(numbers) * 2
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(n_words + 1),
                        pa.array(np.bincount(owner[found], minlength=b - a)),
                        pa.array(base - (n_words + 1) * log_all),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate(([0], np.cumsum(rare))).astype(np.int32)), pa.array(different[back[~found]].view(np.int64))
                        ),
                        pa.array([data[p:q] for p, q in zip((ends - numbers * 2).tolist(), ends.tolist(), strict=True)], pa.binary()),
                    ],
                    names=[f.split()[0] for f in READ_SCHEMA.split(", ")],
                )

    return run


def _id_slices(column: pa.Array, many: int = MANY_IDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows of about so many ids together, with their ids in a row and by row."""
    values = column.to_pylist()
    for a, b in slices(values, 2 * many):
        numbers = np.fromiter(map(len, values[a:b]), np.int64, b - a) >> 1
        yield a, b, np.frombuffer(b"".join(values[a:b]), "<u2"), numbers


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(N_IDS, np.int64)
    for batch in batches:
        for _, _, x, _ in _id_slices(batch.column(0)):
            total += np.bincount(x, minlength=N_IDS)
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])


CELLS_SCHEMA = "line int, ids binary, n binary"


def _lines(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The lines of a table of counts that have any, as their places and counts."""
    lines = np.flatnonzero(table.any(axis=1))
    for a in range(0, len(lines), 256):
        part = lines[a : a + 256]
        places = [np.flatnonzero(table[i]) for i in part]
        columns = [
            pa.array(part, pa.int32()),
            pa.array([p.astype("<u2").tobytes() for p in places], pa.binary()),
            pa.array([table[i][p].astype("<i8").tobytes() for i, p in zip(part, places, strict=True)], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["line", "ids", "n"])


def count_pairs(goal: np.ndarray, one: np.ndarray, two: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(table, cell of the table) for each pair of entries that a table counts."""
    yield 0, one * KNOWN + goal
    yield 1, two * KNOWN + goal
    place = np.arange(len(goal)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
    for distance in FAR:
        yield 2, (goal[:-distance] * KNOWN + goal[distance:])[place[distance:] >= distance]


def _count_pairs(known: np.ndarray):
    """Counts of (id before, id) and, KNOWN lines further, of (id two before, id), then of far ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((3, KNOWN * KNOWN), np.int32)  # a task has fewer ids than such a number counts
        for batch in batches:
            for _, _, x, numbers in _id_slices(batch.column(0), 4 * MANY_IDS):
                one, two = before(x, numbers)
                for k, cells in count_pairs(known[x], known[one], known[two], numbers):
                    tables[k] += np.bincount(cells, minlength=KNOWN * KNOWN).astype(np.int32)
        yield from _lines(tables.reshape(-1, KNOWN))

    return run


def _sum_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal lines of a task added up."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for line, ids, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = total.setdefault(line, np.zeros(KNOWN, np.int64))
            own[np.frombuffer(ids, "<u2")] += np.frombuffer(n, "<i8")
    order = sorted(total)
    for i in order:
        places = np.flatnonzero(total[i])
        columns = [[i], [places.astype("<u2").tobytes()], [total[i][places].astype("<i8").tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["line", "ids", "n"])


def known_of(unigrams: np.ndarray) -> np.ndarray:
    """The entry of each id."""
    known = np.full(N_IDS, KNOWN - 1)
    known[np.argsort(-unigrams, kind="stable")[: KNOWN - 1]] = np.arange(KNOWN - 1)
    return known


class Attention:
    """One causal self-attention layer with counted output biases, and its gradient."""

    def __init__(self, pairs: np.ndarray, unigrams: np.ndarray, seed: int = 5):
        """pairs: counts by (table, entry before, entry)."""
        self.known = known_of(unigrams)
        p1 = (unigrams + 1.0) / (unigrams.sum() + N_IDS)
        rare = self.known == KNOWN - 1
        #: log probability of an id inside its entry
        self.within = np.where(rare, np.log(p1 / p1[rare].sum()), 0.0)
        p = np.bincount(self.known, p1, KNOWN).reshape(CLASSES, MEMBERS).astype(np.float32)
        of_class = p.sum(axis=1)
        of_member = p / of_class[:, None]
        tables = []
        for n in pairs[:2].reshape(2, KNOWN, CLASSES, MEMBERS):
            n = n.astype(np.float32)
            c = n.sum(axis=2)
            kinds = (c > 0).sum(axis=1, keepdims=True) + 1
            a = np.log((c + kinds * of_class) / (c.sum(axis=1, keepdims=True) + kinds))
            kinds = (n > 0).sum(axis=2, keepdims=True) + 1
            b = np.log((n + kinds * of_member) / (c[:, :, None] + kinds))
            tables += [a.astype(np.float32), b.astype(np.float32).reshape(-1, MEMBERS)]
        self.class1, self.member1, self.class2, self.member2 = tables
        # the second distance says how much likelier than by frequency
        self.class2 -= np.log(of_class)
        self.member2.reshape(KNOWN, CLASSES, MEMBERS)[:] -= np.log(of_member)
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {
            "e": draw(KNOWN, DIM) * np.float32(0.3 * np.sqrt(KNOWN)),
            "q": draw(DIM, KEY),
            "k": draw(DIM, KEY),
            "k2": draw(DIM, KEY),
            "v": draw(DIM, DIM),
            "r": draw(DIM, DIM),
            "r2": draw(DIM, DIM),
            "d": np.linspace(0.5, -1.5, LENGTH).astype(np.float32),
            "oc": np.zeros((DIM, CLASSES), np.float32),
            "om": np.zeros((CLASSES, DIM, MEMBERS), np.float32),
            "gc": np.full(CLASSES, 0.5, np.float32),
            "gm": np.full(CLASSES, 0.5, np.float32),
        }
        if pairs[2].any():
            self._begin(pairs[2], p.ravel())
        reach = np.arange(LENGTH)
        self.gap = reach[:, None] - reach[None, :]
        self.back, self.mask = np.maximum(self.gap, 0), np.where(self.gap >= 0, 0, -1e9).astype(np.float32)

    def _begin(self, far: np.ndarray, p: np.ndarray) -> None:
        """Embeddings and outputs from the principal parts of how much likelier entries get far behind others."""
        n, root = far.astype(np.float32), np.sqrt(p)
        odds = np.log((n + 20 * p) / ((n.sum(axis=1, keepdims=True) + 20) * p))
        odds *= root[:, None] * root
        rng = np.random.Generator(np.random.PCG64(7))
        right = rng.standard_normal((KNOWN, 2 * DIM)).astype(np.float32)
        for _ in range(8):  # subspace iteration
            left, _ = np.linalg.qr(odds @ right)
            right, _ = np.linalg.qr(odds.T @ left)
        u, s, vt = np.linalg.svd(left.T @ odds, full_matrices=False)
        self.w["e"] = np.clip((left @ u)[:, :DIM] / root[:, None], -4, 4).astype(np.float32) * np.float32(0.3)
        out = (vt[:DIM].T / root[:, None] * s[:DIM] * np.float32(0.5 / 0.3)).reshape(CLASSES, MEMBERS, DIM)
        share = p.reshape(CLASSES, MEMBERS)
        of_class = (out * (share / share.sum(axis=1, keepdims=True))[:, :, None]).sum(axis=1)
        self.w["oc"] = np.ascontiguousarray(of_class.T).astype(np.float32)
        self.w["om"] = np.ascontiguousarray((out - of_class[:, None]).transpose(0, 2, 1)).astype(np.float32)
        self.w["v"] = np.eye(DIM, dtype=np.float32)
        self.w["r"] *= np.float32(0.1)
        self.w["r2"] *= np.float32(0.1)
        self.w["d"] = np.linspace(0, -0.5, LENGTH).astype(np.float32)

    def step(self, one: np.ndarray, two: np.ndarray, goal: np.ndarray) -> tuple[float, dict]:
        """Mean loss and gradient over windows of entries; goal is -1 where a place doesn't count."""
        w, length, scale = self.w, one.shape[1], np.float32(KEY**-0.5)
        entries = np.stack((one, two), axis=2).ravel()
        xy = w["e"].take(entries, axis=0).reshape(-1, 2 * DIM)  # both entries of a place side by side
        of = np.zeros((2 * DIM, 2 * KEY + 2 * DIM), xy.dtype)
        of[:DIM] = np.concatenate((w["q"] * scale, w["k"], w["v"], w["r"]), axis=1)
        of[DIM:, KEY : 2 * KEY], of[DIM:, -DIM:] = w["k2"], w["r2"]
        asked = (xy @ of).reshape(*one.shape, -1)  # what each place asks, offers, gives and keeps
        q, k, kept = asked[..., :KEY], asked[..., KEY : 2 * KEY], asked[..., -DIM:]
        # a column of ones makes the product with the weights carry their sum
        v = np.ones((*one.shape, DIM + 1), xy.dtype)
        v[..., :DIM] = asked[..., 2 * KEY : -DIM]
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += w["d"][self.back[:length, :length]] + self.mask[:length, :length]
        if not (a.max() < LARGE and np.einsum("bii->bi", a).min() > -LARGE):
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        given = np.matmul(a, v)
        part = 1 / given[..., -1:]
        given = given[..., :-1] * part
        hidden = kept + given
        np.tanh(hidden, out=hidden)
        at = np.flatnonzero(goal.ravel() >= 0)
        c = (goal.ravel()[at] // MEMBERS).astype(np.uint8)
        order = np.argsort(c, kind="stable")  # few classes: sorted by counting
        at, c = at[order], c[order].astype(np.int64)  # all places that count, class by class
        h, b1, b2, m = hidden.reshape(-1, DIM).take(at, axis=0), one.ravel()[at], two.ravel()[at], goal.ravel()[at] % MEMBERS
        n, bounds = len(at), np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
        own = [(j, r, s) for j, (r, s) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if r < s]

        def soft(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Loss by row; logits become the gradient of the mean loss."""
            if not (logits.max() < LARGE and logits.min() > -LARGE):
                logits -= logits.max(axis=1, keepdims=True)
            np.exp(logits, out=logits)
            size = logits.shape[1]
            shares = 1 / (logits @ np.ones((size, 1), np.float32))
            cells, cell = logits.reshape(-1), np.arange(0, n * size, size) + y
            lost = -np.log(cells[cell] * shares[:, 0] + 1e-30)
            logits *= shares * np.float32(1 / n)
            cells[cell] -= np.float32(1 / n)
            return lost

        grad = {"om": np.zeros_like(w["om"])}
        far, p = self.class2.take(b2, axis=0), h @ w["oc"]
        p += self.class1.take(b1, axis=0)
        p += far * w["gc"]
        loss = soft(p, c)
        far *= p
        grad["oc"], grad["gc"] = h.T @ p, np.ones(n, np.float32) @ far
        dh = p @ w["oc"].T
        far, p, back = self.member2.take(b2 * CLASSES + c, axis=0), np.empty((n, MEMBERS), h.dtype), np.empty_like(h)
        for j, r, s in own:
            np.dot(h[r:s], w["om"][j], p[r:s])
        p += self.member1.take(b1 * CLASSES + c, axis=0)
        p += far * w["gm"].take(c)[:, None]
        loss += soft(p, m)
        for j, r, s in own:
            rows = p[r:s]
            np.dot(h[r:s].T, rows, grad["om"][j])
            np.dot(rows, w["om"][j].T, back[r:s])
        dh += back
        grad["gm"] = np.bincount(c, np.einsum("ij,ij->i", far, p), CLASSES).astype(w["gm"].dtype)
        d = np.zeros((*one.shape, 2 * KEY + 2 * DIM), xy.dtype)  # of what each place asks, offers, gives and keeps
        dz = np.zeros_like(hidden)
        dz.reshape(-1, DIM)[at] = dh
        dz *= 1 - hidden * hidden
        # the last column takes off the mean by the weights
        slope = np.concatenate((dz, -np.einsum("bij,bij->bi", dz, given)[..., None]), axis=2)
        slope *= part
        ds = np.matmul(slope, v.transpose(0, 2, 1))
        ds *= a
        np.matmul(ds, k, out=d[..., :KEY])
        np.matmul(ds.transpose(0, 2, 1), q, out=d[..., KEY : 2 * KEY])
        np.matmul(a.transpose(0, 2, 1), slope[..., :-1], out=d[..., 2 * KEY : -DIM])
        d[..., -DIM:] = dz
        d = d.reshape(-1, d.shape[2])
        of_gap = np.ones(len(ds), np.float32) @ ds.reshape(len(ds), -1)  # 0 ahead of a place
        grad["d"] = np.bincount(self.back[:length, :length].ravel(), of_gap, LENGTH).astype(np.float32)
        g = xy.T @ d
        grad["q"], grad["k"], grad["v"], grad["r"] = np.split(g[:DIM], (KEY, 2 * KEY, 2 * KEY + DIM), axis=1)
        grad["q"] = grad["q"] * scale
        grad["k2"], grad["r2"] = g[DIM:, KEY : 2 * KEY], g[DIM:, -DIM:]
        slopes = (d @ of.T).reshape(*one.shape, 2, DIM)
        if (one[:, :-1] == two[:, 1:]).all():  # an entry in a window's middle is its next place's one before
            slopes[:, 1:, 1] += slopes[:, :-1, 0]
            entries, slopes = np.concatenate((two.ravel(), one[:, -1])), np.concatenate((slopes[:, :, 1].reshape(-1, DIM), slopes[:, -1, 0]))
        order = np.argsort(entries.astype(np.uint16), kind="stable")
        entries = entries[order]
        start = np.flatnonzero(np.concatenate(([True], entries[1:] != entries[:-1])))
        grad["e"] = np.zeros_like(w["e"])
        grad["e"][entries[start]] = np.add.reduceat(slopes.reshape(-1, DIM).take(order, axis=0), start, axis=0)
        return float(loss.mean()), grad

    def train(self, windows: np.ndarray, rate: float = RATE, batch: int = BATCH, epochs: int = 1) -> list[float]:
        """Adam over windows: rows of entries, two before the first goal; -1 behind the last."""
        rng = np.random.Generator(np.random.PCG64(11))
        every = _packed(self.w)  # one row, of which the weights become parts
        self.w = _unpacked(every, self.w)
        mean, square = np.zeros_like(every), np.zeros_like(every)
        losses, t, total = [], 0, epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for a in range(0, len(windows), batch):
                part = windows[order[a : a + batch]]
                loss, g = self.step(np.maximum(part[:, 1:-1], 0), np.maximum(part[:, :-2], 0), part[:, 2:])
                losses.append(loss)
                t += 1
                now = np.float32(rate * min(1, t / 10) * (1 - 0.9 * t / total))
                slope, root = _packed(g), math.sqrt(1 - 0.99**t)
                mean *= np.float32(0.9)
                mean += np.float32(0.1) * slope
                slope *= slope
                slope *= np.float32(0.01)
                square *= np.float32(0.99)
                square += slope
                np.sqrt(square, out=slope)
                slope += np.float32(1e-8 * root)
                np.divide(mean, slope, out=slope)
                slope *= np.float32(now * root / (1 - 0.9**t))
                every -= slope
        return losses

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """What scoring looks up: an entry's query, key, value and residual, and gated biases."""

    def __init__(self, model: Attention):
        w, e = model.w, model.w["e"]
        self.known, self.within = model.known, model.within
        self.q, self.k, self.k2 = (e @ w["q"]) * np.float32(KEY**-0.5), e @ w["k"], e @ w["k2"]
        # a column of ones makes the product with the weights carry their sum
        self.v = np.concatenate((e @ w["v"], np.ones((KNOWN, 1), np.float32)), axis=1)
        self.r, self.r2, self.oc, self.om = e @ w["r"], e @ w["r2"], w["oc"], w["om"]
        self.class1, self.class2 = model.class1, model.class2 * w["gc"]
        self.member1 = model.member1
        self.member2 = (model.member2.reshape(KNOWN, CLASSES, MEMBERS) * w["gm"][:, None]).reshape(-1, MEMBERS)
        self.near = w["d"][np.maximum(model.gap, 0)] + model.mask
        self.ones = np.ones(max(CLASSES, MEMBERS), np.float32)

    def _outputs(self, h: np.ndarray, one: np.ndarray, two: np.ndarray, goal: np.ndarray) -> np.ndarray:
        c, m = goal // MEMBERS, goal % MEMBERS
        logits = h @ self.oc
        logits += self.class1.take(one, axis=0)
        logits += self.class2.take(two, axis=0)
        out = logits.ravel().take(np.arange(0, logits.size, CLASSES) + c).astype(np.float64)
        np.exp(logits, out=logits)
        out -= np.log(logits @ self.ones[:CLASSES])
        order = np.argsort(c.astype(np.uint8), kind="stable")  # few classes: sorted by counting
        own = c[order]
        bounds = np.searchsorted(own, np.arange(CLASSES + 1)).tolist()
        logits, h = np.empty((len(goal), MEMBERS), np.float32), h.take(order, axis=0)
        for j, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if b > a:
                np.dot(h[a:b], self.om[j], logits[a:b])
        logits += self.member1.take(one[order] * CLASSES + own, axis=0)
        logits += self.member2.take(two[order] * CLASSES + own, axis=0)
        found = logits.ravel().take(np.arange(0, logits.size, MEMBERS) + m[order]).astype(np.float64)
        np.exp(logits, out=logits)
        out[order] += found - np.log(logits @ self.ones[:MEMBERS])
        return out

    def log_probability(self, x: np.ndarray, numbers: np.ndarray, batch: int = 256, chunk: int = 8192) -> np.ndarray:
        """Natural log probability of each id, given the ids of its text before it."""
        one, two = before(x, numbers)
        goal, one, two = self.known[x], self.known[one], self.known[two]
        # what each place asks, offers and gives, once; windows are stretches of these
        tail = np.zeros(LENGTH, np.int64)
        head, head2 = np.concatenate((one, tail)), np.concatenate((two, tail))
        q, k, v = (rows.take(head, axis=0) for rows in (self.q, self.k, self.v))
        k += self.k2.take(head2, axis=0)
        mixed = np.empty((len(x), DIM + 1), np.float32)
        for start, size, skip in windows_of(numbers):
            for a in range(0, len(start), batch):
                begin, own = start[a : a + batch], size[a : a + batch]
                length = int(own.max())
                weights = np.matmul(_stretches(q, begin + skip, length - skip), _stretches(k, begin, length).transpose(0, 2, 1))
                weights += self.near[skip:length, :length]
                np.exp(weights, out=weights)
                reach, found = np.arange(skip, length), np.matmul(weights, _stretches(v, begin, length))
                if own.min() == length:
                    mixed[begin[:, None] + reach] = found
                else:
                    ok = reach < own[:, None]
                    mixed[(begin[:, None] + reach)[ok]] = found[ok]
        out = np.empty(len(x))
        for a in range(0, len(x), chunk):
            at = slice(a, a + chunk)
            h = mixed[at, :-1] / mixed[at, -1:]
            h += self.r.take(one[at], axis=0)
            h += self.r2.take(two[at], axis=0)
            np.tanh(h, out=h)
            out[at] = self._outputs(h, one[at], two[at], goal[at])
        return out + self.within[x]


def _stretches(rows: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """length rows on from each start; what lies behind a window's end is attended by nothing before it."""
    width = rows.shape[1]
    every = np.lib.stride_tricks.as_strided(rows, (len(rows) - length + 1, length * width), (rows.strides[0], rows.strides[1]))
    return every[start].reshape(len(start), length, width)


def windows_of(numbers: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(starts, sizes, places not scored) of all texts' first windows, and of the later ones.

    Windows of a text start stride apart; each scores what the window before didn't. A window
    ends with its text.
    """
    first = np.cumsum(numbers) - numbers
    order = np.argsort(np.minimum(numbers, LENGTH), kind="stable")  # short ones together
    later = np.maximum(0, -(-(numbers - LENGTH) // STRIDE))
    text = np.repeat(np.arange(len(numbers)), later)
    shift = STRIDE * (1 + np.arange(len(text)) - np.repeat(np.cumsum(later) - later, later))
    size = np.minimum(numbers[text] - shift, LENGTH)
    whole = np.argsort(size < LENGTH, kind="stable")  # those of full length together
    return [
        (first[order], np.minimum(numbers, LENGTH)[order], 0),
        ((first[text] + shift)[whole], size[whole], CONTEXT),
    ]


def chosen_windows(ids: bytes, share: int) -> list[tuple[int, bytes]]:
    """(number, ids) of the windows that a row trains on: one of share, one at least.

    Each has the two ids before its first (END before the text's beginning).
    """
    padded = _HEAD + ids
    return [(w, padded[2 * w * LENGTH : 2 * (w + 1) * LENGTH + 4]) for w in chosen_numbers(ids, share)]


def chosen_numbers(ids: bytes, share: int) -> range:
    n = -(-len(ids) // (2 * LENGTH))
    return range(zlib.crc32(ids) % min(n, share) if share > 1 else 0, n, share)


def _deal(at: int, parts: int):
    """(part, place, ids) of a round's windows, from (row, ids); equal windows are dealt apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            values = batch.column(1).to_pylist()
            numbers = [chosen_numbers(ids, SHARE) for ids in values]
            n = np.fromiter(map(len, numbers), np.int64, len(numbers))
            row = np.repeat(batch.column(0).to_numpy().astype(np.uint64), n)
            window = np.fromiter(itertools.chain.from_iterable(numbers), np.uint64, len(row))
            place = mix(mix(row + np.uint64(1)) + window)
            own = np.flatnonzero(place % np.uint64(ROUNDS) == at)
            part = mix(place[own]) % np.uint64(parts)
            padded, begin = [_HEAD + ids for ids in values], window[own].astype(np.int64) * (2 * LENGTH)
            found = [padded[i][a : a + 2 * LENGTH + 4] for i, a in zip(np.repeat(np.arange(len(n)), n)[own].tolist(), begin.tolist(), strict=True)]
            columns = [pa.array(part.astype(np.int32)), pa.array(place[own].view(np.int64)), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "place", "ids"])

    return run


def _packed(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _unpacked(row: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Parts of a row of weights, by name."""
    ends = np.cumsum([like[k].size for k in sorted(like)])
    return {k: part.reshape(like[k].shape) for k, part in zip(sorted(like), np.split(row, ends[:-1]), strict=True)}


def _train_part(model: Attention, rate: float):
    """The weights of a copy of the model after its pass over a part, and the part's ids."""

    def run(part: pa.Table) -> pa.Table:
        own = copy.copy(model)
        own.w = {k: v.copy() for k, v in model.w.items()}
        rows = part.sort_by([("place", "ascending")]).column("ids").to_pylist()
        windows = np.full((len(rows), LENGTH + 2), -1, np.int64)
        for line, ids in zip(windows, rows, strict=True):
            line[: len(ids) // 2] = model.known[np.frombuffer(ids, "<u2")]
        own.train(windows, rate)
        n = int((windows[:, 2:] >= 0).sum())
        w = _packed(own.w).astype(np.float64) * n
        return pa.table({"part": part.column("part")[:1], "ids": pa.array([n], pa.int64()), "w": pa.array([w.astype("<f8").tobytes()], pa.binary())})

    return run


def _sum_models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n, part = None, 0, 0
    for batch in batches:
        for part, ids, w in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = np.frombuffer(w, "<f8")
            total, n = (own.copy() if total is None else total + own), n + ids
    if total is not None:
        columns = [[part], [n], [total.tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["part", "ids", "w"])


def train_attention(model: Attention, train: DataFrame) -> None:
    """Rounds of copies trained by part and their means; train has the ids of the training rows."""
    n = train.agg(F.sum(F.ceil(F.octet_length("ids") / (2 * LENGTH))).alias("n")).first()["n"]
    if not n:
        return
    parts = max(1, round(n / ROUNDS / PART_WINDOWS))
    numbered = train.select(F.monotonically_increasing_id().alias("row"), "ids")
    schema = "part int, ids long, w binary"
    for at in range(ROUNDS):
        dealt = numbered.mapInArrow(_deal(at, parts), "part int, place long, ids binary")
        own = dealt.repartition(parts, "part").groupBy("part").applyInArrow(_train_part(model, RATE * (1 - at / ROUNDS)), schema)
        sums = parts
        while sums > LEVEL:
            sums = -(-sums // LEVEL)
            own = durable(own).repartition(sums, F.col("part") % sums).sortWithinPartitions("part").mapInArrow(_sum_models, schema)
        total, ids = None, 0
        for r in sorted(own.collect(), key=lambda r: r["part"]):  # at most LEVEL models
            w = np.frombuffer(r["w"], "<f8")
            total, ids = (w.copy() if total is None else total + w), ids + r["ids"]
        if not ids:
            continue
        model.w = _unpacked((total / ids).astype(np.float32), model.w)


def _score(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            for a, b, x, numbers in _id_slices(ids):
                total = np.add.reduceat(scorer.log_probability(x, numbers), np.cumsum(numbers) - numbers) / np.log(10)
                kept = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(total)], names=[*kept.schema.names[:-1], "score"])

    return run


def _top(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of at most limit entries: all from the least count on that so few reach."""
    capped = counts.groupBy(F.least("n", F.lit(65_536)).alias("c")).agg(F.count("*").alias("k")).collect()
    least, have = 65_537, 0
    for c, k in sorted(((r["c"], r["k"]) for r in capped), reverse=True):
        if have + k > limit:
            break
        least, have = c, have + k
    table = counts.filter(F.col("n") >= least).select("key", "n").toArrow()
    return table.column(0).to_numpy(), table.column(1).to_numpy()


def fit(train: DataFrame) -> Attention:
    """The model of a table of ids (binary, 16 bits each)."""
    unigrams = np.zeros(N_IDS)
    for r in train.select("ids").mapInArrow(_count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most N_IDS
        unigrams[r["id"]] = r["n"]
    pairs = np.zeros((3 * KNOWN, KNOWN), np.float32)
    cells = train.select("ids").mapInArrow(_count_pairs(known_of(unigrams)), CELLS_SCHEMA).repartition("line").mapInArrow(_sum_lines, CELLS_SCHEMA)
    for r in cells.toLocalIterator():  # 3 x KNOWN lines
        pairs[r["line"], np.frombuffer(r["ids"], "<u2")] = np.frombuffer(r["n"], "<i8")
    model = Attention(pairs.reshape(3, KNOWN, KNOWN), unigrams)
    train_attention(model, train)
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score."""
    if held_out is None:
        held_out = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 7 == 2
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(f"`{text_col}`").alias("text")
    )
    counts = rows.filter(~F.col("held_out")).select("text").mapInArrow(_count_words, "key long, n long")
    word_counts = durable(counts.groupBy("key").agg(F.sum("n").alias("n")))
    total = word_counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_train, v = int(total["n"] or 0), int(total["v"])

    keys, n = _top(word_counts.filter(F.col("key") != END_HASH), MAX_WORDS)
    order = np.argsort(keys.view(np.uint64))
    ends = word_counts.filter(F.col("key") == END_HASH).first()
    end_n = ends["n"] if ends else 0
    reader = _read(keys.view(np.uint64)[order], n[order], n_train, v)
    read = durable(rows.mapInArrow(reader, READ_SCHEMA))
    scorer = fit(read.filter(~F.col("held_out"))).scorer()

    numbered = read.withColumn("row", F.monotonically_increasing_id())
    rare = numbered.select("row", F.explode("rare").alias("key")).join(word_counts, "key")
    added = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count("*").alias("known"))
    scored = numbered.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "ids").mapInArrow(
        _score(scorer), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    )
    return scored.join(added, "row", "left").select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0)) + F.lit(1 if end_n else 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(float(np.log10(end_n + 1.0)))).alias("base_score"),
        "score",
    )
