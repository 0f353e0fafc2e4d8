"""License scans by conditional compression.

Texts with a marker word are split into candidate blocks: each sentence and line with a marker,
each paragraph around one, and each span, over lines and paragraphs or inside longer ones, where the
words of a template stand (found by the places of its word pairs or trigrams). A block whose number of
words is within the differences allowed of no template is no candidate.

Every candidate, as its words with single spaces, is compressed alone, with all templates as one
zstandard raw dictionary, and then with each template as dictionary of its own. The bytes that a
template saves rank the templates; one that saves less than LEAST_SAVING of what it saves of itself
has nothing to do with the block, and isn't tried if all templates together save too little for it. In the order of savings
the exact differences in wording confirm a template or not, and the first confirmed wins; among
those whose savings are less than TIE bytes behind it, the one with the fewest differences. Of
overlapping blocks the one with the longest confirmed template stays.

The scan is narrow: a row never leaves its task. Texts without a marker are left out by a native
filter before Python; markers are chosen from the templates so that no block within the differences
allowed is without one (see markers_of). Blocks that recur are looked up.

Defined cases: null and empty texts have no findings; repeated rows are reported each; an empty
table gives no rows; ties go to the template first by name; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structex.llm.common import in_parts
from structex.llm.license_templates import TEMPLATES

#: The words that may be missing, and those that may be added, as a share of the template's words.
MAX_DIFFERENCE = 0.15
#: What a template saves of a block at least, as a share of what it saves of itself. Wordings at the
#: bound of differences were measured at 0.18 and more, most prose saves nothing.
LEAST_SAVING = 0.1
#: Bytes that a template alone may save beyond what all templates in one dictionary do, whose places
#: take longer to name.
NEARLY = 4
#: Savings that differ by less, about a word, rank alike.
TIE = 8
_WORD = re.compile(r"[\w.'/:-]*\w")
_CLOSE = re.compile(r"[^\w\s]*")
_SENTENCE = re.compile(r"[^\s].*?(?:[.!?](?=\s|$)|$)", re.DOTALL)

SCHEMA = (
    "doc_id long, license string, start long, end long, plain_bytes long, saved_bytes long, "
    "missing_words int, extra_words int, differences string"
)


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _normal(own: list[str]) -> bytes:
    return " ".join(own).encode("utf-8", "surrogatepass")


def slack(n: int) -> int:
    """How many of a template's n words may be missing, and as many added."""
    return int(MAX_DIFFERENCE * n)


def markers_of(templates: dict[str, str]) -> list[str]:
    """Words such that more of each template's words are markers than may be missing.

    So every block that can be confirmed has a marker. Chosen one by one: the word that makes up
    most of what the templates still lack, the longest of equals.
    """
    bags = {k: Counter(words(v)) for k, v in sorted(templates.items())}
    lack = {k: slack(b.total()) + 1 for k, b in bags.items()}
    chosen: list[str] = []
    every = sorted({w for b in bags.values() for w in b})
    while any(n > 0 for n in lack.values()):
        gain = {w: sum(min(n, bags[k][w]) for k, n in lack.items() if n > 0) * min(len(w), 6) for w in every if w not in chosen}
        best = max(gain, key=lambda w: (gain[w], len(w), w))
        chosen.append(best)
        lack = {k: n - bags[k][best] for k, n in lack.items()}
    return chosen


def blocks(text: str, marked: re.Pattern) -> list[tuple[int, int]]:
    """Bounds of the sentences, lines and paragraphs that have a marker."""
    found, at = set(), 0
    for line in text.split("\n"):
        if marked.search(line.lower()):
            found.add((at, at + len(line)))
            for m in _SENTENCE.finditer(line):
                if marked.search(m[0].lower()):
                    found.add((at + m.start(), at + m.end()))
        at += len(line) + 1
    for m in re.finditer(r"(?:[^\n]*\S[^\n]*\n?)+", text):
        if "\n" in m[0].rstrip("\n") and marked.search(m[0].lower()):
            found.add((m.start(), m.start() + len(m[0].rstrip("\n"))))
    return sorted(found)


class Scanner:
    def __init__(self, templates: dict[str, str], level: int = 3):
        import zstandard as zstd

        self.words = {k: words(v) for k, v in sorted(templates.items())}
        self.bags = {k: Counter(v) for k, v in self.words.items()}
        self.marked = re.compile("|".join(map(re.escape, markers_of(templates))))
        # a block within the differences allowed shares one of these with its template: a missing
        # word breaks as many as a tuple is long, an added one fewer, and so few don't break all
        self.places: dict[tuple, list[tuple[str, int]]] = defaultdict(list)
        for k, v in self.words.items():
            for at in range(len(v)):
                part = tuple(v[at : at + (3 if len(v) >= 20 else 2)])
                if len(part) == (3 if len(v) >= 20 else 2):
                    self.places[part].append((k, at))
        self.heads = {part[0] for part in self.places}
        self.sizes = {n for v in self.words.values() for n in range(len(v) - slack(len(v)), len(v) + slack(len(v)) + 1)}
        # blocks are short: small tables, and frames without what every frame has
        form = zstd.ZstdCompressionParameters.from_level(
            level, window_log=14, hash_log=12, chain_log=12, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.plain = zstd.ZstdCompressor(compression_params=form)
        self.given = {}
        for k, v in self.words.items():
            text = _normal(v)
            # the dictionary ends with the template, where matches are cheapest
            own = zstd.ZstdCompressionDict(text * (1 + 16 // len(text)), dict_type=zstd.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=form)
            self.given[k] = zstd.ZstdCompressor(compression_params=form, dict_data=own)
        texts = [_normal(v) for v in self.words.values()]
        wide = zstd.ZstdCompressionParameters.from_level(
            level, window_log=15, hash_log=14, chain_log=14, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        every = zstd.ZstdCompressionDict(b" ".join(texts), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        every.precompute_compress(compression_params=wide)
        self.every = zstd.ZstdCompressor(compression_params=wide, dict_data=every)
        self.most = {k: len(self.plain.compress(_normal(v))) - len(self.given[k].compress(_normal(v))) for k, v in self.words.items()}
        self.known = lru_cache(maxsize=4096)(self._ranked)

    def _judge(self, block: str) -> tuple | None:
        """(license, plain bytes, saved bytes, missing, extra, differences) of the winner."""
        own = words(block)
        if len(own) not in self.sizes:
            return None
        data = _normal(own)
        return self.known(data) if len(data) < 4096 else self._ranked(data)

    def _ranked(self, data: bytes) -> tuple | None:
        size = len(self.plain.compress(data))
        # no template saves much that all together don't
        together = size - len(self.every.compress(data)) + NEARLY
        near = [k for k, most in self.most.items() if together >= LEAST_SAVING * most]
        savings = sorted(((size - len(self.given[k].compress(data)), k) for k in near), key=lambda x: (-x[0], x[1]))
        best, own = None, data.decode("utf-8", "surrogatepass").split(" ")
        for saved, name in savings:
            if best is not None and saved <= best[1] - TIE:
                break
            if saved < LEAST_SAVING * self.most[name]:
                continue
            goal = self.words[name]
            parts = [o for o in SequenceMatcher(None, goal, own, autojunk=False).get_opcodes() if o[0] != "equal"]
            missing, extra = sum(o[2] - o[1] for o in parts), sum(o[4] - o[3] for o in parts)
            if max(missing, extra) <= slack(len(goal)):
                said = "; ".join(f"-{' '.join(goal[o[1]:o[2]])} +{' '.join(own[o[3]:o[4]])}" for o in parts)
                first = saved if best is None else best[1]
                row = (missing + extra, first, name, size, saved, missing, extra, said)
                best = row if best is None or row[0] < best[0] else best
        return best[2:] if best else None

    def spans(self, text: str) -> set[tuple[int, int]]:
        """Bounds of the stretches that have enough of a template's words, in its order."""
        at = [m.span() for m in _WORD.finditer(text)]
        own = [text[a:b].lower() for a, b in at]
        starts: dict[str, Counter] = defaultdict(Counter)
        for i in range(len(own)):
            if own[i] not in self.heads:
                continue
            for size in (2, 3):
                for name, k in self.places.get(tuple(own[i : i + size]), ()):
                    starts[name][i - k] += 1
        found = set()
        for name, counted in starts.items():
            goal, covered = self.words[name], set()
            apart = slack(len(goal))
            for start, _ in sorted(counted.items(), key=lambda x: (-x[1], x[0])):
                if start + len(goal) // 2 in covered:
                    continue
                low = max(0, start - apart)
                part = own[low : start + len(goal) + apart]
                if (Counter(part) & self.bags[name]).total() < len(goal) - apart:
                    continue
                runs = [r for r in SequenceMatcher(None, goal, part, autojunk=False).get_matching_blocks() if r.size]
                # words that match by chance outside the wording are farther from it than they are long
                while len(runs) > 1 and runs[1].b - runs[0].b - runs[0].size > runs[0].size:
                    runs.pop(0)
                while len(runs) > 1 and runs[-1].b - runs[-2].b - runs[-2].size > runs[-1].size:
                    runs.pop()
                a, b = low + runs[0].b, low + runs[-1].b + runs[-1].size
                covered.update(range(a, b))
                end = at[b - 1][1]
                found.add((at[a][0], end + len(_CLOSE.match(text, end)[0])))
        return found

    def scan(self, text: str) -> list[tuple]:
        """(license, start, end, plain, saved, missing, extra, differences), without overlaps."""
        found = []
        for a, b in sorted({*blocks(text, self.marked), *self.spans(text)}):
            judged = self._judge(text[a:b])
            if judged:
                found.append((-len(self.words[judged[0]]), judged[3] + judged[4], a, b, judged))
        chosen: list[tuple] = []
        for _, _, a, b, (name, *rest) in sorted(found):
            if all(b <= c or a >= d for _, c, d, *_ in chosen):
                chosen.append((name, a, b, *rest))
        return sorted(chosen, key=lambda x: x[1:3])


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.string()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in in_parts(batches):
            rows = [
                (doc_id, *finding)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for finding in scanner.scan(text)
            ]
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per confirmed licence: its place (code points) and how its wording differs."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    templates = templates or TEMPLATES
    low = F.lower("text")
    marked = rows.filter(reduce(or_, (F.contains(low, F.lit(m)) for m in markers_of(templates)), F.lit(False)))
    return marked.mapInArrow(_scan(templates), SCHEMA)
