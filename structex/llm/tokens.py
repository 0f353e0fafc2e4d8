"""Ids of the public byte-level BPE, as the tokenizer's JSON file gives them.

The rank file holds the same vocabulary and is faster to read; tests compare the ids of both. The
string of the one added token has an id of its own wherever it stands in a text, and the stretches
between are encoded apart.
"""

from __future__ import annotations

import array
import base64
import re
import sys
from functools import lru_cache

#: Fixed values of the vocabulary: its added token and that token's id.
ADDED, ADDED_ID = "<|endoftext|>", 50_256


#: Runs of white space that the encoder's pattern can't take in (it fails from about a million on),
#: looked for in texts of so many characters.
LONG = 50_000
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG)


class Encoder:
    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as lines:
            self._ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self._ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """Ids of a text in which the added token is ordinary text."""
        if len(text) < LONG:
            return self._encoding.encode_ordinary(text)
        ids, at = [], 0
        for run in _RUN.finditer(text):
            # a run is one piece but for its last character, which goes with what follows
            end = run.end() - (run.end() < len(text))
            ids += self._encoding.encode_ordinary(text[at : run.start()])
            ids += self._encoding._encode_single_piece(text[run.start() : end])
            at = end
        return ids + self._encoding.encode_ordinary(text[at:])

    def strings(self) -> list[bytes]:
        """The bytes of each id but the added token's."""
        return sorted(self._ranks, key=self._ranks.__getitem__)

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        ids = array.array("I")
        first, *later = text.split(ADDED)
        ids.extend(self.encode(first))
        for part in later:
            ids.append(ADDED_ID)
            ids.extend(self.encode(part))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


@lru_cache(maxsize=2)
def encoder(rank_file: str | None = None) -> Encoder:
    """One encoder per worker process; by default the public 50k vocabulary."""
    import public_tokenizers

    return Encoder(rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
