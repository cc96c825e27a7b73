"""Whole-text encoding with the tokenizers library, one call for each distinct piece of text.

Byte-level and word-level BPE never merge across the pre-tokenizer's boundaries. So a text is cut at some of
those boundaries, new pieces are encoded by the library, and known ones are looked up; the ids are those of
encoding the whole text at once.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

from loamwork.llm.shared import keep_for

#: Unicode's White_Space, which the tokenizers' \s stands for; letters of Latin-1 and ASCII.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LATIN = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"

#: A run of Latin letters ends a pre-token where ASCII (no letter, as the run is possessive) or the end follows;
#: otherwise a piece goes on to the next white space.
BYTE_LEVEL = re.compile(f" ?[{LATIN}]++(?=[\\x00-\\x7f]|\\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_LEVEL = re.compile(f"[{LATIN}]++(?=[\\x00-\\x7f]|\\Z)|[^ \\t\\n\\r]+")

#: Longest piece kept; pieces that a table holds before it becomes the older of two; pieces encoded at a time.
#: They bound a worker's memory.
LONGEST, KEPT, PART = 48, 500_000, 8_000


class Encoder:
    """encode(texts): for each text the bytes of its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer_path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words = str(self.tokenizer.pre_tokenizer).startswith("Sequence")
        self.cut = (WORD_LEVEL if self.words else BYTE_LEVEL).findall
        self.kept, self.known, self.older = kept, {}, {}

    def _learn(self, new: set[str]) -> None:
        """Makes all of new known: taken over from the older table, or encoded."""
        known, older = self.known, self.older
        if older:
            for piece in new & older.keys():
                known[piece] = older[piece]
            new = new.difference(known)
        listed = list(new)
        for a in range(0, len(listed), PART):
            part = listed[a : a + PART]
            for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[piece] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.words:  # this tokenizer lower-cases, which A-Z can be spared from being new pieces
            texts = [t.encode("utf-8").lower().decode("utf-8") for t in texts]
        pieces = [self.cut(t) for t in texts]
        new = set().union(*pieces).difference(self.known)
        self._learn(new)
        out = [b"".join(map(self.known.__getitem__, p)) for p in pieces]
        for piece in new:
            if len(piece) > LONGEST:
                del self.known[piece]
        if len(self.known) > self.kept:
            self.known, self.older = {}, self.known
        return out


@cache
def encoder(tokenizer_path: str) -> Encoder:
    """One encoder for each worker process; its tables stay from task to task until another operator's task begins."""
    keep_for("encoder", encoder.cache_clear)
    return Encoder(tokenizer_path)


def text_blocks(batch, most: int = 2_000_000):
    """(first row, texts) of slices of a record batch with about ``most`` bytes of text each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    column = batch.column("text")
    upto = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
        yield at, column.slice(at, end - at).to_pylist()
        at = end
