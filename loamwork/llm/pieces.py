"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi, and decoding.

The automaton holds all pieces. It reads a text once; at each position its output links give every piece that ends
there, longest first, and each tries to relax the position. The segmentation is read off backwards.

The model is a BPE one: its scores are the order of its merges, so a sum of scores is not what it maximises. A piece
relaxes a position only if it is compatible with the piece that ends where it starts: merged in the order of the scores,
the two of them stay as they are. A sequence whose neighbours are compatible is what merging the whole would give, and
every position has exactly one such piece; so the pass ends with the model's own ids. Whether a pair is compatible follows
from the merges of either piece, which are replayed side by side once and looked up later.

A character that is no piece becomes its UTF-8 bytes (models with byte pieces) or the unknown id.

No piece goes on after a blank that follows a word, which is checked on loading. So the texts are cut there, and
equal stretches are segmented once and looked up.

The model's normalisation must be the identity with a blank put in front, which is checked on loading. A literal
U+2581, the sign that stands for a blank, is written as bytes (the library would take it for a blank), so
decode(encode(text)) is the text whatever it holds.

Defined cases: null or empty texts have no ids; very long stretches are segmented whole but not kept; rows with
null or repeated doc_ids are rows like others; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

from pyspark.sql import DataFrame

from loamwork.llm.bitfile import crc
from loamwork.llm.encoder import text_blocks
from loamwork.llm.shared import doc_columns, keep_for, tidy

BLANK = "▁"
#: Longest stretch kept, stretches kept, pairs of pieces kept.
LONGEST, KEPT, PAIRS = 64, 400_000, 300_000
NEVER = float("-inf")
CUT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+").findall


class Pieces:
    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        special = [model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k) for k in range(len(names))]
        self.normal = {n: k for k, n in enumerate(names) if not special[k]}
        self.score = {n: model.get_score(k) for n, k in self.normal.items()}
        if any(re.search(f"[^{BLANK}]{BLANK}", n) for n in self.normal):
            raise ValueError("a piece goes on over the blank after a word")
        if any(model.normalize(t) != (BLANK + t).replace(" ", BLANK) for t in ("a  b ", " é", "ﬁ\n\tx", "Ａ")):
            raise ValueError("the model's normalisation is not the identity")
        self.unknown_id = model.unk_id()
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(model.is_byte(k) for k in self.bytes)
        self.automaton = ahocorasick.Automaton()
        self.after: dict[str, dict[str, bool]] = {n: {} for n in self.normal}  # whether a piece is compatible with one before it
        self.held = 0
        for n in self.normal:
            self.automaton.add_word(n, (len(n), n, self.after[n]))
        self.automaton.make_automaton()
        self.out = [b"" if special[k] else n.replace(BLANK, " ").encode() for k, n in enumerate(names)]
        if self.has_bytes:
            for b, k in enumerate(self.bytes):
                self.out[k] = bytes([b])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before the table was full
        self.merges: dict[str, tuple[list[tuple[float, str, str]], bool]] = {}

    def merged(self, piece: str) -> tuple[list[tuple[float, str, str]], bool]:
        """A piece's merges from its characters, as (score, first part, last part) before each, and whether they end in one part."""
        found = self.merges.get(piece)
        if found is None:
            parts, steps = list(piece), []
            while True:
                best = max(((self.score[x + y], -k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.score), default=None)
                if best is None:
                    break
                steps.append((best[0], parts[0], parts[-1]))
                k = -best[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            found = self.merges[piece] = (steps, len(parts) == 1)
        return found

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of left + right ends in these two: no merge over the border ever comes first."""
        (a, _), (b, whole) = self.merged(left), self.merged(right)
        i = j = 0
        while whole:
            x, y = a[i][2] if i < len(a) else left, b[j][1] if j < len(b) else right
            ahead = max(a[i][0] if i < len(a) else NEVER, b[j][0] if j < len(b) else NEVER)
            over = self.score.get(x + y, NEVER)
            # of equal scores the leftmost merge is first: one in left, then the one over the border
            if over > ahead or over == ahead > NEVER and not (i < len(a) and a[i][0] == ahead):
                return False
            if ahead == NEVER:
                return True
            if i < len(a) and a[i][0] == ahead:
                i += 1
            else:
                j += 1
        return False

    def _learn(self, left: str, right: str) -> bool:
        if self.held >= PAIRS:
            for known in self.after.values():
                known.clear()
            self.held = 0
        self.held += 1
        found = self.after[right][left] = self.compatible(left, right) if left else self.merged(right)[1]
        return found

    def segment(self, stretch: str) -> list[int]:
        """Ids of the pieces in which merging the stretch ends."""
        n = len(stretch)
        # the piece that ends at each position; "" where none does, so that a character stands alone
        last = [""] * (n + 1)
        for end, (length, piece, known) in self.automaton.iter(stretch):
            end += 1
            if not last[end]:
                start = end - length
                before = (last[start] or stretch[start - 1]) if start else ""
                fits = known.get(before)
                if fits or fits is None and self._learn(before, piece):
                    last[end] = piece
        ids: list[int] = []
        k = n
        while k:
            piece = last[k] or stretch[k - 1]
            name = self.normal.get(piece)
            if name is not None:
                ids.append(name)
            elif self.has_bytes:
                ids.extend(self.bytes[b] for b in reversed(piece.encode("utf-8", "surrogatepass")))
            elif not ids or ids[-1] != self.unknown_id:
                ids.append(self.unknown_id)
            k -= len(piece)
        return ids[::-1]

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        literal = array("I", [self.bytes[b] for b in BLANK.encode()] if self.has_bytes else [self.unknown_id]).tobytes()
        parts = []
        for k, part in enumerate(text.split(BLANK)):
            if k:
                parts.append(literal)
            stretches = CUT((part if k else " " + part).replace(" ", BLANK))
            found = list(map(self.known.get, stretches))
            if None in found:
                found = [self._ids(x) if y is None else y for x, y in zip(stretches, found)]
            parts += found
        return b"".join(parts)

    def _ids(self, stretch: str) -> bytes:
        ids = self.known.get(stretch) or self.older.get(stretch)
        if ids is None:
            ids = array("I", self.segment(stretch)).tobytes()
            if len(stretch) > LONGEST:
                return ids
        if len(self.known) >= KEPT:
            self.known, self.older = {}, self.known
        self.known[stretch] = ids
        return ids

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.out.__getitem__, memoryview(ids).cast("I").tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "surrogatepass" if self.has_bytes else "replace")


@cache
def pieces(model_path: str) -> Pieces:
    """One automaton for each worker process."""
    keep_for("pieces", pieces.cache_clear)
    return Pieces(model_path)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array), and whether they decode to the text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        p = pieces(model_path)
        for batch in batches:
            for at, texts in text_blocks(batch, 2_000_000):
                ids = [p.encode(t) for t in texts]
                same = [p.decode(x) == t for x, t in zip(ids, texts)]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), lists, pa.array(same)], ["doc_id", "ids", "round_trip"])

    return doc_columns(docs).mapInArrow(tidy(run, "pieces"), "doc_id long, ids array<int>, round_trip boolean")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and round_trip of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            found = [crc(flat[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends[1:] - ends[:-1], pa.int64()), pa.array(found, pa.int64()), batch.column(2)], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return encode_documents(docs, model_path).mapInArrow(tidy(run, "pieces"), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
