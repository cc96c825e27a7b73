"""Token files with fixed-width bit packing.

File: 32-byte header (magic, version, bits of an id, ids of a block, documents, ids), the blocks, the byte
offset of each block, then for each document its id, whether it has one, and its first token's place.
Ids take the fewest bits that hold the vocabulary, little-endian, and every block starts at a whole byte.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC, VERSION, HEADER = b"LWTB", 1, struct.Struct("<4sHHIQQ4x")
BLOCK = 1 << 16


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids (uint32), each in ``bits`` bits; whole bytes need no bit matrix."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    found = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(-1, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = found
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Appends documents to an open binary stream, with one block in memory; the counts stand in the trailer too."""

    def __init__(self, stream, bits: int, block: int = BLOCK):
        self.stream, self.bits, self.block = stream, bits, block
        self.rest: list[bytes] = []
        self.waiting = 0
        self.at, self.n_ids = HEADER.size, 0
        self.offsets: list[int] = []
        self.docs: list[int] = []
        self.has: list[bool] = []
        self.starts: list[int] = []
        stream.write(HEADER.pack(MAGIC, VERSION, bits, block, 0, 0))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        self.docs.append(doc_id or 0)
        self.has.append(doc_id is not None)
        self.starts.append(self.n_ids)
        self.rest.append(ids)
        self.waiting += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.waiting >= self.block:
            self._blocks(last=False)

    def _blocks(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.rest), "<u4")
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError("an id does not fit the vocabulary's bits")
        upto = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, upto, self.block):
            data = pack(ids[a : a + self.block][: upto - a], self.bits)
            self.offsets.append(self.at)
            self.at += len(data)
            self.stream.write(data)
        self.rest, self.waiting = [ids[upto:].tobytes()], len(ids) - upto

    def close(self) -> None:
        self._blocks(last=True)
        for values, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.has, "u1"), (self.starts, "<u8")):
            self.stream.write(np.array(values, kind).tobytes())
        self.stream.write(struct.pack("<QQQQ", self.at, len(self.offsets), len(self.docs), self.n_ids))


class Reader:
    """Random access to a random-access file (seek, read, size)."""

    def __init__(self, stream, size: int):
        self.stream = stream
        magic, version, self.bits, self.block, _, _ = HEADER.unpack(self._at(0, HEADER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        at, blocks, docs, self.n_ids = struct.unpack("<QQQQ", self._at(size - 32, 32))
        self.offsets = np.frombuffer(self._at(at, 8 * blocks), "<u8")
        self.docs = np.frombuffer(self._at(at := at + 8 * blocks, 8 * docs), "<i8")
        self.has = np.frombuffer(self._at(at := at + 8 * docs, docs), "u1").astype(bool)
        self.starts = np.frombuffer(self._at(at + docs, 8 * docs), "<u8").astype(np.int64)

    def _at(self, place: int, count: int) -> bytes:
        self.stream.seek(place)
        return self.stream.read(count)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at start..stop of the file, from the blocks that hold them alone."""
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            count = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(self._at(int(self.offsets[b]), (count * self.bits + 7) // 8), self.bits, count))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of each document, about one block in memory beside the document itself."""
        stops = np.append(self.starts[1:], self.n_ids)
        k = 0
        while k < len(self.docs):
            upto = max(k + 1, int(np.searchsorted(stops, self.starts[k] + self.block, "right")))
            ids, base = self.ids(int(self.starts[k]), int(stops[upto - 1])), int(self.starts[k])
            for d in range(k, upto):
                yield (int(self.docs[d]) if self.has[d] else None), int(self.starts[d]), ids[int(self.starts[d]) - base : int(stops[d]) - base]
            k = upto


def crc(ids: np.ndarray | bytes) -> int:
    return zlib.crc32(ids if isinstance(ids, bytes) else ids.astype("<u4").tobytes())
