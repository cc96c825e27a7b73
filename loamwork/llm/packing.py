"""Packing documents into training sequences by non-negative least squares over length combinations.

A shard is a run of documents with about SHARD_TOKENS tokens inside one input partition, so memory is bounded
and nothing is exchanged. In a shard: whole windows are cut off long documents; of the lengths left, all exact
pairs and a spread of exact triples that fill a window are the columns, the histogram of lengths is the right
side, and the repeat counts come from a non-negative least squares fit (accelerated projected gradient). Counts
are rounded as far as the histogram allows. What is left is packed greedily, largest first, cutting one piece
where nothing fits. So every sequence is full, but for the shard's last tokens: these are cut at powers of two,
lengths at which a sequence needs no padding.

sequence_id is the partition's number times 2^33 plus a count in the partition: unique, and repeatable for one dealing of
the rows. Which documents share a sequence depends on how the input is dealt over partitions; every id lies in exactly one
piece whatever that is.

Defined cases: null text is empty, which is the end id alone; null or repeated doc_ids are packed row by row;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loamwork.llm.bitfile import crc
from loamwork.llm.encoder import encoder, text_blocks
from loamwork.llm.shared import doc_columns, tidy

SHARD_TOKENS = 4_000_000
#: Exact triples tried for each largest length, and steps of the fit.
TRIPLES, STEPS = 6, 250
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c) of lengths with a >= b >= c, c = 0 for a pair, a + b + c = window; present[n]: whether length n occurs."""
    found = []
    for a in np.flatnonzero(present)[::-1]:
        low, high = -(-(window - a) // 2), min(a, window - a)
        if a < window and low <= high:
            b = np.arange(low, high + 1)
            b = b[present[b] & ((window - a - b == 0) | present[window - a - b])]
            pair, triple = b[b == window - a], b[b < window - a]
            if len(triple) > TRIPLES:
                triple = triple[np.linspace(0, len(triple) - 1, TRIPLES).astype(int)]
            b = np.concatenate([pair, triple])
            found.append(np.stack([np.full(len(b), a), b, window - a - b], 1))
    return np.concatenate(found) if found else np.empty((0, 3), int)


def repeats(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that makes sum of squares of (A x - histogram) small; A counts the lengths of each combination."""
    n = len(combos)
    if not n:
        return np.zeros(0)
    target = histogram.astype(float)
    target[0] = 0
    real = (combos > 0).astype(float)

    def times(x):
        return np.bincount(combos.ravel(), (x[:, None] * real).ravel(), len(target))

    step = 1 / (3 * times(np.ones(n)).max())
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        gradient = ((times(y) - target)[combos] * real).sum(1)
        new = np.maximum(0, y - step * gradient)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (item, start in the item, length), for items of these lengths."""
    sequences: list[list[tuple[int, int, int]]] = []
    pools: dict[int, list[tuple[int, int]]] = {}
    for k, n in enumerate(lengths):
        whole = n // window * window
        sequences += [[(k, s, window)] for s in range(0, whole, window)]
        if n > whole:
            pools.setdefault(n - whole, []).append((k, whole))
    histogram = np.zeros(window + 1, int)
    for n, pool in pools.items():
        histogram[n] = len(pool)
    combos = combinations(histogram > 0, window)
    x = repeats(combos, histogram)
    order = np.argsort(-x, kind="stable")
    for limit in (np.rint(x), np.full(len(x), np.inf)):  # the rounded counts, then what else fits exactly
        for k in order:
            parts = [int(n) for n in combos[k] if n]
            count = int(min(limit[k], *(len(pools[n]) // parts.count(n) for n in parts)))
            for _ in range(count):
                sequences.append([(*pools[n].pop(), n) for n in parts])
    return sequences + _greedy(pools, window)


def _greedy(pools: dict[int, list[tuple[int, int]]], window: int) -> list[list[tuple[int, int, int]]]:
    sequences, sizes = [], sorted(n for n, p in pools.items() if p)
    left = sum(n * len(pools[n]) for n in sizes)

    def take(at: int) -> tuple[int, int, int]:
        n = sizes[at]
        piece = (*pools[n].pop(), n)
        if not pools[n]:
            del sizes[at]
        return piece

    while left:
        room = window if left >= window else 1 << (left.bit_length() - 1)
        left -= room
        sequence: list[tuple[int, int, int]] = []
        while room:
            fit = bisect_right(sizes, room) - 1
            item, start, n = take(fit if fit >= 0 else 0)
            used = min(n, room)
            if n > used:  # nothing fits: cut the shortest
                if n - used not in pools or not pools[n - used]:
                    pools.setdefault(n - used, [])
                    if bisect_left(sizes, n - used) == len(sizes) or sizes[bisect_left(sizes, n - used)] != n - used:
                        insort(sizes, n - used)
                pools[n - used].append((item, start + used))
            sequence.append((item, start, used))
            room -= used
        sequences.append(sequence)
    return sequences


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each piece of each document, with its sequence and its offset there."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa

        encode, first = encoder(tokenizer_path).encode, TaskContext.get().partitionId() << 33
        ids: list = []
        tokens: list[bytes] = []
        size = 0

        def flush():
            nonlocal first
            rows: list[tuple] = []
            for sequence in plan([len(t) // 4 for t in tokens], window):
                offset = 0
                for item, start, n in sequence:
                    rows.append((ids[item], start, n, crc(tokens[item][4 * start : 4 * (start + n)]), len(tokens[item]) // 4, first, offset))
                    offset += n
                first += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for at, texts in text_blocks(batch):
                for k, t in enumerate(encode(texts)):
                    ids.append(names[at + k])
                    tokens.append(t + end)
                    size += len(t) // 4 + 1
                if size >= shard_tokens:
                    yield from flush()
                    ids, tokens, size = [], [], 0
        if ids:
            yield from flush()

    return doc_columns(docs).mapInArrow(tidy(run, "encoder"), SCHEMA)
