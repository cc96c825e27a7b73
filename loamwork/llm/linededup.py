"""Removing lines that many documents repeat, with two Bloom filters before the exact step.

1. Each line key is sent as a 64-bit hash alone to its part of the hash space; an Arrow batch sends each of its hashes once,
   with a mark if it held it twice, so a line of every document is few rows. There are as many parts as keep a
   part's filters at FILTER_KEYS keys, whatever the size of the corpus.
2. A part has two Bloom filters, for once-seen and twice-seen hashes: a hash that the first one holds already goes
   into the second, so that no repeat is missed.
3. Only lines that the twice-seen filters hold are written out, as a 128-bit cryptographic digest with their document and
   line number. Up to BROADCAST_BYTES, all parts' filters together are broadcast to the documents; beyond, lines'
   hashes and digests go to their part, where its filter waits for them. No text is moved either way.
4. These suspects are grouped by digest, summed up on the map side first. Confirmed keys meet the suspects again in a join
   that splits hot keys, and each document gets the numbers of its lines to drop.
Filters that are fuller than planned only let more lines through to the exact step.

A key is a line stripped of [\\x20\\x09-\\x0D] and with A-Z lower-cased. Keys of at least ``shortest`` code points
in at least ``documents`` documents stay in the document with the largest doc_id alone, in all its lines.

Defined cases: a document is a doc_id: rows that share one count once, and share the right to keep a line; a null doc_id is
one too, smaller than any; a null text is one empty line and becomes empty when rewritten; an empty table stays
empty; other columns, whatever their names, are carried through.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.llm.shared import drop_since, lookup, mark, small_batches, tidy, written

BLANK = b" \t\n\r\x0b\x0c"
#: Bits of a filter for each key, most and least keys of a part's filters, hash positions of a key, bytes of filters broadcast.
BITS_PER_KEY, FILTER_KEYS, LEAST_KEYS, POSITIONS, BROADCAST_BYTES = 16, 1 << 25, 1 << 16, 3, 64 << 20
_NO_ID = -(1 << 63)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def line_key(line: bytes, shortest: int) -> bytes | None:
    """The key of a line (UTF-8), None where it is too short to count."""
    key = line.strip(BLANK).lower()
    if len(key) < shortest or len(key) < 4 * shortest and len(key.decode("utf-8", "surrogatepass")) < shortest:
        return None
    return key


def first_lines(text: str | None, shortest: int) -> dict[bytes, int]:
    """Each key of a text with the number of its first line."""
    found: dict[bytes, int] = {}
    for k, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        key = line_key(line, shortest)
        if key is not None and key not in found:
            found[key] = k
    return found


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bit positions of each hash, a row each."""
    return (hashes[:, None] * _ODD) >> np.uint64(65 - bits.bit_length())


def _put(array: np.ndarray, places: np.ndarray) -> None:
    places = places.ravel()
    np.bitwise_or.at(array, places >> np.uint64(3), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))


def _holds(array: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((array[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


class Filters:
    """The once-seen and twice-seen filters of one part of the hash space."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray, many: np.ndarray) -> None:
        """Puts hashes in; many: where one stands for two or more."""
        values, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        places = positions(values, self.bits)
        again = (counts > 1) | _holds(self.once, places)
        again[at[many]] = True
        _put(self.once, places)
        _put(self.twice, places[again])


class Parts:
    """How the hash space is divided: parts, and bits of a part's filter."""

    def __init__(self, keys: int, tasks: int, bits_per_key: int = BITS_PER_KEY):
        self.parts = max(1, -(-keys // FILTER_KEYS), min(tasks, keys // LEAST_KEYS))
        self.bits = 1 << max(10, (bits_per_key * -(-keys // self.parts) - 1).bit_length())

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The part of each hash, by its upper half; a filter's places come from all of it."""
        return ((hashes >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int32)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def twice_seen(docs: DataFrame, shortest: int, bits_per_key: int = BITS_PER_KEY) -> tuple[Parts, DataFrame]:
    """The parts of the hash space, and (part, twice): the twice-seen filter of each part that has keys, compressed."""
    text = F.col("text").cast("string")
    lines = F.sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    keys = docs.agg(F.least(lines, F.floor(F.sum(F.octet_length(text)) / (shortest + 1)) + F.count(text)).alias("keys")).first()[0]
    parts = Parts(keys or 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), bits_per_key)

    def hashes(batches):
        import pyarrow as pa

        for batch in batches:
            values, counts = np.unique(_hashes(key for t in batch.column(0).to_pylist() for key in first_lines(t, shortest)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(parts.of(values)), pa.array(values.view(np.int64)), pa.array(counts > 1)], ["part", "hash", "many"])

    def fill(batches):
        import pyarrow as pa

        at, filters = None, None
        made = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(filters.twice.tobytes(), 1)], pa.binary())], ["part", "twice"])
        for batch in batches:
            part, values, many = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            for k in np.unique(part):
                if k != at:
                    if at is not None:
                        yield made()
                    at, filters = k, Filters(parts.bits)
                filters.add(values[part == k], many[part == k])
        if at is not None:
            yield made()

    sent = docs.select(text).mapInArrow(tidy(hashes), "part int, hash long, many boolean")
    return parts, written(sent.repartition(parts.parts, "part").sortWithinPartitions("part").mapInArrow(tidy(fill), "part int, twice binary"), "twice")


def suspected_lines(docs: DataFrame, parts: Parts, filters: DataFrame, shortest: int) -> DataFrame:
    """doc, text_hash, key (digest) and line of each row's first lines that the filters hold."""
    text = F.col("text").cast("string")
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text).alias("text_hash"), text)
    few = parts.parts * parts.bits <= 8 * BROADCAST_BYTES
    whole = np.zeros((parts.parts, parts.bits // 8), np.uint8) if few else None
    if few:
        for part, twice in filters.toLocalIterator():  # BROADCAST_BYTES at most
            whole[part] = np.frombuffer(zlib.decompress(twice), np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(whole)

    def lines(batches):
        """Lines with their part; if the filters are here, only those that they hold."""
        import pyarrow as pa

        for batch in batches:
            row, keys, numbers = [], [], []
            for k, t in enumerate(batch.column(2).to_pylist()):
                found = first_lines(t, shortest)
                row += [k] * len(found)
                keys += found
                numbers += found.values()
            hashes = _hashes(keys)
            part = parts.of(hashes)
            there = np.flatnonzero(_holds(sent.value.ravel(), positions(hashes, parts.bits) + (part.astype(np.uint64) * np.uint64(parts.bits))[:, None])) if sent.value is not None else np.arange(len(keys))
            took = pa.array(np.array(row, np.int64)[there])
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[there]), pa.array(hashes[there].view(np.int64)), batch.column(0).take(took), batch.column(1).take(took), pa.array([_digest(keys[h]) for h in there], pa.binary()), pa.array(np.array(numbers, np.int32)[there])],
                ["part", "hash", "doc", "text_hash", "key", "line"],
            )

    def held(batches):
        import pyarrow as pa

        at, bits = None, None
        for batch in batches:
            part, twice = batch.column(0).to_numpy(), batch.column(6)
            keep, hashes = np.zeros(batch.num_rows, bool), batch.column(1).fill_null(0).to_numpy().view(np.uint64)
            for first in np.flatnonzero(twice.is_valid().to_numpy(zero_copy_only=False)):  # a part's filter comes first
                keep[:first] |= (part[:first] == at) & _holds(bits, positions(hashes[:first], parts.bits)) if at is not None else False
                at, bits = part[first], np.frombuffer(zlib.decompress(twice[first].as_py()), np.uint8)
            keep |= (part == at) & _holds(bits, positions(hashes, parts.bits)) if at is not None else False
            yield batch.select(["doc", "text_hash", "key", "line"]).filter(pa.array(keep & ~twice.is_valid().to_numpy(zero_copy_only=False)))

    found = ids.mapInArrow(tidy(lines), "part int, hash long, doc long, text_hash long, key binary, line int")
    if few:
        return found.select("doc", "text_hash", "key", "line")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("hash", "long"), ("doc", "long"), ("text_hash", "long"), ("key", "binary"), ("line", "int"))]
    both = found.withColumn("twice", F.lit(None).cast("binary")).unionByName(filters.select("part", *nothing, "twice"))
    return both.repartition(parts.parts, "part").sortWithinPartitions("part", F.col("twice").isNull()).mapInArrow(tidy(held), "doc long, text_hash long, key binary, line int")


def dedup_lines(docs: DataFrame, shortest: int = 20, documents: int = 3, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """All rows and columns of docs with repeated lines gone from text, and n_lines, n_dropped (long) at the end."""
    first = mark()
    spark = small_batches(docs).sparkSession
    suspects = written(suspected_lines(docs, *twice_seen(docs, shortest, bits_per_key), shortest), "suspects")
    counted = suspects.groupBy("key").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper"))
    confirmed = written(counted.where(F.col("n") >= documents), "confirmed")
    lost = lookup(suspects, confirmed.select("key", "keeper"), "key", "text_hash").where("doc <> keeper")
    drops = written(lost.groupBy(F.col("doc").alias("_ld_doc2"), F.col("text_hash").alias("_ld_hash2")).agg(F.collect_set("line").alias("_ld_lines")), "drops")
    drop_since(spark, first, drops)
    who = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_ld_doc"), F.xxhash64(F.col("text").cast("string")).alias("_ld_hash")]
    both = docs.select("*", *who)
    both = both.join(drops, (both["_ld_doc"] == F.col("_ld_doc2")) & (both["_ld_hash"] == F.col("_ld_hash2")), "left")
    schema = T.StructType([f if f.name != "text" else T.StructField("text", T.StringType()) for f in docs.schema.fields] + [T.StructField(c, T.LongType()) for c in ("_ld_n", "_ld_gone")])

    def rewrite(batches):
        import pyarrow as pa

        for batch in batches:
            n, gone, texts = [], [], []
            for text, lines in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), batch.column(batch.schema.get_field_index("_ld_lines")).to_pylist()):
                split = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                n.append(len(split))
                if lines:
                    bad = {line_key(split[k], shortest) for k in lines}
                    kept = [x for x in split if line_key(x, shortest) not in bad]
                    text = b"\n".join(kept).decode("utf-8", "surrogatepass")
                    gone.append(len(split) - len(kept))
                else:
                    gone.append(0)
                texts.append(text)
            columns = [batch.column(f.name) if f.name != "text" else pa.array(texts, pa.string()) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [f.name for f in schema.fields])

    out = both.drop("_ld_doc", "_ld_hash", "_ld_doc2", "_ld_hash2").withColumn("text", F.col("text").cast("string")).mapInArrow(tidy(rewrite), schema)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_ld_n").alias("n_lines"), F.col("_ld_gone").alias("n_dropped"))
