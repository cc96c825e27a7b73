"""Exact n-gram Jaccard join: size-banded tiles, bitmap signatures, then sorted-array intersection.

Tiles. Sets are banded by size. Shingles have one order for all sets, frequent ones last. If two sets reach the
threshold t, they share more than n - ceil(t * n) of the n shingles of either, so the first n - ceil(t * n) + 1
shingles of both, in this order, have one in common. A tile is (band, shingle) for a set's first shingles: it holds
every linked pair. Sets near a band's upper end also enter the next band. Any order gives whole results; this one
keeps tiles small, as a set's first shingles are those that hardly any other document has. Frequencies are counted over all documents
in a table of hashed counters whose size is bounded (MAX_COUNTERS), so they are upper bounds.

Bounds. A set has a bitmap of BITS hashed bits. A bit of A that B lacks stands for a shingle that B lacks, so bit
counts bound the intersection from above; only pairs that pass it are intersected as sorted arrays.

Work is kept linear. Equal sets are one node, from a digest collapsed on the map side. In a tile, every node is
first compared with the tile's smallest node alone, and components of these links are formed. Tiles of the same nodes
count once. Only tiles that still hold two components are compared in full, in blocks of at most BLOCK nodes, inside a task, leaving out
pairs of one component. Turns that compare only each node's most promising pairs join most components first; the last
turn compares all pairs that are left. So no link between components is lost, and copies are never expanded into pairs.

Tables in the shared folder cut the lineage. Narrow frames are broadcast up to a counted number of rows and joined by a shuffle
beyond; pairs meet their nodes' bitmaps and sets by a shuffle in which a node with many pairs is dealt over many tasks.
Sets are 64-bit hashes of shingles, so results are exact up to collisions of these: two different shingles of 10^6 share
a hash with a chance of 3 in 10^8.

Defined cases: null or wordless texts have no shingles and link with nothing; rows with one doc_id are
nodes of their own that share the id; a null doc_id is larger than any and stays null as a component's id if
it is the only one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.components import components
from loamwork.llm.shared import doc_columns, drop_since, key_sizes, lookup, mark, salts_of, small, small_batches, tidy, written
from loamwork.llm.shingles import WordHashes, mix, shingle_set

#: Bits of a bitmap, steps of 1/t in a band, nodes of a block.
BITS, BAND_STEPS, BLOCK = 1024, 3, 256
#: Hashed counters for each document, their bounds, counters of a page.
COUNTERS_PER_DOC, MIN_COUNTERS, MAX_COUNTERS, PAGE = 32, 1 << 16, 1 << 26, 1 << 16
#: Most promising pairs of a node in a tile that are compared in a limited turn, and limited turns.
BEST, LIMITED = 2, 6
_NO_ID = (1 << 63) - 1
_BAND = 0xC2B2AE3D27D4EB4F


class Tiles:
    """Tile keys for the threshold num/den; levels: of each hashed counter, how frequent its shingles are."""

    def __init__(self, num: int, den: int, levels: np.ndarray):
        self.num, self.den, self.levels = num, den, levels
        self.shift = np.uint64(65 - len(levels).bit_length())
        self.low = [1]  # smallest size of each band

    def band(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, math.floor(self.low[-1] * (self.den / self.num) ** BAND_STEPS)))
        return int(np.searchsorted(self.low, n, "right")) - 1

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        if self.den * (n - 1) < self.num * n and self.den * n < self.num * (n + 1):  # no other set can reach it
            return np.empty(0, np.uint64)
        first = n - -(-self.num * n // self.den) + 1
        order = np.lexsort((shingles, self.levels[(shingles >> self.shift).astype(np.int64)]))
        head, band = shingles[order[:first]], self.band(n)
        bands = [band, band + 1] if n * self.den >= self.low[band + 1] * self.num else [band]
        return np.concatenate([mix(head + np.uint64((b + 1) * _BAND % (1 << 64))) for b in bands])


def count_levels(docs: DataFrame, width: int, counters: int) -> np.ndarray:
    """The count of each hashed counter, scaled down where the mean exceeds 64, up to 255: at most MAX_COUNTERS bytes.

    Tasks count all documents' shingles and send compressed pages of counts (a task's count up to 255), which are summed by page.
    """
    page = min(PAGE, counters)
    shift = np.uint64(65 - counters.bit_length())

    def count(batches):
        import pyarrow as pa

        words, table, some = WordHashes(), np.zeros(counters, np.uint16), False
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                for text in batch.column(0).slice(a, 500).to_pylist():
                    s = shingle_set(text, width, words)
                    some = some or len(s) > 0
                    np.add.at(table, (s >> shift).astype(np.int64), np.uint16(1))
                np.minimum(table, 255, out=table)  # 500 texts cannot wrap the rest
        pages = table.reshape(-1, page)
        used = np.flatnonzero(pages.any(axis=1)) if some else []
        for k in range(0, len(used), 64):
            part = used[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([zlib.compress(pages[p].astype(np.uint8).tobytes(), 1) for p in part], pa.binary())], ["page", "counts"])
        del table, pages

    def total(batches):
        import pyarrow as pa

        at, sums = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.minimum(sums, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())], ["page", "counts"])
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != at:
                    if at is not None:
                        yield row()
                    at, sums = p, np.zeros(page, np.uint64)
                sums += np.frombuffer(zlib.decompress(c), np.uint8)
        if at is not None:
            yield row()

    parts = small_batches(docs).select(F.col("text").cast("string")).mapInArrow(tidy(count), "page int, counts binary")
    out = np.zeros(counters, np.uint32)
    for p, c in parts.repartition("page").sortWithinPartitions("page").mapInArrow(tidy(total), "page int, counts binary").toLocalIterator():
        out[p * page : (p + 1) * page] = np.frombuffer(c, "<u4")
    scale, levels = max(1.0, float(out.mean(dtype=np.float64)) / 64), np.zeros(counters, np.uint8)
    for a in range(0, counters, page):
        levels[a : a + page] = np.minimum(255, out[a : a + page] / scale)
    return levels


def bitmap(shingles: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    bits[(shingles >> np.uint64(54)).astype(np.int64) % BITS] = 1
    return np.packbits(bits).tobytes()


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that do not depend on order; signed, for Spark's long."""
    a, b = np.add.reduce(mix(shingles + np.uint64(5))), np.add.reduce(mix(shingles ^ np.uint64(0xABCDEF1234567)))
    return tuple(int(x.astype(np.int64)) for x in (np.asarray(a), np.asarray(b)))


def most_common(bits_a: np.ndarray, bits_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Upper bound of |A and B| from bit counts, for rows of uint64 words."""
    only_a = np.bitwise_count(bits_a & ~bits_b).sum(axis=1, dtype=np.int64)
    only_b = np.bitwise_count(bits_b & ~bits_a).sum(axis=1, dtype=np.int64)
    return np.minimum(n_a - only_a, n_b - only_b)


def may_link(bits_a: np.ndarray, bits_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the bit counts allow den * |A and B| >= num * |A or B|."""
    most = most_common(bits_a, bits_b, n_a, n_b)
    return den * most >= num * (n_a + n_b - most)


def best_of_each(s: np.ndarray, t: np.ndarray, score: np.ndarray, tie: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the pairs (s, t) that are among the ``most`` with the highest score of s or of t."""
    node, pair = np.concatenate([s, t]), np.tile(np.arange(len(s)), 2)
    order = np.lexsort((tie[pair], -score[pair], node))
    node = node[order]
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    rank = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
    return np.unique(pair[order][rank < most])


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Exact test on sorted distinct arrays."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(a) + len(b) - common)


def _nodes(docs: DataFrame, width: int, num: int, den: int, counters: int | None = None) -> DataFrame:
    """One row for each row of docs: uid, doc_id, n, digest, bitmap, tile keys."""
    counters = counters or min(MAX_COUNTERS, max(MIN_COUNTERS, 1 << (COUNTERS_PER_DOC * max(1, docs.count()) - 1).bit_length()))
    levels = docs.sparkSession.sparkContext.broadcast(count_levels(docs, width, counters))

    def run(batches):
        import pyarrow as pa

        tiles, words, uid = Tiles(num, den, levels.value), WordHashes(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                sets = [shingle_set(t, width, words) for t in part.column("text").to_pylist()]
                d = [digest(s) for s in sets]
                keys = [tiles.keys(s) if len(s) else s for s in sets]
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                flat = np.concatenate(keys).astype(np.int64) if keys else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + len(sets))), part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in d], pa.int64()), pa.array([y for _, y in d], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["uid", "doc_id", "text_hash", "n", "d1", "d2", "bits", "keys"],
                )
                uid += len(sets)

    texts = doc_columns(docs).withColumn("text_hash", F.xxhash64("text"))
    return texts.mapInArrow(tidy(run), "uid long, doc_id long, text_hash long, n long, d1 long, d2 long, bits binary, keys array<long>")


def _words(column, rows=slice(None)) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, BITS // 64)[rows]


def _bounded(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of a written table that sizes and bitmaps allow to link."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            if batch.num_rows:
                keep = may_link(_words(c["bits_a"].to_pylist()), _words(c["bits_b"].to_pylist()), c["n_a"].to_numpy(), c["n_b"].to_numpy(), num, den)
                yield pa.RecordBatch.from_arrays([c["a"], c["b"]], ["a", "b"]).filter(pa.array(keep))

    sizes = {end: key_sizes(pairs, end) for end in ("a", "b")}
    for end, other in (("a", "b"), ("b", "a")):
        pairs = lookup(pairs, reps.select(F.col("uid").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}")), end, other, sizes=sizes[end])
        if end == "b":
            pairs = pairs.where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    return pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(tidy(run), "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that link, by intersecting their sets, which are made again from the texts of these nodes alone."""

    def sets(batches):
        import pyarrow as pa

        words, seen = WordHashes(), set()
        for batch in batches:
            uids, d1, d2, found = batch.column("uid").to_pylist(), batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), ([], [])
            for k, text in enumerate(batch.column("text").to_pylist()):
                if uids[k] not in seen:  # rows equal in doc_id and text may be in other tasks, and only repeat links
                    s = shingle_set(text, width, words)
                    if digest(s) == (d1[k], d2[k]):  # else another text with this doc_id and hash
                        seen.add(uids[k])
                        found[0].append(uids[k])
                        found[1].append(s.tobytes())
                if len(found[0]) == 500 or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.binary())], ["uid", "shingles"])
                    found = ([], [])

    def test(batches):
        import pyarrow as pa

        at, leading = None, None
        for batch in batches:
            lead, salt, other, shingles = (batch.column(k) for k in ("lead", "salt", "other", "shingles"))
            keep = []
            for k, group in enumerate(zip(lead.to_pylist(), salt.to_pylist())):
                array = np.frombuffer(shingles[k].as_buffer(), np.uint64)
                if not other[k].is_valid:  # the leading set comes first
                    at, leading = group, array.copy()
                    keep.append(False)
                else:
                    keep.append(group == at and linked(leading, array, num, den))
            yield pa.RecordBatch.from_arrays([lead, other], ["lead", "other"]).filter(pa.array(keep, pa.bool_()))

    sizes = key_sizes(pairs.select(F.col("a").alias("uid")).unionAll(pairs.select(F.col("b").alias("uid"))), "uid")
    wanted = written(reps.select("uid", "doc_id", "text_hash", "d1", "d2").join(small(sizes.select("uid")), "uid", "left_semi"), "wanted")
    texts = doc_columns(docs).select(F.col("doc_id").alias("its_id"), "text", F.xxhash64("text").alias("its_hash"))
    found = texts.join(small(wanted), (F.col("its_hash") == F.col("text_hash")) & F.col("its_id").eqNullSafe(F.col("doc_id"))).select("uid", "d1", "d2", "text")
    arrays = written(found.mapInArrow(tidy(sets), "uid long, shingles binary"), "sets")
    # the node with more pairs leads; it goes once to each part of its pairs, and the other's set once for each pair
    total = pairs.count()
    counted = pairs
    for end, other in (("a", "b"), ("b", "a")):
        side = sizes.select(F.col("uid").alias(end), F.col("_n").alias(f"n_{end}"))
        few = small(side)
        counted = counted.join(few, end) if few is not side else lookup(counted, side, end, other, sizes=key_sizes(pairs, end))
    first = F.col("n_a") >= F.col("n_b")
    led = counted.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("lead"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"))
    led = led.select("lead", "other", F.pmod(F.xxhash64("other"), salts_of(sizes.withColumnRenamed("uid", "lead"), ["lead"], total)).cast("int").alias("salt"))
    heads = led.select(F.col("lead").alias("uid"), "lead", "salt").distinct().withColumn("other", F.lit(None).cast("long"))
    rows = written(led.select(F.col("other").alias("uid"), "lead", "salt", "other").unionByName(heads), "led")
    few = small(rows)
    moved = arrays.join(few, "uid") if few is not rows else lookup(rows, arrays, "uid", "lead")
    moved = moved.select("lead", "salt", "other", "shingles").repartition("lead", "salt").sortWithinPartitions("lead", "salt", F.col("other").asc_nulls_first())
    return moved.mapInArrow(tidy(test), "lead long, other long").select(F.least("lead", "other").alias("a"), F.greatest("lead", "other").alias("b"))


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, uid, label and size for the members of tiles that hold two components or more; no other tile will hold two again."""
    named = written(members.join(labels, members["uid"] == labels["node"], "left").select("key", "uid", F.coalesce("label", "uid").alias("label")), "named")
    tiles = written(named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("_n")), "tiles")
    side = tiles.where("low < high").select("key", F.col("_n").alias("size"))
    return written(lookup(named, side, "key", "uid", sizes=tiles.select("key", "_n")), "open")


def _crossing(opened: DataFrame, reps: DataFrame, num: int, den: int, best: int | None) -> DataFrame:
    """(a, b, cut): pairs of nodes in one open tile but in different components, that sizes and bitmaps allow to link.

    With ``best``, only pairs among that many most promising of one of their nodes in a tile; cut tells of others.
    """
    rows = opened.join(reps.select("uid", "n", "bits"), "uid")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("uid"), blocks).cast("int")
    places = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(F.least(i, own).alias("x"), F.greatest(i, own).alias("y")))
    dealt = rows.select("key", "uid", "label", "n", "bits", own.alias("own"), F.explode(places).alias("p")).select("key", "uid", "label", "n", "bits", "own", "p.x", "p.y")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    names = ["key", "x", "y", "uid", "label", "n", "own"]

    def pairs(batches):
        import pyarrow as pa

        rest = None

        def compare(c, bits):
            """All pairs inside each run of one (key, x, y): row i with row i + step, for all steps."""
            new = np.concatenate(([True], (c["key"][1:] != c["key"][:-1]) | (c["x"][1:] != c["x"][:-1]) | (c["y"][1:] != c["y"][:-1])))
            group = np.cumsum(new)
            i, step, found, cut = np.arange(len(group) - 1), 1, [], False
            while len(i):
                j = i + step
                small = np.minimum(c["n"][i], c["n"][j])
                ok = (c["label"][i] != c["label"][j]) & (small * den >= np.maximum(c["n"][i], c["n"][j]) * num) & ((c["x"][i] == c["y"][i]) | (c["own"][i] != c["own"][j]))
                p, q = i[ok], j[ok]
                for a in range(0, len(p), 100_000):
                    s, t = p[a : a + 100_000], q[a : a + 100_000]
                    common = most_common(bits[s], bits[t], c["n"][s], c["n"][t])
                    union = c["n"][s] + c["n"][t] - common
                    good = den * common >= num * union
                    found.append((s[good], t[good], (common / union)[good]))
                if best and sum(len(f[0]) for f in found) > 200_000:
                    found, cut = chosen(c, found, cut)
                step += 1
                i = i[(i + step < len(group))]
                i = i[group[i] == group[i + step]]
            if best and found:
                found, cut = chosen(c, found, cut)
            s, t = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
            return np.unique(np.stack([np.minimum(c["uid"][s], c["uid"][t]), np.maximum(c["uid"][s], c["uid"][t])], 1), axis=0), cut

        def chosen(c, found, cut):
            s, t, score = (np.concatenate([f[k] for f in found]) for k in range(3))
            keep = best_of_each(s, t, score, mix((c["uid"][s] ^ c["uid"][t]).astype(np.uint64)), best)
            return [(s[keep], t[keep], score[keep])], cut or len(keep) < len(s)

        def rows_of(found, cut):
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.full(len(found), cut))], ["a", "b", "cut"])

        for batch in batches:
            c, bits = {k: batch.column(k).to_numpy() for k in names}, _words(batch.column("bits").to_pylist())
            if rest is not None:
                c, bits = {k: np.concatenate([rest[0][k], c[k]]) for k in names}, np.concatenate([rest[1], bits])
            last = np.flatnonzero((c["key"] != c["key"][-1]) | (c["x"] != c["x"][-1]) | (c["y"] != c["y"][-1])) if len(bits) else []
            cut = int(last[-1]) + 1 if len(last) else 0  # the last run may go on in the next batch
            if cut:
                yield rows_of(*compare({k: v[:cut] for k, v in c.items()}, bits[:cut]))
            rest = ({k: v[cut:] for k, v in c.items()}, bits[cut:])
        if rest is not None and len(rest[1]):
            yield rows_of(*compare(*rest))

    return dealt.select(*names, "bits").mapInArrow(tidy(pairs), "a long, b long, cut boolean")


def _distinct_tiles(members: DataFrame) -> DataFrame:
    """members with their tile's leader, the smallest node, but for tiles that hold the same nodes as another.

    A tile's nodes are known by their number and 128 bits that do not depend on order.
    """
    bits = [F.bit_xor(F.xxhash64(F.lit(seed), F.col("uid"))).alias(f"x{seed}") for seed in (1, 2)]
    tiles = written(members.groupBy("key").agg(*bits, F.count(F.lit(1)).alias("size"), F.min("uid").alias("leader")), "tiles")
    kept = written(tiles.groupBy("x1", "x2", "size").agg(F.min(F.struct("key", "leader")).alias("t")).select("t.key", "t.leader"), "kept")
    return written(lookup(members, kept, "key", "uid", sizes=tiles.select("key", F.col("size").alias("_n"))), "members")


def jaccard_groups(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), keeper (true in one row of each component), text_hash."""
    spark, first_table = docs.sparkSession, mark()
    nodes = written(_nodes(docs, width, num, den), "nodes")
    narrow = nodes.select("uid", F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text_hash", "n", "d1", "d2")
    full = narrow.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "uid")).alias("first"))
    classes = written(full.select("d1", "d2", "n", F.col("first.uid").alias("rep"), F.col("first.doc_id").alias("rep_doc")), "classes")
    reps = nodes.join(small(classes.select(F.col("rep").alias("uid"))), "uid", "left_semi")
    exploded = reps.select("uid", F.explode("keys").alias("key"))
    shared = written(exploded.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "shared")
    members = _distinct_tiles(written(lookup(exploded, shared.select("key"), "key", "uid", sizes=shared), "members"))
    rep_rows = nodes.select("uid", "doc_id", "text_hash", "n", "d1", "d2", "bits")
    in_tiles = members.select("uid").distinct()
    rep_rows = written(rep_rows.join(small(in_tiles), "uid", "left_semi"), "reps")
    star = written(members.where("uid <> leader").select(F.col("leader").alias("a"), F.col("uid").alias("b")).distinct(), "star")
    star = written(_bounded(star, rep_rows, num, den), "star")
    links = written(_verified(star, docs, rep_rows, width, num, den), "links")
    labels, tested, best, opened = components(links), star, BEST, members
    for turn in range(LIMITED + 1):
        opened = _open(opened.select("key", "uid"), labels)
        crossing = written(_crossing(opened, rep_rows, num, den, best), "crossing")
        fresh = written(crossing.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "fresh")
        more = written(_verified(fresh, docs, rep_rows, width, num, den), "links")
        merged = more.limit(1).count() > 0
        if merged:
            links = written(links.union(more), "links")
            labels = components(links)
        if not crossing.where("cut").limit(1).count():
            break  # every pair between components was bounded, and all that passed were compared
        tested = written(tested.union(fresh), "tested")
        if not merged or turn == LIMITED - 1:
            best = None
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("d1", "d2", "n", "rep_doc", "rep", F.coalesce("label", "rep").alias("label"))
    named = written(named, "named")
    firsts = named.groupBy("label").agg(F.min(F.struct("rep_doc", "rep")).alias("low"))
    ids = lookup(named, firsts, "label", "rep").select("d1", "d2", "n", F.col("low.rep_doc").alias("component"), F.col("low.rep").alias("keeper_uid"))
    ids = written(ids, "ids")
    drop_since(spark, first_table, nodes, ids)
    out = lookup(narrow, ids, ["d1", "d2", "n"], "uid", "left")
    real = lambda c: F.nullif(c, F.lit(_NO_ID))
    return out.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("component", "doc_id")).alias("component_id"), (F.coalesce("keeper_uid", "uid") == F.col("uid")).alias("keeper"), "text_hash")


def one_of_each(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of docs that stay: of each group of near copies one with the smallest doc_id, and all others.

    Rows equal in doc_id and text count as one row.
    """
    who = [F.col("doc_id").cast("long").alias("_j_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_j_hash")]
    kept = jaccard_groups(docs, width, num, den).where("keeper").select(F.col("doc_id").alias("_j_kept"), F.col("text_hash").alias("_j_text")).distinct()
    kept = written(kept, "kept")
    named = docs.select("*", *who)
    out = named.join(kept, F.col("_j_id").eqNullSafe(F.col("_j_kept")) & (F.col("_j_hash") == F.col("_j_text")), "left_semi")
    if docs.select(*who).groupBy("_j_id", "_j_hash").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").limit(1).count():
        out = out.dropDuplicates(["_j_id", "_j_hash"])
    return out.drop("_j_id", "_j_hash")
