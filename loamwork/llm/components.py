"""Connected components of links as smallest nodes, over tables in the shared folder, for any number of rounds.

A round has three steps on the links that still join two labels:

1. Forests. Each partition keeps a spanning forest of its links, as links from each node to its tree's smallest node.
   Links are dealt by both ends, so equal ones meet and a hot node is split. Few links meet in one partition, whose
   forest then is the answer.
2. Hooks. Each label takes its smallest neighbour's if that is smaller; parents are looked up until they are roots, which
   halves paths each time.
3. Links get the roots of their ends, and those inside one tree go.

A label that does not hook has only larger neighbours, and after their hooks one that is smaller, or has grown: two rounds
at least halve the labels of a component, so the rounds end by themselves, after at most 2 * log2(nodes) of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.shared import drop_since, lookup, mark, small, tidy, written

#: Links of one forest, so a task's memory is bounded.
LINKS = 2_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b), and the smallest node that each reaches."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = np.split(codes, 2)
    parent = np.arange(len(nodes))
    while True:
        low, high = np.minimum(parent[p], parent[q]), np.maximum(parent[p], parent[q])
        apart = low < high
        if not apart.any():
            return nodes, nodes[parent]
        p, q = p[apart], q[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _forests(batches):
    import pyarrow as pa

    held: list[tuple[np.ndarray, np.ndarray]] = []

    def made():
        nodes, root = roots(*(np.concatenate(x) for x in zip(*held)))
        inner = nodes != root
        return nodes[inner], root[inner]

    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > LINKS:
            forest = made()
            if len(forest[0]) > LINKS // 2:  # hardly any link less: give it away
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest], ["a", "b"])
                forest = (forest[0][:0], forest[1][:0])
            held, size = [forest], len(forest[0])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made()], ["a", "b"])


def _of(rows: DataFrame, names: DataFrame, key: str, spread: str) -> DataFrame:
    """rows with names' column for their key; names are broadcast if they are few, and hot keys split if not."""
    side = small(names)
    return rows.join(side, key) if side is not names else lookup(rows, names, key, spread)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node that it reaches."""
    spark, first = edges.sparkSession, mark()
    links = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    maps: list[DataFrame] = []
    while True:
        forest = written(links.repartition("a", "b").mapInArrow(tidy(_forests), "a long, b long"), "forest")
        near = forest.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(forest.select("b", "a"))
        parents = written(near.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label")), "parents")
        while True:  # until all parents are roots
            up = parents.select(F.col("node").alias("label"), F.col("label").alias("further"))
            new = written(_of(parents, up, "label", "node").select("node", "label", "further"), "parents")
            parents = new.select("node", F.col("further").alias("label"))
            if not new.where("label <> further").limit(1).count():
                break
        maps.append(parents)
        for end, other in (("a", "b"), ("b", "a")):
            forest = _of(forest, parents.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")), end, other)
        links = written(forest.where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), "links")
        if not links.limit(1).count():
            break
    found = maps.pop()
    while maps:  # each round's roots are nodes of the next, or have no links left
        below = maps.pop()
        up = found.select(F.col("node").alias("label"), F.col("label").alias("further"))
        side = small(up)
        joined = below.join(side, "label", "left") if side is not up else lookup(below, up, "label", "node", "left")
        found = written(joined.select("node", F.coalesce("further", "label").alias("label")), "labels")
    drop_since(spark, first, found)
    return found
