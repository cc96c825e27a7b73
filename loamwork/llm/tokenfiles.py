"""Writing a corpus as bit-packed token files and reading it back.

One range exchange puts the texts in ascending doc_id order; each task streams its range into one file in
the shared folder, named after the attempt, and returns a manifest row. A task that is run again writes a
file of its own, and only the successful attempt's row counts. The driver gets one row for each file.

Defined cases: null text is empty (the end id alone); a null doc_id comes first; rows with one doc_id follow
each other by text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm import bitfile
from loamwork.llm.encoder import encoder, text_blocks
from loamwork.llm.shared import doc_columns, scratch, tidy, written

DOCS_PER_FILE = 50_000


def write_corpus(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int, folder: str | None = None, files: int | None = None) -> list[tuple[str, int, int]]:
    """Writes all documents; (path, documents, ids) of each file in order."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // DOCS_PER_FILE))
    bits, end = bitfile.width(vocabulary), end_id.to_bytes(4, "little")

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.lwtb"
        encode, out = encoder(tokenizer_path).encode, None
        stream = None
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, texts in text_blocks(batch):
                if out is None:
                    stream = store.open_output_stream(f"{at}/{name}")
                    out = bitfile.Writer(stream, bits)
                for k, data in enumerate(encode(texts)):
                    out.add(ids[first + k], data + end)
        if out is not None:
            out.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [f"{folder}/{name}"], "docs": [len(out.docs)], "ids": [out.n_ids]})

    ordered = doc_columns(docs).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = written(ordered.mapInArrow(tidy(write, "encoder"), "part long, path string, docs long, ids long"), "manifest")
    return [(r.path, r.docs, r.ids) for r in sorted(manifest.collect(), key=lambda r: r.part)]


def read_corpus(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files alone."""
    rows, base = [], 0
    for path, _, ids in files:
        rows.append((path, base))
        base += ids

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as stream:
                    found: list[tuple] = []
                    for doc, start, ids in bitfile.Reader(stream, stream.size()):
                        found.append((doc, base + start, len(ids), bitfile.crc(ids)))
                        if len(found) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            found = []
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return listed.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
