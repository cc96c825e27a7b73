"""What the operators share: table reading, and tables written to the folder that all executors see."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix=f"loamwork-{application}-")


class _Paths(threading.local):
    """Paths that this thread has written, in order; ``drop_since`` deletes them."""

    def __init__(self):
        self.all: list[str] = []


_paths = _Paths()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; only where that is unset and Spark is local, in a folder of this session's own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_folder(spark.sparkContext.applicationId)
    _paths.all.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _paths.all[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read back from the shared folder: later steps don't depend on lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the list of written tables, for ``drop_since``."""
    return len(_paths.all)


def drop_since(spark: SparkSession, place: int = 0, *kept: DataFrame) -> None:
    """Deletes the tables that this thread has written since mark() gave ``place``, but for those that ``kept`` read.

    Operators return frames that read such tables, so call it when their rows have been saved elsewhere.
    """
    needed = {f.split("/")[-2] for df in kept for f in df.inputFiles()}  # the tables' names are unique
    stay = []
    for path in _paths.all[place:]:
        if path.rsplit("/", 1)[-1] in needed:
            stay.append(path)
            continue
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _paths.all[place:] = stay


#: Narrow rows that are broadcast at most; parts of a frame's rows that one task of a lookup gets; rows of which no key is split.
BROADCAST_ROWS, PARTS, FEW = 500_000, 500, 10_000


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df as a broadcast side if its rows are counted to be few, else as it is."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def salts_of(sizes: DataFrame, keys: list[str], total: int, parts: int = PARTS) -> Column:
    """Into how many parts each row's key is split: 1, or for keys with more than a ``parts``-th of total rows so many that each part has about that.

    ``sizes`` has the rows of each key as _n. At most ``parts`` keys are hot, and these alone are collected.
    """
    hot = sizes.where((F.col("_n") * parts > total) & (F.col("_n") > 1)).select(F.xxhash64(*keys).alias("code"), F.ceil(F.col("_n") * parts / F.lit(max(1, total))).cast("int").alias("salts"))
    found = {0: 1} | {r.code: r.salts for r in hot.collect()}  # parts rows at most; codes may clash: both sides of a join split by code
    code = F.xxhash64(*keys)
    return F.when(code.isin(list(found)), F.element_at(F.create_map(*(F.lit(x) for kv in found.items() for x in kv)), code)).otherwise(1)


def lookup(left: DataFrame, right: DataFrame, key: str | list[str], spread: str, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """left joined with right, whose key is unique, by a shuffle that splits hot keys.

    A hot key's rows of left are dealt out by the column ``spread``, and right's row is copied to each part: at most
    2 * PARTS copies over all keys. ``sizes`` has the rows of each key as _n; without it left, which should be a written
    table then, is counted.
    """
    keys = [key] if isinstance(key, str) else key
    total = left.count() if sizes is None else sizes.agg(F.sum("_n")).first()[0] or 0
    if total <= FEW:
        return left.join(right, keys, how)
    salts = salts_of(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if sizes is None else sizes, keys, total, PARTS)
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")


def key_sizes(rows: DataFrame, *keys: str) -> DataFrame:
    """How many rows each key has, for ``lookup``: a written table."""
    return written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "sizes")


#: Bytes of an Arrow batch sent to a worker: whole texts are wide, and both sides hold some batches at a time.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches limited to BATCH_BYTES if they were larger."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(name)).rstrip("b")
    if not now.isdigit() or int(now) <= 0 or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers are used again by other stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def collect_garbage(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their garbage, so that heap that one stage's shuffles needed is returned before the next fills the workers.

    A task for each slot reaches every executor that is idle; one that is missed only keeps its heap.
    """
    slots = spark.sparkContext.defaultParallelism
    done = spark.range(0, slots, 1, slots).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")))
    done.write.format("noop").mode("overwrite").save()


#: What a worker process keeps from task to task, by the name of its user: functions that drop it.
_kept: dict[str, Callable[[], None]] = {}


def keep_for(user: str, drop: Callable[[], None]) -> None:
    """Registers in this worker what tasks of ``user`` keep; it is dropped when a task of anything else begins."""
    _kept[user] = drop


def begin(user: str | None) -> None:
    for name in [n for n in _kept if n != user]:
        _kept.pop(name)()
        give_back()


def tidy(function, user: str | None = None):
    """A function over Arrow batches that drops what tasks of other users keep, and gives freed memory back when its task ends.

    Tasks of a ``user`` that keeps tables leave this to the next operator's.
    """

    def run(batches):
        begin(user)
        try:
            yield from function(batches)
        finally:
            if user is None:  # else its tables stay, and there is little to give
                give_back()

    return run


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """doc_id as long and text (null: empty), by position in the frame's own columns whatever others there are."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *names)
