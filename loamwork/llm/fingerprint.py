"""Canonical exact digests of documents, in DataFrame functions only.

A text's canonical form is NFKC, full case folding, NFKC again, white space folded to single blanks and
trimmed. Its bucket is two differently seeded xxhash64 values. Inside buckets that hold more than one text,
the canonical forms are compared byte for byte; a bucket in which they differ is *mixed*, and the
fingerprints of its texts carry a SHA-256 as well. So two fingerprints are equal exactly when the canonical
bytes are equal.

Scale: one range exchange of the texts (for each document's successor, without a global window), and one
exchange of those texts only whose bucket is repeated, collapsed on the map side first, so that a hot group
of copies arrives as one row per task. Which buckets are repeated or mixed travels as a bitmap over hash
slots whose size is bounded by MAX_SLOTS bits whatever the input; slots that coincide only send more texts
to the comparison, or give a longer fingerprint to all equal texts alike.

Defined cases: null text is empty; a null doc_id sorts first and stays null; rows with one doc_id follow
each other by text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.llm.shared import doc_columns

#: The smallest and largest number of bits of a slot bitmap (32 MB), and documents a bucket of the order.
MIN_SLOTS, MAX_SLOTS, SLOTS_PER_DOC = 1 << 15, 1 << 28, 64
DOCS_PER_RANGE, MAX_RANGES = 5_000, 16_384
_FIRST = -(1 << 63)


def canonical(text: Column) -> Column:
    """The canonical form; ASCII texts take the short way, which gives the same bytes."""
    icu = lambda x, kind, method: F.reflect(F.lit(kind), F.lit(method), x, F.lit(True))
    nfkc = lambda x: icu(x, "com.ibm.icu.text.Normalizer", "compose")
    folded = nfkc(icu(nfkc(text), "com.ibm.icu.lang.UCharacter", "foldCase"))
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)
    return F.trim(F.regexp_replace(plain, "[\\s\\x{85}\\x{1680}\\x{2028}\\x{2029}]+", " "))


def _hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(11), text), F.xxhash64(F.lit(17), text)


def _digest(h1: Column, h2: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (h1, h2)))


def _bounds(keys: DataFrame, ranges: int) -> list[int]:
    """Sorted keys that occur, the smallest first, which cut the table into about equal ranges."""
    shares = F.array(*[F.lit(i / ranges) for i in range(1, max(2, ranges))])
    low, cuts = keys.agg(F.min("key"), F.percentile_approx("key", shares, max(10_000, 10 * ranges))).first()
    return [] if low is None else sorted({low, *cuts}) if ranges > 1 else [low]


def _range_of(key: Column, bounds: list[int]) -> tuple[Column, Column]:
    """The range that holds key, and the range's first key: a search in two steps of about the root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    coarse = F.size(F.filter(longs([p[0] for p in parts]), lambda x: x <= key))
    part = F.element_at(F.array(*(longs(p) for p in parts)), coarse)
    fine = F.size(F.filter(part, lambda x: x <= key))
    return (coarse - 1) * step + fine - 1, F.element_at(part, fine)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text and next_text, the text of the next document in ascending doc_id; after the last comes the first.

    Each range of ids also gets the first row of the range after it, so no range waits for another.
    """
    spark = docs.sparkSession
    keyed = doc_columns(docs).withColumn("key", F.coalesce("doc_id", F.lit(_FIRST)))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("key"))
    n = ids.count()
    wide = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // DOCS_PER_RANGE))
    bounds = _bounds(ids, ranges or max(1, min(wide, MAX_RANGES, n)))
    if not bounds:
        return keyed.select("doc_id", "text", F.col("text").alias("next_text"))
    at, first = _range_of(F.col("key"), bounds)
    place = lambda r, tail: F.struct(r.cast("int").alias("range"), F.lit(tail).alias("tail"))
    places = F.when(F.col("key") == F.col("first"), F.array(place(F.col("at"), 0), place(F.pmod(F.col("at") - 1, F.lit(len(bounds))), 1))).otherwise(F.array(place(F.col("at"), 0)))
    dealt = keyed.withColumns({"at": at, "first": first}).select("doc_id", "text", "key", F.explode(places).alias("p")).select("doc_id", "text", "key", "p.range", "p.tail")
    order = Window.partitionBy("range").orderBy("tail", "key", "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("tail = 0").select("doc_id", "text", "next_text")


def _slots(keys: DataFrame, slots: int) -> DataFrame:
    """Bitmap rows (slot_page, slot_bits) of the h1 values in keys: at most slots / 32768 rows of 4 KB."""
    slot = F.pmod("h1", F.lit(slots))
    return keys.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("slot_page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("slot_bits"))


def _marked(rows: DataFrame, marks: DataFrame, h: str, slots: int, flag: str) -> DataFrame:
    """rows with flag: whether the slot of column h is set in marks."""
    page, position = f"{flag}_page", F.bitmap_bit_position(F.pmod(h, F.lit(slots))).cast("int")
    small = F.broadcast(marks.select(F.col("slot_page").alias(page), F.col("slot_bits").alias(f"{flag}_bits")))  # at most MAX_SLOTS bits
    byte = F.conv(F.hex(F.substring(F.col(f"{flag}_bits"), F.shiftright(position, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, position % 8).bitwiseAND(F.lit(1)) == 1
    joined = rows.join(small, F.bitmap_bucket_number(F.pmod(h, F.lit(slots))) == F.col(page), "left")
    return joined.withColumn(flag, F.coalesce(is_set, F.lit(False))).drop(page, f"{flag}_bits")


def fingerprints(pairs: DataFrame, columns: list[str], slots: int, hashes=_hashes) -> DataFrame:
    """Adds <c>_fp, <c>_h1, <c>_h2 for each canonical text column c, resolved by byte comparison over all of them."""
    out = pairs
    for c in columns:
        h1, h2 = hashes(F.col(c))
        out = out.withColumns({f"{c}_h1": h1, f"{c}_h2": h2})
    entries = lambda *more: F.explode(F.array_compact(F.array(*(
        # a text that equals the row's first one needs no second entry
        F.when(F.lit(i == 0) | (F.col(c) != F.col(columns[0])), F.struct(F.col(f"{c}_h1").alias("h1"), F.col(f"{c}_h2").alias("h2"), *(F.col(c).alias(m) for m in more))) for i, c in enumerate(columns)))))
    repeated = out.select(entries().alias("e")).select("e.*").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wide = _marked(out.select(entries("canon").alias("e")).select("e.*"), _slots(repeated, slots), "h1", slots, "seen").where("seen")
    texts = wide.groupBy("h1", "h2", "canon").agg(F.lit(1).alias("one"))  # the byte comparison
    mixed = _slots(texts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), slots)
    for c in columns:
        short = _digest(F.col(f"{c}_h1"), F.col(f"{c}_h2"))
        out = _marked(out, mixed, f"{c}_h1", slots, f"{c}_mixed")
        out = out.withColumn(f"{c}_fp", F.when(F.col(f"{c}_mixed"), F.concat(short, F.lit("-"), F.sha2(c, 256))).otherwise(short))
    return out


def fingerprint(docs: DataFrame, slots: int | None = None, hashes=_hashes) -> DataFrame:
    """doc_id, fingerprint of every row of docs."""
    slots = slots or slots_for(docs.count())
    canon = doc_columns(docs).select("doc_id", canonical(F.col("text")).alias("canon"))
    return fingerprints(canon, ["canon"], slots, hashes).select("doc_id", F.col("canon_fp").alias("fingerprint"))


def slots_for(n: int) -> int:
    return min(MAX_SLOTS, max(MIN_SLOTS, 1 << (SLOTS_PER_DOC * max(n, 1) - 1).bit_length()))


def edited_report(docs: DataFrame, ranges: int | None = None, slots: int | None = None, hashes=_hashes) -> DataFrame:
    """The fingerprint of every text and of its edited text: its last half replaced from the next document.

    Likeness of two exact digests is 1.0 for equal canonical bytes and 0.0 otherwise.
    """
    n = F.col("n_chars")
    half = F.call_function("div", n, F.lit(2)).cast("int")
    both = with_next(docs, ranges).withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("next_text", F.lit(1), half)))
    texts = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("text_c"), canonical(F.col("edited")).alias("edit_c"), canonical(F.col("next_text")).alias("next_c"))
    like = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    texts = texts.select("*", like("text_c", "edit_c").alias("near_edited"), like("text_c", "next_c").alias("near_next")).drop("next_c")
    out = fingerprints(texts, ["text_c", "edit_c"], slots or slots_for(docs.count()), hashes)
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("text_c_fp").alias("fingerprint"), F.col("edit_c_fp").alias("edited_fingerprint"), "near_edited", "near_next")
