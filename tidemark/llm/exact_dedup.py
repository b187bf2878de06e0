"""Exact dedup by two-pass Bloom filtering. DataFrame functions only.

Pass 1 makes a counting Bloom filter of the text hashes: each hash has two positions, positions are counted
with map-side partial sums (so copies of one text meet as one count per task), and those counted twice or
more become bits. Pass 2 tests each row where it lies: a row with a clear bit is certainly unique and goes straight
through; the others are shuffled by hash, where groups are counted exactly. False positives cost a shuffled
row, never a wrong answer.

What moves: pass 1 shuffles position counts (two of 16 bytes a distinct hash, less what a task already summed), never
a hash, an id or a text; pass 2 shuffles the rows that the filter holds to be repeated, and no others.

Filter size: ``bits_per_key`` times the rows, rounded up to a power of two, at most ``max_filter_bits``, broadcast as
4 KB bitmaps. More rows are taken in slices of the hash space, each with a filter of its own within that size. The
keyed rows are written once, each task's sorted by slice, so that a slice's scan skips the other slices' pages by
their statistics; each slice's result is appended to one table.

Defined cases: a null text equals the empty text; a null id is below every other id; of rows that share the largest
id and the text one is kept, and each counts in the group's size; an empty table gives an empty result; columns
named like a result are replaced by it.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import materialize, new_folder, release, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 16
MAX_FILTER_BITS = 1 << 28


def ascii_lower(col):
    """Lower-case A-Z only. An all-ASCII text takes Spark's own fast path."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def text_hash(col):
    text = F.coalesce(col, F.lit(""))
    return F.sha2(ascii_lower(text).cast("binary"), 256)


def filter_bits(rows: int, bits_per_key: int) -> int:
    return max(1 << 15, 1 << max(0, rows * bits_per_key - 1).bit_length())


def repeated_bitmaps(keyed: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap): the filter's positions that two or more hashes hit."""
    at = F.explode(F.array(_position(0, bits), _position(1, bits))).alias("pos")
    hit = keyed.select(at).groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return hit.groupBy(F.bitmap_bucket_number("pos").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bitmap"))


def _position(seed: int, bits: int):
    return F.pmod(F.xxhash64(F.col("text_sha256"), F.lit(seed)), F.lit(bits).cast("bigint")) + 1


def _set(bitmap, pos):
    """Whether ``pos`` is set in its bucket's bitmap (null: no bitmap, so it is clear)."""
    bit = F.bitmap_bit_position(pos)
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("getbit", byte, (bit % 8).cast("int")) == 1, F.lit(False))


def _marked(rows: DataFrame, id_col: str, bits: int) -> DataFrame:
    """rows: a written table with text_sha256 and __uid. Adds keep_id, group_size, kept."""
    bitmaps = F.broadcast(repeated_bitmaps(rows, bits))  # at most bits / 8 bytes
    tested = rows.withColumns({"__p0": _position(0, bits), "__p1": _position(1, bits)})
    for k in ("0", "1"):
        own = bitmaps.select(F.col("bucket").alias(f"__b{k}"), F.col("bitmap").alias(f"__m{k}"))
        tested = tested.join(own, F.bitmap_bucket_number(f"__p{k}") == F.col(f"__b{k}"), "left")
    held = _set(F.col("__m0"), F.col("__p0")) & _set(F.col("__m1"), F.col("__p1"))
    tested = tested.withColumn("__maybe", held).select(*[F.col(f"`{c}`") for c in rows.columns], "__maybe")
    alone = tested.where("not __maybe").drop("__maybe")
    alone = alone.withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("bigint"), "kept": F.lit(True)})
    maybe = tested.where("__maybe").drop("__maybe")
    groups = maybe.groupBy(F.col("text_sha256").alias("__key")).agg(F.max(F.struct(F.col(id_col).alias("id"), F.col("__uid").alias("uid"))).alias("__top"), F.count(F.lit(1)).alias("group_size"))
    # written first, so that both sides of the join are plain exchanges and a large group's rows can be split
    met = maybe.join(materialize(groups, "groups"), F.col("text_sha256") == F.col("__key"))
    met = met.withColumns({"keep_id": F.col("__top.id"), "kept": F.col("__uid") == F.col("__top.uid")}).select(*alone.columns)
    return alone.unionByName(met).drop("__uid")


def mark_duplicates(keyed: DataFrame, id_col: str, bits_per_key: int = BITS_PER_KEY, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``keyed`` has ``text_sha256``; adds keep_id, group_size, kept. Other columns pass through."""
    rows = keyed.count()
    slices = max(1, -(-rows * bits_per_key // max_filter_bits))
    bits = min(filter_bits(-(-rows // slices), bits_per_key), max(max_filter_bits, 1 << 15))
    # written with a number for each row, so that every later scan sees the same numbers
    keyed = keyed.withColumn("__uid", F.monotonically_increasing_id())
    if slices == 1:
        return _marked(materialize(keyed, "keyed"), id_col, bits)
    of = F.pmod(F.xxhash64("text_sha256", F.lit(2)), F.lit(slices)).cast("int")
    table = materialize(keyed.withColumn("__slice", of).sortWithinPartitions("__slice"), "keyed")
    path = new_folder(keyed.sparkSession, "marked")
    for k in range(slices):
        since = written()
        part = _marked(table.where(F.col("__slice") == k).drop("__slice"), id_col, bits)
        part.write.mode("append").parquet(path)
        release(since)
    return keyed.sparkSession.read.schema(part.schema).parquet(path)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256. Rows that are certainly unique aren't shuffled."""
    clean = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    return mark_duplicates(clean.withColumn("text_sha256", text_hash(F.col(text_col))), id_col, **options)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = mark_duplicates(docs.select("doc_id", text_hash(F.col("text")).alias("text_sha256")), "doc_id")
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
