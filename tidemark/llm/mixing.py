"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

Sources in code point order (null last) weigh 1, 2, 3, repeating. Their targets share all words by weight, none
above ``max_repeat`` times its source: with T all words, the target is least(max_repeat * S, x * weight) for the
one x at which targets sum to T, found in a running sum over sources sorted by S / weight.

Words of a source, its documents in seeded hash order, are cut into blocks of ``block`` words. The
T / block seats are dealt to sources by the highest quotients target / (2k + 1); a source holds at most
max_repeat seats per block. Candidates for the last seats lie near target / block, so only about six rows a
source compete: no row per block is ever made. Shard k of ``shards`` owns an even run of a source's blocks and gets an
integer quota of its seats in proportion (a running sum, rounded): each of the shard's blocks is taken
quota div blocks times, and quota mod blocks of them once more. Those are spread evenly from a seeded start, the order of
documents being random already, so that how many of a run of blocks are chosen has a closed form, and a document that
spans millions of blocks costs no more than one of a word. A document takes its words' share of its blocks.

As documents (``mixed_documents``) a share taken / size is a whole number of copies or the next. Shares are summed in
the order of (size class, bucket, size), largest first, and a document gets the whole numbers that its sum passes:
neighbours have about equal sizes, so what one rounds up the next rounds down, in words too, and a source keeps its
words but for about half its largest document.

Distribution: a source is dealt over hash buckets of about ``BUCKET_WORDS`` words were all words its own (their number
follows from the counted words); running positions are sums over (source, bucket) totals plus a running sum within one
bucket, so a source with a third of all rows is spread over as many tasks. A bucket's sort is bounded at any size.
Sums of shares are carried over (source, class), then (source, class, bucket) totals in the same way.

Defined cases: a null text has 0 words; null and repeated ids are ordinary rows; equal rows are tied and
interchangeable; sources without words have target 0; an empty table gives an empty result; other columns
aren't read.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import materialize

MAX_REPEAT, SEED, FINE, SHARDS = 3, 20, 1000, 24
#: Words of a hash bucket, and the least number of buckets.
BUCKET_WORDS, LEAST_BUCKETS = 1 << 21, 512
#: Shares are whole numbers of 1 / UNIT, so that their sums are exact; size classes are 1 / CLASSES of an octave.
UNIT, CLASSES = 1 << 24, 16
WORD = "[^\\x20\\x09-\\x0D]+"


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sizes: (source, source_size). Adds weight and target."""
    everything = Window.partitionBy(F.lit(0))
    s = sizes.withColumn("weight", (F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    filled = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumns({"cap_before": F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "weight_left": F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))})
    # the level if all before this source are full; the first source at which it is not above its own cap sets it
    s = s.withColumns({"level": (F.col("total") - F.col("cap_before")) / F.col("weight_left"), "place": F.row_number().over(filled)})
    s = s.withColumn("x", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(everything)["level"])
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("x"), F.lit(float("inf"))) * F.col("weight")))


def seat_quotas(targets: DataFrame, fine: int = FINE, max_repeat: int = MAX_REPEAT, block: int | None = None) -> DataFrame:
    """Adds block (words), blocks (of the source) and seats, by highest quotients."""
    everything = Window.partitionBy(F.lit(0))
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    width = F.greatest(F.lit(1), F.floor(smallest / fine), F.ceil(F.col("total") / (1 << 31))).cast("bigint")
    t = targets.withColumn("block", F.coalesce(F.lit(block).cast("bigint"), width, F.lit(1).cast("bigint")))
    t = t.withColumns({"blocks": F.ceil(F.col("source_size") / F.col("block")), "ideal": F.col("target") / F.col("block"), "house": F.round(F.col("total") / F.col("block")).cast("bigint"), "n": F.count(F.lit(1)).over(everything)})
    free = F.sum(F.when(F.col("target") < F.col("cap"), F.col("target"))).over(everything)
    most = F.col("blocks") * max_repeat
    # The divisor that fills the house moves no ideal by more than the shares below; seats under `sure` are certain.
    t = t.withColumn("sure", F.greatest(F.lit(0), F.least(most, F.ceil(F.col("ideal") - F.col("n") * F.try_divide(F.col("target"), 2 * F.col("total")) - 1.5))).cast("bigint"))
    top = F.when(F.col("target") >= F.col("cap"), most).otherwise(F.least(most, F.ceil(F.col("ideal") + 1.5 * F.col("n") * F.try_divide(F.col("target"), free) + 1.5))).cast("bigint")
    t = t.withColumn("last", top - 1).withColumn("open", F.col("house") - F.sum("sure").over(everything))
    bids = t.where("last >= sure").select("source", "open", F.explode(F.sequence("sure", "last")).alias("k"), "target")
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), F.col("source").asc_nulls_last(), "k")
    won = bids.withColumn("place", F.row_number().over(order)).where("place <= open").groupBy(F.col("source").alias("bidder")).agg(F.count(F.lit(1)).alias("won"))
    return t.join(won, F.col("source").eqNullSafe(F.col("bidder")), "left").withColumn("seats", F.col("sure") + F.coalesce("won", F.lit(0)))


def shard_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(source, shard, first, own_blocks, before, full, extra, phase): each shard's run of the source's blocks
    [first, first + own_blocks) and its integer quota, full * own_blocks + extra seats. before: the extras of earlier
    shards; phase: the seeded start of the choice. Quotas are the rounded running sum of seats in proportion to blocks."""
    each = quotas.select("source", "seats", "blocks", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    first = lambda k: F.floor(F.col("blocks") * k / shards).cast("bigint")
    more = F.coalesce(F.try_mod("seats", "blocks"), F.lit(0))
    upto = lambda k: F.coalesce(F.floor(F.try_divide(first(k) * more, F.col("blocks")) + 0.5), F.lit(0)).cast("bigint")
    k = F.col("shard")
    out = each.select("source", "shard", "seats", first(k).alias("first"), (first(k + 1) - first(k)).alias("own_blocks"), upto(k).alias("before"),
                      F.coalesce(F.floor(F.try_divide("seats", "blocks")), F.lit(0)).alias("full"), (upto(k + 1) - upto(k)).alias("extra"))
    start = F.coalesce(F.try_mod(F.abs(F.xxhash64("source", "shard", F.lit(seed)) % (1 << 30)), F.col("own_blocks")), F.lit(0))
    out = out.withColumn("phase", start.cast("bigint"))
    return out.withColumn("quota", F.col("full") * F.col("own_blocks") + F.col("extra"))


def _sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({"__id": F.col(id_col), "__source": F.col(source_col), "__size": F.regexp_count(text, F.lit(WORD)).cast("bigint"), "__mark": F.xxhash64(text)})
    return rows.withColumn("__spot", F.xxhash64("__id", "__mark", F.lit(seed)))


def _bucket(buckets: int):
    return F.pmod("__spot", F.lit(buckets)).cast("int")


def _bucket_count(narrow: DataFrame) -> int:
    return max(LEAST_BUCKETS, -(-(narrow.agg(F.sum("__size")).first()[0] or 0) // BUCKET_WORDS))


def _dealt(narrow: DataFrame, seed: int, shards: int, max_repeat: int, fine: int, block: int | None) -> tuple[DataFrame, DataFrame]:
    """narrow: at least __source, __bucket and __size of all rows. Written tables: where each (source, bucket) starts, and
    each source with its quotas."""
    totals = materialize(narrow.groupBy("__source", "__bucket").agg(F.sum("__size").alias("words")), "mix-totals")
    sizes = totals.groupBy(F.col("__source").alias("source")).agg(F.sum("words").alias("source_size"))
    quotas = materialize(seat_quotas(materialize(source_targets(sizes, max_repeat), "mix-targets"), fine, max_repeat, block).select("source", "source_size", "target", "block", "blocks", "seats"), "mix-quotas")
    dealt = shard_quotas(quotas, shards, seed).groupBy(F.col("source").alias("dealt")).agg(F.max("full").alias("full"), F.sort_array(F.collect_list(F.struct("shard", "first", "own_blocks", "before", "extra", "phase"))).alias("runs"))  # shards per source
    quotas = quotas.join(dealt, F.col("source").eqNullSafe(F.col("dealt")))
    quotas = quotas.select(*(F.col(c).alias(f"__{c}") for c in ("source_size", "target", "block", "blocks", "full", "runs")), F.col("source").alias("__whose"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(F.col("__source").alias("__of"), F.col("__bucket").alias("__of_bucket"), before.alias("__bucket_start"))
    return materialize(starts, "mix-starts"), materialize(quotas, "mix-sources")


def _taken(rows: DataFrame, starts: DataFrame, sources: DataFrame, shards: int) -> DataFrame:
    """rows with __source_size, __target and __taken, from what ``_dealt`` wrote."""
    order = Window.partitionBy("__source", "__bucket").orderBy("__id", "__mark", "__size")
    placed = rows.withColumn("__within", F.coalesce(F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(starts, F.col("__source").eqNullSafe(F.col("__of")) & (F.col("__bucket") == F.col("__of_bucket")))
    placed = placed.join(sources, F.col("__source").eqNullSafe(F.col("__whose")))
    start = F.col("__bucket_start") + F.col("__within")
    placed = placed.withColumns({"__from": _extra_words(start, shards), "__to": _extra_words(start + F.col("__size"), shards)})
    return placed.withColumn("__taken", F.when(F.col("__size") > 0, F.col("__size") * F.col("__full") + F.col("__to") - F.col("__from")).otherwise(F.lit(0)).cast("bigint"))


def _extra_words(at, shards: int):
    """Words before position ``at`` of the source that lie in blocks taken once more than the others."""
    block = F.col("__block")
    i = F.least(F.floor(at / block), F.col("__blocks") - 1).cast("bigint")
    # the shard whose run holds block i: runs begin at floor(blocks * shard / shards)
    shard = F.greatest(F.lit(0), F.ceil((i + 1) * F.lit(shards) / F.col("__blocks")).cast("int") - 1)
    run = F.element_at("__runs", shard + 1)
    passed = lambda k: F.floor((k * run["extra"] + run["phase"]) / run["own_blocks"])
    chosen = passed(i - run["first"])
    inside = (passed(i - run["first"] + 1) - chosen) * (at - i * block)
    return F.when(F.col("__blocks") > 0, (run["before"] + chosen) * block + inside).otherwise(F.lit(0)).cast("bigint")


def mix(docs: DataFrame, seed: int = SEED, shards: int = SHARDS, max_repeat: int = MAX_REPEAT, fine: int = FINE, block: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): words that the mix takes of each document."""
    rows = _sized(docs.select(id_col, text_col, source_col), seed, id_col, text_col, source_col)
    rows = materialize(rows.select("__id", "__source", "__size", "__mark", "__spot"), "mix")
    rows = rows.withColumn("__bucket", _bucket(_bucket_count(rows)))
    out = _taken(rows, *_dealt(rows, seed, shards, max_repeat, fine, block), shards)
    return out.select(*(F.col(f"__{c}").alias("doc_id" if c == "id" else c) for c in ("id", "source", "size", "source_size", "target", "taken")))


def _shared(taken: DataFrame) -> DataFrame:
    """Adds __share (of UNIT) and __class, which falls as sizes rise."""
    share = F.floor(F.try_divide(F.col("__taken") * F.lit(float(UNIT)), F.col("__size")) + 0.5)
    return taken.withColumns({"__share": F.coalesce(share, F.lit(0)).cast("bigint"), "__class": F.coalesce(-F.floor(F.log2("__size") * CLASSES), F.lit(1)).cast("int")})


def _share_groups(shared: DataFrame) -> DataFrame:
    return shared.groupBy("__source", "__class", "__bucket").agg(F.sum("__share").alias("shares"))


def _share_starts(groups: DataFrame) -> DataFrame:
    """(__in, __in_class, __in_bucket, __share_start): the source's shares before each (class, bucket)."""
    before = lambda keys, by: F.coalesce(F.sum("shares").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = groups.groupBy(F.col("__source").alias("__of_source"), F.col("__class").alias("__of_class")).agg(F.sum("shares").alias("shares"))
    classes = classes.select("__of_source", "__of_class", before(["__of_source"], "__of_class").alias("class_start"))
    starts = groups.withColumn("within", before(["__source", "__class"], "__bucket")).join(classes, F.col("__source").eqNullSafe(F.col("__of_source")) & (F.col("__class") == F.col("__of_class")))
    return starts.select(F.col("__source").alias("__in"), F.col("__class").alias("__in_class"), F.col("__bucket").alias("__in_bucket"), (F.col("class_start") + F.col("within")).alias("__share_start"))


def mixed_documents(docs: DataFrame, seed: int = SEED, shards: int = SHARDS, max_repeat: int = MAX_REPEAT, fine: int = FINE, block: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents, all columns: each as often as its words are taken, rounded up or down (so from 0 to
    max_repeat times) such that a source's words add up. Texts travel with the windows' shuffle."""
    rows = _sized(docs, seed, id_col, text_col, source_col)
    narrow = materialize(rows.select("__id", "__source", "__size", "__mark", "__spot"), "mix-narrow")
    bucket = _bucket(_bucket_count(narrow))
    rows, narrow = rows.withColumn("__bucket", bucket), narrow.withColumn("__bucket", bucket)
    dealt = _dealt(narrow, seed, shards, max_repeat, fine, block)  # once, for both uses
    groups = materialize(_share_groups(_shared(_taken(narrow, *dealt, shards))), "mix-groups")
    starts = materialize(_share_starts(groups), "mix-shares")
    shared = _shared(_taken(rows, *dealt, shards))
    order = Window.partitionBy("__source", "__bucket", "__class").orderBy(F.col("__size").desc(), "__id", "__mark", "__taken")
    shared = shared.withColumn("__shares", F.sum("__share").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = shared.join(starts, F.col("__source").eqNullSafe(F.col("__in")) & (F.col("__class") == F.col("__in_class")) & (F.col("__bucket") == F.col("__in_bucket")))
    upto = F.col("__share_start") + F.col("__shares")
    passed = lambda sums: F.floor((sums + UNIT // 2) / F.lit(UNIT))
    out = out.withColumn("__times", (passed(upto) - passed(upto - F.col("__share"))).cast("int"))
    return out.where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
