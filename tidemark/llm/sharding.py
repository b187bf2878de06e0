"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` arcs of a ring of 2**16 cells. A row's key hash names its cell, so its arc and home
shard. A shard takes at most its bound; what an arc's shard can't take walks clockwise to the next arc whose
shard has room. The bounds are the row count shared out evenly (floor or ceiling), so counts are at most one
apart (law ``rows``), and only the overflow, a few per cent, leaves its home shard.

Distribution: arcs are counted by an aggregate, the (bounded: shards x vnodes) counts are walked once on the
driver into at most arcs + shards x 2 pieces (arc, first rank, shard, first slot), and rows find their piece by
their rank in the arc. Arcs are a few thousand, of about equal size, whatever the sources or copies are.

Defined cases: a null text has size 8 and the crc of no bytes; null and repeated ids are placed like others
(key: id, text checksum and size); ties in an arc are equal rows; an empty table gives an empty result; columns
besides id and text aren't read.
"""

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import materialize

SHARDS, VNODES, CELLS = 24, 128, 1 << 16


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(last cell, shard) of each arc, clockwise. A vnode's place depends on its shard's number alone."""
    taken: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % CELLS
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = s
    return sorted(taken.items())


def bounds(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(arcs: list[tuple[int, int]], counts: dict[int, int], limits: list[int]) -> list[tuple[int, int, int, int]]:
    """Pieces (arc, first rank, shard, first slot). Home keys go first; the rest continue clockwise."""
    used, pieces, over = [0] * len(limits), [], []
    for i, (_, shard) in enumerate(arcs):
        n = counts.get(i, 0)
        fits = min(n, limits[shard] - used[shard])
        if fits:
            pieces.append((i, 0, shard, used[shard]))
            used[shard] += fits
        if n > fits:
            over.append([i, fits, n])
    # two laps: what waits when the walk passes the end meets the arcs before its own
    waiting: list[list[int]] = []
    at = 0
    for lap in range(2):
        for i, (_, shard) in enumerate(arcs):
            if lap == 0 and at < len(over) and over[at][0] == i:
                waiting.append(over[at])
                at += 1
            while waiting and used[shard] < limits[shard]:
                arc, first, last = waiting[0]
                fits = min(last - first, limits[shard] - used[shard])
                pieces.append((arc, first, shard, used[shard]))
                used[shard] += fits
                waiting[0][1] += fits
                if waiting[0][1] == last:
                    waiting.pop(0)
    return pieces


def shard_rows(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, home_shard) for each row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    arcs = ring(shards, vnodes)
    of_cell, k = [], 0
    for cell in range(CELLS):
        if k < len(arcs) and cell > arcs[k][0]:
            k += 1
        of_cell.append((cell, k % len(arcs), arcs[k % len(arcs)][1]))
    cells = spark.createDataFrame(of_cell, "cell int, arc int, home_shard int")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("spot", F.xxhash64("doc_id", "text_crc32", "size"))
    rows = rows.withColumn("cell", F.pmod(F.col("spot"), F.lit(CELLS)).cast("int")).join(F.broadcast(cells), "cell").drop("cell")
    rows = materialize(rows, "shards")
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most shards x vnodes rows
    pieces = walk(arcs, counts, bounds(sum(counts.values()), shards))
    by_arc: dict[int, list] = {}
    for arc, first, shard, slot in sorted(pieces):
        by_arc.setdefault(arc, []).append((first, shard, slot))
    plan = spark.createDataFrame(list(by_arc.items()), "arc int, pieces array<struct<first: bigint, shard: int, slot: bigint>>")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("spot", "doc_id", "text_crc32", "size")) - 1)
    own = F.element_at(F.filter("pieces", lambda p: p["first"] <= F.col("rank")), -1)
    placed = ranked.join(F.broadcast(plan), "arc").withColumn("own", own)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("own.shard").alias("shard"),
        (F.col("own.slot") + F.col("rank") - F.col("own.first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home_shard",
    )


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
