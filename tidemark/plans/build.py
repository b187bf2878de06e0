"""Causal builds: every version that a derived item had, as information arrived.

A transform that looks at one row alone is evaluated once per input version, in one plan, and the changes are
read off a window over each key's versions. Anything else is evaluated at each information boundary.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.identity import comparable, rows_not_in, withdrawn
from tidemark.functions.types import union_relaxed
from tidemark.operators.transforms import has_duplicates
from tidemark.operators.versions import input_snapshot, keep_last
from tidemark.sources.shared import keep_written

#: Boundaries whose rows are written together.
GROUP = 16
IDENTITY = ("time", "asset_id", "value", "observation_date", "available_date", "_build_baseline")


def pointwise_versions(items: DataFrame, step: Callable[[DataFrame], DataFrame], *, drops: bool = False) -> DataFrame:
    """Versions of ``step`` of an item, for a step that maps each row alone. drops: it may remove rows, whose keys
    are then withdrawn (a null value) if they had a value before."""
    known = [F.col(c) for c in ("time", "available_date", "version_available_date") if c in items.columns]
    stamped = items.withColumn("version_available_date", F.greatest(*known) if len(known) > 1 else known[0])
    # one shuffle by (time, asset_id) serves both windows: the first is over a longer key
    last = keep_last(stamped.repartition("time", "asset_id"), ["time", "asset_id", "version_available_date"], ["version_available_date", "ingested_at", "_commit_seq"])
    made = step(last)
    if drops:
        key = ["time", "asset_id", "version_available_date"]
        made = last.select(*key).join(made.withColumn("_there", F.lit(True)), key, "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    else:
        made = made.withColumn("_there", F.lit(True))
    fields = [c for c in ("value", "observation_date", "available_date") if c in made.columns]
    same = comparable(made, fields)
    w = Window.partitionBy("time", "asset_id").orderBy("version_available_date")
    made = made.withColumn("_now", F.struct("_there", *[c.alias(f"f{i}") for i, c in enumerate(same.values())]))
    made = made.withColumn("_before", F.lag("_now").over(w))
    changed = F.when(F.col("_before").isNull(), F.col("_there")).otherwise(~F.col("_now").eqNullSafe(F.col("_before")) & (F.col("_there") | F.col("_before._there")))
    return made.where(changed).drop("_now", "_before", "_there")


def revision_dates(frames: Sequence[DataFrame], start: date, end: date) -> list[date]:
    """The days after start on which an input changed its past (A14): a small set, a day each."""
    found: set[date] = set()
    for f in frames:
        if "version_available_date" in f.columns:
            days = f.where(F.col("version_available_date") > F.col("time")).select(F.col("version_available_date").alias("d"))
        elif "source_time" in f.columns:
            days = f.where(F.col("time") > F.col("source_time")).select(F.col("time").alias("d"))
        elif "snapshot_date" in f.columns:
            days = f.where(~F.coalesce(F.col("_baseline"), F.lit(False))).select(F.col("snapshot_date").alias("d"))
        else:
            continue
        found |= {r[0] for r in days.where((F.col("d") > F.lit(start)) & (F.col("d") <= F.lit(end))).distinct().collect()}
    return sorted(found)


def _boundaries(raw: dict[str, DataFrame], items: dict[str, DataFrame], start: date, end: date, evaluate: Callable[[dict, dict], DataFrame], *, extra_boundaries: Sequence[date] = (), keys: dict[str, list[str]] | None = None):
    """(boundary, changed rows, whole evaluation): the changed rows need the evaluation, and the one before it, cached."""
    if end < start:
        raise ValueError("end precedes start")
    days = sorted({*revision_dates([*raw.values(), *items.values()], start, end), *(d for d in extra_boundaries if start < d <= end)})
    previous = None
    for at, following in zip([None, *days], [*days, None], strict=True):
        cutoff = following - timedelta(days=1) if following else end
        frame = evaluate({k: input_snapshot(v, cutoff, (keys or {}).get(k)) for k, v in raw.items()}, {k: input_snapshot(v, cutoff) for k, v in items.items()})
        stamps: list[Column] = [F.col("time"), F.col("available_date") if "available_date" in frame.columns else F.col("time"), F.lit(at) if at else F.col("time")]
        frame = frame.withColumn("version_available_date", F.greatest(*stamps)).persist()
        if has_duplicates(frame, ["time", "asset_id"]):
            frame.unpersist()
            raise ValueError(f"the producer gives an asset two values on one day, as known at {cutoff}")
        changed = frame
        if previous is not None:
            identity = [c for c in IDENTITY if c in previous.columns]
            changed = frame.join(rows_not_in(frame, previous, identity).select("time", "asset_id"), ["time", "asset_id"], "left_semi")
            lost = withdrawn(previous, frame, ["time", "asset_id"])
            lost = lost.withColumns({"value": F.lit(None).cast(previous.schema["value"].dataType), "version_available_date": F.greatest(F.col("time"), F.lit(at))})
            changed = union_relaxed(changed, lost)
        previous = frame
        yield at, changed.where(F.col("time").between(F.lit(start), F.lit(end)) & (F.col("version_available_date") <= F.lit(end))), frame


def computed_versions(raw: dict[str, DataFrame], items: dict[str, DataFrame], start: date, end: date, evaluate: Callable[[dict, dict], DataFrame], **options):
    """Yields (boundary, changed rows) in order: what the evaluation newly says, and nulls for keys that it lost. Rows are
    to be used before the next but one is asked for: an evaluation is released once it isn't needed."""
    held: list[DataFrame] = []
    try:
        for at, changed, frame in _boundaries(raw, items, start, end, evaluate, **options):
            held.append(frame)
            yield at, changed
            for old in held[:-2]:
                old.unpersist()
            held = held[-2:]
    finally:
        for frame in held:
            frame.unpersist()


def compute_versions(raw: dict[str, DataFrame], items: dict[str, DataFrame], start: date, end: date, evaluate: Callable[[dict, dict], DataFrame], group: int = GROUP, **options) -> DataFrame:
    """All causal versions in one frame; of those with one key and date the later boundary's stays (V13). Boundaries are
    evaluated ``group`` at a time; each group's rows are written and its evaluations released, so that neither the plan nor
    the cache grows with the number of boundaries."""
    written: list[DataFrame] = []
    parts: list[DataFrame] = []
    held: list[DataFrame] = []

    def write() -> None:
        nonlocal held
        rows = reduce(union_relaxed, parts)
        written.append(keep_written(rows, "versions"))
        parts.clear()
        for old in held[:-1]:  # the last is what the next boundary is compared with
            old.unpersist()
        held = held[-1:]

    try:
        for i, (_, changed, frame) in enumerate(_boundaries(raw, items, start, end, evaluate, **options)):
            held.append(frame)
            parts.append(changed.withColumn("_boundary", F.lit(i)))
            if len(parts) >= group:
                write()
        if parts:
            write()
    finally:
        for frame in held:
            frame.unpersist()
    every = reduce(union_relaxed, written)
    return keep_last(every, ["time", "asset_id", "version_available_date"], ["_boundary"]).drop("_boundary")
