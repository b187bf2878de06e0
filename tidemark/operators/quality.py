"""Checks of keys, responses and stored data (A8-A12, Q1-Q5), and changed intervals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import key_date, lenient_date
from tidemark.functions.identity import multiset_diff, row_hash


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in more than one row; nulls group together."""
    return df.groupBy(*keys).count().where("count > 1")


def conflicts(df: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Keys with different payloads: rows, distinct payloads and the differing fields (A8, Q3). Null is a value."""
    hashed = df.withColumn("_hash", row_hash(df, payload))
    differs = [F.when((F.min(row_hash(df, [c])) != F.max(row_hash(df, [c]))), F.lit(c)) for c in payload]
    found = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), F.min("_hash").alias("_a"), F.max("_hash").alias("_b"), F.array_compact(F.array(*differs)).alias("differing_fields"))
    return found.where("_a <> _b").drop("_a", "_b")


def key_problems(df: DataFrame, keys: list[str], nullable: list[str] = ()) -> list[str]:
    """Missing key columns, and those with nulls."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        return [f"missing key column: {k}" for k in missing]
    need = [k for k in keys if k not in nullable]
    nulls = df.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in need]).first() if need else {}
    return [f"null key values: {k} ({nulls[k]})" for k in need if nulls[k]]


def response_problem(df: DataFrame, *, date_field: str, start: date, end: date, assets: list[str] | None = None, payload: list[str] = ()) -> str | None:
    """The first thing wrong with a provider's response, from one pass over it (Q2)."""
    for c in ("asset_id", date_field):
        if c not in df.columns:
            return f"missing key column: {c}"
    day = lenient_date(F.col(date_field), df.schema[date_field].dataType)
    checks = [F.count_if(F.col("asset_id").isNull() | F.col(date_field).isNull()).alias("null keys"), F.count_if(day.isNull() & F.col(date_field).isNotNull()).alias("invalid dates"), F.count_if(~day.between(F.lit(start), F.lit(end))).alias("dates outside the request")]
    if assets is not None:
        checks.append(F.count_if(~F.col("asset_id").isin(assets)).alias("assets outside the request"))
    row = df.agg(F.count(F.lit(1)).alias("_n"), *checks, *[F.count(F.col(c)).alias(f"_p_{c}") for c in payload]).first().asDict()
    for name, n in row.items():
        if not name.startswith("_") and n:
            return f"{name}: {n}"
    if row["_n"] and payload and not any(row[f"_p_{c}"] for c in payload):
        return "all payload values are null"
    return None


def item_problems(df: DataFrame) -> list[str]:
    """What an item's rows may not have (Q4)."""
    row = df.agg(F.count_if(F.col("time").isNull()).alias("null time"), F.count_if(F.col("asset_id").isNull() | (F.trim("asset_id") == "")).alias("blank asset_id"), F.count_if(F.col("available_date") < F.col("observation_date")).alias("availability before observation")).first().asDict()
    out = [f"{k}: {n}" for k, n in row.items() if n]
    keys = ["time", "asset_id", *(["version_available_date"] if "version_available_date" in df.columns else [])]
    n = duplicate_keys(df, keys).count()
    return [*out, *([f"duplicate version keys: {n}"] if n else [])]


def bounds(df: DataFrame, observed: str = "source_time", available: str = "time") -> DataFrame:
    """Row count, bounds of both dates and the longest delay between them (A10, K5)."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.min(observed).alias("min_observation"), F.max(observed).alias("max_observation"), F.min(available).alias("min_availability"), F.max(available).alias("max_availability"), F.max(F.datediff(available, observed)).alias("max_delay_days"))


def health(df: DataFrame, keys: list[str], available: str = "time") -> DataFrame:
    """Counts per availability month: rows, null keys, duplicate keys, rows outside their partition (Q5)."""
    month = F.date_format(available, "yyyy-MM")
    per_key = df.groupBy(month.alias("month"), *keys).agg(F.count(F.lit(1)).alias("n"))
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    return per_key.groupBy("month").agg(F.sum("n").alias("row_count"), F.sum(F.when(null_key, F.col("n")).otherwise(0)).alias("null_key_rows"), F.sum((F.col("n") > 1).cast("bigint")).alias("duplicate_keys"))


def merge_days(intervals: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Inclusive day intervals merged where they overlap or touch (T11): gaps and islands. Intervals of one first day are
    one interval before that, so that the single ordered pass is over days, however many intervals there are."""
    intervals = intervals.groupBy(start).agg(F.max(end).alias(end))
    w = Window.partitionBy(F.lit(0)).orderBy(start)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = (before.isNull() | (F.col(start) > F.date_add(before, 1))).cast("int")
    return intervals.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(w)).groupBy("_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def changed_intervals(old: DataFrame, new: DataFrame, columns: list[str], begin: str, until: str, first: date, last: date) -> DataFrame:
    """Days on which the members of half-open intervals differ between two snapshots: (start, end), merged (T11). A null
    ``until`` is open; any other date of a changed row that can't be read is refused, here, before anything is merged."""
    diff = multiset_diff(old, new, columns)
    start, stop = key_date(F.col(begin)), key_date(F.col(until))
    unread = diff.where(start.isNull() | (stop.isNull() & F.col(until).isNotNull())).first()
    if unread is not None:
        raise ValueError(f"a changed row has no readable interval: {begin}={unread[begin]!r}, {until}={unread[until]!r}")
    start = F.greatest(start, F.lit(first))
    end = F.least(F.coalesce(F.date_sub(stop, 1), F.lit(last)), F.lit(last))
    return merge_days(diff.select(start.alias("start"), end.alias("end")).where(F.col("start") <= F.col("end")))


def added_keys(old: DataFrame, new: DataFrame, key: str = "asset_id") -> DataFrame | None:
    """Rows of the keys that new adds, if it changes nothing else; else None."""
    columns = sorted(old.columns)
    if sorted(new.columns) != columns:
        return None
    retained = new.join(old.select(key).distinct(), key, "left_semi")
    if not multiset_diff(old, retained, columns).isEmpty():
        return None
    return new.join(old.select(key).distinct(), key, "left_anti")
