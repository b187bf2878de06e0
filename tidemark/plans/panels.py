"""Panels, versions and calendars made of the provided tables, for the catalogue of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source_time", "asset_id", "o_orderkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderdate").cast("date").alias("source_time"), F.col("o_custkey").cast("string").alias("asset_id"), "o_orderkey", F.col("o_totalprice").alias("value"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order, revised after 10 days where its key divides by 5, withdrawn after 30 where it divides by 10. One
    pass over the table: the revisions are an exploded array."""
    at = lambda days: F.date_add("source_time", days)
    row = lambda value, time, commit, baseline: F.struct(value.cast("double").alias("value"), time.alias("time"), F.lit(commit).cast("bigint").alias("_commit_seq"), F.lit(baseline).alias("_baseline"))
    first = row(F.col("value"), F.col("source_time"), 1, True)
    second = F.when(F.col("o_orderkey") % 5 == 0, row(F.col("value") * 2, at(10), 2, False))
    third = F.when(F.col("o_orderkey") % 10 == 0, row(F.lit(None), at(30), 3, False))
    v = obs(spark, sf_dir).select("source_time", "asset_id", "o_orderkey", F.inline(F.array_compact(F.array(first, second, third))))
    return v.withColumn("ingested_at", F.timestamp_seconds(F.col("_commit_seq") * 86400))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("time")).distinct()
    return days.withColumn("is_open", F.when(F.dayofweek("time").isin(1, 7), 0).otherwise(1))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value per user and day: the last event's."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("time"), F.col("user_id").cast("string").alias("asset_id"), "value", "ts", "event_id")
    return e.groupBy("time", "asset_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def panel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the panel x all users: the grid itself."""
    p = table(spark, sf_dir, "events")
    days = p.select(F.col("ts").cast("date").alias("time")).distinct()
    users = p.select(F.col("user_id").cast("string").alias("asset_id")).distinct()
    return users.crossJoin(F.broadcast(days))  # days: bounded by history


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per customer and day, available three days later."""
    o = obs(spark, sf_dir).groupBy("asset_id", F.col("source_time").alias("time")).agg(F.max_by("value", "o_orderkey").alias("value"))
    return o.withColumn("available_date", F.date_add("time", 3))


def order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's last open day x all customers: the grid itself."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("asset_id"))
    days = calendar(spark, sf_dir).where("is_open = 1").groupBy(F.trunc("time", "month")).agg(F.max("time").alias("time")).select("time")
    return users.crossJoin(F.broadcast(days))  # days: bounded by history


#: The same tables as SQL.
SQL = {
    "obs": "SELECT CAST(o_orderdate AS DATE) AS source_time, CAST(o_custkey AS VARCHAR) AS asset_id, o_orderkey, o_totalprice AS value FROM orders",
    "ver": """SELECT source_time, asset_id, o_orderkey, value, source_time AS time, CAST(1 AS BIGINT) AS _commit_seq, TRUE AS _baseline FROM obs
      UNION ALL SELECT source_time, asset_id, o_orderkey, value * 2, CAST(source_time + INTERVAL 10 DAY AS DATE), 2, FALSE FROM obs WHERE o_orderkey % 5 = 0
      UNION ALL SELECT source_time, asset_id, o_orderkey, NULL, CAST(source_time + INTERVAL 30 DAY AS DATE), 3, FALSE FROM obs WHERE o_orderkey % 10 = 0""",
    "cal": "SELECT DISTINCT CAST(o_orderdate AS DATE) AS time, CASE WHEN dayofweek(CAST(o_orderdate AS DATE)) IN (0, 6) THEN 0 ELSE 1 END AS is_open FROM orders",
    "ses": "SELECT time AS session, CAST(row_number() OVER (ORDER BY time) - 1 AS INTEGER) AS idx FROM cal WHERE is_open = 1",
    "panel": "SELECT time, asset_id, value FROM (SELECT CAST(ts AS DATE) AS time, CAST(user_id AS VARCHAR) AS asset_id, value, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "pgrid": "SELECT d.time, CAST(u.user_id AS VARCHAR) AS asset_id FROM (SELECT DISTINCT CAST(ts AS DATE) AS time FROM events) d CROSS JOIN (SELECT DISTINCT user_id FROM events) u",
    "oev": "SELECT time, asset_id, value, CAST(time + INTERVAL 3 DAY AS DATE) AS available_date FROM (SELECT source_time AS time, asset_id, value, row_number() OVER (PARTITION BY source_time, asset_id ORDER BY o_orderkey DESC) AS rn FROM obs) WHERE rn = 1",
    "mses": "SELECT session, CAST(row_number() OVER (ORDER BY session) - 1 AS INTEGER) AS idx FROM (SELECT max(session) AS session FROM ses GROUP BY date_trunc('month', session))",
    "ogrid": "SELECT s.session AS time, CAST(c.c_custkey AS VARCHAR) AS asset_id, s.idx FROM mses s CROSS JOIN customer c",
}
NEEDS = {"ver": ["obs"], "ses": ["cal"], "oev": ["obs"], "mses": ["cal", "ses"], "ogrid": ["cal", "ses", "mses"]}


def with_tables(names: list[str], sql: str) -> str:
    """sql after the definitions of the named tables and of what they need."""
    order: list[str] = []
    for name in names:
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + " " + sql
