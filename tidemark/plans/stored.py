"""Queries that build a lake of the provided tables and read it back, and the same in SQL.

A scenario is a lake that is built once per session and data folder, from whole tables: revisions, checks that verify
unproven history, general snapshots, derived items, receipts. Each query reads one thing from it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, date, datetime
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import identity, types
from tidemark.operators import explore, quality
from tidemark.operators.transforms import Cast, Filter, Select
from tidemark.plans import panels as P
from tidemark.plans.build import revision_dates
from tidemark.sources.shared import scratch_lake
from tidemark.specs import DatasetSpec, ItemInput, ItemSpec, RawInput, UpdatePolicy

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, *tables: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = P.with_tables(list(tables), sql) if tables else sql
        return f

    return add


def at(year: int, month: int, day: int) -> datetime:
    return datetime(year, month, day, tzinfo=UTC)


# --- scenario: orders, revised twice and checked once
ORDERS = DatasetSpec("orders", "by_date", "shop", date_kind="calendar", primary_key_extra=("o_orderkey",), field_mappings={"day": "time", "cust": "asset_id"})
ORDER_COLUMNS = ["source_time", "asset_id", "o_orderkey", "value", "time", "_commit_seq", "_baseline"]


def _order_rows(spark: SparkSession, d: str) -> DataFrame:
    o = P.table(spark, d, "orders")
    return o.select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_custkey").cast("string").alias("cust"), "o_orderkey", F.col("o_totalprice").alias("value"))


@cache
def orders_lake(spark: SparkSession, d: str):
    """Commit 1: all orders as unproven history. Commit 2, 2011-02-01: doubled where the key divides by 5. Check 1,
    2011-03-01: every fourth order as it is stored. Commit 3, 2011-04-01: no value where the key divides by 10."""
    lake, rows = scratch_lake(spark), _order_rows(spark, d)
    lake.raw.register(ORDERS)
    lake.raw.ingest(ORDERS, rows, mode="initialize", ingested_at=at(2011, 1, 1))
    doubled = F.when(F.col("o_orderkey") % 5 == 0, F.col("value") * 2).otherwise(F.col("value"))
    lake.raw.ingest(ORDERS, rows.withColumn("value", doubled).where("o_orderkey % 5 = 0"), ingested_at=at(2011, 2, 1))
    lake.raw.ingest(ORDERS, rows.withColumn("value", doubled).where("o_orderkey % 4 = 0"), ingested_at=at(2011, 3, 1))
    lake.raw.ingest(ORDERS, rows.where("o_orderkey % 10 = 0").withColumn("value", F.lit(None).cast("double")), ingested_at=at(2011, 4, 1))
    lake.store.reject(ORDERS, "run", "null-key", rows.where("o_orderkey % 50 = 0").select("o_orderkey", F.lit(None).cast("string").alias("cust")))
    return lake


_STORED = """stored AS (SELECT source_time, asset_id, o_orderkey, value, source_time AS time, CAST(1 AS BIGINT) AS _commit_seq, TRUE AS _baseline FROM obs
  UNION ALL SELECT source_time, asset_id, o_orderkey, value * 2, DATE '2011-02-01', 2, FALSE FROM obs WHERE o_orderkey % 5 = 0
  UNION ALL SELECT source_time, asset_id, o_orderkey, NULL, DATE '2011-04-01', 3, FALSE FROM obs WHERE o_orderkey % 10 = 0),
every AS (SELECT *, 0 AS att FROM stored
  UNION ALL SELECT source_time, asset_id, o_orderkey, value, DATE '2011-03-01', 1, FALSE, 1 FROM stored WHERE _baseline AND o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0)"""
_TOP = "QUALIFY row_number() OVER (PARTITION BY source_time, asset_id, o_orderkey ORDER BY time DESC, _commit_seq DESC, att DESC) = 1"
_SHOWN = "source_time, asset_id, o_orderkey, value, time, _commit_seq, _baseline"


def _orders(name: str, where: str, after: str = "", top: str = _TOP, **options) -> None:
    QUERIES[name] = lambda spark, d: orders_lake(spark, d).raw.read("orders", source="shop", **options).select(*ORDER_COLUMNS)
    ORACLES[name] = P.with_tables(["obs"], f", {_STORED} SELECT {_SHOWN} FROM (SELECT * FROM every {where} {top}) {after}")


_orders("S1_store_versions", "", top="", view="versions")
_orders("T1_store_latest", "", view="latest")
_orders("T1_store_as_of", "WHERE time <= DATE '2011-02-15'", as_of="2011-02-15")
_orders("T1_store_strict", "WHERE time <= DATE '2011-03-10' AND NOT _baseline", as_of="2011-03-10", strict=True)
_orders("F6_store_history", "WHERE time <= source_time", view="history")
_orders("F8_store_max_commit", "WHERE _commit_seq <= 2", view="latest", max_commit=2)
_orders("S2_store_window", "WHERE source_time BETWEEN DATE '1996-01-01' AND DATE '1996-02-15'", view="latest", observation_start="1996-01-01", observation_end="1996-02-15")
_orders("F5_store_available", "", "WHERE time >= DATE '2011-03-01'", view="latest", start="2011-03-01")
_orders("S3_store_nothing", "WHERE source_time < DATE '1900-01-01'", view="latest", observation_end="1899-12-31")


@query("P16_store_fields", f", {_STORED} SELECT o_orderkey, value FROM (SELECT * FROM every {_TOP})", "obs")
def fields(spark, d):
    return orders_lake(spark, d).raw.read("orders", source="shop", view="latest", fields=["o_orderkey", "value"])


@query("P15_store_observations", f", {_STORED} SELECT time, asset_id, o_orderkey, value FROM (SELECT source_time AS time, asset_id, o_orderkey, value FROM (SELECT * FROM every {_TOP}))", "obs")
def observed(spark, d):
    return orders_lake(spark, d).raw.observations("orders", source="shop", view="latest").select("time", "asset_id", "o_orderkey", "value")


@query("S5_record_ids", "SELECT o_orderkey, sha256('source_time=date,asset_id=string,o_orderkey=bigint;v10:' || strftime(o_orderdate, '%Y-%m-%d') || 'v' || length(CAST(o_custkey AS VARCHAR)) || ':' || o_custkey || 'v' || length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey) AS record FROM orders")
def record_ids(spark, d):
    df = orders_lake(spark, d).raw.read("orders", source="shop", view="history")
    return df.select("o_orderkey", identity.row_hash(df, ORDERS.keys).alias("record"))


@query("K2_segments", f", {_STORED} SELECT _commit_seq AS seq, strftime(time, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS row_count, strftime(min(source_time), '%Y-%m-%d') AS min_obs, strftime(max(source_time), '%Y-%m-%d') AS max_obs, CAST(max(time - source_time) AS BIGINT) AS max_delay FROM stored GROUP BY 1, 2", "obs")
def segments(spark, d):
    rows = [(s["seq"], s["month"], s["row_count"], s["min_obs"], s["max_obs"], s["max_delay"]) for s in orders_lake(spark, d).raw.manifest("orders", source="shop")]
    return spark.createDataFrame(rows, "seq bigint, month string, row_count bigint, min_obs string, max_obs string, max_delay bigint")


@query("K6_commits", f", {_STORED} SELECT _commit_seq AS seq, CAST(count(*) AS BIGINT) AS row_count, CAST(bool_or(_baseline) AS BOOLEAN) AS baseline FROM stored GROUP BY 1", "obs")
def commits(spark, d):
    rows = [(c["seq"], c["row_count"], bool(c["baseline"])) for c in orders_lake(spark, d).meta.snapshot("shop", "orders")["commits"]]
    return spark.createDataFrame(rows, "seq bigint, row_count bigint, baseline boolean")


@query("K8_attested_keys", "SELECT CAST(o_orderdate AS DATE) AS source_time, CAST(o_custkey AS VARCHAR) AS asset_id, o_orderkey, CAST(1 AS BIGINT) AS version_commit, DATE '2011-03-01' AS available_date, CAST(1 AS BIGINT) AS check_id FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0")
def attested(spark, d):
    lake = orders_lake(spark, d)
    return lake.store.events("shop", "orders", lake.meta.snapshot("shop", "orders")).drop("checked_at")


@query("K9_rejected_rows", "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS cust, 'null-key' AS _reason, 'run' AS _run_id FROM orders WHERE o_orderkey % 50 = 0")
def rejected(spark, d):
    return orders_lake(spark, d).integrity.rejected("orders", source="shop")


@query("A13_summary", f", {_STORED} SELECT 'shop' AS source, 'orders' AS dataset, CAST(3 AS BIGINT) AS commits, CAST(count(*) AS BIGINT) AS rows, strftime(min(source_time), '%Y-%m-%d') AS first_observation, strftime(max(source_time), '%Y-%m-%d') AS last_observation FROM stored", "obs")
def summary(spark, d):
    return spark.createDataFrame([tuple(r.values()) for r in orders_lake(spark, d).integrity.summary()], "source string, dataset string, commits bigint, rows bigint, first_observation string, last_observation string")


@query("D18_status", f", {_STORED} SELECT 'orders' AS dataset, CAST(3 AS BIGINT) AS commits, CAST(count(*) AS BIGINT) AS rows, '2011-03-01' AS last_check FROM stored", "obs")
def status(spark, d):
    s = orders_lake(spark, d).raw.status("orders", source="shop")
    return spark.createDataFrame([(s["dataset"], s["commits"], s["rows"], s["last_check"][:10])], "dataset string, commits bigint, rows bigint, last_check string")


@query("T15_evidence", f", {_STORED} SELECT _commit_seq AS seq, CAST(count(*) AS BIGINT) AS rows FROM stored WHERE _commit_seq <= 2 GROUP BY 1", "obs")
def evidence(spark, d):
    found = orders_lake(spark, d).raw.version_evidence("orders", source="shop", as_of="2011-02-15")
    return spark.createDataFrame([(e["seq"], e["rows"]) for e in found], "seq bigint, rows bigint")


@query("Q5_scan", "SELECT 0 AS missing, 0 AS orphans, 0 AS damaged, 0 AS misfiled, 0 AS schemas, 0 AS bad_keys")
def scanned(spark, d):
    found = orders_lake(spark, d).integrity.scan("orders", source="shop", deep=True)
    names = ("missing", "orphans", "damaged", "misfiled", "schemas", "bad_keys")
    return spark.createDataFrame([tuple(x if isinstance(x := found[n], int) else len(x) for n in names)], ", ".join(f"{n} int" for n in names))


@query("K13_restored", f", {_STORED} SELECT {_SHOWN} FROM (SELECT * FROM every {_TOP})", "obs")
def restored(spark, d):
    lake = orders_lake(spark, d)
    copy = scratch_lake(spark)
    lake.files.delete(copy.path)
    backup = f"{copy.path}-backup"
    lake.integrity.backup(backup)
    other = lake.integrity.restore(spark, backup, copy.path, metadata=copy.meta.path)
    lake.files.delete(backup)
    return other.raw.read("orders", source="shop", view="latest").select(*ORDER_COLUMNS)


# --- receipts over the orders
def _receipt(spark, d, cutoff: str, max_commit: int | None = None):
    lake = orders_lake(spark, d)
    return lake, lake.inputs.freeze({"o": RawInput("shop", "orders")}, information_cutoff=cutoff, max_commit=max_commit)


@query("I3_frozen_latest", f", {_STORED} SELECT {_SHOWN} FROM (SELECT * FROM every WHERE time <= DATE '2011-05-01' AND _commit_seq <= 2 {_TOP})", "obs")
def frozen(spark, d):
    lake, receipt = _receipt(spark, d, "2011-05-01", 2)
    return lake.inputs.read(receipt, "o").select(*ORDER_COLUMNS)


@query("V2_frozen_versions", f", {_STORED} SELECT {_SHOWN} FROM every WHERE time <= DATE '2011-02-15'", "obs")
def frozen_versions(spark, d):
    lake, receipt = _receipt(spark, d, "2011-02-15")
    return lake.inputs.read(receipt, "o", view="versions").select(*ORDER_COLUMNS)


@query("I4_frozen_last_per_asset", f", {_STORED}, t AS (SELECT * FROM every WHERE time <= DATE '2011-02-15' {_TOP}) SELECT asset_id, max(source_time) AS time FROM t WHERE source_time <= DATE '1997-06-30' GROUP BY 1", "obs")
def frozen_last(spark, d):
    lake, receipt = _receipt(spark, d, "2011-02-15")
    return lake.inputs.latest(receipt, "o", through="1997-06-30").select("asset_id", "time")


@query("I13_equivalence", "SELECT TRUE AS before_the_revision, FALSE AS whole, TRUE AS current, TRUE AS later_is_current")
def equivalence(spark, d):
    lake, old = _receipt(spark, d, "2011-05-01", 2)
    new = lake.inputs.freeze({"o": RawInput("shop", "orders")}, information_cutoff="2011-05-01")
    early = lake.inputs.freeze({"o": RawInput("shop", "orders")}, information_cutoff="2011-01-15")
    same = lambda **o: lake.inputs.selection_equivalent(old, new, "o", **o)
    return spark.createDataFrame([(same(as_of="2011-02-15"), same(), lake.inputs.is_current(new), lake.inputs.is_current(early))], "before_the_revision boolean, whole boolean, current boolean, later_is_current boolean")


# --- scenario: customers as general snapshots, one of them empty
CUSTOMERS = DatasetSpec("customers", "general", "shop")


@cache
def customers_lake(spark: SparkSession, d: str):
    lake = scratch_lake(spark)
    lake.raw.register(CUSTOMERS)
    rows = P.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("asset_id"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    lake.raw.ingest(CUSTOMERS, rows, mode="initialize", ingested_at=at(2001, 1, 1))
    lake.raw.ingest(CUSTOMERS, rows, ingested_at=at(2001, 1, 10))  # a check
    lake.raw.ingest(CUSTOMERS, rows.where("asset_id % 2 = 0").withColumn("balance", F.col("balance") * 2), ingested_at=at(2001, 2, 1))
    lake.raw.ingest(CUSTOMERS, rows.limit(0), ingested_at=at(2001, 3, 1))
    lake.raw.ingest(CUSTOMERS, rows.select("asset_id", "balance"), ingested_at=at(2001, 4, 1))
    return lake


def _customers(name: str, sql: str, columns: list[str], **options) -> None:
    QUERIES[name] = lambda spark, d: customers_lake(spark, d).raw.read("customers", source="shop", **options).select(*columns)
    ORACLES[name] = sql


_customers("T2_general_first", "SELECT CAST(c_custkey AS VARCHAR) AS asset_id, c_acctbal AS balance, c_mktsegment FROM customer", ["asset_id", "balance", "c_mktsegment"], as_of="2001-01-15")
_customers("T2_general_second", "SELECT CAST(c_custkey AS VARCHAR) AS asset_id, c_acctbal * 2 AS balance, c_mktsegment FROM customer WHERE c_custkey % 2 = 0", ["asset_id", "balance", "c_mktsegment"], as_of="2001-02-15")
_customers("V6_general_empty", "SELECT CAST(c_custkey AS VARCHAR) AS asset_id, c_acctbal AS balance FROM customer WHERE FALSE", ["asset_id", "balance"], as_of="2001-03-15")
_customers("T2_general_last", "SELECT CAST(c_custkey AS VARCHAR) AS asset_id, c_acctbal AS balance FROM customer", ["asset_id", "balance"])
_customers("T2_general_strict", "SELECT CAST(c_custkey AS VARCHAR) AS asset_id, c_acctbal AS balance, FALSE AS _baseline, DATE '2001-01-10' AS snapshot_date FROM customer", ["asset_id", "balance", "_baseline", "snapshot_date"], as_of="2001-01-12", strict=True)
_customers("V7_general_versions", "SELECT CAST(c_custkey AS VARCHAR) AS asset_id, c_acctbal AS balance, CAST(1 AS BIGINT) AS _commit_seq FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_acctbal * 2, 2 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_acctbal, 4 FROM customer", ["asset_id", "balance", "_commit_seq"], view="versions")


@query("T16_snapshots", "SELECT 1 AS seq, CAST(count(*) AS BIGINT) AS row_count, '2001-01-01' AS pit_date FROM customer UNION ALL SELECT 2, count(*), '2001-02-01' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 3, 0, '2001-03-01' UNION ALL SELECT 4, count(*), '2001-04-01' FROM customer")
def snapshots(spark, d):
    found = customers_lake(spark, d).raw.snapshots("customers", source="shop")
    return spark.createDataFrame([(s["seq"], s["row_count"], s["pit_date"]) for s in found], "seq int, row_count bigint, pit_date string")


# --- scenario: a daily panel, items derived from it
DAILY = DatasetSpec("daily", "by_date", "web", date_kind="calendar", field_mappings={"day": "time", "user": "asset_id"})
CLOSE = ItemSpec("close", (RawInput("web", "daily"),), time_column="source_time", value_column="close", transforms=(Select(("source_time", "asset_id", "close")), Filter("close", "gt", 20.0), Cast({"close": "float64"})))
MADE = ItemSpec("made", (RawInput("web", "daily"),), producer_key="twice", producer_revision="1")
FIRST, LAST = "1900-01-01", "2100-01-01"


def _panel_rows(spark, d) -> DataFrame:
    return P.panel(spark, d).select(F.col("time").alias("day"), F.col("asset_id").alias("user"), F.col("value").alias("close"))


@cache
def panel_lake(spark: SparkSession, d: str):
    """Commit 1: the panel as unproven history. Commit 2, 2099-01-01: a third of it negated. The items
    ``close`` (transforms, all versions in one plan) and ``made`` (a producer, evaluated at each boundary)."""
    lake, rows = scratch_lake(spark), _panel_rows(spark, d)
    lake.raw.register(DAILY)
    lake.raw.ingest(DAILY, rows, mode="initialize", ingested_at=at(2098, 1, 1))
    lake.raw.ingest(DAILY, rows.where("user % 3 = 0").withColumn("close", -F.col("close")), ingested_at=at(2099, 1, 1))
    lake.items.register(CLOSE)
    lake.items.build("close", start=FIRST, end=LAST)
    lake.items.register_producer("twice", "1", lambda c: c.read("daily").where("close > 20").select(F.col("source_time").alias("time"), "asset_id", (F.col("close") * 2).alias("value")), UpdatePolicy("same_date"))
    lake.items.register(MADE)
    lake.items.build("made", start=FIRST, end=LAST)
    lake.items.register(ItemSpec("kept"))
    first = rows.select(F.col("day").alias("time"), F.col("user").alias("asset_id"), F.col("close").alias("value"))
    later = lambda n, value: first.where("asset_id % 2 = 0").withColumns({"value": value, "version_available_date": F.date_add("time", n)})
    many = first.withColumn("version_available_date", F.col("time")).unionByName(later(2, F.col("value"))).unionByName(later(5, F.col("value") + 1)).unionByName(later(9, F.lit(None).cast("double")))
    lake.items.ingest("kept", many, historical_baseline=True, ingested_at=at(2099, 2, 1))
    lake.items.register(ItemSpec("whole"))
    lake.items.ingest("whole", first, available_date="2099-03-01", ingested_at=at(2099, 3, 1))
    lake.items.replace_range("whole", first.where("asset_id % 4 <> 0"), start=FIRST, end=LAST, available_date="2099-04-01", ingested_at=at(2099, 4, 1))
    return lake


ITEM_COLUMNS = ["time", "asset_id", "value", "version_available_date"]
_CLOSE = "i AS (SELECT time, asset_id, value, time AS version_available_date FROM panel WHERE value > 20 UNION ALL SELECT time, asset_id, CASE WHEN -value > 20 THEN -value END, DATE '2099-01-01' FROM panel WHERE CAST(asset_id AS BIGINT) % 3 = 0 AND (value > 20 OR -value > 20))"
_KEPT = "i AS (SELECT time, asset_id, value, time AS version_available_date FROM panel UNION ALL SELECT time, asset_id, value, CAST(time + INTERVAL 2 DAY AS DATE) FROM panel WHERE CAST(asset_id AS BIGINT) % 2 = 0 UNION ALL SELECT time, asset_id, value + 1, CAST(time + INTERVAL 5 DAY AS DATE) FROM panel WHERE CAST(asset_id AS BIGINT) % 2 = 0 UNION ALL SELECT time, asset_id, NULL, CAST(time + INTERVAL 9 DAY AS DATE) FROM panel WHERE CAST(asset_id AS BIGINT) % 2 = 0)"
_WHOLE = "i AS (SELECT time, asset_id, value, greatest(time, DATE '2099-03-01') AS version_available_date FROM panel UNION ALL SELECT time, asset_id, NULL, DATE '2099-04-01' FROM panel WHERE CAST(asset_id AS BIGINT) % 4 = 0)"
_ITOP = "QUALIFY row_number() OVER (PARTITION BY time, asset_id ORDER BY version_available_date DESC) = 1"


def _items(name: str, item: str, table: str, where: str = "", top: str = _ITOP, scale: str = "value", **options) -> None:
    QUERIES[name] = lambda spark, d: panel_lake(spark, d).items.read(item, **options).select(*ITEM_COLUMNS)
    ORACLES[name] = P.with_tables(["panel"], f", {table} SELECT time, asset_id, {scale} AS value, version_available_date FROM i {where} {top}")


_items("T9_build_versions", "close", _CLOSE, top="", view="versions")
_items("V3_item_before", "close", _CLOSE, "WHERE version_available_date <= DATE '2098-06-01'", view="snapshot", as_of="2098-06-01")
_items("V3_item_after", "close", _CLOSE, "WHERE version_available_date <= DATE '2099-06-01'", view="snapshot", as_of="2099-06-01")
_items("V3_item_history", "close", _CLOSE, "WHERE version_available_date <= time", view="history")
_items("T8_boundary_versions", "made", _CLOSE, top="", scale="value * 2", view="versions")
_items("K10_item_versions", "kept", _KEPT, top="", view="versions")
_items("K10_item_snapshot", "kept", _KEPT, "WHERE version_available_date <= DATE '2024-01-10'", view="snapshot", as_of="2024-01-10")
_items("K11_replaced", "whole", _WHOLE, "WHERE version_available_date <= DATE '2099-05-01'", view="snapshot", as_of="2099-05-01")
_items("K11_replaced_versions", "whole", _WHOLE, top="", view="versions")


@query("P13_lineage", f", {_CLOSE} SELECT time, asset_id, CAST(NULL AS VARCHAR) AS _producer_key, TRUE AS has_definition, TRUE AS has_receipt FROM i", "panel")
def lineage(spark, d):
    df = panel_lake(spark, d).items.read("close", view="versions")
    return df.select("time", "asset_id", "_producer_key", (F.length("_item_definition_hash") == 64).alias("has_definition"), F.col("_dependency_digest").isNotNull().alias("has_receipt"))


@query("A14_revision_dates", "SELECT DATE '2099-01-01' AS day")
def revisions(spark, d):
    lake = panel_lake(spark, d)
    found = revision_dates([lake.raw.read("daily", source="web", view="versions")], date(1900, 1, 1), date(2100, 1, 1))
    return spark.createDataFrame([(x,) for x in found], "day date")


@query("T13_affected_dates", "SELECT DISTINCT time FROM panel WHERE CAST(asset_id AS BIGINT) % 4 = 0", "panel")
def affected(spark, d):
    lake = panel_lake(spark, d)
    first = lake.meta.snapshot("items", "whole")["commits"][0]["seq"]
    return lake.items.affected_dates("whole", first)


@query("I9_completed_range", "SELECT TRUE AS inside, FALSE AS outside")
def completed(spark, d):
    lake = panel_lake(spark, d)
    receipt = lake.inputs.freeze({"c": ItemInput("close")}, information_cutoff=LAST)
    covers = lambda a, b: lake.inputs.completed_range(receipt, "c", start=a, end=b)
    return spark.createDataFrame([(covers("2000-01-01", "2050-01-01"), covers("1800-01-01", "2050-01-01"))], "inside boolean, outside boolean")


@query("A7_profile", ", v AS (SELECT value FROM panel WHERE value IS NOT NULL AND isfinite(value)) SELECT (SELECT count(*) FROM panel) AS row_count, (SELECT count(*) FROM v) AS valid_count, (SELECT count(*) FROM v, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM v) f WHERE value < a - (b - a) * 0.5 OR value > b + (b - a) * 0.5) AS outliers, (SELECT count(DISTINCT time) FROM panel) AS days, (SELECT count(DISTINCT asset_id) FROM panel) AS assets", "panel")
def profile(spark, d):
    p = P.panel(spark, d)
    made = explore.profile_item(p, p.select("time", "asset_id"), 0.5, None)
    one = made["summary"].select("row_count", "valid_count")
    counts = [made["outliers"].agg(F.count(F.lit(1)).alias("outliers")), made["daily_coverage"].agg(F.count(F.lit(1)).alias("days")), made["asset_coverage"].agg(F.count(F.lit(1)).alias("assets"))]
    for c in counts:
        one = one.crossJoin(F.broadcast(c))  # one row each
    return one


# --- checks, sets, types
@query("A11_null_keys", "SELECT 'null key values: c_nationkey (' || count(*) || ')' AS problem FROM customer WHERE c_nationkey <= 4")
def null_keys(spark, d):
    c = P.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")).alias("c_nationkey"))
    return spark.createDataFrame([(p,) for p in quality.key_problems(c, ["c_custkey", "c_nationkey"])], "problem string")


@query("A12_multiplicities", "SELECT c_mktsegment AS seg, c_nationkey AS n, CAST(count(*) AS BIGINT) AS left_count, CAST(0 AS BIGINT) AS right_count FROM customer GROUP BY ALL")
def multiplicities(spark, d):
    c = P.table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("n"))
    return identity.multiset_diff(c, c.limit(0), ["seg", "n"])


@query("Q4_item_problems", "SELECT 'availability before observation: ' || count(*) AS problem FROM orders WHERE o_orderkey % 3 = 0 HAVING count(*) > 0")
def item_problems(spark, d):
    o = P.obs(spark, d).select(F.col("source_time").alias("time"), F.concat("asset_id", F.lit("/"), F.col("o_orderkey").cast("string")).alias("asset_id"), F.col("source_time").alias("observation_date"), F.when(F.col("o_orderkey") % 3 == 0, F.date_sub("source_time", 1)).otherwise(F.col("source_time")).alias("available_date"))
    return spark.createDataFrame([(p,) for p in quality.item_problems(o)], "problem string")


@query("P8_supertypes", "SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(s_nationkey AS DOUBLE) AS n FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def supertypes(spark, d):
    s = P.table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("k"), F.col("s_nationkey").cast("smallint").alias("n"))
    return types.union_relaxed(s, P.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("n")))


@query("P10_lossless_cast", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS value FROM orders")
def lossless(spark, d):
    o = P.table(spark, d, "orders")
    return o.select("o_orderkey", types.lossless_cast(F.col("o_custkey"), o.schema["o_custkey"].dataType, types.scalar_type("float64")).alias("value"))


@query("H1_row_tokens", "SELECT c_custkey, sha256('c_custkey=bigint,n=int;v' || length(CAST(c_custkey AS VARCHAR)) || ':' || c_custkey || CASE WHEN c_nationkey > 4 THEN 'v' || length(CAST(c_nationkey AS VARCHAR)) || ':' || c_nationkey ELSE 'n' END) AS token FROM customer")
def row_tokens(spark, d):
    c = P.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")).alias("n"))
    return c.select("c_custkey", identity.row_hash(c, ["c_custkey", "n"]).alias("token"))


@query("H2_order_insensitive", "SELECT TRUE AS any_order, FALSE AS one_more")
def order_insensitive(spark, d):
    c = P.table(spark, d, "customer")
    digest = identity.frame_digest(c)
    return spark.createDataFrame([(digest == identity.frame_digest(c.orderBy(F.rand(3))), digest == identity.frame_digest(c.unionByName(c.limit(1))))], "any_order boolean, one_more boolean")


@query("H4_typed_equality", "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 1")
def typed_equality(spark, d):
    """-0.0 and 0.0 are two values, NaN is one."""
    c = P.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.lit(0.0)).alias("v"))
    other = c.withColumn("v", F.when(F.col("c_custkey") % 3 == 1, F.lit(-0.0)).otherwise(F.col("v")))
    return identity.rows_not_in(c, other, ["c_custkey", "v"]).select("c_custkey")
