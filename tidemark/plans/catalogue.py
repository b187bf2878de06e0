"""The catalogue: one query per operator on the provided tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, identity
from tidemark.functions.types import union_relaxed
from tidemark.operators import align, explore, quality
from tidemark.operators import transforms as X
from tidemark.operators import versions as V
from tidemark.plans import panels as P
from tidemark.plans import stored
from tidemark.plans.build import pointwise_versions

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

AS_OF = date(1996, 1, 20)
VER = ["source_time", "asset_id", "o_orderkey", "value", "time", "_commit_seq", "_baseline"]


def query(name: str, sql: str, *tables: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = P.with_tables(list(tables), sql) if tables else sql
        return f

    return add


def _simple(name: str, sql: str, table: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, d: f(P.table(spark, d, table))
    ORACLES[name] = sql


# --- projections, casts, maps, filters
_simple("P1_select_rename", "SELECT o_orderkey AS key, o_custkey AS customer FROM orders", "orders", lambda t: X.Select(("o_orderkey", "o_custkey"), {"o_orderkey": "key", "o_custkey": "customer"}).apply(t, {}))
_simple("P2_cast", "SELECT c_custkey, CAST(c_custkey AS DOUBLE) AS as_double, CAST(c_custkey AS VARCHAR) AS as_text, CAST(c_nationkey AS SMALLINT) AS as_short FROM customer", "customer", lambda t: X.Cast({"as_double": "float64", "as_text": "string", "as_short": "int16"}).apply(t.select("c_custkey", F.col("c_custkey").alias("as_double"), F.col("c_custkey").alias("as_text"), F.col("c_nationkey").alias("as_short")), {}))
_simple(
    "P3_map_values", "SELECT c_custkey, CASE WHEN k IS NULL THEN 0.25 WHEN k = 1 THEN 1.5 ELSE CAST(k AS DOUBLE) END AS mapped FROM (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END AS k FROM customer)", "customer",
    lambda t: X.MapValues("k", {1: 1.5, None: 0.25}, "mapped").apply(t.select("c_custkey", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("k")), {}).drop("k"),
)
for op, sql, value in (("eq", "= 'F'", "F"), ("ne", "<> 'F'", "F"), ("in", "IN ('F', 'O')", ["F", "O"])):
    _simple(f"F1_{op}", f"SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus {sql}", "orders", lambda t, op=op, value=value: X.Filter("o_orderstatus", op, value).apply(t.select("o_orderkey", "o_orderstatus"), {}))
for op, sql in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _simple(f"F1_{op}", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey {sql} 100", "orders", lambda t, op=op: X.Filter("o_custkey", op, 100).apply(t.select("o_orderkey", "o_custkey"), {}))
for op, sql in (("is_null", "IS NULL"), ("is_not_null", "IS NOT NULL")):
    _simple(f"F1_{op}", f"SELECT c_custkey, n FROM (SELECT c_custkey, CASE WHEN c_nationkey > 4 THEN c_nationkey END AS n FROM customer) WHERE n {sql}", "customer", lambda t, op=op: X.Filter("n", op).apply(t.select("c_custkey", F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")).alias("n")), {}))
_simple("F2_assets", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "orders", lambda t: t)
QUERIES["F2_assets"] = lambda spark, d: P.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(P.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
_simple("F10_finite", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND isfinite(value)", "events", lambda t: t.where(explore.valid(t)).select("event_id", "value"))
_simple("F12_selector", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE TRY_CAST(o_orderstatus AS BIGINT) = 1 OR o_orderkey % 7 = 1", "orders", lambda t: t.where((F.col("o_orderstatus").try_cast("bigint") == 1) | (F.col("o_orderkey") % 7 == 1)).select(F.col("o_orderdate").cast("date").alias("day")).distinct())

# text keys of all forms: compact, ISO, unpadded, space-led, time suffix, junk, null
_KEY = "CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%-m-%-d') WHEN 3 THEN ' ' || strftime(o_orderdate, '%Y%m%d') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') || ' ' WHEN 5 THEN 'invalid' END"


def _keyed(spark, d):
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    compact, iso = F.date_format(day, "yyyyMMdd"), F.date_format(day, "yyyy-MM-dd")
    key = F.when(k == 0, compact).when(k == 1, iso).when(k == 2, F.date_format(day, "yyyy-M-d")).when(k == 3, F.concat(F.lit(" "), compact)).when(k == 4, F.concat(iso, F.lit(" "))).when(k == 5, F.lit("invalid"))
    return P.table(spark, d, "orders").select("o_orderkey", key.alias("k"))


_ISO = "CASE WHEN regexp_matches(trim(k), '^\\d{4}-\\d{1,2}-\\d{1,2}$') THEN CAST(try_strptime(trim(k), '%Y-%m-%d') AS DATE) END"


@query("P5_lenient_date", f"SELECT o_orderkey, k, CASE WHEN length(k) = 8 THEN CASE WHEN regexp_matches(k, '^\\d{{8}}$') THEN CAST(try_strptime(k, '%Y%m%d') AS DATE) END ELSE {_ISO} END AS day FROM (SELECT o_orderkey, {_KEY} AS k FROM orders)")
def lenient(spark, d):
    t = _keyed(spark, d)
    return t.withColumn("day", dates.lenient_date(F.col("k"), t.schema["k"].dataType))


@query("P6_strict_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def strict(spark, d):
    t = P.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("k"))
    return t.select("o_orderkey", dates.strict_date(F.col("k"), t.schema["k"].dataType).alias("day"))


@query("P7_first_date", f"SELECT o_orderkey, coalesce(CASE WHEN length(k) = 8 THEN CASE WHEN regexp_matches(k, '^\\d{{8}}$') THEN CAST(try_strptime(k, '%Y%m%d') AS DATE) END ELSE {_ISO} END, CAST(o_orderdate AS DATE)) AS source_time FROM (SELECT o_orderkey, o_orderdate, {_KEY} AS k FROM orders)")
def first_of(spark, d):
    t = _keyed(spark, d).join(P.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    return t.select("o_orderkey", dates.first_date([(F.col("k"), t.schema["k"].dataType), (F.col("o_orderdate"), t.schema["o_orderdate"].dataType)]).alias("source_time"))


@query("F9_key_range", f"SELECT o_orderkey, k FROM (SELECT o_orderkey, o_orderdate, {_KEY} AS k FROM orders) WHERE o_orderkey % 7 < 4 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'")
def key_range(spark, d):
    t = _keyed(spark, d)  # a key with a trailing blank is no date and in no range
    return t.where(dates.key_between(F.col("k"), t.schema["k"].dataType, date(1996, 1, 1), date(1996, 3, 31)))


_simple("S7_date_range_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-01-31'", "lineitem", lambda t: t.where("l_shipdate BETWEEN timestamp_ntz'1996-01-01' AND timestamp_ntz'1996-01-31'").select("l_orderkey", "l_linenumber", "l_quantity"))
_simple("P14_latest_of_dates", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_shipdate AS DATE) ELSE greatest(CAST(l_shipdate AS DATE), DATE '1997-01-01') END AS day FROM lineitem", "lineitem", lambda t: t.select("l_orderkey", "l_linenumber", F.greatest(F.col("l_shipdate").cast("date"), F.when(F.col("l_linenumber") % 3 != 0, F.lit(date(1997, 1, 1)))).alias("day")))


# --- joins
@query("U2_union_relaxed", "SELECT CAST(s_suppkey AS DOUBLE) AS key, s_name AS name, NULL AS segment, s_acctbal AS balance FROM supplier UNION ALL SELECT CAST(c_custkey AS DOUBLE) + 0.5, NULL, c_mktsegment, NULL FROM customer")
def relaxed(spark, d):
    return union_relaxed(P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), P.table(spark, d, "customer").select((F.col("c_custkey") + F.lit(0.5)).cast("double").alias("key"), F.col("c_mktsegment").alias("segment"))).select("key", "name", "segment", "balance")


def _sides(spark, d):
    left = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_nationkey") > 4, F.col("s_nationkey")).alias("n"), F.col("s_acctbal").alias("b"))
    right = P.table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("k"), F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("b"))
    return left, right


_LEFT = "(SELECT s_suppkey AS k, CASE WHEN s_nationkey > 4 THEN s_nationkey END AS n, s_acctbal AS b FROM supplier)"
_RIGHT = "(SELECT c_custkey * 2 AS k, c_nationkey AS n, c_acctbal AS b FROM customer)"
for how in ("left", "inner", "full"):
    QUERIES[f"J1_{how}"] = lambda spark, d, how=how: X.join_frames(*_sides(spark, d), ["k"], how)
    ORACLES[f"J1_{how}"] = f"SELECT k, l.n, l.b, r.n AS n_right, r.b AS b_right FROM {_LEFT} l {how.upper()} JOIN {_RIGHT} r USING (k)"
for how in ("semi", "anti"):
    QUERIES[f"J1_{how}"] = lambda spark, d, how=how: X.join_frames(*_sides(spark, d), ["k"], how)
    ORACLES[f"J1_{how}"] = f"SELECT l.k, l.n, l.b FROM {_LEFT} l WHERE {'NOT ' if how == 'anti' else ''}EXISTS (SELECT 1 FROM {_RIGHT} r WHERE r.k = l.k)"
QUERIES["J2_many_to_one"] = lambda spark, d: X.join_frames(P.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), P.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"], "left", "m:1")
ORACLES["J2_many_to_one"] = "SELECT o.o_custkey AS c_custkey, o.o_orderkey, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"


@query("J8_null_safe_diff", f"SELECT DISTINCT n, b FROM {_LEFT} l WHERE NOT EXISTS (SELECT 1 FROM (SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey ELSE CASE WHEN s_nationkey > 4 THEN s_nationkey END END AS n, s_acctbal AS b FROM supplier) r WHERE r.n IS NOT DISTINCT FROM l.n AND r.b IS NOT DISTINCT FROM l.b)")
def null_safe(spark, d):
    left, _ = _sides(spark, d)
    right = P.table(spark, d, "supplier").select(F.when((F.col("s_suppkey") % 3 == 0) | (F.col("s_nationkey") > 4), F.col("s_nationkey")).alias("n"), F.col("s_acctbal").alias("b"))
    return identity.rows_not_in(left.select("n", "b"), right, ["n", "b"]).distinct()


@query("J19_multiset_diff", "SELECT seg, n, CAST(sum(l) AS BIGINT) AS left_count, CAST(sum(r) AS BIGINT) AS right_count FROM (SELECT c_mktsegment AS seg, c_nationkey AS n, 1 AS l, 0 AS r FROM customer UNION ALL SELECT c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END, 0, 1 FROM customer) GROUP BY seg, n HAVING sum(l) <> sum(r)")
def multiset(spark, d):
    c = P.table(spark, d, "customer")
    return identity.multiset_diff(c.select(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("n")), c.select(F.col("c_mktsegment").alias("seg"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("n")), ["seg", "n"])


@query("J18_key_appends", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 = 0")
def appends(spark, d):
    new = P.table(spark, d, "customer").select("c_custkey", "c_name")
    return quality.added_keys(new.where("c_custkey % 4 <> 0"), new, "c_custkey")


# --- exploration
def _mixed(p: DataFrame) -> DataFrame:
    """The panel with nulls and values that aren't finite."""
    k = (F.dayofmonth("time") + F.col("asset_id").cast("bigint")) % 11
    return p.withColumn("value", F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k != 2, F.col("value")))


_MIXED = "SELECT time, asset_id, CASE (day(time) + CAST(asset_id AS BIGINT)) % 11 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) WHEN 2 THEN NULL ELSE value END AS value FROM panel"
_OK = "(value IS NOT NULL AND isfinite(value))"
_ELIGIBLE = f"(SELECT g.time, g.asset_id, m.value FROM pgrid g LEFT JOIN ({_MIXED}) m USING (time, asset_id))"


def _explored(spark, d):
    return _mixed(P.panel(spark, d)), P.panel_grid(spark, d)


@query(
    "A1_overview", f"""SELECT count(*) AS row_count, count(*) AS expected_count, count(*) FILTER (WHERE {_OK}) AS valid_count, count(*) FILTER (WHERE value IS NULL) AS null_count, count(*) FILTER (WHERE isnan(value)) AS nan_count, count(*) FILTER (WHERE isinf(value)) AS infinite_count,
    count(*) FILTER (WHERE isnan(value) OR isinf(value)) AS non_finite_count, count(*) FILTER (WHERE NOT {_OK}) AS missing_count, count(*) FILTER (WHERE {_OK}) / count(*) AS coverage_rate, (count(*) - count(*) FILTER (WHERE {_OK})) / count(*) AS missing_rate,
    min(time) FILTER (WHERE {_OK}) AS first_valid_date, max(time) FILTER (WHERE {_OK}) AS last_valid_date, count(DISTINCT asset_id) AS asset_count, count(DISTINCT time) AS date_count, count(DISTINCT value) FILTER (WHERE {_OK}) AS cardinality, (SELECT count(*) FROM panel) AS source_row_count, 'double' AS value_dtype, TRUE AS "numeric" FROM {_ELIGIBLE}""", "panel", "pgrid",
)
def overview(spark, d):
    p, g = _explored(spark, d)
    return explore.overview(p, g)


for by in ("time", "asset_id"):
    QUERIES[f"A2_coverage_{by}"] = lambda spark, d, by=by: explore.coverage(*_explored(spark, d), by)
    ORACLES[f"A2_coverage_{by}"] = P.with_tables(["panel", "pgrid"], f"SELECT {by}, count(*) AS expected_count, count(*) FILTER (WHERE {_OK}) AS valid_count, count(*) FILTER (WHERE value IS NULL) AS null_count, count(*) - count(*) FILTER (WHERE {_OK}) AS missing_count, count(*) FILTER (WHERE {_OK}) / count(*) AS coverage_rate FROM {_ELIGIBLE} GROUP BY {by}")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


@query("A3_quantiles", f"SELECT CAST(p AS DOUBLE) AS probability, round(quantile_cont(value, p), 6) AS value FROM (SELECT unnest(q) AS p, q2 AS value FROM (SELECT [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99] AS q, value AS q2 FROM ({_MIXED}) WHERE {_OK})) GROUP BY p", "panel")
def quantiles(spark, d):
    return _rounded(explore.quantiles(_explored(spark, d)[0]))


ORACLES["A3_quantiles"] = P.with_tables(["panel"], f", v AS (SELECT value FROM ({_MIXED}) WHERE {_OK}) " + " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS probability, round(quantile_cont(value, {p}), 6) AS value FROM v" for p in explore.PROBABILITIES))


@query("A4_distribution", "", "panel")
def distribution(spark, d):
    return _rounded(explore.distribution(_explored(spark, d)[0]))


ORACLES["A4_distribution"] = P.with_tables(["panel"], f", v AS (SELECT value FROM ({_MIXED}) WHERE {_OK}) " + " UNION ALL ".join(f"SELECT '{n}' AS statistic, round({e}, 6) AS value FROM v" for n, e in [("count", "CAST(count(*) AS DOUBLE)"), ("mean", "avg(value)"), ("std", "stddev_samp(value)"), ("min", "min(value)"), ("max", "max(value)"), *((f"p{int(p * 100):02d}", f"quantile_cont(value, {p})") for p in explore.PROBABILITIES)]))


@query("A4_categories", "SELECT value, count(*) AS count FROM (SELECT event_type AS value FROM events) GROUP BY value")
def categories(spark, d):
    e = P.table(spark, d, "events").select(F.col("ts").alias("time"), F.col("event_id").cast("string").alias("asset_id"), F.col("event_type").alias("value"))
    return explore.distribution(e)


@query("A5_outliers", f", v AS (SELECT * FROM ({_MIXED}) WHERE {_OK}), f AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM v) SELECT v.* FROM v, f WHERE value < a - (b - a) * 0.5 OR value > b + (b - a) * 0.5", "panel")
def outliers(spark, d):
    return explore.outliers(_explored(spark, d)[0], 0.5)


@query("A6_time_series", "SELECT * FROM panel WHERE asset_id = '7'", "panel")
def series(spark, d):
    return explore.time_series(P.panel(spark, d), "7")


@query("A6_cross_section", "SELECT * FROM panel WHERE time = (SELECT min(time) FROM panel)", "panel")
def section(spark, d):
    p = P.panel(spark, d)
    return explore.cross_section(p, p.agg(F.min("time")).first()[0])


# --- point-in-time reads
_PICK = "QUALIFY row_number() OVER (PARTITION BY source_time, asset_id, o_orderkey ORDER BY time DESC, _commit_seq DESC) = 1"


def _read(name: str, where: str, after: str = "", pick: str = _PICK, **options) -> None:
    QUERIES[name] = lambda spark, d: V.read_versions(P.versions(spark, d), P.KEYS, **options).select(*VER)
    ORACLES[name] = P.with_tables(["ver"], f"SELECT * FROM (SELECT * FROM ver {where} {pick}) {after}")


_read("V1_latest", "", view="latest")
_read("F4_snapshot", "WHERE time <= DATE '1996-01-20'", as_of=AS_OF)
_read("F6_history", "WHERE time <= source_time", view="history")
_read("F6_history_as_of", "WHERE time <= source_time AND time <= DATE '1996-01-20'", view="history", as_of=AS_OF)
_read("V7_versions", "", pick="", view="versions")
_read("F7_strict_latest", "WHERE NOT _baseline", view="latest", strict=True)
_read("F7_strict_snapshot", "WHERE NOT _baseline AND time <= DATE '1996-01-20'", as_of=AS_OF, strict=True)
_read("F7_strict_history", "WHERE NOT _baseline AND time <= source_time", view="history", strict=True)
_read("F8_max_commit", "WHERE _commit_seq <= 2", view="latest", max_commit=2)
_read("F3_observed_window", "WHERE source_time BETWEEN DATE '1996-01-01' AND DATE '1996-02-15'", view="latest", observation_start="1996-01-01", observation_end="19960215")
_read("F5_available_after", "", "WHERE time BETWEEN DATE '1996-01-01' AND DATE '1996-02-15'", view="latest", start="1996-01-01", end="1996-02-15")
_read("F2_asset_list", "WHERE asset_id IN ('1', '2', '5', '10')", view="latest", assets=["1", "2", "5", "10"])


@query("P15_observations", f"SELECT o_orderkey, source_time AS time, value FROM (SELECT * FROM ver {_PICK})", "ver")
def observed(spark, d):
    return V.observations(V.read_versions(P.versions(spark, d), P.KEYS, view="latest")).select("o_orderkey", "time", "value")


_EVENTS = "SELECT source_time AS es, asset_id AS ea, o_orderkey AS eo, CAST(source_time + INTERVAL 5 DAY AS DATE) AS ed, CAST(o_orderkey AS BIGINT) AS ei FROM obs WHERE o_orderkey % 4 = 0"


@query(
    "T3_overlay", f""", e AS ({_EVENTS}), v AS (SELECT source_time, asset_id, o_orderkey, value, time, _commit_seq, _baseline, CAST(NULL AS BIGINT) AS _attestation_id FROM ver
    UNION ALL SELECT source_time, asset_id, o_orderkey, value, greatest(time, ed), _commit_seq, FALSE, ei FROM ver JOIN e ON source_time = es AND asset_id = ea AND o_orderkey = eo WHERE _baseline) SELECT * FROM v WHERE NOT _baseline QUALIFY row_number() OVER (PARTITION BY source_time, asset_id, o_orderkey ORDER BY time DESC, _commit_seq DESC) = 1""", "ver",
)
def overlaid(spark, d):
    events = P.obs(spark, d).where("o_orderkey % 4 = 0").select("source_time", "asset_id", "o_orderkey", F.lit(1).cast("bigint").alias("version_commit"), F.date_add("source_time", 5).alias("available_date"), F.timestamp_seconds(F.lit(86400)).alias("checked_at"), F.col("o_orderkey").alias("check_id"))
    both = V.overlay(P.versions(spark, d), events, P.KEYS)
    return V.read_versions(both, P.KEYS, view="latest", strict=True).select(*VER, "_attestation_id")


_ITEMS = "SELECT source_time AS time, asset_id, value, time AS version_available_date, _commit_seq FROM (SELECT *, row_number() OVER (PARTITION BY source_time, asset_id, time, _commit_seq ORDER BY value IS NULL, o_orderkey DESC) AS rn FROM ver) WHERE rn = 1"
_IPICK = "QUALIFY row_number() OVER (PARTITION BY time, asset_id ORDER BY version_available_date DESC, _commit_seq DESC) = 1"


def _items(spark, d):
    """One value per (day, customer, availability, commit): of the largest order, values before nulls."""
    o = P.versions(spark, d).groupBy("source_time", "asset_id", "time", "_commit_seq").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("o_orderkey"))).alias("value"))
    return o.select(F.col("source_time").alias("time"), "asset_id", "value", F.col("time").alias("version_available_date"), "_commit_seq")


@query("V4_item_snapshot", f", i AS ({_ITEMS}) SELECT * FROM i WHERE version_available_date <= DATE '1996-01-20' {_IPICK}", "ver")
def item_snapshot(spark, d):
    return V.select_versions(_items(spark, d), as_of=AS_OF)


@query("V4_item_history", f", i AS ({_ITEMS}) SELECT * FROM i WHERE version_available_date <= time {_IPICK}", "ver")
def item_history(spark, d):
    return V.select_versions(_items(spark, d), history=True)


@query("V5_general_snapshot", "SELECT c_custkey, c_acctbal * 2 AS balance, CAST(2 AS BIGINT) AS _commit_seq FROM customer WHERE c_custkey % 2 = 0")
def general(spark, d):
    c = P.table(spark, d, "customer")
    snap = lambda df, k, day: df.withColumns({"_commit_seq": F.lit(k).cast("bigint"), "_snapshot_id": F.lit(str(k)), "snapshot_date": F.lit(day), "ingested_at": F.timestamp_seconds(F.lit(k))})
    one = snap(c.select("c_custkey", F.col("c_acctbal").alias("balance")), 1, date(1996, 1, 1))
    two = snap(c.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") * 2).alias("balance")), 2, date(1996, 1, 10))
    three = snap(c.limit(0).select("c_custkey", F.col("c_acctbal").alias("balance")), 3, date(1996, 2, 1))
    return V.input_snapshot(one.unionByName(two).unionByName(three), AS_OF).select("c_custkey", "balance", "_commit_seq")


@query("V9_latest_per_asset", "SELECT asset_id, time, value FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY time DESC) AS rn FROM oev WHERE time <= DATE '1997-06-30') WHERE rn = 1", "oev")
def latest_asset(spark, d):
    return V.latest_per_asset(P.order_events(spark, d), "1997-06-30").select("asset_id", "time", "value")


@query("K11_tombstones", "SELECT time, asset_id, CASE WHEN CAST(asset_id AS BIGINT) % 3 = 0 THEN NULL ELSE value END AS value FROM oev", "oev")
def tombstones(spark, d):
    old = P.order_events(spark, d).select("time", "asset_id", "value")
    return V.with_tombstones(old, old.where("cast(asset_id AS bigint) % 3 <> 0"), ["time", "asset_id"])


@query("J9_withdrawn", "SELECT time, asset_id, value FROM oev WHERE CAST(asset_id AS BIGINT) % 3 = 0", "oev")
def gone(spark, d):
    old = P.order_events(spark, d).select("time", "asset_id", "value")
    return identity.withdrawn(old, old.where("cast(asset_id AS bigint) % 3 <> 0"), ["time", "asset_id"])


# --- alignment
@query("J4_forward_asof", "SELECT o.o_orderkey, o.source_time, s.session, s.idx AS index FROM obs o ASOF LEFT JOIN ses s ON o.source_time <= s.session", "obs", "ses")
def forward(spark, d):
    sessions = align.open_sessions(P.calendar(spark, d))
    return align.forward_asof(P.obs(spark, d).select("o_orderkey", "source_time"), "source_time", sessions)


@query("J5_backward_asof", "SELECT g.time, g.asset_id, e.time AS event_time, e.value FROM ogrid g ASOF LEFT JOIN oev e ON g.asset_id = e.asset_id AND g.time >= e.time", "oev", "ogrid")
def backward(spark, d):
    found = align.backward_asof(P.order_grid(spark, d), P.order_events(spark, d), "asset_id", "time", "time")
    return found.select("time", "asset_id", F.col("_event.time").alias("event_time"), F.col("_event.value").alias("value"))


@query("T5_align_exact", "SELECT g.time, g.asset_id, e.value, e.available_date FROM ogrid g LEFT JOIN (SELECT * REPLACE (CAST(available_date - INTERVAL 3 DAY AS DATE) AS available_date) FROM oev) e ON g.time = e.time AND g.asset_id = e.asset_id", "oev", "ogrid")
def exact(spark, d):
    return align.align_panel(P.order_events(spark, d).withColumn("available_date", F.col("time")), P.order_grid(spark, d))


for n in (1, 2, 5):
    QUERIES[f"T5_align_fill_{n}"] = lambda spark, d, n=n: align.align_panel(P.order_events(spark, d), P.order_grid(spark, d), forward_fill_sessions=n).select("time", "asset_id", "value", "available_date")
    ORACLES[f"T5_align_fill_{n}"] = P.with_tables(["oev", "ogrid"], f", e AS (SELECT asset_id, available_date AS eff, value, available_date FROM oev WHERE available_date <= (SELECT max(session) FROM mses)), m AS (SELECT e.*, s.idx AS ei FROM e ASOF JOIN mses s ON e.eff <= s.session) SELECT g.time, g.asset_id, CASE WHEN g.idx - m.ei < {n} THEN m.value END AS value, CASE WHEN g.idx - m.ei < {n} THEN m.available_date END AS available_date FROM ogrid g ASOF LEFT JOIN m ON g.asset_id = m.asset_id AND g.time >= m.eff")

_POLICY = dict(observation_date_field="time", base_available_date_field="available_date", calendar_id="x/cal")
for buffer in (0, 1, 3):
    moved = f", p AS (SELECT o.*, s2.session AS moved, s2.idx AS mi FROM (SELECT o.*, (SELECT count(*) FROM ses s WHERE s.session {'<' if buffer == 0 else '<='} o.available_date) + {max(0, buffer - 1)} AS at FROM (SELECT *, available_date AS av FROM oev) o) o JOIN ses s2 ON s2.idx = o.at), q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY asset_id, moved ORDER BY time DESC) = 1)"
    QUERIES[f"T7_advance_{buffer}"] = lambda spark, d, b=buffer: align.advance_sessions(P.order_events(spark, d).select("time", "asset_id", F.col("available_date").alias("base")), "base", align.open_sessions(P.calendar(spark, d)), b)
    ORACLES[f"T7_advance_{buffer}"] = P.with_tables(["oev", "ses"], moved + " SELECT o.time, o.asset_id, o.available_date AS base, p.moved AS available_date FROM oev o LEFT JOIN p ON p.time = o.time AND p.asset_id = o.asset_id")
    for kind in ("exact_daily", "forward_fill", "derived"):
        name = f"T6_{kind}_{buffer}"
        policy = align.AvailabilityPolicy(availability_buffer_sessions=buffer, alignment=kind, max_forward_fill_sessions=4 if kind == "forward_fill" else None, **_POLICY)
        QUERIES[name] = lambda spark, d, policy=policy: align.materialize_daily_pit(P.order_events(spark, d), P.calendar(spark, d), policy, start=date(1996, 1, 1), end=date(1996, 3, 31)).select("time", "asset_id", "value", "observation_date", "available_date")
        tail = {
            "exact_daily": "SELECT moved AS time, asset_id, value, time AS observation_date, moved AS available_date FROM q WHERE moved BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'",
            "derived": "SELECT greatest(time, moved) AS time, asset_id, value, time AS observation_date, moved AS available_date FROM p WHERE greatest(time, moved) BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' QUALIFY row_number() OVER (PARTITION BY greatest(time, moved), asset_id ORDER BY moved DESC, time DESC) = 1",
            "forward_fill": "SELECT g.session AS time, g.asset_id, q.value, q.time AS observation_date, q.moved AS available_date FROM (SELECT s.session, s.idx, a.asset_id FROM ses s CROSS JOIN (SELECT DISTINCT asset_id FROM q) a WHERE s.session BETWEEN DATE '1996-01-01' AND DATE '1996-03-31') g ASOF JOIN q ON g.asset_id = q.asset_id AND g.session >= q.moved WHERE g.idx - q.mi < 4",
        }[kind]
        ORACLES[name] = P.with_tables(["oev", "ses"], f"{moved} {tail}")


# --- causal versions, intervals, quality
@query(
    "T8_causal_versions", f""", i AS ({_ITEMS}), t AS (SELECT time, asset_id, CASE WHEN value > 100000 THEN CAST(1 AS BIGINT) ELSE CAST(value AS BIGINT) % 10 END AS value, greatest(time, version_available_date) AS version_available_date, _commit_seq FROM i),
    l AS (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS rn FROM t WINDOW w AS (PARTITION BY time, asset_id ORDER BY version_available_date, _commit_seq)) SELECT time, asset_id, value, version_available_date FROM l WHERE rn = 1 OR value IS DISTINCT FROM before""", "ver",
)
def causal(spark, d):
    step = lambda df: df.withColumn("value", F.when(F.col("value") > 100000, F.lit(1)).otherwise(F.rint("value").cast("bigint") % 10))
    return pointwise_versions(_items(spark, d), step).select("time", "asset_id", "value", "version_available_date")


@query(
    "T11_changed_days", """, iv AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate + INTERVAL 2 DAY AS DATE) AS e FROM orders WHERE o_orderkey % 97 = 0), m AS (SELECT s, e, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv),
    k AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (ORDER BY s, e) AS island FROM m) SELECT min(s) AS start, max(e) AS "end" FROM k GROUP BY island""", "cal",
)
def changed(spark, d):
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("begin"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 3), "yyyy-MM-dd").alias("until"))
    return quality.changed_intervals(o, o.where("asset_id % 97 <> 0"), ["asset_id", "begin", "until"], "begin", "until", date(1900, 1, 1), date(2100, 1, 1))


@query("A8_conflicts", "SELECT o_custkey, count(*) AS row_count FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1")
def conflicting(spark, d):
    return quality.conflicts(P.table(spark, d, "orders"), ["o_custkey"], ["o_orderpriority"]).select("o_custkey", "row_count")


@query("A9_duplicates", "SELECT l_partkey, l_suppkey, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark, d):
    return quality.duplicate_keys(P.table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("A10_bounds", "SELECT count(*) AS row_count, min(source_time) AS min_observation, max(source_time) AS max_observation, min(time) AS min_availability, max(time) AS max_availability, CAST(max(time - source_time) AS INTEGER) AS max_delay_days FROM ver", "ver")
def bounded(spark, d):
    return quality.bounds(P.versions(spark, d))


@query("Q5_health", "SELECT strftime(time, '%Y-%m') AS month, CAST(sum(n) AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS null_key_rows, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_keys FROM (SELECT any_value(time) AS time, count(*) AS n FROM ver GROUP BY strftime(time, '%Y-%m'), source_time, asset_id) GROUP BY 1", "ver")
def healthy(spark, d):
    return quality.health(P.versions(spark, d), ["source_time", "asset_id"])


QUERIES.update(stored.QUERIES)
ORACLES.update(stored.ORACLES)
