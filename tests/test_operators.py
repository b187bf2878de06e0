"""Operators by hand-computed rows: types, dates, identity, transforms, alignment, exploration, builds."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import dates, identity, types
from tidemark.operators import align, explore, quality, transforms, versions
from tidemark.plans.build import compute_versions, pointwise_versions
from tidemark.plans.incremental import merge_windows


def d(n: int) -> date:
    return date(2024, 1, n)


def test_supertypes_and_keys():
    s = types.supertype
    assert s(T.IntegerType(), T.LongType()) == T.LongType() and s(T.LongType(), T.DoubleType()) == T.DoubleType()
    assert s(T.StringType(), T.LongType()) == T.LongType() and s(T.NullType(), T.DateType()) == T.DateType()
    with pytest.raises(types.SchemaError):
        s(T.DateType(), T.LongType())
    assert not types.lossless_key(T.LongType(), T.DoubleType())
    assert types.lossless_key(T.ByteType(), T.FloatType()) and types.lossless_key(T.FloatType(), T.DoubleType()) and types.lossless_key(T.IntegerType(), T.DoubleType())
    with pytest.raises(ValueError):
        types.scalar_type("datetime[ns]")


def test_lossless_cast(spark):
    df = spark.createDataFrame([(2**53 + 1,)], "v bigint")
    with pytest.raises(Exception, match="survive"):
        df.select(types.lossless_cast(F.col("v"), T.LongType(), T.DoubleType())).collect()
    assert df.select(types.lossless_cast(F.col("v") - 1, T.LongType(), T.DoubleType())).first()[0] == 2.0**53


def test_dates(spark):
    rows = ["20240102", "2024-01-02", " 2024-1-2 ", "2024-1-2", "20240231", "invalid", None]
    df = spark.createDataFrame([(r,) for r in rows], "k string")
    # eight characters are the compact form, even where they hold hyphens
    assert [r[0] for r in df.select(dates.lenient_date(F.col("k"), T.StringType())).collect()] == [d(2), d(2), d(2), None, None, None, None]
    keys = spark.createDataFrame([("2024011",), (" 20240110",), ("20240231",)], "k string")
    assert [r[0] for r in keys.select(dates.key_date(F.col("k"))).collect()] == [d(1), d(10), None]
    with pytest.raises(Exception, match="[Pp]ars|CAST|date"):
        df.select(dates.strict_date(F.col("k"), T.StringType())).collect()
    assert dates.as_date("20240102") == dates.as_date("2024-01-02T10:00") == dates.as_date(datetime(2024, 1, 2, 5)) == d(2)


def test_identity(spark):
    a = spark.createDataFrame([(1, None), (1, float("nan")), (1, 0.0), (1, -0.0)], "k int, v double")
    assert a.select(identity.row_hash(a, ["k", "v"])).distinct().count() == 4
    assert identity.frame_digest(a) == identity.frame_digest(a.orderBy(F.desc("v")))
    assert identity.frame_digest(a) != identity.frame_digest(a.unionByName(a)) and identity.frame_digest(a) != identity.frame_digest(a.withColumn("k", F.col("k").cast("bigint")))
    b = spark.createDataFrame([(1, None), (1, float("nan")), (1, 0.0)], "k int, v double")
    left = identity.rows_not_in(a, b, ["k", "v"]).collect()
    assert len(left) == 1 and math.copysign(1, left[0]["v"]) == -1
    nested = spark.createDataFrame([(("a", [1.0, None]),), (("a", [1.0, float("nan")]),)], "p struct<label:string,values:array<double>>")
    assert nested.select(identity.row_hash(nested, ["p"])).distinct().count() == 2


def test_map_values(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v bigint")
    assert [r[0] for r in transforms.MapValues("v", {1: 1.5, None: 0.25}).apply(df, {}).collect()] == [1.5, 2.0, 0.25]
    big = spark.createDataFrame([(2**53 + 1,)], "v bigint")
    assert transforms.MapValues("v", {2**53 + 1: 0.5}).apply(big, {}).first()[0] == 0.5  # replaced before it is cast
    with pytest.raises(Exception, match="survive"):
        transforms.MapValues("v", {1: 0.5}).apply(big, {}).collect()


def test_transform_codec_and_pointwise():
    ts = (transforms.Select(("a", "b"), {"a": "c"}), transforms.Filter("t", "in", [d(1), datetime(2024, 1, 1, 5)]), transforms.MapValues("v", {1: "x", None: "y", d(2): "z"}), transforms.Cast({"v": "float64"}), transforms.Join("o", ("k",)), transforms.Align("g", 3))
    import json

    assert tuple(transforms.from_json(json.loads(json.dumps(transforms.to_json(t)))) for t in ts) == ts
    assert transforms.pointwise(ts[:4]) and not transforms.pointwise(ts) and not transforms.pointwise((transforms.Select(("a",), {"a": "time"}),))


def test_join_validation(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "q"), (None, "n")], "k int, v string")
    with pytest.raises(ValueError, match="left"):
        transforms.join_frames(a, b, ["k"])
    out = transforms.join_frames(a, b, ["k"], "left", "m:1")
    assert sorted((r["v"], r["v_right"]) for r in out.collect()) == [("x", "q"), ("y", "q"), ("z", None)]
    with pytest.raises(ValueError):
        transforms.join_frames(a, b, [])
    with pytest.raises(ValueError):
        transforms.Filter("k", "like", 1).apply(a, {})


def test_finite_fill(spark):
    grid = spark.createDataFrame([(d(n), "A") for n in range(1, 7)], "time date, asset_id string")
    events = spark.createDataFrame([(d(1), "A", 1.0, d(2)), (d(4), "A", None, d(4))], "time date, asset_id string, value double, available_date date")
    out = align.align_panel(events, grid, forward_fill_sessions=2).orderBy("time").collect()
    assert [r["value"] for r in out] == [None, 1.0, 1.0, None, None, None]
    exact = align.align_panel(events, grid).orderBy("time").collect()
    assert [r["value"] for r in exact] == [None] * 6
    with pytest.raises(ValueError):
        align.align_panel(events, grid, forward_fill_sessions=0)
    with pytest.raises(ValueError, match="duplicate"):
        align.align_panel(events.unionByName(events), grid)


def test_availability_policy(spark):
    calendar = spark.createDataFrame([(d(n),) for n in (1, 3, 6, 8, 10)], "time date")
    obs = spark.createDataFrame([("A", d(1), d(1), "x"), ("A", d(2), d(5), None)], "asset_id string, event_date date, known date, value string")
    policy = align.AvailabilityPolicy("event_date", "known", 0, "forward_fill", 2, "s/c")
    out = align.materialize_daily_pit(obs, calendar, policy, start=d(1), end=d(10)).orderBy("time").collect()
    assert [(r["time"].day, r["value"]) for r in out] == [(1, "x"), (3, "x"), (6, None), (8, None)]
    moved = spark.createDataFrame([(d(n),) for n in (1, 2, 9, 11)], "base date")
    for buffer, want in ((0, [d(1), d(3), d(10), None]), (1, [d(3), d(3), d(10), None]), (2, [d(6), d(6), None, None])):
        got = align.advance_sessions(moved, "base", align.open_sessions(calendar), buffer).orderBy("base").collect()
        assert [r["available_date"] for r in got] == want
    with pytest.raises(ValueError, match="two values"):
        align.materialize_daily_pit(obs.unionByName(obs.withColumn("value", F.lit("other"))), calendar, policy, start=d(1), end=d(10))


def test_explore(spark):
    inf = float("inf")
    df = spark.createDataFrame([(d(1), "A", 1.0), (d(2), "A", 3.0), (d(1), "B", None), (d(2), "B", float("nan")), (d(3), "B", inf)], "time date, asset_id string, value double")
    grid = spark.createDataFrame([(d(n), a) for n in (1, 2, 3) for a in "AB"], "time date, asset_id string")
    o = explore.overview(df, grid).first()
    assert (o["valid_count"], o["null_count"], o["nan_count"], o["infinite_count"], o["cardinality"]) == (2, 2, 1, 1, 2) and abs(o["coverage_rate"] - 1 / 3) < 1e-12
    empty = explore.overview(df.limit(0)).first()
    assert empty["row_count"] == 0 and empty["coverage_rate"] is None
    assert [r["value"] for r in explore.quantiles(df, (0.0, 0.5, 1.0)).collect()] == [1.0, 2.0, 3.0]
    assert explore.quantiles(df.limit(0), (0.5,)).first()["value"] is None
    text = df.select("time", "asset_id", F.lit("x").alias("value"))
    assert [tuple(r) for r in explore.distribution(text).collect()] == [("x", 5)] and explore.outliers(text).isEmpty()
    profile = explore.profile_item(df, grid)
    assert profile["values"].count() == 2 and profile["daily_coverage"].count() == 3
    with pytest.raises(ValueError, match="two values"):
        explore.overview(df.unionByName(df))


def test_exact_percentiles_beyond_one_aggregate(spark):
    df = spark.range(10_000).select((F.pmod(F.col("id") * 7919, F.lit(10_007)) * 1.5).alias("x"))
    want = explore.exact_percentiles(df, "x", explore.PROBABILITIES)
    assert explore.exact_percentiles(df, "x", explore.PROBABILITIES, rows=50) == pytest.approx(want)
    ties = spark.range(3000).select(F.when(F.col("id") < 2000, 1.0).otherwise(F.col("id") / 1.0).alias("x"))
    assert explore.exact_percentiles(ties, "x", [0.1, 0.9], rows=100) == pytest.approx(explore.exact_percentiles(ties, "x", [0.1, 0.9]))


def test_quality(spark):
    df = spark.createDataFrame([("A", "20240105", 1.0), ("B", "bad", 2.0)], "asset_id string, day string, v double")
    check = lambda f, **o: quality.response_problem(f, date_field="day", start=d(1), end=d(31), **o)
    assert check(df).startswith("invalid dates") and check(df.where("asset_id='A'")) is None
    assert check(df.where("asset_id='A'"), assets=["C"]).startswith("assets outside")
    assert check(df.where("asset_id='A'").withColumn("v", F.lit(None).cast("double")), payload=["v"]) == "all payload values are null"
    two = spark.createDataFrame([("A", 1, None), ("A", 1, 2), ("B", 1, 1), ("B", 1, 1)], "k string, x int, y int")
    c = quality.conflicts(two, ["k"], ["x", "y"]).collect()
    assert [(r["k"], r["differing_fields"]) for r in c] == [("A", ["y"])]
    old = spark.createDataFrame([("A", "20240101", None), ("B", "20240105", "20240107")], "asset_id string, begin string, until string")
    new = spark.createDataFrame([("A", "20240101", None), ("B", "20240105", "20240109")], "asset_id string, begin string, until string")
    got = quality.changed_intervals(old, new, ["asset_id", "begin", "until"], "begin", "until", d(1), d(31)).collect()
    assert [(r["start"], r["end"]) for r in got] == [(d(5), d(8))]
    assert quality.added_keys(old, new) is None and quality.added_keys(old.where("asset_id='A'"), old).count() == 1
    assert merge_windows([(d(5), d(6)), (d(1), d(2)), (d(3), d(3)), (d(9), d(8))]) == [(d(1), d(3)), (d(5), d(6))]


def test_general_choice():
    log = [{"seq": 1, "pit_date": "2024-01-01", "baseline": 1, "ingested_at": "a"}, {"seq": 2, "pit_date": "2024-01-05", "baseline": 0, "ingested_at": "b"}]
    checks = [{"id": 7, "pit_date": "2024-01-03", "baseline": 0, "visible_commit": 1, "checked_at": "c"}]
    pick = versions.choose_snapshot
    assert pick(log)["seq"] == 2 and pick(log, "2024-01-04")["seq"] == 1
    assert pick(log, "2024-01-02", strict=True) is None and pick(log, "2024-01-04", checks=checks, strict=True)["attestation_id"] == 7
    assert pick(log, "2023-12-31") is None and pick(log, "2023-12-31", include_historical_baseline=True)["seq"] == 1


def test_causal_versions_agree_with_snapshots(spark):
    rows = [(d(1), "A", 1.0, d(1), 1), (d(1), "A", -1.0, d(4), 2), (d(1), "A", 3.0, d(6), 3), (d(2), "B", 5.0, d(3), 1), (d(2), "B", 5.0, d(5), 2), (d(3), "C", -2.0, d(3), 1)]
    items = spark.createDataFrame(rows, "time date, asset_id string, value double, version_available_date date, _commit_seq bigint")
    step = lambda df: df.where("value > 0").withColumn("value", F.col("value") * 10)
    one = pointwise_versions(items, step, drops=True)
    many = compute_versions({}, {"i": items}, d(1), d(9), lambda raw, own: step(own["i"]).select("time", "asset_id", "value"))
    for day in range(1, 10):
        want = sorted((r["time"], r["asset_id"], r["value"]) for r in step(versions.select_versions(items, as_of=d(day))).collect())
        for made in (one, many):
            got = versions.select_versions(made, as_of=d(day)).where("value is not null")
            assert sorted((r["time"], r["asset_id"], r["value"]) for r in got.collect()) == want, day
