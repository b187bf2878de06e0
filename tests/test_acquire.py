"""Acquisition with a fake provider, and streams."""

from datetime import UTC, date, datetime, timedelta

import pytest

from tidemark.lake import Lake
from tidemark.sources.acquire import Acquirer, Limits, bisected, compact, pages, variants
from tidemark.specs import DatasetSpec
from tidemark.streaming.ingest import stream_into

SPEC = DatasetSpec("daily", "by_date", "fake", date_kind="calendar", recent_recheck_days=0, field_mappings={"day": "time", "code": "asset_id"}, source_api_param_sets=({"board": ["x", "y"]},))
SCHEMA = "day string, code string, close double"
DAYS = [date(2024, 1, 30) + timedelta(days=k) for k in range(5)]


class Fake:
    name = "fake"

    def __init__(self):
        self.seen, self.broken = [], set()

    def fetch(self, dataset, request):
        self.seen.append(request)
        if request.get("board") in self.broken:
            raise ValueError("no access")
        a, b = request["start"], request["end"]
        days = [a + timedelta(days=k) for k in range((b - a).days + 1)]
        rows = [{"day": d.isoformat(), "code": request["board"] + str(n), "close": float(d.day)} for d in days if d.day != 1 for n in range(2)]
        return rows[request.get("offset", 0) :][: request.get("limit", 10**9)]


def test_variants_ranges_and_pages():
    assert variants(SPEC) == [{"board": "x"}, {"board": "y"}]
    assert variants(DatasetSpec("d", "general", parameter_dataset="p", parameter_name="id"), ["b", "a", "a"]) == [{"id": "a"}, {"id": "b"}]
    assert compact(DAYS) == [(date(2024, 1, 30), date(2024, 1, 31)), (date(2024, 2, 1), date(2024, 2, 3))]
    call = lambda r: list(range(10))[r["offset"] : r["offset"] + r["limit"]]
    assert [x for p in pages(call, {}, Limits(page_size=4)) for x in p] == list(range(10))
    with pytest.raises(RuntimeError, match="repeats"):
        list(pages(lambda r: [1, 2], {}, Limits(page_size=2)))
    calls = []

    def ranged(r):
        calls.append((r["start"], r["end"]))
        return [r["start"] + timedelta(days=k) for k in range((r["end"] - r["start"]).days + 1)][:4]

    assert bisected(ranged, {}, DAYS[0], DAYS[0] + timedelta(days=8), Limits(saturation=4)) == [DAYS[0] + timedelta(days=k) for k in range(9)]
    with pytest.raises(RuntimeError, match="truncated"):
        bisected(lambda r: [1] * 4, {}, DAYS[0], DAYS[0], Limits(saturation=4))


def test_update_run(spark, tmp_path):
    lake, fake = Lake(spark, tmp_path / "lake"), Fake()
    lake.raw.register(SPEC)
    fake.broken = {"y"}
    run = Acquirer(lake, fake, Limits(page_size=3))
    report = run.update("daily", days=DAYS, schema=SCHEMA, ingested_at=datetime(2024, 2, 5, tzinfo=UTC))
    assert report.status == "partial" and report.rows == 8
    assert report.scopes == {"success": 4, "empty": 1, "failed": 5}
    fake.broken, fake.seen = set(), []
    again = Acquirer(lake, fake).update("daily", days=DAYS, schema=SCHEMA, ingested_at=datetime(2024, 2, 6, tzinfo=UTC))
    assert again.status == "success" and again.rows == 8 and all(r["board"] == "y" for r in fake.seen)
    assert lake.raw.read("daily", source="fake", view="latest").count() == 16
    assert Acquirer(lake, fake).coverage("daily", DAYS) == [] and len(lake.integrity.runs("daily")) == 2
    stopped = Acquirer(lake, fake, cancelled=lambda: True)
    assert stopped.reset_scopes("daily", DAYS[:1]) == 2
    assert stopped.update("daily", days=DAYS, schema=SCHEMA).status == "cancelled"
    assert lake.integrity.update_summary("daily", source="fake")["pending"] == 2


def test_stream(spark, tmp_path):
    lake = Lake(spark, tmp_path / "lake")
    spec = lake.raw.register(DatasetSpec("s", "by_date", "fake", date_kind="calendar", field_mappings={"day": "time", "code": "asset_id"}))
    spark.createDataFrame([("20240102", "A", 1.0), ("20240103", "A", 2.0)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    for n in (2, 2):
        stream_into(lake, spec, spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "cp"), ingested_at=datetime(2024, 1, 5, tzinfo=UTC)).awaitTermination(120)
        assert lake.raw.read("s", source="fake", view="latest").count() == n
