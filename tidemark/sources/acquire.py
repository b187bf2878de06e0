"""Acquisition: scopes, requests, pages and runs of providers.

Fetching is driver-side I/O on a bounded thread pool; only the coordinator publishes. Every (day, variant) is a
scope with a state in the ledger: pending, running, success, empty, failed.
"""

from __future__ import annotations

import json
import threading
import time as clock
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, date, datetime, timedelta
from functools import reduce
from itertools import product
from typing import Protocol
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import lenient_date
from tidemark.operators.quality import response_problem
from tidemark.sources.store import normalize
from tidemark.specs import BY_DATE, DatasetSpec

DAY = timedelta(days=1)


class DataSource(Protocol):
    """What a provider adapter offers: rows (dicts) for a request."""

    name: str

    def fetch(self, dataset: str, request: dict) -> list[dict]: ...


class Cancelled(RuntimeError):
    """The caller asked to stop."""


@dataclass
class Limits:
    page_size: int | None = None
    max_pages: int = 1000
    saturation: int | None = None
    retries: int = 3
    backoff: float = 0.0
    calls_per_second: float | None = None
    workers: int = 4
    max_in_flight: int = 8


@dataclass
class RunReport:
    run_id: str
    status: str = "no_data"
    rows: int = 0
    calls: int = 0
    scopes: dict = field(default_factory=dict)
    errors: list = field(default_factory=list)


class RateLimit:
    """At most so many calls a second, over all threads."""

    def __init__(self, per_second: float | None):
        self.gap, self.next, self.lock = 0.0 if not per_second else 1.0 / per_second, 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = clock.monotonic()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            clock.sleep(at - now)


def variants(spec: DatasetSpec, parameters: Iterable | None = None) -> list[dict]:
    """Request parameters: the product of each set's lists, and of the parameter dataset's values."""
    out = []
    for own in spec.source_api_param_sets or ({},):
        lists = [[(k, v) for v in (values if isinstance(values, (list, tuple)) else [values])] for k, values in {**spec.source_api_params, **own}.items()]
        out += [dict(p) for p in product(*lists)]
    if spec.parameter_dataset:
        out = [{**v, spec.parameter_name: p} for v in out for p in sorted(set(parameters or ()))]
    return out


def compact(days: Iterable[date], longest: int | None = None) -> list[tuple[date, date]]:
    """Runs of adjacent days, cut at month ends and at a longest length."""
    out: list[tuple[date, date]] = []
    for d in sorted(set(days)):
        if out and d == out[-1][1] + DAY and d.month == out[-1][1].month and (longest is None or (d - out[-1][0]).days < longest):
            out[-1] = (out[-1][0], d)
        else:
            out.append((d, d))
    return out


def pages(call: Callable[[dict], list[dict]], request: dict, limits: Limits) -> Iterator[list[dict]]:
    """Offset pages until one is short; a page that repeats the one before, or too many, is an error (E5)."""
    if limits.page_size is None:
        yield call(request)
        return
    before = None
    for k in range(limits.max_pages):
        rows = call({**request, "offset": k * limits.page_size, "limit": limits.page_size})
        if rows and rows == before:
            raise RuntimeError(f"the provider repeats a page at offset {k * limits.page_size}")
        yield rows
        if len(rows) < limits.page_size:
            return
        before = rows
    raise RuntimeError(f"more than {limits.max_pages} pages")


def bisected(call: Callable[[dict], list[dict]], request: dict, start: date, end: date, limits: Limits) -> list[dict]:
    """Rows of a date range; a range whose answer is full is halved until answers aren't, or a day remains."""
    rows = [r for page in pages(call, {**request, "start": start, "end": end}, limits) for r in page]
    if limits.saturation is None or len(rows) < limits.saturation:
        return rows
    if start == end:
        raise RuntimeError(f"the answer for {start} is truncated")
    middle = start + (end - start) // 2
    return bisected(call, request, start, middle, limits) + bisected(call, request, middle + DAY, end, limits)


class Acquirer:
    def __init__(self, lake, source: DataSource, limits: Limits | None = None, cancelled: Callable[[], bool] | None = None):
        self.lake, self.source, self.limits = lake, source, limits or Limits()
        self.cancelled, self.rate, self.calls = cancelled or (lambda: False), RateLimit(self.limits.calls_per_second), 0

    def discover(self, api: str, params: dict, field_name: str) -> list:
        """Distinct values of a field that fan out later requests."""
        return sorted({r[field_name] for r in self._call(api, params) if r.get(field_name) is not None})

    def _call(self, dataset: str, request: dict) -> list[dict]:
        """One admitted call with retries."""
        for attempt in range(self.limits.retries + 1):
            if self.cancelled():
                raise Cancelled
            self.rate.wait()
            self.calls += 1
            try:
                return list(self.source.fetch(dataset, request))
            except (OSError, TimeoutError):
                if attempt == self.limits.retries:
                    raise
                clock.sleep(self.limits.backoff * 2**attempt)
        raise AssertionError

    def scopes(self, spec: DatasetSpec, days: list[date], params: list[dict], recheck: bool = True) -> list[tuple[date, str]]:
        """Scopes that are due: new, pending, failed, abandoned, and recent successes."""
        text = [json.dumps(p, sort_keys=True, default=str) for p in params]
        with self.lake.meta.transaction() as db:
            for d in days:
                for v in text:
                    db.execute("INSERT OR IGNORE INTO scopes(source,dataset,day,variant,status) VALUES(?,?,?,?,'pending')", (spec.source, spec.name, d.isoformat(), v))
        recent = set(sorted(days)[-spec.recent_recheck_days :]) if recheck and spec.recent_recheck_days else set()
        wanted = set(days)
        rows = self.lake.meta.rows("SELECT day, variant, status FROM scopes WHERE source=? AND dataset=? ORDER BY day, variant", (spec.source, spec.name))
        return [(date.fromisoformat(r["day"]), r["variant"]) for r in rows if date.fromisoformat(r["day"]) in wanted and r["variant"] in text and (r["status"] in ("pending", "failed") or date.fromisoformat(r["day"]) in recent)]

    def _mark(self, spec: DatasetSpec, scopes: list[tuple[date, str]], status: str, run: str, error: str | None = None) -> None:
        now = datetime.now(UTC).isoformat()
        with self.lake.meta.transaction() as db:
            for d, v in scopes:
                db.execute("UPDATE scopes SET status=?, attempts=attempts+?, error=?, checked_at=?, run_id=? WHERE source=? AND dataset=? AND day=? AND variant=?", (status, int(status == "running"), error, now, run, spec.source, spec.name, d.isoformat(), v))

    def update(self, dataset: str, *, days: list[date] | None = None, parameters: Iterable | None = None, mode: str = "incremental", schema: str | None = None, longest: int | None = 31, ingested_at: datetime | None = None) -> RunReport:
        """Fetch what is due and publish it (E9, E10, D16). Fetches run in threads; ranges publish in order."""
        spec = self.lake.raw.get(dataset, source=self.source.name)
        report = RunReport(uuid4().hex)
        started = datetime.now(UTC).isoformat()
        with self.lake.meta.transaction() as db:
            db.execute("INSERT INTO runs(id,source,dataset,status,started_at) VALUES(?,?,?,'running',?)", (report.run_id, spec.source, spec.name, started))
        try:
            run = self._dated if spec.update_type == BY_DATE else self._general
            run(spec, report, days or [], variants(spec, parameters), mode, schema, longest, ingested_at)
        except Cancelled:
            report.status = "cancelled"
        except Exception as error:  # noqa: BLE001  reported as the run's failure
            report.status, report.errors = "failed", [*report.errors, str(error).splitlines()[0]]
        report.calls = self.calls
        report.scopes = self.lake.integrity.update_summary(dataset, source=spec.source)
        with self.lake.meta.transaction() as db:
            db.execute("UPDATE runs SET status=?, ended_at=?, rows=?, calls=?, error=? WHERE id=?", (report.status, datetime.now(UTC).isoformat(), report.rows, report.calls, "; ".join(report.errors) or None, report.run_id))
        return report

    def _frame(self, rows: list[dict], schema: str | None) -> DataFrame:
        return self.lake.spark.createDataFrame(rows, schema)

    def _general(self, spec, report, days, params, mode, schema, longest, ingested_at) -> None:
        """All variants make one snapshot; if one fails, the snapshot before stays."""
        rows = [r for p in params for page in pages(lambda q: self._call(spec.source_api or spec.name, q), p, self.limits) for r in page]
        if not rows and schema is None:
            raise RuntimeError("an empty answer needs a declared schema")
        done = self.lake.raw.ingest(spec, self._frame(rows, schema), mode=mode, ingested_at=ingested_at, run_id=report.run_id)
        report.rows, report.status = done.rows, "success" if rows else "no_data"

    def _dated(self, spec, report, days, params, mode, schema, longest, ingested_at) -> None:
        due: dict[str, list[date]] = {}
        for d, v in self.scopes(spec, days, params):
            due.setdefault(v, []).append(d)
        work = [(v, a, b) for v, own in due.items() for a, b in compact(own, longest)]
        work.sort(key=lambda w: (w[1], w[0]))
        good = bad = 0
        with ThreadPoolExecutor(self.limits.workers) as pool:
            for k in range(0, len(work), self.limits.max_in_flight):
                part = work[k : k + self.limits.max_in_flight]
                for w in part:
                    self._mark(spec, self._inside(due, w), "running", report.run_id)
                fetches = [pool.submit(bisected, lambda q: self._call(spec.source_api or spec.name, q), json.loads(v), a, b, self.limits) for v, a, b in part]
                for w, fetch in zip(part, fetches, strict=True):
                    mine = self._inside(due, w)
                    try:
                        found = self._publish(spec, report, fetch.result(), w, mode, schema, ingested_at)
                        self._mark(spec, [s for s in mine if s[0] in found], "success", report.run_id)
                        self._mark(spec, [s for s in mine if s[0] not in found], "empty", report.run_id)
                        good += 1
                    except Cancelled:
                        for x in part[part.index(w) :]:
                            self._mark(spec, self._inside(due, x), "pending", report.run_id)
                        raise
                    except Exception as error:  # noqa: BLE001  one range's failure doesn't stop the others
                        bad += 1
                        report.errors.append(str(error).splitlines()[0])
                        self._mark(spec, mine, "failed", report.run_id, report.errors[-1])
        report.status = "failed" if bad and not good else "partial" if bad else "success" if report.rows or good else "no_data"

    @staticmethod
    def _inside(due: dict, w: tuple) -> list[tuple[date, str]]:
        return [(d, w[0]) for d in due[w[0]] if w[1] <= d <= w[2]]

    def _publish(self, spec, report, rows, w, mode, schema, ingested_at) -> set[date]:
        """Validate an answer and publish it; the days that it has rows for."""
        if not rows:
            return set()
        df = self._frame(rows, schema)
        dated = next(s for s, t in spec.field_mappings.items() if t == "time")
        own = df.withColumnsRenamed({s: t for s, t in spec.field_mappings.items() if t == "asset_id" and s != t})
        problem = response_problem(own, date_field=dated, start=w[1], end=w[2])
        if problem:
            self.lake.store.reject(spec, report.run_id, "invalid", df)
            raise ValueError(problem)
        report.rows += self.lake.store.commit(spec, normalize(spec, df), mode=mode, ingested_at=ingested_at, run_id=report.run_id).rows
        day = lenient_date(F.col(dated), df.schema[dated].dataType)
        return {r[0] for r in df.select(day).distinct().collect()}  # days of one range

    def coverage(self, dataset: str, days: list[date], params: list[dict] | None = None) -> list[tuple[date, str]]:
        """Scopes of a calendar that were never answered (Q8)."""
        spec = self.lake.raw.get(dataset, source=self.source.name)
        done = {(r["day"], r["variant"]) for r in self.lake.integrity.update_scopes(dataset, source=spec.source) if r["status"] in ("success", "empty")}
        text = [json.dumps(p, sort_keys=True, default=str) for p in params or variants(spec)]
        return [(d, v) for d in days for v in text if (d.isoformat(), v) not in done]

    def reset_scopes(self, dataset: str, days: list[date]) -> int:
        spec = self.lake.raw.get(dataset, source=self.source.name)
        with self.lake.meta.transaction() as db:
            return reduce(lambda n, d: n + db.execute("UPDATE scopes SET status='pending', error=NULL WHERE source=? AND dataset=? AND day=? AND status<>'running'", (spec.source, spec.name, d.isoformat())).rowcount, days, 0)
