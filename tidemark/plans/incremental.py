"""Incremental planning: which output days an update has to rebuild (T10). What isn't known blocks.

Bounds of commits come from metadata alone. Data is read only where a policy asks for it: the calendar of a limited
history (a row per day), and snapshots of general inputs that changed, which are compared by Spark.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import as_date, lenient_date
from tidemark.functions.identity import multiset_diff
from tidemark.operators.quality import added_keys, changed_intervals
from tidemark.operators.versions import choose_snapshot

DAY = timedelta(days=1)


@dataclass(frozen=True)
class Plan:
    action: str  # initialize, incremental, attest or blocked
    windows: tuple[tuple[date, date], ...]
    reason: str | None = None
    available_date: date | None = None


class Unknown(Exception):
    """Why the impact of a change can't be told."""


def merge_windows(windows: list[tuple[date, date]]) -> list[tuple[date, date]]:
    """Inclusive windows merged where they overlap or touch."""
    out: list[tuple[date, date]] = []
    for a, b in sorted(w for w in windows if w[0] <= w[1]):
        if out and a <= out[-1][1] + DAY:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def check_policy(lake, spec, policy) -> None:
    """Whether the inputs that a policy speaks of are of the kind that it means."""
    from tidemark.specs import RawInput, SpecError

    inputs = {i.key: i for i in spec.inputs}
    kind = lambda a: lake.raw.get(inputs[a].dataset, source=inputs[a].source, include_inactive=True).update_type if isinstance(inputs.get(a), RawInput) else None
    for a, _ in policy.general_fields:
        if kind(a) != "general":
            raise SpecError(f"{spec.name}: general_fields speaks of {a}, which is no general raw input")
    for a in policy.output_anchors:
        if kind(a) != "by_date":
            raise SpecError(f"{spec.name}: output anchor {a} is no dated raw input")
    for a in (policy.calendar_input, *policy.timing_neutral_inputs):
        if a is not None and a not in inputs:
            raise SpecError(f"{spec.name}: its policy speaks of {a}, which is no input")


class Planner:
    def __init__(self, lake, spec, receipt: dict, policy, start: date, completed: date, cutoff: date, end: date):
        self.lake, self.spec, self.receipt, self.policy = lake, spec, receipt, policy
        self.start, self.completed, self.cutoff, self.end = start, completed, cutoff, end
        self.windows: list[tuple[date, date]] = []
        self.checks: list[dict] = []
        self._calendar: list[date] | None = None

    def plan(self) -> Plan:
        try:
            for alias, i in self.receipt["inputs"].items():
                self._input(alias, i)
        except Unknown as why:
            return Plan("blocked", (), str(why))
        windows = list(self.windows)
        if not windows and self.checks:
            verified = max(as_date(c["pit_date"]) for c in self.checks)
            if not self._unproven(self.end):  # all that the output rests on is proven by now: so is the output
                return Plan("attest", ((self.completed + DAY, self.end),) if self.end > self.completed else (), None, verified)
            for c in self.checks:
                windows.append(self._affected(as_date(c["min_obs"]), as_date(c["max_obs"])))
        if self.end > self.completed:
            windows.append((self.completed + DAY, self.end))
        return Plan("incremental", tuple(merge_windows([(max(a, self.start), min(b, self.end)) for a, b in windows])))

    def _input(self, alias: str, i: dict) -> None:
        now = self.lake.meta.get_spec(i["source"], i["dataset"])
        if now["spec_hash"] != i["spec_hash"]:
            raise Unknown(f"the definition of {alias} changed")
        snap = self.lake.meta.snapshot(i["source"], i["dataset"])
        captured = {c[0] for c in i["commits"]}
        if now["spec"].get("update_type") == "general":
            self._general(alias, i, snap, captured)
            return
        commits = {c["seq"]: c for c in snap["commits"]}
        for s in snap["segments"]:
            new = s["seq"] not in captured
            # captured, but not all visible at the old cutoff
            later = (s["max_avail"] or "") > self.cutoff.isoformat()
            if not new and not later or (s["min_avail"] or "") > self.end.isoformat() or new and self._unused(i, commits[s["seq"]]):
                continue
            if self.policy is None:
                raise Unknown("the producer declares no update policy")
            if s["min_obs"] is None:
                raise Unknown(f"bounds of {alias} are unknown")
            low, high = as_date(s["min_obs"]), as_date(s["max_obs"])
            if not new and s["max_delay"] is not None:
                low = max(low, self.cutoff + DAY - timedelta(days=s["max_delay"]))
            if low <= self.completed:
                self.windows.append(self._affected(max(low, self.start), high))
        for c in snap["checks"]:  # rows that became verified count from their first verified date
            if c["path"] and c["id"] not in i["checks"] and not c["baseline"] and c["pit_date"] <= self.end.isoformat():
                if self.policy is None:
                    raise Unknown("the producer declares no update policy")
                if alias in self.policy.timing_neutral_inputs and self._unproven(self.cutoff) and self._unproven(self.end):
                    continue  # values don't depend on it, and the output stays unproven either way
                self.checks.append(c)

    def _unused(self, i: dict, commit: dict) -> bool:
        """Whether a verified revision changed only fields that the input doesn't select (K5)."""
        changes = commit["changes"]
        return bool(i["fields"]) and changes is not None and not commit["baseline"] and "$initial" not in changes and not set(changes) & set(i["fields"])

    def _affected(self, low: date, high: date) -> tuple[date, date]:
        p = self.policy
        if p.historical_impact == "same_date":
            return low, min(high, self.completed)
        if p.history_observations is None:
            return low, self.end
        days = self.calendar()
        at = bisect_right(days, high) - 1 + p.history_observations
        return low, min(self.end, days[max(0, at)]) if at < len(days) else self.end

    def calendar(self) -> list[date]:
        """The days of the policy's calendar as known at the end of the update: a row per day."""
        if self._calendar is None:
            p = self.policy
            source = next(i for i in self.spec.inputs if i.key == p.calendar_input)
            receipt = self.lake.inputs.freeze({"calendar": source}, information_cutoff=self.end)
            df = self.lake.inputs.read(receipt, "calendar")
            if "source_time" in df.columns and p.calendar_field == "time":
                df = df.withColumn("time", F.col("source_time"))
            if p.calendar_selector is not None:
                field, value = p.calendar_selector
                df = df.where(F.col(field).try_cast("bigint") == value)
            day = lenient_date(F.col(p.calendar_field), df.schema[p.calendar_field].dataType)
            self._calendar = sorted(r[0] for r in df.select(day.alias("d")).where("d is not null").distinct().collect())
        return self._calendar

    def _unproven(self, at: date) -> bool:
        """Whether any input still rests on unproven history at a date."""
        receipt = self.lake.inputs.freeze({i.key: i for i in self.spec.inputs}, information_cutoff=at)
        return any(self.lake.inputs.has_baseline(receipt, i.key, at) for i in self.spec.inputs)

    def _general(self, alias: str, i: dict, snap: dict, captured: set) -> None:
        old_commits = [c for c in snap["commits"] if c["seq"] in captured]
        old_checks = [c for c in snap["checks"] if c["id"] in i["checks"]]
        old = choose_snapshot(old_commits, self.cutoff, checks=old_checks, include_historical_baseline=True)
        seen = lambda c: as_date(c["pit_date"]) <= self.end
        states = [c for c in snap["commits"] if seen(c) and (c["seq"] not in captured or as_date(c["pit_date"]) > self.cutoff and not c["baseline"])]
        if not states or self._no_coordinates():
            return
        fields = dict(self.policy.general_fields).get(alias) if self.policy is not None else None
        if fields is None:
            raise Unknown(f"{alias} has another general snapshot, and no policy says which of its fields are used")
        if alias not in self.policy.timing_neutral_inputs or old is None:
            raise Unknown(f"{alias}: when its snapshots became known may matter")
        for state in states:  # each of them, not the last alone: a change may be taken back
            before = choose_snapshot(old_commits, min(self.cutoff, as_date(state["pit_date"])), checks=old_checks, include_historical_baseline=True)
            if before is None or bool(before["baseline"]) != bool(state["baseline"]) and not self._unproven(self.end):
                raise Unknown(f"{alias}: its history became known or proven at {state['pit_date']}")
            a, b = (self._projected(i, snap, c, fields, alias) for c in (before, state))
            if not multiset_diff(a, b, list(fields)).isEmpty():
                self._changed(alias, a, b, fields)

    def _projected(self, i: dict, snap: dict, commit: dict, fields: tuple, alias: str) -> DataFrame:
        df = self.lake.store.scan(i["source"], i["dataset"], snap, commits=[commit["seq"]])
        missing = [f for f in fields if f not in df.columns]
        if missing:
            raise Unknown(f"{alias}: a snapshot has no {missing}")
        return df.select(*fields)

    def _changed(self, alias: str, old: DataFrame, new: DataFrame, fields: tuple) -> None:
        p = self.policy
        if alias in p.general_asset_local_inputs:
            added = added_keys(old, new, "asset_id")
            if added is not None and not self._anchored(added):
                return  # new assets, none of which has a completed coordinate
        interval = next((x[1:] for x in p.general_intervals if x[0] == alias), None)
        if interval is None:
            raise Unknown(f"{alias}: fields that are used changed: {sorted(fields)}")
        try:
            days = changed_intervals(old, new, list(fields), *interval, self.start, self.completed).collect()  # merged days
        except ValueError as why:
            raise Unknown(f"{alias}: {why}") from why
        self.windows += [(r["start"], r["end"]) for r in days]

    def _no_coordinates(self) -> bool:
        """Whether the output can't have a completed coordinate, by the bounds of its anchors."""
        if self.policy is None or not self.policy.output_anchors:
            return False
        for alias in self.policy.output_anchors:
            i = self.receipt["inputs"][alias]
            for s in self.lake.meta.snapshot(i["source"], i["dataset"])["segments"]:
                visible = s["min_avail"] is None or as_date(s["min_avail"]) <= self.end
                if s["row_count"] and visible and (s["min_obs"] is None or as_date(s["min_obs"]) <= self.completed and as_date(s["max_obs"]) >= self.start):
                    return False
        return True

    def _anchored(self, added: DataFrame) -> bool:
        """Whether an added asset, or a row without an asset, has a coordinate among the completed ones."""
        if not added.where("asset_id is null").isEmpty():
            return True
        receipt = self.lake.inputs.freeze({i.key: i for i in self.spec.inputs if i.key in self.policy.output_anchors}, information_cutoff=self.end)
        for alias in self.policy.output_anchors:
            anchor = self.lake.inputs.read(receipt, alias, view="versions", start=self.start, end=self.completed)
            if not anchor.join(added.select(F.col("asset_id").cast("string").alias("asset_id")).distinct(), "asset_id", "left_semi").isEmpty():
                return True
        return False


def plan_windows(lake, spec, receipt: dict, policy, start: date, completed: date, cutoff: date, end: date) -> Plan:
    """Windows of changed inputs, of content that becomes visible, and of appended days."""
    return Planner(lake, spec, receipt, policy, start, completed, cutoff, end).plan()
