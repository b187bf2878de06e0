"""The metadata store: declarations, commits, checks, receipts, leases, categories and the acquisition ledger.

It is a small SQLite database on the driver; each publication is one immediate transaction. Data never passes
through it.
"""

from __future__ import annotations

import json
import sqlite3
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta
from pathlib import Path
from uuid import uuid4

TABLES = """
CREATE TABLE IF NOT EXISTS state(key TEXT PRIMARY KEY, value TEXT);
CREATE TABLE IF NOT EXISTS datasets(source TEXT, name TEXT, kind TEXT, spec TEXT, spec_hash TEXT, active INT DEFAULT 1, enabled INT DEFAULT 1, PRIMARY KEY(source, name));
CREATE TABLE IF NOT EXISTS commits(seq INTEGER PRIMARY KEY AUTOINCREMENT, source TEXT, dataset TEXT, run_id TEXT, ingested_at TEXT, pit_date TEXT, mode TEXT, status TEXT, spec_hash TEXT, baseline INT, row_count INT, schema TEXT, path TEXT, digest TEXT, requests TEXT, receipt TEXT, changes TEXT);
CREATE TABLE IF NOT EXISTS segments(seq INT, month TEXT, path TEXT, row_count INT, min_obs TEXT, max_obs TEXT, min_avail TEXT, max_avail TEXT, max_delay INT);
CREATE TABLE IF NOT EXISTS checks(id INTEGER PRIMARY KEY AUTOINCREMENT, source TEXT, dataset TEXT, run_id TEXT, checked_at TEXT, pit_date TEXT, baseline INT, visible_commit INT, row_count INT, path TEXT, min_obs TEXT, max_obs TEXT, receipt TEXT, schema TEXT);
CREATE TABLE IF NOT EXISTS leases(source TEXT, dataset TEXT, owner TEXT, started_at TEXT, expires_at TEXT, PRIMARY KEY(source, dataset));
CREATE TABLE IF NOT EXISTS receipts(id TEXT PRIMARY KEY, digest TEXT UNIQUE, payload TEXT, checksum TEXT);
CREATE TABLE IF NOT EXISTS dependencies(item TEXT, kind TEXT, source TEXT, dataset TEXT);
CREATE TABLE IF NOT EXISTS builds(id INTEGER PRIMARY KEY AUTOINCREMENT, item TEXT, definition_hash TEXT, receipt TEXT, start TEXT, end TEXT, cutoff TEXT, rows INT, result_commit INT, created_at TEXT, complete INT DEFAULT 1);
CREATE TABLE IF NOT EXISTS categories(id TEXT PRIMARY KEY, space TEXT, parent TEXT, name TEXT, description TEXT);
CREATE TABLE IF NOT EXISTS assignments(space TEXT, key TEXT, category TEXT, PRIMARY KEY(space, key));
CREATE TABLE IF NOT EXISTS sources(name TEXT PRIMARY KEY, config TEXT, enabled INT DEFAULT 1);
CREATE TABLE IF NOT EXISTS scopes(source TEXT, dataset TEXT, day TEXT, variant TEXT, status TEXT, attempts INT DEFAULT 0, error TEXT, checked_at TEXT, run_id TEXT, PRIMARY KEY(source, dataset, day, variant));
CREATE TABLE IF NOT EXISTS runs(id TEXT PRIMARY KEY, source TEXT, dataset TEXT, status TEXT, started_at TEXT, ended_at TEXT, rows INT, calls INT, error TEXT);
"""


class LeaseError(RuntimeError):
    """Another writer holds the dataset."""


class Metadata:
    def __init__(self, path: Path, read_only: bool = False):
        self.path, self.read_only = Path(path), read_only
        if not read_only:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            with self.connect() as db:
                db.executescript(TABLES)
                db.execute("INSERT OR IGNORE INTO state VALUES('format', '1')")

    @contextmanager
    def connect(self):
        db = sqlite3.connect(f"file:{self.path}{'?mode=ro' if self.read_only else ''}", uri=True, isolation_level=None, timeout=30)
        db.row_factory = sqlite3.Row
        try:
            yield db
        finally:
            db.close()

    @contextmanager
    def transaction(self):
        """One atomic publication; nothing stays if it fails."""
        if self.read_only:
            raise PermissionError("the lake is open for reading only")
        with self.connect() as db:
            db.execute("BEGIN IMMEDIATE")
            try:
                yield db
            except BaseException:
                db.execute("ROLLBACK")
                raise
            db.execute("COMMIT")

    def rows(self, sql: str, args: tuple = ()) -> list[dict]:
        with self.connect() as db:
            return [dict(r) for r in db.execute(sql, args)]

    def one(self, sql: str, args: tuple = ()) -> dict | None:
        found = self.rows(sql, args)
        return found[0] if found else None

    def snapshot(self, source: str, dataset: str) -> dict:
        """Commits, segments and checks from one read transaction: later publications can't change a planned read."""
        with self.connect() as db:
            db.execute("BEGIN")
            get = lambda sql: [dict(r) for r in db.execute(sql, (source, dataset))]
            out = {
                "commits": get("SELECT * FROM commits WHERE source=? AND dataset=? AND status='committed' ORDER BY seq"),
                "checks": get("SELECT * FROM checks WHERE source=? AND dataset=? ORDER BY id"),
                "segments": get("SELECT s.* FROM segments s JOIN commits c ON c.seq = s.seq WHERE c.source=? AND c.dataset=? AND c.status='committed'"),
            }
            db.execute("COMMIT")
        for c in out["commits"]:
            c["changes"] = json.loads(c["changes"]) if c["changes"] else None
        return out

    @contextmanager
    def lease(self, source: str, dataset: str, owner: str | None = None, minutes: int = 60):
        """Exclusive writing of a dataset. Expiry is reported, it never frees; ``abandon`` does."""
        owner, now = owner or uuid4().hex, datetime.now(UTC)
        with self.transaction() as db:
            held = db.execute("SELECT owner FROM leases WHERE source=? AND dataset=?", (source, dataset)).fetchone()
            if held and held["owner"] != owner:
                raise LeaseError(f"{source}/{dataset} is held by {held['owner']}")
            nested = held is not None
            if not nested:
                db.execute("INSERT INTO leases VALUES(?,?,?,?,?)", (source, dataset, owner, now.isoformat(), (now + timedelta(minutes=minutes)).isoformat()))
        try:
            yield owner
        finally:
            if not nested:
                with self.transaction() as db:
                    db.execute("DELETE FROM leases WHERE source=? AND dataset=? AND owner=?", (source, dataset, owner))

    def active_leases(self) -> list[dict]:
        now = datetime.now(UTC).isoformat()
        return [{**r, "expired": r["expires_at"] < now} for r in self.rows("SELECT * FROM leases ORDER BY source, dataset")]

    def abandon(self, owner: str) -> None:
        """Give up an owner's leases; its running scopes fail and its runs are cancelled."""
        with self.transaction() as db:
            db.execute("DELETE FROM leases WHERE owner=?", (owner,))
            db.execute("UPDATE scopes SET status='failed', error='abandoned' WHERE run_id=? AND status='running'", (owner,))
            db.execute("UPDATE runs SET status='cancelled' WHERE id=? AND status='running'", (owner,))

    def get_spec(self, source: str, name: str, include_inactive: bool = False) -> dict:
        found = self.one("SELECT * FROM datasets WHERE source=? AND name=?", (source, name))
        if found is None or not (found["active"] or include_inactive):
            raise KeyError(f"unknown dataset: {source}/{name}")
        return {**found, "spec": json.loads(found["spec"])}
