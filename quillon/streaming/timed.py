"""Streams with timers of event time: a folder's files as they change, and entries that expire.

Both keep a small state for each key and one timer, which fires when the watermark has passed it; so state goes even for keys that
nothing more comes for. They need the RocksDB state store (``use_rocksdb``). Late rows (behind the watermark) are dropped by Spark; rows of one
key in a batch are taken in order of time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.textindex import TextIndex

CLAIM_SECONDS, STATE_SECONDS = 30 * 60, 24 * 3600
_EPOCH = datetime(1970, 1, 1)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _seconds(ts) -> float:
    return (pd.Timestamp(ts).to_pydatetime().replace(tzinfo=None) - _EPOCH) / timedelta(seconds=1)


def _time(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc).replace(tzinfo=None)


class _Timed(StatefulProcessor):
    """One timer for each key, moved whenever the state changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def _wake_at(self, seconds: float | None) -> None:
        for ms in list(self.handle.listTimers()):
            self.handle.deleteTimer(ms)
        if seconds is not None:
            self.handle.registerTimer(int(seconds * 1000))

    def close(self) -> None:
        pass


class _File(_Timed):
    def __init__(self, quiet: float, gap: float):
        self.quiet, self.gap = quiet, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("file", "known string, pending string, since double, seen double")

    def _due(self, path: str, s: list, now: float, out: list) -> None:
        """What has happened by ``now``: s is [known hash, hash to be told, since when, last seen]."""
        if s[1] is not None and now >= s[2] + self.quiet and s[2] + self.quiet < s[3] + self.gap:
            out.append((path, "added" if s[0] is None else "changed", s[1], _time(s[2] + self.quiet)))
            s[0], s[1] = s[1], None
        if s[3] is not None and now >= s[3] + self.gap:
            if s[0] is not None:
                out.append((path, "removed", s[0], _time(s[3] + self.gap)))
            s[:] = [None, None, None, None]

    def _keep(self, s: list) -> None:
        if s[3] is None:
            self.state.clear()
            self._wake_at(None)
        else:
            self.state.update(tuple(s))
            self._wake_at(min(s[3] + self.gap, s[2] + self.quiet if s[1] is not None else float("inf")))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, out = list(self.state.get()) if self.state.exists() else [None, None, None, None], []
        for ts, digest in pd.concat(list(rows)).sort_values("ts", kind="stable")[["ts", "content_hash"]].itertuples(index=False):
            now = _seconds(ts)
            self._due(key[0], s, now, out)
            if digest == s[0]:
                s[1] = None
            elif digest != s[1]:
                s[1], s[2] = digest, now
            s[3] = now
        self._keep(s)
        yield _frame(out, ["path", "kind", "content_hash", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, out = list(self.state.get()) if self.state.exists() else [None, None, None, None], []
        self._due(key[0], s, expiredTimerInfo.getExpiryTimeInMs() / 1000, out)
        self._keep(s)
        yield _frame(out, ["path", "kind", "content_hash", "at"])


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def file_changes(listings: DataFrame, quiet: float = 2, gap: float = 10, delay: str = "0 seconds") -> DataFrame:
    """(path, kind, content_hash, at) of files added, changed and removed, from listings (ts, path, content_hash) of a folder.

    A listing names all files there are at its time. A new or changed file is told once its hash has stood still for ``quiet`` seconds
    (each change begins them anew; one that is undone before is not told). A file that later listings don't name for ``gap`` seconds is
    gone, and its state with it: so ``gap`` is more than the time from one listing to the next. A file that is renamed is gone and added.
    """
    return listings.select("ts", "path", "content_hash").withWatermark("ts", delay).groupBy("path").transformWithStateInPandas(
        _File(quiet, gap), "path string, kind string, content_hash string, at timestamp", "append", "EventTime"
    )


def renames(changes: DataFrame, gap: float = 10) -> DataFrame:
    """(old, new, content_hash): removed and added files of one hash, the added one at most ``gap`` seconds before or behind; each once."""
    gone = changes.where("kind = 'removed'").select(F.col("path").alias("old"), "content_hash", F.col("at").alias("gone"))
    came = changes.where("kind = 'added'").select(F.col("path").alias("new"), "content_hash", F.col("at").alias("came"))
    met = gone.join(came, "content_hash").where("old <> new").withColumn("apart", F.abs(F.unix_micros("came") - F.unix_micros("gone"))).where(F.col("apart") <= gap * 1e6)
    first = lambda x: F.row_number().over(Window.partitionBy("content_hash", x).orderBy("apart", "old", "new"))
    return met.withColumns({"i": first("old"), "j": first("new")}).where("i = 1 and j = 1").select("old", "new", "content_hash")


def index_changes(index: TextIndex, notes_of: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A handler for ``foreachBatch`` that keeps a text index up with ``file_changes``.

    ``notes_of`` gives the notes (id, path, title, text) of rows (path, content_hash), of removed files too (their ids suffice). Of several changes of a
    path in a batch the last counts. A batch that is handled twice leaves the index as if handled once.
    """

    def handle(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("kind", F.struct("at", F.col("kind") != "removed")).alias("kind"), F.max_by("content_hash", "at").alias("content_hash"))
        if last.limit(1).count():
            notes = notes_of(last.select("path", "content_hash"))
            keep = last.where("kind <> 'removed'").select("path")
            index.apply(notes.join(keep, "path", "left_semi"), notes.join(keep, "path", "left_anti").select("id"))

    return handle


class _Entry(_Timed):
    def __init__(self, names: list[str], seconds: float):
        self.names, self.seconds = names, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("entry", "value string, until double")

    def _ended(self, key, value: str | None, until: float) -> tuple:
        return (*key, "expired", value, _time(until), _time(until))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, held = [], self.state.get() if self.state.exists() else None
        for ts, value, seconds in pd.concat(list(rows)).sort_values("ts", kind="stable")[["ts", "value", "seconds"]].itertuples(index=False):
            now, lasts = _seconds(ts), self.seconds if pd.isna(seconds) else float(seconds)
            if held is not None and now >= held[1]:
                out.append(self._ended(key, *held))
                held = None
            until = max(now + lasts, held[1] if held else 0.0)
            out.append((*key, "set" if held is None else "renewed", value, _time(now), _time(until)))
            held = (value, until)
        self.state.update(held)
        self._wake_at(held[1])
        yield _frame(out, [*self.names, "event", "value", "at", "until"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            out.append(self._ended(key, *self.state.get()))
            self.state.clear()
        yield _frame(out, [*self.names, "event", "value", "at", "until"])


def expiring(rows: DataFrame, keys: list[str], seconds: float, delay: str = "10 minutes") -> DataFrame:
    """(keys, event, value, at, until) of entries (keys, ts, value, seconds) that are set, renewed and expire.

    An entry lasts for its own ``seconds`` or, where they are null, for the default; a renewal never shortens it. When event time has passed
    its end an entry is told as expired and its state is gone, whether more rows of its key come or not.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "event string, value string, at timestamp, until timestamp"])
    return rows.select(*keys, "ts", F.col("value").cast("string").alias("value"), F.col("seconds").cast("double").alias("seconds")).withWatermark("ts", delay).groupBy(*keys).transformWithStateInPandas(
        _Entry(keys, seconds), schema, "append", "EventTime"
    )


def claims(rows: DataFrame) -> DataFrame:
    """Claims (path, agent, type, ts, seconds) on files that expire, after half an hour where they don't say when."""
    return expiring(rows.withColumn("value", F.lit(None).cast("string")), ["path", "agent", "type"], CLAIM_SECONDS)


def session_state(rows: DataFrame) -> DataFrame:
    """Values (session_id, key, ts, value) that go a day after they were set last."""
    return expiring(rows.withColumn("seconds", F.lit(None).cast("double")), ["session_id", "key"], STATE_SECONDS)
