"""Streams of files, prompts and uses.

Late rows: ten minutes of watermark. State is kept by key and times out, so it doesn't grow with the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "10 minutes"
DEBOUNCE = {"stop": 300, "precompact": 120}


def budget_stream(usage: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Uses of each hook in sessions closed by a gap."""
    return usage.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", gap).alias("w"), "user_id", "hook_name").agg(
        F.count("*").alias("injections"), F.count_if("was_referenced").alias("referenced"), F.sum("estimated_tokens").alias("tokens")
    ).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "user_id", "hook_name", "injections", "referenced", "tokens")


def _keyed(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable")


def _expire(state: GroupState, rows: pd.DataFrame, seconds: int) -> None:
    """The key's state goes when event time has passed its last row by so many seconds."""
    last = int(rows["ts"].iloc[-1].timestamp() * 1000)
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + seconds * 1000)


def debounced(events: DataFrame, seconds: int = 300) -> DataFrame:
    """Events (session_id, hook_name, ts) that fire: the first, and each that comes ``seconds`` or more after the last that fired."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        out_of = _keyed(rows)
        for ts in out_of["ts"]:
            now = ts.timestamp()
            if last is None or now - last >= seconds:
                last = now
                out.append((*key, ts))
        state.update((last,))
        _expire(state, out_of, 24 * 3600)
        yield pd.DataFrame(out, columns=["session_id", "hook_name", "ts"])

    return events.withWatermark("ts", WATERMARK).groupBy("session_id", "hook_name").applyInPandasWithState(
        run, "session_id string, hook_name string, ts timestamp", "last double", "append", GroupStateTimeout.EventTimeTimeout
    )


def topic_gate(prompts: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Prompts (session_id, ts, terms) with whether their topic is new against the last terms that were let through."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = set(state.get[0]) if state.exists else None
        out = []
        out_of = _keyed(rows)
        for ts, terms in out_of[["ts", "terms"]].itertuples(index=False):
            now = set(terms)
            like = -1.0 if last is None else (1.0 if not now | last else len(now & last) / len(now | last))
            new = like <= threshold
            if new:
                last = now
            out.append((key[0], ts, like, new))
        state.update((sorted(last or ()),))
        _expire(state, out_of, 24 * 3600)
        yield pd.DataFrame(out, columns=["session_id", "ts", "similarity", "changed"])

    return prompts.withWatermark("ts", WATERMARK).groupBy("session_id").applyInPandasWithState(
        run, "session_id string, ts timestamp, similarity double, changed boolean", "terms array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )


def admitted(writes: DataFrame, seconds: int = 60, most: int = 30) -> DataFrame:
    """Writes (user_id, ts) with whether they are let through; only those let through count against the limit."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        out = []
        out_of = _keyed(rows)
        for ts in out_of["ts"]:
            now = ts.timestamp()
            recent = [t for t in recent if t > now - seconds]
            fits = len(recent) < most
            if fits:
                recent.append(now)
            out.append((key[0], ts, fits))
        state.update((recent,))
        _expire(state, out_of, 10 * seconds)
        yield pd.DataFrame(out, columns=["user_id", "ts", "admitted"])

    return writes.withWatermark("ts", WATERMARK).groupBy("user_id").applyInPandasWithState(
        run, "user_id long, ts timestamp, admitted boolean", "recent array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def watch(files: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 2):
    """Handle new files in batches, every two seconds: the trailing pause of a folder watcher."""
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
