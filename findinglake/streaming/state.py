"""Stateful operators over streams of events: rate limits, lockouts, sessions and the state of findings.

Each takes a streaming DataFrame.  State is kept per key, and its size is bounded: by the limit of hits, or by a few
numbers.  All of a key's rows in a micro-batch are taken in the order of time and id, however many Arrow chunks they fill.
"""

from __future__ import annotations

import heapq
import itertools
import pickle
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from findinglake.storage import shared_folder

_HELD = 1_000_000  # rows of a key sorted in memory
_BLOCK = 10_000  # rows read from disk or passed on at once


def _timed(rows: DataFrame, *more) -> DataFrame:
    """key, t, none (no id), event_id and more columns; rows without time go."""
    own = F.col("event_id").cast("long")
    out = rows.select(F.col("key").cast("string").alias("key"), F.col("t").cast("double").alias("t"), own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("event_id"), *more)
    return out.where("t is not null")


def _in_order(chunks: Iterator[pd.DataFrame], names: list[str], held: int) -> Iterator[tuple]:
    """All rows of a key's micro-batch as tuples in the order of `names`; runs of `held` rows are sorted, and merged from disk."""
    runs, rows, n = [], [], 0
    for pdf in chunks:
        rows.append(pdf[names])
        n += len(pdf)
        if n >= held:
            run, rows, n = _sorted(rows, names), [], 0
            runs.append(tempfile.TemporaryFile())  # noqa: SIM115 (closed and gone with the task)
            while block := list(itertools.islice(run, _BLOCK)):
                pickle.dump(block, runs[-1])
    rest = _sorted(rows, names) if rows else iter(())
    return heapq.merge(*map(_read, runs), rest, key=lambda r: (r[0] != r[0], *r)) if runs else rest  # NaN is last


def _sorted(rows: list[pd.DataFrame], names: list[str]) -> Iterator[tuple]:
    return pd.concat(rows).sort_values(names).itertuples(index=False, name=None)


def _read(file) -> Iterator[tuple]:
    file.seek(0)
    while True:
        try:
            yield from pickle.load(file)
        except EOFError:
            return


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while block := list(itertools.islice(rows, _BLOCK)):
        yield pd.DataFrame(block, columns=columns).astype({"event_id": "Int64"})


def rate_limit(hits: DataFrame, limit: int, window: float = 60.0, held: int = _HELD) -> DataFrame:
    """key, event_id, t, allowed, retry_after of each hit (key, event_id, t in seconds).

    A hit is allowed if fewer than `limit` allowed ones lie in the last `window` seconds; one exactly `window` old
    still counts, and rejected hits aren't counted.  Hits older than the newest one of earlier micro-batches are judged
    as if at its time.  held: so many rows of a key are sorted in memory; more are merged from disk.
    """

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState):
        times = list(state.get[0]) if state.exists else []
        last = state.get[1] if state.exists else float("-inf")

        def judged():
            nonlocal last
            for t, none, i in _in_order(chunks, ["t", "none", "event_id"], held):
                now = last = max(last, t)
                while times and now - times[0] > window:
                    times.pop(0)
                ok = len(times) < limit
                yield key[0], None if none else i, t, ok, 0.0 if ok else max(0.0, window - (now - times[0]))
                if ok:
                    times.append(now)

        yield from _frames(judged(), ["key", "event_id", "t", "allowed", "retry_after"])
        state.update((times, last))

    if limit < 1:
        raise ValueError("limit must be at least 1")
    out, kept = "key string, event_id long, t double, allowed boolean, retry_after double", "times array<double>, last double"
    return _timed(hits).groupBy("key").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def lockout(logins: DataFrame, most: int = 5, minutes: float = 15.0, held: int = _HELD) -> DataFrame:
    """key, event_id, t, outcome of each login (key, event_id, t in seconds, ok): DENIED while locked, else SUCCESS or
    FAILURE.  The `most`-th failure in a row locks for some minutes; success and locking set the count to 0.
    held: so many rows of a key are sorted in memory; more are merged from disk."""

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState):
        failed, until = state.get if state.exists else (0, float("-inf"))

        def judged():
            nonlocal failed, until
            for t, none, i, ok in _in_order(chunks, ["t", "none", "event_id", "ok"], held):
                i = None if none else i
                if until > t:
                    yield key[0], i, t, "DENIED"
                    continue
                if ok:
                    failed, until = 0, float("-inf")
                else:
                    failed += 1
                    if failed >= most:
                        failed, until = 0, t + 60 * minutes
                yield key[0], i, t, "SUCCESS" if ok else "FAILURE"

        yield from _frames(judged(), ["key", "event_id", "t", "outcome"])
        state.update((failed, until))

    rows = _timed(logins, F.coalesce("ok", F.lit(False)).alias("ok"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, event_id long, t double, outcome string", "failed int, until double", "append", GroupStateTimeout.NoTimeout)


def bounded_sessions(hits: DataFrame, idle: float = 3600.0, longest: float = 28_800.0, held: int = _HELD) -> DataFrame:
    """key, event_id, t and began, the start of the session, of each hit (key, event_id, t in seconds).

    A session ends when more than `idle` seconds pass without a hit, or more than `longest` since it began; the next
    hit begins another.  held: so many rows of a key are sorted in memory; more are merged from disk.
    """

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState):
        began, last = state.get if state.exists else (float("-inf"), float("-inf"))

        def placed():
            nonlocal began, last
            for t, none, i in _in_order(chunks, ["t", "none", "event_id"], held):
                if t - last > idle or t - began > longest:
                    began = t
                last = max(last, t)
                yield key[0], None if none else i, t, began

        yield from _frames(placed(), ["key", "event_id", "t", "began"])
        state.update((began, last))

    out = "key string, event_id long, t double, began double"
    return _timed(hits).groupBy("key").applyInPandasWithState(step, out, "began double, last double", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """key, began, ended (the last event's time plus the gap) and n of each run of events, no pause above the gap.

    With `late` the events are a stream and a session is final once the watermark passes its end.  Batches work too.
    """
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def advance(state: DataFrame, scan: DataFrame, at) -> DataFrame:
    """The findings' state after a scan: one row per repository and fingerprint.

    state: repository, fingerprint, status, first_seen, last_seen; scan: repository, fingerprint.  Found again after
    RESOLVED is REOPENED; open ones of a scanned repository that are missing get RESOLVED; others stay.
    """
    seen = scan.select("repository", "fingerprint").distinct().withColumn("seen", F.lit(True))
    ran = scan.select("repository").distinct().withColumn("ran", F.lit(True))
    rows = state.join(seen, ["repository", "fingerprint"], "full").join(ran, "repository", "left")
    old, at = F.col("status"), F.lit(at)
    status = (
        F.when(F.col("seen") & old.isNull(), "OPEN").when(F.col("seen") & (old == "RESOLVED"), "REOPENED")
        .when(F.col("seen").isNull() & F.col("ran") & old.isin("OPEN", "IN_PROGRESS", "REOPENED"), "RESOLVED").otherwise(old)
    )
    return rows.select("repository", "fingerprint", status.alias("status"), F.coalesce("first_seen", at).alias("first_seen"), F.when(F.col("seen"), at).otherwise(F.col("last_seen")).alias("last_seen"))


def new_folder(df: DataFrame) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_folder(df.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a stream gives for all data there is now, written once with a checkpoint and read back."""
    folder = new_folder(stream)
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
