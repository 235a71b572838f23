"""Stateful operators over request and job events, as folds in batch and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.functions.folds import folded


def admit(times: list[float], kept: list[float], limit: int, span: float) -> tuple[list[bool], list[float]]:
    """Which requests pass: fewer than ``limit`` passed ones within ``span`` before; refused ones do not count."""
    out, kept = [], list(kept)
    for t in times:
        kept = [k for k in kept if k > t - span]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out, kept


def rate_limited(events: DataFrame, limit: int, span: float, key: str = "user_id", at: str = "ts", id: str = "event_id") -> DataFrame:
    """``(key, id, at, allowed)``: a sliding limit for each key; ties in time go by id."""

    def step(kept: list[float] | None, r: dict) -> tuple[list[float], tuple]:
        (allowed,), kept = admit([r[at].timestamp()], kept or [], limit, span)
        return kept, (allowed,)

    return folded(events.select(key, id, at), key, [at, id], step, {"allowed": "boolean"})


def rate_limited_stream(events: DataFrame, limit: int, span: float, key: str = "user_id", at: str = "ts", id: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """The same over a stream, with the results of the batch for all events that are not later than ``late``.

    An event waits in its key's state until the watermark has passed it, so that events of any order, also those with equal
    times in several batches, are admitted by time and id; later ones are dropped.  The state is what waits and the passed
    requests of the last ``span``, and goes when neither is left.
    """
    kind = dict(events.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, ids, times = (list(x) for x in state.get) if state.exists else ([], [], [])
        for rows in batches:
            ids += rows[id].tolist()
            times += [t.value // 1000 for t in rows[at]]
        mark = max(state.getCurrentWatermarkMs(), 0)
        waiting = sorted(zip(times, ids, strict=True))
        ready = [w for w in waiting if w[0] <= mark * 1000]
        waiting = waiting[len(ready) :]
        allowed, kept = admit([t / 1e6 for t, _ in ready], kept, limit, span)
        kept = [t for t in kept if t > mark / 1000 - span]
        if waiting or kept:
            state.update((kept, [i for _, i in waiting], [t for t, _ in waiting]))
            due = waiting[0][0] // 1000 if waiting else int((kept[-1] + span) * 1000)
            state.setTimeoutTimestamp(max(due, mark) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [k[0]] * len(ready), id: [i for _, i in ready], at: pd.to_datetime([t for t, _ in ready], unit="us"), "allowed": allowed})

    return (
        events.withWatermark(at, late)
        .groupBy(key)
        .applyInPandasWithState(
            step, f"{key} {kind[key]}, {id} {kind[id]}, {at} {kind[at]}, allowed boolean", f"kept array<double>, ids array<{kind[id]}>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def in_window(events: DataFrame, span: int, key: str = "user_id", at: str = "ts") -> DataFrame:
    """Events with the number of the key's events in the last ``span`` seconds, this one included."""
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(seconds).rangeBetween(-span * 1_000_000 + 1, 0)
    return events.withColumn("in_window", F.count("*").over(w))


def locked_out(attempts: DataFrame, most: int = 5, span: float = 900.0) -> DataFrame:
    """``attempts`` (email, attempted_at, success) with ``locked``: refused for ``span`` seconds after ``most`` failures in a row."""

    def step(state: tuple[int, float] | None, r: dict) -> tuple[tuple[int, float], tuple]:
        failures, until = state or (0, float("-inf"))
        t = r["attempted_at"].timestamp()
        if t < until:
            return (failures, until), (True,)
        failures = 0 if r["success"] else failures + 1
        return ((0, t + span) if failures >= most else (failures, until)), (False,)

    return folded(attempts, "email", ["attempted_at"], step, {"locked": "boolean"})


def job_states(events: DataFrame) -> DataFrame:
    """The latest state of each job of ``events`` (job_id, state, at)."""
    return events.groupBy("job_id").agg(F.max_by("state", F.struct("at", "state")).alias("state"), F.max("at").alias("at"))


def volume(events: DataFrame, size: str = "1 day", at: str = "ts", late: str | None = None) -> DataFrame:
    """(start, n) of tumbling windows; with ``late`` a watermark, as a stream needs."""
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(F.window(at, size)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", at: str = "ts") -> DataFrame:
    """(key, start, end, n) of runs of events without a longer pause."""
    return events.groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
