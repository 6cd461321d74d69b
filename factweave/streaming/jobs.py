"""Job states from a stream of stage events, kept by an arbitrary stateful operator with event-time timers.

A job opens with the first event of its key, moves with each event in order of event time, and ends when an event says COMPLETED or FAILED,
or FAILED with no event for ``stall``, whichever the order in which events arrive: events wait in the state until the watermark has
passed them, so each is applied in its place; events behind the watermark are ignored. The next event of the key after
an end opens its next job. A timer wakes a key when its earliest waiting event or its stall is due, so a silent
key ends without new events. State is a few values a key and the events of one delay.

Defined results: events without key, time or known stage are ignored; events of one time go by progress, ends last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas

ENDS = ("COMPLETED", "FAILED")
OUTCOME = "key string, job int, status string, stage string, progress int, events int, started_at timestamp, ended_at timestamp, stalled boolean"
_ENDED = ["job", "status", "stage", "progress", "events", "started", "ended", "stalled"]
#: Order of events of one time: by progress, ends last.
_PLACE = {s: p + 1000 * (s in ENDS) + (s == "FAILED") for s, p in schemas.STAGES.items()}


def advance(job: tuple | None, number: int, waiting: list[tuple[int, str]], upto: int, stall: int) -> tuple[tuple | None, int, list[tuple]]:
    """Apply the events (milliseconds, stage) before ``upto``: the open job (stage, progress, started, last, events) or None, how many jobs have ended, and the ended (job, status, stage, progress, events, started, ended, stalled)."""
    done: list[tuple] = []

    def end(status: str, at: int, stalled: bool) -> None:
        nonlocal job, number
        number += 1
        done.append((number, status, job[0], job[1], job[4], job[2], at, stalled))
        job = None

    for at, stage in sorted(waiting, key=lambda x: (x[0], _PLACE[x[1]])):
        if job is not None and at > job[3] + stall:
            end("FAILED", job[3] + stall, True)
        if job is None:
            job = (stage, 0, at, at, 0)
        job = (stage, max(job[1], schemas.STAGES[stage]), job[2], at, job[4] + 1)
        if stage in ENDS:
            end(stage, at, False)
    if job is not None and upto > job[3] + stall:
        end("FAILED", job[3] + stall, True)
    return job, number, done


class JobStates(StatefulProcessor):
    """Input: key, ms, stage. All that a key holds is one value, read and written once a step: each call of the state is a trip to the JVM and back."""

    def __init__(self, stall_ms: int):
        self.stall = stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "stage string, progress int, started long, last long, events int, open boolean, number int, ms array<long>, stages array<string>")

    def _step(self, key, fresh: list[tuple[int, str]], watermark: int) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        job, number, waiting = None, 0, fresh
        if held is not None:
            job, number, waiting = (tuple(held[:5]) if held[5] else None), held[6], [*zip(held[7], held[8], strict=True), *fresh]
        due, rest = [w for w in waiting if w[0] < watermark], [w for w in waiting if w[0] >= watermark]
        job, number, done = advance(job, number, due, watermark, self.stall)
        self.state.update((*(job or ("", 0, 0, 0, 0)), job is not None, number, [w[0] for w in rest], [w[1] for w in rest]))
        wake = [min(rest)[0] + 1] if rest else []
        if job is not None:
            wake.append(job[3] + self.stall + 1)
        if wake:
            self.handle.registerTimer(max(min(wake), watermark + 1))
        if done:
            yield pd.DataFrame({"key": [key[0]] * len(done)} | dict(zip(_ENDED, zip(*done, strict=True), strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(a), b) for f in rows for a, b in zip(f["ms"].tolist(), f["stage"].tolist(), strict=True)]
        yield from self._step(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


#: The state store that arbitrary state needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def job_outcomes(events: DataFrame, delay: str = "1 hour", stall_ms: int = 86_400_000) -> DataFrame:
    """The ended jobs (OUTCOME) of a stream of ``events`` (key, ts, stage). The session needs STATE_STORE when the stream starts."""
    known = events.where(F.col("key").isNotNull() & F.col("ts").isNotNull() & F.col("stage").isin(*schemas.STAGES)).withWatermark("ts", delay)
    rows = known.select(F.col("key").cast("string").alias("key"), "ts", F.unix_millis("ts").alias("ms"), "stage")
    out = rows.groupBy("key").transformWithStateInPandas(JobStates(stall_ms), "key string, job int, status string, stage string, progress int, events int, started long, ended long, stalled boolean", "Append", "EventTime")
    return out.select("key", "job", "status", "stage", "progress", "events", F.timestamp_millis("started").alias("started_at"), F.timestamp_millis("ended").alias("ended_at"), "stalled")
