"""Jobs and sessions as streams: a state machine for each job, stale answers, debouncing and save coalescing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Phases of a job, and those that end it.
PHASES = ("queued", "running", "cancelling", "committing", "succeeded", "failed", "cancelled")
TERMINAL = ("succeeded", "failed", "cancelled")


def step(phase: str | None, event: str) -> tuple[str, bool]:
    """The next phase after an event, and whether the event was taken.

    A cancel wins until the commit begins: then whatever else comes ends the job as cancelled. A terminal phase takes only a
    new start. Events: start, run, cancel, commit, succeed, fail.
    """
    if phase is None or phase in TERMINAL:
        return ("queued", True) if event == "start" else (phase or "queued", False)
    if event == "start":
        return phase, False  # busy
    if event == "cancel":
        return ("cancelling", True) if phase in ("queued", "running") else (phase, False)
    if phase == "cancelling":
        return "cancelled", True
    if event == "run":
        return ("running", True) if phase == "queued" else (phase, False)
    if event == "commit":
        return ("committing", True) if phase == "running" else (phase, False)
    if event == "succeed":
        return ("succeeded", True) if phase == "committing" else (phase, False)
    return ("failed", True) if event == "fail" else (phase, False)


OUTPUT = "job long, event_id long, event string, phase string, taken boolean"


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator:
    """A key's events of a micro-batch in order, also where they come in several Arrow batches."""
    parts = list(batches)
    return pd.concat(parts).sort_values("event_id").itertuples() if parts else iter(())


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    phase = state.get[0] if state.exists else None
    rows = []
    for r in _in_order(batches):
        phase, taken = step(phase, r.event)
        rows.append((key[0], r.event_id, r.event, phase, taken))
    state.update((phase,))
    yield pd.DataFrame(rows, columns=["job", "event_id", "event", "phase", "taken"])


def job_phases(events: DataFrame) -> DataFrame:
    """events(job, event_id, event), a stream -> each event with the phase after it. State is one phase for each job."""
    return events.groupBy("job").applyInPandasWithState(_advance, OUTPUT, "phase string", "append", GroupStateTimeout.NoTimeout)


class Coalescer(StatefulProcessor):
    """Save requests of a session: one runs, at most one waits; further ones fold into the waiting one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "running boolean, waiting boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        running, waiting = self.state.get() or (False, False)
        out = []
        for r in _in_order(rows):
            running, waiting, action = coalesce(running, waiting, r.event)
            out.append((key[0], r.event_id, action))
        self.state.update((running, waiting))
        yield pd.DataFrame(out, columns=["session", "event_id", "action"])

    def close(self) -> None:
        pass


def coalesce(running: bool, waiting: bool, event: str) -> tuple[bool, bool, str]:
    """Of a save or done event: the next state and what happens (begin, wait, fold, idle)."""
    if event == "save":
        return (True, waiting, "begin") if not running else (True, True, "fold" if waiting else "wait")
    return (True, False, "begin") if waiting else (False, False, "idle")


def save_actions(events: DataFrame) -> DataFrame:
    """events(session, event_id, event), a stream -> the action each one leads to."""
    return events.groupBy("session").transformWithStateInPandas(Coalescer(), "session long, event_id long, action string", "Append", "None")


# batch forms of what needs no state beyond a window


def stale(events: DataFrame, session: str, order: str, epoch: str) -> DataFrame:
    """events with stale: an answer of an epoch below the latest one begun so far."""
    latest = F.max(epoch).over(Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("stale", F.col(epoch) < latest)


def debounced(events: DataFrame, session: str, at: str, gap: str) -> DataFrame:
    """Bursts of events with no gap of that length: session, first and last time, number of events."""
    w = F.session_window(at, gap)
    return events.groupBy(session, w).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("session_window")


def accepted_writes(writes: DataFrame, session: str, order: str, seen: str, content: str) -> DataFrame:
    """writes with accepted: whether the fingerprint a writer has seen is that of the write before it."""
    before = F.lag(F.sha2(content, 256)).over(Window.partitionBy(session).orderBy(order))
    return writes.withColumn("accepted", F.col(seen).eqNullSafe(before))


def opened_once(opens: DataFrame, user: str, path: str, order: str) -> DataFrame:
    """opens with session: a path that a user has open already leads to the session that opened it first."""
    return opens.withColumn("session", F.min(order).over(Window.partitionBy(user, path)))


def busy(events: DataFrame, session: str, order: str, event: str) -> DataFrame:
    """events with busy: a start while the last start or end before it was a start, as one job runs at a time."""
    so_far = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(event).isin("start", "end"), F.col(event)), ignorenulls=True).over(so_far)
    return events.withColumn("busy", (F.col(event) == "start") & F.coalesce(last == "start", F.lit(False)))


def publish_conflicts(jobs: DataFrame, writes: DataFrame, session: str) -> DataFrame:
    """jobs(session, job, started, committed) with conflict: whether the input changed between start and commit.

    Under the commit gate a job reads its input again: it conflicts if the last write (session, at, sha) up to its commit has
    another hash than the last one up to its start. One window over writes and both moments of all jobs; no range join.
    """
    moments = jobs.select(session, "job", F.explode(F.array(F.struct(F.col("started").alias("at"), F.lit("s").alias("kind")), F.struct(F.col("committed").alias("at"), F.lit("c").alias("kind")))).alias("m"))
    moments = moments.select(session, F.col("m.at").alias("at"), F.lit(None).cast("string").alias("sha"), "job", F.col("m.kind").alias("kind"))
    every = writes.select(session, "at", "sha", F.lit(None).cast(jobs.schema["job"].dataType).alias("job"), F.lit("").alias("kind")).unionByName(moments)
    seen = F.last("sha", ignorenulls=True).over(Window.partitionBy(session).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    known = every.withColumn("seen", seen).where("kind <> ''")
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("seen")))
    return known.groupBy(session, "job").agg((~pick("s").eqNullSafe(pick("c"))).alias("conflict"))


def recent(opens: DataFrame, path: str, at: str, most: int = 20) -> DataFrame:
    """path and latest: the files that were opened last, each once, the latest first."""
    return opens.groupBy(path).agg(F.max(at).alias("latest")).orderBy(F.col("latest").desc(), path).limit(most)
