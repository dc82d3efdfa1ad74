"""Streams give what the plain machines give, event by event."""

from collections import defaultdict

from parchment.plans import streams
from parchment.streaming.jobs import coalesce, step

SMALL = "/root/testdata/sf0.001"


def by_user(spark):
    out = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/events.parquet").select("user_id", "event_id").orderBy("event_id").collect():
        out[r.user_id].append(r.event_id)
    return out


def test_job_phases(spark):
    got = {(r.job, r.event_id): (r.phase, r.taken) for r in streams.ts1(spark, SMALL).collect()}
    for user, events in by_user(spark).items():
        phase = None
        for e in events:
            phase, taken = step(phase, streams.EVENTS[e % 6])
            assert got[user, e] == (phase, taken)


def test_save_actions(spark):
    got = {(r.session, r.event_id): r.action for r in streams.ts4(spark, SMALL).collect()}
    for user, events in by_user(spark).items():
        state = (False, False)
        for e in events:
            *state, action = coalesce(*state, "done" if e % 3 == 0 else "save")
            assert got[user, e] == action
