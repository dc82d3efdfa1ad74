"""Stateful behaviour over the events table, as streams where state is needed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parchment.plans.catalog import query, table
from parchment.store import shared_dir
from parchment.streaming import jobs as J


def _stream(s, d, shape):
    """A table as a stream that ends: every row is read once, in one batch after another."""
    path = f"{d}/events.parquet"
    schema = s.read.parquet(path).schema
    return shape(s.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path if not path.endswith(".parquet") else d + "/event[s].parquet"))


def _finished(s, stream, name: str):
    """What a stream that ends has written: files in the shared folder, so nothing is gathered by the driver."""
    folder = f"{shared_dir(s)}/stream-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/log").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{folder}/rows")


EVENTS = ("start", "run", "commit", "succeed", "cancel", "fail")
NUMBERED = f"e AS (SELECT user_id AS job, event_id, {list(EVENTS)}[event_id % 6 + 1] AS event, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"
# the phase before any event is null; an event that is refused before the first start leaves it queued
PHASE = """CASE WHEN p.phase IS NULL OR p.phase IN ('succeeded', 'failed', 'cancelled') THEN CASE WHEN e.event = 'start' THEN 'queued' ELSE coalesce(p.phase, 'queued') END
  WHEN e.event = 'start' THEN p.phase WHEN e.event = 'cancel' THEN CASE WHEN p.phase IN ('queued', 'running') THEN 'cancelling' ELSE p.phase END WHEN p.phase = 'cancelling' THEN 'cancelled'
  WHEN e.event = 'run' THEN CASE WHEN p.phase = 'queued' THEN 'running' ELSE p.phase END WHEN e.event = 'commit' THEN CASE WHEN p.phase = 'running' THEN 'committing' ELSE p.phase END
  WHEN e.event = 'succeed' THEN CASE WHEN p.phase = 'committing' THEN 'succeeded' ELSE p.phase END WHEN e.event = 'fail' THEN 'failed' ELSE p.phase END"""
TAKEN = """CASE WHEN p.phase IS NULL OR p.phase IN ('succeeded', 'failed', 'cancelled') THEN e.event = 'start' WHEN e.event = 'start' THEN false WHEN e.event = 'cancel' THEN p.phase IN ('queued', 'running')
  WHEN p.phase = 'cancelling' THEN true WHEN e.event = 'run' THEN p.phase = 'queued' WHEN e.event = 'commit' THEN p.phase = 'running' WHEN e.event = 'succeed' THEN p.phase = 'committing' ELSE e.event = 'fail' END"""


@query(
    "ts1_job_phases",
    f"""WITH RECURSIVE {NUMBERED}, r AS (
          SELECT job, event_id, event, n, {PHASE.replace("p.phase", "CAST(NULL AS VARCHAR)")} AS phase, {TAKEN.replace("p.phase", "CAST(NULL AS VARCHAR)")} AS taken FROM e WHERE n = 1
          UNION ALL SELECT e.job, e.event_id, e.event, e.n, {PHASE}, {TAKEN} FROM r p JOIN e ON e.job = p.job AND e.n = p.n + 1)
        SELECT job, event_id, event, phase, taken FROM r""",
)
def ts1(s, d):
    kind = F.element_at(F.array(*[F.lit(e) for e in EVENTS]), (F.col("event_id") % 6 + 1).cast("int"))
    events = _stream(s, d, lambda t: t.select(F.col("user_id").cast("long").alias("job"), F.col("event_id").cast("long").alias("event_id"), kind.alias("event")))
    return _finished(s, J.job_phases(events), "ts1_job_phases")


@query(
    "ts4_save_coalescing",
    """WITH RECURSIVE e AS (SELECT user_id AS session, event_id, event_id % 3 = 0 AS done, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), r AS (
         SELECT session, event_id, n, NOT done AS running, false AS waiting, CASE WHEN done THEN 'idle' ELSE 'begin' END AS action FROM e WHERE n = 1
         UNION ALL SELECT e.session, e.event_id, e.n, CASE WHEN e.done THEN p.waiting ELSE true END, CASE WHEN e.done THEN false WHEN p.running THEN true ELSE p.waiting END,
                CASE WHEN e.done THEN CASE WHEN p.waiting THEN 'begin' ELSE 'idle' END WHEN NOT p.running THEN 'begin' WHEN p.waiting THEN 'fold' ELSE 'wait' END
         FROM r p JOIN e ON e.session = p.session AND e.n = p.n + 1)
       SELECT session, event_id, action FROM r""",
)
def ts4(s, d):
    kind = F.when(F.col("event_id") % 3 == 0, "done").otherwise("save")
    events = _stream(s, d, lambda t: t.select(F.col("user_id").cast("long").alias("session"), F.col("event_id").cast("long").alias("event_id"), kind.alias("event")))
    # the operator needs this store; the stream ends here, so the session gets its setting back
    key, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = s.conf.get(key)
    s.conf.set(key, own)
    try:
        return _finished(s, J.save_actions(events), "ts4_save_coalescing")
    finally:
        s.conf.set(key, before)


@query("ts3_stale_epoch", "SELECT event_id, event_id % 7 < max(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id) AS stale FROM events")
def ts3(s, d):
    e = table(s, d, "events", "event_id", "user_id").withColumn("epoch", F.col("event_id") % 7)
    return J.stale(e, "user_id", "event_id", "epoch").select("event_id", "stale")


@query("ts5_debounce", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM i GROUP BY user_id, burst")
def ts5(s, d):
    e = table(s, d, "events", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.debounced(e, "user_id", "ts", "1 hour").select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@query("ts6_external_change", "WITH l AS (SELECT conv_id, turn, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN p IS NULL ELSE true END AS accepted FROM l")
def ts6(s, d):
    from pyspark.sql import Window

    c = table(s, d, "conversations")
    before = F.lag(F.sha2("text", 256)).over(Window.partitionBy("conv_id").orderBy("turn"))
    writes = c.withColumn("seen", F.when(F.col("turn") % 3 == 0, F.lit(None)).otherwise(before))
    return J.accepted_writes(writes, "conv_id", "turn", "seen", "text").select("conv_id", "turn", "accepted")


