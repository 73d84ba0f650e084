"""Queries on jobs, their events and streams. Jobs are taken from the event table: a user is a job, a kind of event a command."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import service as S
from corvane.operators.ranges import running_total
from corvane.plans.registry import ONCE, query, table
from corvane.sources.shared import materialize
from corvane.streaming import state as ST

_KIND = {"signup": "claim", "view": "claim", "click": "finish", "error": "fail", "purchase": "cancel"}
# twelve jobs for each user, so that most end in different states; an owner of three
_JOB = "user_id * 12 + event_id // 7 % 12"
EVENTS = f"(SELECT {_JOB} AS job_id, event_id AS id, event_id % 3 AS owner, CASE event_type {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in _KIND.items())} END AS kind, epoch_us(ts) AS at FROM events)"


def _events(e: DataFrame) -> DataFrame:
    kind = None
    for k, v in _KIND.items():
        kind = (F if kind is None else kind).when(F.col("event_type") == k, v)
    job = F.col("user_id") * 12 + F.floor(F.col("event_id") / 7) % 12
    return e.select(job.cast("bigint").alias("job_id"), F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("owner"), kind.alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


_FOLD = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id) AS n FROM {EVENTS}),
    w AS (SELECT job_id, 0::BIGINT AS n, 'queued' AS status, NULL::BIGINT AS owner, 0 AS applied FROM (SELECT DISTINCT job_id FROM e) UNION ALL
      SELECT e.job_id, e.n, CASE WHEN kind = 'claim' AND w.status = 'queued' THEN 'running' WHEN kind IN ('finish', 'fail') AND w.status = 'running' AND w.owner = e.owner THEN CASE kind WHEN 'finish' THEN 'done' ELSE 'error' END WHEN kind = 'cancel' AND w.status IN ('queued', 'running') THEN 'cancelled' ELSE w.status END,
        CASE WHEN kind = 'claim' AND w.status = 'queued' THEN e.owner ELSE w.owner END,
        w.applied + ((kind = 'claim' AND w.status = 'queued') OR (kind IN ('finish', 'fail') AND w.status = 'running' AND coalesce(w.owner = e.owner, false)) OR (kind = 'cancel' AND w.status IN ('queued', 'running')))::INT
      FROM w JOIN e ON e.job_id = w.job_id AND e.n = w.n + 1)
    SELECT job_id, arg_max(status, n) AS status, max(owner) AS owner, max(applied) AS applied FROM w GROUP BY job_id"""


@query(_FOLD)
def job_states(spark, d):
    return ST.fold_jobs(_events(table(spark, d, "events")))


@query(_FOLD)
def stream_jobs(spark, d):
    """The same by a stateful stream; of a job's states the one with most applied events is its last."""
    out = ST.run_to_end(ST.stream_of(spark, f"{d}/events.parquet"), lambda s: ST.job_stream(_events(s)), "update")
    return out.groupBy("job_id").agg(F.max_by(F.struct("status", "owner", "applied"), "applied").alias("s")).select("job_id", "s.*")


_NODES = "(SELECT id, list_extract((SELECT list(id ORDER BY id) FROM nodes), (('0x' || substr(md5(id), 1, 6))::BIGINT % 14 + 1)::INT) AS node_id, created_at FROM (SELECT DISTINCT ON (id) * FROM requests WHERE status = 'pending'))"


def _queued(spark, d) -> DataFrame:
    """Pending requests with the node that they wait for (by digest)."""
    r = S.deduplicated(table(spark, d, "requests")).where("status = 'pending'")
    ids = table(spark, d, "nodes").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # fourteen
    bucket = F.pmod(F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("bigint"), F.lit(14))
    return r.join(F.broadcast(ids)).select("id", F.element_at("ids", (bucket + 1).cast("int")).alias("node_id"), "created_at")


@query(f"SELECT q.node_id, arg_min(q.id, (q.created_at, q.id)) AS id FROM {_NODES} q JOIN nodes n ON n.id = q.node_id WHERE n.status = 'online' GROUP BY 1")
def job_fifo_claim(spark, d):
    """For each online node the oldest job that waits for it."""
    online = table(spark, d, "nodes").where("status = 'online'").select(F.col("id").alias("node_id"))
    return _queued(spark, d).join(F.broadcast(online), "node_id", "left_semi").groupBy("node_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))


@query(f"WITH c AS (SELECT q.node_id, arg_min(q.id, (q.created_at, q.id)) AS id FROM {_NODES} q JOIN nodes n ON n.id = q.node_id WHERE n.status = 'online' GROUP BY 1) SELECT q.id, CASE WHEN c.id IS NULL THEN 'queued' ELSE 'running' END AS status, n.name AS owner FROM {_NODES} q LEFT JOIN c ON c.id = q.id LEFT JOIN nodes n ON n.id = c.node_id")
def job_claim_update(spark, d):
    """The queue after the claims: a claimed job runs and has its node as owner."""
    claims = job_fifo_claim(spark, d).withColumnRenamed("node_id", "claimed_by")
    names = table(spark, d, "nodes").select(F.col("id").alias("claimed_by"), F.col("name").alias("owner"))
    x = _queued(spark, d).join(claims, "id", "left").join(F.broadcast(names), "claimed_by", "left")
    return x.select("id", F.when(F.col("claimed_by").isNull(), "queued").otherwise("running").alias("status"), "owner")


@query("WITH h AS (SELECT max(event_id) // 2 AS half FROM events) SELECT event_id, (SELECT max(event_id) FROM events, h WHERE event_id < half) + row_number() OVER (ORDER BY event_id) AS log_id FROM events, h WHERE event_id >= half")
def event_log_append(spark, d):
    """The first half of the events is the log; the others are appended with numbers after its last, in their order."""
    e = table(spark, d, "events").select("event_id")
    e = e.join(F.broadcast(e.agg(F.floor(F.max("event_id") / 2).alias("half"))))
    last = e.where("event_id < half").agg(F.max("event_id").alias("last"))
    new = running_total(e.where("event_id >= half"), [], "event_id", F.lit(1), "before")
    return new.join(F.broadcast(last)).select("event_id", (F.col("last") + F.col("before") + 1).alias("log_id"))


@query(
    f"""WITH RECURSIVE e AS (SELECT job_id // 12 AS job_id, id, "at", row_number() OVER (PARTITION BY job_id // 12 ORDER BY "at", id) AS n FROM {EVENTS}),
    w AS (SELECT job_id, n, "at" AS f0, 1 AS held, 1 AS batches, 1 AS largest FROM e WHERE n = 1 UNION ALL
      SELECT e.job_id, e.n, CASE WHEN w.held >= 16 OR e."at" - w.f0 > 86400000000 THEN e."at" ELSE w.f0 END, CASE WHEN w.held >= 16 OR e."at" - w.f0 > 86400000000 THEN 1 ELSE w.held + 1 END,
        w.batches + (w.held >= 16 OR e."at" - w.f0 > 86400000000)::INT, greatest(w.largest, CASE WHEN w.held >= 16 OR e."at" - w.f0 > 86400000000 THEN 1 ELSE w.held + 1 END) FROM w JOIN e ON e.job_id = w.job_id AND e.n = w.n + 1)
    SELECT job_id, max(batches) AS batches, max(largest) AS largest FROM w GROUP BY job_id"""
)
def event_batches(spark, d):
    """Each user's events gathered into batches of at most 16 within a day."""
    e = _events(table(spark, d, "events")).withColumn("job_id", F.floor(F.col("job_id") / 12).cast("bigint"))
    return ST.event_batches(e, "job_id", "at", "id", 16, 86_400_000_000)


_LAST = "TIMESTAMP '2024-01-30 12:00:00'"


@query(f"SELECT user_id AS id, CASE WHEN max(ts) < {_LAST} - INTERVAL 6 HOUR THEN 'offline' ELSE 'online' END AS status FROM events GROUP BY 1")
def stream_offline_sweep(spark, d):
    """Heartbeats (events) by a stream; whoever was silent for six hours before noon of the last day is offline."""
    beats = ST.run_to_end(ST.stream_of(spark, f"{d}/events.parquet"), lambda s: s.groupBy(F.col("user_id").alias("id")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("at")), "complete")
    now = int(spark.sql(f"SELECT unix_micros(CAST({_LAST} AS TIMESTAMP)) AS t").first()[0])
    return ST.sweep(beats, now, 6 * 3_600_000_000)


@query("SELECT user_id, count(*) FILTER (idle) AS timeouts FROM (SELECT user_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOUR, false) AS idle FROM events) GROUP BY 1")
def idle_timeouts(spark, d):
    """How often each user's stream would have been cut for twelve idle hours."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "43200000001 microseconds")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg((F.count("*") - 1).alias("timeouts"))


def _four_files(spark, d) -> str:
    """The events in four files, as a stream of four epochs."""
    e = table(spark, d, "events")
    return materialize(e.repartition(4, F.pmod("event_id", F.lit(4))).sortWithinPartitions("event_id"), "files")._corvane_path


@query("SELECT count(*) AS n, sum(event_id)::BIGINT AS ids, 'all' AS upto FROM events UNION ALL SELECT count(*), sum(event_id)::BIGINT, 'again' FROM events")
def epoch_rebuild(spark, d):
    """A stream of several epochs is written; all of it is read back, and once more after the last epoch was rolled back and written anew."""
    folder = ST.in_epochs(spark, _four_files(spark, d), lambda s: s.select("event_id"), 4)
    last = spark.read.parquet(folder).agg(F.max("epoch")).first()[0]
    whole = ST.rolled_back(spark, folder, last)
    lost = whole.where(F.col("epoch") == last).select("event_id")
    again = ST.rolled_back(spark, folder, last - 1).select("event_id").unionAll(lost)
    figures = lambda x, name: x.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).withColumn("upto", F.lit(name))
    return figures(whole, "all").unionAll(figures(again, "again"))


@query("SELECT source, count(*) AS n FROM (SELECT 'documents' AS source FROM documents UNION ALL SELECT 'candidates' FROM download_candidates UNION ALL SELECT 'corpus' FROM corpus_docs) GROUP BY 1")
def stream_union_sources(spark, d):
    """Several sources as one interleaved stream, whose checkpoint holds a cursor for each."""
    one = lambda name, key, label: ST.stream_of(spark, f"{d}/{name}.parquet").select(F.lit(label).alias("source"), F.col(key).alias("id"))
    both = one("documents", "doc_id", "documents").unionAll(one("download_candidates", "seq", "candidates")).unionAll(one("corpus_docs", "seq", "corpus"))
    return ST.run_to_end(both, lambda s: s.groupBy("source").agg(F.count("*").alias("n")), "complete")


@query(
    f"""WITH s AS (SELECT node_id, date_trunc('day', created_at AT TIME ZONE 'UTC') AS day, count(*) AS n, count(*) FILTER (status = 'error') AS errors FROM {ONCE} WHERE node_id IS NOT NULL GROUP BY 1, 2)
    SELECT node_id, day::DATE::VARCHAR AS day, n, n - lag(n) OVER (PARTITION BY node_id ORDER BY day) AS more, round(100.0 * errors / n, 2) AS error_pct FROM s"""
)
def progress_deltas(spark, d):
    """Requests of each node by day, and how many more than the day before."""
    from pyspark.sql import Window

    r = S.deduplicated(table(spark, d, "requests")).where("node_id is not null")
    s = r.groupBy("node_id", F.to_date("created_at").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors"))
    w = Window.partitionBy("node_id").orderBy("day")  # one row a node and day
    return s.select("node_id", "day", "n", (F.col("n") - F.lag("n").over(w)).alias("more"), F.round(F.lit(100.0) * F.col("errors") / F.col("n"), 2).alias("error_pct"))


_STARTS = [(1, 0, 50), (2, 10, 20), (3, 15, 30), (4, 25, 90), (5, 60, 61), (6, 62, 63), (7, 64, 70), (8, 200, 210)]


@query("SELECT * FROM (VALUES (1, 'accept'), (2, 'accept'), (3, 'active'), (4, 'accept'), (5, 'accept'), (6, 'accept'), (7, 'rate'), (8, 'accept')) v(n, decision)")
def limiter_cases(spark, d):
    """At most two calls at once and four in a minute (times in seconds): the first is asked before the second."""
    x = spark.createDataFrame([("a", n, s * 1_000_000, e * 1_000_000) for n, s, e in _STARTS], "who string, n int, s bigint, e bigint")
    return ST.limit_active_batch(x, "who", "s", "e", "n", 2, ST.Limits(0, 4, 0, 0)).select("n", "decision")


_WHO = "coalesce(api_key_id, mode || ':' || coalesce(user_id, 'nobody'))"
_FULL = "len(list_filter(w.accepted, lambda a: a > c.s - 1000000)) >= 2 OR len(list_filter(w.accepted, lambda a: a > c.s - 60000000)) >= 3 OR len(list_filter(w.accepted, lambda a: a > c.s - 3600000000)) >= 4 OR len(list_filter(w.accepted, lambda a: a > c.s - 86400000000)) >= 5"
_BUSY = "len(list_filter(w.ends, lambda e: e > c.s)) >= 2"


@query(
    f"""WITH RECURSIVE q AS (SELECT CASE WHEN {_WHO} LIKE 'web:%' THEN 'web' ELSE {_WHO} END AS k, epoch_us(created_at) AS s, epoch_us(created_at) + coalesce(latency_ms, 0)::BIGINT * 1000 * 100 AS e, id FROM {ONCE}), c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, id) AS n FROM q),
    w AS (SELECT k, 0::BIGINT AS n, []::BIGINT[] AS accepted, []::BIGINT[] AS ends, '' AS decision FROM (SELECT DISTINCT k FROM c) UNION ALL
      SELECT c.k, c.n, CASE WHEN ({_BUSY}) OR ({_FULL}) THEN w.accepted ELSE list_append(list_filter(w.accepted, lambda a: a > c.s - 86400000000), c.s) END, CASE WHEN ({_BUSY}) OR ({_FULL}) THEN w.ends ELSE list_append(list_filter(w.ends, lambda e: e > c.s), c.e) END,
        CASE WHEN {_BUSY} THEN 'active' WHEN {_FULL} THEN 'rate' ELSE 'accept' END FROM w JOIN c ON c.k = w.k AND c.n = w.n + 1)
    SELECT decision, count(*) AS n FROM w WHERE n > 0 GROUP BY decision"""
)
def limiter_active(spark, d):
    """Requests of each identity (all of the web as one), at most two at once; each lasts a hundred times its latency, so that some do run at once."""
    who = S.identity(F.col("api_key_id"), F.col("mode"), F.coalesce("user_id", F.lit("nobody")))
    start = S.micros("created_at")
    r = S.deduplicated(table(spark, d, "requests")).select("id", F.when(who.startswith("web:"), "web").otherwise(who).alias("who"), start.alias("s"), (start + F.coalesce("latency_ms", F.lit(0)).cast("bigint") * 1000 * 100).alias("e"))
    return ST.limit_active_batch(r, "who", "s", "e", "id", 2, ST.Limits(2, 3, 4, 5)).groupBy("decision").agg(F.count("*").alias("n"))


@query(
    f"""WITH s AS (SELECT r.node_id, date_trunc('hour', s.created_at AT TIME ZONE 'UTC') AS hour, sum(tokens)::BIGINT AS tokens FROM responses s JOIN {ONCE} r ON r.id = s.request_id WHERE tokens IS NOT NULL AND node_id IS NOT NULL GROUP BY 1, 2), t AS (SELECT node_id, epoch_us(hour) AS t, tokens FROM s)
    SELECT node_id, t, sum(tokens) OVER (PARTITION BY node_id ORDER BY t)::BIGINT AS total, round(tokens / ((t - lag(t) OVER (PARTITION BY node_id ORDER BY t)) / 1000000), 6) AS per_second FROM t"""
)
def token_rates(spark, d):
    """Tokens of each node by hour: the running total and the rate since the hour before."""
    r = S.deduplicated(table(spark, d, "requests")).where("node_id is not null").select(F.col("id").alias("request_id"), "node_id")
    s = table(spark, d, "responses").where("tokens is not null").join(r, "request_id").groupBy("node_id", F.unix_micros(F.date_trunc("hour", "created_at")).alias("t")).agg(F.sum("tokens").alias("tokens"))
    return S.snapshot_rates(s, "node_id", "t", "tokens")


_CHUNKS = [
    (1, 1, "chunk", "The ", None, None), (1, 2, "chunk", "fox", None, None), (1, 3, "done", None, None, "The fox, whole"),
    (2, 1, "chunk", "Old", None, None), (2, 2, "chunk", "New", True, None), (2, 3, "chunk", "er", None, None),
    (3, 1, "chunk", None, None, "Par"), (3, 2, "chunk", None, None, "Part"), (3, 3, "done", None, None, None),
    (4, 1, "error", None, None, None),
]


@query("SELECT * FROM (VALUES (1, 'The fox', true), (2, 'Newer', false), (3, 'Part', true), (4, '', false)) v(job, text, complete)")
def chunk_cases(spark, d):
    x = spark.createDataFrame(_CHUNKS, "job int, id int, event string, delta string, reset boolean, output string")
    return S.chunk_text(x, "job", "id")


@query("WITH p AS (SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY id) AS k FROM responses) SELECT request_id, id FROM p WHERE k <= 1")
def first_answers(spark, d):
    """At most one answer of each request."""
    return S.capped(table(spark, d, "responses").select("request_id", "id"), "request_id", "id", 1)
