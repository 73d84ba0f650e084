import random

from pyspark.sql import functions as F

from corvane.sources import jsonl
from corvane.streaming import state as ST


def brute(times, limits):
    out, ok = [], []
    for t in times:
        full = any(n and sum(t - span < a for a in ok) >= n for n, span in zip(limits.each(), ST.HORIZONS))
        out.append("rate" if full else "accept")
        if not full:
            ok.append(t)
    return out


def test_decisions_follow_the_accepted_calls_only():
    rng = random.Random(4)
    limits = ST.Limits(2, 5, 20, 40)
    t, times = 0, []
    for _ in range(400):
        t += rng.choice([100_000, 900_000, 5_000_000, 400_000_000, 1_000_000])
        times.append(t)
    assert ST.decide(times, ST.deque(), limits) == brute(times, limits)


def test_calls_at_once_are_counted():
    rng = random.Random(8)
    limits = ST.Limits(2, 6, 0, 0)
    t, calls = 0, []
    for _ in range(300):
        t += rng.choice([100_000, 900_000, 5_000_000, 40_000_000])
        calls.append((t, t + rng.choice([50_000, 3_000_000, 30_000_000])))
    out, ok = [], []
    for start, end in calls:
        if sum(e > start for _, e in ok) >= 3:
            out.append("active")
        elif any(n and sum(start - span < s for s, _ in ok) >= n for n, span in zip(limits.each(), ST.HORIZONS)):
            out.append("rate")
        else:
            out.append("accept")
            ok.append((start, end))
    state = ST.AtOnce(3, limits)
    assert [state.call(*c) for c in calls] == out and {*out} == {"accept", "active", "rate"}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2, None]), 1_700_000_000_000_000 + i * rng.choice([200_000, 3_000_000])) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, us bigint").withColumn("ts", F.timestamp_micros("us"))
    path = f"{tmp_path}/events.parquet"
    df.coalesce(1).write.parquet(path)
    limits = ST.Limits(1, 10, 30, 50)
    batch = {(r.event_id, r.decision) for r in ST.limit_batch(df.where("user_id is not null"), "user_id", "ts", "event_id", limits).collect()}
    stream = {(r.i, r.decision) for r in ST.limit_stream(spark, path, "user_id", "ts", "event_id", limits).collect()}
    assert batch == stream and {d for _, d in batch} == {"accept", "rate"}


def test_strict_json_lines(spark, tmp_path):
    lines = ['{"id": "1", "source": "wiki", "text": "a"}', "not json", "[1]", '{"id": "1", "text": "a"}', '{"id": "1", "source": "wiki", "text": "a", "more": 1}', '{"id": 1, "source": "wiki", "text": "a"}', '{"id": "1", "source": "other", "text": "a"}', "", "  "]
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(lines))
    got = jsonl.read_strict(spark, str(path), ["id", "source", "text"], {"source": ["wiki"]})
    assert sorted(r.problem or "ok" for r in got.collect()) == sorted(["ok", "invalid_json", "non_object", "invalid_schema", "invalid_schema", "invalid_types", "unknown_source"])
    out = tmp_path / "out"
    jsonl.write(got.where("problem is null").select("id", "source", "text"), str(out))
    assert jsonl.read_tolerant(spark, str(out), "id string, source string, text string").count() == 1


def test_model_calls_are_tried_again(spark):
    from corvane.sources import streams

    def call(p):
        if p == "bad":
            raise streams.CallError("client")
        if p == "busy":
            raise streams.CallError("server")
        return p.upper(), 1

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "busy")], "k bigint, p string")
    got = {r.k: (r.text, r.tries, r.error) for r in streams.call_model(df, "k", "p", call, 3, lambda s: None).collect()}
    assert got == {1: ("A", 1, None), 2: (None, 1, "client"), 3: (None, 3, "server")}
    assert [streams.backoff(n) for n in range(8)] == [1, 2, 4, 8, 16, 32, 60, 60]


def test_snapshots_are_pushed(spark, tmp_path):
    import time

    path = f"{tmp_path}/in"
    spark.range(10).withColumn("k", F.col("id") % 2).write.parquet(path)
    seen = []
    start = ST.snapshots(ST.stream_of(spark, path), lambda s: s.groupBy("k").count(), "1 second")
    q = start(lambda batch, n: seen.append(sorted((r.k, r["count"]) for r in batch.collect())), f"{tmp_path}/log")
    for _ in range(60):
        if seen:
            break
        time.sleep(0.5)
    q.stop()
    assert seen[0] == [(0, 5), (1, 5)]


def test_digests_of_files(spark, tmp_path):
    import hashlib

    from corvane.sources import streams

    (tmp_path / "a.bin").write_bytes(b"one")
    rows = {r.name: (r.bytes, r.sha256) for r in streams.file_digests(spark, str(tmp_path)).collect()}
    assert rows == {"a.bin": (3, hashlib.sha256(b"one").hexdigest())}
    parts = [hashlib.md5(x).digest() for x in (b"one", b"two")]
    assert streams.multipart_tag(parts) == hashlib.md5(b"".join(parts)).hexdigest() + "-2"
