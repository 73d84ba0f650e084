"""Stateful streaming: rate limiting by identity, and streams run to their end."""

from __future__ import annotations

import heapq
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.shared import shared_dir

HORIZONS = (1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000)


@dataclass(frozen=True)
class Limits:
    """Accepted calls in a second, minute, hour and day; 0: no limit."""

    second: int
    minute: int
    hour: int
    day: int

    def each(self) -> tuple[int, int, int, int]:
        return self.second, self.minute, self.hour, self.day


def decide(times: Iterable[int], accepted: deque[int], limits: Limits) -> list[str]:
    """Decisions of calls in order of time. accepted (microseconds) is brought up to date; at most a day of it is kept, and
    never more than the day's limit where there is one."""
    out = []
    for t in times:
        while accepted and accepted[0] <= t - HORIZONS[-1]:
            accepted.popleft()
        # the limit-th last accepted call still lies within its window
        full = any(limit and len(accepted) >= limit and accepted[-limit] > t - span for limit, span in zip(limits.each(), HORIZONS))
        out.append("rate" if full else "accept")
        if not full:
            accepted.append(t)
    return out


class AtOnce:
    """Decisions of calls that last: no more than `most` may be running (asked first), and the limits hold."""

    def __init__(self, most: int, limits: Limits) -> None:
        self.most, self.limits = most, limits
        self.accepted: deque[int] = deque()
        self.running: list[int] = []  # a heap of ends

    def call(self, start: int, end: int) -> str:
        """The decision of the next call in order of starts."""
        while self.running and self.running[0] <= start:
            heapq.heappop(self.running)
        if self.most and len(self.running) >= self.most:
            return "active"
        said = decide([start], self.accepted, self.limits)[0]
        if said == "accept":
            heapq.heappush(self.running, max(start, end))
        return said


def limit_batch(rows: DataFrame, key: str, at: str, tie: str, limits: Limits) -> DataFrame:
    """key, tie, decision. A decision depends on those before it, so an identity's calls are one sequence: they arrive sorted and pass
    through a generator, of which only the day's accepted times are held."""
    ddl = f"{key} {rows.schema[key].dataType.simpleString()}, {tie} {rows.schema[tie].dataType.simpleString()}, decision string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, accepted = object(), deque()
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"]):
                if k != now:
                    now, accepted = k, deque()
                out += decide([t], accepted, limits)
            yield pd.DataFrame({key: b["k"], tie: b["i"], "decision": out})

    ordered = rows.select(F.col(key).alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(tie).alias("i")).repartition("k").sortWithinPartitions("k", "t", "i")
    return ordered.mapInPandas(run, ddl)


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files of a table; a table of one file is a stream of one batch."""
    import os

    schema = spark.read.parquet(path).schema
    plain = path.removeprefix("file://")
    if os.path.isdir(plain):
        return spark.readStream.schema(schema).parquet(path)
    folder, name = os.path.split(plain)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def _to_end(spark: SparkSession, writer) -> None:
    """Starts a query over all that its sources hold and waits for its end. State with a timeout asks for batches without data for ever, so there are none."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, old)


def run_to_end(stream: DataFrame, f: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Runs f over all that the stream holds, with a checkpoint in the shared folder, and reads the result back."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    out = f(stream)

    def keep(batch: DataFrame, n: int) -> None:
        # a batch that is run again writes the same folder anew
        (batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={n}"))

    _to_end(spark, out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/log"))
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def limit_stream(spark: SparkSession, path: str, key: str, at: str, tie: str, limits: Limits) -> DataFrame:
    """limit_batch over a stream, whose accepted times by identity are its state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()  # a day without calls: nothing that is kept counts any more
            return
        accepted = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(["t", "i"])
        decisions = decide(rows["t"], accepted, limits)
        state.update((list(accepted),))
        state.setTimeoutDuration(HORIZONS[-1] // 1000)
        yield pd.DataFrame({"k": [k[0]] * len(rows), "i": rows["i"], "decision": decisions})

    def f(s: DataFrame) -> DataFrame:
        rows = s.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(tie).alias("i"))
        return rows.groupBy("k").applyInPandasWithState(run, "k string, i bigint, decision string", "accepted array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout)

    return run_to_end(stream_of(spark, path), f, "append")


def limit_active_batch(rows: DataFrame, key: str, start: str, end: str, tie: str, most: int, limits: Limits) -> DataFrame:
    """key, tie, decision ('accept', 'active' or 'rate') of calls that last from start to end (microseconds)."""
    ddl = f"{key} {rows.schema[key].dataType.simpleString()}, {tie} {rows.schema[tie].dataType.simpleString()}, decision string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for b in batches:
            out = []
            for k, s, e in zip(b["k"], b["s"], b["e"]):
                if k != now:
                    now, state = k, AtOnce(most, limits)
                out.append(state.call(s, e))
            yield pd.DataFrame({key: b["k"], tie: b["i"], "decision": out})

    ordered = rows.select(F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(tie).alias("i")).repartition("k").sortWithinPartitions("k", "s", "i")
    return ordered.mapInPandas(run, ddl)


# -- jobs: queued -> running -> done or error, cancelled while not over


def fold_sorted(rows: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[], object], step: Callable[..., object], finish: Callable[[object], tuple], ddl: str) -> DataFrame:
    """key and the columns of ddl: the state of each key after its rows in order. Rows arrive sorted and pass through a generator, of which only the
    state of the present key is held, so a key of any number of rows fits."""
    names = [x.strip().split(" ", 1)[0] for x in ddl.split(",")]
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, begun = None, None, False
        for b in batches:
            out: list[tuple] = []
            for k, *values in b[["k", *columns]].itertuples(index=False, name=None):
                if not begun or k != now:
                    if begun:
                        out.append((now, *finish(state)))
                    now, state, begun = k, start(), True
                state = step(state, *values)
            yield pd.DataFrame(out, columns=[key, *names])
        if begun:
            yield pd.DataFrame([(now, *finish(state))], columns=[key, *names])

    held = list(dict.fromkeys([*columns, *order]))
    ordered = rows.select(F.col(key).alias("k"), *held).repartition("k").sortWithinPartitions("k", *order)
    return ordered.mapInPandas(run, f"{key} {kind}, {ddl}")


def fold_jobs(events: DataFrame, key: str = "job_id", order: str = "id") -> DataFrame:
    """job_id, status, owner, applied: the state of each job after its events in order. claim(owner): queued -> running; finish and fail by the
    owner only: running -> done or error; cancel: queued or running -> cancelled. Others change nothing; applied counts those that did."""
    return fold_sorted(events, key, [order], ["kind", "owner"], lambda: ("queued", None, 0), lambda s, kind, owner: apply_event(s, kind, int(owner)), lambda s: s, "status string, owner bigint, applied int")


def apply_event(state: tuple[str, int | None, int], kind: str, owner: int | None) -> tuple[str, int | None, int]:
    """One transition of fold_jobs()."""
    status, held, n = state
    if kind == "claim" and status == "queued":
        return "running", owner, n + 1
    if kind in ("finish", "fail") and status == "running" and held == owner:
        return ("done" if kind == "finish" else "error"), held, n + 1
    if kind == "cancel" and status in ("queued", "running"):
        return "cancelled", held, n + 1
    return state


def job_stream(events: DataFrame, idle_ms: int = 86_400_000) -> DataFrame:
    """fold_jobs() over a stream (job_id, id, kind, owner): the state of a job after each batch with events of it; a job idle for longer is
    forgotten."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(state.get) if state.exists else ("queued", None, 0)
        rows = pd.concat(list(batches)).sort_values("id")
        for kind, owner in zip(rows["kind"], rows["owner"]):
            now = apply_event(now, kind, int(owner))
        state.update(now)
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"job_id": [k[0]], "status": [now[0]], "owner": pd.array([now[1]], "Int64"), "applied": [now[2]]})

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id bigint, status string, owner bigint, applied int", "status string, owner bigint, applied int", "update", GroupStateTimeout.ProcessingTimeTimeout)


def event_batches(events: DataFrame, key: str, at: str, order: str, most: int = 16, span: int = 100_000) -> DataFrame:
    """key, batches, largest: the events of each key gathered into batches of at most `most`, each within `span` microseconds of its first."""

    def step(s: tuple[int, int, int, int], t: int) -> tuple[int, int, int, int]:
        first, held, batches, largest = s
        if not batches or held >= most or t - first > span:
            first, held, batches = t, 0, batches + 1
        return first, held + 1, batches, max(largest, held + 1)

    return fold_sorted(events, key, [at, order], [at], lambda: (0, 0, 0, 0), step, lambda s: s[2:], "batches int, largest int")


def sweep(heartbeats: DataFrame, now: int, idle: int) -> DataFrame:
    """id, status: nodes (id, at in microseconds) by whether their last heartbeat is older than idle."""
    return heartbeats.groupBy("id").agg(F.max("at").alias("at")).select("id", F.when(F.col("at") < now - idle, "offline").otherwise("online").alias("status"))


def snapshots(stream: DataFrame, f: Callable[[DataFrame], DataFrame], every: str = "3 seconds") -> Callable[[Callable[[DataFrame, int], None]], object]:
    """Starts a query that hands a full snapshot of f(stream) to a callback at intervals, and gives the running query."""

    def start(push: Callable[[DataFrame, int], None], checkpoint: str):
        return f(stream).writeStream.outputMode("complete").foreachBatch(push).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

    return start


def in_epochs(spark: SparkSession, path: str, f: Callable[[DataFrame], DataFrame], epochs: int) -> str:
    """Writes f of a stream of files under a shared folder, one subfolder for each epoch (batch): a batch that is run again replaces its
    own. At most so many files are taken a batch that there are about `epochs` of them. Gives the folder."""
    import os

    stream = stream_of(spark, path)
    plain = path.removeprefix("file://")
    files = len([x for x in os.listdir(plain) if x.endswith(".parquet")]) if os.path.isdir(plain) else 1
    at = f"{shared_dir(spark).rstrip('/')}/epochs-{uuid.uuid4().hex}"
    schema = stream.schema
    limited = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, files // epochs)).parquet(path) if os.path.isdir(plain) else stream

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/epoch={n}")

    _to_end(spark, f(limited).writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/log"))
    return f"{at}/out"


def rolled_back(spark: SparkSession, folder: str, epoch: int) -> DataFrame:
    """What was written up to an epoch, with its number; later epochs, torn or not, don't count."""
    return spark.read.parquet(folder).where(F.col("epoch") <= epoch)
