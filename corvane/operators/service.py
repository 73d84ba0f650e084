"""Analytics of a text-generation service: deduplicated requests, exports, overviews, routing, limits and running figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T


def deduplicated(requests: DataFrame, key: str = "id") -> DataFrame:
    """One row of each delivered id; repeats are equal rows, so which one stays doesn't matter."""
    return requests.dropDuplicates([key])


def micros(c: Column | str) -> Column:
    return F.unix_micros(c)


def ordered_answers(responses: DataFrame) -> DataFrame:
    """request_id, answers (variant and output in order of time)."""
    return responses.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "variant", "output"))).alias("answers"))


def export(requests: DataFrame, responses: DataFrame, choice: Column | None = None) -> DataFrame:
    """Answered requests with their answers in order and the one that was chosen (variant A where nothing says else)."""
    ok = deduplicated(requests).where("status = 'ok'")
    rows = ok.join(ordered_answers(responses), ok["id"] == F.col("request_id"), "left")
    answers = F.coalesce("answers", F.array().cast(ordered_answers(responses).schema["answers"].dataType))
    wanted = F.coalesce(choice if choice is not None else F.lit(None).cast("string"), F.lit("A"))
    picked = F.filter(answers, lambda a: a["variant"] == wanted)
    return rows.select(ok["id"], "mode", F.lower("model").alias("model"), "created_at", answers.alias("answers"), F.when(F.size(picked) > 0, F.element_at(picked, 1)["output"]).alias("selected"))


def overview(requests: DataFrame) -> DataFrame:
    r = deduplicated(requests)
    return r.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("feedback") & (F.col("mode") == "web")).alias("web_feedback"), F.countDistinct("user_id").alias("users"))


def zero_filled(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A count for each of a fixed set of keys, 0 where there are no rows."""
    wanted = rows.sparkSession.createDataFrame([(k,) for k in keys], f"{name} string")
    return wanted.join(rows.groupBy(name).count(), name, "left").select(name, F.coalesce("count", F.lit(0)).alias("n"))


def pick_node(nodes: DataFrame, model: str, now: Column, window: str = "INTERVAL 30 DAYS") -> DataFrame:
    """Live nodes that serve a model, best first: least load per throughput, then most throughput, unknown last."""
    live = nodes.where((F.col("status") == "online") & (F.col("last_heartbeat") > now - F.expr(window))).where(F.exists("models", lambda m: (m["id"] == model) | (m["family"] == model)))
    return live.orderBy((F.col("active_requests") / F.greatest(F.col("throughput"), F.lit(1.0))).asc(), F.col("throughput").desc_nulls_last(), "name")


def available_models(nodes: DataFrame) -> DataFrame:
    """Models of online nodes that are no alias, the last node by name decides."""
    m = nodes.where("status = 'online'").select("name", F.explode("models").alias("m")).where(~F.coalesce(F.col("m.alias"), F.lit(False)))
    return m.groupBy(F.col("m.id").alias("id")).agg(F.max_by("m.kind", "name").alias("kind"), F.count("*").alias("nodes"))


def node_state(now: Column, window: str = "INTERVAL 30 DAYS") -> Column:
    return F.when((F.col("status") != "online") | (F.col("last_heartbeat") < now - F.expr(window)), "offline").when(F.col("active_requests") >= F.col("max_concurrency"), "busy").otherwise("online")


def rating(given: Column, prompts: Column) -> Column:
    return F.round(T.clamp(given / F.greatest(prompts, F.lit(1)) + F.lit(0.25), 0.1, 1.5), 6)


SPANS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def trailing_counts(rows: DataFrame, key: str, at: str, windows: dict[str, str]) -> DataFrame:
    """For each row how many rows of its key lie in the time before it (itself included), by window of at most a day.

    A row is counted in its own day and serves as context in the next, so a key held by a tenth of all rows is as many tasks' work as
    there are days."""
    t = micros(at)
    day = F.floor(t / F.lit(86_400_000_000))
    both = rows.withColumn("_t", t).withColumn("_d", F.explode(F.array(F.struct(day.alias("d"), F.lit(True).alias("own")), F.struct((day + 1).alias("d"), F.lit(False).alias("own")))))
    w = Window.partitionBy(key, "_d.d").orderBy("_t")
    counted = both.select("*", *(F.count("*").over(w.rangeBetween(-SPANS[s] * 1_000_000 + 1, Window.currentRow)).alias(n) for n, s in windows.items()))
    return counted.where("_d.own").drop("_d", "_t")


def clamped_params(params: Column | str) -> list[Column]:
    p = T.col(params)
    number = lambda name: F.get_json_object(p, f"$.{name}").cast("double")
    return [F.round(T.clamp(F.coalesce(number("temperature"), F.lit(0.8)), 0.05, 2.0), 6).alias("temperature"), T.clamp(F.coalesce(number("top_k"), F.lit(50.0)), 1.0, 256.0).cast("int").alias("top_k")]


#: Values of a key after which an older one weighs less than a double can tell (0.7^200 is 1e-31).
EMA_LAST = 200


def ema(rows: DataFrame, key: str, at: str, value: str, keep: float = 0.7, tie: str = "id") -> DataFrame:
    """The exponential moving average of each key's values in order of time; the first value starts it.

    The average is a weighted sum: the k-th last of n values weighs (1 - keep) keep^(k - 1), the first one keep^(n - 1). Values older than
    the last EMA_LAST weigh nothing in a double, so each task passes on only its last ones of a key (the limit of the rank does that),
    and the number of values is counted apart."""
    known = rows.where(F.col(value).isNotNull()).select(key, at, tie, F.col(value).cast("double").alias("v"))
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc())
    last = known.withColumn("k", F.row_number().over(w)).where(F.col("k") <= EMA_LAST)
    counts = known.groupBy(key).agg(F.count("*").alias("n"))
    weight = F.pow(F.lit(keep), F.col("k") - 1) * F.when(F.col("k") == F.col("n"), 1.0).otherwise(1 - keep)
    return last.join(counts, key).groupBy(key).agg(F.round(F.sum(F.col("v") * weight), 4).alias("ema"), F.first("n").alias("n"))


def most_active(events: DataFrame, key: str, at: str, step: str, span: int = 3_600_000_000) -> DataFrame:
    """The highest running sum of step (+1, -1) over each key's events in order of time (microseconds); events of one time count at once.

    Sums by stretch of time first, their running sum, then the events within a stretch: a key of all events is many tasks' work."""
    g = events.groupBy(key, at).agg(F.sum(step).alias("_s")).withColumn("_b", F.floor(F.col(at) / F.lit(span)))
    sums = g.groupBy(key, "_b").agg(F.sum("_s").alias("_n"))
    before = sums.select(key, "_b", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = g.withColumn("_in", F.sum("_s").over(Window.partitionBy(key, "_b").orderBy(at))).groupBy(key, "_b").agg(F.max("_in").alias("_top"))
    return within.join(before, [key, "_b"]).groupBy(key).agg(F.max(F.col("_before") + F.col("_top")).alias("most_active"))


def rate_of_last(rows: DataFrame, key: str, at: str, n: int, tie: str) -> DataFrame:
    """Rows per second over the last n rows of each key: (rows - 1) / (last - first)."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc())
    last = rows.select(key, micros(at).alias("t"), F.row_number().over(w).alias("k")).where(F.col("k") <= n)
    span = (F.max("t") - F.min("t")) / F.lit(1_000_000)
    return last.groupBy(key).agg(F.count("*").alias("n"), F.round(F.try_divide(F.count("*") - 1, span), 9).alias("per_second"))


def fold_deltas(events: DataFrame, key: str = "job_id", order: str = "id") -> DataFrame:
    """The text of each job from its ordered deltas, where a reset starts anew. Only what follows the last reset is gathered."""
    last = events.groupBy(key).agg(F.max(F.when(F.col("reset"), F.col(order))).alias("_from"))
    kept = events.join(last, key).where(F.col("_from").isNull() | (F.col(order) >= F.col("_from")))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "delta"))), lambda x: F.coalesce(x["delta"], F.lit(""))), "").alias("text"))


def upsert_latest(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """Old rows changed by new ones: of each column the latest value that isn't null."""
    cols = [c for c in old.columns if c not in (key, at)]
    both = old.unionByName(new.select(old.columns))
    return both.groupBy(key).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in cols), F.max(at).alias(at)).select(old.columns)


def running_best(rows: DataFrame, at: str, value: str) -> DataFrame:
    """For each row the best value before it and whether it improves on that."""
    w = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(value).over(w)
    return rows.select(at, value, best.alias("best_before"), F.coalesce(F.col(value) < best, F.lit(True)).alias("improved"))


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.join(have, key, "left_anti")


SECRET = ["authorization", "token", "api_key", "password", "secret"]


def redacted(m: Column, names: list[str]) -> Column:
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).isin(names), F.lit("[redacted]")).otherwise(v))


# -- feedback


def choice(c: Column) -> Column:
    """A vote as A, B, yes, no or none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.isin("a", "b"), F.upper(low)).when(low.isin("yes", "no"), low).otherwise("none")


def latest_choice(feedback: DataFrame) -> DataFrame:
    """request_id, choice: the last vote of each request."""
    return feedback.groupBy("request_id").agg(F.max_by("choice", F.struct("created_at", "id")).alias("choice"))


def voted_share(requests: DataFrame, feedback: DataFrame, mode: str = "web") -> DataFrame:
    """shown, voted, percent: answered requests of a mode, those with a vote (each once), and their percentage, rounded half up."""
    ok = requests.where((F.col("status") == "ok") & (F.col("mode") == mode))
    voted = ok.join(feedback.select(F.col("request_id").alias("id")), "id", "left_semi")
    r = ok.agg(F.count("*").alias("shown")).join(voted.agg(F.countDistinct("id").alias("voted")))
    return r.withColumn("percent", F.coalesce(F.floor(F.try_divide(F.lit(100) * F.col("voted"), F.col("shown")) + F.lit(0.5)), F.lit(0)).cast("bigint"))


def selected_variant(vote: Column) -> Column:
    return F.when(vote.isin("A", "B"), vote).when(vote == "yes", "A")


# -- requests


def story_of(text: Column) -> Column:
    """The story fields in a message: a JSON object, or lines of `key: value`."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r"))
    pairs = F.transform(F.filter(F.split(t, "\n"), lambda x: F.instr(x, ":") > 1), lambda x: F.struct(F.btrim(F.substring_index(x, ":", 1), F.lit(" \t\r")).alias("k"), F.btrim(F.substring(x, F.instr(x, ":") + 1, F.length(x)), F.lit(" \t\r")).alias("v")))
    # a key given twice has its last value
    last = F.filter(pairs, lambda p: F.element_at(F.filter(pairs, lambda q: q["k"] == p["k"]), -1)["v"].eqNullSafe(p["v"]))
    lines = F.map_from_entries(F.array_distinct(last))
    return F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), F.from_json(t, "map<string,string>")).otherwise(lines)


def last_user_message(messages: Column) -> Column:
    """The content of the last message whose role is user."""
    own = F.filter(messages, lambda m: m["role"] == "user")
    return F.when(F.size(own) > 0, F.element_at(own, -1)["content"])


def usage(text: Column) -> Column:
    """Tokens for the bill: words, at least 1."""
    return F.greatest(F.lit(1), T.words(F.coalesce(text, F.lit(""))).cast("int"))


MOST_CHARS = 4000


def prompt_fault(text: Column) -> tuple[Column, Column]:
    """(the prompt with plain line ends, trimmed; what is wrong with it, or null)."""
    t = F.btrim(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit(" \t\n"))
    return t, F.when(t == "", "required").when(F.length(t) > MOST_CHARS, "too_long").when(~t.rlike(r"^[\t\n\x20-\x7E]+$"), "characters")


def identity(key: Column, mode: Column, address: Column) -> Column:
    """Whom the limits count for: the key, else the mode and address."""
    return F.coalesce(key, F.concat_ws(":", mode, address))


def all_params(params: Column | str) -> list[Column]:
    """temperature, top_k, max_tokens (under either of its names) and seed, brought into their ranges; null where absent."""
    p = T.col(params)
    number = lambda name: F.get_json_object(p, f"$.{name}").try_cast("double")
    whole = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))
    most = F.coalesce(number("max_new_tokens"), number("max_tokens"))
    return [
        F.when(number("temperature").isNotNull(), T.clamp(number("temperature"), 0.05, 2.0)).alias("temperature"),
        F.when(number("top_k").isNotNull(), T.clamp(whole(number("top_k")), 1, 256)).cast("int").alias("top_k"),
        F.when(most.isNotNull(), T.clamp(whole(most), 8, 1000)).cast("int").alias("max_tokens"),
        whole(number("seed")).cast("bigint").alias("seed"),
    ]


def matching(rows: DataFrame, most: int | None = None, cap: int = 1000, **wanted: str | None) -> DataFrame:
    """Rows that have all the values that are given (None: any), the newest first, at most the asked number and never more than cap."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.col("created_at").desc(), "id").limit(min(cap if most is None else most, cap))


def key_digest(key: Column) -> list[Column]:
    """What is kept of a secret key: its beginning and its digest."""
    return [F.substring(key, 1, 8).alias("key_prefix"), F.sha2(key, 256).alias("key_hash")]


def same_origin(origin: Column, host: Column) -> Column:
    """Whether a request's origin names this host (with its port)."""
    place = F.regexp_extract(F.lower(F.coalesce(origin, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#@\s]+)", 1)
    return (place != "") & (place == F.lower(F.coalesce(host, F.lit(""))))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose parent isn't there."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


# -- figures over time


def snapshot_rates(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """key, at, total, per_second: the running total of a value (a row for each snapshot, in microseconds) and its growth since the one before."""
    w = Window.partitionBy(key).orderBy(at)
    x = rows.select(key, at, F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("total"), (F.col(at) - F.lag(at).over(w)).alias("_dt"), F.col(value).alias("_v"))
    return x.select(key, at, "total", F.round(F.try_divide(F.col("_v"), F.col("_dt") / F.lit(1_000_000)), 6).alias("per_second"))


def chunk_text(events: DataFrame, key: str, order: str) -> DataFrame:
    """key, text, complete: what a stream of chunks shows in the end: deltas added up (a reset begins anew) where there are any, else the last whole
    text; complete: whether a chunk says that it is done."""
    has = events.groupBy(key).agg(F.max(F.col("delta").isNotNull()).alias("_d"), F.max_by("output", F.when(F.col("output").isNotNull(), F.col(order))).alias("_o"), F.coalesce(F.max(F.col("event") == "done"), F.lit(False)).alias("complete"))
    parts = events.where("delta is not null").withColumn("reset", F.coalesce("reset", F.lit(False)))
    return has.join(fold_deltas(parts, key, order), key, "left").select(key, F.when(F.col("_d"), F.col("text")).otherwise(F.coalesce("_o", F.lit(""))).alias("text"), "complete")


def capped(pairs: DataFrame, probe: str, order: str, most: int) -> DataFrame:
    """At most so many partners of each probe, the first ones in order; for uses that bound their work on purpose (None of this library's do)."""
    w = Window.partitionBy(probe).orderBy(order)
    return pairs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")
