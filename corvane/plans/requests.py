"""Queries on feedback, parsed requests and generated stories. Votes and keys, for which there is no table, are derived from requests
by digests, alike on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import fixed as X
from corvane.functions import text as T
from corvane.operators import service as S
from corvane.operators import stories as P
from corvane.operators import verify as V
from corvane.plans.registry import ONCE, n_of, query, quoted, sql_list, table


def _bucket(c: str, n: int):
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("bigint"), F.lit(n))


_B = "('0x' || substr(md5({c}), 1, 6))::BIGINT % {n}"
_VOTES = ["A", "b", "YES", "no", "?"]
# a vote for most requests that asked for one, and a later second one for a third of these
FEEDBACK = f"""(WITH o AS (SELECT * FROM {ONCE} WHERE feedback AND {_B.format(c='id', n=7)} <> 0) SELECT id || ':1' AS id, id AS request_id, {_VOTES}[{_B.format(c='id', n=5)} + 1] AS choice, created_at + INTERVAL 5 SECOND AS created_at FROM o
    UNION ALL SELECT id || ':2', id, {_VOTES}[{_B.format(c="id || 'x'", n=5)} + 1], created_at + INTERVAL 65 SECOND FROM o WHERE {_B.format(c='id', n=3)} = 0)"""
_CHOICE = "CASE WHEN lower(choice) IN ('a', 'b') THEN upper(choice) WHEN lower(choice) IN ('yes', 'no') THEN lower(choice) ELSE 'none' END"


def feedback(spark, d) -> DataFrame:
    o = S.deduplicated(table(spark, d, "requests")).where(F.col("feedback") & (_bucket("id", 7) != 0))
    vote = lambda c: F.element_at(F.array(*map(F.lit, _VOTES)), (c + 1).cast("int"))
    first = o.select(F.concat("id", F.lit(":1")).alias("id"), F.col("id").alias("request_id"), vote(_bucket("id", 5)).alias("choice"), (F.col("created_at") + F.expr("INTERVAL 5 SECONDS")).alias("created_at"))
    again = o.where(_bucket("id", 3) == 0).withColumn("_x", F.concat("id", F.lit("x")))
    second = again.select(F.concat("id", F.lit(":2")).alias("id"), F.col("id").alias("request_id"), vote(_bucket("_x", 5)).alias("choice"), (F.col("created_at") + F.expr("INTERVAL 65 SECONDS")).alias("created_at"))
    return first.unionAll(second).withColumn("choice", S.choice(F.col("choice")))


@query(f"SELECT k.choice, count(f.id) AS n FROM (VALUES ('A'), ('B'), ('yes'), ('no'), ('none')) k(choice) LEFT JOIN (SELECT id, {_CHOICE} AS choice FROM {FEEDBACK}) f USING (choice) GROUP BY 1")
def feedback_by_choice(spark, d):
    return S.zero_filled(feedback(spark, d).select("choice"), ["A", "B", "yes", "no", "none"], "choice")


@query(
    f"""WITH ok AS (SELECT id FROM {ONCE} WHERE mode = 'web' AND status = 'ok'), n AS (SELECT count(*) AS shown, (SELECT count(DISTINCT request_id) FROM {FEEDBACK} f JOIN ok ON ok.id = f.request_id) AS voted FROM ok)
    SELECT *, CASE WHEN shown = 0 THEN 0 ELSE floor(100 * voted / shown + 0.5) END::BIGINT AS percent FROM n"""
)
def overview_voted_pct(spark, d):
    return S.voted_share(S.deduplicated(table(spark, d, "requests")), feedback(spark, d))


@query(f"SELECT request_id, arg_max({_CHOICE}, (created_at, id)) AS choice FROM {FEEDBACK} GROUP BY 1")
def feedback_latest(spark, d):
    return S.latest_choice(feedback(spark, d))


@query(f"SELECT mode, lower(model) AS model, {_CHOICE} AS choice, count(*) AS votes FROM {FEEDBACK} f JOIN (SELECT id, mode, model FROM {ONCE} WHERE status = 'ok') r ON r.id = f.request_id GROUP BY ALL")
def feedback_by_model(spark, d):
    ok = S.deduplicated(table(spark, d, "requests")).where("status = 'ok'").select(F.col("id").alias("request_id"), "mode", F.lower("model").alias("model"))
    return feedback(spark, d).join(ok, "request_id").groupBy("mode", "model", "choice").agg(F.count("*").alias("votes"))


@query(
    f"""WITH l AS (SELECT request_id, arg_max({_CHOICE}, (created_at, id)) AS vote FROM {FEEDBACK} GROUP BY 1), s AS (SELECT r.id, vote, CASE WHEN vote IN ('A', 'B') THEN vote WHEN vote = 'yes' THEN 'A' END AS variant FROM {ONCE} r LEFT JOIN l ON l.request_id = r.id WHERE status = 'ok')
    SELECT s.id, vote, s.variant, md5((SELECT min(output) FROM responses p WHERE p.request_id = s.id AND p.variant = s.variant)) AS answer FROM s"""
)
def export_selected(spark, d):
    """Answered requests with the answer that was voted for."""
    ok = S.deduplicated(table(spark, d, "requests")).where("status = 'ok'").select("id")
    x = ok.join(S.latest_choice(feedback(spark, d)).withColumnsRenamed({"request_id": "id", "choice": "vote"}), "id", "left").withColumn("variant", S.selected_variant(F.col("vote")))
    answers = table(spark, d, "responses").groupBy(F.col("request_id").alias("id"), "variant").agg(F.min("output").alias("answer"))
    return x.join(answers, ["id", "variant"], "left").select("id", "vote", "variant", F.md5("answer").alias("answer"))


# -- keys: one for each api_key_id, held by the user of its first request

_SECRET = "'sk-' || md5(api_key_id)"
KEYS = f"(SELECT api_key_id AS id, arg_min(user_id, id) AS user_id, arg_min(mode, id) AS mode, substr({_SECRET}, 1, 8) AS key_prefix, sha256({_SECRET}) AS key_hash, {_B.format(c='api_key_id', n=5)} <> 0 AS active FROM {ONCE} WHERE api_key_id IS NOT NULL GROUP BY api_key_id)"


def keys(spark, d) -> DataFrame:
    r = S.deduplicated(table(spark, d, "requests")).where("api_key_id is not null")
    k = r.groupBy(F.col("api_key_id").alias("id")).agg(F.min_by("user_id", F.when(F.col("user_id").isNotNull(), F.col("id"))).alias("user_id"), F.min_by("mode", "id").alias("mode"))
    secret = F.concat(F.lit("sk-"), F.md5("id"))
    return k.select("id", "user_id", "mode", *S.key_digest(secret), (_bucket("id", 5) != 0).alias("active"))


@query(f"SELECT k.id, u.name, k.mode, key_prefix, key_hash, active FROM {KEYS} k JOIN users u ON u.id = k.user_id")
def api_key_list(spark, d):
    u = table(spark, d, "users").select(F.col("id").alias("user_id"), "name")
    return keys(spark, d).join(F.broadcast(u), "user_id").select("id", "name", "mode", "key_prefix", "key_hash", "active")


@query(f"WITH s AS (SELECT DISTINCT {_SECRET} AS key, mode AS asked FROM {ONCE} WHERE api_key_id IS NOT NULL UNION ALL SELECT 'sk-nobody', 'native') SELECT key, asked, CASE WHEN k.id IS NULL THEN 'unknown' WHEN NOT active THEN 'inactive' WHEN k.mode <> asked THEN 'mode' ELSE 'allowed' END AS outcome FROM s LEFT JOIN {KEYS} k ON k.key_hash = sha256(s.key)")
def api_key_auth(spark, d):
    """Presented keys looked up by their digests."""
    asked = table(spark, d, "requests").where("api_key_id is not null").select(F.concat(F.lit("sk-"), F.md5("api_key_id")).alias("key"), F.col("mode").alias("asked")).distinct()
    asked = asked.unionAll(spark.createDataFrame([("sk-nobody", "native")], "key string, asked string"))
    x = asked.withColumn("key_hash", F.sha2("key", 256)).join(keys(spark, d), "key_hash", "left")
    return x.select("key", "asked", F.when(F.col("id").isNull(), "unknown").when(~F.col("active"), "inactive").when(F.col("mode") != F.col("asked"), "mode").otherwise("allowed").alias("outcome"))


@query(f"SELECT 'responses' AS child, count(*) AS orphans FROM responses WHERE request_id NOT IN (SELECT id FROM requests) UNION ALL SELECT 'requests', count(*) FROM {ONCE} WHERE node_id IS NOT NULL AND node_id NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'request_users', count(*) FROM {ONCE} WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT id FROM users)")
def orphan_rows(spark, d):
    r = S.deduplicated(table(spark, d, "requests"))
    found = [("responses", S.orphans(table(spark, d, "responses"), "request_id", r, "id")), ("requests", S.orphans(r, "node_id", table(spark, d, "nodes"), "id")), ("request_users", S.orphans(r, "user_id", table(spark, d, "users"), "id"))]
    out = None
    for name, x in found:
        one = x.agg(F.count("*").alias("orphans")).select(F.lit(name).alias("child"), "orphans")
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT id, role FROM users UNION ALL SELECT 'web', 'web' WHERE 'web' NOT IN (SELECT id FROM users) UNION ALL SELECT 'admin', 'admin' WHERE NOT EXISTS (SELECT 1 FROM users WHERE role = 'admin')")
def seed_users(spark, d):
    """Users that have to be there are added where they aren't."""
    u = table(spark, d, "users").select("id", "role")
    web = spark.createDataFrame([("web", "web")], "id string, role string").join(u.select("id"), "id", "left_anti")
    admin = spark.createDataFrame([("admin", "admin")], "id string, role string").join(u.select("role"), "role", "left_anti").select("id", "role")
    return u.unionAll(web).unionAll(admin)


# -- requests as they arrive


@query(
    f"""SELECT id, coalesce(json_extract_string(i, '$.prompt'), '') AS prompt, CASE WHEN json_extract_string(i, '$.prompt') IS NULL OR trim(json_extract_string(i, '$.prompt')) = '' THEN 'required' WHEN length(json_extract_string(i, '$.prompt')) > 4000 THEN 'too_long'
    WHEN NOT regexp_matches(json_extract_string(i, '$.prompt'), '^[\\t\\n\\x20-\\x7E]+$') THEN 'characters' END AS fault, greatest(1, {n_of("coalesce(json_extract_string(i, '$.prompt'), '')", r"\S+")})::INT AS usage FROM (SELECT id, CASE WHEN json_valid(input) THEN input END AS i FROM {ONCE})"""
)
def request_prompts(spark, d):
    text = F.when(F.try_parse_json("input").isNotNull(), F.get_json_object("input", "$.prompt"))
    prompt, fault = S.prompt_fault(F.col("t"))
    return S.deduplicated(table(spark, d, "requests")).select("id", text.alias("t")).select("id", prompt.alias("prompt"), fault.alias("fault"), S.usage(F.col("t")).alias("usage"))


_CHAT = [
    (1, '{"hero": "fox", "lesson": "sharing", "age": 3}'),
    (2, "hero: owl\n setting : the harbour: at night\nno colon\n: nothing before it\nhero: cat"),
    (3, "{broken: json\nlesson: patience"),
    (4, None),
]


@query("SELECT * FROM (VALUES (1, 'age=3;hero=fox;lesson=sharing'), (2, 'hero=cat;setting=the harbour: at night'), (3, 'lesson=patience;{broken=json'), (4, '')) v(n, story)")
def chat_story_parse(spark, d):
    x = spark.createDataFrame(_CHAT, "n int, text string").select("n", S.story_of(F.col("text")).alias("m"))
    return x.select("n", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("story"))


@query("SELECT batch, md5(arg_max(user_msg, seq)) AS last FROM (SELECT seq, seq // 4 AS batch, user_msg FROM sft_pairs WHERE user_msg IS NOT NULL) GROUP BY batch")
def chat_last_user(spark, d):
    """Conversations of four pairs each, of which the last message by the user counts."""
    p = table(spark, d, "sft_pairs").where("user_msg is not null")
    turn = lambda role, c, k: F.struct((F.col("seq") * 2 + k).alias("turn"), F.lit(role).alias("role"), F.col(c).alias("content"))
    both = p.select(F.floor(F.col("seq") / 4).cast("bigint").alias("batch"), F.explode(F.array(turn("user", "user_msg", 0), turn("assistant", "assistant_msg", 1))).alias("m"))
    talks = both.groupBy("batch").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return talks.select("batch", F.md5(S.last_user_message(F.col("ms"))).alias("last"))


_PARAMS = [(1, '{"temperature": 9, "top_k": 12.9, "max_tokens": 3, "seed": -4.7}'), (2, '{"max_new_tokens": 5000, "max_tokens": 20}'), (3, '{"temperature": -1, "top_k": 0, "seed": ""}'), (4, "{}"), (5, None)]


@query("SELECT n, temperature::DOUBLE AS temperature, top_k, max_tokens, seed FROM (VALUES (1, 2.0, 12, 8, -4), (2, NULL, NULL, 1000, NULL), (3, 0.05, 1, NULL, NULL), (4, NULL, NULL, NULL, NULL), (5, NULL, NULL, NULL, NULL)) v(n, temperature, top_k, max_tokens, seed)")
def param_cases(spark, d):
    x = spark.createDataFrame(_PARAMS, "n int, params string").select("n", *S.all_params("params"))
    return x.withColumn("seed", F.col("seed").cast("int"))


@query(f"SELECT id, coalesce(api_key_id, mode || ':10.0.0.' || {_B.format(c='id', n=250)}) AS identity FROM {ONCE}")
def request_identity(spark, d):
    r = S.deduplicated(table(spark, d, "requests"))
    return r.select("id", S.identity(F.col("api_key_id"), F.col("mode"), F.concat(F.lit("10.0.0."), _bucket("id", 250))).alias("identity"))


_ORIGINS = [(1, "https://play.example", "play.example"), (2, "https://play.example:8443/x", "play.example:8443"), (3, "https://other.example", "play.example"), (4, None, "play.example"), (5, "not an origin", "play.example"), (6, "HTTP://Play.Example", "play.example")]


@query("SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, false), (5, false), (6, true)) v(n, same)")
def same_origin_cases(spark, d):
    return spark.createDataFrame(_ORIGINS, "n int, origin string, host string").select("n", S.same_origin(F.col("origin"), F.col("host")).alias("same"))


@query(f"SELECT id, epoch_us(created_at) AS at FROM (SELECT * FROM {ONCE} WHERE mode = 'native' AND status = 'ok') ORDER BY created_at DESC, id LIMIT 50")
def request_filter(spark, d):
    r = S.matching(S.deduplicated(table(spark, d, "requests")), 50, mode="native", status="ok", model=None)
    return r.select("id", S.micros("created_at").alias("at"))


@query(f"SELECT id, 'authorization=[redacted];mode=' || mode || ';token=[redacted]' AS line FROM {ONCE}")
def log_redaction(spark, d):
    m = F.create_map(F.lit("mode"), "mode", F.lit("Token"), "id", F.lit("authorization"), F.md5("id"))
    x = S.deduplicated(table(spark, d, "requests")).select("id", S.redacted(m, S.SECRET).alias("m"))
    return x.select("id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"]))), ";").alias("line"))


# -- stories

_COMBOS = " CROSS JOIN ".join(f"(SELECT unnest([{sql_list(X.STORY_OPTIONS[f])}]) AS {f})" for f in X.STORY_FIELDS)
_KEYS = ", ".join(X.STORY_FIELDS)


@query(
    f"""WITH c AS (SELECT {_KEYS} FROM {_COMBOS}), r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '42', {_KEYS})), {_KEYS}) AS k FROM c),
    h AS (SELECT {_KEYS}, count(*) AS have FROM (SELECT list_extract([{sql_list(X.STORY_OPTIONS['hero'])}], (seq % 10 + 1)::INT) AS hero, 'forest' AS setting, 'sad day' AS problem, 'wise owl' AS helper_or_item, 'sharing' AS lesson FROM sft_pairs) GROUP BY ALL),
    w AS (SELECT {_KEYS}, (250000 // 100000 + CASE WHEN k <= 250000 % 100000 THEN 1 ELSE 0 END)::BIGINT AS want FROM r)
    SELECT {_KEYS}, want, coalesce(have, 0) AS have, greatest(0, want - coalesce(have, 0))::BIGINT AS missing FROM w LEFT JOIN h USING ({_KEYS})"""
)
def story_combo_plan(spark, d):
    """All hundred thousand combinations against the stories that are there (some for each hero)."""
    heroes = F.array(*map(F.lit, X.STORY_OPTIONS["hero"]))
    have = table(spark, d, "sft_pairs").select(F.element_at(heroes, (F.col("seq") % 10 + 1).cast("int")).alias("hero"), F.lit("forest").alias("setting"), F.lit("sad day").alias("problem"), F.lit("wise owl").alias("helper_or_item"), F.lit("sharing").alias("lesson"))
    return P.deficits(P.product(spark, X.STORY_OPTIONS), have, 250_000, X.STORY_FIELDS, 100_000)


_HINTS = "CASE problem " + " ".join(f"WHEN '{k}' THEN '{quoted(v)}'" for k, v in X.PROBLEM_HINTS.items()) + " ELSE '' END"
_MORAL = f"replace(replace(list_extract([{sql_list(X.MORALS)}], (('0x' || substr(md5(concat_ws(':', {_KEYS})), 1, 8))::BIGINT % 8 + 1)::INT), '{{hero}}', hero), '{{lesson}}', lesson)"


@query(f"SELECT {_KEYS}, 'Hero: ' || hero || '. Setting: ' || setting || '. Problem: ' || problem || {_HINTS} || '. Helper/item: ' || helper_or_item || '. Lesson: ' || lesson || '.' AS prompt, {_MORAL} AS moral, 4 AS messages FROM {_COMBOS}")
def story_prompts(spark, d):
    ms = P.messages("Write a tiny story.", [("Hero: fox.", "A fox came by.")], F.col("prompt"))
    x = P.product(spark, X.STORY_OPTIONS).withColumn("prompt", P.user_prompt())
    return x.select(*X.STORY_FIELDS, "prompt", P.moral(F.concat_ws(":", *X.STORY_FIELDS)).alias("moral"), F.size(ms).alias("messages"))


def _story_rows(spark, d) -> DataFrame:
    """Answers with the story fields of their requests; every tenth is a made-up story with its combination, spoilt in one of several ways."""
    fields = [F.get_json_object("input", f"$.story.{f}").alias(f) for f in X.STORY_FIELDS]
    r = S.deduplicated(table(spark, d, "requests")).select(F.col("id").alias("request_id"), *fields)
    return table(spark, d, "responses").select("id", "request_id", "output").join(r, "request_id").select("id", "output", *X.STORY_FIELDS)


_GOOD = "Ben the fox lived in the green forest. A big storm broke the old tree by the road. A wise owl showed Ben a warm and dry place. Ben gave half of the place to all his friends."
_STORIES = [
    (1, _GOOD, "ok"),
    (2, "“" + _GOOD + " The lesson was sharing.”", "ok"),
    (3, None, "empty"),
    (4, _GOOD.replace("Ben gave", "Ben... gave"), "banned:..."),
    (5, _GOOD + " And", "truncated"),
    (6, "The fox ran. It rained.", "too-short=2"),
    (7, _GOOD.replace("Ben the fox lived", "Once upon a time a fox lived"), "template-start"),
    (8, _GOOD.replace("A wise owl showed", "A wise owl, who was very very very very very very very very very very very very very very old, showed"), "long-sentence"),
    (9, "The fox ran. A storm came. An owl sat. He gave food.", "wordcount=12"),
    (10, _GOOD.replace("fox", "hare"), "hero-missing"),
    (11, _GOOD.replace("wise owl", "small bird"), "helper-missing"),
    (12, _GOOD.replace("A big storm broke", "Somebody cut"), "problem-missing"),
    (13, _GOOD.replace("gave half of the place to all his friends", "slept there until noon and went home"), "lesson-not-shown"),
    (14, "🦊 " + _GOOD.replace(" by the road.", " by the road ."), "ok"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({n}, '{r}')" for n, _, r in _STORIES) + ") v(n, reason)")
def story_reason_cases(spark, d):
    x = spark.createDataFrame([(n, t, "fox", "big storm", "wise owl", "sharing") for n, t, _ in _STORIES], "n int, output string, hero string, problem string, helper_or_item string, lesson string")
    return P.with_story_reason(x, "output").select("n", "reason")


def _cues(low: str, key: str, cues: dict, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN len(list_filter([{sql_list(v)}], lambda c: contains({low}, c))) > 0" for k, v in cues.items()) + f" ELSE {other} END"


def _named(phrase: str, low: str) -> str:
    w = f"list_filter(string_split(lower(coalesce({phrase}, '')), ' '), lambda w: length(w) >= 3)"
    return f"(len({w}) = 0 OR len(list_filter({w}, lambda w: contains({low}, substr(w, 1, 4)))) > 0)"


@query(
    rf"""WITH j AS (SELECT s.id, s.output, {", ".join(f"CASE WHEN json_valid(input) THEN json_extract_string(input, '$.story.{f}') END AS {f}" for f in X.STORY_FIELDS)} FROM responses s JOIN {ONCE} r ON r.id = s.request_id),
    a AS (SELECT *, regexp_replace(trim(regexp_replace(coalesce(output, ''), '\s+', ' ', 'g')), '\s+([.,!?;:])', '\1', 'g') AS t FROM j), b AS (SELECT *, lower(t) AS f, list_filter(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda s: s <> '') AS s0 FROM a),
    c AS (SELECT *, CASE WHEN len(s0) >= 5 AND regexp_matches(s0[-1], '{quoted(X.STORY_MORAL)}') THEN s0[:len(s0) - 1] ELSE s0 END AS ss FROM b), e AS (SELECT *, array_to_string(ss[1:4], ' ') AS story, lower(array_to_string(ss[1:4], ' ')) AS low FROM c)
    SELECT id, CASE WHEN t = '' THEN 'empty' WHEN len(list_filter([{sql_list(X.STORY_BANNED)}], lambda v: contains(f, v))) > 0 THEN 'banned:' || list_filter([{sql_list(X.STORY_BANNED)}], lambda v: contains(f, v))[1] WHEN NOT regexp_matches(t, '[.!?]$') THEN 'truncated' WHEN len(ss) < 4 THEN 'too-short=' || len(ss)
      WHEN regexp_matches(low, '^(?:{"|".join(X.STORY_STARTS)})') THEN 'template-start' WHEN len(list_filter(ss[1:4], lambda s: {n_of("s", r"\S+")} > 24)) > 0 THEN 'long-sentence' WHEN {n_of("story", r"\S+")} NOT BETWEEN 24 AND 90 THEN 'wordcount=' || {n_of("story", r"\S+")}
      WHEN NOT contains(low, lower(coalesce(hero, ''))) THEN 'hero-missing' WHEN NOT {_named("helper_or_item", "low")} THEN 'helper-missing' WHEN NOT {_cues("low", "problem", X.PROBLEM_CUES, _named("problem", "low"))} THEN 'problem-missing' WHEN NOT {_cues("f", "lesson", X.LESSON_CUES, "true")} THEN 'lesson-not-shown' ELSE 'ok' END AS reason FROM e"""
)
def story_validate(spark, d):
    return P.with_story_reason(_story_rows(spark, d), "output").select("id", "reason")


@query(f"""SELECT id, CASE {" ".join(f"WHEN coalesce(trim(json_extract_string(input, '$.story.{f}')), '') NOT IN ({sql_list(X.STORY_OPTIONS[f])}) THEN '{f}'" for f in X.STORY_FIELDS)} END AS fault FROM {ONCE} WHERE json_valid(input) AND json_extract_string(input, '$.story.hero') IS NOT NULL
    UNION ALL SELECT 'fine', NULL UNION ALL SELECT 'lesson', 'lesson'""")
def story_options(spark, d):
    r = S.deduplicated(table(spark, d, "requests")).where(F.try_parse_json("input").isNotNull() & F.get_json_object("input", "$.story.hero").isNotNull())
    known = spark.createDataFrame([("fine", '{"story": {"hero": "fox", "setting": "sea", "problem": "sad day", "helper_or_item": "wise owl", "lesson": "bravery"}}'), ("lesson", '{"story": {"hero": "fox", "setting": "sea", "problem": "sad day", "helper_or_item": "wise owl", "lesson": "greed"}}')], "id string, input string")
    both = r.select("id", "input").unionAll(known)
    return both.select("id", P.option_fault({f: F.get_json_object("input", f"$.story.{f}") for f in X.STORY_FIELDS}).alias("fault"))


_INPUT = " || chr(10) || ".join(f"'{f}: ' || coalesce(json_extract_string(input, '$.story.{f}'), '')" for f in X.STORY_FIELDS)
_PROMPT = f"'<|input|>' || chr(10) || reverse({_INPUT}) || chr(10) || chr(10) || '<|story|>' || chr(10) || reverse(output) || chr(10) || '<|end|>'"
_PROMPTS = f"(SELECT s.id, {_PROMPT} AS prompt FROM responses s JOIN {ONCE} r ON r.id = s.request_id WHERE json_valid(input) AND json_extract_string(input, '$.story.hero') IS NOT NULL AND output IS NOT NULL)"


@query(f"SELECT id, md5(prompt) AS prompt FROM {_PROMPTS} UNION ALL SELECT 'literal', md5('<|input|>' || chr(10) || 'd :nossel' || chr(10) || ' :meti_ro_repleh' || chr(10) || 'c :melborp' || chr(10) || 'b :gnittes' || chr(10) || 'a :oreh' || chr(10) || chr(10) || '<|story|>' || chr(10) || '.dnE' || chr(10) || '<|end|>')")
def prompt_template(spark, d):
    rows = _story_rows(spark, d).where("hero is not null and output is not null")
    rows = rows.unionByName(spark.createDataFrame([("literal", "End.", "a", "b", "c", None, "d")], "id string, output string, hero string, setting string, problem string, helper_or_item string, lesson string"))
    return rows.select("id", F.md5(V.training_prompt("output")).alias("prompt"))


@query(
    f"""WITH p AS (SELECT *, ('0x' || substr(md5(id), 1, 6))::BIGINT % 6 AS k FROM {_PROMPTS}) SELECT id, unnest(CASE k WHEN 1 THEN ['missing_input', 'content_mismatch'] WHEN 2 THEN ['missing_end', 'content_mismatch'] WHEN 3 THEN ['content_mismatch'] ELSE ['missing_input', 'missing_story', 'missing_end', 'content_mismatch'] END) AS problem FROM p WHERE k BETWEEN 1 AND 4"""
)
def prompt_verify(spark, d):
    """Training prompts of which two thirds are spoilt: without a mark, with other content, or lost."""
    rows = _story_rows(spark, d).where("hero is not null and output is not null").withColumn("want", V.training_prompt("output")).withColumn("k", _bucket("id", 6))
    spoilt = F.when(F.col("k") == 1, F.replace("want", F.lit("<|input|>"), F.lit(""))).when(F.col("k") == 2, F.replace("want", F.lit("<|end|>"), F.lit("")))
    spoilt = spoilt.when(F.col("k") == 3, F.concat("want", F.lit(" "))).when(F.col("k") != 4, F.col("want"))
    return rows.select("id", F.explode(V.prompt_problems(spoilt, F.col("want"))).alias("problem"))


_LINE = "'{\"id\":\"' || doc_id || '\",\"source\":\"s\",\"text\":\"' || {t} || '\"}'"


@query(
    """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS line, count(*) OVER () AS total FROM documents) SELECT line, CASE WHEN line >= total - 3 THEN 'missing_line' WHEN line % 10 = 1 THEN 'invalid_json' WHEN line % 10 = 2 THEN 'incorrect_fields' WHEN line % 10 = 3 THEN 'non_string_value' WHEN line % 10 = 4 THEN 'changed_source' WHEN line % 10 = 5 THEN 'roundtrip_text' ELSE 'fine' END AS problem FROM n"""
)
def pair_lines(spark, d):
    """Lines of two files side by side: the second is three lines short, and half of its lines are spoilt, each in its own way."""
    docs = table(spark, d, "documents").select("doc_id", F.substring(F.md5("text"), 1, 12).alias("t"))
    record = lambda t, s="s", more="": F.concat(F.lit('{"id":"'), F.col("doc_id").cast("string"), F.lit('","source":"' + s + '","text":"'), t, F.lit('"' + more + "}"))
    a = docs.select("doc_id", record(F.col("t")).alias("line"))
    n = V.numbered(docs, "doc_id").withColumn("k", F.col("_line") % 10)
    turned = F.reverse("t")
    spoilt = F.when(F.col("k") == 1, "{torn").when(F.col("k") == 2, record(turned, more=',"x":"y"')).when(F.col("k") == 3, F.concat(F.lit('{"id":"'), F.col("doc_id").cast("string"), F.lit('","source":"s","text":5}')))
    spoilt = spoilt.when(F.col("k") == 4, record(turned, "z")).when(F.col("k") == 5, record(F.concat(turned, F.lit("!")))).otherwise(record(turned))
    total = n.agg(F.count("*").alias("total"))
    b = n.join(F.broadcast(total)).where(F.col("_line") < F.col("total") - 3).select("doc_id", spoilt.alias("line"))
    x = V.zip_lines(a, b, "doc_id")
    return x.select(F.col("_line").alias("line"), F.coalesce(V.pair_problem(F.col("a"), F.col("b"), ["id", "source", "text"], ["id", "source"]), F.lit("fine")).alias("problem"))


@query("SELECT id, CASE WHEN status = 'pending' THEN 'queued' ELSE status END AS status, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM (SELECT DISTINCT ON (id) * FROM requests) ORDER BY created_at DESC, id LIMIT 20")
def recent_events(spark, d):
    r = S.matching(S.deduplicated(table(spark, d, "requests")), 20)
    w = Window.orderBy(F.col("created_at").desc(), "id")  # twenty rows
    return r.select("id", F.when(F.col("status") == "pending", "queued").otherwise(F.col("status")).alias("status"), F.row_number().over(w).cast("bigint").alias("place"))
