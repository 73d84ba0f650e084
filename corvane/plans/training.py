"""Queries on token sequences, training logs and renderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import figures as G
from corvane.functions import fixed as X
from corvane.functions import text as T
from corvane.operators import service as S
from corvane.operators.ranges import running_total
from corvane.plans.registry import ONCE, SOURCE_SQL, n_of, query, table

U = "(('0x' || substr(md5({s}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"


@query(
    f"""WITH w AS (SELECT seq, ids, unnest(range(len(ids) - 64)) AS start FROM sft_sequences WHERE len(ids) > 64)
    SELECT seq, start, md5(array_to_string(ids[start + 1:start + 64], ' ')) AS x, md5(array_to_string(ids[start + 2:start + 65], ' ')) AS y FROM w WHERE {U.format(s="concat('9:', seq, ':', start)")} < 0.02"""
)
def token_windows(spark, d):
    w = G.token_windows(table(spark, d, "sft_sequences"), 64, 0.02, 9)
    h = lambda c: F.md5(F.array_join(F.transform(c, lambda v: v.cast("string")), " "))
    return w.select("seq", F.col("start").cast("bigint").alias("start"), h("x").alias("x"), h("y").alias("y"))


@query("SELECT seq, row_number() OVER (PARTITION BY split ORDER BY len(ids), seq) - 1 AS place FROM sft_sequences")
def length_order(spark, d):
    """The place of each sequence in its split in order of length."""
    s = table(spark, d, "sft_sequences").select("seq", "split", (F.size("ids").cast("bigint") * F.lit(1 << 40) + F.col("seq")).alias("at"))
    return running_total(s, ["split"], "at", F.lit(1), "place").select("seq", "place")


@query("SELECT split, min(list_min(ids))::INT AS least, max(list_max(ids))::INT AS most, sum(len(ids))::BIGINT AS tokens, ceil(sum(len(ids)) / 65536)::BIGINT AS steps FROM sft_sequences GROUP BY 1")
def token_range(spark, d):
    """Ids, tokens and steps of an epoch by split."""
    s = table(spark, d, "sft_sequences").groupBy("split").agg(F.min(F.array_min("ids")).alias("least"), F.max(F.array_max("ids")).alias("most"), F.sum(F.size("ids").cast("bigint")).alias("tokens"))
    return s.withColumn("steps", F.ceil(F.col("tokens") / 65536))


@query("SELECT seq, len(ids)::BIGINT AS tokens, md5(array_to_string(list_concat(ids[1:48], list_transform(range(greatest(0, 48 - len(ids))), lambda x: 0)), ' ')) AS ids FROM sft_sequences")
def padded_sequences(spark, d):
    s = table(spark, d, "sft_sequences")
    return s.select("seq", F.size("ids").cast("bigint").alias("tokens"), F.md5(F.array_join(F.transform(G.padded(F.col("ids"), 48), lambda v: v.cast("string")), " ")).alias("ids"))


@query("SELECT CASE WHEN ('0x' || substr(md5(coalesce(user_msg, '') || chr(0) || coalesce(assistant_msg, '')), 1, 13))::BIGINT / 4503599627370496.0 < 0.02 THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(seq)::BIGINT AS seqs FROM sft_pairs GROUP BY 1")
def sft_content_split(spark, d):
    """Pairs divided by their content, so equal pairs fall on one side."""
    f = F.conv(F.substring(F.md5(F.concat(F.coalesce("user_msg", F.lit("")), F.lit("\x00"), F.coalesce("assistant_msg", F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return table(spark, d, "sft_pairs").groupBy(F.when(f < 0.02, "val").otherwise("train").alias("split")).agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))




@query(
    f"""WITH l AS (SELECT event_id, list_transform(range(20), lambda i: round(-1.5 * ln((('0x' || substr(md5(concat('l:', event_id, ':', i)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0), 6)) AS ls FROM events),
    t AS (SELECT *, list_reverse_sort(ls)[5] AS least FROM l), n AS (SELECT event_id, list_transform(range(20), lambda i: CASE WHEN ls[i + 1] >= least THEN round(ls[i + 1] / 0.8 - ln(-ln((('0x' || substr(md5(concat(event_id, ':', i)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)), 9) END) AS ns FROM t)
    SELECT event_id, list_position(ns, list_max(ns)) - 1 AS token FROM n"""
)
def sample_tokens(spark, d):
    """A token drawn from the five greatest of twenty logits (there is no model, so logits come from digests)."""
    e = table(spark, d, "events")
    logits = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.round(F.lit(-1.5) * F.log(G.uniform(F.lit("l"), F.col("event_id").cast("string"), i.cast("string"))), 6))
    return e.select("event_id", logits.alias("ls")).select("event_id", G.drawn_token(F.col("ls"), F.col("event_id").cast("string"), 5, 0.8).cast("bigint").alias("token"))


@query("SELECT s::BIGINT AS step, round(CASE WHEN s < 10 THEN 0.001 * (s + 1) / 10 WHEN s >= 100 THEN 0.0001 ELSE 0.0001 + 0.5 * (1 + cos(pi() * (s - 10) / 90)) * 0.0009 END, 9) AS rate FROM range(120) r(s)")
def rate_schedule(spark, d):
    return spark.range(120).select(F.col("id").alias("step"), F.round(G.cosine_rate(F.col("id"), 10, 100, 1e-3, 1e-4), 9).alias("rate"))


_LOSSES = [3.0, 2.5, 2.49, 2.6, 2.2, 2.2, 2.19, 2.18, 2.3]


@query(
    "SELECT step, loss::DOUBLE AS loss, best, stale, stop FROM (VALUES (0, 3.0, true, 0, false), (1, 2.5, true, 0, false), (2, 2.49, true, 1, false), (3, 2.6, false, 2, false), (4, 2.2, true, 0, false), (5, 2.2, false, 1, false), (6, 2.19, true, 2, false), (7, 2.18, true, 3, true), (8, 2.3, false, 4, true)) v(step, loss, best, stale, stop)"
)
def early_stop_cases(spark, d):
    log = spark.createDataFrame(list(enumerate(_LOSSES)), "step bigint, loss double")
    return G.early_stop(log, "step", "loss", 3, 0.05).withColumn("step", F.col("step").cast("int"))


@query("SELECT * FROM (VALUES (0, '0s', '00:00'), (9, '9s', '00:09'), (127, '2m07s', '02:07'), (3900, '1h05m', '01:05:00'), (183723, '51h02m', '2d03h')) v(seconds, short, clock)")
def time_rendering(spark, d):
    x = spark.createDataFrame([(s,) for s in (0, 9, 127, 3900, 183723)], "seconds int")
    return x.select("seconds", G.short_time(F.col("seconds")).alias("short"), G.clock_time(F.col("seconds")).alias("clock"))


@query(f"SELECT id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS at, epoch(date_trunc('second', created_at))::BIGINT AS seconds, CASE WHEN latency_ms IS NULL THEN NULL ELSE format('{{:,}}', latency_ms) END AS latency, CASE WHEN length(input) > 40 THEN substr(input, 1, 39) || '…' ELSE input END AS input FROM {ONCE}")
def request_rendering(spark, d):
    r = S.deduplicated(table(spark, d, "requests"))
    return r.select("id", G.iso_utc(F.col("created_at")).alias("at"), F.floor(S.micros("created_at") / 1_000_000).alias("seconds"), F.format_number("latency_ms", 0).alias("latency"), G.shortened(F.col("input"), 40).alias("input"))


@query("SELECT name, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1) AS host, replace(name, '-', '%2D') AS path FROM nodes")
def node_addresses(spark, d):
    n = table(spark, d, "nodes")
    return n.select("name", G.host_of(F.col("url")).alias("host"), F.replace(G.url_part("name"), F.lit("-"), F.lit("%2D")).alias("path"))


@query("SELECT lower(domain) AS domain, count(*) AS n FROM documents WHERE domain IS NOT NULL GROUP BY 1 ORDER BY n DESC, domain LIMIT 20")
def top_domains(spark, d):
    return G.frequency_summary(table(spark, d, "documents").where("domain is not null").select(F.lower("domain").alias("domain")), "domain", 20)


@query(f"SELECT doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*'), lambda w: length(w) > 1 AND w = upper(w))) AS capitals, len(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*'), lambda w: length(w) > 12)) AS long_words, {n_of('text', r'[{}\[\]<>;`\\=_]')} AS symbols FROM documents")
def word_shapes(spark, d):
    w = F.regexp_extract_all("text", F.lit(X.WORD), F.lit(0))
    symbols = F.length("text") - F.length(F.translate("text", X.CODE_SYMBOLS, ""))
    return table(spark, d, "documents").select("doc_id", G.words_in_capitals(F.col("text")).cast("bigint").alias("capitals"), F.size(F.filter(w, lambda x: F.length(x) > 12)).cast("bigint").alias("long_words"), symbols.cast("bigint").alias("symbols"))


_BYTES = [(1, b"plain"), (2, "é".encode()), (3, b"\xff\xfe"), (4, b"\xc3"), (5, b"")]


@query("SELECT * FROM (VALUES (1, 'plain'), (2, 'é'), (3, NULL), (4, NULL), (5, '')) v(n, text)")
def utf8_cases(spark, d):
    return spark.createDataFrame([(n, bytearray(b)) for n, b in _BYTES], "n int, b binary").select("n", G.text_of_utf8(F.col("b")).alias("text"))


_WEIGHTS = {"fineweb-edu": 7.0, "wikipedia": 1.2, "simple-wikipedia": 0.5, "smollm-edu": 0.8, "open-web-math": 0.3, "stackexchange": 0.2}


@query("SELECT * FROM (VALUES ('fineweb-edu', 7000000000), ('wikipedia', 1200000000), ('simple-wikipedia', 500000000), ('smollm-edu', 800000000), ('open-web-math', 300000000), ('stackexchange', 200000000)) v(source, quota)")
def source_quotas(spark, d):
    return spark.createDataFrame(list(G.quota_shares(_WEIGHTS, 10_000_000_000).items()), "source string, quota bigint")


@query("SELECT * FROM (VALUES (0, 'wikipedia'), (1, 'open-web-math'), (2, 'fineweb-edu')) v(place, source)")
def source_arguments(spark, d):
    return spark.createDataFrame(list(enumerate(G.source_list("Wiki, math,wikipedia ,FINEWEB-EDU,,math", X.SOURCE_NAMES, X.SOURCES))), "place int, source string")


@query(
    f"""WITH d AS (SELECT {SOURCE_SQL.format(c='source')} AS source, text FROM corpus_docs) SELECT source, count(*) AS documents, sum(strlen(coalesce(text, '')))::BIGINT AS bytes, sum(length(coalesce(text, '')))::BIGINT AS chars, sum({n_of("coalesce(text, '')", r"\S+")})::BIGINT AS words,
      quantile_cont({n_of("coalesce(text, '')", r"\S+")}, 0.5) AS median_words FROM d GROUP BY source"""
)
def corpus_source_report(spark, d):
    t = F.coalesce("text", F.lit(""))
    x = table(spark, d, "corpus_docs").select(T.source_name("source").alias("source"), t.alias("t")).withColumn("w", T.words("t"))
    return x.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.octet_length("t").cast("bigint")).alias("bytes"), F.sum(F.length("t").cast("bigint")).alias("chars"), F.sum("w").alias("words"), F.percentile("w", F.lit(0.5)).alias("median_words"))


@query("SELECT seq FROM sft_pairs ORDER BY md5(concat('5:', seq)), seq LIMIT 1500")
def judge_budget_cut(spark, d):
    """As many batches of ten as a balance pays for, in an order by hash; the number of batches stands for the limit of a budget."""
    batches = min(150, G.affordable(0.3, 0.15, 0.0006))
    p = table(spark, d, "sft_pairs").select("seq", F.md5(F.concat(F.lit("5:"), F.col("seq").cast("string"))).alias("h"))
    return p.orderBy("h", "seq").limit(10 * batches).select("seq")




@query("SELECT doc_id, md5(chr(10) || chr(10) || regexp_replace(regexp_replace(text, '</?p>', chr(10), 'g'), '</?[bi]>', '', 'g') || chr(10) || chr(10) || chr(10) || 'One' || chr(10) || chr(10) || chr(10) || 'End — now') AS seen FROM documents")
def pages_visible_text(spark, d):
    """Documents wrapped into pages (some hold tags of their own), and the text that a reader sees."""
    from corvane.operators import cleaning as K

    text = F.replace("text", F.lit("&"), F.lit("&amp;"))
    page = F.concat(F.lit("<html><head><style>p { x }</style></head><body><nav>Home | About</nav><div><p>"), text, F.lit("</p></div><script>var a = 1 < 2;</script><ul><li>One</li></ul><br/>End &mdash; now</body></html>"))
    return table(spark, d, "documents").select("doc_id", page.alias("page")).select("doc_id", F.md5(K.visible_text("page")).alias("seen"))


_ODD = [(1, "ﬁne ① Ａ ½", "fine 1 A 1⁄2"), (2, "plain", "plain"), (3, "é", "é"), (4, None, None)]


@query("SELECT * FROM (VALUES (1, 'fine 1 A 1⁄2'), (2, 'plain'), (3, 'é'), (4, NULL)) v(n, text)")
def compatible_cases(spark, d):
    from corvane.operators import cleaning as K

    return spark.createDataFrame([(n, t) for n, t, _ in _ODD], "n int, t string").select("n", K.compatible("t").alias("text"))


@query("SELECT id, CASE WHEN user_id IS NULL THEN 'invalid' ELSE 'valid' END AS row FROM (SELECT DISTINCT ON (id) * FROM requests)")
def row_validity(spark, d):
    return S.deduplicated(table(spark, d, "requests")).select("id", F.when(T.blank(F.coalesce("user_id", F.lit(""))), "invalid").otherwise("valid").alias("row"))


@query("SELECT seq, md5(coalesce(nullif(user_msg, ''), 'nothing') || '|' || coalesce(assistant_msg, user_msg, 'nothing')) AS text FROM sft_pairs")
def coalesced_texts(spark, d):
    t = F.concat_ws("|", F.coalesce(F.nullif("user_msg", F.lit("")), F.lit("nothing")), F.coalesce("assistant_msg", "user_msg", F.lit("nothing")))
    return table(spark, d, "sft_pairs").select("seq", F.md5(t).alias("text"))


