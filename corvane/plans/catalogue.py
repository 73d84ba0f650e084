"""Every query of the engine's own operators over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import fixed as X
from corvane.functions import text as T
from corvane.operators import cleaning as K
from corvane.operators import curation as C
from corvane.operators import instruction as I
from corvane.operators import service as S
from corvane.operators import verify as V
from corvane.plans.registry import ONCE, QUERIES, SOURCE_SQL, SQL, n_of, query, quoted, sql_list, table, texts, words_of
from corvane.streaming import state as ST


def queries():
    from corvane.plans import connectors, jobs, requests, training  # noqa: F401  (they add their queries)

    return dict(QUERIES)


def oracle_sql():
    queries()
    return dict(SQL)


_q = quoted

# -- pieces of SQL

WORDS = n_of("text", r"\S+")
VISIBLE = n_of("text", r"\S")
LETTERS = n_of("text", r"\p{L}")
LATIN = n_of("text", r"[A-Za-z\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]")
DIGITS = n_of("text", "[0-9]")


STOPS = words_of("text", X.STOP_WORDS)
LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
# A table line has three pipes, two tabs, or is a rule of dashes or pipes.
TABLE = r"(length(x) - length(replace(x, '|', '')) >= 3 OR length(x) - length(replace(x, chr(9), '')) >= 2 OR (regexp_matches(x, '^\s*\|?[\s:|-]{6,}\|?\s*$') AND (contains(x, '|') OR contains(x, '-'))))"
CODE = (
    f"(regexp_matches(x, '{_q(X.CODE_LINE)}') OR regexp_matches(x, '{_q(X.CODE_TOKEN)}') OR length(x) - length(translate(x, '{{}}', '')) >= 2"
    f" OR (length(x) > 24 AND (length(x) - length(translate(x, '{{}}[]<>;`\\=_', ''))) / length(x) > 0.15))"
)
BOILER = f"(regexp_matches(x, '{_q(X.BOILERPLATE)}') OR regexp_matches(x, '{_q(X.NAVIGATION)}') OR regexp_matches(x, '{_q(X.ADVERTS)}'))"
TOKENS = "regexp_extract_all(lower({c}), '[a-z0-9]+')"
DIGEST = f"md5(array_to_string({TOKENS.format(c='{c}')}, ' '))"


# -- corpus


@query(f"SELECT {SOURCE_SQL.format(c='source')} AS source, count(*) AS documents, sum(strlen(text))::BIGINT AS text_bytes, sum({WORDS})::BIGINT AS words FROM documents GROUP BY 1")
def corpus_source_stats(spark, d):
    return table(spark, d, "documents").groupBy(T.source_name("source").alias("source")).agg(F.count("*").alias("documents"), F.sum(F.octet_length("text").cast("bigint")).alias("text_bytes"), F.sum(T.words("text")).alias("words"))


@query(
    f"""WITH w AS (SELECT {WORDS} AS n FROM documents)
    SELECT min(n)::DOUBLE AS min, round(quantile_cont(n, 0.1), 6) AS p10, round(quantile_cont(n, 0.5), 6) AS median, round(avg(n), 6) AS mean,
           round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99, max(n)::DOUBLE AS max FROM w"""
)
def corpus_length_summary(spark, d):
    n = table(spark, d, "documents").select(T.words("text").alias("n"))
    p = lambda q: F.round(F.percentile("n", F.lit(q)), 6)
    return n.agg(F.min("n").cast("double").alias("min"), p(0.1).alias("p10"), p(0.5).alias("median"), F.round(F.avg("n"), 6).alias("mean"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max("n").cast("double").alias("max"))


@query("SELECT count(*) - count(DISTINCT id) AS duplicate_ids, count(*) - count(DISTINCT text) AS duplicate_texts FROM corpus_docs")
def corpus_dup_counts(spark, d):
    return table(spark, d, "corpus_docs").agg((F.count("*") - F.countDistinct("id")).alias("duplicate_ids"), (F.count("*") - F.countDistinct(F.md5("text"))).alias("duplicate_texts"))


@query(
    f"""WITH k AS (SELECT seq, {DIGEST.format(c="coalesce(text, '')")} AS dig, min(seq) OVER (PARTITION BY id) AS first_of FROM corpus_docs),
    f AS (SELECT dig, min(seq) AS first_text FROM k WHERE first_of = seq GROUP BY dig)
    SELECT seq, CASE WHEN first_of <> seq THEN 'duplicate_id' WHEN first_text <> seq THEN 'duplicate_text' ELSE 'accepted' END AS outcome FROM k LEFT JOIN f USING (dig)"""
)
def corpus_exact_dedup(spark, d):
    return C.first_wins(table(spark, d, "corpus_docs"))


def _ratio(a: str, b: str) -> str:
    return f"round({a} / greatest({b}, 1), 6)"


@query(f"SELECT doc_id, {WORDS} AS words, {_ratio(LETTERS, VISIBLE)} AS alpha, {_ratio(LATIN, LETTERS)} AS latin, {_ratio(DIGITS, VISIBLE)} AS digits, {STOPS} AS stops, {_ratio(STOPS, WORDS)} AS stop_ratio FROM documents")
def corpus_text_ratios(spark, d):
    return C.text_ratios(texts(spark, d, "documents"))


# The steps of cleaning in SQL. The tables hold no entities and only the tags <p>, <b> and <i>, and no compatibility characters in documents
# that come so far; SQL has no parser of mark-up and no compatibility composition.
_NBSP = "'‘’“”–—−' || chr(160) || chr(8203) || chr(8204) || chr(8205) || chr(65279)"


def _clean_sql(name: str, key: str, strict: bool) -> str:
    tag = r"</?(?:p|div|br|span|a|li|table|tr|td|ul|ol|h[1-6])\b[^>]*>" if strict else r"<[!/a-zA-Z][^>]{0,1000}>"
    shown = rf"CASE WHEN regexp_matches(text, '(?i){tag}') THEN regexp_replace(regexp_replace(text, '(?i)</?p>', chr(10), 'g'), '</?[a-zA-Z][^>]*>', '', 'g') ELSE text END"
    plain = rf"""regexp_replace(replace(translate(regexp_replace(regexp_replace(regexp_replace({shown}, '!\[[^\]]*\]\([^)]+\)', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\[\d+(?:,\s*\d+)*\]', '', 'g'), {_NBSP}, chr(39) || chr(39) || '""--- '), '…', '...'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"""
    x = "m"
    line = lambda t: t.replace("(x,", f"({x},").replace("length(x)", f"length({x})").replace("(x, ", f"({x}, ")
    letters, latin = n_of("m", r"\p{L}"), n_of("m", r"[A-Za-z\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]")
    if strict:
        kind = f"WHEN {line(TABLE)} THEN 'boiler' WHEN {line(CODE)} THEN 'code' WHEN {line(BOILER)} THEN 'boiler' WHEN {letters} > 0 AND {latin} / {letters} < 0.72 THEN 'none' WHEN length(u) > 300 AND NOT contains(u, ' ') THEN 'none'"
    else:
        code = rf"(regexp_matches(m, '{_q(X.CODE_LINE_A)}') OR regexp_matches(m, '{_q(X.CODE_TOKEN_A)}') OR length(m) - length(translate(m, '{{}}', '')) >= 2 OR (length(m) > 20 AND (length(m) - length(translate(m, '{{}}[]<>;`\=_', ''))) / length(m) > 0.14))"
        kind = rf"WHEN {line(TABLE)} THEN 'none' WHEN {code} THEN 'code' WHEN len(regexp_extract_all(m, '\S+')) <= 24 AND regexp_matches(m, '{_q(X.BOILERPLATE_A)}') THEN 'none' WHEN length(m) > 300 AND NOT contains(m, ' ') THEN 'none'"
    least, alpha, share, lines_ = (200, 0.64, 0.94, 0.60) if strict else (250, 0.62, 0.92, 0.55)
    ws, ln = n_of("t", r"\S+"), "list_filter(string_split(t, chr(10)), lambda v: v <> '')"
    vis, let, lat, dig = (n_of("t", p) for p in (r"\S", r"\p{L}", r"[A-Za-z\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]", r"\p{Nd}"))
    rep = f"(len({ln}) >= 8 AND len(list_distinct({ln})) / len({ln}) < {lines_})"
    gate = f"CASE WHEN raw IS NULL OR length(raw) < {least} THEN 'too_short_raw' "
    stops = f"len(list_filter(w, lambda v: v IN ({sql_list(X.STOP_WORDS)})))"
    if strict:
        gate += rf"""WHEN contains(raw, chr(65533)) THEN 'replacement_character' WHEN content > 0 AND (code >= 15 OR (code >= 5 AND code / content >= 0.08)) THEN 'code_heavy'
        WHEN content > 0 AND code >= 3 AND regexp_matches(plain, '{_q(X.SOFTWARE)}') THEN 'software_documentation' WHEN content > 0 AND (boiler >= 12 OR (boiler >= 5 AND boiler / content >= 0.30)) THEN 'boilerplate_heavy'
        WHEN {ws} < 50 THEN 'too_short' WHEN {vis} = 0 OR {let} / {vis} < {alpha} THEN 'low_alpha' WHEN {let} = 0 OR {lat} / {let} < {share} THEN 'non_english_script' WHEN {dig} / {vis} > 0.18 THEN 'too_many_digits'
        WHEN st < 3 OR st / greatest(len(w), 1) < 0.045 THEN 'non_english_heuristic' WHEN {rep} THEN 'repetition' WHEN regexp_matches(t, '{_q(X.HTML_TAG)}') OR regexp_matches(t, '{_q(X.ENTITY)}') THEN 'residual_html' ELSE 'accepted' END"""
    else:
        gate += rf"""WHEN length(raw) - length(replace(raw, chr(65533), '')) > greatest(2, length(raw) // 2000) THEN 'broken_unicode' WHEN content > 0 AND code / content > 0.20 THEN 'code' WHEN len(w) < 50 THEN 'too_short' WHEN len(w) > 40000 THEN 'too_long'
        WHEN {vis} = 0 OR {let} / {vis} < {alpha} THEN 'low_alpha' WHEN {let} = 0 OR {lat} / {let} < {share} THEN 'non_english_script' WHEN st < 3 OR st / len(w) < 0.045 THEN 'non_english' WHEN {dig} / {vis} > 0.18 THEN 'too_many_digits'
        WHEN len(list_filter(w0, lambda v: length(v) > 40)) > greatest(2, len(w) // 100) THEN 'broken_tokens' WHEN len(list_filter(w0, lambda v: length(v) > 1 AND v = upper(v))) / len(w) > 0.22 THEN 'too_many_caps'
        WHEN {rep} OR (len(w) >= 100 AND list_max(map_values(list_histogram(w))) / len(w) > 0.14) THEN 'repetition' ELSE 'accepted' END"""
    return rf"""WITH p AS (SELECT {key} AS k, text AS raw, {SOURCE_SQL.format(c='source')} AS src, CASE WHEN length(text) >= {least} THEN {plain} END AS plain FROM {name}),
    l0 AS (SELECT k, src, i, trim(l, ' ' || chr(9) || chr(10) || chr(13)) AS l FROM (SELECT k, src, unnest(string_split(plain, chr(10))) AS l, generate_subscripts(string_split(plain, chr(10)), 1) AS i FROM p)),
    l1 AS (SELECT *, regexp_matches(l, '^(```|~~~)') AS fence, count(*) FILTER (regexp_matches(l, '^(```|~~~)')) OVER (PARTITION BY k ORDER BY i) % 2 = 1 AS inside, trim(regexp_replace(l, '^\s{{0,3}}#{{1,6}}\s+', '')) AS h FROM l0),
    s AS (SELECT k, min(i) AS stop FROM l1 WHERE NOT fence AND NOT inside AND src IN ('wikipedia', 'simple-wikipedia') AND lower(h) IN ({sql_list(X.STOP_SECTIONS)}) GROUP BY k),
    l2 AS (SELECT l1.*, {"trim(" if strict else "("}regexp_replace(h, '^\s*(?:[-*+]|\d+[.)])\s+', '')) AS m FROM l1 LEFT JOIN s USING (k) WHERE stop IS NULL OR i < stop),
    l3 AS (SELECT *, trim(regexp_replace(regexp_replace(m, '(?i)(?:https?://\S+|www\.\S+)', '', 'g'), '[ \t]+', ' ', 'g')) AS u FROM l2),
    l4 AS (SELECT *, CASE WHEN fence THEN 'fence' WHEN inside THEN CASE WHEN l <> '' THEN 'inner' ELSE 'none' END WHEN l = '' THEN 'blank' WHEN m = '' THEN 'none' {kind} WHEN u = '' THEN 'none' ELSE 'keep' END AS kind FROM l3),
    c AS (SELECT k, count(*) FILTER (kind IN ({"'fence', 'inner', 'code'" if strict else "'fence', 'code'"})) AS code, count(*) FILTER (kind = 'boiler') AS boiler, count(*) FILTER (NOT fence AND NOT inside AND l <> '') AS lines,
      trim(regexp_replace(coalesce(string_agg(CASE WHEN kind = 'keep' THEN u ELSE '' END, chr(10) ORDER BY i) FILTER (kind IN ('keep', 'blank')), ''), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS t FROM l4 GROUP BY k),
    d AS (SELECT p.*, coalesce(code, 0) AS code, coalesce(boiler, 0) AS boiler, coalesce(lines, 0) + (stop IS NOT NULL)::INT AS content, coalesce(t, '') AS t, regexp_extract_all(coalesce(t, ''), '[A-Za-z][A-Za-z''-]*') AS w0 FROM p LEFT JOIN c USING (k) LEFT JOIN s USING (k)),
    e AS (SELECT *, list_transform(w0, lambda v: trim(lower(v), chr(39))) AS w FROM d), f AS (SELECT *, {stops} AS st FROM e),
    g AS (SELECT *, {gate} AS reason FROM f)"""


_STRICT = _clean_sql("documents", "doc_id", True)


@query(f"{_STRICT} SELECT k AS doc_id, reason, CASE WHEN reason = 'accepted' THEN md5(t) END AS cleaned FROM g")
def corpus_clean(spark, d):
    docs = texts(spark, d, "documents").select("doc_id", T.source_name("source").alias("source"), "text")
    return K.clean(docs).select("doc_id", "reason", F.md5("cleaned").alias("cleaned"))


@query(f"{_clean_sql('documents', 'doc_id', False)} SELECT k AS doc_id, reason, CASE WHEN reason = 'accepted' THEN md5(t) END AS cleaned FROM g")
def corpus_intake(spark, d):
    docs = texts(spark, d, "documents").select("doc_id", T.source_name("source").alias("source"), "text")
    return K.clean(docs, K.INTAKE).select("doc_id", "reason", F.md5("cleaned").alias("cleaned"))


@query(f"{_clean_sql('corpus_docs', 'seq', True)} SELECT k AS seq, reason FROM g")
def corpus_reject_reasons(spark, d):
    docs = texts(spark, d, "corpus_docs").select("seq", T.source_name("source").alias("source"), "text")
    return K.clean(docs).select("seq", "reason")


@query(f"{_STRICT} SELECT src AS source, reason, count(*) AS documents FROM g GROUP BY 1, 2")
def corpus_curation_summary(spark, d):
    docs = texts(spark, d, "documents").select(T.source_name("source").alias("source"), "text")
    return K.clean(docs).groupBy("source", "reason").agg(F.count("*").alias("documents"))


@query(
    f"""WITH a AS (SELECT seq, {LINES} AS ls FROM corpus_docs)
    SELECT seq, len(ls) AS lines, len(list_distinct(ls)) AS distinct_lines, len(list_filter(ls, lambda x: {TABLE})) AS table_lines, len(list_filter(ls, lambda x: {CODE})) AS code_lines, len(list_filter(ls, lambda x: {BOILER})) AS boiler_lines FROM a"""
)
def corpus_line_flags(spark, d):
    return C.line_counts(texts(spark, d, "corpus_docs"), "seq")


_TEXT = lambda sql: sql.replace("(x,", "(text,")


def _flags_sql(name: str, key: str, text: str = "text") -> str:
    return f"""WITH a AS (SELECT {key} AS k, coalesce({text}, '') AS text FROM {name}), b AS (SELECT *, {LINES} AS ls FROM a), x AS (SELECT k, unnest(list_filter([
 CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' END, CASE WHEN contains(text, chr(65533)) OR regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') THEN 'broken_unicode' END,
 CASE WHEN regexp_matches(text, '{_q(X.HTML_TAG)}') THEN 'html' END, CASE WHEN regexp_matches(text, '{_q(X.ENTITY)}') THEN 'html_entity' END,
 CASE WHEN {_TEXT(BOILER)} THEN 'boilerplate' END, CASE WHEN len(list_filter(ls, lambda x: {CODE})) >= 3 THEN 'code' END, CASE WHEN len(list_filter(ls, lambda x: {TABLE})) >= 2 THEN 'table' END,
 CASE WHEN {WORDS} < 50 THEN 'too_short' END, CASE WHEN {WORDS} > 10000 THEN 'too_long' END], lambda f: f IS NOT NULL)) AS flag FROM b)"""


FLAGS = _flags_sql("corpus_docs", "seq")


@query(f"{FLAGS} SELECT flag, count(*) AS documents FROM x GROUP BY flag")
def corpus_validation_flags(spark, d):
    return texts(spark, d, "corpus_docs").select(F.explode_outer(K.flags("text")).alias("flag")).where("flag is not null").groupBy("flag").agg(F.count("*").alias("documents"))


_LEAKS = ["broken_unicode", "html", "html_entity", "boilerplate", "code", "table", "too_short", "too_long"]


@query(
    f"""{FLAGS}, t AS (SELECT count(*) AS documents, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, sum(coalesce({WORDS}, 0))::BIGINT AS words, count(*) FILTER (id IS NULL OR text IS NULL OR source IS NULL) AS invalid_types,
      count(*) FILTER ({SOURCE_SQL.format(c='source')} = 'unknown') AS invalid_source, count(*) - count(DISTINCT id) AS duplicate_ids, count(*) - count(DISTINCT text) AS duplicate_texts,
      round(avg((len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda x: x IN ('the', 'of', 'and', 'was'))) >= 3)::INT), 6) AS english_fraction FROM corpus_docs),
    f AS (SELECT count(*) FILTER (flag = 'empty') AS empty, {", ".join(f"count(*) FILTER (flag = '{f}') AS \"{f}\"" for f in _LEAKS)} FROM x)
    SELECT *, CASE WHEN bytes < 1000000000 OR english_fraction < 0.995 OR greatest(invalid_types, invalid_source, empty, duplicate_ids, duplicate_texts, {", ".join(f'"{f}"' for f in _LEAKS)}) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM t, f"""
)
def corpus_verdict(spark, d):
    null = F.col("id").isNull() | F.col("text").isNull() | F.col("source").isNull()
    english = T.count_of(F.coalesce("text", F.lit("")), ["the", "of", "and", "was"]) >= 3
    return K.validation_report(texts(spark, d, "corpus_docs"), {"invalid_types": null, "invalid_source": T.source_name("source") == "unknown"}, english, 1_000_000_000)


_VERDICTS = [(1, 2, 2, 0, 1.0), (2, 1, 2, 0, 1.0), (3, 2, 2, 1, 1.0), (4, 2, 2, 0, 0.5)]


@query("SELECT * FROM (VALUES (1, 'PASS'), (2, 'FAIL'), (3, 'FAIL'), (4, 'FAIL')) v(n, verdict)")
def corpus_verdict_cases(spark, d):
    """The verdict on a table that passes, and on ones that are too small, hold a leak or are half in another language."""
    good = "The people of the town went to the market on the hill and it was not far from the river that they had seen. "
    out = None
    for n, (size, leak, english) in enumerate([(100, "", 1), (10**9, "", 1), (100, "<p>", 1), (100, "", 0)], 1):
        docs = spark.createDataFrame([("a", good * 3 + leak, "wikipedia"), ("b", good * 4, "wikipedia")], "id string, text string, source string")
        e = F.lit(True) if english else F.col("id") == "a"
        one = K.validation_report(docs, {"invalid_types": F.col("text").isNull()}, e, size).select(F.lit(n).alias("n"), "verdict")
        out = one if out is None else out.unionByName(one)
    return out


_AGAIN = _clean_sql("(SELECT r.* FROM corpus_docs r WHERE seq IN (SELECT k FROM fl))", "seq", True).replace("WITH p AS", "p AS", 1)


@query(
    f"""{FLAGS}, fl AS (SELECT DISTINCT k FROM x), {_AGAIN.replace(" x AS", " xx AS")}, y AS (SELECT k, t FROM g WHERE reason = 'accepted'),
    z AS ({_flags_sql("y", "k", "t")} SELECT DISTINCT k FROM x)
    SELECT seq, CASE WHEN seq NOT IN (SELECT k FROM fl) THEN 'kept' WHEN seq IN (SELECT k FROM y) AND seq NOT IN (SELECT k FROM z) THEN 'repaired' ELSE 'rejected' END AS outcome,
      md5(CASE WHEN seq NOT IN (SELECT k FROM fl) THEN text WHEN seq IN (SELECT k FROM y) AND seq NOT IN (SELECT k FROM z) THEN y.t END) AS text FROM corpus_docs LEFT JOIN y ON y.k = seq"""
)
def corpus_repair(spark, d):
    docs = texts(spark, d, "corpus_docs").select("seq", T.source_name("source").alias("source"), "text")
    return K.repair(docs).select("seq", "outcome", F.md5("text").alias("text"))


@query(
    f"""WITH w AS (SELECT doc_id, unnest({TOKENS.format(c='text')}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL)
    SELECT doc_id, max(n) AS top_count, sum(n)::BIGINT AS tokens, round(max(n) / sum(n), 6) AS top_ratio FROM c GROUP BY doc_id"""
)
def corpus_repetition(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.array_sort(T.tokens("text")).alias("t")).where(F.size("t") > 0)
    # a fold over the sorted tokens finds the longest run without a shuffle
    zero = F.struct(F.lit("").alias("w"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a, x):
        run = F.when(a["w"] == x, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("w"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    r = w.select("doc_id", F.aggregate("t", zero, step)["best"].cast("bigint").alias("top_count"), F.size("t").cast("bigint").alias("tokens"))
    return r.withColumn("top_ratio", F.round(F.col("top_count") / F.col("tokens"), 6))


@query(
    """WITH l AS (SELECT seq, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM corpus_docs),
    f AS (SELECT *, regexp_matches(trim(line), '^(```|~~~)') AS fence FROM l), s AS (SELECT *, sum(fence::INT) OVER (PARTITION BY seq ORDER BY i) AS k FROM f)
    SELECT seq, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT fence AND k % 2 = 0), '')) AS kept FROM s GROUP BY seq"""
)
def corpus_fence_lines(spark, d):
    return C.fence_kept(table(spark, d, "corpus_docs"), "seq").select("seq", F.md5("kept").alias("kept"))


QUOTAS = [("fineweb-edu", 700_000), ("wikipedia", 120_000), ("simple-wikipedia", 50_000), ("smollm-edu", 80_000), ("open-web-math", 30_000), ("stackexchange", 20_000)]
_QUOTA_SQL = "(VALUES " + ", ".join(f"('{s}', {q})" for s, q in QUOTAS) + ") q(source, quota)"


@query(
    f"""WITH d AS (SELECT doc_id, {SOURCE_SQL.format(c='source')} AS source, strlen(text) AS b FROM documents),
    r AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bytes_before FROM d)
    SELECT doc_id, r.source, bytes_before FROM r JOIN {_QUOTA_SQL} USING (source) WHERE bytes_before < quota"""
)
def corpus_byte_quota(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.source_name("source").alias("source"), F.octet_length("text").cast("bigint").alias("size"))
    quotas = spark.createDataFrame(QUOTAS, "source string, quota bigint")
    return C.byte_quota(docs, quotas, size=F.col("size")).select("doc_id", "source", "bytes_before")


@query(
    """WITH u AS (SELECT 0 AS stage, doc_id AS n, strlen(text) AS b FROM documents UNION ALL SELECT 1, seq, strlen(text) FROM corpus_docs),
    r AS (SELECT *, coalesce(sum(b) OVER (ORDER BY stage, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bytes_before FROM u)
    SELECT stage, count(*) AS records, sum(b)::BIGINT AS bytes FROM r WHERE bytes_before < 2500000 GROUP BY stage"""
)
def corpus_topup_until_target(spark, d):
    first = table(spark, d, "documents").select(F.lit(0).alias("stage"), F.col("doc_id").alias("n"), F.octet_length("text").cast("bigint").alias("b"))
    more = table(spark, d, "corpus_docs").select(F.lit(1).alias("stage"), F.col("seq").alias("n"), F.octet_length("text").cast("bigint").alias("b"))
    order = F.col("stage").cast("bigint") * F.lit(1 << 40) + F.col("n")
    rows = first.unionByName(more).withColumn("at", order).withColumn("source", F.lit("all"))
    quotas = spark.createDataFrame([("all", 2_500_000)], "source string, quota bigint")
    return C.byte_quota(rows, quotas, order="at", size=F.col("b")).groupBy("stage").agg(F.count("*").alias("records"), F.sum("b").alias("bytes"))


@query("SELECT doc_id, md5(concat('42:', doc_id)) AS priority FROM documents ORDER BY priority, doc_id LIMIT 100")
def corpus_bottomk_sample(spark, d):
    return C.bottom_k(table(spark, d, "documents"), 100, 42).select("doc_id", "priority")


LANG_SQL = "CASE " + " ".join(f"WHEN regexp_replace(lower(trim({{c}})), '[-_].*$', '') IN ({', '.join(repr(s) for s in names)}) THEN '{code}'" for code, names in {"en": ["en", "eng", "english"], "de": ["de", "deu", "german"], "fr": ["fr", "fra", "french"], "es": ["es", "spa", "spanish"]}.items()) + " ELSE 'other' END"


@query(f"SELECT {LANG_SQL.format(c='lang')} AS lang, count(*) AS documents, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM documents GROUP BY 1")
def corpus_lang_fraction(spark, d):
    c = F.regexp_replace(F.lower(F.trim("lang")), "[-_].*$", "")
    code = F.when(c.isin("en", "eng", "english"), "en").when(c.isin("de", "deu", "german"), "de").when(c.isin("fr", "fra", "french"), "fr").when(c.isin("es", "spa", "spanish"), "es").otherwise("other")
    n = table(spark, d, "documents").groupBy(code.alias("lang")).agg(F.count("*").alias("documents"))
    return n.withColumn("fraction", F.round(F.col("documents") / F.sum("documents").over(Window.partitionBy()), 6))


@query(
    f"""WITH t AS (SELECT seq, {TOKENS.format(c='text')} AS t FROM download_candidates), s AS (SELECT seq, t, len(t) - 2 AS n, greatest(1, (len(t) - 2) // 160) AS step FROM t WHERE len(t) > 2),
    h AS (SELECT seq, md5(array_to_string(t[i:i + 2], ' ')) AS h FROM (SELECT seq, t, unnest(range(1, n + 1, step)) AS i FROM s)),
    v AS (SELECT seq, b, sum(CASE WHEN (('0x' || substr(h, 1 + 8 * (1 - b // 32)::INT, 8))::BIGINT >> (b % 32)::INT) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, range(64) r(b) GROUP BY seq, b)
    SELECT seq, printf('%08x', sum(CASE WHEN b >= 32 AND v >= 0 THEN 1::BIGINT << (b - 32)::INT ELSE 0 END)::BIGINT) || printf('%08x', sum(CASE WHEN b < 32 AND v >= 0 THEN 1::BIGINT << b::INT ELSE 0 END)::BIGINT) AS bits FROM v GROUP BY seq
    UNION ALL SELECT seq, substr(md5(array_to_string(t, ' ')), 1, 16) FROM t WHERE len(t) < 3 UNION ALL SELECT seq, NULL FROM download_candidates WHERE text IS NULL"""
)
def corpus_simhash(spark, d):
    return C.simhash(texts(spark, d, "download_candidates"), "seq")


_FIRST = "(SELECT simhash AS f, min(seq) AS i FROM download_candidates WHERE simhash IS NOT NULL GROUP BY simhash)"
_PAIRS = f"SELECT a.i AS a, b.i AS b, bit_count(xor(a.f, b.f))::BIGINT AS distance FROM {_FIRST} a JOIN {_FIRST} b ON a.i < b.i AND bit_count(xor(a.f, b.f)) <= 3"


@query(_PAIRS)
def corpus_near_dup_pairs(spark, d):
    return C.simhash_pairs(table(spark, d, "download_candidates"))


@query(
    f"""WITH RECURSIVE pairs AS ({_PAIRS}), ends AS (SELECT i, row_number() OVER (ORDER BY i) AS n FROM (SELECT a AS i FROM pairs UNION SELECT b FROM pairs)),
    near AS (SELECT n, i, (SELECT coalesce(list(a), []) FROM pairs WHERE b = i) AS before FROM ends),
    walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL SELECT near.n, CASE WHEN list_has_any(walk.kept, near.before) THEN walk.kept ELSE list_append(walk.kept, near.i) END FROM walk JOIN near ON near.n = walk.n + 1),
    last AS (SELECT kept FROM walk ORDER BY n DESC LIMIT 1)
    SELECT i, NOT (i IN (SELECT i FROM ends)) OR list_contains((SELECT kept FROM last), i) AS kept FROM {_FIRST}"""
)
def corpus_near_dedup_greedy(spark, d):
    rows = table(spark, d, "download_candidates")
    nodes = rows.where("simhash is not null").groupBy("simhash").agg(F.min("seq").alias("i"))
    return C.greedy_keep(nodes, C.simhash_pairs(rows))


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5(concat('7:', doc_id)), 1, 13))::BIGINT / 4503599627370496.0 < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents")
def corpus_hash_split(spark, d):
    f = T.hash_fraction(F.lit("7"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", F.when(f < 0.1, "val").otherwise("train").alias("split"))


@query(f"SELECT seq, {SOURCE_SQL.format(c='source')} || ':' || substr(md5(coalesce(nullif(trim(id), ''), lower(to_hex(seq)) || ':' || md5(substr(text, 1, 4096)))), 1, 20) AS stable_id FROM corpus_docs")
def corpus_stable_ids(spark, d):
    own = F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.concat(F.lower(F.hex("seq")), F.lit(":"), F.md5(F.substring("text", 1, 4096))))
    return table(spark, d, "corpus_docs").select("seq", F.concat(T.source_name("source"), F.lit(":"), F.substring(F.md5(own), 1, 20)).alias("stable_id"))


@query(
    rf"""WITH RECURSIVE t AS (SELECT doc_id, text, {WORDS} AS total FROM documents WHERE text IS NOT NULL),
    par AS (SELECT doc_id, g, list_filter(regexp_split_to_array(trim(p, ' ' || chr(9) || chr(10) || chr(13)), '\s+'), lambda w: w <> '') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS g FROM t WHERE total > 500)),
    cut AS (SELECT doc_id, g, w, greatest(0, ceil((len(w) - 500) / 400))::INT AS cuts FROM par), run AS (SELECT doc_id, g, c, c < cuts AS alone, CASE WHEN c < cuts THEN w[c * 400 + 1:c * 400 + 400] ELSE w[c * 400 + 1:] END AS w FROM (SELECT *, unnest(range(cuts + 1)) AS c FROM cut)),
    unit AS (SELECT doc_id, alone, len(w) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY g, c) AS i FROM run WHERE len(w) > 0),
    walk AS (SELECT doc_id, 0::BIGINT AS i, 0 AS p, 0::BIGINT AS held, -1 AS piece, 0::BIGINT AS n FROM (SELECT DISTINCT doc_id FROM unit) UNION ALL
      SELECT u.doc_id, u.i, v.p + (v.held > 0 AND (u.alone OR v.held + u.n > 400))::INT + u.alone::INT, CASE WHEN u.alone THEN 0 WHEN v.held > 0 AND v.held + u.n > 400 THEN u.n ELSE v.held + u.n END, v.p + (v.held > 0 AND (u.alone OR v.held + u.n > 400))::INT, u.n FROM walk v JOIN unit u ON u.doc_id = v.doc_id AND u.i = v.i + 1),
    size AS (SELECT doc_id, piece, sum(n)::BIGINT AS n FROM walk WHERE piece >= 0 GROUP BY 1, 2), tail AS (SELECT *, max(piece) OVER (PARTITION BY doc_id) AS last FROM size),
    merged AS (SELECT doc_id, CASE WHEN last > 0 AND piece = last AND n < 50 THEN piece - 1 ELSE piece END AS piece, n FROM tail), whole AS (SELECT doc_id, piece, sum(n)::BIGINT AS n FROM merged GROUP BY 1, 2),
    fine AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY piece) AS part, count(*) OVER (PARTITION BY doc_id) AS parts, n FROM whole WHERE n BETWEEN 50 AND 500 UNION ALL SELECT doc_id, 1, 1, total FROM t WHERE total <= 500)
    SELECT doc_id, part, parts, CASE WHEN parts = 1 THEN doc_id::VARCHAR ELSE doc_id || '#part-' || part END AS part_id, n AS words FROM fine"""
)
def corpus_split_pieces(spark, d):
    x = K.split_long(texts(spark, d, "documents"), "doc_id", max_words=500, target=400)
    return x.select("doc_id", F.col("part").cast("bigint").alias("part"), F.col("parts").cast("bigint").alias("parts"), "part_id", T.words("piece").alias("words"))


_M = r"regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]+\)', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\[\d+(?:,\s*\d+)*\]', '', 'g')"
_MARKUP = rf"""regexp_replace(regexp_replace(regexp_replace(replace(translate({_M}, '‘’“”–—−' || chr(160) || chr(8203) || chr(8204) || chr(8205) || chr(65279), '''''""--- '), '…', '...'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '(?i)(?:https?://\S+|www\.\S+)', '', 'g'), '[ \t]+', ' ', 'g')"""


@query(f"SELECT doc_id, md5({_MARKUP}) AS stripped FROM documents")
def corpus_markup_strip(spark, d):
    return texts(spark, d, "documents").select("doc_id", F.md5(T.strip_markup("text")).alias("stripped"))


@query("SELECT doc_id, md5(reverse(text)) AS turned FROM documents")
def text_reverse(spark, d):
    return V.reversed_columns(table(spark, d, "documents"), ["text"]).select("doc_id", F.md5("text").alias("turned"))


# every seventh text is spoilt by one character, every eleventh row lacks its partner
@query("SELECT doc_id, unnest(CASE WHEN doc_id % 11 = 0 THEN ['missing'] ELSE ['roundtrip_text'] END) AS problem FROM documents WHERE doc_id % 11 = 0 OR doc_id % 7 = 0 UNION ALL SELECT -1, 'extra'")
def text_reverse_verify(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "domain")
    turned = V.reversed_columns(docs, ["text", "domain"]).where("doc_id % 11 <> 0")
    turned = turned.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    turned = turned.unionByName(spark.createDataFrame([(-1, "z", "z")], "doc_id bigint, text string, domain string"))
    return V.verify_pairs(docs, turned, "doc_id", ["text", "domain"])


# -- instruction pairs

CATEGORY_SQL = "CASE WHEN regexp_replace(lower(trim(category)), '_v[0-9]+$', '') IN (" + ", ".join(f"'{c}'" for c in I.CATEGORIES) + ") THEN regexp_replace(lower(trim(category)), '_v[0-9]+$', '') ELSE 'everyday' END"


@query(f"SELECT {CATEGORY_SQL} AS category, count(*) AS pairs FROM sft_pairs GROUP BY 1")
def sft_categories(spark, d):
    return table(spark, d, "sft_pairs").groupBy(I.category("category").alias("category")).agg(F.count("*").alias("pairs"))


_U, _A = "coalesce(user_msg, '')", "coalesce(assistant_msg, '')"
_N = n_of(_A, r"\S+")


_UW = f"regexp_extract_all({_A}, '[A-Za-z'']+')"
_SALAD = f"(len({_UW}) >= 25 AND len(list_filter({_UW}, lambda v: lower(v) IN ({sql_list(X.FUNCTION_WORDS)}))) / len({_UW}) < 0.10)"
_BLANK = f"regexp_matches({_U}, '^[ \t\n\r]*$') OR regexp_matches({_A}, '^[ \t\n\r]*$')"
_ODD = f"contains({_U}, chr(65533)) OR contains({_A}, chr(65533))"
# accented words in lower case, with what stands before them (RE2 has no look-behind)
_ACCENTED = rf"list_transform(regexp_extract_all(' ' || {_A}, '[^A-Za-z0-9_{X.ACCENTS}]([a-z{X.ACCENTS}''’]*[{X.ACCENTS}][a-z{X.ACCENTS}''’]*)', 1), lambda v: trim(lower(v), chr(39) || '’'))"
_FOREIGN = f"""(regexp_matches({_U}, '{_q(X.ASKS_TRANSLATION)}') OR regexp_matches({_A}, '{_q(X.GIVES_TRANSLATION)}') OR regexp_matches({_U} || ' ' || {_A}, '{_q(X.FOREIGN_PHRASES)}')
    OR regexp_matches({_U} || ' ' || {_A}, '{_q(X.QUOTED_ACCENT)}') OR len(list_filter({_ACCENTED}, lambda v: v NOT IN ({sql_list(X.LOAN_WORDS)}))) > 0)"""


@query(
    f"""SELECT seq, CASE WHEN {_BLANK} THEN 'empty' WHEN {_ODD} THEN 'mojibake' WHEN regexp_matches({_A}, '{_q(X.SELF_LEAK)}') THEN 'self_arch_leak' WHEN {_FOREIGN} THEN 'foreign_translation' WHEN regexp_matches({_U} || {_A}, '{X.NON_LATIN}') THEN 'non_english'
    WHEN regexp_matches({_U}, '{_q(X.TRANSLATE)}') THEN 'translation' WHEN regexp_matches({_A}, '[?]\\s*$') THEN 'follow_up' WHEN regexp_matches({_U} || chr(10) || {_A}, '{_q(X.FORBIDDEN)}') THEN 'forbidden' WHEN {_SALAD} THEN 'word_salad' WHEN {_N} < 4 OR {_N} > 200 THEN 'length' ELSE 'kept' END AS reason FROM sft_pairs"""
)
def sft_heuristic_reasons(spark, d):
    return texts(spark, d, "sft_pairs").select("seq", I.heuristic_reason().alias("reason"))


@query(
    f"""SELECT seq, CASE WHEN {_ODD} THEN 'mojibake' WHEN regexp_matches({_U}, '{_q(X.TRANSLATE)}') THEN 'translation' WHEN regexp_matches({_A}, '[?]\\s*$') THEN 'ends_with_question' WHEN {_SALAD} THEN 'low_function_word_ratio' ELSE 'judge' END AS reason FROM sft_pairs"""
)
def sft_judge_prefilter(spark, d):
    return texts(spark, d, "sft_pairs").select("seq", I.judge_prefilter().alias("reason"))


_GATE = f"CASE WHEN {_BLANK} THEN 'empty' WHEN regexp_matches({_U} || chr(10) || {_A}, '{_q(X.FORBIDDEN_MORE)}') THEN 'forbidden' WHEN regexp_matches({_U} || chr(10) || {_A}, '{X.NON_LATIN}') THEN 'non_english' ELSE 'parsed' END"


@query(f"SELECT {_GATE} AS gate, count(*) AS pairs FROM sft_pairs GROUP BY 1")
def sft_assembly_gates(spark, d):
    return texts(spark, d, "sft_pairs").groupBy(I.assembly_gate().alias("gate")).agg(F.count("*").alias("pairs"))


_KEY = "regexp_replace(lower(trim(coalesce(user_msg, ''))), '[ \\t\\n\\r]+', ' ', 'g')"


@query(
    f"""WITH ok AS (SELECT seq, {_KEY} AS k FROM sft_pairs WHERE {_GATE} = 'parsed' AND NOT regexp_matches({_U}, '{_q(X.TRANSLATE)}') AND NOT regexp_matches({_A}, '[?]\\s*$') AND {_N} BETWEEN 4 AND 200 AND seq % 3 <> 0)
    SELECT min(seq) AS seq FROM ok WHERE k NOT IN (SELECT {_KEY} FROM sft_pairs WHERE seq % 3 = 0) GROUP BY k"""
)
def sft_accepted_new(spark, d):
    """Two thirds of the pairs are taken for new ones, the rest for what is there already."""
    rows = texts(spark, d, "sft_pairs")
    return I.accepted_new(rows.where("seq % 3 <> 0"), rows.where("seq % 3 = 0")).select("seq")


@query("SELECT min(seq) AS seq FROM sft_pairs GROUP BY regexp_replace(lower(trim(coalesce(user_msg, ''))), '[ \\t\\n\\r]+', ' ', 'g')")
def sft_dedup(spark, d):
    return I.first_by_user(table(spark, d, "sft_pairs")).select("seq")


SFT_QUOTAS = [("identity", 40), ("everyday", 80), ("explanations", 80), ("troubleshooting", 60), ("rewrite", 40), ("comparisons", 40), ("unclear", 500), ("emotional", 20), ("safety", 20)]


@query(
    f"""WITH p AS (SELECT seq, {CATEGORY_SQL} AS category FROM sft_pairs), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(concat('11:', seq)), seq) AS rank FROM p)
    SELECT seq, r.category, rank FROM r JOIN (VALUES {", ".join(f"('{c}', {q})" for c, q in SFT_QUOTAS)}) q(category, quota) USING (category) WHERE rank <= quota"""
)
def sft_stratified(spark, d):
    rows = table(spark, d, "sft_pairs").select("seq", I.category("category").alias("category"))
    return I.stratified(rows, spark.createDataFrame(SFT_QUOTAS, "category string, quota int"), 11).select("seq", "category", F.col("rank").cast("bigint").alias("rank"))


@query(
    f"""WITH p AS (SELECT {CATEGORY_SQL} AS category, count(*) AS available FROM sft_pairs GROUP BY 1)
    SELECT q.category, coalesce(available, 0) AS available, quota::BIGINT AS quota, least(coalesce(available, 0), quota)::BIGINT AS taken, greatest(quota - coalesce(available, 0), 0)::BIGINT AS shortfall FROM (VALUES {", ".join(f"('{c}', {q})" for c, q in SFT_QUOTAS)}) q(category, quota) LEFT JOIN p USING (category)"""
)
def sft_quota_report(spark, d):
    have = table(spark, d, "sft_pairs").groupBy(I.category("category").alias("category")).agg(F.count("*").alias("available"))
    r = spark.createDataFrame(SFT_QUOTAS, "category string, quota bigint").join(F.broadcast(have), "category", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return r.select("category", "available", "quota", F.least("available", "quota").alias("taken"), F.greatest(F.col("quota") - F.col("available"), F.lit(0)).alias("shortfall"))


_SEQ = """WITH s AS (SELECT seq, ids[2:assistant_start - 2] AS u, (ids[assistant_start + 1:len(ids) - 1])[1:509] AS a FROM sft_sequences), t AS (SELECT seq, a, CASE WHEN len(u) <= 509 - len(a) THEN u WHEN 509 - len(a) <= 0 THEN [] ELSE u[len(u) - (509 - len(a)) + 1:] END AS u FROM s)"""


@query(f"{_SEQ} SELECT seq, len(u) + 3 AS assistant_start, len(u) + len(a) + 4 AS tokens, md5(array_to_string([1] || u || [2, 1] || a || [2], ' ')) AS ids FROM t")
def sft_sequence_build(spark, d):
    x = I.sequences(table(spark, d, "sft_sequences"), 512)
    return x.select("seq", F.col("assistant_start").cast("bigint").alias("assistant_start"), F.size("ids").cast("bigint").alias("tokens"), F.md5(F.array_join(F.transform("ids", lambda v: v.cast("string")), " ")).alias("ids"))


@query("SELECT seq, split, coalesce(sum(len(ids)) OVER (PARTITION BY split ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM sft_sequences")
def sft_offsets(spark, d):
    return I.running_offsets(table(spark, d, "sft_sequences").select("seq", "split", F.size("ids").alias("n")), size=F.col("n")).select("seq", "split", F.col("offset").cast("bigint").alias("offset"))


@query("SELECT seq, greatest(len(ids) - assistant_start, 0)::BIGINT AS supervised, list_sum(list_filter(list_transform(ids[2:], lambda x, i: CASE WHEN i - 1 < assistant_start - 1 THEN -100 ELSE x END), lambda x: x >= 0))::BIGINT AS total FROM sft_sequences")
def sft_label_mask(spark, d):
    m = table(spark, d, "sft_sequences").select("seq", I.label_mask().alias("m"))
    kept = F.filter("m", lambda x: x >= 0)
    return m.select("seq", F.size(kept).cast("bigint").alias("supervised"), F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT split, least(len(ids) // 128, 16)::BIGINT AS bucket, count(*) AS sequences, sum(len(ids))::BIGINT AS tokens, max(len(ids))::BIGINT AS longest FROM sft_sequences GROUP BY 1, 2")
def sft_length_buckets(spark, d):
    s = table(spark, d, "sft_sequences").select("split", F.size("ids").cast("bigint").alias("n"))
    return s.groupBy("split", F.least(F.floor(F.col("n") / 128), F.lit(16)).cast("bigint").alias("bucket")).agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.max("n").alias("longest"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS k FROM sft_pairs), l AS (SELECT k // 10 AS batch, k % 10 AS i, 'Q: ' || substr(replace(coalesce(user_msg, ''), chr(10), ' '), 1, 600) || ' A: ' || substr(replace(coalesce(assistant_msg, ''), chr(10), ' '), 1, 1200) AS line FROM r)
    SELECT batch, count(*) AS items, md5(string_agg(i || '. ' || line, chr(10) ORDER BY i)) AS prompt FROM l GROUP BY batch"""
)
def judge_batches(spark, d):
    return I.judge_prompts(table(spark, d, "sft_pairs")).withColumn("prompt", F.md5("prompt"))


_ANSWERS = [(0, 'Sure: [{"i": 0, "v": "KEEP"}, {"i": 1, "v": "drop"}] done'), (1, "no list here"), (2, '[{"i": 1, "v": "Keep"}]'), (3, '[{"i": 0, "v": ')]


@query(
    """WITH items AS (SELECT batch, i FROM range(4) b(batch), range(2) t(i)), said(batch, i, v) AS (VALUES (0, 0, 'keep'), (0, 1, 'drop'), (2, 1, 'keep'))
    SELECT batch, i, coalesce(v, 'drop') AS v FROM items LEFT JOIN said USING (batch, i)"""
)
def judge_verdict_join(spark, d):
    items = spark.range(4).select(F.col("id").alias("batch")).crossJoin(spark.range(2).select(F.col("id").cast("int").alias("i")))
    said = I.verdicts(spark.createDataFrame(_ANSWERS, "batch bigint, text string"))
    return I.apply_verdicts(items, said).select("batch", F.col("i").cast("bigint").alias("i"), "v")


# -- service


@query(f"SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (feedback AND mode = 'web') AS web_feedback, count(DISTINCT user_id) AS users FROM {ONCE}")
def overview_totals(spark, d):
    return S.overview(table(spark, d, "requests"))


@query(f"SELECT mode, lower(model) AS model, status, count(*) AS requests, round(avg(latency_ms), 4) AS mean_latency, round(quantile_cont(latency_ms, 0.95), 4) AS p95_latency FROM {ONCE} GROUP BY 1, 2, 3")
def overview_breakdown(spark, d):
    return S.deduplicated(table(spark, d, "requests")).groupBy("mode", F.lower("model").alias("model"), "status").agg(F.count("*").alias("requests"), F.round(F.avg("latency_ms"), 4).alias("mean_latency"), F.round(F.percentile("latency_ms", F.lit(0.95)), 4).alias("p95_latency"))


@query("SELECT k.status, count(r.id) AS n FROM (VALUES ('ok'), ('error'), ('rejected'), ('busy'), ('pending'), ('cancelled')) k(status) LEFT JOIN requests r ON r.status = k.status GROUP BY k.status")
def overview_zero_filled(spark, d):
    return S.zero_filled(table(spark, d, "requests").select("status"), ["ok", "error", "rejected", "busy", "pending", "cancelled"], "status")


@query(
    f"""WITH a AS (SELECT request_id, string_agg(variant || ':' || md5(output), ',' ORDER BY created_at, id) AS answers, (list(output ORDER BY created_at, id) FILTER (variant = 'A'))[1] AS picked FROM responses GROUP BY request_id)
    SELECT r.id, mode, lower(model) AS model, epoch_us(created_at) AS at, coalesce(answers, '') AS answers, md5(picked) AS selected FROM {ONCE} r LEFT JOIN a ON r.id = a.request_id WHERE status = 'ok'"""
)
def export_rows(spark, d):
    x = S.export(table(spark, d, "requests"), table(spark, d, "responses"))
    joined = F.array_join(F.transform("answers", lambda a: F.concat(a["variant"], F.lit(":"), F.md5(a["output"]))), ",")
    return x.select("id", "mode", "model", S.micros("created_at").alias("at"), joined.alias("answers"), F.md5("selected").alias("selected"))


@query(f"SELECT r.id, epoch_us(r.created_at) AS at, n.name AS node, EXISTS (SELECT 1 FROM responses s WHERE s.request_id = r.id AND s.variant = 'B') AS has_b FROM {ONCE} r LEFT JOIN nodes n ON n.id = r.node_id ORDER BY r.created_at DESC, r.id LIMIT 1000")
def recent_list(spark, d):
    r = S.deduplicated(table(spark, d, "requests")).orderBy(F.col("created_at").desc(), "id").limit(1000)
    r = r.select("id", "created_at", "node_id")
    # a thousand ids are broadcast, so responses aren't shuffled as a whole
    b = table(spark, d, "responses").where("variant = 'B'").select(F.col("request_id").alias("id")).join(F.broadcast(r.select("id")), "id", "left_semi").distinct().withColumn("b", F.lit(True))
    n = table(spark, d, "nodes").select(F.col("id").alias("node_id"), F.col("name").alias("node"))
    return r.join(F.broadcast(n), "node_id", "left").join(b, "id", "left").select("id", S.micros("created_at").alias("at"), "node", F.coalesce("b", F.lit(False)).alias("has_b"))


_NOW = "TIMESTAMPTZ '2026-02-01 00:00:00+00'"


def _now():
    return F.lit("2026-02-01 00:00:00+00").cast("timestamp")


@query(
    f"""WITH m AS (SELECT min(m.id) AS wanted FROM (SELECT unnest(models) AS m FROM nodes)), l AS (SELECT n.*, wanted FROM nodes n, m WHERE status = 'online' AND last_heartbeat > {_NOW} - INTERVAL 30 DAYS AND len(list_filter(models, lambda x: x.id = wanted OR x.family = wanted)) > 0)
    SELECT name, row_number() OVER (ORDER BY active_requests / greatest(throughput::DOUBLE, 1.0), throughput DESC NULLS LAST, name) AS place FROM l"""
)
def pick_node(spark, d):
    nodes = table(spark, d, "nodes").withColumn("throughput", F.col("throughput").cast("double"))
    wanted = nodes.select(F.explode("models").alias("m")).agg(F.min("m.id")).first()[0]
    best = S.pick_node(nodes, wanted, _now())
    order = Window.orderBy((F.col("active_requests") / F.greatest("throughput", F.lit(1.0))).asc(), F.col("throughput").desc_nulls_last(), "name")
    return best.select("name", F.row_number().over(order).cast("bigint").alias("place"))


@query("SELECT m.id AS id, max_by(m.kind, name) AS kind, count(*) AS nodes FROM (SELECT name, unnest(models) AS m FROM nodes WHERE status = 'online') WHERE NOT coalesce(m.alias, false) GROUP BY 1")
def available_models(spark, d):
    return S.available_models(table(spark, d, "nodes"))


@query(f"SELECT name, CASE WHEN status <> 'online' OR last_heartbeat < {_NOW} - INTERVAL 30 DAYS THEN 'offline' WHEN active_requests >= max_concurrency THEN 'busy' ELSE 'online' END AS state, (system::JSON ->> '$.cpu')::BIGINT AS cpu FROM nodes")
def node_states(spark, d):
    return table(spark, d, "nodes").select("name", S.node_state(_now()).alias("state"), F.get_json_object("system", "$.cpu").cast("bigint").alias("cpu"))


@query(
    f"""WITH r AS (SELECT user_id, count(*) AS requests, count(*) FILTER (feedback) AS asked FROM {ONCE} WHERE user_id IS NOT NULL GROUP BY 1)
    SELECT u.id, coalesce(requests, 0) AS requests, coalesce(asked, 0) AS asked, round(least(greatest(feedback_given / greatest(feedback_prompts, 1) + 0.25, 0.1), 1.5), 6) AS rating FROM users u LEFT JOIN r ON r.user_id = u.id"""
)
def user_rating(spark, d):
    r = S.deduplicated(table(spark, d, "requests")).where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if("feedback").alias("asked"))
    u = table(spark, d, "users").join(r.withColumnRenamed("user_id", "id"), "id", "left")
    return u.select("id", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("asked", F.lit(0)).alias("asked"), S.rating(F.col("feedback_given"), F.col("feedback_prompts")).alias("rating"))


@query(
    f"""SELECT id, round(least(greatest(coalesce(TRY_CAST(json_extract_string(params, '$.temperature') AS DOUBLE), 0.8), 0.05), 2.0), 6) AS temperature, least(greatest(coalesce(TRY_CAST(json_extract_string(params, '$.top_k') AS DOUBLE), 50.0), 1.0), 256.0)::INT AS top_k FROM {ONCE}"""
)
def request_params(spark, d):
    return S.deduplicated(table(spark, d, "requests")).select("id", *S.clamped_params("params"))


@query(f"SELECT json_valid(input) AS readable, CASE WHEN json_valid(input) THEN CASE WHEN input LIKE '{{\"story\"%' THEN 'story' WHEN input LIKE '{{\"prompt\"%' THEN 'prompt' ELSE 'other' END ELSE 'broken' END AS shape, count(*) AS n FROM {ONCE} WHERE input IS NOT NULL GROUP BY ALL")
def request_shapes(spark, d):
    r = S.deduplicated(table(spark, d, "requests")).where("input is not null")
    ok = F.try_parse_json("input").isNotNull()
    shape = F.when(~ok, "broken").when(F.startswith("input", F.lit('{"story"')), "story").when(F.startswith("input", F.lit('{"prompt"')), "prompt").otherwise("other")
    return r.groupBy(ok.alias("readable"), shape.alias("shape")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT id, count(*) OVER w1 AS in_minute, count(*) OVER w2 AS in_hour, count(*) OVER w3 AS in_day FROM (SELECT id, user_id, epoch_us(created_at) AS t FROM {ONCE} WHERE user_id IS NOT NULL)
    WINDOW w1 AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW), w3 AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)"""
)
def rate_window_all(spark, d):
    r = S.deduplicated(table(spark, d, "requests")).where("user_id is not null").select("id", "user_id", "created_at")
    return S.trailing_counts(r, "user_id", "created_at", {"in_minute": "minute", "in_hour": "hour", "in_day": "day"}).select("id", "in_minute", "in_hour", "in_day")


def _limited(calls: str) -> str:
    """Decisions of calls (k, t, i) in order: at most 1 accepted in a second, 2 in a minute, 3 in an hour and 4 in a day."""
    full = " OR ".join(f"len(list_filter(w.accepted, lambda a: a > c.t - {span})) >= {n}" for n, span in ((1, 1_000_000), (2, 60_000_000), (3, 3_600_000_000), (4, 86_400_000_000)))
    return f"""WITH RECURSIVE c AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t, i) AS n FROM ({calls})),
    w AS (SELECT k, 0::BIGINT AS n, []::BIGINT[] AS accepted, '' AS decision FROM (SELECT DISTINCT k FROM c) UNION ALL
      SELECT c.k, c.n, CASE WHEN {full} THEN w.accepted ELSE list_append(list_filter(w.accepted, lambda a: a > c.t - 86400000000), c.t) END, CASE WHEN {full} THEN 'rate' ELSE 'accept' END FROM w JOIN c ON c.k = w.k AND c.n = w.n + 1)
    SELECT decision, count(*) AS n FROM w WHERE n > 0 GROUP BY decision"""


_FEW = ST.Limits(1, 2, 3, 4)


@query(_limited(f"SELECT user_id AS k, epoch_us(created_at) AS t, id AS i FROM {ONCE} WHERE user_id IS NOT NULL"))
def rate_limiter_exact(spark, d):
    r = S.deduplicated(table(spark, d, "requests")).where("user_id is not null").select("id", "user_id", "created_at")
    return ST.limit_batch(r, "user_id", "created_at", "id", _FEW).groupBy("decision").agg(F.count("*").alias("n"))


@query(
    f"""WITH v AS (SELECT node_id, tokens::DOUBLE AS v, s.created_at, s.id FROM responses s JOIN {ONCE} r ON r.id = s.request_id WHERE tokens IS NOT NULL AND node_id IS NOT NULL),
    k AS (SELECT node_id, list(v ORDER BY created_at, id) AS vs FROM v GROUP BY node_id) SELECT node_id, round(list_reduce(vs, lambda a, x: 0.7 * a + 0.3 * x), 4) AS ema, len(vs) AS n FROM k"""
)
def throughput_ema(spark, d):
    r = S.deduplicated(table(spark, d, "requests")).where("node_id is not null").select(F.col("id").alias("request_id"), "node_id")
    return S.ema(table(spark, d, "responses").join(r, "request_id"), "node_id", "created_at", "tokens")


@query(
    f"""WITH r AS (SELECT node_id, epoch_us(created_at) AS t, row_number() OVER (PARTITION BY node_id ORDER BY created_at DESC, id DESC) AS k FROM {ONCE} WHERE node_id IS NOT NULL)
    SELECT node_id, count(*) AS n, round((count(*) - 1) / nullif((max(t) - min(t)) / 1000000, 0), 9) AS per_second FROM r WHERE k <= 400 GROUP BY node_id"""
)
def windowed_rate_400(spark, d):
    r = S.deduplicated(table(spark, d, "requests")).where("node_id is not null")
    return S.rate_of_last(r, "node_id", "created_at", 400, "id")


@query(
    f"""WITH e AS (SELECT node_id, epoch_us(created_at) AS t, 1 AS d FROM {ONCE} WHERE node_id IS NOT NULL AND latency_ms IS NOT NULL UNION ALL SELECT node_id, epoch_us(created_at) + latency_ms * 1000, -1 FROM {ONCE} WHERE node_id IS NOT NULL AND latency_ms IS NOT NULL),
    g AS (SELECT node_id, t, sum(d) AS d FROM e GROUP BY 1, 2), r AS (SELECT node_id, sum(d) OVER (PARTITION BY node_id ORDER BY t) AS active FROM g) SELECT node_id, max(active)::BIGINT AS most_active FROM r GROUP BY node_id"""
)
def active_gauge(spark, d):
    r = S.deduplicated(table(spark, d, "requests")).where("node_id is not null and latency_ms is not null")
    t = S.micros("created_at")
    e = r.select("node_id", F.explode(F.array(F.struct(t.alias("t"), F.lit(1).alias("d")), F.struct((t + F.col("latency_ms").cast("bigint") * 1000).alias("t"), F.lit(-1).alias("d")))).alias("e")).select("node_id", "e.*")
    return S.most_active(e, "node_id", "t", "d")


@query(
    f"""WITH o AS (SELECT id, status = 'ok' AND ('0x' || substr(md5(concat('3:', id)), 1, 13))::BIGINT / 4503599627370496.0 < 0.3 AS two FROM {ONCE}) SELECT id, unnest(CASE WHEN two THEN ['A', 'B'] ELSE ['A'] END) AS variant FROM o"""
)
def ab_variants(spark, d):
    r = S.deduplicated(table(spark, d, "requests")).select("id", ((F.col("status") == "ok") & (T.hash_fraction(F.lit("3"), F.col("id")) < 0.3)).alias("two"))
    return r.select("id", F.explode(F.when(F.col("two"), F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))).alias("variant"))


@query("SELECT event_id, event_type FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events) ORDER BY event_id LIMIT 500")
def event_cursor_read(spark, d):
    """A page of five hundred after a cursor in the middle."""
    e = table(spark, d, "events")
    cursor = e.agg(F.floor(F.max("event_id") / 2)).first()[0] or 0
    return e.where(F.col("event_id") > cursor).orderBy("event_id").limit(500).select("event_id", "event_type")


@query(
    """WITH e AS (SELECT user_id, event_id, event_type, event_type = 'purchase' AS reset FROM events), l AS (SELECT *, max(CASE WHEN reset THEN event_id END) OVER (PARTITION BY user_id) AS f FROM e)
    SELECT user_id, md5(string_agg(event_type, '' ORDER BY event_id)) AS text FROM l WHERE f IS NULL OR event_id >= f GROUP BY user_id"""
)
def delta_fold(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("id"), F.col("event_type").alias("delta"), (F.col("event_type") == "purchase").alias("reset"))
    return S.fold_deltas(e).select(F.col("job_id").alias("user_id"), F.md5("text").alias("text"))


@query(
    """WITH d AS (SELECT date_trunc('day', ts)::DATE AS day, round(avg(value), 6) AS v FROM events GROUP BY 1), b AS (SELECT *, min(v) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM d)
    SELECT day::VARCHAR AS day, v, best_before, coalesce(v < best_before, true) AS improved FROM b"""
)
def plateau_running_best(spark, d):
    # one row a day: the number of days is bounded by the calendar, not by the events
    days = table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    return S.running_best(days, "day", "v")


@query("SELECT user_id, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_per_group(spark, d):
    e = table(spark, d, "events").where("value is not null")
    half = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    return S.upsert_latest(e.where(half).select("user_id", "value", "event_id"), e.where(~half).select("user_id", "value", "event_id"), "user_id", "event_id")


@query("SELECT user_id, count(*) AS sessions, max(n)::BIGINT AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY user_id")
def idle_sessions(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT v.name FROM (VALUES ('001_a'), ('002_b'), ('003_c'), ('004_d')) v(name) WHERE v.name NOT IN ('001_a', '003_c')")
def migrations_pending(spark, d):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    return S.missing(one(["001_a", "002_b", "003_c", "004_d"]), one(["001_a", "003_c"]), "name")


# -- generated texts

@query("SELECT id, CASE WHEN raw_output IS NULL THEN 'absent' WHEN reverse(raw_output) = output THEN 'match' ELSE 'mismatch' END AS raw FROM responses")
def raw_output_verify(spark, d):
    return table(spark, d, "responses").select("id", F.when(F.col("raw_output").isNull(), "absent").when(F.reverse("raw_output") == F.col("output"), "match").otherwise("mismatch").alias("raw"))


# -- streams (each is run to its end over the table's files and read back)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_overview(spark, d):
    return ST.run_to_end(ST.stream_of(spark, f"{d}/events.parquet"), lambda s: s.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")), "complete")


@query(_limited("SELECT user_id AS k, epoch_us(ts) AS t, event_id AS i FROM events WHERE user_id IS NOT NULL"))
def stream_limiter(spark, d):
    return ST.limit_stream(spark, f"{d}/events.parquet", "user_id", "ts", "event_id", _FEW).groupBy("decision").agg(F.count("*").alias("n"))


# requests are delivered at least once, so this stream has repeats
@query("SELECT count(*) AS n, count(DISTINCT id) AS requests FROM (SELECT DISTINCT ON (id) id FROM requests)")
def stream_dedup(spark, d):
    """Repeats within 40 days of the newest row are dropped, and state of older rows is forgotten."""
    once = lambda s: s.select("id", "created_at").withWatermark("created_at", "40 days").dropDuplicatesWithinWatermark(["id"]).select("id")
    return ST.run_to_end(ST.stream_of(spark, f"{d}/requests.parquet"), once, "append").agg(F.count("*").alias("n"), F.countDistinct("id").alias("requests"))
