"""Queries on sources and sinks: tables are written in a text form to the shared folder and read back, or parsed from text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.functions import fixed as X
from corvane.functions import text as T
from corvane.operators import instruction as I
from corvane.operators import service as S
from corvane.plans.registry import ONCE, SOURCE_SQL, n_of, query, quoted, sql_list, table
from corvane.sources import jsonl
from corvane.sources import streams as N
from corvane.sources.shared import shared_dir


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT count(*) AS records, sum({n_of('text', r'\S+')})::BIGINT AS words, bit_xor(('0x' || substr(md5(doc_id || ':' || text), 1, 15))::BIGINT) AS texts FROM documents WHERE text IS NOT NULL")
def jsonl_text_scan(spark, d):
    """Documents written as lines of JSON and two fields of them read back; lines without a text don't count. The digest doesn't depend on the order."""
    at = _folder(spark, "lines")
    jsonl.write(table(spark, d, "documents").select("doc_id", "source", "text"), at)
    text = jsonl.lines(spark, at).select(F.get_json_object("value", "$.doc_id").alias("k"), F.get_json_object("value", "$.text").alias("t")).where("t is not null")
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", "k", "t")), 1, 15), 16, 10).cast("bigint")
    return text.agg(F.count("*").alias("records"), F.sum(T.words("t")).alias("words"), F.bit_xor(digest).alias("texts"))


@query(f"SELECT CASE WHEN NOT json_valid(input) THEN 'invalid_json' WHEN json_type(input) <> 'OBJECT' THEN 'non_object' WHEN json_keys(input) <> ['prompt'] THEN 'invalid_schema' WHEN json_type(input, '$.prompt') <> 'VARCHAR' THEN 'invalid_types' ELSE 'record' END AS problem, count(*) AS n FROM (SELECT input FROM {ONCE} WHERE input IS NOT NULL UNION ALL SELECT unnest(['[1]', '\"x\"', '{{\"prompt\": 5}}', '{{\"prompt\": \"a\", \"b\": 1}}'])) GROUP BY 1")
def jsonl_schema_gate(spark, d):
    """Inputs of requests as lines that should be records of one text field; a few others beside them."""
    odd = spark.createDataFrame([("[1]",), ('"x"',), ('{"prompt": 5}',), ('{"prompt": "a", "b": 1}',)], "input string")
    rows = S.deduplicated(table(spark, d, "requests")).where("input is not null").select("input").unionAll(odd)
    return rows.groupBy(F.coalesce(jsonl.problem(["prompt"], value="input"), F.lit("record")).alias("problem")).agg(F.count("*").alias("n"))


@query(f"SELECT {SOURCE_SQL.format(c='source')} AS source, count(*) AS n FROM documents GROUP BY 1")
def jsonl_tolerant_counts(spark, d):
    """Written lines with a torn one and noise among them: counts of what can be read."""
    at = _folder(spark, "torn")
    jsonl.write(table(spark, d, "documents").select(T.source_name("source").alias("source"), "doc_id"), at)
    spark.createDataFrame([('{"source": "wikip',), ("noise",), ("",)], "value string").write.mode("append").text(at)
    return jsonl.read_tolerant(spark, at, "source string, doc_id bigint").groupBy("source").agg(F.count("*").alias("n"))


_CAT = "CASE WHEN regexp_replace(lower(trim(category)), '_v[0-9]+$', '') IN (" + sql_list(I.CATEGORIES) + ") THEN regexp_replace(lower(trim(category)), '_v[0-9]+$', '') ELSE 'everyday' END"


@query(f"SELECT {_CAT} AS category, count(*) AS n FROM sft_pairs GROUP BY 1")
def jsonl_category_files(spark, d):
    """Pairs written to a folder for each category and read back with the category that the path names."""
    at = _folder(spark, "chunks")
    rows = table(spark, d, "sft_pairs").select(F.concat(F.lit("chunk_"), I.category("category")).alias("part"), "user_msg", "assistant_msg")
    jsonl.write(rows, at, by=["part"])
    back = spark.read.text(at).select("value", F.col("_metadata.file_path").alias("file"))
    name = F.element_at(F.split("file", "/"), -2)
    return back.groupBy(jsonl.category_of_file(name, X.CATEGORY_PARTS, "everyday").alias("category")).agg(F.count("*").alias("n"))


_NAMES = ["identity_01.jsonl", "troubleshoot-a.jsonl", "explain_identity.jsonl", "Comparison.jsonl", "misc.jsonl", "rewrite_safety.jsonl", "explanations.jsonl"]


@query("SELECT * FROM (VALUES ('identity_01.jsonl', 'identity'), ('troubleshoot-a.jsonl', 'troubleshooting'), ('explain_identity.jsonl', 'identity'), ('Comparison.jsonl', 'comparisons'), ('misc.jsonl', 'everyday'), ('rewrite_safety.jsonl', 'safety'), ('explanations.jsonl', 'explanations')) v(name, category)")
def file_categories(spark, d):
    return spark.createDataFrame([(n,) for n in _NAMES], "name string").select("name", jsonl.category_of_file("name", X.CATEGORY_PARTS, "everyday").alias("category"))


@query(f"SELECT {SOURCE_SQL.format(c='source')} AS source, doc_id AS id, md5(text) AS text FROM documents UNION ALL SELECT 'stackexchange', item_id, md5(benchmark || chr(10) || prompt || chr(10) || chr(10) || answer) FROM eval_items")
def source_text(spark, d):
    """The text of a row by its source: questions with their answers, else what is called text or content."""
    docs = table(spark, d, "documents").select(T.source_name("source").alias("source"), F.col("doc_id").alias("id"), "text", *(F.lit(None).cast("string").alias(c) for c in ("title", "body", "answer")))
    asked = table(spark, d, "eval_items").select(F.lit("stackexchange").alias("source"), F.col("item_id").alias("id"), F.lit(None).cast("string").alias("text"), F.col("benchmark").alias("title"), F.col("prompt").alias("body"), "answer")
    both = docs.unionAll(asked)
    question = F.concat_ws("\n\n", F.concat_ws("\n", "title", "body"), "answer")
    return both.select("source", "id", F.md5(F.coalesce("text", question)).alias("text"))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents)")
def parquet_list_scan(spark, d):
    """Several files in one scan."""
    return spark.read.parquet(f"{d}/documents.parquet", f"{d}/documents.parquet").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


@query("SELECT user_id, event_id, event_type, value FROM events WHERE event_id % 5 <> 0")
def ndjson_decode(spark, d):
    """Each user's events as one text of JSON lines, every fifth of them torn, decoded again."""
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 5 == 0, F.lit('{"event_id": 1')).otherwise(F.to_json(F.struct("event_id", "event_type", "value")))
    chunks = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    return N.ndjson_events(chunks, "user_id", "t", "event_id bigint, event_type string, value double").drop("place")


@query("SELECT id AS request, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS place, event, md5(data) AS data FROM (SELECT s.id, 0 AS k, 'output' AS event, replace(output, '. ', '.' || chr(10)) AS data FROM responses s WHERE output IS NOT NULL UNION ALL SELECT id, 1, 'done', tokens::VARCHAR FROM responses WHERE output IS NOT NULL AND tokens IS NOT NULL)")
def sse_roundtrip(spark, d):
    """Answers framed as server-sent events (of several lines) and decoded again."""
    r = table(spark, d, "responses").where("output is not null")
    done = F.when(F.col("tokens").isNotNull(), N.sse_frame(F.lit("done"), F.col("tokens").cast("string"))).otherwise(": nothing\n\n")
    x = r.select(F.col("id").alias("request"), F.concat(N.sse_frame(F.lit("output"), F.replace("output", F.lit(". "), F.lit(".\n"))), done).alias("t"))
    return N.sse_events(x, "request", "t").select("request", F.col("place").cast("bigint").alias("place"), "event", F.md5("data").alias("data"))


_ANSWERS = [(1, 'Here:\n{"user": "a", "assistant": "b"},\n  {"user": "c", "assistant": "d"}\n{"user": "torn'), (2, "none"), (3, '[\n{"user": "e"},,\n]'), (4, None)]


@query("SELECT * FROM (VALUES (1, 1, 'a', 'b'), (1, 2, 'c', 'd'), (3, 1, 'e', NULL)) v(n, place, \"user\", assistant)")
def answer_rows(spark, d):
    x = spark.createDataFrame(_ANSWERS, "n int, text string")
    return N.answer_rows(x, "n", "text", "user string, assistant string")


@query("SELECT seq, CASE WHEN seq % 10 = 0 THEN NULL ELSE reverse(user_msg) END AS text, CASE WHEN seq % 10 = 0 THEN 4 WHEN seq % 10 = 1 THEN 3 WHEN seq % 10 = 2 THEN 1 ELSE 1 END AS tries, CASE WHEN seq % 10 = 0 THEN 'rate' WHEN seq % 10 = 2 THEN 'auth' END AS error FROM sft_pairs WHERE user_msg IS NOT NULL AND seq % 10 <> 2 UNION ALL SELECT seq, NULL, 1, 'auth' FROM sft_pairs WHERE user_msg IS NOT NULL AND seq % 10 = 2")
def model_calls(spark, d):
    """Prompts sent to a stand-in for a model: some fail for good, some at first, some with an error that isn't tried again."""
    state: dict[str, int] = {}

    def call(p: str) -> tuple[str, int]:
        n, prompt = p.split(":", 1)
        k = int(n) % 10
        state[p] = state.get(p, 0) + 1
        if k == 0 or k == 1 and state[p] < 3:
            raise N.CallError("rate")
        if k == 2:
            raise N.CallError("auth")
        return prompt[::-1], len(prompt.split())

    rows = table(spark, d, "sft_pairs").where("user_msg is not null").select("seq", F.concat(F.col("seq").cast("string"), F.lit(":"), "user_msg").alias("p"))
    return N.call_model(rows, "seq", "p", call, wait=lambda s: None).select("seq", "text", "tries", "error")


@query("SELECT mode, count(*) AS n FROM (SELECT DISTINCT ON (id) * FROM requests) WHERE status = 'ok' AND latency_ms >= 1000 GROUP BY 1")
def sql_parameters(spark, d):
    """A statement with named parameters over a table."""
    r = S.deduplicated(table(spark, d, "requests"))
    return spark.sql("SELECT mode, count(*) AS n FROM {r} WHERE status = :status AND latency_ms >= :least GROUP BY mode", args={"status": "ok", "least": 1000}, r=r)


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (5, 50, 500)")
def index_lookup(spark, d):
    """Point lookups in a stored index."""
    at = _folder(spark, "index")
    table(spark, d, "documents").select("doc_id", "source").sortWithinPartitions("doc_id").write.parquet(at)
    return N.index_lookup(spark, at, "doc_id", [5, 50, 500])


@query("SELECT name || '.txt' AS name, strlen(name || ' ' || id || chr(10)) AS bytes, sha256(name || ' ' || id || chr(10)) AS sha256 FROM nodes")
def file_manifest(spark, d):
    """A file for each node and the digests of the files."""
    at = _folder(spark, "files")
    table(spark, d, "nodes").select("name", F.concat("name", F.lit(" "), "id").alias("value")).write.partitionBy("name").text(at)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(at)
    return files.select(F.concat(F.regexp_extract("path", "name=([^/]+)", 1), F.lit(".txt")).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query("SELECT * FROM (VALUES ('node-00.txt', 'missing'), ('node-01.txt', 'size'), ('node-02.txt', 'content'), ('extra.txt', 'unlisted')) v(name, problem)")
def manifest_gate(spark, d):
    """The manifest of the files above against what is there: one file lost, one longer, one changed, one too many."""
    have = file_manifest(spark, d)
    want = have
    name = F.col("name")
    spoilt = have.where(name != "node-00.txt").withColumn("bytes", F.when(name == "node-01.txt", F.col("bytes") + 1).otherwise(F.col("bytes"))).withColumn("sha256", F.when(name.isin("node-01.txt", "node-02.txt"), F.lit("0")).otherwise(F.col("sha256")))
    spoilt = spoilt.unionAll(spark.createDataFrame([("extra.txt", 1, "0")], "name string, bytes bigint, sha256 string"))
    return N.digest_problems(want, spoilt)


_GATE = f"CASE WHEN regexp_matches(coalesce(user_msg, ''), '^[ \t\n\r]*$') OR regexp_matches(coalesce(assistant_msg, ''), '^[ \t\n\r]*$') THEN 'empty' WHEN regexp_matches(coalesce(user_msg, '') || chr(10) || coalesce(assistant_msg, ''), '{quoted(X.FORBIDDEN_MORE)}') THEN 'forbidden' WHEN regexp_matches(coalesce(user_msg, '') || chr(10) || coalesce(assistant_msg, ''), '{X.NON_LATIN}') THEN 'non_english' ELSE 'parsed' END"


@query(f"SELECT {_GATE} AS reason, count(*) AS n, sum(seq)::BIGINT AS seqs FROM sft_pairs GROUP BY 1")
def reject_side_output(spark, d):
    """Pairs written with the rejected ones beside, by reason, and both read back."""
    at = _folder(spark, "gated")
    N.write_with_rejects(table(spark, d, "sft_pairs").select("seq", "user_msg", "assistant_msg", I.assembly_gate().alias("reason")), at, "reason", "parsed")
    kept = spark.read.schema("seq bigint").json(f"{at}/kept").select(F.lit("parsed").alias("reason"), "seq")
    lost = spark.read.schema("seq bigint, reason string").json(f"{at}/rejected").select("reason", "seq")
    return kept.unionAll(lost).groupBy("reason").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query("SELECT split, seq, len(ids)::BIGINT AS tokens, md5(array_to_string(ids, ' ')) AS ids FROM sft_sequences")
def ragged_roundtrip(spark, d):
    """Token sequences as one flat run of tokens and their offsets, and cut again by these."""
    s = I.running_offsets(table(spark, d, "sft_sequences").select("split", "seq", "ids"))
    flat = s.select("split", F.posexplode("ids").alias("i", "token"), "offset").select("split", (F.col("offset") + F.col("i")).alias("at"), "token")
    index = s.select("split", "seq", F.col("offset").alias("start"), F.size("ids").cast("bigint").alias("tokens"))
    # a token finds its sequence by the offset that it came with, as a reader of the flat file would by searching the offsets
    cut = s.select("split", F.col("offset").alias("start"), F.explode(F.sequence(F.lit(0), F.size("ids") - 1)).alias("i")).select("split", "start", (F.col("start") + F.col("i")).alias("at"))
    rows = cut.join(flat, ["split", "at"]).groupBy("split", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"].cast("string")).alias("t"))
    return index.where("tokens > 0").join(rows, ["split", "start"]).select("split", "seq", "tokens", F.md5(F.array_join("t", " ")).alias("ids"))


@query("SELECT doc_id AS place, substr(replace(coalesce(text, ''), chr(10), '⏎'), 1, 240) AS line FROM documents ORDER BY doc_id LIMIT 10")
def sample_dump(spark, d):
    return N.sample_lines(table(spark, d, "documents"), "text", 10, "doc_id")


@query(
    f"""WITH s AS (SELECT {SOURCE_SQL.format(c='source')} AS source, count(*) AS documents, format('{{:,}}', sum(strlen(text))::BIGINT) AS bytes FROM documents GROUP BY 1)
    SELECT -2 AS place, '| source | documents | bytes |' AS line UNION ALL SELECT -1, '| --- | --- | --- |' UNION ALL SELECT row_number() OVER (ORDER BY source) - 1, '| ' || source || ' | ' || documents || ' | ' || bytes || ' |' FROM s"""
)
def corpus_report(spark, d):
    s = table(spark, d, "documents").groupBy(T.source_name("source").alias("source")).agg(F.count("*").alias("documents"), F.format_number(F.sum(F.octet_length("text")), 0).alias("bytes"))
    return N.markdown_table(s, ["source", "documents", "bytes"], ["source"])


@query("SELECT * FROM (VALUES ('A', '1'), ('B', 'two words'), ('C', 'x=y'), ('D', '')) v(key, value)")
def environment_file(spark, d):
    text = "# note\nA=1\nexport B=\"two words\"\n\nC='x=y'\nA=2\nD=\nnonsense\n"
    x = spark.createDataFrame([(text,)], "t string").select(F.explode(F.map_entries(N.environment_lines(F.col("t")))).alias("e"))
    return x.select("e.key", "e.value")


@query("SELECT * FROM (VALUES ('batch', '64'), ('rate', '0.1'), ('workers', '4')) v(name, value)")
def settings_merge(spark, d):
    got = N.settings({"batch": 32, "rate": 0.1, "workers": 1}, {"batch": 64, "unknown": 1}, {"workers": 4, "rate": None}, None)
    return spark.createDataFrame([(k, str(v)) for k, v in got.items()], "name string, value string")


@query("SELECT mode, lower(status) AS status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY mode), 1) AS pct FROM (SELECT DISTINCT ON (id) * FROM requests) GROUP BY 1, 2")
def reason_tallies(spark, d):
    from pyspark.sql import Window

    n = S.deduplicated(table(spark, d, "requests")).groupBy("mode", F.lower("status").alias("status")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("mode")), 1))
