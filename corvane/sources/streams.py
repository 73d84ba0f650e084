"""Sources and sinks that aren't tables: event text, model answers, model calls, files with digests, samples and reports."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T


# -- text streams


def ndjson_events(chunks: DataFrame, key: str, text: str, schema: str) -> DataFrame:
    """key, place, and the fields of each line of JSON in a text; lines that can't be read are left out."""
    lines = chunks.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("place", "line"))
    fine = F.try_parse_json("line").isNotNull() & F.btrim("line").startswith("{")
    return lines.where(fine).select(key, "place", F.from_json("line", schema).alias("e")).select(key, "place", "e.*")


def sse_frame(event: Column, data: Column) -> Column:
    """One event as text: its name and its data, each line of which is marked."""
    return F.concat(F.lit("event: "), event, F.lit("\n"), F.array_join(F.transform(F.split(data, "\n"), lambda x: F.concat(F.lit("data: "), x)), "\n"), F.lit("\n\n"))


def sse_events(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, event ('message' without a name), data: the events of a text; blocks without data are left out."""
    blocks = chunks.select(key, F.posexplode(F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n\n")).alias("place", "block"))
    lines = F.split("block", "\n")
    value = lambda x, name: F.regexp_replace(x, f"^{name}: ?", "")
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: value(x, "data"))
    name = F.element_at(F.concat(F.array(F.lit("message")), F.transform(F.filter(lines, lambda x: x.startswith("event:")), lambda x: value(x, "event"))), -1)
    return blocks.select(key, "place", name.alias("event"), F.array_join(data, "\n").alias("data"), F.size(data).alias("n")).where("n > 0").drop("n")


def answer_rows(answers: DataFrame, key: str, text: str, schema: str) -> DataFrame:
    """The records in a model's answer: lines that begin with a brace, a comma after them aside; what can't be read is left out."""
    lines = answers.select(key, F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("place", "line"))
    lines = lines.withColumn("line", F.regexp_replace(F.btrim("line", F.lit(" \t")), ",+$", ""))
    return lines.where(F.col("line").startswith("{") & F.try_parse_json("line").isNotNull()).select(key, "place", F.from_json("line", schema).alias("r")).select(key, "place", "r.*")


# -- model calls


class CallError(Exception):
    """A call that failed: kind is rate, server, connection, auth or client; the first three are worth another try."""

    def __init__(self, kind: str) -> None:
        super().__init__(kind)
        self.kind = kind


RETRIED = ("rate", "server", "connection")


def backoff(attempt: int, first: float = 1.0, most: float = 60.0) -> float:
    """Seconds to wait after a failed attempt (0, 1, ...)."""
    return min(most, first * 2**attempt)


def call_model(rows: DataFrame, key: str, prompt: str, call: Callable[[str], tuple[str, int]], attempts: int = 4, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """key, text, tokens, tries, error: the answers of a model to a column of prompts, asked from the executors. call gives text and tokens or
    raises a CallError; errors that pass are tried again after a growing wait. A failed row has its error and no text."""
    kind = rows.schema[key].dataType.simpleString()

    def ask(p: str) -> tuple[str | None, int, int, str | None]:
        for n in range(attempts):
            try:
                text, tokens = call(p)
                return text, tokens, n + 1, None
            except CallError as e:
                if e.kind not in RETRIED or n + 1 == attempts:
                    return None, 0, n + 1, e.kind
                wait(backoff(n))
        return None, 0, attempts, "none"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [ask(p) for p in b["p"]]
            yield pd.DataFrame({"k": b["k"], "text": [g[0] for g in got], "tokens": [g[1] for g in got], "tries": [g[2] for g in got], "error": [g[3] for g in got]})

    return rows.select(F.col(key).alias("k"), F.col(prompt).alias("p")).mapInPandas(run, f"k {kind}, text string, tokens bigint, tries int, error string").withColumnRenamed("k", key)


# -- files


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, bytes, sha256 of the files under a folder (each is read whole, up to 2 GB)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def digest_problems(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """name, problem: files of a manifest (name, bytes, sha256) that are missing, of another size or content, and files that it doesn't list."""
    h = have.select("name", F.col("bytes").alias("b"), F.col("sha256").alias("s"), F.lit(True).alias("there"))
    x = wanted.withColumn("listed", F.lit(True)).join(h, "name", "full_outer")
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("bytes") != F.col("b"), "size").when(F.col("sha256") != F.col("s"), "content")
    return x.select("name", problem.alias("problem")).where("problem is not null")


def multipart_tag(parts: list[bytes]) -> str:
    """The tag of an object that was sent in parts, from the MD5 digests of these."""
    import hashlib

    return f"{hashlib.md5(b''.join(parts)).hexdigest()}-{len(parts)}"


def write_with_rejects(rows: DataFrame, path: str, reason: str, accepted: str) -> None:
    """Accepted rows under kept/, the others with their reason under rejected/ by reason; rows are computed once."""
    from corvane.sources.shared import discard, materialize

    once = materialize(rows, "judged")
    once.where(F.col(reason) == accepted).drop(reason).write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/kept")
    once.where(F.coalesce(F.col(reason), F.lit("")) != accepted).write.mode("errorifexists").partitionBy(reason).option("ignoreNullFields", "false").json(f"{path}/rejected")
    discard(once)


def settings(defaults: dict[str, object], *layers: dict[str, object] | None) -> dict[str, object]:
    """Settings by name: later layers go before earlier ones, except where they say nothing (None); names that aren't known are left out."""
    out = dict(defaults)
    for layer in layers:
        out.update({k: v for k, v in (layer or {}).items() if k in out and v is not None})
    return out


def environment_lines(c: Column) -> Column:
    """A map of the KEY=VALUE lines of a text: comments, blanks, `export` and quotes around values aside; the first of equal keys holds."""
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: F.regexp_replace(F.btrim(x, F.lit(" \t")), r"^export\s+", "")), lambda x: x.rlike(r"^[^#=]+="))
    pairs = F.transform(lines, lambda x: F.struct(F.btrim(F.substring_index(x, "=", 1)).alias("k"), F.regexp_replace(F.btrim(F.substring(x, F.instr(x, "=") + 1, F.length(x))), r"^(['\"])(.*)\1$", "$2").alias("v")))
    first = F.filter(pairs, lambda p: F.element_at(F.filter(pairs, lambda q: q["k"] == p["k"]), 1)["v"].eqNullSafe(p["v"]))
    return F.map_from_entries(F.array_distinct(first))


def index_lookup(spark: SparkSession, path: str, key: str, values: list) -> DataFrame:
    """Rows of a stored index with some keys: the filter reaches the scan, so only files that may hold them are read."""
    return spark.read.parquet(path).where(F.col(key).isin(values))


# -- samples and reports


def sample_lines(rows: DataFrame, text: str, n: int, order: str, width: int = 240) -> DataFrame:
    """place, line: the first n rows' texts, cut to width for the eye, with line ends shown."""
    first = rows.orderBy(order).limit(n)
    shown = F.substring(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), F.lit("⏎")), 1, width)
    return first.select(F.col(order).alias("place"), shown.alias("line"))


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """place, line: a small table (a report: its rows are those of an aggregate) as lines of Markdown, in an order."""
    from pyspark.sql import Window

    spark = rows.sparkSession
    head = spark.createDataFrame([(-2, "| " + " | ".join(columns) + " |"), (-1, "|" + " --- |" * len(columns))], "place bigint, line string")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    return head.unionAll(rows.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint").alias("place"), line.alias("line")))
