"""Tokens of each source, language and domain: every distinct text is tokenized once and counted as often as it occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bpe import Tokenizer
from corvane.llm.common import clean_domain, clean_lang, clean_source, map_rows


def token_counts(texts: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """The other columns of texts and tokens, the number of tokens of the whole text (0 for null and '')."""
    shared = texts.sparkSession.sparkContext.broadcast(tokenizer)
    rest = [f for f in texts.schema.fields if f.name != text]
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rest), "tokens bigint"])

    def count(c: dict[str, list]) -> dict[str, list]:
        t = shared.value
        return {**{f: c[f] for f in c if f != text}, "tokens": [t.count(x) for x in c[text]]}

    return map_rows(texts.select(*(f.name for f in rest), text), count, ddl, text)


def token_budget(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", source: str = "source", lang: str = "lang", domain: str = "domain") -> DataFrame:
    """level ('cell', 'source', 'lang' or 'domain'), source, lang, domain, documents, tokens.

    A cell is one cleaned source, language and domain; the other levels are totals and have null in the columns they
    sum over. Unknown values are 'unknown'. Repeated rows count each time. A null or empty text is a document of no tokens.
    No rows give no rows.
    """
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), clean_source(source).alias("source"), F.coalesce(clean_lang(lang), F.lit("unknown")).alias("lang"), clean_domain(domain).alias("domain"))
    rows = rows.select(F.unhex(F.md5("text")).alias("digest"), "*")
    # Copies are counted before any shuffle, and a text that occurs often leaves each partition once.
    cells = rows.groupBy("digest", "source", "lang", "domain").agg(F.count("*").alias("n"))
    sizes = token_counts(rows.select("digest", "text").dropDuplicates(["digest"]), tokenizer)
    # MapInArrow hides that sizes is as large as its input, so it isn't left to Spark to guess.
    joined = cells.join(sizes.hint("shuffle_hash"), "digest")
    summed = joined.groupBy("source", "lang", "domain").agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("tokens")).alias("tokens"))
    spark = docs.sparkSession
    return spark.sql(
        """
        SELECT CASE grouping_id(source, lang, domain) WHEN 0 THEN 'cell' WHEN 3 THEN 'source' WHEN 5 THEN 'lang' ELSE 'domain' END AS level,
               source, lang, domain, sum(documents) AS documents, sum(tokens) AS tokens
        FROM {summed} GROUP BY source, lang, domain GROUPING SETS ((source, lang, domain), (source), (lang), (domain))
        """,
        summed=summed,
    )
