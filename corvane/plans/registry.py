"""The catalogue's registry, and pieces of SQL that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.functions import fixed as X
from corvane.sources.shared import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table for work that is heavy for each row."""
    return spread(table(spark, d, name))


def quoted(s: str) -> str:
    return s.replace("'", "''")


def sql_list(values) -> str:
    return ", ".join(f"'{quoted(v)}'" for v in values)


def n_of(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{quoted(pattern)}'))"


def words_of(c: str, words: list[str]) -> str:
    return f"len(list_filter(regexp_extract_all(lower({c}), '[a-z]+'), lambda x: x IN ({sql_list(words)})))"


SOURCE_SQL = "CASE lower(regexp_replace({c}, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')) " + " ".join(f"WHEN '{a}' THEN '{n}'" for a, n in [*X.SOURCE_NAMES.items(), *((n, n) for n in X.SOURCES)]) + " ELSE 'unknown' END"
ONCE = "(SELECT DISTINCT ON (id) * FROM requests)"
