"""Reversible text transforms and the check of a transformed table against its source, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import fixed as X
from corvane.functions import text as T
from corvane.operators.ranges import running_total


def reversed_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: T.reverse_text(c) for c in columns})


def verify_pairs(source: DataFrame, turned: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, problem: rows that lack their partner, or whose columns don't come back when turned again."""
    a = source.select(key, *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(True).alias("in_a"))
    b = turned.select(key, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(True).alias("in_b"))
    both = a.join(b, key, "full_outer")
    checks = [F.when(F.col("in_a").isNull(), F.lit("extra")), F.when(F.col("in_b").isNull(), F.lit("missing"))]
    checks += [F.when(F.col("in_a") & F.col("in_b") & ~T.reverse_text(F.col(f"b_{c}")).eqNullSafe(F.col(f"a_{c}")), F.lit(f"roundtrip_{c}")) for c in columns]
    return both.select(key, F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def table_checksum(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a digest that doesn't depend on the order of rows, and their number."""
    return rows.agg(F.bit_xor(F.xxhash64(*columns)).alias("checksum"), F.count("*").alias("rows"))


def training_prompt(story: str = "story") -> Column:
    """The training prompt of a record with the story fields as columns: fields and story reversed between marks."""
    first, second, end = X.PROMPT_MARKS
    fields = F.concat_ws("\n", *(F.concat(F.lit(f"{f}: "), F.coalesce(f, F.lit(""))) for f in X.STORY_FIELDS))
    return F.concat(F.lit(first + "\n"), F.reverse(fields), F.lit("\n\n" + second + "\n"), F.reverse(story), F.lit("\n" + end))


def prompt_problems(prompt: Column, expected: Column) -> Column:
    """What is wrong with a training prompt: missing marks, other content."""
    checks = [F.when(~F.coalesce(prompt, F.lit("")).contains(m), F.lit(f"missing_{m[2:-2]}")) for m in X.PROMPT_MARKS]
    return F.array_compact(F.array(*checks, F.when(~prompt.eqNullSafe(expected), F.lit("content_mismatch"))))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with _line: their number in an order, from 0, by ranges of it."""
    return running_total(rows, [], order, F.lit(1), "_line")


def zip_lines(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """_line, a, b: the lines of two tables side by side; null where one is shorter."""
    left, right = (numbered(x, order).select("_line", F.col("line").alias(n)) for x, n in ((a, "a"), (b, "b")))
    return left.join(right, "_line", "full_outer")


def pair_problem(source: Column, turned: Column, fields: list[str], kept: list[str]) -> Column:
    """The first fault of a turned record (JSON text) against its source: other fields, a value that is no text, a kept field that
    changed, a field that doesn't come back when turned again. Null for none."""
    names = F.array(*map(F.lit, sorted(fields)))
    keys = lambda c: F.sort_array(F.json_object_keys(c))
    kind = lambda c, f: F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), f"$.{f}", "variant")), F.lit("VOID"))
    value = lambda c, f: F.get_json_object(c, f"$.{f}")
    out = F.when(source.isNull() | turned.isNull(), "missing_line").when(F.try_parse_json(source).isNull() | F.try_parse_json(turned).isNull(), "invalid_json")
    out = out.when(~keys(source).eqNullSafe(names) | ~keys(turned).eqNullSafe(names), "incorrect_fields")
    for f in fields:
        out = out.when((kind(source, f) != "STRING") | (kind(turned, f) != "STRING"), "non_string_value")
        if f in kept:
            out = out.when(value(source, f) != value(turned, f), f"changed_{f}")
        else:
            out = out.when(T.reverse_text(value(turned, f)) != value(source, f), f"roundtrip_{f}")
    return out
