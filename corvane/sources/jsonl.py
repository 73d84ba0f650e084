"""Lines of JSON: strict and tolerant reading, and compact writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, file: the lines that aren't blank, with the name of their file."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(~F.col("value").rlike(r"^\s*$"))


def problem(fields: list[str], allowed: dict[str, list[str]] | None = None, value: str = "value") -> Column:
    """The first fault of a line against a record of exactly these string fields; null for none."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    one = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    keys = F.sort_array(F.json_object_keys(value))
    wrong = [F.coalesce(one(f), F.lit("VOID")) != "STRING" for f in fields]
    out = F.when(v.isNull(), "invalid_json").when(~F.startswith(kind, F.lit("OBJECT")), "non_object")
    out = out.when(keys != F.array(*map(F.lit, sorted(fields))), "invalid_schema")
    bad = wrong[0]
    for w in wrong[1:]:
        bad = bad | w
    out = out.when(bad, "invalid_types")
    for f, values in (allowed or {}).items():
        out = out.when(~F.get_json_object(value, f"$.{f}").isin(values), f"unknown_{f}")
    return out


def read_strict(spark: SparkSession, path: str | list[str], fields: list[str], allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """The fields of every line and its problem (null where it is a record as wanted)."""
    x = lines(spark, path)
    return x.select("file", *(F.get_json_object("value", f"$.{f}").alias(f) for f in fields), problem(fields, allowed).alias("problem"))


def read_tolerant(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Records of the lines that can be read; others, such as a torn last line, are left out."""
    x = lines(spark, path).select(F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNotNull().alias("fine"))
    return x.where("fine and r is not null").select("r.*")


def write(rows: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """One compact object a line, nulls kept; by: columns that name subfolders."""
    w = rows.write.mode(mode).option("ignoreNullFields", "false")
    (w.partitionBy(*by) if by else w).json(path)


def encoded_size(columns: list[str]) -> Column:
    """Bytes of a row as a line."""
    return (F.octet_length(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})) + 1).cast("bigint")


def category_of_file(file: Column | str, patterns: list[tuple[str, str]], other: str) -> Column:
    """The category of the first pattern that a file's name contains."""
    name = F.lower(F.col(file) if isinstance(file, str) else file)
    out = F.when(F.lit(False), other)
    for part, category in patterns:
        out = out.when(F.contains(name, F.lit(part)), category)
    return out.otherwise(other)
