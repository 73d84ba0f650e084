"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.fixed import SOURCE_NAMES as SOURCE_ALIASES
from corvane.sources.shared import discard, materialize, shared_dir, spread  # noqa: F401

#: Characters of text that one Python step handles at a time, so that a batch of long texts stays small in memory.
CHUNK_CHARS = 3_000_000

# Language codes with their three-letter codes and English names.
LANGUAGES = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"),
    "it": ("ita", "italian"),
    "pt": ("por", "portuguese"),
    "nl": ("nld", "dut", "dutch"),
    "ru": ("rus", "russian"),
}
LANG_SPELLINGS = {s: code for code, names in LANGUAGES.items() for s in (code, *names)}


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a list of `name type`, also usable in an executor; a type may be an array."""

    def kind(t: str) -> pa.DataType:
        return pa.list_(kind(t[6:-1])) if t.startswith("array<") else _ARROW[t]

    return pa.schema([(name, kind(t)) for name, t in (x.strip().split(" ", 1) for x in ddl.split(","))])


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], ddl: str, text: str | None = None) -> DataFrame:
    """mapInArrow with columns as Python lists. A batch is cut where its column `text` exceeds CHUNK_CHARS."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in batches:
            for part in chunks(batch, text):
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def chunks(batch: pa.RecordBatch, text: str | None) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    if text is None:
        yield batch
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(text))), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > CHUNK_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """About n rows (all, of no more), by a bound on the hash of the key: each task passes on its share only. Keys that occur
    very often can't exceed 2 n rows."""
    rows = df.count()
    if rows <= n:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int((1 << 40) * n / rows)).limit(2 * n)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def clean_source(c: Column | str) -> Column:
    """The canonical name of a source: that of a known alias, else the name itself in lower case; 'unknown' for null and empty ones."""
    c = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", ""))
    out = F.when(F.coalesce(c, F.lit("")) == "", "unknown")
    for alias, name in SOURCE_ALIASES.items():
        out = out.when(c == alias, name)
    return out.otherwise(c)


def clean_lang(c: Column | str) -> Column:
    """The two-letter code of any spelling of a known language; null for anything else."""
    c = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", ""))
    c = F.regexp_replace(c, r"[-_].*$", "")
    out = None
    for code, names in LANGUAGES.items():
        out = (F if out is None else out).when(c.isin(code, *names), F.lit(code))
    return out.otherwise(F.lit(None).cast("string"))


def clean_domain(c: Column | str) -> Column:
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(F.length(c) > 0, c).otherwise("unknown")


class Ids(dict):
    """word -> value of fn(word), kept for later words and emptied when it grows too large."""

    def __init__(self, fn: Callable[[str], int], most: int = 1_000_000) -> None:
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.fn(word)
        return value


WORD = re.compile(r"[a-z0-9]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
