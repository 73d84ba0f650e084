"""Corpus curation: text figures, deduplication, quotas, samples, fingerprints and near-duplicate removal."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.ranges import ranged


def text_ratios(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    c = F.col(text)
    x = docs.select(key, T.words(text).alias("words"), T.letters(c).alias("_l"), T.visible(c).alias("_v"), T.latin_letters(c).alias("_a"), T.digits(c).alias("_d"), T.stop_words(c).cast("bigint").alias("stops"))
    n = lambda name: F.col(name)
    return x.select(key, "words", T.ratio(n("_l"), n("_v")).alias("alpha"), T.ratio(n("_a"), n("_l")).alias("latin"), T.ratio(n("_d"), n("_v")).alias("digits"), "stops", T.ratio(n("stops"), n("words")).alias("stop_ratio"))


def line_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """By document: lines, distinct lines, and lines of each bad kind. Higher-order functions: no row is exploded or shuffled."""
    x = docs.select(key, T.lines(F.coalesce(F.col(text), F.lit(""))).alias("_l"))
    count = lambda p: F.size(F.filter("_l", p)).cast("bigint")
    return x.select(key, F.size("_l").cast("bigint").alias("lines"), F.size(F.array_distinct("_l")).cast("bigint").alias("distinct_lines"), count(T.is_table_line).alias("table_lines"), count(T.is_code_line).alias("code_lines"), count(T.is_boilerplate_line).alias("boiler_lines"))


def first_wins(docs: DataFrame, order: str = "seq", key: str = "id", text: str = "text") -> DataFrame:
    """order, outcome. A key is taken by its first row even if that row's text is a duplicate.

    Both stages are aggregates (minimum by group), so one key or text held by a third of all rows is reduced before the shuffle.
    """
    rows = docs.select(order, F.col(key).alias("_k"), T.content_digest(F.coalesce(F.col(text), F.lit(""))).alias("_d"))
    keyed = rows.join(rows.groupBy("_k").agg(F.min(order).alias("_first")), "_k", "left")
    fresh = keyed.where(F.col("_first").isNull() | (F.col("_first") == F.col(order)))
    texts = fresh.groupBy("_d").agg(F.min(order).alias("_text"))
    out = keyed.join(texts, "_d", "left")
    return out.select(order, F.when(F.col("_first") != F.col(order), "duplicate_id").when(F.col("_text") != F.col(order), "duplicate_text").otherwise("accepted").alias("outcome"))


def byte_quota(docs: DataFrame, quotas: DataFrame, group: str = "source", order: str = "doc_id", size: Column | None = None, parts: int = 256) -> DataFrame:
    """Rows of each group in order while the bytes before them are under the group's quota (the row that crosses it is kept).

    The running sum goes over ranges of the order: sums by range first, then rows within a range, so that one large group is
    no single task's work.
    """
    rows = ranged(docs.withColumn("_b", size if size is not None else F.octet_length("text")), order, parts)
    ranges = rows.groupBy(group, "_r").agg(F.sum("_b").alias("_n"))
    before = ranges.select(group, "_r", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("_b").over(Window.partitionBy(group, "_r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_in", within).join(before, [group, "_r"]).withColumn("bytes_before", F.col("_before") + F.col("_in"))
    return rows.join(F.broadcast(quotas), group).where(F.col("bytes_before") < F.col("quota")).drop("_r", "_before", "_in")


def bottom_k(docs: DataFrame, k: int, seed: int, key: str = "doc_id") -> DataFrame:
    """A uniform sample: the k rows of the least hashes (kept by partition before anything is shuffled)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return docs.withColumn("priority", h).orderBy("priority", key).limit(k)


def fence_kept(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines outside code fences; a fold over the line array carries the state."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        fence = F.trim(line).rlike("^(```|~~~)")
        return F.struct(F.when(fence, ~acc["inside"]).otherwise(acc["inside"]).alias("inside"), F.when(fence | acc["inside"], acc["kept"]).otherwise(F.concat(acc["kept"], F.array(line))).alias("kept"))

    x = docs.select(key, F.aggregate(F.split(F.col(text), "\n"), start, step).alias("s"))
    return x.select(key, F.array_join("s.kept", "\n").alias("kept"))


def simhash_pairs(rows: DataFrame, order: str = "seq", mark: str = "simhash", errors: int = 3) -> DataFrame:
    """Pairs of distinct fingerprints (by their first rows, a < b) that differ in at most `errors` of 64 bits.

    The bits are cut into twice as many blocks as errors: at least half of the blocks of such a pair are equal, so the equi-join on
    every choice of half of the blocks finds all, on keys of 32 bits, which few other fingerprints share. Equal fingerprints are one
    node: a fingerprint that a third of all rows share makes no pairs.
    """
    blocks = max(2, 2 * errors)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    first = rows.where(F.col(mark).isNotNull()).groupBy(F.col(mark).alias("f")).agg(F.min(order).alias("i"))
    masks = [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in some) for some in itertools.combinations(range(blocks), blocks - errors)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    keys = F.array(*(F.col("f").bitwiseAND(F.lit(signed(m))) for m in masks))
    spread = first.select("f", "i", F.posexplode(keys).alias("choice", "value"))
    left, right = spread.alias("l"), spread.alias("r")
    near = F.bit_count(F.col("l.f").bitwiseXOR(F.col("r.f")))
    pairs = left.join(right, [F.col("l.choice") == F.col("r.choice"), F.col("l.value") == F.col("r.value"), F.col("l.i") < F.col("r.i")])
    return pairs.where(near <= errors).select(F.col("l.i").alias("a"), F.col("r.i").alias("b"), near.cast("bigint").alias("distance")).distinct()


def greedy_keep(nodes: DataFrame, pairs: DataFrame, order: str = "i") -> DataFrame:
    """order, kept: rows are taken in order, and one near a kept earlier row is dropped.

    Each round decides all rows whose earlier neighbours are decided, until none is undecided: as many rounds as the longest chain of
    neighbours is long. The rest of the pairs is written to the shared folder after each, so nothing is computed twice and no lineage
    grows; the table before is removed.
    """
    from corvane.sources.shared import discard, materialize

    undecided = materialize(pairs.select("a", "b"), "edges")
    dropped = None
    while not undecided.isEmpty():
        # an earlier end that is no later end of an undecided pair is decided: kept. The least of all ends always is, so each round decides some.
        free = undecided.select("a").distinct().join(undecided.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = materialize(undecided.join(free, "a").select("b").distinct(), "gone")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        rest = undecided.join(free, "a", "left_anti").join(gone, "b", "left_anti").join(gone.withColumnRenamed("b", "a"), "a", "left_anti")
        before, undecided = undecided, materialize(rest.select("a", "b"), "edges")
        discard(before)
    if dropped is None:
        return nodes.select(order, F.lit(True).alias("kept"))
    return nodes.select(order).join(dropped.distinct().select(F.col("b").alias(order), F.lit(False).alias("kept")), order, "left").select(order, F.coalesce("kept", F.lit(True)).alias("kept"))


_TOKEN = re.compile("[a-z0-9]+")


def _votes(text: str, most: int) -> str:
    """Sixteen hexadecimal digits: bit by bit what most of the hashed shingles have; of fewer than three tokens the beginning of their digest."""
    t = _TOKEN.findall(text.lower())
    n = len(t) - 2
    if n < 1:
        return hashlib.md5(" ".join(t).encode()).hexdigest()[:16]
    step = max(1, n // most)
    raw = b"".join(hashlib.md5(" ".join(t[i : i + 3]).encode()).digest()[:8] for i in range(0, n, step))
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64)
    return np.packbits(2 * bits.sum(0, dtype=np.int64) >= len(bits)).tobytes().hex()


def simhash(docs: DataFrame, key: str, text: str = "text", most: int = 160) -> DataFrame:
    """key, bits (16 hexadecimal digits): votes of the hashed three-token shingles, at most 2 * most - 1 of them, evenly spread. One
    pass over Arrow batches, without a shuffle. A text of fewer than three tokens has the beginning of its content digest, a null text null."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else _votes(t, most) for t in b.column(1).to_pylist()], pa.string())], names=["k", "bits"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, bits string").withColumnRenamed("k", key)
