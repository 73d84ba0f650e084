"""Held-out test texts that leaked into a corpus, found with suffix arrays of the training text.

The corpus is read once, in shards (whole documents, about CHUNK_CHARS characters). All words of a shard form one sequence, and a
suffix array of all its suffixes is built by prefix doubling, each sorted up to the end of its document. Every suffix of every
test prompt is searched in it by bisection, which gives its longest verbatim match (with a neighbour of its place in
the array) and the range of all places that share its first SEED words. From these places matches are lengthened to both
sides, at the cost of at most one error in `per` words. A document holds an item when at least `least` of the item's
words, from a matched word to a matched word, lie in it in order with no more than one in `per` of them replaced, dropped
or added. A span of `least` words or more within that bound holds a verbatim run of SEED words: 16 words with two errors leave 14
in three runs, and no longer span can do with shorter ones.

Common question openings are no leak: words in runs of SEED words that COMMON_IN or more different prompts have in common
are counted as common, and a span needs OWN matched words besides them (one, if `least` of its words stand verbatim in a row).

Case, accents, typography, hyphens at line ends, mark-up and layout are removed on both sides. Null and empty texts
have no matches. Repeated items match each under their own id; equal documents each appear. Extra columns are ignored.
Words are compared by 63 bits of their hashes.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WORD, Ids, arrow_schema, chunks, map_rows

SEED = 5
#: Errors to either side of a match that are crossed before it is discarded.
NEAR_ERRORS = 3
#: Different prompts that share a run of SEED words, so that it is common; matched words beyond common ones that a span needs.
COMMON_IN, OWN = 3, 8
#: Test items whose suffixes are held at a time, and blocks of these that one scan of the corpus searches. Both bound what is broadcast.
ITEMS_A_BLOCK, BLOCKS_A_SCAN = 20_000, 50
_INLINE = re.compile(r"</?(?:a|b|i|u|em|strong|span|sup|sub|mark|small|code)(?:\s[^<>]*)?>", re.I)
_TAGS = re.compile(r"</?[a-zA-Z!][^<>]*>")
_NOTES = re.compile(r"\[(?:\d{1,3}|note \d{1,3}|citation needed)\]|\]\([^()\s]+\)")
_BROKEN = re.compile(r"(?<=\w)[-‐][ \t\r]*\n[ \t]*(?=\w)")
_UNSEEN = re.compile("[­​-‏⁠﻿'‘’ʼ`´]")
#: Letters that have no decomposition, and look-alikes from other scripts.
_LETTERS = str.maketrans(
    {
        "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ı": "i",
        "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
        "ο": "o", "α": "a", "ε": "e", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k",
    }
)


def normal_words(text: str | None) -> list[str]:
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAGS.sub(" ", _INLINE.sub("", text))
    if "]" in text:
        text = _NOTES.sub("", text)
    if "\n" in text:
        text = _BROKEN.sub("", text.replace("\u00ad\n", ""))
    text = text.lower()
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", _UNSEEN.sub("", text)))
        if not text.isascii():
            text = "".join(c for c in text.translate(_LETTERS) if not unicodedata.combining(c))
    elif "'" in text or "`" in text:
        text = text.replace("'", "").replace("`", "")
    return WORD.findall(text)


def _reach(doc: list[int], item: list[int], errors: int) -> list[tuple[int, int]]:
    """For e = 0..errors: how many words of item, from its start and up to a matched word, are aligned with a beginning of doc
    at the cost of e words replaced, dropped or added, at the most; and how many words of doc these take."""
    n, m = len(item), len(doc)
    far: dict[int, int] = {}  # by diagonal (doc place less item place): the farthest item place at the present cost
    best: list[tuple[int, int]] = []
    for e in range(errors + 1):
        now: dict[int, int] = {}
        top = best[-1] if best else (0, 0)
        for d in range(-e, e + 1):
            i = 0 if e == 0 else max(far.get(d, -9) + 1, far.get(d + 1, -9) + 1, far.get(d - 1, -9))
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            j = i
            while j < n and j + d < m and item[j] == doc[j + d]:
                j += 1
            now[d] = j
            if j > i and j > top[0]:
                top = (j, j + d)
        far = now
        best.append(top)
    return best


def word_value(word: str) -> int:
    """63 bits of a hash with the highest bit set, so that every word lies above the marks at the ends of texts."""
    return xxhash.xxh64_intdigest(word) | 1 << 63


def suffix_array(flat: np.ndarray) -> np.ndarray:
    """The places of all suffixes of flat in order, by prefix doubling; only places not yet told apart are sorted again.
    flat has a different value at each end of a text, so that no two suffixes are equal beyond it."""
    n = len(flat)
    sa = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], flat[sa[1:]] != flat[sa[:-1]]]) if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)  # the slot where each slot's group begins
    rank = np.empty(n + 1, np.int64)
    rank[sa], rank[n] = first, -1
    size = np.diff(np.append(np.flatnonzero(new), n))
    slots = np.flatnonzero(np.repeat(size > 1, size))
    k = 1
    while len(slots):
        at = sa[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + k, n)] + 1
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        sa[slots] = at
        begins = np.flatnonzero(new)
        size = np.diff(np.append(begins, len(at)))
        rank[at] = np.repeat(slots[begins], size)
        slots = slots[np.repeat(size > 1, size)]
        k *= 2
    return sa


def agree(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of places the words from there on that a and b have in common, up to `most`; and whether a's suffix is less than b's."""
    same, less = np.zeros(len(p), np.int64), np.zeros(len(p), bool)
    live = np.arange(len(p))
    for k in range(most):
        x, y = a[p[live] + k], b[q[live] + k]
        less[live] = x < y
        live = live[x == y]
        if not len(live):
            break
        same[live] = k + 1
    return same, less


class Shard:
    """The words of some documents one after another (an end mark after each) and their suffix array."""

    def __init__(self, texts: list[str | None], ids: Ids) -> None:
        words = [normal_words(t) for t in texts]
        self.counts = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.counts + 1) - (self.counts + 1)
        self.flat = np.zeros(int((self.counts + 1).sum()), np.uint64)
        inside = np.ones(len(self.flat), bool)
        inside[self.starts + self.counts] = False
        self.flat[inside] = np.fromiter((ids[x] for w in words for x in w), np.uint64, int(self.counts.sum()))
        self.flat[~inside] = np.arange(1, len(words) + 1)
        self.array = suffix_array(self.flat)

    def bound(self, tests: np.ndarray, q: np.ndarray, most: int, after: bool = False) -> np.ndarray:
        """The first slot of the array whose suffix isn't less than (after: is greater than) the test suffix at q, in the first `most` words."""
        low, high = np.zeros(len(q), np.int64), np.full(len(q), len(self.array))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            same, less = agree(self.flat, self.array[mid], tests, q[open_], most)
            up = less & (same < most) | (after & (same == most))
            low[open_] = np.where(up, mid + 1, low[open_])
            high[open_] = np.where(up, high[open_], mid)
        return low

    def longest(self, tests: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
        """The words of the longest verbatim match of each test suffix, that with a neighbour of its place in the array."""
        at = self.bound(tests, q, most)
        n = len(self.array)
        out = np.zeros(len(q), np.int64)
        for slot in (at - 1, at):
            fine = np.flatnonzero((slot >= 0) & (slot < n))
            out[fine] = np.maximum(out[fine], agree(self.flat, self.array[slot[fine]], tests, q[fine], most)[0])
        return out


class TestSuffixes:
    """The words of a block of test prompts one after another, each with an end mark, and which of them are common."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str, list[int]]]) -> None:
        ids = Ids(word_value)
        words = [normal_words(t) for _, t, _ in items]
        self.ids = [i for i, _, _ in items]
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        self.flat = np.zeros(int((self.lengths + 1).sum()), np.uint64)  # end marks are 0, which no shard has
        own = np.ones(len(self.flat), np.int64)
        for s, w, (_, _, common) in zip(self.starts, words, items):
            self.flat[s : s + len(w)] = [ids[x] for x in w]
            own[s + len(w)] = 0
            for k in common or ():
                own[s + k : s + k + SEED] = 0
        self.own = np.concatenate([[0], np.cumsum(own)])
        self.places = np.flatnonzero(self.flat)
        self.longest = int(self.lengths.max(initial=0))


def search(shard: Shard, tests: TestSuffixes, least: int, per: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """(text number, item number, first word in the text, words taken there, item words, errors, longest verbatim run): the best span of each pair."""
    flat = shard.flat
    if len(flat) < SEED or not len(tests.places):
        return []
    found = shard.longest(tests.flat, tests.places, tests.longest)
    seeds = tests.places[found >= SEED]
    low, high = shard.bound(tests.flat, seeds, SEED), shard.bound(tests.flat, seeds, SEED, True)
    hits = high - low
    which = np.repeat(np.arange(len(hits)), hits)
    p = shard.array[np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low, hits)]
    q = seeds[which]
    d = np.searchsorted(shard.starts, p, side="right") - 1
    item = np.searchsorted(tests.starts, q, side="right") - 1
    more = (p > shard.starts[d]) & (q > tests.starts[item])  # lengthened to the left by another hit
    more[more] = flat[p[more] - 1] == tests.flat[q[more] - 1]
    p, d, q, item = p[~more], d[~more], q[~more], item[~more]
    # A span with e errors is e + 1 runs of equal words, of which those between adjacent errors are empty. With up to three
    # errors it has 13 words or more in four runs; with more, 7 e or more, so some three runs in a row have 14 or more.
    # Either way one of these runs holds a seed, and a match there has so many equal words near it, at most three errors
    # away, so on its diagonal or one of three to either side.
    near = least - least // per - 1
    none = np.zeros(2 * least, np.uint64)
    wide, wide_items = np.concatenate([none + np.uint64(len(shard.counts) + 1), flat, none + np.uint64(len(shard.counts) + 1)]), np.concatenate([none, tests.flat, none])
    fine = np.zeros(len(p), bool)
    for k in range(0, len(p), 20_000):
        x, y = p[k : k + 20_000, None] + 2 * least, q[k : k + 20_000, None] + 2 * least
        span = np.arange(-least, least + 1)[None, :]
        those = wide_items[y + span]
        fine[k : k + 20_000] = sum((wide[x + span + d] == those).sum(1) for d in range(-NEAR_ERRORS, NEAR_ERRORS + 1)) >= near
    p, d, q, item = p[fine], d[fine], q[fine], item[fine]
    best: dict[tuple[int, int], tuple] = {}
    for x, y, dn, it in zip(p.tolist(), q.tolist(), d.tolist(), item.tolist()):
        ds, is_ = int(shard.starts[dn]), int(tests.starts[it])
        de = ds + int(shard.counts[dn])
        ie = is_ + int(tests.lengths[it])
        n = ie - is_
        allowed = n // per
        if n < least:
            continue
        old = best.get((dn, it))
        if old and old[0] <= x - ds and x - ds + SEED <= old[0] + old[1]:
            continue
        sides = (flat[x : min(de, x + 2 * n)].tolist(), tests.flat[y:ie].tolist()), (flat[max(ds, x - 2 * n) : x][::-1].tolist(), tests.flat[is_:y][::-1].tolist())
        if _reach(*sides[0], NEAR_ERRORS)[-1][0] + _reach(*sides[1], NEAR_ERRORS)[-1][0] < near:
            continue
        right, left = (_reach(*side, allowed) for side in sides)
        longest = right[0][0]
        for e1, (l, ld) in enumerate(left):
            for e2, (r, rd) in enumerate(right[: allowed - e1 + 1]):
                if l + r >= least and (e1 + e2) * per <= l + r and tests.own[y + r] - tests.own[y - l] - e1 - e2 >= (1 if longest >= least else OWN):
                    old = best.get((dn, it))
                    if old is None or (l + r, -e1 - e2) > (old[2], -old[3]):
                        best[dn, it] = (x - ld - ds, ld + rd, l + r, e1 + e2, max(longest, old[4] if old else 0))
                    else:
                        best[dn, it] = (*old[:4], max(longest, old[4]))
    return [(dn, it, *v) for (dn, it), v in best.items()]


def common_runs(items: DataFrame) -> DataFrame:
    """i, t, common: the items with the places of runs of SEED words that COMMON_IN or more different prompts have."""

    def cut(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"i": [], "place": [], "run": [], "whole": []}
        for i, t in zip(c["i"], c["t"]):
            w = normal_words(t)
            whole = xxhash.xxh64_intdigest(" ".join(w)) - (1 << 63)
            for k in range(len(w) - SEED + 1):
                out["i"].append(i)
                out["place"].append(k)
                out["run"].append(xxhash.xxh64_intdigest(" ".join(w[k : k + SEED])) - (1 << 63))
                out["whole"].append(whole)
        return out

    runs = map_rows(items, cut, "i bigint, place int, run bigint, whole bigint", "t")
    common = runs.select("run", "whole").distinct().groupBy("run").count().where(F.col("count") >= COMMON_IN).select("run")
    places = runs.join(common, "run", "left_semi").groupBy("i").agg(F.sort_array(F.collect_set("place")).alias("common"))
    return items.join(places, "i", "left").select("i", "t", "common")


def blocks_of(items: DataFrame) -> Iterator[TestSuffixes]:
    """The items, ITEMS_A_BLOCK at a time: the driver holds no more."""
    block: list[tuple[int, str, list[int]]] = []
    for r in items.toLocalIterator():
        block.append((r.i, r.t, r.common))
        if len(block) == ITEMS_A_BLOCK:
            yield TestSuffixes(sorted(block, key=lambda x: x[:2]))
            block = []
    yield TestSuffixes(sorted(block, key=lambda x: x[:2]))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", prompt: str = "prompt", least: int = 15, per: int = 8) -> DataFrame:
    """doc_id, item_id, first_word, doc_words, item_words, errors, longest_run: one row for each document and item found in it.

    One scan of the corpus searches up to ITEMS_A_BLOCK x BLOCKS_A_SCAN items (a million); each shard's array is built once and serves
    all blocks, of which a task holds one at a time. More items take another scan for each further million."""
    ddl = "doc_id bigint, item_id bigint, first_word int, doc_words int, item_words int, errors int, longest_run int"
    kept = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(prompt).alias("t")).where("i is not null and t is not null").distinct()
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null")

    def scan(blocks: list) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema, words = arrow_schema(ddl), Ids(word_value)
            for whole in batches:
                for part in chunks(whole, "text"):
                    ids = part.column(0).to_pylist()
                    shard = Shard(part.column(1).to_pylist(), words)
                    for b in blocks:
                        tests = b.value
                        if len(blocks) > 1 and getattr(b, "_path", None):
                            b.__dict__.pop("_value", None)  # read again for the next shard, so that one block is held at a time
                        found = search(shard, tests, least, per)
                        cols = [[ids[f[0]] for f in found], [tests.ids[f[1]] for f in found], *([f[k] for f in found] for k in range(2, 7))]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)

        return rows.mapInArrow(run, ddl)

    out, held = None, []
    for block in blocks_of(common_runs(kept)):
        held.append(sc.broadcast(block))
        if len(held) == BLOCKS_A_SCAN:
            out, held = scan(held) if out is None else out.unionAll(scan(held)), []
    if held:
        out = scan(held) if out is None else out.unionAll(scan(held))
    return out


def without_leaks(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents in which nothing was found."""
    return docs.join(found.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
