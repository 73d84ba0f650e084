"""Near-duplicate records: binary-trie self-joins of min-hash codes within an error budget, then an exact check.

The delivered 64-bit fingerprint is stale for some rows, and a pair at a similarity of one half lies about 17 of its 64 bits apart.
So each text gets a sketch of its own: SKETCH_BITS one-bit min-hashes, whose expected Hamming distance is (1 - similarity) / 2 of
the bits, and BANDS keys of ROWS min-hashes each. The code of a text in a band is the band's key followed by the sketch, and the
codes of all texts form one binary trie a band. Its node pairs are traversed together with the differing bits so far, and a
pair is dropped when these exceed the budget of its depth: none in the key, whose bits differ at random as soon as one of its
min-hashes does, and then what pairs at the least similarity still to be found all but never exceed (see budgets).

The tries' upper part, the keys, is traversed by an exchange: packed keys meet by their hash, nodes of one text are dropped there, and
equal sets of texts (copies of a passage share many keys) are kept once. Only then are sketches sent, and the lower parts of the tries are
walked in tasks. What is left is checked exactly on the texts.

Nulls: a null text has no words and is in no pair. A text of fewer than SHINGLE words has no shingles; it is
paired only with rows of the same words (at least one word). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WORD, Ids, arrow_schema, chunks, map_rows, materialize

SKETCH_BITS, BANDS, ROWS = 256, 40, 3
SIG = SKETCH_BITS // 64
#: Bytes of a key that are kept: equal keys stay equal, and chance ones fail the budget or the exact check.
KEY_BYTES = 6
#: Standard deviations by which the bits of a wanted pair may exceed what is expected, at any depth.
SPREAD = 3.6
#: Rows of one key beyond which its node is divided into blocks that meet two by two; of very large tables a share of the rows, so that
#: there are at most 80 x HOT_SHARE such keys.
HOT_ROWS, HOT_SHARE = 20_000, 50_000
#: Every so manieth document is looked at to find such keys; this decides only how work is divided.
HOT_SAMPLE = 32
#: Keys in one part of the exchange, about, and keys that a task gathers before it packs them; of very many rows, parts have more
#: keys, so that on average PACKED of a task's keys go to each part.
PART_KEYS, PACK_KEYS, PACKED = 250_000, 8_000_000, 50
#: Node pairs of at most so many pairs of codes are compared word by word.
LEAF = 64
#: Copies of one text beyond which their pairs are made in blocks.
COPIES = 1000
_rng = np.random.default_rng(20)
_MUL = (_rng.integers(1, 2**31, 2 * SKETCH_BITS, dtype=np.uint32) * 2 + 1).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, 2 * SKETCH_BITS, dtype=np.uint32)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k ids."""
    h = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - k + 1 + i])
    return h


def within(runs: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Of the runs of k over concatenated documents of so many words, those that lie in one document."""
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts)[: len(runs)] - np.arange(len(runs))
    return runs[left >= k]


def sketch(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document (slices of hashes that begin at starts, none empty): BANDS keys, and SKETCH_BITS bits as 64-bit words."""
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    n = len(starts)
    need = max(SKETCH_BITS, BANDS * ROWS)
    sig = np.zeros((n, SIG), np.uint64)
    keys = np.zeros((n, BANDS), np.uint64)
    for k in range(need):
        low = np.minimum.reduceat(x * _MUL[k] + _ADD[k], starts).astype(np.uint64)
        mixed = _mix(low * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
        if k < SKETCH_BITS:
            sig[:, k // 64] = (sig[:, k // 64] << np.uint64(1)) | (mixed & np.uint64(1))
        if k < BANDS * ROWS:
            keys[:, k // ROWS] = _mix(keys[:, k // ROWS] + mixed + np.uint64(k))
    return keys, sig


def budgets(least: float) -> np.ndarray:
    """For each number of sketch bits (0 to SKETCH_BITS) the differing ones that a pair at the least similarity exceeds with a chance of about one in 6 000."""
    d = np.arange(SKETCH_BITS + 1)
    p = (1 - least) / 2
    return np.floor(d * p + SPREAD * np.sqrt(d * p * (1 - p))).astype(np.int64)


def fingerprints(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """id, words, h1, h2 (a 128-bit digest of the words), keys (KEY_BYTES of each band's key), sk (the sketch); both empty without shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        ids = Ids(xxhash.xxh64_intdigest)
        for whole in batches:
            for b in chunks(whole, "text"):
                keys, texts = b.column(0), b.column(1).to_pylist()
                words = [words_of(t) for t in texts]
                digests = [xxhash.xxh128_intdigest(" ".join(w)) for w in words]
                counts = np.array([len(w) for w in words], np.int64)
                lengths = np.maximum(counts - shingle + 1, 0)
                has = lengths > 0
                bands, sig = np.zeros((0, BANDS), np.uint64), np.zeros((0, SIG), np.uint64)
                if has.any():
                    hashes = within(shingle_hashes(np.fromiter((ids[x] for w in words for x in w), np.uint64, int(counts.sum())), shingle), counts, shingle)
                    bands, sig = sketch(hashes, (np.cumsum(lengths) - lengths)[has])
                # the band is part of the key, so that one exchange serves all bands
                short = np.ascontiguousarray(_mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.uint8).reshape(len(bands), BANDS, 8)[:, :, :KEY_BYTES]).reshape(len(bands), -1)
                at = np.cumsum(has) - 1
                cut = lambda rows: [rows[i].tobytes() if h else b"" for i, h in zip(at.tolist(), has.tolist())]
                h1 = np.array([d >> 64 for d in digests], np.uint64).view(np.int64)
                h2 = np.array([d & (2**64 - 1) for d in digests], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([keys.cast(schema[0].type), pa.array(counts, pa.int32()), pa.array(h1), pa.array(h2), pa.array(cut(short), pa.binary()), pa.array(cut(sig), pa.binary())], schema=schema)

    ddl = "id bigint, words int, h1 bigint, h2 bigint, keys binary, sk binary"
    return df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").mapInArrow(run, ddl).where("words > 0")


class Walk:
    """What a traversal did: pairs of codes compared, and node pairs dropped by the budget."""

    def __init__(self) -> None:
        self.compared = self.dropped = 0


def trie_self_join(group: np.ndarray, sig: np.ndarray, budget: np.ndarray, walk: Walk | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), each pair once, of all pairs of codes (group, then sig as 64-bit words) of one group whose first d bits differ in at
    most budget[d] places at every depth d at which the traversal looks, the last one included.

    A node is a range of the sorted codes that share their first bits. The budget of the group's bits is 0, so only pairs of
    a node with itself survive these, and they are taken in one step."""
    walk = walk if walk is not None else Walk()
    bits = 64 * sig.shape[1]
    order = np.lexsort((*sig.T[::-1], group))
    g, a = group[order], np.ascontiguousarray(sig[order])
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(g))
    walk.dropped += len(starts) * (len(starts) - 1) // 2
    many = ends - starts > 1
    s, e = starts[many], ends[many]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(0, s[i : i + 4096], e[i : i + 4096], s[i : i + 4096], e[i : i + 4096], np.zeros(len(s[i : i + 4096]), np.int16)) for i in range(0, len(s), 4096)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, l1, r1, l2, r2, acc = stack.pop()
        same = l1 == l2
        small = ((r1 - l1) * (r2 - l2) <= LEAF) | (depth == bits)
        if small.any():
            _compare(a, l1[small], r1[small], l2[small], r2[small], budget, out, walk)
        keep = ~small
        if not keep.any():
            continue
        l1, r1, l2, r2, acc, same = l1[keep], r1[keep], l2[keep], r2[keep], acc[keep], same[keep]
        if depth not in ones:
            bit = (a[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit)]).astype(np.int64)
        c = ones[depth]
        m1, m2 = r1 - (c[r1] - c[l1]), r2 - (c[r2] - c[l2])
        n = ~same
        nodes = (
            np.concatenate([l1, m1, l1, m1[n]]),
            np.concatenate([m1, r1, m1, r1[n]]),
            np.concatenate([l2, m2, m2, l2[n]]),
            np.concatenate([m2, r2, r2, m2[n]]),
            np.concatenate([acc, acc, acc + 1, acc[n] + 1]),
        )
        there = (nodes[0] < nodes[1]) & (nodes[2] < nodes[3]) & ~((nodes[0] == nodes[2]) & (nodes[1] - nodes[0] == 1))
        fine = there & (nodes[4] <= budget[depth + 1])
        walk.dropped += int((there & ~fine).sum())
        nodes = tuple(x[fine] for x in nodes)
        for i in range(0, len(nodes[0]), 65536):
            stack.append((depth + 1, *(x[i : i + 65536] for x in nodes)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate([x for x, _ in out])], order[np.concatenate([y for _, y in out])]


def _compare(a, l1, r1, l2, r2, budget, out, walk) -> None:
    """All pairs of the codes of each node pair, word by word; a pair ends where it exceeds the budget of its depth."""
    step = max(1, 2_000_000 // max(1, int(((r1 - l1) * (r2 - l2)).max())))
    for k in range(0, len(l1), step):
        p, q, w = l1[k : k + step], l2[k : k + step], r2[k : k + step] - l2[k : k + step]
        sizes = (r1[k : k + step] - p) * w
        which = np.repeat(np.arange(len(p)), sizes)
        at = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        i, j = p[which] + at // w[which], q[which] + at % w[which]
        fine = (p[which] != q[which]) | (i < j)
        i, j = i[fine], j[fine]
        walk.compared += len(i)
        d = np.zeros(len(i), np.int64)
        for word in range(a.shape[1]):
            d = d + np.bitwise_count(a[i, word] ^ a[j, word])
            fine = d <= budget[64 * (word + 1)]
            i, j, d = i[fine], j[fine], d[fine]
        if len(i):
            out.append((i, j))


def hot_keys(reps: DataFrame, rows: int) -> dict[int, int]:
    """Keys of many rows, by a sample, with the number of blocks that each is divided into."""
    most = max(HOT_ROWS, rows // HOT_SHARE)
    if rows <= most:
        return {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_keys(b.column(0)).ravel().view(np.int64))], names=["key"])

    sample = reps.where(F.pmod(F.xxhash64("id"), F.lit(HOT_SAMPLE)) == 0).select("keys").mapInArrow(run, "key bigint")
    found = sample.groupBy("key").count().where(F.col("count") > most / HOT_SAMPLE / 2).collect()
    return {r.key: max(2, -(-r["count"] * HOT_SAMPLE // most)) for r in found}


def _keys(column: pa.Array) -> np.ndarray:
    """The keys of each row."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS, KEY_BYTES)
    out = np.zeros((*raw.shape[:2], 8), np.uint8)
    out[:, :, :KEY_BYTES] = raw
    return out.view(np.uint64)[:, :, 0]


def shared_nodes(reps: DataFrame) -> DataFrame:
    """node, ids: the different sets of two or more ids whose codes share a key, which are the tries' nodes below the keys."""
    rows = reps.count()
    parts = max(1, min(rows * BANDS // PART_KEYS, PACK_KEYS // PACKED))
    shared = reps.sparkSession.sparkContext.broadcast(hot_keys(reps, rows))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part: its keys (KEY_BYTES each) and, as differences from a base, their ids."""
        hot = shared.value
        hots = np.array(sorted(hot), np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            ids, keys = np.concatenate([i for i, _ in held]), np.concatenate([k for _, k in held])
            n = keys.shape[1]
            ids, keys = np.repeat(ids, n), keys.ravel()
            if len(hots):
                many = np.isin(keys.view(np.int64), hots)
                extra_i, extra_k = [ids[~many]], [keys[~many]]
                for i, k in zip(ids[many].tolist(), keys[many].tolist()):
                    blocks = hot[k if k < 1 << 63 else k - (1 << 64)]
                    own = xxhash.xxh32_intdigest(i.to_bytes(8, "little", signed=True)) % blocks
                    pairs = [min(own, o) * blocks + max(own, o) for o in range(blocks) if o != own]
                    extra_i.append(np.full(len(pairs), i, np.int64))
                    extra_k.append(_mix(np.uint64(k) + _mix(np.array(pairs, np.uint64) + np.uint64(1))) & np.uint64((1 << 8 * KEY_BYTES) - 1))
                ids, keys = np.concatenate(extra_i), np.concatenate(extra_k)
            part = (_mix(keys) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, ids, keys = part[order], ids[order], keys[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            base = int(ids.min())
            wide = int(ids.max()) - base >= 1 << 32
            off = (ids.view(np.uint64) - np.uint64(base & (2**64 - 1))).astype(np.uint64 if wide else np.uint32)
            raw = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            ends = [*cuts[1:].tolist(), len(part)]
            return pa.RecordBatch.from_arrays(
                [pa.array(part[cuts]), pa.array([base] * len(cuts), pa.int64()), pa.array([raw[s:e].tobytes() for s, e in zip(cuts.tolist(), ends)], pa.binary()), pa.array([off[s:e].tobytes() for s, e in zip(cuts.tolist(), ends)], pa.binary())],
                names=["part", "base", "keys", "ids"],
            )

        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy(zero_copy_only=False), _keys(b.column(1))))
            n += b.num_rows * BANDS
            if n >= PACK_KEYS:
                yield emit()
                held, n = [], 0
        if held:
            yield emit()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            ids, keys = [], []
            for base, k, i in rows:
                raw = np.frombuffer(k, np.uint8).reshape(-1, KEY_BYTES)
                wide = np.zeros((len(raw), 8), np.uint8)
                wide[:, :KEY_BYTES] = raw
                keys.append(wide.view(np.uint64)[:, 0])
                off = np.frombuffer(i, np.uint32 if len(i) == 4 * len(raw) else np.uint64)
                ids.append(off.astype(np.uint64).view(np.int64) + base)
            key, id_ = np.concatenate(keys), np.concatenate(ids)
            order = np.argsort(key, kind="stable")
            key, id_ = key[order], id_[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            size = np.diff(np.append(np.flatnonzero(new), len(key)))
            many = np.repeat(size > 1, size)
            key, id_, size = key[many], id_[many], size[size > 1]
            order = np.lexsort((id_, np.repeat(np.arange(len(size)), size)))
            id_ = id_[order]
            starts = np.cumsum(size) - size
            node = np.add.reduceat(_mix(id_.view(np.uint64)), starts) if len(size) else np.zeros(0, np.uint64)
            node, first = np.unique(_mix(node + size.astype(np.uint64)), return_index=True)
            sets = pa.ListArray.from_arrays(pa.array(np.append(starts, len(id_)).astype(np.int32)), pa.array(id_))
            return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), sets.take(pa.array(first))], names=["node", "ids"])

        held, now = [], None
        for b in batches:  # sorted by part
            for part, base, k, i in zip(*(c.to_pylist() for c in b.columns)):
                if part != now and held:
                    yield emit(held)
                    held = []
                now = part
                held.append((base, k, i))
        if held:
            yield emit(held)

    packed = reps.select("id", "keys").mapInArrow(pack, "part bigint, base bigint, keys binary, ids binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "node bigint, ids array<bigint>").groupBy("node").agg(F.first("ids").alias("ids"))


def candidates(reps: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (a < b) of ids whose sketches share a key and lie within the budgets."""
    budget = budgets(least)
    # Spark's guess of what comes out of Python is no size bound, so nothing here is broadcast
    entries = shared_nodes(reps).select("node", F.explode("ids").alias("id"))
    rows = entries.join(reps.select("id", "sk").hint("merge"), "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("a bigint, b bigint")

        def emit(node, ids, sk):
            i, j = trie_self_join(node.view(np.uint64), np.frombuffer(b"".join(sk), np.uint64).reshape(-1, SIG), budget)
            x, y = ids[i], ids[j]
            keep = x != y
            pairs = np.unique(np.stack([np.minimum(x, y)[keep], np.maximum(x, y)[keep]], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

        held: list[list] = []
        n = 0

        def joined() -> list:
            return [np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [x for h in held for x in h[2]]]

        for b in batches:  # sorted by node, so a node is whole once the next begins
            held.append([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()])
            n += b.num_rows
            if n < 200_000:
                continue
            cols = joined()
            cut = np.flatnonzero(cols[0][1:] != cols[0][:-1])
            if not len(cut):
                held = [cols]
                continue
            cut = cut[-1] + 1
            yield emit(*(c[:cut] for c in cols))
            held, n = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if n:
            yield emit(*joined())

    parted = rows.repartition("node").sortWithinPartitions("node").select("node", "id", "sk")
    return parted.mapInArrow(run, "a bigint, b bigint").distinct()


def shingle_sets(texts: list[str], k: int) -> list[set]:
    """The set of runs of k words of each text."""
    out = []
    for t in texts:
        w = words_of(t)
        out.append({*zip(*(w[i:] for i in range(k)))})
    return out


def near_duplicates(df: DataFrame, key: str = "seq", text: str = "text", shingle: int = 3, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep; links: a, b): rep is the least id of the rows of the same words, links are the pairs of
    representatives with a share of at least `least` of their shingles in common. Every row with a word is a member."""
    prints = materialize(fingerprints(df, key, text, shingle), "prints")
    classes = prints.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    members = materialize(prints.select("id", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "rep"), "members")
    # an id of several texts stands for each of them; the texts are told apart by the digest
    reps = prints.join(members.where("id = rep").select("id").distinct(), "id", "left_semi").where("length(sk) > 0").select("id", "keys", "sk")
    pairs = candidates(reps, least)
    texts = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("text is not null")
    # A small file can hold much text, so Spark's guess by file size may not broadcast it; both joins use one exchange of the texts.
    left = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "x"}).hint("merge"), "a")
    both = left.join(texts.withColumnsRenamed({"id": "b", "text": "y"}).hint("merge"), "b")

    def check(c: dict[str, list]) -> dict[str, list]:
        texts = {**dict(zip(c["a"], c["x"])), **dict(zip(c["b"], c["y"]))}  # each text is cut into words once a batch
        sets = dict(zip(texts, shingle_sets(list(texts.values()), shingle)))
        kept = []
        for i, (a, b) in enumerate(zip(c["a"], c["b"])):
            x, y = sets[a], sets[b]
            both = len(x & y)
            if both and both >= least * (len(x) + len(y) - both):
                kept.append(i)
        return {"a": [c["a"][i] for i in kept], "b": [c["b"][i] for i in kept]}

    return members, map_rows(both.select("a", "b", "x", "y"), check, "a bigint, b bigint", "x")


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of ids (seq_a < seq_b) of linked or equal texts. Copies of a text beyond COPIES are divided into blocks that meet two by
    two, so that no key has more than COPIES rows on either side."""
    sizes = members.groupBy("rep").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / COPIES).cast("int"))
    m = members.join(sizes, "rep").select("rep", "id", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    copied = m.join(sizes.where("n > 1").select("rep"), "rep", "left_semi")
    left = copied.select("rep", F.col("id").alias("x"), F.col("own").alias("p"), F.explode(every).alias("q"))
    right = copied.select("rep", F.col("id").alias("y"), F.col("own").alias("q"), F.explode(every).alias("p"))
    within = left.join(right.hint("merge"), ["rep", "p", "q"]).where("x < y").select("x", "y")
    # a link meets the blocks of both of its ends
    of = sizes.select("rep", "blocks")
    ends = links.join(of.withColumnsRenamed({"rep": "a", "blocks": "ba"}), "a").join(of.withColumnsRenamed({"rep": "b", "blocks": "bb"}), "b")
    ends = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("ba") - 1)).alias("p"), "bb").select("a", "b", "p", F.explode(F.sequence(F.lit(0), F.col("bb") - 1)).alias("q"))
    of_a, of_b = m.select(F.col("rep").alias("a"), F.col("own").alias("p"), F.col("id").alias("x")), m.select(F.col("rep").alias("b"), F.col("own").alias("q"), F.col("id").alias("y"))
    across = ends.join(of_a, ["a", "p"]).join(of_b, ["b", "q"]).select("x", "y")
    both = within.unionByName(across)
    return both.select(F.least("x", "y").alias("seq_a"), F.greatest("x", "y").alias("seq_b")).where("seq_a < seq_b").distinct()


def near_duplicate_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per document: its class of equal texts, that class's size and its number of links to other texts."""
    ends = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    return members.join(sizes.join(ends, "rep", "left"), "rep").select("id", F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
