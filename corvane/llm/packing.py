"""Token sequences placed into blocks of fixed size, by linear grouping.

Only the number of sequences of each length matters for the plan, and lengths are at most the block size, so the plan is made
on a histogram that doesn't grow with the data. Large lengths are rounded up within groups of equal cardinality; the
numbers of blocks of each configuration of the few sizes left are found by column generation; the real lengths take the
places of the rounded ones; and small lengths go where they fit best. The plan is a list of runs (so many sequences of
one length, into so many blocks from one on), which every sequence finds by its rank among those of its length.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import map_rows, materialize

BLOCK = 2049
GROUPS = 64
#: Lengths of more than this share of a block are large.
LARGE = 1 / 8
#: Sequences of one length that are ranked together, about; of very many sequences more, so that there are at most MOST_PARTS parts
#: beyond one for each length.
RANKED, MOST_PARTS = 100_000, 50_000


def configurations(sizes: list[int], counts: list[int], block: int) -> list[tuple[tuple[int, ...], float]]:
    """Configurations (how many of each size) and how many blocks of each, by the simplex method with columns priced by a knapsack."""
    m = len(sizes)
    basis = np.diag([float(block // s) for s in sizes])
    need, each = np.array(counts, float), np.array(sizes)
    for _ in range(60 * m):
        prices = np.linalg.solve(basis.T, np.ones(m))
        best, took = np.zeros(block + 1), np.full(block + 1, -1)
        for c in range(int(each.min()), block + 1):
            worth = np.where(each <= c, best[np.maximum(c - each, 0)] + prices, -1.0)
            k = int(worth.argmax())
            best[c] = best[c - 1]
            if worth[k] > best[c] + 1e-12:
                best[c], took[c] = worth[k], k
        if best[block] <= 1 + 1e-7:
            break
        column, c = np.zeros(m), block
        while c > 0:
            if took[c] < 0:
                c -= 1
                continue
            column[took[c]] += 1
            c -= sizes[took[c]]
        step, have = np.linalg.solve(basis, column), np.linalg.solve(basis, need)
        ratio = np.where(step > 1e-9, have / np.where(step > 1e-9, step, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(ratio.argmin())] = column
    return [(tuple(int(v) for v in basis[:, j]), float(x)) for j, x in enumerate(np.linalg.solve(basis, need))]


class Plan:
    """Blocks are numbered from 0; blocks of the same free room lie in classes (first block, number of blocks, places taken)."""

    def __init__(self, block: int) -> None:
        self.block, self.blocks = block, 0
        self.free: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self.rooms: list[int] = []
        #: length -> (first rank, sequences, first block, sequences a block, first position, first token)
        self.runs: dict[int, list[tuple[int, int, int, int, int, int]]] = defaultdict(list)
        self.ranks: dict[int, int] = defaultdict(int)

    def put(self, room: int, first: int, blocks: int, places: int, length: int, each: int) -> int:
        """`each` sequences of a length into each of these blocks; gives the room that is left."""
        self.runs[length].append((self.ranks[length], blocks * each, first, each, places, self.block - room))
        self.ranks[length] += blocks * each
        return room - each * length

    def keep(self, room: int, first: int, blocks: int, places: int) -> None:
        if blocks and room:
            if room not in self.free or not self.free[room]:
                if room not in self.rooms:
                    bisect.insort(self.rooms, room)
            self.free[room].append((first, blocks, places))

    def best_fit(self, length: int, n: int) -> None:
        while n:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = min(n, self.block // length)
                blocks = n // each
                first, self.blocks = self.blocks, self.blocks + blocks
                self.keep(self.put(self.block, first, blocks, 0, length, each), first, blocks, each)
                n -= blocks * each
                continue
            room = self.rooms[at]
            first, blocks, places = self.free[room].pop()
            if not self.free[room]:
                self.rooms.pop(at)
            each = min(n, room // length)
            take = min(blocks, n // each)
            if take < blocks:
                self.keep(room, first + take, blocks - take, places)
            self.keep(self.put(room, first, take, places, length, each), first, take, places + each)
            n -= take * each


def plan(counts: dict[int, int], block: int = BLOCK, groups: int = GROUPS, large: float = LARGE) -> Plan:
    """The plan for so many sequences of each length (1 to block)."""
    out = Plan(block)
    left = dict(counts)
    big = sorted((n for n in counts if n > block * large), reverse=True)
    total = sum(counts[n] for n in big)
    if total:
        # groups of equal cardinality, the longest first; each is rounded up to its longest
        size_of, sizes, in_group, seen = {}, [], [], 0
        for n in big:
            if not sizes or seen >= total * len(sizes) / groups:
                sizes.append(n)
                in_group.append([])
            in_group[-1].append(n)
            seen += counts[n]
        for pattern, x in configurations(sizes, [sum(counts[n] for n in g) for g in in_group], block):
            blocks = int(x + 1e-9)
            # every place of the configuration gets the longest length of its group that is left, for as many blocks as that lasts
            while blocks:
                used, chosen = defaultdict(int), []
                for g, k in enumerate(pattern):
                    for _ in range(k):
                        n = next((n for n in in_group[g] if left[n] > used.get(n, 0)), 0)
                        if n:
                            used[n] += 1
                            chosen.append(n)
                if not chosen:
                    break
                many = min(blocks, *(left[n] // k for n, k in used.items()))
                first, room, places = out.blocks, block, 0
                out.blocks += many
                for n, k in used.items():
                    room = out.put(room, first, many, places, n, k)
                    left[n] -= many * k
                    places += k
                out.keep(room, first, many, places)
                blocks -= many
    for n in sorted(left, reverse=True):
        if left[n]:
            out.best_fit(n, left[n])
    return out


def pack(seqs: DataFrame, block: int = BLOCK, key: str = "seq", split: str = "split", ids: str = "ids") -> DataFrame:
    """split, block, position, seq, piece, first_token, tokens: the place of every sequence, for each split apart.

    A sequence of more than `block` tokens is cut into pieces (piece 0, 1, ...) of a whole block and a rest; no other is cut.
    Null splits form one of their own. Null and empty sequences have no tokens and no place. Equal rows are placed each.
    """
    size = F.size(F.coalesce(F.col(ids), F.array().cast(seqs.schema[ids].dataType)))
    rows = seqs.select(F.col(split).alias("split"), F.col(key).alias("seq"), size.alias("size")).where("size > 0")
    last = F.floor((F.col("size") - 1) / block).cast("int")
    rows = rows.select("split", "seq", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    rows = rows.select("split", "seq", "piece", F.least(F.lit(block), F.col("size") - F.col("piece") * block).cast("int").alias("tokens"))
    rows = materialize(rows, "lengths")
    # at most `block` rows for each split, of which there are a handful
    lengths = rows.groupBy("split", "tokens").agg(F.count("*").alias("n")).collect()
    each = max(RANKED, sum(r.n for r in lengths) // MOST_PARTS)
    parts = seqs.sparkSession.createDataFrame([(r.split, r.tokens, -(-r.n // each)) for r in lengths], "s string, t int, parts int")
    rows = rows.join(F.broadcast(parts), F.col("split").eqNullSafe(F.col("s")) & (F.col("tokens") == F.col("t"))).drop("s", "t").withColumn("part", F.pmod(F.xxhash64("seq", "piece"), F.col("parts")).cast("int"))
    by: dict = defaultdict(lambda: defaultdict(dict))
    for r in lengths:
        by[r.split][r.tokens] = {} if r.n > each else {0: r.n}
    for r in rows.where("parts > 1").groupBy("split", "tokens", "part").agg(F.count("*").alias("n")).collect():
        by[r.split][r.tokens][r.part] = r.n
    offsets, keys, runs = {}, [], []
    for s in sorted(by, key=lambda x: (x is not None, x)):
        for tokens, held in by[s].items():
            at = 0
            for part in sorted(held):
                offsets[s, tokens, part] = at
                at += held[part]
        p = plan({tokens: sum(held.values()) for tokens, held in by[s].items()}, block)
        for tokens, rs in p.runs.items():
            rs = sorted(rs)
            keys.append((s, tokens))
            runs.append(np.array(rs, np.int64))
    shared = seqs.sparkSession.sparkContext.broadcast((offsets, dict(zip(keys, runs))))
    # a length may be that of a third of all rows: each of its parts is ranked apart
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("split", "tokens", "part").orderBy("seq", "piece")) - 1)

    def place(c: dict[str, list]) -> dict[str, list]:
        offsets, runs = shared.value
        out = {"split": c["split"], "seq": c["seq"], "piece": c["piece"], "tokens": c["tokens"], "block": [], "position": [], "first_token": []}
        for s, tokens, part, rank in zip(c["split"], c["tokens"], c["part"], c["rank"]):
            rank += offsets[s, tokens, part]
            rs = runs[s, tokens]
            start, _, first, each, places, at = rs[np.searchsorted(rs[:, 0], rank, side="right") - 1].tolist()
            out["block"].append(first + (rank - start) // each)
            out["position"].append(places + (rank - start) % each)
            out["first_token"].append(at + (rank - start) % each * tokens)
        return out

    return map_rows(ranked.select("split", "seq", "piece", "tokens", "part", "rank"), place, "split string, block bigint, position int, seq bigint, piece int, first_token int, tokens int")


def fill(packed: DataFrame, block: int = BLOCK) -> DataFrame:
    """By split: blocks, tokens, unused room and its share."""
    return packed.groupBy("split").agg((F.max("block") + 1).alias("blocks"), F.sum("tokens").alias("tokens")).withColumn("unused", F.col("blocks") * block - F.col("tokens")).withColumn("unused_share", F.round(F.col("unused") / (F.col("blocks") * block), 6))
