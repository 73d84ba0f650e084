"""Token counts and ids under a byte-level pair tokenizer given as a table of merges."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from corvane.llm.common import Ids

#: An optional space and a run of letters, of digits or of other visible marks; or a run of the remaining white space.
PIECE = re.compile(r" ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+")
FIRST_BYTE = 4
#: A table of merges is a vocabulary: it is read by the driver and refused beyond this many rows.
MOST_MERGES = 1_000_000


class Tokenizer:
    def __init__(self, merges: list[tuple[int, bytes, bytes, int]]) -> None:
        self.ids = {bytes([b]): FIRST_BYTE + b for b in range(256)}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, left, right, token in sorted(merges):
            self.ranks.setdefault((left, right), rank)
            self.ids.setdefault(left + right, token)
        self.counts = Ids(lambda piece: len(self.pieces(piece)))

    @classmethod
    def of(cls, table: DataFrame) -> Tokenizer:
        rows = table.select("merge_rank", "left_hex", "right_hex", "token_id").where("merge_rank is not null and left_hex is not null and right_hex is not null").limit(MOST_MERGES + 1).collect()
        if len(rows) > MOST_MERGES:
            raise ValueError(f"more than {MOST_MERGES} merges")
        return cls([(r[0], bytes.fromhex(r[1]), bytes.fromhex(r[2]), r[3]) for r in rows])

    def __reduce__(self):
        return _made, (self.ids, self.ranks)

    def pieces(self, piece: str) -> list[bytes]:
        parts = [bytes([b]) for b in piece.encode("utf-8", "surrogatepass")]
        if len(parts) > 64:
            return self._long(parts)
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.ranks.get(p, 1 << 60))
            if best not in self.ranks:
                break
            parts = _join(parts, best)
        return parts

    def _long(self, parts: list[bytes]) -> list[bytes]:
        """As pieces(), with one pass per listed rank that occurs: for runs without a break, which may be as long as a text."""
        import heapq

        n = len(parts)
        right, left, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:  # the lowest rank first, and of one rank the leftmost: all of its occurrences, left to right
            rank, i = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or self.ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i] += parts[j]
            alive[j], right[i] = False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
                if (r := self.ranks.get((parts[i], parts[right[j]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if left[i] >= 0 and (r := self.ranks.get((parts[left[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, left[i]))
        return [p for p, a in zip(parts, alive) if a]

    def count(self, text: str | None) -> int:
        """Tokens of the whole text; 0 for null and ''. """
        return sum(map(self.counts.__getitem__, PIECE.findall(text))) if text else 0

    def encode(self, text: str | None) -> list[int]:
        return [self.ids[p] for piece in PIECE.findall(text or "") for p in self.pieces(piece)]


def _made(ids: dict, ranks: dict) -> Tokenizer:
    t = Tokenizer([])
    t.ids, t.ranks = ids, ranks
    return t


def _join(parts: list[bytes], pair: tuple[bytes, bytes]) -> list[bytes]:
    out, i = [], 0
    while i < len(parts):
        if i + 1 < len(parts) and parts[i] == pair[0] and parts[i + 1] == pair[1]:
            out.append(parts[i] + parts[i + 1])
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return out
