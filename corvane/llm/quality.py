"""Per-document quality figures, and the kind of each document from a hidden Markov model over its lines.

Every text is cut into lines, and lines of several sentences into these. Each line gives a vector of small categories
(LineStats); a Markov chain with the hidden states prose, list, table and junk emits them. Its parameters are estimated on all
documents: started from the plain lines of a tenth of them, then re-estimated by expectation and maximisation over the most likely
paths of all. The texts are read once; the rounds go over a table of the categories (one whole number a line), whose counts each task
adds up. A document's kind is the label that covers more than half of its characters. Which words are known is counted over all
documents too.

Null and empty texts have no lines: their figures are 0, their kind is 'empty'. Repeated rows are labelled alike.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import arrow_schema, chunks, discard, materialize

STATES = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)
#: Words that occur in KNOWN_IN of KNOWN_OF documents are known: of more documents in the same share.
KNOWN_IN, KNOWN_OF = 4, 3000

# Common words of the eight languages.
COMMON = frozenset(
    """
    the of and to in a is that it was for on with as by at from this are not but or which had been were nobody
    der die das und nicht sich zu den von mit ist für auf dass ein eine im haben wird aber nach bei waren gibt wenn
    le la les et des un une que pour dans est ne pas qui sur avec il plus ont par mais sont du était aux
    el los las y en de no por se una con para lo como más su al pero hay fueron sin cuando
    il lo gli che di non per una sono con del della anche ma si nel è dei fossero delle quando
    o os as e não que em um uma por com se da do para foram mais quando há
    het een van niet dat op te zijn er met voor maar ook aan worden waren als bij
    в и не на что с по это как из у за но все были к так уже если там ни
    """.split()
)
_BULLET = re.compile(r"\s*(?:[-–—•*·▪‣○●◦☐☑✓✔►»>+]|\[[ xX]?\]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)]|(?:No|Nr|Step|Item)\.? ?\d{1,3}[.:)]?|#\d{1,3})\s+")
_ITEMS = re.compile(r"[,;] | [·•/] ")
_SENTENCE = re.compile(r"(?<=[.!?…;])[\"'”’»)]*\s+")
_STOPS = (".", "!", "?", "…", "。")
_CLOSERS = "\"'”’»)] \t\r\n"
_DAMAGE = re.compile("[ÃÂÐÑâ][\u0080-¿‚-›€™œžšŸˆ˜]|[\u0080-\u009f�]")
_WORD = re.compile(r"[^\W\d_]+")
# each byte of Latin-1 that is no letter to a blank
_LETTERS = bytes(c if _WORD.fullmatch(chr(c)) else 32 for c in range(256))
_RULE = re.compile(r"[\s|+:=_-]{3,}$")
_GAPS = re.compile(r"\S {3,}\S")
#: The longest line that is one line still; a longer one without sentence ends is cut at white space.
LONG = 400
_LONG = re.compile(r"\S.{1,399}(?=\s|$)|\S{400}|\S+", re.S)
# Digits and symbols lie below U+0100, so they are counted in the bytes of what Latin-1 can hold.
_DIGITS = bytes(range(48, 58))
_SYMBOLS = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127), *range(0xA1, 0xAA), *range(0xAB, 0xB5), *range(0xB6, 0xBA), *range(0xBB, 0xC0), 0xD7, 0xF7])
#: One document in so many gives seed labels; of fewer documents than SEED_ALL every one.
SEED_EVERY, SEED_ALL = 10, 100
#: The statistics of a line depend on each other, so together they count for so much of what they would if independent.
TEMPER = 0.5
#: How many categories each feature of a line has.
SIZES = (4, 5, 5, 2, 5, 4, 5, 3, 3, 4, 4)
#: The categories of a line as one number, and where those of each feature begin among all categories.
PLACES = np.cumprod([1, *SIZES[:-1]])
OFFSETS = np.cumsum([0, *SIZES[:-1]])
#: Lines of which the rounds of the estimation hold the scores at a time.
CHUNK_LINES = 500_000


def words_of(text: str, pattern: re.Pattern = _WORD) -> list[str]:
    """What the pattern finds, which for a text within Latin-1 are runs of letters; such a text is cut as bytes, which is faster."""
    raw = text.encode("latin-1", "ignore")
    return raw.translate(_LETTERS).decode("latin-1").split() if len(raw) == len(text) else pattern.findall(text)


def finished(line: str) -> bool:
    return line.rstrip(_CLOSERS)[-1:] in _STOPS


def _marked(line: str) -> bool:
    return "|" in line or "\t" in line or "   " in line or " = " in line or " : " in line or "...." in line


def unwrapped(text: str) -> list[str]:
    """The lines of a text, where those of a hard-wrapped paragraph (hardly a line could have held the next one's first word) are joined."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        if len(held) > 2:
            width = max(map(len, held))
            full = sum(len(a) + 1 + len(b.split(None, 1)[0]) > width for a, b in pairwise(held))
            if 30 <= width <= 120 and full >= 0.9 * (len(held) - 1) and len({*held}) >= 0.7 * len(held):
                out.append(" ".join(x.strip() for x in held))
                held.clear()
        out.extend(held)
        held.clear()

    for line in text.splitlines():
        plain = line.rstrip()
        if not plain:
            end()
        elif _marked(plain) or _BULLET.match(plain) or (" " not in plain and len(plain) > 30):
            end()
            out.append(plain)
        else:
            held.append(plain)
    end()
    return out


def lines_of(text: str, whole: list[str] | None = None) -> list[str]:
    """The lines of a text; an enumeration in one line is cut into its items, another long line into its sentences, and these, if
    very long, at white space. whole: its unwrapped lines, where they are there already."""
    out = []
    for line in unwrapped(text) if whole is None else whole:
        if len(line) <= 160 and (line.count(",") + line.count("·") + line.count("•") + line.count("/") < 6 or _marked(line)):
            out.append(line)
            continue
        for s in _SENTENCE.split(line) if len(line) > 160 else (line,):
            items = _ITEMS.split(s) if len(s) > 60 else ()
            if len(items) >= 7 and len(s.split()) <= 6 * len(items) and sum(map(str.isdigit, s)) < 0.2 * len(s):
                out += [x for x in items if x.strip()]
            elif len(s) <= LONG:
                if s.strip():
                    out.append(s)
            else:
                out += _LONG.findall(s)
    return out


class Coded(NamedTuple):
    """A document as the line model sees it: the categories of its lines, its variety, the lengths of the lines, how many end as sentences do,
    and their seed labels (-1: none), if it gives any."""

    codes: np.ndarray
    variety: int
    sizes: np.ndarray
    ended: int
    seeds: np.ndarray | None


class LineStats:
    """The categories of each line of a document."""

    def __init__(self, known: frozenset[str]) -> None:
        self.known = known
        self.codes: dict[tuple[int, ...], int] = {}

    def of(self, lines: list[str]) -> list[tuple[int, ...]]:
        out = []
        cut = [words_of(line.lower()) for line in lines]
        everything = set().union(*cut)
        total = sum(map(len, cut))
        # words said again and again, as in stuffing and menus: few different ones for so many
        variety = bisect_right((0.7, 1.1, 1.6), len(everything) / total ** 0.75) if total >= 40 else 3
        repeats = Counter(lines) if len({*lines}) < len(lines) else None
        damaged = bisect_right((0.002, 0.01), sum(0 if line.isascii() else len(_DAMAGE.findall(line)) for line in lines) / max(1, sum(map(len, lines))))
        # sets of the document's words: smaller ones to meet those of a line
        usual, sure_words = COMMON & everything, self.known & everything
        all_sure = len(sure_words) == len(everything)
        for line, words in zip(lines, cut):
            n = len(words)
            kinds = {*words}
            size = len(line)
            plain = line.isascii()
            raw = line.encode("latin-1", "ignore")
            tabs = line.count("\t")
            digits, symbols = len(raw) - len(raw.translate(None, _DIGITS)), len(raw) - len(raw.translate(None, _SYMBOLS))
            dense = max(1, size - line.count(" ") - tabs)
            ends = 0 if finished(line) else 1 if n == 0 else 2 if line.rstrip()[-1:] in ":,;" else 3
            common = bisect_right((0.001, 0.12, 0.22, 0.35), len(usual & kinds) / len(kinds)) if n else 0
            tokens = len(line.split())
            length = bisect_right((2, 5, 9, 30), tokens)
            bullet = 0 if _BULLET.match(line) is None else 1
            commas, semi = line.count(","), line.count(";")
            marks = max(line.count("|"), tabs, semi)
            if "   " in line:
                marks = max(marks, len(_GAPS.findall(line)))
            if commas >= 2 and not marks and (", " not in line or digits > 0.15 * dense):
                marks = commas
            if not n and ("|" in line or "+" in line or "---" in line) and _RULE.match(line):
                fields = 4
            elif not n and not digits:
                fields = 0
            elif marks:
                fields = 3 if marks >= 2 else 2
            else:
                fields = 1 if n <= 8 and (" = " in line or ": " in line or " : " in line or "\t" in line or "..." in line) else 0
            digit = bisect_right((0.02, 0.15, 0.4), digits / dense) if digits else 0
            symbol = bisect_right((0.03, 0.07, 0.2, 0.5), symbols / dense)
            again = bisect_right((2, 4), repeats[line]) if repeats else 0
            damage = max(damaged, bisect_right((0.004, 0.04), len(_DAMAGE.findall(line)) / size)) if damaged else 0
            sure = (3 if all_sure else bisect_right((0.2, 0.5, 0.8), len(sure_words & kinds) / len(kinds))) if n else 0
            items = commas + semi + (line.count(" / ") if "/" in line else 0) + (0 if plain else line.count(" · ") + line.count(" • "))
            comma = bisect_right((0.08, 0.2), items / max(1, tokens)) if items else 0
            if comma == 2 and items >= 4:
                parts = [x.strip().lower() for x in _ITEMS.split(line)]
                comma = 2 if len({*parts}) >= 0.6 * len(parts) else 3
            out.append((ends, common, length, bullet, fields, digit, symbol, again, damage, sure, comma))
        self.variety = variety
        # most lines are short and end nowhere, as in an enumeration without marks
        self.plain = len(out) >= 5 and sum(s[0] == 3 and s[2] <= 2 and s[4] == 0 for s in out) >= 0.7 * len(out)
        return out

    def coded(self, text: str | None, seeding: bool = False, whole: list[str] | None = None) -> Coded:
        lines = lines_of(text, whole) if text else []
        if not lines:
            return Coded(np.zeros(0, np.int32), 0, np.zeros(0, np.int32), 0, np.zeros(0, np.int32) if seeding else None)
        rows = self.of(lines)
        codes = self.codes
        out = []
        for s in rows:
            at = codes.get(s)
            if at is None:
                at = codes[s] = int(PLACES @ s)
            out.append(at)
        seeds = None
        if seeding:
            sure = [seed(s, self.variety, x, self.plain) for s, x in zip(rows, lines)]
            seeds = np.array([-1 if x is None else x for x in sure], np.int32)
        return Coded(np.array(out, np.int32), self.variety, np.array([*map(len, lines)], np.int32), sum(s[0] == 0 for s in rows), seeds)


def seed(s: tuple[int, ...], variety: int, line: str, plain: bool) -> int | None:
    """A label for a line that plainly is one thing, from which the estimation starts; else None."""
    ends, common, length, bullet, fields, digit, symbol, again, damage, sure, comma = s
    if damage == 2 or again == 2 and length >= 2:
        return JUNK
    if symbol == 4 and digit == 0 and sure == 0 and fields != 4:
        return JUNK
    if fields >= 3 and (digit >= 1 or fields == 4) and common <= 1:
        return TABLE
    if fields == 1 and digit >= 1 and common <= 1:
        return TABLE
    if symbol == 4 or digit == 3 and length >= 3 and fields == 0:
        return JUNK
    if variety == 0 and common <= 1 and comma != 2 and not bullet and fields == 0 or comma == 3:
        return JUNK
    if sure == 0 and length >= 3 and common == 0 and damage == 0 and ends == 3 and not line[:1].isupper():
        return JUNK
    if length <= 1 and common == 0 and len(line) > 30 and symbol <= 2 and " " not in line.strip():
        return JUNK
    if common >= 2 and length >= 3 and fields == 0 and symbol <= 1 and again == 0 and comma <= 1 and variety >= 1:
        return PROSE
    if ends == 0 and common >= 1 and length >= 3 and again == 0 and fields == 0 and not bullet and variety >= 1:
        return PROSE
    if bullet and ends == 3 and length <= 3 and common <= 2 and fields == 0 and sure >= 1:
        return LIST
    if plain and ends == 3 and length <= 2 and fields == 0 and sure >= 2 and again <= 1 and symbol <= 3 and digit <= 2 and variety >= 1:
        return LIST
    if ends >= 2 and comma == 2 and length >= 2 and fields <= 1 and common <= 2 and sure >= 1:
        return LIST
    return None


def _digits(codes: np.ndarray, feature: int) -> np.ndarray:
    return codes // PLACES[feature] % SIZES[feature]


class LineModel:
    """Emission and transition log-probabilities, with the known words."""

    offsets = OFFSETS

    def __init__(self, known: frozenset[str], start: np.ndarray, move: np.ndarray, emit: np.ndarray, variety: np.ndarray) -> None:
        self.known, self.start, self.move, self.emit, self.variety = known, start, move, emit, variety

    @classmethod
    def of_counts(cls, known: frozenset[str], counts: np.ndarray) -> LineModel:
        """From what counted() gives, summed."""
        n = sum(SIZES)
        start, move, emit, variety = np.split(counts.astype(float), np.cumsum([4, 16, 4 * n]))
        start, move, emit, variety = 1 + start, 1 + 4 * np.eye(4) + move.reshape(4, 4), 0.5 + emit.reshape(4, n), 1 + variety.reshape(4, 4)
        parts = [emit[:, o : o + n] / emit[:, o : o + n].sum(1, keepdims=True) for o, n in zip(OFFSETS, SIZES)]
        return cls(known, np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), TEMPER * np.log(np.concatenate(parts, 1)), TEMPER * np.log(variety / variety.sum(1, keepdims=True)))

    @classmethod
    def train(cls, texts: list[str], known: frozenset[str] | None = None, rounds: int = 3) -> LineModel:
        """From texts in memory. known: words of the whole corpus (see known_words); None: of the texts."""
        if known is None:
            seen: Counter = Counter()
            for t in texts:
                seen.update({*_WORD.findall(t.lower())})
            known = frozenset(w for w, n in seen.items() if n >= KNOWN_IN)
        stats = LineStats(known)
        docs = [c for t in texts if len((c := stats.coded(t, True)).codes)]
        codes, lengths, variety = flat(docs)
        # one document in SEED_EVERY gives labelled lines to start from; all other lines get their labels from the model, again and again
        seeds = np.concatenate([np.zeros(0, np.int32), *(c.seeds if k % SEED_EVERY == 0 else np.full(len(c.codes), -1) for k, c in enumerate(docs))])
        model = None
        for _ in range(rounds + 1):
            model = cls.of_counts(known, counted(codes, lengths, variety, seeds, model))
        return model

    def paths(self, codes: np.ndarray, lengths: np.ndarray, variety: np.ndarray) -> np.ndarray:
        """The most likely labels of the lines of documents that follow each other, all documents at once."""
        labels = np.zeros(len(codes), np.int8)
        if not len(codes):
            return labels
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")[: int((lengths > 0).sum())]
        starts, lengths, own = starts[order], lengths[order], variety[order]
        kinds, which = np.unique(codes, return_inverse=True)
        seen = sum(self.emit[:, o + _digits(kinds, k)] for k, o in enumerate(self.offsets))[:, which]
        doc_variety = self.variety[:, own]
        back = np.zeros((4, len(codes)), np.int8)
        score = self.start[:, None] + seen[:, starts] + doc_variety
        for t in range(1, int(lengths[0])):
            live = int(np.searchsorted(-lengths, -t))  # documents of more than t lines
            at = starts[:live] + t
            through = score[:, None, :live] + self.move[:, :, None]
            back[:, at] = through.argmax(0)
            score[:, :live] = through.max(0) + seen[:, at] + doc_variety[:, :live]
        labels[starts + lengths - 1] = score.argmax(0)
        for t in range(int(lengths[0]) - 1, 0, -1):
            at = starts[: int(np.searchsorted(-lengths, -t))] + t
            labels[at - 1] = back[labels[at], at]
        return labels

    def decode(self, docs: list[tuple[np.ndarray, int]]) -> list[list[int]]:
        """paths() of documents given as rows of categories and varieties."""
        lengths = np.array([len(rows) for rows, _ in docs], np.int64)
        codes = np.concatenate([np.zeros(0, np.int64), *(rows @ PLACES for rows, _ in docs)])
        labels = self.paths(codes, lengths, np.array([v for _, v in docs], np.int64))
        return [x.tolist() for x in np.split(labels, np.cumsum(lengths)[:-1])] if docs else []

    def judged(self, docs: Sequence[Coded]) -> list[list[float]]:
        """The shares of each label in each document."""
        codes, lengths, variety = flat(docs)
        by = np.bincount(4 * np.repeat(np.arange(len(docs)), lengths) + self.paths(codes, lengths, variety), np.concatenate([np.zeros(0), *(c.sizes for c in docs)]), 4 * len(docs)).reshape(len(docs), 4)
        return (by / np.maximum(1, by.sum(1, keepdims=True))).tolist()

    def kinds(self, texts: list[str | None]) -> list[str]:
        stats = LineStats(self.known)
        return [kind_of(by) for by in self.judged([stats.coded(t) for t in texts])]

    def label(self, texts: list[str | None]) -> list[tuple[list[str], list[int]]]:
        """The lines of each text and their labels."""
        stats = LineStats(self.known)
        docs = [stats.coded(t) for t in texts]
        codes, lengths, variety = flat(docs)
        return [(lines_of(t) if t else [], x.tolist()) for t, x in zip(texts, np.split(self.paths(codes, lengths, variety), np.cumsum(lengths)[:-1]))]


def flat(docs: Sequence[Coded]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of all lines, the number of lines of each document, and its variety."""
    return np.concatenate([np.zeros(0, np.int32), *(c.codes for c in docs)]), np.array([len(c.codes) for c in docs], np.int64), np.array([c.variety for c in docs], np.int64)


def counted(codes: np.ndarray, lengths: np.ndarray, variety: np.ndarray, seeds: np.ndarray, model: LineModel | None) -> np.ndarray:
    """How often a document starts with each label, a label follows another, and a category and a variety go with a label. A line's label is
    its seed (-1: none), else that of the model's path; without a model it has none."""
    labels = np.where(seeds >= 0, seeds, -1 if model is None else model.paths(codes, lengths, variety)).astype(np.int64)
    has = labels >= 0
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    first = labels[starts]
    inner = np.ones(len(codes), bool)
    inner[starts] = False
    inner[1:] &= has[1:] & has[:-1]
    follows = np.flatnonzero(inner)
    kinds, which = np.unique(codes, return_inverse=True)
    by_kind = np.bincount((labels * len(kinds) + which)[has], minlength=4 * len(kinds)).reshape(4, len(kinds))
    emit = np.zeros((4, sum(SIZES)))
    for k, o in enumerate(OFFSETS):
        digits = _digits(kinds, k)
        for label in range(4):
            emit[label, o : o + SIZES[k]] = np.bincount(digits, by_kind[label], SIZES[k])
    return np.concatenate([np.bincount(first[first >= 0], minlength=4), np.bincount(4 * labels[follows - 1] + labels[follows], minlength=16), emit.ravel(), np.bincount((4 * labels + np.repeat(variety, lengths))[has], minlength=16)]).astype(np.int64)


def shares(lines: list[str], labels: list[int]) -> list[float]:
    by = [0, 0, 0, 0]
    for line, label in zip(lines, labels):
        by[label] += len(line)
    total = sum(by)
    return [b / total for b in by] if total else [0.0] * 4


def kind_of(parts: list[float]) -> str:
    """The label of more than half of the text; without one, that of most of it, prose if this is not under a half of the rest."""
    if not sum(parts):
        return "empty"
    best = max(range(4), key=lambda k: (parts[k], -k))
    if parts[best] > 0.5:
        return STATES[best]
    return STATES[PROSE] if parts[PROSE] >= 0.4 else STATES[max(range(1, 4), key=lambda k: parts[k])]


def known_words(docs: DataFrame, text: str = "text", n: int = KNOWN_OF) -> frozenset[str]:
    """The words of at least KNOWN_IN in n of all documents (and at least KNOWN_IN). Of documents with d different words on average
    these are at most d n / KNOWN_IN, however many documents there are."""
    return words_and_count(docs, text, n)[0]


def words_and_count(docs: DataFrame, text: str, n: int) -> tuple[frozenset[str], int]:
    """known_words() and the number of documents."""
    rows = docs.where(F.length(text) > 0)
    count = rows.count()
    least = max(KNOWN_IN, -(-count * KNOWN_IN // n))
    words = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)))).alias("w"))
    return frozenset(r.w for r in words.groupBy("w").count().where(F.col("count") >= least).select("w").toLocalIterator()), count


def seeding(count: int, key: str, text: str) -> Column:
    """Whether a document, of so many, gives seed labels: told by a hash, so that no partitioning changes it."""
    return F.lit(True) if count < SEED_ALL else F.pmod(F.xxhash64(key, text), F.lit(SEED_EVERY)) == 0


#: The columns that the estimation reads.
CODED = "codes array<int>, variety int, seeds array<int>"


def fit_lines(coded: DataFrame, known: frozenset[str], rounds: int = 3) -> LineModel:
    """The line model from a table with the columns CODED, one row for each document; the seeds of most documents are null."""

    def estimated(rows: DataFrame, model: LineModel | None) -> LineModel:
        shared = coded.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = counted(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), None)
            for batch in batches:
                for part in line_chunks(batch):
                    codes, variety, seeds = part.columns
                    lengths = pc.list_value_length(codes).to_numpy(zero_copy_only=False).astype(np.int64)
                    marks = np.full(int(lengths.sum()), -1)
                    marks[np.repeat(seeds.is_valid().to_numpy(zero_copy_only=False), lengths)] = pc.list_flatten(seeds).to_numpy()
                    total += counted(pc.list_flatten(codes).to_numpy(), lengths, variety.to_numpy(zero_copy_only=False), marks, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["counts"])

        counts = [np.array(r.counts, np.int64) for r in rows.mapInArrow(run, "counts array<bigint>").collect()]
        return LineModel.of_counts(frozenset(), sum(counts, np.zeros(20 + 4 * sum(SIZES) + 16, np.int64)))

    rows = coded.select("codes", "variety", "seeds").where("size(codes) > 0")
    model = estimated(rows.where("seeds is not null"), None)
    for _ in range(rounds):
        model = estimated(rows, model)
    return LineModel(known, model.start, model.move, model.emit, model.variety)


def line_chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut where its column `codes` exceeds CHUNK_LINES numbers."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(batch.schema.names.index("codes"))), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > CHUNK_LINES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows:
        yield batch.slice(start)


def coded_docs(codes: pa.Array, variety: pa.Array, sizes: pa.Array) -> list[Coded]:
    """Documents from the columns of a table; codes and sizes not null."""
    cuts = np.cumsum(pc.list_value_length(codes).to_numpy(zero_copy_only=False))[:-1]
    return [Coded(c, v, s, 0, None) for c, v, s in zip(np.split(pc.list_flatten(codes).to_numpy(), cuts), variety.to_pylist(), np.split(pc.list_flatten(sizes).to_numpy(), cuts))]


FIGURES = "words int, mean_word_length double, symbol_share double, punctuated_share double, common_share double"
KINDS = "kind string, prose double, list double, table double, junk double"


def _figures(t: str | None, c: Coded) -> tuple:
    words = words_of((t or "").lower())
    n = len(words)
    raw = (t or "").encode("latin-1", "ignore")
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    dense = sum(map(len, (t or "").split()))
    return n, sum(map(len, words)) / n if n else 0.0, symbols / dense if dense else 0.0, c.ended / len(c.codes) if len(c.codes) else 0.0, sum(map(COMMON.__contains__, words)) / n if n else 0.0


def _coded(docs: DataFrame, known: frozenset[str], seeds: Column, key: str, text: str) -> DataFrame:
    """id, the figures, and the documents as the line model sees them."""
    ddl = f"id bigint, {FIGURES}, {CODED}, sizes array<int>"
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        stats = LineStats(shared.value)
        for whole in batches:
            for part in chunks(whole, "text"):
                texts = part.column(1).to_pylist()
                coded = [stats.coded(t, s) for t, s in zip(texts, part.column(2).to_pylist())]
                cols = [*zip(*(_figures(t, c) for t, c in zip(texts, coded))), *([getattr(c, f) for c in coded] for f in ("codes", "variety", "seeds", "sizes"))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:]))], schema=schema)

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), seeds.alias("seeding")).mapInArrow(run, ddl)


def _judged(coded: DataFrame, model: LineModel, key: str) -> DataFrame:
    names = [x.split()[0] for x in FIGURES.split(", ")]
    ddl = f"id bigint, {KINDS}, {FIGURES}"
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for whole in batches:
            for part in line_chunks(whole):
                by = shared.value.judged(coded_docs(*part.columns[-3:]))
                cols = [[kind_of(b) for b in by], *zip(*([round(x, 6) for x in b] for b in by))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:])), *part.columns[1:-3]], schema=schema)

    return coded.select("id", *names, "codes", "variety", "sizes").mapInArrow(run, ddl).withColumnRenamed("id", key)


def train_lines(docs: DataFrame, key: str = "seq", text: str = "text", n: int = KNOWN_OF) -> LineModel:
    """The line model of all documents."""
    known, count = words_and_count(docs, text, n)
    coded = materialize(_coded(docs, known, seeding(count, key, text), key, text).select("codes", "variety", "seeds"), "lines")
    model = fit_lines(coded, known)
    discard(coded)
    return model


def quality(docs: DataFrame, model: LineModel, key: str = "seq", text: str = "text") -> DataFrame:
    """key, kind, the shares of the four labels, and the figures: words, mean_word_length, symbol_share (of the characters that
    are no white space), punctuated_share (of the lines), common_share (of the words)."""
    return _judged(_coded(docs, model.known, F.lit(False), key, text), model, key)


def trained_quality(docs: DataFrame, key: str = "seq", text: str = "text", n: int = KNOWN_OF) -> DataFrame:
    """quality() by train_lines(), with one reading of the texts for both."""
    known, count = words_and_count(docs, text, n)
    coded = materialize(_coded(docs, known, seeding(count, key, text), key, text), "lines")
    return _judged(coded, fit_lines(coded, known), key)
