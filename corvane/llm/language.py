"""The language of each document and of each stretch of a mixed one, by hierarchical discrimination.

A sentence is a bag of its words' character n-grams (hashed), so its score is the sum of its words' scores, and a word is scored
once. A first level of linear machines tells language families apart; within a family, one-versus-one linear support vector
machines separate the related languages by votes. They are trained here on a bounded sample of labelled rows; sentences of
that sample which the first round puts clearly elsewhere (labels are partly wrong) are left out of the second.

Full sentences (at least MIN_WORDS words and a final stop) say which languages a document has. Other stretches, such as headings, list
items and fragments, have a language of their own if that is sure (ALONE), and else go with the sentence before, or after, them; a
document without a full sentence is judged as a whole. So every sentence lies in a segment. A text without a letter, null and
empty ones included, has one row whose language is null; without labelled rows every document has. Repeated rows are labelled alike; of several labels of one key the latest counts, of equally late
ones the first in order of the alphabet.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import quality
from corvane.llm.common import arrow_schema, chunks, clean_lang, materialize
from corvane.llm.quality import LineModel, LineStats, finished, kind_of, unwrapped, words_of

FAMILIES = {"germanic": ("en", "de", "nl"), "romance": ("fr", "es", "it", "pt"), "slavic": ("ru",)}
#: Labelled documents of each language that the machines are trained on, at the most, and sentences of each document.
SAMPLE_DOCS, SAMPLE_SENTENCES = 300, 8
DIMENSIONS = 2048
#: A sentence whose language is less sure than this is no evidence of a second language in its document.
DOUBT = 0.9
#: Words and confidence with which a piece that is no full sentence has a language of its own.
ALONE_WORDS, ALONE = 6, 0.98
MIN_WORDS = 4
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+")


def sentences(text: str | None, whole: list[str] | None = None) -> list[tuple[str, bool]]:
    """The sentences of a text in order, and whether each is a full one. whole: its unwrapped lines, where they are there already."""
    out = []
    for line in whole if whole is not None else unwrapped(text) if text else ():
        for s in _SPLIT.split(line):
            if s and not s.isspace():
                out.append((s, finished(s) and s.count(" ") >= MIN_WORDS - 1))
    return out


def grams(word: str) -> list[int]:
    """Places of a word's character n-grams (one to four characters, with its ends) and of itself."""
    w = f"<{word.lower()}>"
    parts = [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]
    return [xxhash.xxh32_intdigest(p) % DIMENSIONS for p in (*parts, w, w)]


class _Numbers(dict):
    """word -> its number, made by `make` for a new one."""

    def __init__(self, make: Callable[[str], int]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> int:
        return self.make(word)


class LanguageModel:
    def __init__(self, codes: list[str], machines: list[tuple[tuple[str, ...], tuple[str, ...]]], weights: np.ndarray, bias: np.ndarray, slope: float) -> None:
        self.codes, self.machines, self.weights, self.bias, self.slope = codes, machines, weights, bias, slope
        self._setup()

    def _setup(self) -> None:
        self.words = _Numbers(self._word)
        self.rows = np.zeros((4096, len(self.machines) + 1))
        self.families = [tuple(c for c in f if c in self.codes) for f in FAMILIES.values()]
        self.families = [f for f in self.families if f]

    def __getstate__(self):
        return self.codes, self.machines, self.weights, self.bias, self.slope

    def __setstate__(self, state):
        self.codes, self.machines, self.weights, self.bias, self.slope = state
        self._setup()

    def _word(self, word: str) -> int:
        if len(self.words) >= 500_000:
            self.words.clear()
        at = self.words[word] = len(self.words)
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        g = grams(word)
        self.rows[at, :-1] = self.weights[:, g].sum(1)
        self.rows[at, -1] = len(g)
        return at

    def scores(self, texts: list[str]) -> np.ndarray:
        """The value of each machine for each text; 0 for a text without words."""
        # without an apostrophe words are runs of letters
        cut = [_WORD.findall(t) if "'" in t else words_of(t, _WORD) for t in texts]
        counts = np.array([len(w) for w in cut], np.int64)
        out = np.zeros((len(texts), len(self.machines)))
        has = counts > 0
        if has.any():
            if len(self.words) + int(counts.sum()) > 500_000 and len(self.words) > 100_000:
                self.words.clear()
            ids = np.fromiter(map(self.words.__getitem__, itertools.chain.from_iterable(cut)), np.int64, int(counts.sum()))
            sums = np.add.reduceat(self.rows[ids], (np.cumsum(counts) - counts)[has], axis=0)
            out[has] = SCALE * sums[:, :-1] / sums[:, -1:] + self.bias
        return out

    def classify(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and confidence of each text."""
        if not self.families:
            return [("", 0.0)] * len(texts)
        s = self.scores(texts)
        n = len(self.families)
        best = s[:, :n].argmax(1)
        others = np.sort(s[:, :n], axis=1)
        sure = np.minimum(others[:, -1] - others[:, -2], 4.0) if n > 1 else np.full(len(s), 4.0)
        code, margin = np.empty(len(s), object), sure.copy()
        for f, members in enumerate(self.families):
            at = np.flatnonzero(best == f)
            if not len(at):
                continue
            votes = np.zeros((len(at), len(members)))
            least = np.full((len(at), len(members)), 9.0)
            for k, (plus, minus) in enumerate(self.machines):
                if k >= n and plus[0] in members:
                    i, j, v = members.index(plus[0]), members.index(minus[0]), s[at, k]
                    votes[:, i] += v > 0
                    votes[:, j] += v <= 0
                    least[:, i] = np.minimum(least[:, i], v)
                    least[:, j] = np.minimum(least[:, j], -v)
            won = (votes + 1e-3 * np.tanh(least)).argmax(1)
            code[at] = np.array(members, object)[won]
            margin[at] = np.minimum(margin[at], np.maximum(least[np.arange(len(at)), won], 0))
        return list(zip(code.tolist(), (1 / (1 + np.exp(-self.slope * margin))).tolist()))

    @classmethod
    def train(cls, labelled: list[tuple[str, str]]) -> LanguageModel:
        """From (text, language code) of documents, some of them labelled wrongly."""
        texts, codes = [], []
        for text, code in labelled:
            full = [s for s, whole in sentences(text) if whole][:SAMPLE_SENTENCES]
            texts += full
            codes += [code] * len(full)
        known = sorted({*codes})
        families = [tuple(c for c in f if c in known) for f in FAMILIES.values()]
        families = [f for f in families if f]
        machines = [(f, tuple(c for c in known if c not in f)) for f in families] if len(families) > 1 else [(families[0], ())] if families else []
        machines += [((a,), (b,)) for f in families for a, b in itertools.combinations(f, 2)]
        x = np.zeros((len(texts), DIMENSIONS), np.float32)
        kept: dict[str, list[int]] = {}
        for row, t in zip(x, texts):
            at = [g for w in _WORD.findall(t) for g in (kept.get(w) or kept.setdefault(w, grams(w)))]
            row[:] = np.bincount(at, minlength=DIMENSIONS) * (SCALE / max(1, len(at))) if at else 0
        y = np.array(codes)
        use = np.ones(len(y), bool)
        held = np.arange(len(y)) % 5 == 4  # for the slope of the confidence
        model = None
        for _ in range(2):
            weights, bias = np.zeros((len(machines), DIMENSIONS), np.float32), np.zeros(len(machines))
            for k, (plus, minus) in enumerate(machines):
                rows = use & ~held & np.isin(y, [*plus, *minus])
                if minus and rows.any():
                    weights[k], bias[k] = _machine(x[rows], np.where(np.isin(y[rows], plus), 1.0, -1.0))
            model = cls(known, machines, weights, bias, 3.0)
            said = model.classify(texts)
            use = np.array([c == z or p < 0.8 for (c, p), z in zip(said, y)], bool)
        right = np.array([c == z for (c, _), z in zip(said, y)], bool)[held & use]
        odds = np.array([np.log(p / max(1e-9, 1 - p)) / 3.0 for _, p in said], float)[held & use]
        if len(right):
            slopes = np.array([0.5, 1, 2, 3, 4, 6, 8])
            p = 1 / (1 + np.exp(-slopes[:, None] * odds))
            model.slope = float(slopes[np.where(right, np.log(p), np.log1p(-np.minimum(p, 1 - 1e-9))).sum(1).argmax()])
        return model


SCALE = 20.0


def _machine(x: np.ndarray, y: np.ndarray, epochs: int = 25, batch: int = 128, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine by averaged stochastic subgradients; both classes weigh the same."""
    rng = np.random.default_rng(3)
    order = rng.permutation(len(y))
    x, y = x[order], y[order]  # mixed once, so that every batch is one piece of memory; batches come in another order each time
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    w, b, mean, offset, steps, t = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0, 0, 0
    starts = np.arange(0, len(y), batch)
    for epoch in range(epochs):
        for k in rng.permutation(starts):
            rows = slice(k, k + batch)
            t += 1
            rate = 0.5 / (1 + 0.02 * t)
            out = (y[rows] * (x[rows] @ w + b) < 1) * y[rows] * weight[rows]
            w = (1 - rate * penalty) * w + (rate / len(out)) * (out.astype(np.float32) @ x[rows])
            b += rate * out.mean()
            if epoch >= epochs // 2:
                mean += w
                offset, steps = offset + b, steps + 1
    return mean / max(1, steps), offset / max(1, steps)


def latest_labels(labels: DataFrame, key: str = "seq", lang: str = "lang", at: str = "labelled_at") -> DataFrame:
    """key, label (a two-letter code, or null where the latest label names no known language)."""
    rows = labels.select(F.col(key).alias("k"), clean_lang(lang).alias("l"), F.col(at).alias("t")).where("k is not null")
    # the greatest (time, then label in reverse): an aggregate, so a key of many labels is reduced before the shuffle
    return rows.groupBy("k").agg(F.max(F.struct("t", F.coalesce(F.translate("l", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"), F.lit("")).alias("r"))).alias("m")).select(
        F.col("k").alias(key), F.when(F.col("m.r") != "", F.translate("m.r", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba")).alias("label")
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "seq", text: str = "text", n: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """Of each language the n labelled documents whose keys have the least hashes."""
    first = labels.where("label is not null").withColumn("n", F.row_number().over(Window.partitionBy("label", F.pmod(F.xxhash64(key), F.lit(64))).orderBy(F.xxhash64(key, F.lit(1)), key))).where(F.col("n") <= n)
    chosen = first.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64(key, F.lit(1)), key))).where(F.col("n") <= n).select(key, "label")
    # at most n rows for each of the known languages
    rows = docs.select(key, F.col(text).alias("t")).join(F.broadcast(chosen), key).where("t is not null").select(key, "t", "label")
    return [(r.t, r.label) for r in sorted(rows.collect(), key=lambda r: (r.label, str(r[0]), r.t))]


def languages(docs: DataFrame, model: LanguageModel, lines: LineModel | None = None, key: str = "seq", text: str = "text", label: str | None = None) -> DataFrame:
    """One row for each stretch in one language: key, label, kind, segment (from 0), lang, confidence (mean over its sentences), sentences
    (all of the stretch), and of the document lang_sentences (full sentences in that language), languages (those with at least two) and
    main (the language of most full sentences). kind is that of the line model; only documents whose label doesn't say what the text says
    are asked for it, others have null."""
    return _stretches(docs, model, lines, None, F.lit(False), key, text, label).withColumnRenamed("id", key)


STRETCHES = "id bigint, label string, kind string, segment int, lang string, confidence double, sentences int, lang_sentences int, languages int, main string"


def _stretches(docs: DataFrame, model: LanguageModel, lines: LineModel | None, known: frozenset[str] | None, seeds: Column, key: str, text: str, label: str | None) -> DataFrame:
    """languages(); with known words, the columns that the line model is estimated on besides: those of a document on its first row, and on all rows of
    one that is to be asked for its kind, which has the lengths of its lines too."""
    ddl = STRETCHES + (f", {quality.CODED}, sizes array<int>" if known is not None else "")
    shared = docs.sparkSession.sparkContext.broadcast((model, lines, known))
    kept = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"), seeds.alias("seeding"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        model, lines, known = shared.value
        stats = LineStats(known) if known is not None else None
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, texts, labels, seeding = (part.column(k).to_pylist() for k in range(4))
                wholes = [unwrapped(t) if t else [] for t in texts]
                cut = [sentences(t, w) if model.families else [] for t, w in zip(texts, wholes)]
                cut = [[(x, f) for x, f in c if f or _WORD.search(x)] for c in cut]
                # a document without a full sentence is one piece; of others, pieces too short to have a language of their own aren't asked
                asked = [[x for x, f in c if f or x.count(" ") >= ALONE_WORDS - 1] if any(f for _, f in c) else [" ".join(x for x, _ in c)] if c else [] for c in cut]
                said = iter(model.classify([x for a in asked for x in a]))
                rows: list[list] = []
                ask: dict[int, str | None] = {}
                for i, c in enumerate(cut):
                    got = [next(said) for _ in asked[i]]
                    if not got:
                        rows.append([i, 0, None, 0.0, len(c), 0, 0, None])
                        continue
                    if not any(f for _, f in c):
                        rows.append([i, 0, got[0][0], got[0][1], len(c), 0, 0, got[0][0]])
                        continue
                    got = iter(got)
                    by = [(f, *(next(got) if f or x.count(" ") >= ALONE_WORDS - 1 else (None, 0.0))) for x, f in c]
                    counts = Counter(z for f, z, _ in by if f)
                    main = min(counts, key=lambda z: (-counts[z], z))
                    # a doubtful sentence is taken for one in the language of most
                    by = [(f, main, 1 - p) if f and z != main and p < DOUBT else (f, z if f or p >= ALONE else None, p) for f, z, p in by]
                    counts = Counter(z for f, z, _ in by if f)
                    several = sum(n > 1 for n in counts.values())
                    if (lines or stats) is not None and (several > 1 or labels[i] != main):
                        ask[i] = None
                    last = next(z for _, z, _ in by if z is not None)
                    parts: list[tuple[str, float | None]] = []
                    for _, z, p in by:
                        parts.append((z or last, p if z else None))
                        last = z or last
                    for n, (z, group) in enumerate(itertools.groupby(parts, key=lambda r: r[0])):
                        p = [q for _, q in group]
                        rows.append([i, n, z, float(np.mean([q for q in p if q is not None])), len(p), counts[z], several, main])
                if lines is not None:
                    ask = dict(zip(ask, lines.kinds([texts[i] for i in ask])))
                cols = [[ids[r[0]] for r in rows], [labels[r[0]] for r in rows], [ask.get(r[0]) for r in rows], *([r[k] for r in rows] for k in range(1, 8))]
                if stats is not None:
                    coded = [stats.coded(t, s, w) for t, s, w in zip(texts, seeding, wholes)]
                    own = [coded[r[0]] if r[1] == 0 or r[0] in ask else None for r in rows]
                    cols += [[c and getattr(c, f) for c in own] for f in ("codes", "variety", "seeds")] + [[c.sizes if r[0] in ask else None for r, c in zip(rows, own)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return kept.mapInArrow(run, ddl)


def _with_kinds(rows: DataFrame, lines: LineModel, key: str) -> DataFrame:
    """The stretches with the kinds of the documents that have lengths of lines."""
    shared = rows.sparkSession.sparkContext.broadcast(lines)
    names = [f.split()[0] for f in STRETCHES.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(STRETCHES)
        for batch in batches:
            for part in quality.line_chunks(batch):
                asked = part.column(len(names) + 2).is_valid()
                some = part.filter(asked)
                said = iter(shared.value.judged(quality.coded_docs(*some.columns[len(names) :])))
                kinds = [kind_of(next(said)) if a else None for a in asked.to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(kinds, pa.string()), *part.columns[3 : len(names)]], schema=schema)

    return rows.select(*names, "codes", "variety", "sizes").mapInArrow(run, STRETCHES).withColumnRenamed("id", key)


def label_documents(docs: DataFrame, labels: DataFrame, key: str = "seq", text: str = "text") -> DataFrame:
    """languages() of documents with delivered labels, by language machines trained on a sample of both tables and a line model estimated on
    all documents. The texts are read once for the stretches and the line model."""
    latest = latest_labels(labels, key)
    model = LanguageModel.train(labelled_sample(docs, latest, key, text))
    joined = docs.select(key, text).join(latest, key, "left")
    if not model.families:
        return languages(joined, model, None, key, text, "label")  # nothing is asked for its kind
    known, count = quality.words_and_count(docs, text, quality.KNOWN_OF)
    rows = materialize(_stretches(joined, model, None, known, quality.seeding(count, key, text), key, text, "label"), "stretches")
    return _with_kinds(rows, quality.fit_lines(rows.where("segment = 0"), known), key)


def mislabelled(rows: DataFrame, key: str = "seq") -> DataFrame:
    """key, lang: the languages of at least two full sentences of each document of prose that lacks a label, is labelled wrongly or mixes languages."""
    return rows.where("kind = 'prose' and lang_sentences >= 2 and (label is null or languages > 1 or label <> lang)").select(key, "lang").distinct()
