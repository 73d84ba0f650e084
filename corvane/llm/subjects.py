"""The subject areas of each document, by a chain of calibrated classifiers with beam search.

Terms are the words whose documents, in their language, gather in a few subjects: their weights come from a bounded sample of labelled
documents and, in further rounds, from unlabelled ones with the subjects found so far. A sentence is on the subject for which its terms
speak most, within what its document is about; without terms it is on none. A document's features are, by subject, the share of its words in sentences on that subject (terms), and its
source, length and share of words on no subject (structure). The chain's step k predicts subject k from these and from the
labels of the steps before, so that it learns which subjects go together. Labels by hand that the first fit finds next to impossible
are left out of the second, and each step's scores are calibrated on a held-out fifth. The combination of labels that a beam search
finds most likely is the answer: nothing is added to it or taken away. What share of its words a document must spend on a
subject is learnt from the labels; LEAST only says where the features bend and which unlabelled documents serve as examples.

Null and empty texts have no subjects. A document that occurs in several rows gets rows for each. Labels that name no
known subject, and repeated ones, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SOURCE_ALIASES, arrow_schema, chunks, clean_source, hash_sample

#: Labelled and unlabelled documents that the models are estimated on, about.
SAMPLE_LABELLED, SAMPLE_OTHERS = 4000, 4000
BEAM = 8
#: Where the features of a share bend: below the lower bound nobody would name a subject, above the upper one all would.
LEAST = 0.25
BENDS = (0.4 * LEAST, LEAST, 1.6 * LEAST)
#: A label by hand of a smaller probability in the first fit is left out of the second.
UNLIKELY = 0.02
#: Subjects are areas of a catalogue; a longer list than this is refused.
MOST_SUBJECTS = 200
SOURCES = [*sorted({*SOURCE_ALIASES.values()}), "unknown"]
# Words that tell the language of a text, so that each language gets word distributions of its own.
MARKERS = {
    "en": "the of and was that it by for with as are",
    "de": "der die das und nicht sich den von mit ist dass ein",
    "fr": "les des et que une dans est pas qui sur pour ont",
    "es": "los las el en y que por una con para se del",
    "it": "gli che di non per sono della con anche nel si è",
    "pt": "os as não em um uma com do da para há e",
    "nl": "het een van niet dat op zijn er met voor de te",
    "ru": "и в не на что с по это как из у за",
}
_MARKER = {w: [c for c, ws in MARKERS.items() if w in ws.split()] for ws in MARKERS.values() for w in ws.split()}
#: A term occurs in so many documents, and its documents' subjects are, for such shares, the most frequent one and three.
TERM_DOCS, TERM_SHARE, TERM_THREE = 4, 0.25, 0.75
#: In so many, in the first round and a language of few documents.
RARE_DOCS = 2
#: How many times as frequent as elsewhere a term has to be, in documents times logarithm.
TERM_LIFT = 7.0
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n+")
LONG_SENTENCE = 60


def cut(text: str | None) -> list[list[str]]:
    """The words of each sentence; one of more than LONG_SENTENCE words is cut into runs of a third of that."""
    out = []
    for s in _SENTENCE.split(text.lower()) if text else ():
        w = _WORD.findall(s)
        if len(w) <= LONG_SENTENCE:
            if w:
                out.append(w)
        else:
            step = LONG_SENTENCE // 3
            out += [w[i : i + step] for i in range(0, len(w), step)]
    return out


def language_of(sentences: list[list[str]]) -> str:
    """The language whose markers are most frequent; '' without any."""
    hits: dict[str, int] = {}
    for s in sentences:
        for w in s:
            for c in _MARKER.get(w, ()):
                hits[c] = hits.get(c, 0) + 1
    return min(hits, key=lambda c: (-hits[c], c)) if hits else ""


class SubjectModel:
    def __init__(self, subjects: list[str]) -> None:
        self.subjects = subjects
        self.vocab: dict[str, dict[str, int]] = {}
        self.weights = np.zeros((1, len(subjects)))  # by term; row 0: a word that is no term
        self.chain: list[np.ndarray] = []

    # -- sentences

    def _flat(self, docs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids (0: unknown) of all sentences, words of each sentence, sentences of each document."""
        out: list[int] = []
        for d in docs:
            get = self.vocab.get(language_of(d), {}).get
            for s in d:
                out += [get(w, 0) for w in s]
        ids = np.array(out, np.int64)
        return ids, np.array([len(s) for d in docs for s in d], np.int64), np.array([len(d) for d in docs], np.int64)

    def posteriors(self, ids: np.ndarray, lengths: np.ndarray, doc_of: np.ndarray, docs: int) -> np.ndarray:
        """By sentence the probability of each subject and, last, of none. The second pass takes each document's own make-up into account."""
        k = len(self.subjects)
        p = np.zeros((len(lengths), k + 1))
        if not len(lengths):
            return p
        starts = np.cumsum(lengths) - lengths
        sums = np.add.reduceat(self.weights[ids], starts, axis=0)
        on = (np.add.reduceat((ids > 0).astype(np.int64), starts) > 0) & (sums.max(1) > 0.5)
        prior = np.zeros((docs, k))
        for _ in range(2):
            x = sums[on] + prior[doc_of[on]]
            x = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
            p[on, :k] = x / x.sum(1, keepdims=True) if len(x) else x
            mass = np.zeros((docs, k))
            np.add.at(mass, doc_of[on], p[on, :k] * lengths[on, None])
            prior = np.log((mass + 3) / (mass.sum(1, keepdims=True) + 3 * k))
        p[~on, k] = 1
        return p

    def _terms(self, docs: list[list[list[str]]], langs: list[str], labels: list[frozenset[str]], first: bool) -> None:
        """Terms and weights by language, from documents with subjects."""
        k = len(self.subjects)
        at = {s: j for j, s in enumerate(self.subjects)}
        self.vocab, rows = {}, [np.zeros(k)]
        main, *rest = sorted({*langs}, key=lambda c: (-langs.count(c), c)) or [""]
        common = {w for d, c in zip(docs, langs) if c == main for s in d for w in s}
        for lang in [main, *rest]:
            counts: dict[str, np.ndarray] = {}
            size = np.zeros(k)
            for d, c, of in zip(docs, langs, labels):
                if c != lang or not of:
                    continue
                share = np.zeros(k)
                share[[at[s] for s in of]] = 1 / len(of)
                size += share
                for w in {w for s in d for w in s}:
                    if w in counts:
                        counts[w] += share
                    else:
                        counts[w] = share.copy()
            # In languages of few documents rarer words serve at first, unless the main language has them too, as it has names
            # (but not with the same subject): later rounds see more documents and hold all to one measure.
            rare = first and lang != main
            least = RARE_DOCS if rare else TERM_DOCS
            words = sorted(w for w, c in counts.items() if c.sum() >= (TERM_DOCS if w in common else least) - 0.01)
            if not words:
                continue
            n = np.array([counts[w] for w in words])
            rate = (n + 0.02) / (size + 1)
            share = rate / rate.sum(1, keepdims=True)
            order = np.sort(share, axis=1)
            top = share.argmax(1)
            lift = n[np.arange(len(n)), top] * np.log(np.maximum(share.max(1) * k, 1e-9))
            keep = (order[:, -1] >= max(TERM_SHARE, min(0.9, 1.5 / k)))  # of few subjects, each has much of any word
            keep &= (order[:, -3:].sum(1) >= TERM_THREE) & (lift >= np.where([rare and w not in common for w in words], TERM_LIFT * RARE_DOCS / TERM_DOCS, TERM_LIFT))
            self.vocab[lang] = {words[i]: len(rows) + r for r, i in enumerate(np.flatnonzero(keep))}
            rows += list(np.log(np.maximum(share[keep], 0.01) * k))
        self.weights = np.array(rows)

    def fit(self, texts: list[str], labels: list[frozenset[str]], sources: list[str], rounds: int = 3) -> None:
        """labels: the subjects of each text; an empty set: not labelled."""
        if not self.subjects:
            return
        docs = [cut(t) for t in texts]
        langs = [language_of(d) for d in docs]
        k = len(self.subjects)
        taken = labels
        for r in range(rounds):
            self._terms(docs, langs, taken, r == 0)
            if r + 1 < rounds:
                # labels are partly wrong or missing: what the terms say plainly counts
                x = self.features(docs, sources)[:, : 2 * k : 2]
                taken = [frozenset(s for j, s in enumerate(self.subjects) if row[j] >= (0.1 if s in of else 0.4 if of else LEAST)) for row, of in zip(x, labels)]
        x = self.features(docs, sources)
        use = np.array([bool(of) for of in labels], bool)
        # documents that nobody labelled are examples of no subject only where next to nothing in them is on one
        plain = ~use & (x[:, : 2 * k : 2].max(1) < 0.1) if len(x) else use
        y = np.array([[s in of for s in self.subjects] for of in labels], float).reshape(len(labels), k)
        rows = use | plain
        self.chain = []
        if rows.any():
            x, y = x[rows], y[rows]
            held = np.arange(len(x)) % 5 == 4
            # what holds for any subject is fitted on all of them together; a step departs from it as far as its own labels say
            alone = [self._step(x[~held], np.zeros((int((~held).sum()), 0)), j) for j in range(k)]
            common = _logistic(np.concatenate(alone), np.concatenate([y[~held, j] for j in range(k)]))
            for j in range(k):
                step, fit = self._step(x, y[:, :j], j), ~held
                start = np.concatenate([common, np.zeros(j)])
                w = _logistic(step[fit], y[fit, j], start)
                p = 1 / (1 + np.exp(-np.clip(step @ w, -30, 30)))
                fit &= np.where(y[:, j] > 0, p, 1 - p) >= UNLIKELY
                w = _logistic(step[fit], y[fit, j], start)
                self.chain.append(_calibrated(w, step[held], y[held, j]))

    # -- documents

    def features(self, docs: list[list[list[str]]], sources: list[str]) -> np.ndarray:
        """share and strong share by subject (2k), share on none, log of words, source."""
        k = len(self.subjects)
        ids, lengths, per = self._flat(docs)
        out = np.zeros((len(docs), 2 * k + 2 + len(SOURCES)))
        if len(docs):
            doc_of = np.repeat(np.arange(len(docs)), per)
            p = self.posteriors(ids, lengths, doc_of, len(docs))
            words = np.bincount(doc_of, lengths, len(docs))
            if len(p):
                best = p.argmax(1)
                hard = np.zeros((len(docs), k + 1))
                np.add.at(hard, (doc_of, best), lengths)
                soft = np.zeros((len(docs), k + 1))
                np.add.at(soft, doc_of, p * lengths[:, None])
                hard, soft = hard / np.maximum(1, words)[:, None], soft / np.maximum(1, words)[:, None]
                out[:, : 2 * k : 2], out[:, 1 : 2 * k : 2], out[:, 2 * k] = hard[:, :k], soft[:, :k], hard[:, k]
            out[:, 2 * k + 1] = np.log1p(words) / 10
            out[np.arange(len(docs)), 2 * k + 2 + np.array([SOURCES.index(s) if s in SOURCES else len(SOURCES) - 1 for s in sources], np.int64)] = 0.1
        return out

    def _step(self, x: np.ndarray, before: np.ndarray, j: int) -> np.ndarray:
        """What step j of the chain sees: its own shares, bent at BENDS, the largest other share, structure, source and the labels before."""
        k = len(self.subjects)
        own, soft = x[:, 2 * j], x[:, 2 * j + 1]
        others = np.delete(x[:, : 2 * k : 2], j, 1).max(1, initial=0)
        bent = [np.clip((v - a) / (b - a), 0, 1) for v in (own, soft) for a, b in zip((0.0, *BENDS[:-1]), BENDS)]
        return np.column_stack([np.ones(len(x)), own, soft, *bent, others, x[:, 2 * k :], before])

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely combination of labels of each row, by beam search."""
        n, k = len(x), len(self.subjects)
        if not self.chain or not n:
            return np.zeros((n, k), bool)
        beams, scores = np.zeros((n, 1, 0)), np.zeros((n, 1))
        for j in range(k):
            b = beams.shape[1]
            z = self._step(np.repeat(x, b, 0), beams.reshape(n * b, j), j) @ self.chain[j]
            yes, no = -np.logaddexp(0, -z).reshape(n, b), -np.logaddexp(0, z).reshape(n, b)
            both = np.concatenate([scores + no, scores + yes], 1)
            wide = np.concatenate([np.concatenate([beams, np.zeros((n, b, 1))], 2), np.concatenate([beams, np.ones((n, b, 1))], 2)], 1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :BEAM]
            scores, beams = np.take_along_axis(both, top, 1), np.take_along_axis(wide, top[:, :, None], 1)
        return beams[:, 0] > 0

    def subjects_of(self, texts: list[str | None], sources: list[str]) -> list[tuple[int, int, float]]:
        """(text number, subject number, share of its words) of all texts."""
        if not self.subjects:
            return []
        x = self.features([cut(t) for t in texts], sources)
        given = self.decode(x)
        return [(int(i), int(j), float(x[i, 2 * j])) for i, j in zip(*np.nonzero(given))]


def _logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, penalty: float | np.ndarray = 0.3, rounds: int = 100) -> np.ndarray:
    """Logistic regression by Newton's method, whose weights are held to those of start (none: 0); a scalar penalty leaves the first one free.
    A step that would not lower the loss is halved, as on labels that are nearly separable a whole one leads away and never back."""
    start = np.zeros(x.shape[1]) if start is None else start
    held = np.concatenate([[1e-6], np.full(x.shape[1] - 1, penalty)]) if np.isscalar(penalty) else penalty

    def loss(w: np.ndarray, z: np.ndarray) -> float:
        return float((np.logaddexp(0, z) - y * z).sum() + held @ (w - start) ** 2 / 2)

    w, z = start.copy(), x @ start
    now = loss(w, z)
    for _ in range(rounds):
        p = np.exp(-np.logaddexp(0, -z))
        down = x.T @ (y - p) - held * (w - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(held), down)
        size = 1.0
        # a whole step at the end changes nothing but the last digits of the loss
        while (then := loss(w + size * step, x @ (w + size * step))) > now - 1e-4 * size * (down @ step) + 1e-9 * abs(now) and size > 1e-9:
            size /= 2
        if size <= 1e-9:
            break
        w = w + size * step
        z, now = x @ w, then
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def _calibrated(w: np.ndarray, x: np.ndarray, y: np.ndarray, penalty: float = 3.0) -> np.ndarray:
    """Weights whose scores are stretched and shifted so that their probabilities fit rows held out; with few rows they hardly change."""
    z = np.clip(x @ w, -30, 30)
    a = _logistic(np.column_stack([np.ones(len(z)), z]), y, np.array([0.0, 1.0]), np.full(2, penalty))  # shift and stretch, held to these values
    a[1] = max(a[1], 0.1)
    out = a[1] * w
    out[0] += a[0]
    return out


def clean_labels(labels: DataFrame, areas: list[str], doc_id: str = "doc_id", subject: str = "subject") -> DataFrame:
    return labels.select(F.col(doc_id).alias("k"), F.lower(F.trim(F.regexp_replace(subject, r"\s+", " "))).alias("s")).where(F.col("s").isin(areas) & F.col("k").isNotNull()).distinct()


def train_subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> SubjectModel:
    names = [r[0] for r in areas.select("subject").where("subject is not null").distinct().orderBy("subject").limit(MOST_SUBJECTS + 1).collect()]
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    by = {n.lower().strip(): n for n in names}
    known = clean_labels(labels, [*by])
    chosen = hash_sample(known.groupBy("k").agg(F.sort_array(F.collect_set("s")).alias("labels")), "k", SAMPLE_LABELLED)
    others = hash_sample(docs.select(F.col(doc_id).alias("k")).where("k is not null"), "k", SAMPLE_OTHERS).select("k", F.array().cast("array<string>").alias("labels"))
    # about SAMPLE_LABELLED + SAMPLE_OTHERS rows and never twice as many; a document in both keeps its labels
    both = chosen.unionByName(others).groupBy("k").agg(F.max("labels").alias("labels"))
    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t"), clean_source(source).alias("src")).join(F.broadcast(both), "k").where("t is not null").limit(4 * (SAMPLE_LABELLED + SAMPLE_OTHERS)).collect()
    rows.sort(key=lambda r: (r.k, r.t))
    model = SubjectModel(names)
    model.fit([r.t for r in rows], [frozenset(by[s] for s in r.labels) for r in rows], [r.src for r in rows])
    return model


def document_subjects(docs: DataFrame, model: SubjectModel, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, subject, share (of its words that are on it): the subjects of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = "id bigint, subject string, share double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for part in chunks(whole, "text"):
                ids, texts, sources = (part.column(k).to_pylist() for k in range(3))
                found = m.subjects_of(texts, sources)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _, _ in found], pa.int64()), pa.array([m.subjects[j] for _, j, _ in found], pa.string()), pa.array([round(s, 6) for _, _, s in found], pa.float64())], schema=arrow_schema(ddl))

    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), clean_source(source).alias("src")).mapInArrow(run, ddl).withColumnRenamed("id", doc_id)
