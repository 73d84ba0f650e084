"""A training mix whose sources hold target shares of its tokens, by soft membership.

A classifier over words and web host is trained on a bounded sample of the labelled table (documents of a known source). For every
document it gives the posterior of each source; a document's own label is further evidence, wrong with a probability that is
estimated from the sample too (labels that the classifier, trained without them, contradicts). So a document belongs to its labelled
source as surely as labels and text allow, and a table of wrong labels is mixed by what its texts are.

Documents of one label and equal (quantised) membership get equal rates, so tokens are summed by them in one aggregation. The rates, between
0 and max_repeats of the label, whose expected tokens by source come nearest to the targets in the (weighted) least-squares sense are
found by projected gradient steps: each step's sums over the groups are made by the executors, which repeat the steps before from the
few numbers, one for each source, that the driver keeps of each. A rate becomes whole numbers of uses: each document its whole
part, and one more for documents in the order of a hash until the tokens of the remainders are reached.

This project's data say that rows of an unknown source belong to none; they take no part unless use_unlabelled is set, and then under
the label that their text makes the likeliest. Copies of one text count as one document (the one with the least id), whatever their number, so no text is
used more often than max_repeats. Targets without documents stay at nothing; the others keep their proportions. Null and empty texts hold no
tokens and aren't used. Null targets and repeats of 0 mean none; of a target listed twice the greatest share holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.bpe import Tokenizer
from corvane.llm.common import Ids, arrow_schema, chunks, clean_domain, clean_source, hash_sample, map_rows, materialize
from corvane.llm.token_budget import token_counts

#: Labelled documents that the classifier is trained on, about; slots of its hashed features.
SAMPLE, SLOTS = 4000, 1 << 14
SMOOTH = 1e-3
#: Steps in which a membership is kept.
QUANTA = 32
#: Parts of the remainders 0 to 1 within which documents get their last use, and of a source by hash.
POOLS, PARTS = 64, 4096
MOST_TARGETS = 10_000
#: Gradient steps at the most, and the change of the expected tokens at which they end.
STEPS, STILL = 200, 1e-7
TEMPERS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0)
_WORD = re.compile(r"[^\W\d_]+")


class DomainModel:
    """Multinomial naive Bayes over hashed words and the web host, tempered to fit held-out labels, and the share of wrong labels."""

    def __init__(self, domains: list[str], logs: np.ndarray, prior: np.ndarray, temper: float = 0.2, wrong: float = 0.0) -> None:
        self.domains, self.logs, self.prior, self.temper, self.wrong = domains, logs, prior, temper, wrong
        self.at = {d: i for i, d in enumerate(domains)}
        self.slots = Ids(lambda w: xxhash.xxh32_intdigest(w) % SLOTS)

    def __reduce__(self):
        return DomainModel, (self.domains, self.logs, self.prior, self.temper, self.wrong)

    @staticmethod
    def features(text: str | None, host: str, slots: Ids) -> list[int]:
        return [slots[w] for w in (*{*_WORD.findall((text or "").lower())}, *[f"host:{host}"] * 5)]

    @classmethod
    def train(cls, rows: list[tuple[str | None, str, str]]) -> DomainModel:
        """From (text, host, label), some of them labelled wrongly."""
        domains = sorted({d for _, _, d in rows})
        slots = Ids(lambda w: xxhash.xxh32_intdigest(w) % SLOTS)
        at = [cls.features(t, h, slots) for t, h, _ in rows]
        y = np.array([domains.index(d) for _, _, d in rows], np.int64)

        def fit(keep: np.ndarray) -> DomainModel:
            # hardly any smoothing: it would make the words of small domains look rarer
            counts, prior = np.full((len(domains), SLOTS), SMOOTH), np.ones(len(domains))
            for i in np.flatnonzero(keep):
                np.add.at(counts[y[i]], at[i], 1.0)
                prior[y[i]] += 1
            return cls(domains, np.log(counts / counts.sum(1, keepdims=True)), np.log(prior / prior.sum()))

        out = fit(np.ones(len(y), bool))
        if len(rows) < 2 or len(domains) < 2:
            return out
        # each row is judged by a model of the other half
        sums, base = np.zeros((len(y), len(domains))), np.zeros((len(y), len(domains)))
        for half in (0, 1):
            m = fit(np.arange(len(y)) % 2 != half)
            for i in range(half, len(y), 2):
                sums[i], base[i] = m.logs[:, at[i]].sum(1), m.prior
        mine = np.arange(len(y)), y
        best = -np.inf
        for temper in TEMPERS:
            p = _softmax(base + temper * sums)
            fits = np.log(0.95 * p[mine] + 0.05 / len(domains)).sum()  # a wrong label costs little
            if fits > best:
                best, out.temper, judged = fits, temper, p
        # the share of wrong labels, by expectation and maximisation; where texts tell nothing it goes to 0
        wrong, others = 0.02, len(domains) - 1
        for _ in range(60):
            right = judged[mine] * (1 - wrong)
            false = (1 - judged[mine]) * wrong / others
            wrong = float((false / np.maximum(1e-300, right + false)).sum() / (1.05 * len(y)))
        out.wrong = wrong
        return out

    def posterior(self, text: str | None, host: str, label: str | None = None) -> np.ndarray:
        """By domain. Words of a text depend on each other, hence temper."""
        p = _softmax((self.prior + self.temper * self.logs[:, self.features(text, host, self.slots)].sum(1))[None])[0] if self.domains else np.zeros(0)
        if label in self.at and len(self.domains) > 1:
            says = np.full(len(p), self.wrong / (len(p) - 1))
            says[self.at[label]] = 1 - self.wrong
            p = p * says
            p = p / p.sum() if p.sum() > 0 else np.eye(len(p))[self.at[label]]
        return p


def _softmax(s: np.ndarray) -> np.ndarray:
    p = np.exp(s - s.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train_domains(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", domain: str = "domain") -> DomainModel:
    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t"), clean_domain(domain).alias("h"), clean_source(source).alias("s")).where("s <> 'unknown' and k is not null")
    return DomainModel.train([(r.t, r.h, r.s) for r in sorted(hash_sample(rows, "k", SAMPLE).collect(), key=lambda r: (r.k, r.t or "", r.s, r.h))])


def posteriors(docs: DataFrame, model: DomainModel, doc_id: str = "doc_id", text: str = "text", source: str = "source", domain: str = "domain") -> DataFrame:
    """doc_id, label, source, posterior: how far each document belongs to each source (label: its own, or 'unknown')."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), clean_domain(domain).alias("h"), clean_source(source).alias("s"))

    def run(c: dict[str, list]) -> dict[str, list]:
        m = shared.value
        p = [m.posterior(t, h, s) for t, h, s in zip(c["text"], c["h"], c["s"])]
        k = len(m.domains)
        return {"id": [i for i in c["id"] for _ in range(k)], "label": [s for s in c["s"] for _ in range(k)], "source": m.domains * len(p), "posterior": [round(float(x), 9) for row in p for x in row]}

    return map_rows(rows, run, "id bigint, label string, source string, posterior double", "text").withColumnRenamed("id", doc_id)


def quantised(p: np.ndarray, places: list[int]) -> str:
    """A membership as text: place:units of QUANTA, rounded by largest remainders; places that are -1 are no target and left out."""
    x = p * QUANTA
    units = np.floor(x + 1e-9).astype(int)
    short = QUANTA - int(units.sum())
    if short > 0:
        units[np.argsort(-(x - units), kind="stable")[:short]] += 1
    return ",".join(f"{places[i]}:{units[i]}" for i in np.flatnonzero(units) if places[i] >= 0)


def memberships(rows: DataFrame, model: DomainModel, names: list[str]) -> DataFrame:
    """rows (id, source, host, text, ...) with `member`, the membership in the targets, in place of host; a row of unknown source gets the likeliest."""
    shared = rows.sparkSession.sparkContext.broadcast((model, [names.index(d) if d in names else -1 for d in model.domains]))
    rest = [f for f in rows.schema.fields if f.name not in ("host", "source", "text")]
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rest), "source string, text string, member string"])

    def run(c: dict[str, list]) -> dict[str, list]:
        m, places = shared.value
        out = {**{f: v for f, v in c.items() if f != "host"}, "source": [], "member": []}
        for t, h, s in zip(c["text"], c["host"], c["source"]):
            p = m.posterior(t, h, s)
            out["member"].append(quantised(p, places) if len(p) else "")
            out["source"].append(m.domains[int(p.argmax())] if s == "unknown" and len(p) else s)
        return out

    return map_rows(rows.select(*(f.name for f in rest), "source", "host", "text"), run, ddl, "text")


def _matrix(members: list[str], k: int) -> np.ndarray:
    out = np.zeros((len(members), k))
    for row, m in zip(out, members):
        for pair in m.split(",") if m else ():
            place, units = pair.split(":")
            row[int(place)] = int(units) / QUANTA
    return out


def steps(member: np.ndarray, cap: np.ndarray, history: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(rates, point of the next step) of groups after the steps of which history holds the residuals (weighted) and momenta."""
    x = v = np.zeros(len(member))
    for residual, momentum in history:
        new = np.clip(v + member @ residual, 0, cap)
        v = new + momentum * (new - x)
        x = new
    return x, v


def fit_rates(groups: DataFrame, have: np.ndarray, goal: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """The history (see steps) of an accelerated projected gradient descent for the rates r, 0 <= r <= cap, of groups (member, tokens,
    cap) that minimise sum of (expected tokens - goal)^2 / have over the targets. Each step is one job over the groups, whose result is two numbers
    for each target and task. In these units the greatest curvature is at most 1, so a step of 1 never overshoots."""
    k = len(goal)
    history: list[tuple[np.ndarray, float]] = []
    t, last = 1.0, None
    for _ in range(STEPS):
        seen = list(history)

        def run(batches: Iterable[pa.RecordBatch], seen=seen) -> Iterator[pa.RecordBatch]:
            at_x, at_v = np.zeros(k), np.zeros(k)
            for b in batches:
                m = _matrix(b.column(0).to_pylist(), k)
                tokens, cap = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
                x, v = steps(m, cap, seen)
                at_x += m.T @ (tokens * x)
                at_v += m.T @ (tokens * v)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(at_x), pa.array(at_v)], schema=arrow_schema("place int, x double, v double"))

        sums = groups.select("member", "tokens", "cap").mapInArrow(run, "place int, x double, v double").groupBy("place").agg(F.sum("x").alias("x"), F.sum("v").alias("v")).collect()
        at_x, at_v = np.zeros(k), np.zeros(k)
        for r in sums:
            at_x[r.place], at_v[r.place] = r.x, r.v
        if last is not None and np.abs(at_x - last).max() <= STILL * max(1.0, float(goal.max())):
            break
        last = at_x
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        history.append((np.where(have > 0, (goal - at_v) / np.maximum(have, 1e-9), 0.0), (t - 1) / t_new))
        t = t_new
    return history


def with_rates(docs: DataFrame, k: int, history: list[tuple[np.ndarray, float]]) -> DataFrame:
    """docs (member, cap, ...) with their rate."""
    shared = docs.sparkSession.sparkContext.broadcast(history)
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields), "rate double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _ = steps(_matrix(b.column("member").to_pylist(), k), b.column("cap").to_numpy(zero_copy_only=False).astype(float), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x, pa.float64())], names=[*b.schema.names, "rate"])

    return docs.mapInArrow(run, ddl)


def expected_tokens(rows: DataFrame, names: list[str], weight: str) -> DataFrame:
    """source, <weight>: the sum of a column of rows (member, weight), shared out by membership."""
    k = len(names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for b in batches:
            total += _matrix(b.column(0).to_pylist(), k).T @ b.column(1).to_numpy(zero_copy_only=False).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(total)], names=["source", weight])

    return rows.select("member", F.col(weight).cast("double").alias(weight)).mapInArrow(run, f"source string, {weight} double").groupBy("source").agg(F.sum(weight).alias(weight))


def mix(
    docs: DataFrame,
    targets: DataFrame,
    tokenizer: Tokenizer,
    total: float | None = None,
    use_unlabelled: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    domain: str = "domain",
) -> tuple[DataFrame, DataFrame]:
    """(mix: doc_id, source, tokens, rate, uses of every document used; report: source, target_share, max_repeats, available_tokens,
    documents, tokens, most_uses, share, share_error by label, and expected_tokens, expected_share by membership). total: tokens of
    the mix; None: as many as all targets with documents can reach."""
    spark = docs.sparkSession
    wanted = targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.coalesce("max_repeats", F.lit(0)).cast("int").alias("max_repeats")).where("source is not null")
    goals = wanted.groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.max("max_repeats").alias("max_repeats")).orderBy("source").limit(MOST_TARGETS + 1).collect()
    if len(goals) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    names = [r.source for r in goals]
    share = np.array([r.target_share for r in goals], float)
    model = train_domains(docs, doc_id, text, source, domain)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), clean_source(source).alias("source"), clean_domain(domain).alias("host"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(text).alias("text")).where("id is not null and text <> ''")
    known = F.col("source") != "unknown"
    if not use_unlabelled:
        rows = rows.where(known)
    sized = token_counts(memberships(rows.withColumn("known", known), model, names), tokenizer)
    # one document for each text: of its rows (those with a label of their own first) the one with the least id
    first = sized.groupBy("digest").agg(F.min(F.struct((~F.col("known")).alias("other"), "id", "source", "tokens", "member")).alias("d")).select("d.id", "d.source", "d.tokens", "d.member")
    goal_rows = spark.createDataFrame([(r.source, float(r.target_share), int(r.max_repeats)) for r in goals], "source string, target_share double, max_repeats int")
    # at most MOST_TARGETS rows are broadcast
    first = first.join(F.broadcast(goal_rows.select("source", F.col("max_repeats").cast("double").alias("cap"))), "source").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    first = materialize(first.select("id", "source", "tokens", "member", "cap", "part"), "documents")
    groups = materialize(first.where("tokens > 0").groupBy("source", "member", "cap").agg(F.sum("tokens").alias("tokens")), "groups")
    able = {r.source: r.expected for r in expected_tokens(groups.withColumn("expected", F.col("tokens")), names, "expected").collect()}
    most = {r.source: r.expected for r in expected_tokens(groups.withColumn("expected", F.col("tokens") * F.col("cap")), names, "expected").collect()}
    have, most = (np.array([x.get(s, 0.0) for s in names], float) for x in (able, most))
    # a target without labelled documents of its own stays empty, whatever mass other documents' texts would give it
    filled = {r.source for r in groups.select("source").distinct().collect()}
    can = (most > 0) & (share > 0) & np.array([s in filled for s in names], bool)
    size = total if total is not None else float((most[can] / share[can]).min(initial=np.inf)) if can.any() else 0.0
    history = fit_rates(groups, have, np.where(can, share * size, 0.0)) if can.any() else []
    rated = with_rates(first.where("tokens > 0"), len(names), history)
    rated = rated.withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("int")).withColumn("more", F.greatest(F.lit(0.0), F.round(F.col("rate") - F.col("whole"), 9)))
    rated = rated.withColumn("pool", F.floor(F.col("more") * POOLS).cast("int"))
    # documents of nearly one remainder form a pool; its parts in order up to the one in which the remainders' tokens end; within that one, documents in order
    parts = rated.groupBy("source", "pool", "part").agg(F.sum("tokens").alias("held"), F.sum(F.col("tokens") * F.col("more")).alias("owed"))
    in_pool = Window.partitionBy("source", "pool")
    before = parts.withColumn("before", F.coalesce(F.sum("held").over(in_pool.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("goal", F.sum("owed").over(in_pool)).drop("owed")
    placed = rated.join(before, ["source", "pool", "part"]).withColumn("left", F.col("goal") - F.col("before"))
    inside = placed.where("left > 0 and left < held").withColumn("upto", F.sum("tokens").over(Window.partitionBy("source", "pool", "part").orderBy("id")))
    used = placed.where("not (left > 0 and left < held)").withColumn("extra", (F.col("left") >= F.col("held")).cast("int")).drop("left")
    used = used.unionByName(inside.withColumn("extra", (F.col("upto") - F.col("tokens") / 2 <= F.col("left")).cast("int")).drop("left", "upto"))
    used = used.withColumn("uses", F.least(F.col("whole") + F.col("extra"), F.col("cap").cast("int"))).where("uses > 0")
    chosen = materialize(used.select(F.col("id").alias(doc_id), "source", "tokens", F.round("rate", 9).alias("rate"), "uses", "member"), "mix")
    got = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    held = first.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    hoped = expected_tokens(chosen.withColumn("expected_tokens", F.col("tokens") * F.col("uses")), names, "expected_tokens").withColumn("expected_tokens", F.round("expected_tokens", 3))
    report = goal_rows.join(got, "source", "left").join(held, "source", "left").join(hoped, "source", "left").na.fill(0, ["documents", "tokens", "most_uses", "available_tokens", "expected_tokens"])
    all_ = Window.partitionBy()  # over the targets
    whole, soft = F.sum("tokens").over(all_), F.sum("expected_tokens").over(all_)
    report = report.withColumn("share", F.round(F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0), 6)).withColumn("share_error", F.round(F.col("share") - F.col("target_share"), 6))
    return chosen.drop("member"), report.withColumn("expected_share", F.round(F.when(soft > 0, F.col("expected_tokens") / soft).otherwise(0.0), 6))
