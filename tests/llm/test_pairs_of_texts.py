"""Near duplicates and leaks against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import leakage as L
from corvane.llm import near_duplicates as N

VOCAB = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ro", "su", "ti") for b in ("ban", "den", "fol", "gar", "hin", "jun", "kel", "lam", "mor")]


def text(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def jaccard(x, y, k=3):
    s, t = ({*zip(*(w[i:] for i in range(k)))} for w in (N.words_of(x), N.words_of(y)))
    return len(s & t) / len(s | t) if s | t else 0.0


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    rows = [(i, text(rng, rng.randint(40, 120))) for i in range(120)]
    for i in range(120, 260):
        words = rng.choice(rows)[1].split()
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = rng.choice(VOCAB)
        if rng.random() < 0.3:
            k = rng.randrange(len(words))
            words = words[k:] + words[:k]
        rows.append((i, " ".join(words)))
    rows += [(300, rows[0][1].upper() + "!!"), (301, "one two"), (302, "One, two"), (303, ""), (304, None), (305, "..."), (None, "one two"), (306, "solo"), (307, "long " + text(rng, 30_000))]
    return rows


def test_near_duplicate_pairs(spark, corpus):
    df = spark.createDataFrame(corpus, "seq bigint, text string").select("seq", "text", F.lit(1).alias("id"), F.lit("x").alias("a"), F.lit("y").alias("rep"))
    got = {tuple(r) for r in N.all_pairs(*N.near_duplicates(df)).collect()}
    fine = [(i, t) for i, t in corpus if i is not None and t]
    want = {(i, j) for i, x in fine for j, y in fine if i < j and (jaccard(x, y) >= 0.5 or (N.words_of(x) == N.words_of(y) and N.words_of(x)))}
    assert got - want == set()
    sure = {p for p in want if p[0] >= 300 or jaccard(dict(fine)[p[0]], dict(fine)[p[1]]) >= 0.6}
    assert sure <= got and len(want - got) <= 0.02 * len(want)
    assert (0, 300) in got and (301, 302) in got


def test_classes_have_one_row_per_document(spark, corpus):
    df = spark.createDataFrame(corpus, "seq bigint, text string")
    rows = N.near_duplicate_classes(*N.near_duplicates(df)).collect()
    by = {r.id: r for r in rows}
    assert len(rows) == len(by) and by[300].class_id == 0 and by[0].copies == 2 and 303 not in by


def test_no_rows(spark):
    e = spark.createDataFrame([], "seq bigint, text string")
    assert N.all_pairs(*N.near_duplicates(e)).collect() == []


def far(sig, i, j):
    """Bits of two sketches that differ up to the end of each word."""
    return np.cumsum(np.bitwise_count(sig[i] ^ sig[j]), -1, dtype=np.int64)


@pytest.mark.parametrize("share", [1.0, 0.9, 0.5, 0.3])
def test_trie_join_against_all_pairs(share, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (40, N.SIG), dtype=np.uint64)
    sig = np.repeat(base, 40, 0)
    for k in range(N.SIG):
        sig[:, k] ^= rng.integers(0, 2**63, 1600, dtype=np.uint64) & rng.integers(0, 2**63, 1600, dtype=np.uint64) & rng.integers(0, 2**63, 1600, dtype=np.uint64)
    group = rng.integers(0, 2, 1600).astype(np.uint64)
    budget = N.budgets(share)
    for leaf in (1 << 30, 64):  # whole groups word by word, and a deep walk
        monkeypatch.setattr(N, "LEAF", leaf)
        walk = N.Walk()
        i, j = N.trie_self_join(group, sig, budget, walk)
        got = {(min(x, y), max(x, y)) for x, y in zip(i.tolist(), j.tolist())}
        assert len(got) == len(i) and walk.dropped > 0
        d = np.cumsum(np.bitwise_count(sig[:, None, :] ^ sig[None, :, :]), 2, dtype=np.int64)
        fine = (d <= budget[[64, 128, 192, 256]]).all(2) & (group[:, None] == group[None, :])
        a, b = np.nonzero(np.triu(fine, 1))
        want = set(zip(a.tolist(), b.tolist()))
        # a deep walk looks at more depths than the ends of words, so it may drop a few more
        assert got == want if leaf > 64 else got <= want and len(want - got) <= 0.02 * len(want)


def test_the_trie_prunes_and_finds_pairs_at_one_half():
    """8 000 texts of random shingles, of which each even one shares just half of its shingles with the next: every band's trie, counted."""
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(4000):
        x = rng.integers(0, 2**64, 160, dtype=np.uint64)
        sets += [x[:120], x[40:]]
    keys, sig = N.sketch(np.concatenate(sets), np.arange(8000) * 120)
    walk, found = N.Walk(), set()
    for band in range(N.BANDS):
        i, j = N.trie_self_join(keys[:, band], sig, N.budgets(0.5), walk)
        found |= {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())}
    every = 8000 * 7999 // 2
    assert walk.compared < 0.05 * every and walk.dropped > 0.9 * every
    assert len(found & {(k, k + 1) for k in range(0, 8000, 2)}) >= 0.99 * 4000 and len(found) < 4100


def test_a_key_of_many_rows_is_divided(spark, corpus, monkeypatch):
    df = spark.createDataFrame([r for r in corpus if r[0] is not None], "seq bigint, text string")
    want = {tuple(r) for r in N.all_pairs(*N.near_duplicates(df)).collect()}
    monkeypatch.setattr(N, "HOT_ROWS", 2)
    monkeypatch.setattr(N, "HOT_SAMPLE", 1)
    monkeypatch.setattr(N, "COPIES", 2)
    monkeypatch.setattr(N, "PACK_KEYS", 2000)
    monkeypatch.setattr(N, "PART_KEYS", 500)
    assert {tuple(r) for r in N.all_pairs(*N.near_duplicates(df)).collect()} == want
    far_apart = df.select((F.col("seq") * (1 << 45)).alias("seq"), "text")
    assert {(r[0] >> 45, r[1] >> 45) for r in N.all_pairs(*N.near_duplicates(far_apart)).collect()} == want


def test_many_copies_make_all_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "COPIES", 10)
    a, b = "the old road to the river was closed in the spring of that year", "the old road to the river was closed in the spring of that year again"
    df = spark.createDataFrame([(k, a if k % 3 else b) for k in range(100)], "seq bigint, text string")
    got = [tuple(r) for r in N.all_pairs(*N.near_duplicates(df)).collect()]
    assert len(got) == len({*got}) == 100 * 99 // 2


def test_pairs_at_one_half_share_a_key():
    """Of 2 000 pairs of sets with a share of one half in common, 99 in 100 have a key in common."""
    rng = np.random.default_rng(5)
    shared = 0
    for k in range(2000):
        x = rng.integers(0, 2**64, 160, dtype=np.uint64)
        keys, sig = N.sketch(np.concatenate([x[:120], x[40:]]), np.array([0, 120]))  # 80 of 160
        shared += bool((keys[0] == keys[1]).any())
    assert shared >= 1980


# -- leaks


def spans(doc, item, least, per):
    """Whether some part of item of at least `least` words lies in doc with at most one error in `per` words (edit distance of every part)."""
    n = len(item)
    for a in range(n):
        # distance of item[a:b] to the nearest part of doc, for every b
        row = [0] * (len(doc) + 1)
        for b in range(a, n):
            new = [b - a + 1]
            for k, w in enumerate(doc):
                new.append(min(row[k] + (item[b] != w), row[k + 1] + 1, new[k] + 1))
            row = new
            length = b - a + 1
            if length >= least and min(row) * per <= length:
                return True
    return False


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(11)
    items = [(i, text(rng, rng.choice([20, 40, 70])).capitalize() + "?") for i in range(12)] + [(90, None), (91, ""), (92, "too short to leak")]
    docs = []
    for d in range(90):
        words = text(rng, 60).split()
        if d % 3:
            item = L.normal_words(items[rng.randrange(12)][1])
            n = rng.choice([6, 10, 14, 15, 16, 20, 30, 60])
            a = rng.randrange(max(1, len(item) - n))
            part = item[a : a + n]
            for _ in range(rng.choice([0, 0, 1, 2, 4, 7])):
                k = rng.randrange(len(part))
                how = rng.randrange(3)
                part[k : k + 1] = [] if how == 0 and len(part) > 1 else ["zzz"] if how == 1 else [part[k], "zzz"]
            k = rng.randrange(len(words))
            words[k:k] = part
        docs.append((d, " ".join(words)))
    docs += [(200, None), (201, ""), (202, items[0][1].replace(" ", "<br>\n").upper()), (203, items[1][1].replace("a", "á")), (204, text(rng, 20_000) + " " + items[2][1])]
    return docs, items


def test_leaks_against_edit_distance(spark, leaky):
    docs, items = leaky
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(5)).withColumn("i", F.lit(0))
    i = spark.createDataFrame(items, "item_id bigint, prompt string").withColumn("doc_id", F.lit("x"))
    rows = L.leaks(d, i).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(got) == len(rows)
    want = {(a, b) for a, t in docs if t and len(t) < 5000 for b, p in items if p and spans(L.normal_words(t), L.normal_words(p), 15, 8)}
    assert (202, 0) in got and (203, 1) in got and (204, 2) in got
    # at the ends an errorneous word may make up the fifteen words; a found span begins and ends with a matched one
    assert {g for g in got if g[0] != 204} <= want
    loose = {w for w in want - got if not spans(L.normal_words(dict(docs)[w[0]]), L.normal_words(dict(items)[w[1]]), 18, 9)}
    assert want - got == loose
    assert L.without_leaks(d, L.leaks(d, i)).count() == len(docs) - len({a for a, _ in got})


def test_blocks_of_items(spark, leaky, monkeypatch):
    docs, items = leaky
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, prompt string")
    want = {tuple(r) for r in L.leaks(d, i).collect()}
    monkeypatch.setattr(L, "ITEMS_A_BLOCK", 4)
    assert {tuple(r) for r in L.leaks(d, i).collect()} == want
    monkeypatch.setattr(L, "BLOCKS_A_SCAN", 2)
    assert {tuple(r) for r in L.leaks(d, i).collect()} == want
    assert L.leaks(d, i.limit(0)).collect() == [] and L.leaks(d.limit(0), i).collect() == []


def test_adjacent_errors():
    item = [f"w{k}" for k in range(40)]
    cases = []
    for n, a in [(24, 10), (24, 11), (25, 11), (26, 12), (24, 9), (24, 3)]:
        cases.append(item[:a] + ["x", "y", "z"] + item[a + 3 : n])  # three replaced
        cases.append(item[:a] + item[a + 3 : n])  # three dropped
    cases += [item[:12] + ["x", "y", "z"] + item[12:n] for n in (24, 27)]  # three added
    cases.append(item[:9] + ["x", "y"] + item[11:13] + ["z"] + item[14:24])
    docs = [" ".join(["start", "of", "it", *c, "end"]) for c in cases]
    find = lambda texts: L.search(L.Shard(texts, L.Ids(L.word_value)), L.TestSuffixes([(1, " ".join(item), [])]), 15, 8)
    found = find(docs)
    assert [f[0] for f in sorted(found)] == list(range(len(docs)))
    assert all(spans(d.split(), item, 15, 8) for d in docs)
    # a fourth error is one too many
    assert find([" ".join(item[:10] + ["x"] * 4 + item[14:24])]) == []


def test_suffix_array_and_longest_matches():
    import numpy as np

    rng = random.Random(6)
    texts = [" ".join(rng.choices("abc", k=rng.choice([0, 1, 3, 40]))) for _ in range(30)]
    texts += [texts[3]] * 3 + [None]
    shard = L.Shard(texts, L.Ids(L.word_value))
    flat = shard.flat.tolist()
    assert shard.array.tolist() == sorted(range(len(flat)), key=lambda i: flat[i:])
    prompts = [" ".join(rng.choices("abcd", k=25)) for _ in range(10)]
    tests = L.TestSuffixes([(i, t, []) for i, t in enumerate(prompts)])
    want = []
    for t in prompts:
        w = t.split()
        for a in range(len(w)):
            n = 0
            while a + n < len(w) and any(" ".join(["", *w[a : a + n + 1], ""]) in f" {x} " for x in texts if x):
                n += 1
            want.append(n)
    assert shard.longest(tests.flat, tests.places, 25).tolist() == want
    low, high = (shard.bound(tests.flat, tests.places, 3, after) for after in (False, True))
    values = tests.flat.tolist()
    assert (high - low).tolist() == [sum(flat[i : i + 3] == values[q : q + 3] for i in range(len(flat))) for q in tests.places]
    assert np.array_equal(L.suffix_array(np.zeros(0, np.uint64)), np.zeros(0, np.int64))


def test_common_openings_are_no_leak(spark):
    rng = random.Random(9)
    opening = "only then had they been counted which of the following statements must be true if"
    words = lambda n: " ".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(n))
    items = [(k, f"{words(20)} {opening} {words(12)}") for k in range(6)]
    d = [(1, f"{words(30)} {opening} {words(30)}"), (2, items[0][1]), (3, f"{words(5)} {opening} {' '.join(items[1][1].split()[35:43])} {words(5)}")]
    got = L.leaks(spark.createDataFrame(d, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, prompt string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(2, 0), (3, 1)}


def test_many_items_take_one_scan(spark):
    rng = random.Random(10)
    names = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmnprst"]
    items = [(k, " ".join(rng.choices(names, k=18))) for k in range(40_000)]
    docs = [(k, " ".join(rng.choices(names, k=30)) + " " + (items[k * 397][1] if k % 2 else "")) for k in range(100)]
    found = L.leaks(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(1), spark.createDataFrame(items, "item_id bigint, prompt string"))
    assert "Union" not in found._jdf.queryExecution().toString()
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, k * 397) for k in range(1, 100, 2)}


def test_normal_words():
    assert L.normal_words("The Gar-\niquar’s <b>c</b>afé[12] &amp; “ﬁne” lam​p") == ["the", "gariquars", "cafe", "fine", "lamp"]
