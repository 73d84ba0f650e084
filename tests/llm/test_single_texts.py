"""Packing, token counts, mixing, languages, line kinds, pair defects and subjects."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, language, mixing, packing, pairs, quality, subjects, token_budget

MERGES = [(0, b" ", b"t", 260), (1, b"h", b"e", 261), (2, b" t", b"he", 262), (3, b"a", b"n", 263), (4, b"an", b"d", 264), (5, b" ", b" ", 265)]


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer(MERGES)


def merges_table(spark):
    return spark.createDataFrame([(r, a.hex(), b.hex(), t) for r, a, b, t in MERGES], "merge_rank int, left_hex string, right_hex string, token_id int")


def test_tokens(tokenizer, spark):
    assert tokenizer.encode(" the and") == [262, 4 + 32, 264]
    assert bpe.Tokenizer.of(merges_table(spark)).encode("he the") == [261, 262]
    rng = random.Random(1)
    for n in (10, 70, 400):  # the long way gives what the short one does
        t = "".join(rng.choice("thean d") for _ in range(n)).replace(" ", "")
        parts = [bytes([b]) for b in t.encode()]
        while True:
            best = min(zip(parts, parts[1:]), key=lambda p: tokenizer.ranks.get(p, 99), default=None)
            if best not in tokenizer.ranks:
                break
            parts = bpe._join(parts, best)
        assert tokenizer._long([bytes([b]) for b in t.encode()]) == parts == tokenizer.pieces(t)
    assert tokenizer.count(None) == tokenizer.count("") == 0
    for t in ("naïve — 12_3\n\n x", "日本 語", "  lead", "tail  "):
        assert b"".join(p for piece in bpe.PIECE.findall(t) for p in tokenizer.pieces(piece)).decode() == t


def test_token_budget(spark, tokenizer):
    rows = [("the the", " Wiki", "EN", "A.example"), ("the the", "wikipedia", "english", "a.example "), ("and", None, "xx", None), (None, "fineweb", "de-AT", "b"), ("", "fineweb", None, "b")]
    df = spark.createDataFrame(rows, "text string, source string, lang string, domain string").withColumn("digest", F.lit(1)).withColumn("tokens", F.lit(9)).withColumn("n", F.lit(0))
    got = {(r.level, r.source, r.lang, r.domain): (r.documents, r.tokens) for r in token_budget.token_budget(df, tokenizer).collect()}
    n = tokenizer.count("the the")
    assert got["cell", "wikipedia", "en", "a.example"] == (2, 2 * n)
    assert got["source", "unknown", None, None] == (1, 1)
    assert got["lang", None, "unknown", None] == (2, 1) and got["lang", None, "de", None] == (1, 0)
    assert got["domain", None, None, "b"] == (2, 0)
    assert token_budget.token_budget(df.limit(0), tokenizer).collect() == []


def placed(spark, lengths, block=100):
    rows = [(i, "val" if i % 9 == 0 else "train", [1] * n) for i, n in enumerate(lengths)]
    rows += [(900, None, [1] * 7), (901, "train", None), (902, "train", []), (3, "train", [1] * 5)]
    df = spark.createDataFrame(rows, "seq bigint, split string, ids array<int>").withColumn("block", F.lit("z")).withColumn("rank", F.lit(1))
    return rows, packing.pack(df, block).collect()


def best_fit_decreasing(sizes, block):
    rooms = []
    for n in sorted(sizes, reverse=True):
        k = min((k for k, room in enumerate(rooms) if room >= n), key=lambda k: rooms[k], default=None)
        if k is None:
            rooms.append(block - n)
        else:
            rooms[k] -= n
    return len(rooms)


@pytest.mark.parametrize("ranked", [100_000, 3])
def test_packing(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    rng = random.Random(2)
    rows, got = placed(spark, [rng.choice([5, 20, 33, 34, 50, 51, 99, 100, 101, 250, 1000]) if rng.random() < 0.6 else rng.randint(1, 130) for _ in range(600)])
    blocks = defaultdict(list)
    for r in got:
        blocks[r.split, r.block].append(r)
    for rs in blocks.values():
        rs.sort(key=lambda r: r.position)
        assert [r.position for r in rs] == list(range(len(rs)))
        assert [r.first_token for r in rs] == [sum(x.tokens for x in rs[:k]) for k in range(len(rs))]
        assert sum(r.tokens for r in rs) <= 100
    want = Counter((s, i, p, min(100, len(x) - 100 * p)) for i, s, x in rows if x for p in range(-(-len(x) // 100)))
    assert Counter((r.split, r.seq, r.piece, r.tokens) for r in got) == want
    for s in ("train", "val"):
        total = sum(r.tokens for r in got if r.split == s)
        numbers = {b for x, b in blocks if x == s}
        assert numbers == set(range(len(numbers)))
        assert total / 100 <= len(numbers) <= best_fit_decreasing([r.tokens for r in got if r.split == s], 100) + 2


def test_packing_of_few_sizes_is_optimal(spark):
    _, got = placed(spark, [60] * 20 + [40] * 20 + [26] * 40 + [24] * 40)
    per = defaultdict(int)
    for r in got:
        per[r.split] += r.tokens
    assert len({r.block for r in got if r.split == "train"}) <= -(-per["train"] // 100) + 2
    assert packing.pack(spark.createDataFrame([], "seq bigint, split string, ids array<int>")).collect() == []


def test_mix_reaches_the_shares(spark, tokenizer):
    rng = random.Random(3)
    rows = [(i, " the and" * rng.randint(1, 40) + f" {i}", s, "h") for i, s in enumerate(rng.choices(["wiki", "FineWeb", "stack", None, "nope"], [3, 6, 1, 1, 1], k=900))]
    rows += [(2000 + i, rows[0][1], rows[0][2], None) for i in range(50)] + [(3000, None, "wiki", "h"), (3001, "", "wiki", "h"), (None, "x", "wiki", "h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, domain string").withColumn("uses", F.lit(0)).withColumn("id", F.lit(0))
    goal = spark.createDataFrame([("wikipedia", 0.4, 2), ("fineweb-edu", 0.4, 1), ("stackexchange", 0.2, 5), ("field-notes", 0.0, 2), ("open-web-math", None, None)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(df, goal, tokenizer)
    by = {r.source: r for r in report.collect()}
    for s, want in (("wikipedia", 0.4), ("fineweb-edu", 0.4), ("stackexchange", 0.2)):
        assert abs(by[s].share - want) < 0.01 and by[s].most_uses <= by[s].max_repeats
    assert by["field-notes"].tokens == 0 and by["open-web-math"].tokens == 0
    used = chosen.collect()
    assert len({r.doc_id for r in used}) == len(used) and not any(2000 <= r.doc_id < 2050 for r in used)
    soft, _ = mixing.mix(df, goal, tokenizer, use_unlabelled=True)
    assert soft.count() >= 1
    empty, rep = mixing.mix(df.limit(0), goal, tokenizer)
    assert empty.collect() == [] and all(r.share == 0 for r in rep.collect())


def test_wrong_labels_change_the_rates(spark, tokenizer):
    rng = random.Random(5)
    words = {"wikipedia": [f"wa{c}" for c in "bcdfghjklmnp"], "stackexchange": [f"so{c}" for c in "bcdfghjklmnp"]}
    rows = []
    for i in range(1200):
        true = "wikipedia" if i % 2 else "stackexchange"
        label = "wiki" if true == "stackexchange" and rng.random() < 0.3 else true  # three in ten are labelled wrongly
        rows.append((i, " ".join(rng.choices(words[true], k=30)) + f" {i}", label, "h", true))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, domain string, truth string")
    goal = spark.createDataFrame([("wikipedia", 0.5, 1), ("stackexchange", 0.5, 1)], "source string, target_share double, max_repeats int")
    model = mixing.train_domains(df)
    assert 0.1 < model.wrong < 0.2  # 15 in a hundred of all labels
    chosen, report = mixing.mix(df, goal, tokenizer)
    truth = {r[0]: r[4] for r in rows}
    real, labelled = Counter(), Counter()
    for r in chosen.collect():
        real[truth[r.doc_id]] += r.tokens * r.uses
        labelled[r.source] += r.tokens * r.uses
    assert abs(real["wikipedia"] / real.total() - 0.5) < 0.02 and labelled["wikipedia"] / labelled.total() > 0.6
    by = {r.source: r for r in report.collect()}
    assert all(abs(r.expected_share - 0.5) < 0.02 for r in by.values())


def test_rates_against_a_plain_solver(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    k, n = 4, 30
    units = rng.multinomial(mixing.QUANTA, rng.dirichlet(np.ones(k) * 0.4), size=n)
    members = [",".join(f"{j}:{u}" for j, u in enumerate(row) if u) for row in units]
    tokens, cap = rng.integers(10, 1000, n), rng.integers(1, 4, n).astype(float)
    m = units / mixing.QUANTA
    have = m.T @ tokens
    for goal in (0.7 * have, have * np.array([9.0, 0.2, 0.5, 0.0])):  # within reach, and not
        groups = spark.createDataFrame([(x, int(t), float(c)) for x, t, c in zip(members, tokens, cap)], "member string, tokens bigint, cap double")
        rates, _ = mixing.steps(m, cap, mixing.fit_rates(groups, have, goal))
        assert (rates >= 0).all() and (rates <= cap + 1e-9).all()
        x = np.zeros(n)
        for _ in range(100_000):
            x = np.clip(x + m @ ((goal - m.T @ (tokens * x)) / have), 0, cap)
        loss = lambda r: (((m.T @ (tokens * r)) - goal) ** 2 / have).sum()
        assert loss(rates) <= loss(x) + 1e-4 * (1 + loss(x))


SENTENCES = {
    "en": "The people of {n} have seen the old houses near the river. It was not easy for them to find the way back. She said that the books and the letters belong together.",
    "de": "Die Leute aus {n} haben die alten Häuser am Fluss gesehen. Es war nicht leicht für sie, den Weg zurück zu finden. Sie hat gesagt, dass die Bücher und die Briefe zusammengehören.",
    "fr": "Les gens de {n} ont vu les vieilles maisons près de la rivière. Il n'était pas facile pour eux de trouver le chemin du retour. Elle a dit que les livres et les lettres vont ensemble.",
    "es": "La gente de {n} ha visto las casas viejas cerca del río. No era fácil para ellos encontrar el camino de vuelta. Ella dijo que los libros y las cartas van siempre juntos.",
    "it": "La gente di {n} ha visto le vecchie case vicino al fiume. Non era facile per loro trovare la strada del ritorno. Lei ha detto che i libri e le lettere stanno bene insieme.",
    "nl": "De mensen uit {n} hebben de oude huizen bij de rivier gezien. Het was niet makkelijk voor hen om de weg terug te vinden. Zij zei dat de boeken en de brieven bij elkaar horen.",
    "ru": "Жители города {n} видели старые дома у реки. Им было нелегко найти дорогу назад. Она сказала, что книги и письма всегда нужны вместе.",
}
NAMES = ["Tolva", "Merin", "Askel", "Borun", "Cadel", "Dorim", "Elvan", "Farum"]


def fill(code, n):
    return SENTENCES[code].replace("{n}", n)


@pytest.fixture(scope="module")
def speaker():
    rng = random.Random(4)
    rows = [(fill(c, rng.choice(NAMES)), c) for c in SENTENCES for _ in range(20)]
    rows = [(t, rng.choice(list(SENTENCES)) if rng.random() < 0.1 else c) for t, c in rows]  # some labels are wrong
    return language.LanguageModel.train(rows)


def test_languages(spark, speaker):
    docs = [(i, fill(c, "Quenna"), c) for i, c in enumerate(SENTENCES)]
    docs += [(20, fill("de", "X") + "\n\n" + fill("fr", "Y"), "de"), (21, fill("en", "X") + ' He called it "la vie en rose" then.', "en"), (22, None, "en"), (23, "", None), (24, "no full sentence here", None), (25, fill("en", "X"), "de"), (26, fill("en", "X") * 400, None)]
    df = spark.createDataFrame(docs, "seq bigint, text string, label string").withColumn("lang", F.lit("zz")).withColumn("main", F.lit(0))
    lines = quality.LineModel.train([fill(c, n) for c in SENTENCES for n in NAMES] + ["- one\n- two\n- three\n- four"] * 9)
    rows = language.languages(df, speaker, lines, label="label").collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.segment):
        by[r.seq].append(r.lang)
    assert [by[i] for i in range(len(SENTENCES))] == [[c] for c in SENTENCES]
    assert by[20] == ["de", "fr"] and by[21] == ["en"] and by[22] == by[23] == [None] and len(by[24]) == 1
    assert all(0 <= r.confidence <= 1 for r in rows)
    found = {tuple(r) for r in language.mislabelled(language.languages(df, speaker, lines, label="label")).collect()}
    assert {(20, "de"), (20, "fr"), (25, "en"), (26, "en")} == found


def test_every_stretch_has_a_language(spark, speaker):
    heads = "Notes from the river"
    rows = [(0, heads + "\n\n" + fill("en", "Tolva")), (1, heads), (2, None), (3, ""), (4, "12 + 3 = 15 |||"), (5, "- " + fill("fr", "Merin")[:40] + "\n- et puis la rivière\n" + fill("de", "Askel")), (6, "\n".join(["- the books and the letters of the people", "- the old houses near the river"]))]
    got = defaultdict(list)
    for r in language.languages(spark.createDataFrame(rows, "seq bigint, text string"), speaker).orderBy("seq", "segment").collect():
        got[r.seq].append((r.lang, r.sentences))
    assert sorted(got) == list(range(7))
    for i, t in rows:
        pieces = [x for x, _ in language.sentences(t) if language._WORD.search(x)]
        assert sum(n for _, n in got[i]) == len(pieces)  # every piece lies in one segment
    assert [c for c, _ in got[0]] == ["en"] and got[1][0][0] == "en" and got[6][0][0] == "en"
    assert got[2] == got[3] == got[4] == [(None, 0)] and got[5][-1][0] == "de"


def test_latest_label(spark):
    rows = [(1, "EN", 1), (1, "ger", 2), (2, " fr-XX", 3), (2, "fr", 3), (2, "de", 3), (3, None, 5), (3, "en", 1), (4, "n/a", 1), (None, "en", 1)]
    df = spark.createDataFrame(rows, "seq bigint, lang string, labelled_at int")
    assert {tuple(r) for r in language.latest_labels(df).collect()} == {(1, "de"), (2, "de"), (3, None), (4, None)}


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, fill("en", "X"))], "seq bigint, text string")
    labels = spark.createDataFrame([], "seq bigint, lang string, labelled_at timestamp")
    assert [(r.seq, r.lang, r.confidence) for r in language.label_documents(docs, labels).collect()] == [(1, None, 0.0)]
    assert language.label_documents(docs.limit(0), labels).collect() == []


def test_kinds(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["mango", "barley", "copper", "lantern", "harness", "violet", "pebble", "timber"])
    make = {
        "prose": lambda: " ".join(fill("en", rng.choice(NAMES)).split(". ")[k % 3] + "." for k in range(3)) + f" The {word()} and the {word()} were not far from the {word()}.",
        "list": lambda: "\n".join(f"{rng.choice('-*•')} {word()} {word()}" for _ in range(9)),
        "table": lambda: "\n".join(f"{word()} | {rng.randint(1, 99)} | {rng.random():.2f} | {word()}" for _ in range(9)),
        "junk": lambda: "\n".join(["Home Menu Login Subscribe Next page"] * 9) if rng.random() < 0.5 else " ".join("".join(rng.choice("qwxzjk") for _ in range(7)) for _ in range(60)),
    }
    docs = [(i, make[k](), k) for i, k in enumerate(rng.choices(list(make), [6, 2, 2, 2], k=240))]
    df = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(900, None), (901, ""), (902, " \n "), (903, docs[0][1] * 500)], "seq bigint, text string").withColumn("kind", F.lit("x")).withColumn("words", F.lit(0))
    rows = {r.seq: r for r in quality.quality(df, quality.train_lines(df)).collect()}
    assert sum(rows[i].kind == k for i, _, k in docs) >= 0.98 * len(docs)
    assert rows[900].kind == rows[901].kind == rows[902].kind == "empty" and rows[900].words == 0
    i, t, _ = next(d for d in docs if d[2] == "prose")
    assert rows[i].words == len(quality._WORD.findall(t)) and abs(rows[i].prose - 1) < 1e-6
    assert quality.quality(df.limit(0), quality.train_lines(df.limit(0))).collect() == []


def test_lines_before_and_after_decide():
    """A line that could be prose or an item is labelled like its surroundings."""
    import numpy as np

    rng = random.Random(5)
    word = lambda: rng.choice(["mango", "barley", "copper", "lantern", "harness", "violet", "pebble", "timber"])
    prose = lambda: f"The {word()} and the {word()} were not far from the {word()} of the old house."
    item = lambda: f"{rng.choice('-*•')} {word()} {word()}"
    texts = ["\n".join([prose() for _ in range(6)] + [item() for _ in range(rng.choice([0, 0, 8, 20]))]) for _ in range(60)]
    texts += ["\n".join(item() for _ in range(9)) for _ in range(40)]
    m = quality.LineModel.train(texts)
    odd = [f"{word()} of {word()}", f"{word()} {word()} and {word()}:", f"the {word()} {word()}"]
    mixed = ["\n".join([item() for _ in range(4)] + [rng.choice(odd)] + [item() for _ in range(4)] + [prose()]) for _ in range(20)]
    mixed += ["\n".join([prose() for _ in range(4)] + [rng.choice(odd)] + [prose() for _ in range(4)]) for _ in range(20)]
    chained = [labels for _, labels in m.label(mixed)]
    m.start, m.move = np.full(4, np.log(0.25)), np.full((4, 4), np.log(0.25))
    alone = [labels for _, labels in m.label(mixed)]
    assert sum(a != b for a, b in zip(chained, alone)) >= 5
    assert all(c[4] == quality.LIST for c in chained[:20]) and all(c[4] == quality.PROSE for c in chained[20:])


def test_known_words_are_counted_over_all_documents(spark):
    rows = [(i, f"The lantern w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} {'rare' if i < 5 else ''}") for i in range(400)]
    df = spark.createDataFrame(rows + [(None, None), (500, "")], "seq bigint, text string")
    assert quality.known_words(df, n=1000) == {"the", "lantern", "rare"}
    assert quality.known_words(df, n=200) == {"the", "lantern"}  # 4 in 200 are 8 of 400
    assert quality.known_words(df.limit(0)) == frozenset()


def line_docs(n):
    rng = random.Random(7)
    word = lambda: rng.choice(["mango", "barley", "copper", "lantern", "harness", "violet", "pebble", "timber"])
    prose = lambda: f"The {word()} and the {word()} were not far from the {word()} of the old house."
    item = lambda: f"{rng.choice('-*•')} {word()} {word()}"
    return [(i, "\n".join([prose() for _ in range(rng.randint(1, 5))] + [item() for _ in range(rng.choice([0, 0, 3, 9]))])) for i in range(n)]


def test_lines_are_estimated_on_all_documents(spark, monkeypatch):
    import numpy as np

    rows = line_docs(400)
    df = spark.createDataFrame([*rows, (None, None), (500, "")], "seq bigint, text string").repartition(5)
    m = quality.train_lines(df, n=40)
    assert round(float(np.exp(-m.start[quality.JUNK]))) == 4 + 400  # no document begins with junk: one of all that were counted, and one for each label
    # the same counts as in memory, however the documents are dealt out
    monkeypatch.setattr(quality, "SEED_EVERY", 1)
    whole = quality.LineModel.train([t for _, t in rows], quality.known_words(df, n=40))
    monkeypatch.setattr(quality, "CHUNK_LINES", 20)
    for parts in (1, 7):
        m = quality.train_lines(df.repartition(parts), n=40)
        assert m.known == whole.known
        for a, b in ((m.start, whole.start), (m.move, whole.move), (m.emit, whole.emit), (m.variety, whole.variety)):
            assert np.array_equal(a, b)
    assert sorted(map(tuple, quality.trained_quality(df, n=40).collect()), key=str) == sorted(map(tuple, quality.quality(df, m).collect()), key=str)


def test_languages_in_one_reading_of_the_texts(spark, speaker, monkeypatch):
    rows = [(i, fill(c, n)) for i, (c, n) in enumerate((c, n) for c in SENTENCES for n in NAMES[:5])]
    rows += [(100 + i, t) for i, t in line_docs(60)] + [(200, fill("de", "X") + "\n\n" + fill("fr", "Y")), (201, None), (202, ""), (203, "12 + 3")]
    docs = spark.createDataFrame(rows, "seq bigint, text string")
    labels = spark.createDataFrame([(i, "de" if i % 3 else None, 1) for i, _ in rows if i % 4], "seq bigint, lang string, labelled_at int")
    monkeypatch.setattr(language.LanguageModel, "train", classmethod(lambda cls, labelled: speaker))
    one = language.label_documents(docs, labels)
    two = language.languages(docs.join(language.latest_labels(labels), "seq", "left"), speaker, quality.train_lines(docs), label="label")
    assert one.schema == two.schema and sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)
    assert {r.kind for r in one.collect()} >= {"prose", "list", None}


def test_words_cut_as_bytes():
    rng = random.Random(4)
    some = [*"aZ09_ '\t\x85\xa0\xad-éßµªº²½ÿ÷×", *"’–ЯіŒ\u2028٣漢\U0001f600\ud800"]
    for n in (18, len(some)):
        for _ in range(500):
            t = "".join(rng.choice(some[:n]) for _ in range(rng.randint(0, 30)))
            assert quality.words_of(t) == quality._WORD.findall(t)
            assert "'" in t or quality.words_of(t, language._WORD) == language._WORD.findall(t)


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(6)
    m = quality.LineModel(frozenset(), np.log(rng.dirichlet(np.ones(4))), np.log(rng.dirichlet(np.ones(4), 4)), np.log(rng.random((4, sum(quality.SIZES)))), np.log(rng.dirichlet(np.ones(4), 4)))
    docs = [(np.stack([rng.integers(0, n, k) for n in quality.SIZES], 1), int(rng.integers(0, 4))) for k in (1, 4, 6, 2)]
    for (rows, v), path in zip(docs, m.decode(docs)):
        def score(p):
            s = m.start[p[0]] + sum(m.move[a, b] for a, b in zip(p, p[1:]))
            return s + sum(m.emit[x, m.offsets + r].sum() + m.variety[x, v] for x, r in zip(p, rows))

        assert abs(score(path) - max(score(p) for p in itertools.product(range(4), repeat=len(rows)))) < 1e-9


def test_pair_defects(spark):
    good = "Start with the lid and turn it slowly. Keep the cup away from the stove. It helps to wait for a few minutes."
    rows = [(i, "How do I open the jar without a tool?", good) for i in range(40)]
    extra = {
        100: ("Why?", None, {"empty_answer"}), 101: ("Why?", " ​\n", {"empty_answer"}), 102: ("Why?", "[N/A]", {"empty_answer"}), 103: ("Why?", "Yes, the jar.", set()),
        104: ("How do I open the jar?", "You asked: how do I open the jar", {"copied_question"}), 105: ("How do I open the jar?", '"HOW DO I OPEN THE JAR?"', {"copied_question"}), 106: ("How do I open the jar?", "You asked: How do I open the jar?\n" + good, set()),
        107: ("How do I open the jar?", "I'm sorry, but I can't help with that. Please ask someone else.", {"refusal"}), 108: ('Make this polite: "i cant help you with the jar"', "I'm sorry, but I can't help with the jar.", set()), 109: ("How do I open it?", "I can't promise much. " + good, set()),
        110: ("How do I open the jar?", good[:70], {"truncated"}), 111: ("How do I open the jar?", good + "\n- Turn it slowly", set()), 112: ("How do I open the jar?", good[:-1], set()),
        113: ("How do the people open the old jar here?", fill("de", "Tolva"), {"wrong_language"}), 114: ("Write a few sentences in German for the people.", fill("de", "Tolva"), set()), 115: (fill("de", "X"), fill("de", "Y"), set()),
        116: (None, good, set()), 117: ("", "", {"empty_answer"}), 118: ("How do I open the jar?", good * 300, set()),
    }
    rows += [(i, u, a) for i, (u, a, _) in extra.items()]
    rows += [(200 + i, "How do I open the jar without a tool?", "Turn it slowly\nKeep it away from the stove") for i in range(6)]
    df = spark.createDataFrame(rows, "seq bigint, user_msg string, assistant_msg string").withColumn("defect", F.lit("x")).withColumn("id", F.lit(1))
    nb = pairs.NaiveBayes.train([(fill(c, n), c) for c in SENTENCES for n in NAMES])
    got = defaultdict(set)
    for r in pairs.defects(df, nb).collect():
        got[r.seq].add(r.defect)
    assert {i: got[i] for i in extra} == {i: w for i, (_, _, w) in extra.items()}
    assert not any(got[i] for i in range(40))
    assert pairs.defects(df.limit(0), pairs.NaiveBayes.train([])).collect() == []


def test_endings_against_counts_in_memory(spark, monkeypatch):
    import itertools

    from corvane.llm.common import Ids

    rng = random.Random(12)
    words = ["open", "the", "jar", "slowly", "and", "turn", "it", "lid", "again", "Merin", "42"]
    texts = [" ".join(rng.choices(words, [3, 6, 3, 2, 4, 3, 5, 2, 2, 1, 1], k=rng.randint(2, 9))) + rng.choice([".", "", "", "!", "\nThe end."]) for _ in range(900)]
    ends, goes = Counter(), Counter()
    ids = Ids(pairs.xxhash.xxh64_intdigest)
    e, g = pairs.context_counts(texts, ids)
    ends.update(e.tolist())
    goes.update(g.tolist())

    def off(t):
        plain, toks = pairs.ending(t)
        if plain or not toks:
            return plain
        c1, c2, c3 = pairs.contexts(pairs.token_ids(toks[-8:], ids))
        (e1, n1), (e2, n2), (e3, n3) = ((ends[int(c[-1])], ends[int(c[-1])] + goes[int(c[-1])]) for c in (c1, c2, c3))
        named = toks[-1] in ("N", "0")
        if n2 >= pairs.SEEN:
            return e2 < pairs.ENDS[0] * n2 or len(toks) > 2 and n3 >= pairs.SEEN and e3 < pairs.ENDS[1] * n3
        if n1 >= pairs.SEEN:
            before = ends[int(c1[-2])] + goes[int(c1[-2])] if len(c1) > 1 and not named else 0
            return e1 < (pairs.ENDS_CUT if before >= pairs.FREQUENT else pairs.ENDS_ONE) * n1
        return not named and len(toks) > 3

    want = {i for i, t in enumerate(texts) if off(t)}
    df = spark.createDataFrame(list(enumerate(itertools.repeat("How?", 0))) + [(i, "How?", t) for i, t in enumerate(texts)], "seq bigint, user_msg string, assistant_msg string")
    found = lambda: {r.seq for r in pairs.defects(df, pairs.NaiveBayes.train([])).where("defect = 'truncated'").collect()}
    assert found() == want and want
    monkeypatch.setattr(pairs, "MAP_BITS", 32768)  # a map that is too small only lets more contexts through
    assert found() == want
    assert pairs.last_tokens("x" * 3000 + " a b c")[-3:] == ["a", "b", "c"] and len(pairs.last_tokens("wordword " * 20 + "y" * 5000)) > 10


def test_subjects(spark):
    rng = random.Random(8)
    nouns = {"cooking": ["ladle", "broth", "dough", "oven", "spice"], "law": ["jury", "statute", "verdict", "appeal", "clause"], "music": ["violin", "chord", "tempo", "choir", "melody"]}
    plain = ["the neighbours went home by the old road before noon", "nobody could say who had left the gate open again", "a small sign told the visitors to turn left there"]
    say = lambda s: f"the {rng.choice(nouns[s])} and the {rng.choice(nouns[s])} came before the {rng.choice(nouns[s])} again"

    def doc(parts):
        out = [say(s) for s, n in parts.items() for _ in range(n)] + [rng.choice(plain) for _ in range(10 - sum(parts.values()))]
        rng.shuffle(out)
        return ". ".join(x.capitalize() for x in out) + "."

    docs, truth = [], {}
    for i in range(400):
        parts = rng.choice([{}, {"law": 6}, {"music": 8}, {"cooking": 4}, {"law": 4, "music": 4}, {"cooking": 5, "law": 1}, {"cooking": 3, "music": 3, "law": 3}])
        docs.append((i, doc(parts), "wiki"))
        truth[i] = {s for s, n in parts.items() if n > 1}
    labels = [(i, s.upper() + " ") for i in range(150) for s in truth[i]] + [(3, "nonsense"), (4, None), (None, "law")]
    labels = [(i, rng.choice(list(nouns)) if rng.random() < 0.05 else s) for i, s in labels]
    areas = spark.createDataFrame([(k, s) for k, s in enumerate(nouns)], "subject_id int, subject string")
    df = spark.createDataFrame(docs + [(900, None, None), (901, "", "x"), (902, docs[1][1] * 300, "wiki")], "doc_id bigint, text string, source string").withColumn("subject", F.lit("z")).withColumn("k", F.lit(0))
    ls = spark.createDataFrame(labels, "doc_id bigint, subject string")
    got = defaultdict(set)
    for r in subjects.document_subjects(df, subjects.train_subjects(df, ls, areas)).collect():
        got[r.doc_id].add(r.subject)
    assert sum(got[i] == truth[i] for i in truth) >= 0.97 * len(truth)
    assert not got[900] and not got[901] and got[902] == got[1]
    assert subjects.document_subjects(df.limit(0), subjects.train_subjects(df.limit(0), ls.limit(0), areas)).collect() == []
    assert subjects.document_subjects(df, subjects.train_subjects(df, ls, areas.limit(0))).collect() == []


def planted_chain(weights):
    import numpy as np

    m = subjects.SubjectModel(["a", "b", "c"])
    width = len(m._step(np.zeros((1, 2 * 3 + 2 + len(subjects.SOURCES))), np.zeros((1, 0)), 0)[0])
    m.chain = []
    for bias, own, before in weights:
        w = np.zeros(width + len(before))
        w[0], w[1], w[width:] = bias, own, before
        m.chain.append(w)
    return m


def test_beam_finds_the_likeliest_labels(monkeypatch):
    import itertools

    import numpy as np

    # subject a alone is unlikely, but with it b is nearly certain: step by step a is refused, together both are likeliest
    m = planted_chain([(-0.2, 0.0, []), (-0.1, 0.0, [6.0]), (-1.0, 3.0, [0.5, -2.0])])
    x = np.random.default_rng(1).random((50, 2 * 3 + 2 + len(subjects.SOURCES)))

    def joint(row, labels):
        out = 0.0
        for j, w in enumerate(m.chain):
            z = float((m._step(row[None], np.array([labels[:j]], float).reshape(1, j), j) @ w)[0])
            out -= np.logaddexp(0, -z if labels[j] else z)
        return out

    best = [max(itertools.product([0, 1], repeat=3), key=lambda v: joint(row, v)) for row in x]
    got = m.decode(x)
    assert [tuple(map(int, r)) for r in got] == best and any(b[0] for b in best)
    monkeypatch.setattr(subjects, "BEAM", 1)
    assert (m.decode(x) != got).any()


def test_subjects_that_go_together():
    import numpy as np

    rng = random.Random(3)
    nouns = {"art": ["easel", "fresco", "canvas", "sculptor", "gallery"], "law": ["jury", "statute", "verdict", "appeal", "clause"], "sport": ["goal", "referee", "league", "striker", "derby"]}
    plain = ["the neighbours went home by the old road before noon", "nobody could say who had left the gate open again"]
    say = lambda s: f"the {rng.choice(nouns[s])} and the {rng.choice(nouns[s])} came before the {rng.choice(nouns[s])} again"

    texts, labels = [], []
    for _ in range(600):
        parts = rng.choice([{"art": 4, "law": 2}, {"sport": 4, "law": 2}, {"law": 6}, {"art": 5}, {"sport": 6}, {"law": 2}, {"law": 2}])
        out = [say(s) for s, n in parts.items() for _ in range(n)]
        texts.append(". ".join(out + [rng.choice(plain) for _ in range(10 - len(out))]) + ".")
        # whoever labelled these calls a fifth on law enough where the rest is on art, and only there
        labels.append(frozenset(s for s, n in parts.items() if n > 2 or "art" in parts))
    m = subjects.SubjectModel(["art", "law", "sport"])
    m.fit(texts, labels, ["wikipedia"] * len(texts))
    x = m.features([subjects.cut(t) for t in texts], ["wikipedia"] * len(texts))
    right = lambda rows: np.mean([{s for s, g in zip(m.subjects, row) if g} == set(v) for row, v in zip(rows, labels)])
    whole, m.chain = right(m.decode(x)), [np.concatenate([w[: len(w) - j], np.zeros(j)]) for j, w in enumerate(m.chain)]
    assert right(m.decode(x)) < whole - 0.1 and whole > 0.95


def test_calibration_of_labels_that_are_nearly_separable():
    """A few wrong labels beside scores that tell the rest apart: the stretch stays moderate and the loss doesn't grow."""
    import numpy as np

    rng = np.random.default_rng(2)
    y = np.repeat([0.0, 1.0], [765, 88])
    z = np.concatenate([rng.normal(-9, 1.5, 765), rng.normal(9, 1.5, 88)])
    y[[3, 5, 8, 11]], y[[770, 780, 790, 800]] = 1, 0
    x = np.column_stack([np.ones(len(z)), z])

    def loss(w):
        return float((np.logaddexp(0, x @ w) - y * (x @ w)).sum() + 1.5 * ((w - [0.0, 1.0]) ** 2).sum())

    w = subjects._calibrated(np.array([0.0, 1.0]), x, y)
    assert loss(w) <= loss(np.array([0.0, 1.0])) and 0.1 <= w[1] < 2
    assert all(loss(w) <= loss(w + d) + 1e-6 for d in ([0.01, 0], [-0.01, 0], [0, 0.01], [0, -0.01]))
    assert (((x @ w) > 0) == (z > 0)).all()
    free = subjects._logistic(x, y, np.array([0.0, 40.0]))  # held to a start that is far off
    assert np.isfinite(free).all() and ((x @ free > 0) == (z > 0)).mean() > 0.99


def test_pair_defects_of_any_length():
    assert pairs.is_empty("-" * 61) and pairs.is_empty("... " * 500) and not pairs.is_empty("... " * 500 + "word")
    refusal = "I'm sorry, but I can't help with that. " * 40
    assert pairs.is_refusal("How do I bake bread?", refusal) and not pairs.is_refusal("How do I bake bread?", refusal + "Mix flour and water.")
    assert pairs.is_copy("Name three rivers.", "Name three rivers. " * 60) and not pairs.is_copy("Name three rivers.", "The Rhine, the Elbe and the Oder are rivers. " * 60)
    # the last of many changed words counts too
    words = [3 * a + 3 * b for a in "abcdefghijkl" for b in "mnopqrstuvw"]
    slips = [w[:-1] + "x" if i % 6 == 5 else w for i, w in enumerate(words)]
    last = max(i for i in range(len(words)) if slips[i] != words[i])
    assert pairs._slips(words, slips) and not pairs._slips(words, [*slips[:last], "yyyyyy", *slips[last + 1 :]])
