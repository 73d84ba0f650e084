import random

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import cleaning as K
from corvane.operators import curation as C
from corvane.operators import instruction as I
from corvane.operators import service as S
from corvane.operators import stories as P
from corvane.operators import verify as V

GOOD = "The people of the town went to the market on the hill and it was not far from the river that they had seen before. " * 4


def cleaned(spark, texts, p=K.STRICT, source="fineweb-edu"):
    df = spark.createDataFrame([(i, t, source) for i, t in enumerate(texts)], "seq bigint, text string, source string").withColumn("_t", F.lit(1)).drop("_t")
    return [(r.reason, r.cleaned) for r in K.clean(df, p).orderBy("seq").collect()]


VARIED = "\n".join(f"The people of town {i} went to the market on the hill and it was not far from the river." for i in range(9))


def test_reject_reasons_in_order(spark):
    cases = {
        None: "too_short_raw",
        "": "too_short_raw",
        "x" * 199: "too_short_raw",
        GOOD + "�": "replacement_character",
        VARIED + "\n" + "\n".join(["def f(x):"] * 15): "code_heavy",
        VARIED + "\n" + "\n".join(["import x"] * 3) + "\nRead the API reference first.": "software_documentation",
        VARIED + "\n" + "\n".join(["Click here to read more"] * 12): "boilerplate_heavy",
        VARIED + "\n" + "\n".join(["a | b | c | d"] * 12): "boilerplate_heavy",
        "abcdefgh" * 40: "too_short",
        "12 %% 34 ## " * 60: "low_alpha",
        "слово и дело " * 60: "too_short",  # lines in another script are dropped
        "haus baum weg stein licht berg " * 20: "non_english_heuristic",
        "\n".join([GOOD[:120]] * 10): "repetition",
        GOOD + " &amp;lt;": "residual_html",
        GOOD: "accepted",
        VARIED: "accepted",
    }
    assert [r for r, _ in cleaned(spark, list(cases))] == list(cases.values())


def test_cleaned_text(spark):
    text = "# Title of it\n\n* " + VARIED.replace("\n", "\n\n\n") + "\n\n```py\nx = 1\n```\nSee [this page](http://x.y) “now” www.z.org\tend…\n| --- | --- |\nСлово и дело тут\n" + "z" * 400 + "\n## References\nGone"
    wiki = cleaned(spark, [text, text.replace("\n", "\r\n")], source="wikipedia")
    want = "Title of it\n\n" + VARIED.replace("\n", "\n\n") + '\n\nSee this page "now" end...'
    assert [w for _, w in wiki] == [want, want]
    assert cleaned(spark, [text])[0][1] == want + "\nReferences\nGone"
    page = f"<div><p>{VARIED}</p><script>if (a < b) x();</script><nav>menu</nav><li>Fish &amp; chips for all of us</li></div>"
    assert cleaned(spark, [page])[0][1] == VARIED + "\n\nFish & chips for all of us"


def test_intake_profile(spark):
    words = " ".join(f"the river and town number w{chr(97 + i % 26)}{chr(97 + i // 26)} of it" for i in range(40))
    cases = {
        "x" * 249: "too_short_raw",
        words + "���": "broken_unicode",
        words + "\n" + "\n".join(["x = {a: {}}"] * 2): "code",
        "shortened words of the township " * 9: "too_short",
        words.upper(): "too_many_caps",
        words + " " + " ".join(["q" * 41] * 8): "broken_tokens",
        words + " of" * 80: "repetition",
        words + "\nContact us": "accepted",
        words: "accepted",
    }
    got = cleaned(spark, list(cases), K.INTAKE)
    assert [r for r, _ in got] == list(cases.values()) and got[-2][1] == words


def test_repair(spark):
    rows = [(1, GOOD), (2, GOOD + "\nClick here to read more"), (3, "short"), (4, None)]
    df = spark.createDataFrame([(i, t, "wikipedia") for i, t in rows], "seq bigint, text string, source string")
    got = {r.seq: (r.outcome, r.text) for r in K.repair(df).collect()}
    assert got == {1: ("kept", GOOD), 2: ("repaired", GOOD.strip()), 3: ("rejected", None), 4: ("rejected", None)}


def test_validation_flags(spark):
    df = spark.createDataFrame([(0, None), (1, "<p>short</p> &amp; cookie policy"), (2, "a|b|c|d\ne|f|g|h\n" + GOOD), (3, "x" * 10 + "\x01")], "seq bigint, text string")
    got = {r.seq: r.f for r in df.select("seq", K.flags("text").alias("f")).collect()}
    assert got[0] == ["empty", "too_short"]
    assert got[1] == ["html", "html_entity", "boilerplate", "too_short"]
    assert got[2] == ["table"] and got[3] == ["broken_unicode", "too_short"]


def test_first_wins_keeps_the_id_of_a_duplicate_text_taken(spark):
    rows = [(1, "a", "one two"), (2, "a", "other text"), (3, "b", "One, two!"), (4, "b", "fresh words"), (5, "c", "fresh words"), (6, None, "lonely"), (7, None, "lonely")]
    got = {r.seq: r.outcome for r in C.first_wins(spark.createDataFrame(rows, "seq bigint, id string, text string")).collect()}
    assert got == {1: "accepted", 2: "duplicate_id", 3: "duplicate_text", 4: "duplicate_id", 5: "accepted", 6: "accepted", 7: "duplicate_text"}


def test_byte_quota_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("xyz"), rng.randint(1, 50)) for i in rng.sample(range(10_000), 400)]
    quotas = {"x": 900, "y": 10_000_000, "z": 1}
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n int")
    got = sorted(r.doc_id for r in C.byte_quota(df, spark.createDataFrame(list(quotas.items()), "source string, quota bigint"), size=F.col("n"), parts=7).collect())
    want, used = [], dict.fromkeys(quotas, 0)
    for i, s, n in sorted(rows):
        if used[s] < quotas[s]:
            want.append(i)
        used[s] += n
    assert got == sorted(want)


def test_pieces(spark):
    words = lambda n, p: " ".join(f"{p}{i}" for i in range(n))
    long = "\n\n".join([words(300, "a"), words(300, "b"), words(300, "c"), words(20, "d")])
    huge = words(1250, "e")
    df = spark.createDataFrame([(1, "short text"), (2, long), (3, huge), (4, None)], "doc_id bigint, text string")
    rows = K.split_long(df, "doc_id", max_words=500, target=400).collect()
    got = {k: [len(r.piece.split()) for r in sorted(rows, key=lambda r: r.part) if r.doc_id == k] for k in (1, 2, 3, 4)}
    assert got[1] == [2]
    assert got[2] == [300, 300, 320]
    assert got[3] == [400, 400, 450]
    assert got[4] == []


def test_fences(spark):
    df = spark.createDataFrame([(1, "a\n```py\ncode\n```\nb"), (2, "~~~\nopen to the end"), (3, "none")], "seq bigint, text string")
    assert {r.seq: r.kept for r in C.fence_kept(df, "seq").collect()} == {1: "a\nb", 2: "", 3: "none"}


def test_simhash_pairs_and_greedy_keep(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(12)]
    marks = []
    for b in base:
        marks.append(b)
        for errors in (1, 2, 3, 4):
            x = b
            for bit in rng.sample(range(63), errors):
                x ^= 1 << bit
            marks.append(x)
    rows = list(enumerate(marks)) + [(100, marks[0]), (101, None)]
    df = spark.createDataFrame(rows, "seq bigint, simhash bigint")
    pairs = C.simhash_pairs(df)
    got = {(r.a, r.b): r.distance for r in pairs.collect()}
    want = {(i, j): (x ^ y).bit_count() for i, x in enumerate(marks) for j, y in enumerate(marks) if i < j and x != y and (x ^ y).bit_count() <= 3}
    assert got == want
    nodes = df.where("simhash is not null").groupBy("simhash").agg(F.min("seq").alias("i"))
    kept = {r.i: r.kept for r in C.greedy_keep(nodes, pairs).collect()}
    taken = []
    for i in sorted(kept):
        if not any((marks[i] ^ marks[j]).bit_count() <= 3 for j in taken):
            taken.append(i)
    assert sorted(i for i, k in kept.items() if k) == taken


def test_reversal_round_trip_with_special_tokens(spark):
    texts = ["", "abc", "a<|bos|>bc<|eos|>", "<|bos|>", "é<|pad|>ß 日本", None, "a <| b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    turned = V.reversed_columns(df, ["text"])
    got = [r.text for r in turned.orderBy("doc_id").collect()]
    assert got[2] == "<|eos|>cb<|bos|>a" and got[5] is None and got[1] == "cba"
    assert V.verify_pairs(df, turned, "doc_id", ["text"]).count() == 0
    broken = turned.withColumn("text", F.when(F.col("doc_id") == 1, "cbx").otherwise(F.col("text"))).where("doc_id <> 3").unionByName(spark.createDataFrame([(9, "z")], "doc_id bigint, text string"))
    assert {(r.doc_id, r.problem) for r in V.verify_pairs(df, broken, "doc_id", ["text"]).collect()} == {(1, "roundtrip_text"), (3, "missing"), (9, "extra")}


def test_checksum_ignores_order(spark):
    df = spark.range(50).withColumn("t", F.md5(F.col("id").cast("string")))
    assert V.table_checksum(df, ["id", "t"]).first() == V.table_checksum(df.orderBy(F.col("id").desc()), ["id", "t"]).first()


def test_heuristic_reasons(spark):
    rows = {
        ("hi", None): "empty",
        ("hi", "a � b"): "mojibake",
        ("hi", "I was trained on many books."): "self_arch_leak",
        ("how do you say it", "you say it like so"): "foreign_translation",
        ("hi", "We had a nice café au lait there."): "kept",
        ("hi", "We had a nice garçon there today."): "foreign_translation",
        ("hi", "Привет вам и всем друзьям"): "non_english",
        ("what is it in polish", "I do not know that one."): "translation",
        ("hi", "Do you want more of it?"): "follow_up",
        ("hi", "As an AI language model I know it."): "forbidden",
        ("hi", "zeta " * 30): "word_salad",
        ("hi", "too short"): "length",
        ("hi", "This is a fine answer to it."): "kept",
    }
    df = spark.createDataFrame([(i, u, a) for i, (u, a) in enumerate(rows)], "seq bigint, user_msg string, assistant_msg string")
    got = [r.r for r in df.select("seq", I.heuristic_reason().alias("r")).orderBy("seq").collect()]
    assert got == list(rows.values())


def test_sequences_and_masks(spark):
    user, answer = list(range(10, 20)), list(range(50, 56))
    rows = [(1, [1, *user, 2, 1, *answer, 2], 13), (2, [1, 7, 2, 1, *range(100, 140), 2], 4)]
    df = spark.createDataFrame(rows, "seq bigint, ids array<int>, assistant_start int")
    got = {r.seq: (r.ids, r.assistant_start) for r in I.sequences(df, 15).collect()}
    assert got[1] == ([1, *user[-6:], 2, 1, *answer, 2], 9)
    assert got[2] == ([1, 2, 1, *range(100, 112), 2], 3)
    mask = {r.seq: r.m for r in df.select("seq", I.label_mask().alias("m")).collect()}
    assert mask[1] == [-100] * 12 + [*answer, 2]


def test_ema_is_the_fold(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, rng.randint(1, 99)]), str(i)) for k in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "node string, at bigint, v int, id string")
    got = {r.node: r.ema for r in S.ema(df, "node", "at", "v").collect()}
    for k in "ab":
        values = [v for n, _, v, _ in rows if n == k and v is not None]
        e = float(values[0])
        for v in values[1:]:
            e = 0.7 * e + 0.3 * v
        assert abs(got[k] - e) < 1e-3


def test_delta_fold_and_upsert(spark):
    ev = spark.createDataFrame([("j", 1, "a", False), ("j", 2, "b", False), ("j", 3, "c", True), ("j", 4, None, False), ("j", 5, "d", False), ("k", 1, "x", False)], "job_id string, id int, delta string, reset boolean")
    assert {r.job_id: r.text for r in S.fold_deltas(ev).collect()} == {"j": "cd", "k": "x"}
    old = spark.createDataFrame([("n", "up", 1.0, 1), ("m", "up", 2.0, 1)], "name string, status string, load double, at int")
    new = spark.createDataFrame([("n", None, 3.0, 2), ("o", "new", None, 2)], "name string, status string, load double, at int")
    assert {tuple(r) for r in S.upsert_latest(old, new, "name", "at").collect()} == {("n", "up", 3.0, 2), ("m", "up", 2.0, 1), ("o", "new", None, 2)}


def test_story_plan_and_reasons(spark):
    combos = P.product(spark, {"a": ["x", "y"], "b": ["1", "2", "3"]})
    assert combos.count() == 6
    plan = P.deficits(combos, combos.where("a = 'x'"), 8, ["a", "b"], 6).collect()
    assert sum(r.want for r in plan) == 8 and sum(r.missing for r in plan) == sum(max(0, r.want - r.have) for r in plan)


def test_judge_answers(spark):
    raw = spark.createDataFrame([(0, 'ok [{"i": 0, "v": "KEEP"}]'), (1, "nothing"), (2, None)], "batch bigint, text string")
    assert {tuple(r) for r in I.verdicts(raw).collect()} == {(0, 0, "keep")}


def test_empty_tables(spark):
    e = spark.createDataFrame([], "seq bigint, id string, doc_id bigint, text string, source string, simhash bigint, user_msg string, assistant_msg string")
    for df in (C.first_wins(e), C.text_ratios(e), C.line_counts(e, "seq"), K.split_long(e, "doc_id"), C.simhash_pairs(e), I.first_by_user(e), I.judge_prompts(e), C.simhash(e, "seq"), K.clean(e), K.clean(e, K.INTAKE), K.repair(e)):
        assert df.collect() == []


def test_fold_punctuation_and_markup(spark):
    df = spark.createDataFrame([("‘a’ “b” – c… [link](http://x.y) ![i](z) d [1, 2] www.x.org\te",)], "t string")
    assert df.select(T.strip_markup("t")).first()[0] == "'a' \"b\" - c... link d e"


def test_training_prompt_literally(spark):
    df = spark.createDataFrame([("fox", "sea", "sad day", "wise owl", "bravery", "He ran.")], "hero string, setting string, problem string, helper_or_item string, lesson string, story string")
    got = df.select(V.training_prompt()).first()[0]
    assert got == "<|input|>\nyrevarb :nossel\nlwo esiw :meti_ro_repleh\nyad das :melborp\naes :gnittes\nxof :oreh\n\n<|story|>\n.nar eH\n<|end|>"


def test_simhash_of_short_and_null_texts(spark):
    import hashlib

    df = spark.createDataFrame([(1, "One, two!"), (2, None), (3, "")], "seq bigint, text string")
    got = {r.seq: r.bits for r in C.simhash(df, "seq").collect()}
    assert got == {1: hashlib.md5(b"one two").hexdigest()[:16], 2: None, 3: hashlib.md5(b"").hexdigest()[:16]}


def test_long_chains_are_decided_to_their_end(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(9)], "a bigint, b bigint")
    kept = C.greedy_keep(spark.range(10).withColumnRenamed("id", "i"), pairs).collect()
    assert {r.i for r in kept if r.kept} == {0, 2, 4, 6, 8}


def test_ranges_hold_about_as_many_rows(spark):
    from corvane.operators.ranges import ranged, running_total

    ids = [i for i in range(500)] + [10**12 + i for i in range(500)] + [10**15]
    df = spark.createDataFrame([(i,) for i in ids], "k bigint")
    sizes = [r["count"] for r in ranged(df, "k", 10).groupBy("_r").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200
    got = {r.k: r.n for r in running_total(df, [], "k", F.lit(1), "n", 10).collect()}
    assert got == {k: n for n, k in enumerate(sorted(ids))}


def test_shared_tables_are_removed_and_clusters_need_a_folder(spark):
    import os

    import pytest

    from corvane.sources import shared

    df = shared.materialize(spark.range(5), "t")
    path = df._corvane_path.removeprefix("file://")
    assert os.path.isdir(path)
    shared.discard(df)
    assert not os.path.isdir(path)

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        shared.shared_dir(Cluster)


def test_entry_hides_only_a_missing_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/corvane", tmp_path / "corvane", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    alone = run()
    assert alone.returncode == 0 and int(alone.stdout.split()[-1]) > 100
    (tmp_path / "corvane" / "llm").mkdir()
    (tmp_path / "corvane" / "llm" / "__init__.py").write_text("")
    (tmp_path / "corvane" / "llm" / "queries.py").write_text("import a_package_that_is_not_there\n")
    assert run().returncode != 0
