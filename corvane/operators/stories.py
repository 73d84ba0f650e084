"""Parameter products: which combinations still lack records, prompts for them, and checks of generated texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import fixed as X
from corvane.functions import text as T

SPACE = " \t\n\r"


def product(spark: SparkSession, values: dict[str, list[str]]) -> DataFrame:
    """All combinations of lists of values; their number is the product of the lists' lengths, which the caller sets."""
    out = spark.range(1)
    for name, vs in values.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, vs))))
    return out.drop("id")


def deficits(combos: DataFrame, have: DataFrame, target: int, keys: list[str], size: int, seed: int = 42) -> DataFrame:
    """keys, want, have, missing: the target spread evenly, the remainder over the first combinations by hash."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))
    base, rest = divmod(target, size)
    extra = combos.select(*keys, h.alias("_h")).orderBy("_h", *keys).limit(rest).select(*keys, F.lit(1).alias("_x"))
    want = combos.join(extra, keys, "left").withColumn("want", F.lit(base) + F.coalesce("_x", F.lit(0)))
    got = have.groupBy(*keys).agg(F.count("*").alias("have"))
    return want.join(got, keys, "left").select(*keys, F.col("want").cast("bigint").alias("want"), F.coalesce("have", F.lit(0)).alias("have"), F.greatest(F.lit(0), F.col("want") - F.coalesce("have", F.lit(0))).cast("bigint").alias("missing"))


def tidy(text: Column) -> Column:
    """A generated text without pictures and quotes around it, on one line, with no blank before a mark."""
    t = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), X.EMOJI, ""), F.lit(SPACE))
    quoted = t.rlike("(?s)^[\"'“‘].*[\"'”’]$") & (F.length(t) >= 2)
    t = F.when(quoted, F.btrim(F.substring(t, F.lit(2), F.length(t) - 2), F.lit(SPACE))).otherwise(t)
    return F.regexp_replace(F.btrim(F.regexp_replace(t, r"\s+", " ")), r"\s+([.,!?;:])", "$1")


def sentences(text: Column) -> Column:
    """Sentences end with . ! or ? before white space."""
    return F.filter(F.transform(F.split(F.btrim(text), r"(?<=[.!?])\s+"), lambda s: F.btrim(s)), lambda s: s != "")


def names_word_of(phrase: Column, low: Column, least: int = 3) -> Column:
    """Whether some word of a phrase of at least so many letters, or its first four letters, is in a text; also if the phrase has no such word."""
    long = F.filter(F.split(F.lower(F.coalesce(phrase, F.lit(""))), r"\s+"), lambda w: F.length(w) >= least)
    return (F.size(long) == 0) | F.exists(long, lambda w: low.contains(F.substring(w, 1, 4)))


def has_cue(low: Column, key: Column, cues: dict[str, list[str]], otherwise: Column) -> Column:
    """Whether a text has one of the cues listed for a key; `otherwise` for keys without a list."""
    out = None
    for k, stems in cues.items():
        out = (F if out is None else out).when(key == k, T.any_of(low, stems))
    return out.otherwise(otherwise)


def with_story_reason(rows: DataFrame, text: str, fields: dict[str, str] | None = None) -> DataFrame:
    """rows with reason ('ok' or the first fault, with its figure or phrase) and story (its four sentences, null unless ok). fields: column
    names of hero, problem, helper_or_item and lesson."""
    name = lambda f: F.coalesce(F.col((fields or {}).get(f, f)), F.lit(""))
    x = rows.withColumn("_t", tidy(F.col(text))).withColumn("_full", F.lower("_t"))
    x = x.withColumn("_banned", F.get(F.filter(F.array(*map(F.lit, X.STORY_BANNED)), lambda b: F.contains(F.col("_full"), b)), F.lit(0)))
    x = x.withColumn("_ss", sentences(F.col("_t")))
    moral = (F.size("_ss") >= 5) & F.element_at("_ss", -1).rlike(X.STORY_MORAL)
    x = x.withColumn("_ss", F.when(moral, F.slice("_ss", F.lit(1), F.size("_ss") - 1)).otherwise(F.col("_ss")))
    x = x.withColumn("_story", F.array_join(F.slice("_ss", 1, 4), " ")).withColumn("_low", F.lower("_story"))
    size = lambda s: F.regexp_count(s, F.lit(r"\S+"))
    starts = T.col("_low").rlike("^(?:" + "|".join(X.STORY_STARTS) + ")")
    n = F.col("_low")
    reason = (
        F.when(F.col("_t") == "", "empty")
        .when(F.col("_banned").isNotNull(), F.concat(F.lit("banned:"), "_banned"))
        .when(~F.col("_t").rlike(r"[.!?]$"), "truncated")
        .when(F.size("_ss") < 4, F.concat(F.lit("too-short="), F.size("_ss")))
        .when(starts, "template-start")
        .when(F.exists(F.slice("_ss", 1, 4), lambda s: size(s) > 24), "long-sentence")
        .when(~size(F.col("_story")).between(24, 90), F.concat(F.lit("wordcount="), size(F.col("_story"))))
        .when(~n.contains(F.lower(name("hero"))), "hero-missing")
        .when(~names_word_of(name("helper_or_item"), n), "helper-missing")
        .when(~has_cue(n, name("problem"), X.PROBLEM_CUES, names_word_of(name("problem"), n)), "problem-missing")
        .when(~has_cue(F.col("_full"), name("lesson"), X.LESSON_CUES, F.lit(True)), "lesson-not-shown")
        .otherwise("ok")
    )
    x = x.withColumn("reason", reason)
    return x.select(*rows.columns, "reason", F.when(F.col("reason") == "ok", F.col("_story")).alias("story"))


def one_of(key: Column, options: list[str]) -> Column:
    """A fixed choice among options, by hash of the key."""
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(len(options))) + 1).cast("int"))


def moral(key: Column, hero: str = "hero", lesson: str = "lesson") -> Column:
    """A closing line for a story, chosen by hash of the key."""
    return F.replace(F.replace(one_of(key, X.MORALS), F.lit("{hero}"), F.col(hero)), F.lit("{lesson}"), F.col(lesson))


def user_prompt() -> Column:
    """What a generator is asked, with a hint for problems that it tends to miss."""
    hint = F.lit("")
    for problem, text in X.PROBLEM_HINTS.items():
        hint = F.when(F.col("problem") == problem, text).otherwise(hint)
    return F.concat(F.lit("Hero: "), "hero", F.lit(". Setting: "), "setting", F.lit(". Problem: "), "problem", hint, F.lit(". Helper/item: "), "helper_or_item", F.lit(". Lesson: "), "lesson", F.lit("."))


def messages(system: str, examples: list[tuple[str, str]], user: Column) -> Column:
    """The conversation that a generator gets: system, examples, user."""
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    shots = [m for u, a in examples for m in (one("user", F.lit(u)), one("assistant", F.lit(a)))]
    return F.array(one("system", F.lit(system)), *shots, one("user", user))


def option_fault(fields: dict[str, Column]) -> Column:
    """The first field whose value isn't among its options; null for none."""
    out = F.lit(None).cast("string")
    for f in reversed(X.STORY_FIELDS):
        out = F.when(~F.btrim(F.coalesce(fields[f], F.lit(""))).isin(X.STORY_OPTIONS[f]), f).otherwise(out)
    return out
