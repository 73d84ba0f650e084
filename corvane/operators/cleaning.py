"""Documents cleaned to plain prose, or rejected with the first reason against them; two profiles.

Mark-up is resolved first (entities, visible text, links, punctuation, compatibility characters); then lines are judged one by
one inside the row, with higher-order functions; then the document. Python sees only texts that hold an entity, a
tag or a character beyond ASCII. Nulls and short texts are 'too_short_raw'.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import fixed as X
from corvane.functions import text as T


@dataclass(frozen=True)
class Profile:
    """What the two ways of cleaning differ in. 'strict' cleans a corpus; 'intake' filters documents as they arrive."""

    name: str
    least_chars: int
    tag: str
    hidden: list[str] = field(default_factory=list)
    breaks: list[str] = field(default_factory=list)
    alpha: float = 0.64
    latin: float = 0.94
    distinct_lines: float = 0.60


STRICT = Profile("strict", 200, X.HTML_TAG, X.HIDDEN_B, X.BREAKS_B)
INTAKE = Profile("intake", 250, X.TAG_LIKE, X.HIDDEN_A, X.BREAKS_A, 0.62, 0.92, 0.55)
SPACE = " \t\n\r\x0b\x0c"
FENCE = r"(?:(?<=\n)|^)[ \t]*(?:```|~~~)[^\n]*(?:\n|$)"


class _Shown(HTMLParser):
    """Gathers what a reader would see."""

    def __init__(self, hidden: frozenset[str], breaks: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.breaks, self.inside, self.seen = hidden, breaks, 0, []

    def _tag(self, name: str, step: int) -> None:
        if name in self.hidden:
            self.inside = max(0, self.inside + step)
        elif name in self.breaks and not self.inside:
            self.seen.append("\n")

    def handle_starttag(self, tag, attrs):
        self._tag(tag, 1)

    def handle_endtag(self, tag):
        # the end of a hidden element that was never begun counts as nothing
        self._tag(tag, -1)

    def handle_data(self, data):
        if not self.inside:
            self.seen.append(data)


def shown(text: str, p: Profile) -> str:
    parser = _Shown(frozenset(p.hidden), frozenset(p.breaks))
    parser.feed(text)
    parser.close()
    return "".join(parser.seen)


def visible_text(c: Column | str, p: Profile = STRICT) -> Column:
    """Entities resolved and, where a tag occurs, only the visible text."""
    import re

    tag = re.compile(p.tag)

    @F.pandas_udf("string")
    def resolve(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            t = html.unescape(t)
            return shown(t, p) if tag.search(t) else t

        return s.map(one, na_action="ignore").astype(object)

    c = T.col(c)
    return F.coalesce(resolve(F.when(c.contains("&") | c.contains("<"), c)), c)


def compatible(c: Column | str) -> Column:
    """Compatibility composition (NFKC) of texts beyond ASCII."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore").astype(object)

    c = T.col(c)
    return F.coalesce(compose(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def plain_text(c: Column | str, p: Profile = STRICT) -> Column:
    c = visible_text(c, p)
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, X.IMAGE, " "), X.LINK, "$1"), X.CITATION, "")
    c = F.regexp_replace(compatible(T.fold_punctuation(c)), X.CONTROL, "")
    return F.regexp_replace(c, r"\r\n|[\r\x{85}\x{2028}\x{2029}]", "\n")


def is_table_line(c: Column) -> Column:
    return T.is_table_line(c)


def is_code_line(c: Column, p: Profile) -> Column:
    if p.name == "strict":
        return T.is_code_line(c)
    size = F.length(c)
    return c.rlike(X.CODE_LINE_A) | c.rlike(X.CODE_TOKEN_A) | (size - F.length(F.translate(c, "{}", "")) >= 2) | ((size > 20) & ((size - F.length(F.translate(c, X.CODE_SYMBOLS, ""))) / size > 0.14))


def lines(c: Column) -> Column:
    """The trimmed lines of a text with the number of code fences before each; fence lines themselves are left out."""
    parts = F.split(c, FENCE, -1)
    last = F.size(parts) - 1

    def cut(part: Column, k: Column) -> Column:
        # the line end before a fence belongs to the line, so it begins no other
        body = F.when((k < last) & part.endswith("\n"), F.substring(part, F.lit(1), F.length(part) - 1)).otherwise(part)
        rows = F.transform(F.split(body, "\n", -1), lambda x: F.struct(F.btrim(x, F.lit(SPACE)).alias("l"), k.alias("k")))
        return F.when((k < last) & (part == ""), F.array().cast("array<struct<l:string,k:int>>")).otherwise(rows)

    return F.flatten(F.transform(parts, cut))


def fences(c: Column) -> Column:
    return F.size(F.split(c, FENCE, -1)) - 1


def _kind(line: Column, p: Profile) -> Column:
    """What becomes of a line (struct l, k, m: without heading and list marks)."""
    m, inside = line["m"], line["k"] % 2 == 1
    few = F.regexp_count(m, F.lit(r"\S+")) <= 24
    out = F.when(inside, F.when(line["l"] != "", "code").otherwise("none")).when(line["l"] == "", "blank").when(m == "", "none")
    if p.name == "strict":
        letters = T.letters(m)
        out = out.when(is_table_line(m), "boiler").when(is_code_line(m, p), "code").when(T.is_boilerplate_line(m), "boiler")
        out = out.when((letters > 0) & (T.latin_letters(m) / F.greatest(letters, F.lit(1)) < 0.72), "none")
        bare = line["u"]
        return out.when((F.length(bare) > 300) & ~bare.contains(" "), "none").when(bare == "", "none").otherwise("keep")
    out = out.when(is_table_line(m), "none").when(is_code_line(m, p), "code").when(few & m.rlike(X.BOILERPLATE_A), "none")
    return out.when((F.length(m) > 300) & ~m.contains(" "), "none").when(line["u"] == "", "none").otherwise("keep")


def judged_lines(docs: DataFrame, text: str, source: str, p: Profile) -> DataFrame:
    """docs and _lines (struct of kind and line), _content, _code, _boiler: counts up to the heading at which the document ends."""
    plain = lambda x: F.btrim(F.regexp_replace(x, X.HEADING, ""), F.lit(SPACE))
    x = docs.withColumn("_all", lines(F.col(text)))
    wiki = F.coalesce(T.col(source), F.lit("")).isin(X.WIKI_SOURCES)
    x = x.withColumn("_stop", F.when(wiki, F.array_position(F.transform("_all", lambda v: (v["k"] % 2 == 0) & F.lower(plain(v["l"])).isin(X.STOP_SECTIONS)), True)).otherwise(0).cast("int"))
    x = x.withColumn("_fences", F.when(F.col("_stop") > 0, F.element_at("_all", F.col("_stop"))["k"]).otherwise(fences(F.col(text))))
    x = x.withColumn("_all", F.when(F.col("_stop") > 0, F.slice("_all", F.lit(1), F.col("_stop") - 1)).otherwise(F.col("_all")))
    mark = lambda v: F.regexp_replace(plain(v["l"]), X.LIST_MARK, "")
    marked = F.transform("_all", lambda v: F.struct(v["l"].alias("l"), v["k"].alias("k"), (F.btrim(mark(v), F.lit(SPACE)) if p.name == "strict" else mark(v)).alias("m")))
    x = x.withColumn("_all", marked)
    tidy = lambda m: F.btrim(F.regexp_replace(F.regexp_replace(m, X.URL, ""), r"[ \t]+", " "), F.lit(SPACE))
    x = x.withColumn("_all", F.transform("_all", lambda v: F.struct(v["l"].alias("l"), v["k"].alias("k"), v["m"].alias("m"), tidy(v["m"]).alias("u"))))
    x = x.withColumn("_lines", F.transform("_all", lambda v: F.struct(_kind(v, p).alias("kind"), v["u"].alias("line"))))
    n = lambda kind: F.size(F.filter("_lines", lambda v: v["kind"] == kind))
    seen = F.size(F.filter("_all", lambda v: (v["k"] % 2 == 0) & (v["l"] != ""))) + F.when(F.col("_stop") > 0, 1).otherwise(0)
    code = n("code") + F.col("_fences")
    if p.name != "strict":  # lines within fences aren't counted there
        code = F.col("_fences") + n("code") - F.size(F.filter("_all", lambda v: (v["k"] % 2 == 1) & (v["l"] != "")))
    return x.withColumns({"_content": seen, "_code": code, "_boiler": n("boiler")}).drop("_all", "_stop", "_fences")


def rebuilt() -> Column:
    """The kept lines, with one blank line where there were any between two of them."""
    kept = F.transform(F.filter("_lines", lambda v: v["kind"].isin("keep", "blank")), lambda v: F.when(v["kind"] == "keep", v["line"]).otherwise(""))
    return F.btrim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), F.lit(SPACE))


def top_share(words: Column) -> Column:
    """How often the most frequent of some words occurs: the longest run of the sorted words."""
    zero = F.struct(F.lit("").alias("w"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["w"] == x, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("w"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(F.array_sort(words), zero, step)["best"]


def clean(docs: DataFrame, p: Profile = STRICT, text: str = "text", source: str = "source", language: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs, reason ('accepted' or the first reason against the document) and cleaned (null if rejected).

    source is the canonical name. language: an expression that gives the language code of a text, asked by the strict profile
    where words leave a doubt; None: such texts pass."""
    raw = F.col(text)
    x = docs.withColumn("_plain", plain_text(F.when(F.length(raw) >= p.least_chars, raw), p))
    x = judged_lines(x, "_plain", source, p).withColumn("_t", rebuilt())
    words = F.regexp_extract_all("_t", F.lit(X.WORD), F.lit(0))
    x = x.withColumns({"_w": F.transform(words, lambda w: F.btrim(F.lower(w), F.lit("'"))), "_caps": F.size(F.filter(words, lambda w: w.rlike("^[A-Z'-]{2,}$"))), "_long": F.size(F.filter(words, lambda w: F.length(w) > 40))})
    x = x.withColumns({"_n": F.size("_w"), "_st": F.size(F.filter("_w", lambda w: w.isin(X.STOP_WORDS))), "_v": T.visible("_t"), "_a": T.letters("_t"), "_la": T.latin_letters("_t"), "_d": T.decimal_digits("_t"), "_ls": F.filter(F.split("_t", "\n"), lambda v: v != "")})
    x = x.withColumn("_u", F.size(F.array_distinct("_ls")))
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    lost = F.length(raw) - F.length(F.replace(raw, F.lit("�"), F.lit("")))
    few_lines = (F.size("_ls") >= 8) & (F.col("_u") / F.size("_ls") < p.distinct_lines)
    script = (F.col("_a") == 0) | (part("_la", "_a") < p.latin)
    foreign = (F.col("_st") < 3) | (part("_st", "_n") < 0.045)
    digits = part("_d", "_v") > 0.18
    out = F.when(raw.isNull() | (F.length(raw) < p.least_chars), "too_short_raw")
    if p.name == "strict":
        told = language(F.substring("_t", 1, 2000)) if language else F.lit("en")
        many = lambda n, most, some, share: (F.col(n) >= most) | ((F.col(n) >= some) & (F.col(n) / F.col("_content") >= share))
        has = F.col("_content") > 0
        out = (
            out.when(lost > 0, "replacement_character")
            .when(~F.is_valid_utf8(raw), "broken_unicode")
            .when(has & many("_code", 15, 5, 0.08), "code_heavy")
            .when(has & (F.col("_code") >= 3) & F.col("_plain").rlike(X.SOFTWARE), "software_documentation")
            .when(has & many("_boiler", 12, 5, 0.30), "boilerplate_heavy")
            .when(T.words("_t") < 50, "too_short")
            .when((F.col("_v") == 0) | (part("_a", "_v") < p.alpha), "low_alpha")
            .when(script, "non_english_script")
            .when(digits, "too_many_digits")
            .when(foreign, "non_english_heuristic")
            .when((part("_st", "_n") < 0.10) & (told != "en"), "non_english_classifier")
            .when(few_lines, "repetition")
            .when(F.col("_t").rlike(X.HTML_TAG) | F.col("_t").rlike(X.ENTITY), "residual_html")
        )
    else:
        out = (
            out.when(lost > F.greatest(F.lit(2), F.floor(F.length(raw) / 2000)), "broken_unicode")
            .when((F.col("_content") > 0) & (F.col("_code") / F.col("_content") > 0.20), "code")
            .when(F.col("_n") < 50, "too_short")
            .when(F.col("_n") > 40_000, "too_long")
            .when((F.col("_v") == 0) | (part("_a", "_v") < p.alpha), "low_alpha")
            .when(script, "non_english_script")
            .when(foreign, "non_english")
            .when(digits, "too_many_digits")
            .when(F.col("_long") > F.greatest(F.lit(2), F.floor(F.col("_n") / 100)), "broken_tokens")
            .when(part("_caps", "_n") > 0.22, "too_many_caps")
            .when(few_lines | ((F.col("_n") >= 100) & (top_share(F.col("_w")) / F.col("_n") > 0.14)), "repetition")
        )
    x = x.withColumn("reason", out.otherwise("accepted"))
    return x.select(*docs.columns, "reason", F.when(F.col("reason") == "accepted", F.col("_t")).alias("cleaned"))


def with_pieces(docs: DataFrame, text: str = "text", name: str = "pieces", max_words: int = 10_000, target: int = 8000, least: int = 50) -> DataFrame:
    """docs with an array of the pieces of a long text, cut at blank lines: a text of at most max_words is one piece, unchanged. Paragraphs fill a
    piece up to `target` words; one of more than max_words is cut into runs of `target` first. A last piece of under
    `least` words joins the one before; pieces still shorter or longer than allowed are left out. A null text has no array."""
    c = F.col(text)
    word_list = lambda v: F.filter(F.split(F.regexp_replace(F.btrim(v, F.lit(SPACE)), r"\s+", " "), " "), lambda w: w != "")
    # each step is a column of its own, so that none is computed more than once
    x = docs.withColumn("_long", T.words(c) > max_words)
    x = x.withColumn("_w", F.when(F.col("_long"), F.transform(F.split(c, "\n\n"), word_list)))

    def runs(w: Column) -> Column:
        whole = F.greatest(F.lit(0), F.ceil((F.size(w) - max_words) / F.lit(target))).cast("int")  # runs of target words before the rest
        unit = lambda k: F.when(k < whole, F.slice(w, k * target + 1, F.lit(target))).otherwise(F.slice(w, k * target + 1, F.greatest(F.size(w) - k * target, F.lit(0))))
        return F.transform(F.sequence(F.lit(0), whole), lambda k: F.struct(unit(k).alias("w"), (k < whole).alias("alone")))

    units = F.flatten(F.transform("_w", runs))
    x = x.withColumn("_u", F.filter(F.transform(units, lambda u: F.struct(F.array_join(u["w"], " ").alias("t"), u["alone"].alias("alone"), F.size(u["w"]).alias("n"))), lambda u: u["n"] > 0))
    # number of the piece, words in it so far and, for each unit, its piece
    zero = F.struct(F.lit(0).alias("piece"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("out"))

    def place(a: Column, u: Column) -> Column:
        full = (a["held"] > 0) & (u["alone"] | (a["held"] + u["n"] > target))
        p = a["piece"] + F.when(full, 1).otherwise(0)
        held = F.when(u["alone"], 0).when(full, u["n"]).otherwise(a["held"] + u["n"])
        return F.struct((p + F.when(u["alone"], 1).otherwise(0)).cast("int").alias("piece"), held.cast("int").alias("held"), F.concat(a["out"], F.array(p.cast("int"))).alias("out"))

    x = x.withColumn("_at", F.aggregate("_u", zero, place, lambda a: a["out"]))
    x = x.withColumn("_tail", F.aggregate(F.zip_with("_at", "_u", lambda p, u: F.when(p == F.array_max("_at"), u["n"]).otherwise(0)), F.lit(0), lambda a, n: a + n))
    last = F.array_max("_at")
    x = x.withColumn("_at", F.when((last > 0) & (F.col("_tail") < least), F.transform("_at", lambda p: F.least(p, last - 1))).otherwise(F.col("_at")))
    x = x.withColumn("_zip", F.zip_with("_at", "_u", lambda p, u: F.struct(p.alias("p"), u["t"].alias("t"))))
    joined = F.transform(F.array_distinct("_at"), lambda p: F.array_join(F.transform(F.filter("_zip", lambda r: r["p"] == p), lambda r: r["t"]), "\n\n"))
    fine = F.filter(joined, lambda v: T.words(v).between(least, max_words))
    return x.withColumn(name, F.when(~F.col("_long"), F.array(c)).otherwise(fine)).drop("_long", "_w", "_u", "_at", "_tail", "_zip")


def split_long(docs: DataFrame, key: str, text: str = "text", max_words: int = 10_000, target: int = 8000, least: int = 50) -> DataFrame:
    """key, part, parts, part_id (the key alone where there is one piece), piece: a row for each piece of each text that isn't null."""
    x = with_pieces(docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text")), "_text", "_p", max_words, target, least)
    part_id = F.when(F.col("parts") == 1, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("#part-"), F.col("part")))
    # an outer generator, since Spark puts a filter with the whole expression before a plain one
    x = x.select(key, F.size("_p").alias("parts"), F.posexplode_outer("_p").alias("part", "piece")).where("piece is not null")
    return x.withColumn("part", F.col("part") + 1).select(key, "part", "parts", part_id.alias("part_id"), "piece")


def flags(text: Column | str) -> Column:
    """Everything that validation has against a text, in order."""
    c = F.coalesce(T.col(text), F.lit(""))
    ls = T.lines(c)
    flag = lambda p, name: F.when(p, F.lit(name))
    return F.array_compact(
        F.array(
            flag(F.btrim(c, F.lit(SPACE)) == "", "empty"),
            flag(c.contains("�") | c.rlike(X.CONTROL), "broken_unicode"),
            flag(c.rlike(X.HTML_TAG), "html"),
            flag(c.rlike(X.ENTITY), "html_entity"),
            flag(T.is_boilerplate_line(c), "boilerplate"),
            flag(F.size(F.filter(ls, T.is_code_line)) >= 3, "code"),
            flag(F.size(F.filter(ls, T.is_table_line)) >= 2, "table"),
            flag(T.words(c) < 50, "too_short"),
            flag(T.words(c) > 10_000, "too_long"),
        )
    )


def repair(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """docs with the text repaired, and outcome: 'kept' where validation has nothing against it; else the text is cleaned and cut, and the first piece
    that passes takes its place ('repaired'), or none does ('rejected', text null)."""
    # one pass: texts that pass are null to the cleaner, which costs nothing
    x = docs.withColumn("_f", F.size(flags(text))).withColumn("_raw", F.when(F.col("_f") > 0, F.col(text)))
    x = with_pieces(clean(x, STRICT, "_raw", source), "cleaned", "_p").withColumn("_p", F.filter("_p", lambda v: F.size(flags(v)) == 0))
    x = x.withColumn("_new", F.when(F.col("_f") == 0, F.col(text)).otherwise(F.get("_p", F.lit(0))))
    x = x.withColumn("outcome", F.when(F.col("_f") == 0, "kept").when(F.col("_new").isNull(), "rejected").otherwise("repaired"))
    return x.select(*(F.col("_new").alias(text) if c == text else F.col(c) for c in docs.columns), "outcome")


LEAKS = ["broken_unicode", "html", "html_entity", "boilerplate", "code", "table", "too_short", "too_long"]


def validation_report(docs: DataFrame, schema_counts: dict[str, Column], english: Column, target_bytes: int, key: str = "id", text: str = "text", size: Column | None = None) -> DataFrame:
    """One row: bytes, documents, words, duplicates, schema faults, documents with each leak, the English fraction and the verdict, which is
    PASS only if none of eighteen conditions is met. size: bytes of a record as a line; schema_counts: name -> condition."""
    c = F.coalesce(F.col(text), F.lit(""))
    x = docs.select("*", flags(text).alias("_f"), (size if size is not None else F.octet_length(c) + 1).cast("bigint").alias("_b"), english.alias("_e"))
    has = lambda f: F.count_if(F.array_contains("_f", f))
    r = x.agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum("_b"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(T.words(c)), F.lit(0)).alias("words"),
        *(F.count_if(cond).alias(n) for n, cond in schema_counts.items()),
        has("empty").alias("empty"),
        (F.count("*") - F.countDistinct(key)).alias("duplicate_ids"),
        (F.count("*") - F.countDistinct(F.md5(text))).alias("duplicate_texts"),
        *(has(f).alias(f) for f in LEAKS),
        F.coalesce(F.round(F.avg(F.col("_e").cast("double")), 6), F.lit(0.0)).alias("english_fraction"),
    )
    counts = [*schema_counts, "empty", "duplicate_ids", "duplicate_texts", *LEAKS]
    bad = F.greatest(*(F.col(n) for n in counts)) > 0
    return r.withColumn("verdict", F.when((F.col("bytes") < target_bytes) | bad | (F.col("english_fraction") < 0.995), "FAIL").otherwise("PASS"))
