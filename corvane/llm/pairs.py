"""Prompt and response pairs that don't serve, with the kind of their defect.

wrong_language compares the language posteriors of prompt and response under a naive Bayes model over character n-grams, trained
on a bounded sample of labelled documents. truncated uses an end-of-text n-gram model: over all responses, how often a context
of one to three tokens was followed by the end of a sentence or line, and how often by more text. Only contexts at which
some response ends open are counted (a fixed bit map of them spares the others the exchange), each under 64 bits of its hash, and the
counts are joined to the open responses, so the model is as exact at any size. The other defects follow from the two texts.

A null, empty or placeholder response is empty_answer and nothing else. A null or empty prompt gets no comparison.
Repeated pairs get their rows each under their own key. Extra columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import LANGUAGES, Ids, arrow_schema, chunks, materialize
from corvane.llm.language import sentences
from corvane.llm.quality import COMMON

DEFECTS = ("empty_answer", "truncated", "refusal", "copied_question", "wrong_language")
#: Bits of the map of contexts that are asked for (8 MB); of more contexts than it holds, others are counted too, in vain.
MAP_BITS = 1 << 26
#: A context seen so often decides; a shorter one is asked else.
SEEN = 4
#: A response breaks off if after its last two, or three, tokens an end has less than this probability.
ENDS = (0.02, 0.06)
#: The same after its last token, where the last two are hardly ever seen.
ENDS_ONE = 0.12
#: The same where the token before is frequent.
FREQUENT, ENDS_CUT = 200, 0.7
#: The language of a shorter text isn't compared.
LEAST_LETTERS = 12
GRAM_SLOTS = 1 << 14

_UNSEEN = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯⠀ㅤ️﻿]")
_TOKEN = re.compile(r"\n+|[^\W_]+(?:['’][^\W_]+)*|[^\w\s]|_")
_WORD = re.compile(r"[^\W\d_]+")
_SMILE = re.compile(r"(?:\s*(?:[:;=]-?[)(DPp]|[\u2600-\u27bf\U0001f300-\U0001faff]\ufe0f?))+\s*$")
_PERSONS = frozenset("i me my mine you your yours im youre ive youve am are".split())
_STOPS = frozenset(".!?…。")
_QUOTES = frozenset("\"'”’»)]}`*_")
# Texts that stand in the place of an answer.
PLACEHOLDERS = frozenset(
    "n a|na|none|null|nil|nan|nothing|blank|empty|no answer|no response|no reply|no output|no content|answer|response|your answer here|insert answer here|todo|to do|tbd|tba|tbc|fixme|wip|pending|placeholder|missing|undefined|unknown|not available|not applicable|no data|void|x|xx|xxx|br|nbsp|lorem ipsum|answer here|no comment|error|null null|coming soon|to be added|to be done|see above|left blank|intentionally left blank|empty string|no text|assistant|deleted|removed|redacted".split("|")
)
# Words in which a copy may be dressed.
DRESSING = re.compile(r"^(?:(?:you|the user|user|he|she|they)(?:'ve| have)? (?:asked|said|wrote|typed|wanted to know|want to know|are asking|asks|says)(?: me)?|(?:your|the|original|here is your|here is the|repeat(?:ing)? (?:your|the))? ?(?:question|message|prompt|request|query|text|input)(?: (?:is|was|reads|again))?|question|user|q|prompt|input|quote|human|i quote|to repeat)\b[\s:–—>,.-]*", re.I)
REFUSAL = re.compile(
    r"\b(?:i|we)(?:'m| am|'re| are)? ?(?:really |simply |just |also |afraid (?:that )?i )?(?:can't|can’t|cannot|can not|cant|won't|won’t|will not|wont|couldn't|could not|unable to|not able to|not allowed to|not permitted to|not going to|not in a position to|not comfortable|not willing to|must refuse|must decline|have to refuse|have to decline|need to decline|must say no|have to say no|decline|refuse|would rather not|'d rather not|’d rather not|prefer not to|would prefer not|don't feel comfortable|do not feel comfortable|have to pass|must pass|may not)\b"
    r"|\b(?:i'm|i’m|i am) (?:unable|not able|not allowed|not permitted|not in a position|not comfortable|not willing|not going|sorry,? (?:but )?no\b)"
    r"|\bi['’]d (?:rather|prefer) not\b|something i (?:have to|must|need to) (?:decline|refuse)|\bnot something i (?:can|could|may|am)\b|(?:isn't|isn’t|is not|not) possible for me\b|\bagainst (?:my|our|the) (?:guidelines|policy|policies|rules|principles|instructions|programming)\b"
    r"|\b(?:falls|is|lies|goes) (?:outside|beyond) (?:of )?(?:what (?:i|we)|my|our)\b|nothing i could say\b.*\bappropriate|\blook elsewhere\b|\bas an ai\b.*\b(?:can't|cannot|can not|not)\b|\bi have no (?:answer|opinion|comment) (?:on|for|to)\b"
    r"|\bno puedo\b|\bno me es posible\b|\bkann ich (?:dir |ihnen |leider )*nicht\b|\bich kann (?:dir |ihnen |leider |dabei |das |diese .{1,20} )*nicht\b|\bje ne (?:peux|suis pas en mesure)\b|\bnon posso\b|\bnão posso\b|\bik kan (?:je |u )?(?:hier |daar |dit )?(?:niet|helaas)\b|не могу\b",
    re.I,
)
FILLER = re.compile(
    r"^\W*(?:(?:well|hmm+|hm|oh|ah|look|honestly|ok|okay|hi|hello|hey|unfortunately|sadly|regrettably|however|but|and|so|sorry|i apologi[sz]e|apologies|my apologies|i'm sorry|i am sorry|i’m sorry|no|nope)\b[\s,.!:;-]*)*"
    r"(?:$|(?:please|kindly|thanks|thank you|is there|are there|can i help|could you|would you|let me know|feel free|i hope|i understand|i appreciate|i know|i realise|i realize|you may want|you might want|you should (?:ask|contact|consult|speak)|that is an? (?:fair|good|great|interesting|reasonable|tricky|difficult)|that's an? (?:fair|good|great|interesting|reasonable|tricky|difficult)|it is an? (?:fair|good|great)|this is an? (?:fair|good|great|sensitive)|sorry to hear|perhaps (?:ask|try asking|someone)|maybe ask|try asking|ask (?:someone else|about something else|me something else)|lo siento|tut mir leid|es tut mir leid|leider|désolé|je suis désolé|mi dispiace|sinto muito|het spijt me|извините|простите)\b)",
    re.I,
)
_REWORK = re.compile(r"\b(?:rewrite|reword|rephrase|shorten|summari[sz]e|polite|politer|grammar|clearer|sound better|improve|correct|proofread|fix|edit|draft|write|compose|translate|reply|respond|message|note|email|letter|decline|refuse|refusal|turn down|say no)\b", re.I)
_DECLINES = re.compile(r"\b(?:(?:i|we) (?:can'?t|can’t|cannot|wont|won'?t|won’t|refuse|decline)|no i|not my job|not in a position|refus\w+|declin\w+|turn\w* down|say\w* no|reject\w*)\b", re.I)
_PLAIN_REFUSAL = frozenset("can cant cannot will wont help with this that the you its not for job note message please sorry unable refuse decline are was our out any more make write text rewrite shorten grammar better sound clearer polite fix due fact".split())
# How a language may be asked for.
LANGUAGE_NAMES = {
    "en": "english|englisch|inglés|anglais|inglese|inglês|engels|английск",
    "de": "german|deutsch|alemán|allemand|tedesco|alemão|duits|немецк",
    "fr": "french|französisch|francés|français|francese|francês|frans|французск",
    "es": "spanish|spanisch|español|castellano|espagnol|spagnolo|espanhol|spaans|испанск",
    "it": "italian|italienisch|italiano|italien|italiaans|итальянск",
    "pt": "portuguese|portugiesisch|portugués|portugais|portoghese|português|portugees|португальск",
    "nl": "dutch|niederländisch|holandés|neerlandés|néerlandais|olandese|holandês|nederlands|голландск|нидерландск",
    "ru": "russian|russisch|ruso|russe|russo|русск",
}
_ASKED = {c: re.compile(rf"(?:{n})", re.I) for c, n in LANGUAGE_NAMES.items()}
_LONGEST = max(map(len, PLACEHOLDERS))


def bare(text: str | None) -> str:
    return _UNSEEN.sub("", text).strip() if text else ""


def is_empty(text: str | None) -> bool:
    t = bare(text)
    if not t:
        return True
    words = ""
    for m in re.finditer(r"[^\W_]+", t.lower()):
        words = f"{words} {m[0]}".lstrip()
        if len(words) > _LONGEST:
            return False
    return not words or words in PLACEHOLDERS


def _plain(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower().replace("'", "").replace("’", ""))


def _same(words: list[str]) -> list[str]:
    """A copy may turn the prompt's persons round."""
    return ["you" if w in _PERSONS else w for w in words]


def is_copy(user: str, answer: str) -> bool:
    """The answer is the prompt, once or more, perhaps in quotes, in other case or punctuation or after a few words such as 'you asked'."""
    if len(answer) < 0.7 * len(user):
        return False
    u, a = _same(_plain(user)), _same(_plain(answer))
    if not u or not a or len({*u} & {*a}) < 0.5 * len({*u}):
        return False
    asked = {*u}
    forms = [a]
    cut = bare(answer).lstrip("\"'“‘>*#-–— \n")
    while (m := DRESSING.match(cut)) and m.end():
        cut = cut[m.end() :].lstrip("\"'“‘>*#-–— \n")
        forms.append(_same(_plain(cut)))
    for w in forms:
        if not w:
            continue
        if w == u:
            return True
        times = max(1, round(len(w) / len(u)))
        many = u * times
        if abs(len(w) - len(many)) > max(2, len(many) // 10):
            continue
        if sum(x in asked for x in w) < 0.75 * len(many) or sum((Counter(many) & Counter(w)).values()) < 0.75 * len(many):
            continue
        # its beginning too, since a text to be improved is given back without the request before it
        if difflib.SequenceMatcher(None, u[:5], w[:5]).ratio() >= 0.6 and difflib.SequenceMatcher(None, many, w, autojunk=False).ratio() >= 0.85 and _slips(u, w):
            return True
    return False


def _slips(u: list[str], w: list[str]) -> bool:
    """The words differ by slips of the pen only: each word of the one is nearly a word of the other."""
    if len(w) > 1.5 * len(u):
        return True
    missing = [x for x in u if x not in w]
    return len(missing) <= max(2, len(u) // 5) and all(difflib.get_close_matches(x, w, 1, 0.6) for x in missing)


def is_refusal(user: str, answer: str) -> bool:
    """Every sentence of the answer declines or is polite padding, and the prompt doesn't ask for such a text."""
    t = bare(answer)
    declines = padded = 0
    for part in re.split(r"(?<=[.!?…])[\"'”’)]*\s+|\n+", t):
        if REFUSAL.search(part) and not re.search(r"\b(?:so|but) (?:i will|i'll|here|i can)\b(?!['’]t)", part, re.I):
            declines += 1
        elif FILLER.match(part):
            padded += 1
        else:
            return False
    if not declines:
        return False
    if padded or not (_REWORK.search(user) and _DECLINES.search(user)):
        return True
    # asked to reword a text that declines: its answer keeps what that text is about
    return not {w for w in _plain(user) if len(w) > 2} & {w for w in _plain(t) if len(w) > 2} - COMMON - _PLAIN_REFUSAL


def tokens(text: str) -> list[str]:
    out = []
    begins = True
    for t in _TOKEN.findall(text):
        if t[0] == "\n":
            out.append("\n")
            begins = True
        elif t.isdigit():
            out.append("0")
            begins = False
        elif t[0].isalpha():
            out.append("N" if t[0].isupper() and not begins and t != "I" else t.lower())
            begins = False
        else:
            out.append(t)
            begins = t in _STOPS
    return out


def contexts(ids: np.ndarray) -> list[np.ndarray]:
    """For k = 1..3 the hash of the last k tokens at each place (a shorter beginning counts as padded)."""
    out, h = [], np.zeros(len(ids), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(3):
            back = np.concatenate([np.zeros(min(k, len(ids)), np.uint64), ids[: max(0, len(ids) - k)]])
            h = (h ^ (back + np.uint64(k + 1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            out.append(h.view(np.int64))
    return out


def token_ids(toks: list[str], kept: Ids) -> np.ndarray:
    return np.fromiter(map(kept.__getitem__, toks), np.uint64, len(toks))


def last_tokens(text: str, n: int = 10) -> list[str]:
    """At least the last n tokens of a text (all, of fewer)."""
    size = 400
    while True:
        toks = tokens(text[-size:])
        if len(toks) > n or size >= len(text):
            return toks
        size *= 8


def ending(text: str) -> tuple[bool, list[str]]:
    """(whether the text plainly breaks off, its last tokens if they have to tell)."""
    t = _SMILE.sub("", bare(text))
    if not t or t[-1] == ")" and t.rfind("(") > t[:-1].rfind(")"):
        return False, []
    if t.rstrip("\"'”’»)]}`*_")[-1:] in _STOPS:
        return False, []
    toks = last_tokens(t)
    while toks and toks[-1] in _QUOTES and len(toks) > 1 and toks[-1] not in "([{":
        toks.pop()
    if not toks or toks[-1] in _STOPS:
        return False, []
    if toks[-1] in (",", ";", ":", "-", "–", "—", "(", "[", "{", "/", "&"):
        return True, []
    return False, toks


def context_counts(texts: list[str], kept: Ids) -> tuple[np.ndarray, np.ndarray]:
    """The contexts that were followed by an end, and by more text."""
    ends: list[np.ndarray] = [np.zeros(0, np.int64)]
    goes: list[np.ndarray] = [np.zeros(0, np.int64)]
    for t in texts:
        toks = tokens(t)
        if len(toks) < 2:
            continue
        last = np.array([x in _STOPS or x == "\n" for x in toks[1:]] + [False])
        here = np.array([x in _STOPS or x == "\n" or x in _QUOTES for x in toks])
        here[-1] = True  # what follows the last token isn't known
        for c in contexts(token_ids(toks, kept)):
            ends.append(c[last & ~here])
            goes.append(c[~last & ~here])
    return np.concatenate(ends), np.concatenate(goes)


def bit_map(asked: DataFrame, column: str) -> np.ndarray:
    """The bits of MAP_BITS that the values of a column set, as bytes; what reaches the driver is at most the map itself."""
    place = F.pmod(F.col(column), F.lit(MAP_BITS)) + 1
    rows = asked.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    out = np.zeros((MAP_BITS // 32768, 4096), np.uint8)
    for r in rows:
        out[r.b - 1] = np.frombuffer(bytes(r.m), np.uint8)
    return out.ravel()


def breaking_off(openings: DataFrame, answers: DataFrame, key: str, text: str) -> DataFrame:
    """id: of open endings (id, c1, c2, c3, before: context hashes; plain: whether the last token is no name or number; tokens) those after
    whose last tokens, in all answers, a text hardly ever ends."""
    places = F.explode(F.array(*(F.struct(F.lit(n).alias("which"), F.col(c).alias("context")) for n, c in enumerate(("c1", "c2", "c3", "before"))))).alias("x")
    asked = openings.select("id", places).select("id", "x.*").where("context is not null")
    bits = answers.sparkSession.sparkContext.broadcast(bit_map(asked, "context"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, kept, wanted = arrow_schema(ddl), Ids(xxhash.xxh64_intdigest), bits.value
        for whole in batches:
            for part in chunks(whole, "text"):
                sums = []
                for c in context_counts([t for t in part.column(0).to_pylist() if t], kept):
                    at = np.mod(c, MAP_BITS)
                    sums.append(np.unique(c[(wanted[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0], return_counts=True))
                (e, ne), (g, ng) = sums
                zero = lambda x: np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([e, g])), pa.array(np.concatenate([ne.astype(np.int64), zero(g)])), pa.array(np.concatenate([zero(e), ng.astype(np.int64)]))], schema=schema)

    ddl = "context bigint, ends bigint, goes bigint"
    counts = answers.select(F.col(text).alias("text")).where("text is not null").mapInArrow(run, ddl).groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    # many answers may end alike: a join by sorting, whose parts Spark divides where one context has many rows
    joined = asked.join(counts.hint("merge"), "context", "left")
    of = lambda n, c: F.coalesce(F.max(F.when(F.col("which") == n, F.col(c))), F.lit(0))
    seen = joined.groupBy("id").agg(*(of(n, c).alias(f"{c[0]}{n + 1}") for n in range(4) for c in ("ends", "goes")))
    x = openings.select("id", "plain", "tokens").join(seen, "id")
    n = lambda k: F.col(f"e{k}") + F.col(f"g{k}")
    by_two = (F.col("e2") < ENDS[0] * n(2)) | ((F.col("tokens") > 2) & (n(3) >= SEEN) & (F.col("e3") < ENDS[1] * n(3)))
    # after a frequent word nearly all that ever follows is known: what isn't is the beginning of a longer word
    cut = F.when(F.col("plain") & (n(4) >= FREQUENT), ENDS_CUT).otherwise(ENDS_ONE)
    # its last word is hardly ever seen: a word in the middle, unless it is a name, number or the whole of a short text
    off = F.when(n(2) >= SEEN, by_two).when(n(1) >= SEEN, F.col("e1") < cut * n(1)).otherwise(F.col("plain") & (F.col("tokens") > 3))
    return x.where(off).select("id").distinct()


class NaiveBayes:
    """Language posteriors from character n-grams (one to three, with word ends), one score for each word."""

    def __init__(self, codes: list[str], logs: np.ndarray) -> None:
        self.codes, self.logs = codes, logs
        self.words: dict[str, int] = {}
        self.rows = np.zeros((4096, len(codes)))

    def __getstate__(self):
        return self.codes, self.logs

    def __setstate__(self, state):
        self.__init__(*state)

    @staticmethod
    def grams(word: str) -> list[int]:
        w = f"<{word}>"
        return [xxhash.xxh32_intdigest(w[i : i + n]) % GRAM_SLOTS for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    @classmethod
    def train(cls, labelled: list[tuple[str, str]]) -> NaiveBayes:
        codes = sorted({c for _, c in labelled})
        counts = np.full((len(codes), GRAM_SLOTS), 0.5)
        for text, code in labelled:
            at = [g for s, full in sentences(text) if full for w in _WORD.findall(s.lower()) for g in cls.grams(w)]
            counts[codes.index(code)] += np.bincount(at, minlength=GRAM_SLOTS) if at else 0
        return cls(codes, np.log(counts / counts.sum(1, keepdims=True)))

    def posterior(self, text: str) -> np.ndarray:
        """By language; the n-grams of a word overlap, so a word's weight is tempered by a third."""
        if len(self.words) > 300_000:
            self.words.clear()
        ids, get = [], self.words.get
        for w in _WORD.findall(text.lower()):
            at = get(w)
            if at is None:
                at = self._word(w)
            ids.append(at)
        total = self.rows[ids].sum(0) if ids else np.zeros(len(self.codes))
        p = np.exp(total - total.max()) if len(total) else total
        return p / p.sum() if len(p) else p

    def _word(self, word: str) -> int:
        at = self.words[word] = len(self.words)
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = self.logs[:, self.grams(word)].sum(1) / 3
        return at


def asks_for(user: str, code: str) -> bool:
    return _ASKED[code].search(user) is not None if code in _ASKED else False


def wrong_language(user: str, answer: str, model: NaiveBayes) -> bool:
    """The two posteriors agree on no language: the mass that they share is under a hundredth."""
    if not model.codes or sum(map(len, _WORD.findall(user))) < LEAST_LETTERS or sum(map(len, _WORD.findall(answer))) < LEAST_LETTERS:
        return False
    p, q = model.posterior(user), model.posterior(answer)
    if np.minimum(p, q).sum() >= 0.01 or p.max() < 0.95 or q.max() < 0.95:
        return False
    return not asks_for(user, model.codes[int(q.argmax())])


def defects(pairs: DataFrame, languages: NaiveBayes, key: str = "seq", user: str = "user_msg", assistant: str = "assistant_msg") -> DataFrame:
    """key, defect: one row for each defect of each pair."""
    shared = pairs.sparkSession.sparkContext.broadcast(languages)
    ddl = "id bigint, defect string, c1 bigint, c2 bigint, c3 bigint, before bigint, plain boolean, tokens int"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nb, kept, schema = shared.value, Ids(xxhash.xxh64_intdigest), arrow_schema(ddl)
        for whole in batches:
            for part in chunks(whole, "a"):
                rows: list[tuple] = []
                for i, u, a in zip(*(part.column(k).to_pylist() for k in range(3))):
                    found = []
                    if is_empty(a):
                        found = ["empty_answer"]
                    else:
                        u = u or ""
                        if is_copy(u, a):
                            found.append("copied_question")
                        else:
                            off, toks = ending(a)
                            if off:
                                found.append("truncated")
                            elif toks:
                                c1, c2, c3 = contexts(token_ids(toks[-8:], kept))
                                rows.append((i, None, c1[-1], c2[-1], c3[-1], c1[-2] if len(c1) > 1 else None, toks[-1] not in ("N", "0"), len(toks)))
                            if is_refusal(u, a):
                                found.append("refusal")
                        if wrong_language(u, a, nb):
                            found.append("wrong_language")
                    rows += [(i, d, None, None, None, None, None, None) for d in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    found = pairs.select(F.col(key).cast("bigint").alias("id"), F.col(user).alias("u"), F.col(assistant).alias("a")).mapInArrow(run, ddl)
    # a row for each defect and each open ending; the texts aren't kept
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "endings")
    openings = found.where("defect is null")
    # a key may belong to several pairs, so their endings are told apart by the number of the row
    off = breaking_off(openings.drop("id").withColumnRenamed("row", "id"), pairs, key, assistant)
    truncated = openings.join(off.withColumnRenamed("id", "row"), "row", "left_semi").select("id", F.lit("truncated").alias("defect"))
    return found.where("defect is not null").select("id", "defect").unionByName(truncated).withColumnRenamed("id", key)
