"""Lists, patterns and constants that results depend on and that therefore have to be what they are."""

from __future__ import annotations

# Sources of the corpus and other spellings of them.
SOURCES = ["fineweb-edu", "wikipedia", "simple-wikipedia", "smollm-edu", "open-web-math", "stackexchange"]
SOURCE_NAMES = {"fineweb": "fineweb-edu", "wiki": "wikipedia", "simplewiki": "simple-wikipedia", "simple-wiki": "simple-wikipedia", "smollm": "smollm-edu", "math": "open-web-math", "stack": "stackexchange"}

# Words by which English is told, of both cleaning profiles.
STOP_WORDS = """
the of and a to in is was for it with as on be at by this had not are
but from or have an they which one you were all there would their we been
has when who will more no if out so what up its about into than them can
only other some could time these two may then do first any now such like
our over even most made after also did many before through years where much
your way well should because each those people how good very make world see
work get here between both life under day same another know while last
might us great year come since go right used take use during without again
place however found part high every does number course something fact
though public enough system better called find going later important
example different often information question answer
""".split()

# Headings at which an encyclopedia page ends.
STOP_SECTIONS = """
references
external links
see also
further reading
notes
bibliography
citations
sources
footnotes
gallery
related pages
other websites
notes and references
""".strip().split("\n")
WIKI_SOURCES = ["wikipedia", "simple-wikipedia"]

# Patterns of mark-up.
HTML_TAG = r"(?i)</?(?:html|head|body|div|span|p|a|br|hr|table|tr|td|th|tbody|thead|script|style|ul|ol|li|form|nav|footer|header|section|article|iframe|svg|button|input|meta|link)\b[^>]*>"
TAG_LIKE = r"<[!/a-zA-Z][^>]{0,1000}>"
ENTITY = r"(?i)&(?:nbsp|amp|lt|gt|quot|apos|copy|reg|mdash|ndash|#\d{2,5}|#x[0-9a-f]+);"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
URL = r"(?i)(?:https?://\S+|www\.\S+)"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
LINK = r"\[([^\]]+)\]\([^)]+\)"
CITATION = r"\[\d+(?:,\s*\d+)*\]"
HEADING = r"^\s{0,3}#{1,6}\s+"
LIST_MARK = r"^\s*(?:[-*+]|\d+[.)])\s+"
WORD = r"[A-Za-z][A-Za-z'-]*"
# Tags whose content isn't shown, and tags that end a line, of the two profiles.
HIDDEN_B = ["script", "style", "code", "pre", "table", "svg", "nav", "footer", "form"]
HIDDEN_A = ["script", "style", "code", "pre", "table", "svg", "math"]
BREAKS_B = ["p", "div", "br", "li", "article", "section", "header", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "tr"]
BREAKS_A = ["p", "div", "br", "li", "article", "section", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "tr"]

# Patterns of lines that are no prose.
TABLE_RULE = r"^\s*\|?[\s:|-]{6,}\|?\s*$"
CODE_LINE = (
    r"(?i)^\s*(?:```|~~~|def |class |import |from \S+ import |#include|using namespace|public (?:class|static)|private |protected |function |"
    r"func |(?:const|let|var)\s+\w+|(?:if|for|while|switch)\s*\(|SELECT\s+.+\s+FROM|INSERT\s+INTO|CREATE\s+TABLE|pip install|npm install)"
)
CODE_TOKEN = r"(?i)(?:=>|::|&&|\|\||console\.(?:log|error)|System\.out|\b(?:printf|println)\s*\(|^\s*[\w.]+\([^)]*\)\s*;?\s*$)"
CODE_LINE_A = (
    r"(?i)^\s*(?:def |class |import |from \S+ import |#include|using namespace|public (?:class|static)|private |protected |function |func |const |let |"
    r"var |SELECT\s+.+\s+FROM|INSERT\s+INTO|(?:if|for|while)\s*\()"
)
CODE_TOKEN_A = r"(?i)(?:=>|::|&&|\|\||</?[a-z][^>]*>|\b(?:printf|console\.log|System\.out)\s*\()"
CODE_SYMBOLS = r"{}[]<>;`\=_"
SOFTWARE = r"(?i)\b(?:API reference|command[- ]line option|source code|class method|function signature|package manager|stack trace|compiler error|programming language|GitHub repository)\b"
BOILERPLATE = (
    r"(?i)\b(?:cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|subscribe(?: to| now)?|sign[ -]?in|log[ -]?in|"
    r"click here|read more|share this|leave a (?:comment|reply)|related (?:posts|articles)|advertisement|skip to (?:main )?content|"
    r"accept (?:all )?cookies|enable javascript|newsletter|follow us|page tools|print page|print all|back to top)\b"
)
BOILERPLATE_A = (
    r"(?i)\b(?:cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|subscribe to|sign[ -]?in|log[ -]?in|click here|read more|"
    r"share this|leave a (?:comment|reply)|related (?:posts|articles)|advertisement|skip to (?:main )?content|accept cookies|enable javascript|newsletter|follow us|contact us)\b"
)
NAVIGATION = (
    r"(?i)^(?:home\s*[>»|]|(?:previous|next)\s*(?:page|article)?$|(?:views?|author|publish time|posted on|updated on)\s*:\s*|"
    r"(?:main menu|site menu|search this site|continue to site)$|(?:development|aid|economy|trade|human rights|global governance)(?:\s*[&|]\s*\w+){2,})"
)
ADVERTS = r"(?i)\b(?:best price|buy cheap|limited time offer|free download|download (?:pdf|ebook|kindle)|casino bonus|payday loan|write my essay|online dating)\b"

# Patterns of instruction pairs.
FUNCTION_WORDS = """
a an the of to in on at for and or but so if is are was were be been being am
i you he she it we they me him her them my your his our their this that these those
with from by as into about up out down over under not no do does did have has had
can could should would will just than then too very more most some any what why how
when where who which because while there here its it's you're i'm
""".split()
FORBIDDEN = r"(?im)(?:\breverse text\b|\btokeniz|\bdataset\b|\btraining run\b|\bfine-?tun|\bpipeline\b|\bcase note\b|^focus:|^first step\b|\bas an ai language model\b)"
FORBIDDEN_MORE = r"(?im)(?:\breverse text\b|\breversed text\b|\btokeniz|\bdataset\b|\btraining run\b|\bfine-?tun|\bpipeline\b|\bcase note\b|^focus:|^first step\b|\bas an ai language model\b)"
NON_LATIN = r"[Ѐ-ӿ؀-ۿऀ-ॿ぀-ヿ一-鿿가-힯]"
TRANSLATE = r"(?i)(?:\btranslat|how (?:do|to) (?:you |i )?say\b|\bin (?:spanish|french|german|italian|portuguese|japanese|chinese|russian|korean|arabic|latin|dutch|polish)\b|what does .* mean in (?:english|spanish|french|german|italian))"
SELF_LEAK = (
    r"(?i)(?:\bI'?m? (?:a |an )?(?:large )?language model\b|\bI am (?:a |an )?(?:large )?language model\b|\bchatbots? like me\b|\bwe use a (?:large )?language model\b|"
    r"\bI use (?:a )?(?:large )?language model\b|\bI was trained\b|\bmy training\b|\bI(?:'m| am)[^.]{0,40}\btrained\b)"
)
ASKS_TRANSLATION = (
    r"(?i)(?:\b(?:spanish|french|italian|german|portuguese|latin|japanese|chinese|russian|korean) (?:for|version)\b|"
    r"\bthe (?:english|spanish|french|italian|german|portuguese) (?:for|of)\b|\bhow (?:do|to) (?:you |i )?say\b|\btranslat)"
)
GIVES_TRANSLATION = r"(?i)(?:\bin (?:spanish|french|german|italian|portuguese|latin)\b|\b(?:spanish|french|italian|german|portuguese|latin) (?:for|word|phrase|expression|greeting|idiom)\b)"
FOREIGN_PHRASES = (
    r"(?i)\b(?:c'est|je ne sais|qué onda|niño|librería|mañana|sinvergüenza|verstehe nicht|à bientôt|grasse matin|dolce vita|te quiero|te amo|buongiorno|guten tag|grazie|gracias|"
    r"enchanté|bonjour|obrigad|hola|ciao|merci|danke|andiamo|viva la vida|buona fortuna|rompere)\b"
)
ACCENTS = "àâáéèêíìóòôúùñçãõ"
QUOTED_ACCENT = r"(?i)['\"][^'\"]*[àâáéèêíìóòôúùñçãõ][^'\"]*['\"]"
LOAN_WORDS = """
sauté sautéed sautéing sautés café cafés déjà résumé résumés naïve naïveté jalapeño
jalapeños fiancé fiancée cliché clichés purée puréed purées entrée entrées soufflé soufflés piñata
piñatas façade façades crème brûlée exposé touché séance papier-mâché doppelgänger frappé frappés
pâté pâtés flambé flambéed consommé velouté béchamel arête arêtes après crêpe crêpes crêperie
à la flambée protégé protégée vis-à-vis café-au-lait naïvely
""".split()
# A category by the first of these parts that a file's name contains.
CATEGORY_PARTS = [
    ("identity", "identity"),
    ("troubleshoot", "troubleshooting"),
    ("comparison", "comparisons"),
    ("emotional", "emotional"),
    ("unclear", "unclear"),
    ("safety", "safety"),
    ("rewrite", "rewrite"),
    ("explanation", "explanations"),
    ("explain", "explanations"),
    ("everyday", "everyday"),
]

# The fields of a story and what each may be.
STORY_FIELDS = ["hero", "setting", "problem", "helper_or_item", "lesson"]
STORY_OPTIONS = {
    "hero": ["cat", "dog", "rabbit", "fox", "bear", "mouse", "dragon", "robot", "star", "cloud"],
    "setting": ["forest", "moon", "village", "castle", "garden", "sea", "mountain", "school", "dreamland", "snowy field"],
    "problem": ["lost friend", "dark night", "broken toy", "missing key", "scary noise", "sad day", "big storm", "forgotten promise", "lonely creature", "hard choice"],
    "helper_or_item": ["magic leaf", "tiny lamp", "wise owl", "golden bell", "kind fairy", "talking stone", "little boat", "rainbow rope", "warm scarf", "silver star"],
    "lesson": ["kindness", "sharing", "bravery", "honesty", "patience", "friendship", "helping others", "not giving up", "saying sorry", "being careful"],
}
# What shows that a story has its lesson, and its problem.
LESSON_CUES = {
    "kindness": ["kind", "gentle", "caring", "cared", "care", "nice", "warm", "comfort", "sweet", "help", "hug", "smile", "love"],
    "sharing": ["shar", "gave", "give", "took turns", "together", "split", "offered", "handed", "passed", "everyone", "each other", "let them"],
    "bravery": ["brave", "braver", "courage", "bold", "fearless", "dared", "stood up", "faced", "no fear", "not afraid", "strong", "kept going", "without fear"],
    "honesty": ["honest", "truth", "true", "did not lie", "didn't lie", "admit", "told no lie", "owned up", "confess"],
    "patience": ["patien", "wait", "calm", "slowly", "took her time", "took his time", "took its time", "step by step", "one by one"],
    "friendship": ["friend", "together", "befriend", "pal", "buddy", "companion"],
    "helping others": ["help", "rescu", "saved", "assist", "aid", "lend", "support", "came to", "guid", "led", "show", "care", "comfort", "gave"],
    "not giving up": ["give up", "giving up", "gave up", "kept", "keep", "again", "continued", "determinat", "persever", "never stopped", "didn't stop", "did not stop", "tried hard", "harder", "tried again", "would not quit", "tried", "trying", "try", "effort", "struggl", "no matter", "even though"],
    "saying sorry": ["sorry", "apolog", "forgave", "forgive", "made up", "regret"],
    "being careful": ["careful", "carefully", "cautio", "safe", "slowly", "watch out", "looked both", "gently", "step by step"],
}
PROBLEM_CUES = {
    "lost friend": ["lost", "friend", "gone", "missing", "disappear", "vanish", "could not find", "couldn't find", "nowhere"],
    "dark night": ["dark", "night", "no light", "no moon", "no stars", "black sky", "pitch", "gloomy"],
    "broken toy": ["broke", "broken", "toy", "crack", "shatter", "snapped", "in pieces", "fell apart", "torn", "ripped"],
    "missing key": ["miss", "key", "lost", "gone", "could not find", "couldn't find", "nowhere", "vanish"],
    "scary noise": ["scar", "nois", "sound", "fright", "loud", "spooky", "strange", "rumble", "bang", "creak"],
    "sad day": ["sad", "unhapp", "gloom", "cry", "cried", "tear", "down", "blue", "upset", "glum"],
    "big storm": ["storm", "rain", "wind", "thunder", "lightning", "gale", "tempest", "downpour", "blizzard", "snow"],
    "forgotten promise": ["forgot", "forgotten", "promise", "vow", "did not keep", "didn't keep", "broke a"],
    "lonely creature": ["lone", "alone", "lonely", "by itself", "by himself", "by herself", "no friends", "all alone", "no one"],
    "hard choice": ["hard", "choice", "choose", "chose", "decide", "decision", "difficult", "tough", "dilemma", "torn between"],
}
STORY_BANNED = ["```", "...", "…", "{", "}", "#", "*", "|", "</", "http", '"input"', '"story"']
STORY_STARTS = ["once upon a time", "once there was", "once there lived", "long ago", "in a land far", "in a faraway"]
STORY_MORAL = r"(?i)\b(?:lesson|moral|learn(?:ed|t)?\b.*\b(?:that|to|about)|remember(?:ed)?|never forgot|taught (?:us|them|him|her))\b"
MORALS = [
    "The lesson was: {lesson}.",
    "And so the {hero} learned all about {lesson}.",
    "From that day on, the {hero} always remembered {lesson}.",
    "That is how the {hero} discovered the value of {lesson}.",
    "In the end, it was {lesson} that saved the day.",
    "The {hero} was so glad to have learned about {lesson}.",
    "And the {hero} never forgot the importance of {lesson}.",
    "Everyone could see that {lesson} had made everything right.",
]
PROBLEM_HINTS = {
    "hard choice": " (the hero must choose between two good things and can pick only one)",
    "lonely creature": " (a creature that is all alone and longs for a friend)",
}
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2190}-\x{21FF}\x{FE00}-\x{FE0F}\x{2B00}-\x{2BFF}]+"
PROMPT_MARKS = ("<|input|>", "<|story|>", "<|end|>")
