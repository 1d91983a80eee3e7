"""What is worth keeping: who may yield which kind of fact, what is refused afterwards, and how sure a fact is.

All are rules over columns; the first that holds gives the reason.  Word lists are an English rule pack (fixed values).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.config import CONFIG
from recollect.functions import text

OWNER, GROUP, AIDE = CONFIG.owner, CONFIG.group, CONFIG.assistants[0]
OWN_KINDS = ("correction", "preference", "decision", "life_change")
AIDE_KINDS = ("commitment", "self_correction")
SHARED_KIND = "agreement"
#: Kinds by their words, in the order in which they are tried.
OWN_WORDS = [
    ("correction", r"\b(wrong|incorrect|not true|no longer|rather than|instead)\b"),
    ("preference", r"\b(like|likes|love|loves|hate|hates|prefer|prefers|favou?rite|want)\b"),
    ("decision", r"\b(decided|decide|rule|from now on|agreed|shall)\b"),
    ("life_change", r"\b(bought|moved|started|finished|sick|graduated|hired|quit|was|are)\b"),
]
AIDE_WORDS = [("self_correction", r"\b(my mistake|i was wrong|sorry|apologi[sz]e)\b"), ("commitment", r"\b(i will|i promise|from now on|next time|always|never|is)\b")]
#: Refusals by words; the soft ones give way to promises and to what the owner lays down.
REFUSED = [
    ("setup", r"\b(runs on|deployed|configured|logged in|account)\b", False),
    ("process", r"\b(timed? out|restarted|retry|failed|crashed|fixed|expired)\b", True),
    ("retelling", r"\b(reportedly|allegedly|i heard|they say|it is said|according to)\b", False),
    ("metric", r"\d+(\.\d+)?\s*(%|tokens?|ms|mb|gb|bytes|lines)", False),
    ("passing", r"\b(currently|right now|for now|online|offline|not yet)\b", True),
    ("summary", r"\b(in summary|to sum up|overall|report|recap)\b", True),
    ("advice", r"\b(you should|consider|recommend|suggest|alternatively)\b", False),
    ("cheer", r"\b(don't worry|you got this|well done|cheer up|hugs?)\b", True),
]
PROMISE = r"\b(promise|from now on|next time|never again|i was wrong|i will|rule)\b"
LASTING = r"\b(want|decide|decided|agree|rule|never|always|must|like|hate|prefer|instead|remind me)\b"
RIVAL = r"\b(gpt|assistant_b|assistant_c|gemini|codex)\b"
VERDICT = r"\b(useless|lazy|stupid|smart|unreliable|reliable|lies|terrible|awful|clever)\b"
PRONOUN = r"^(he|she|they|it|someone|somebody|everyone|others|that person)\b"
#: Somebody's words retold: kin or others, and a verb of saying.
REPORTED = r"\b(my|her|his|the) (mother|mom|father|dad|sister|brother|friend|boss|teacher|doctor|colleague|roommate)s? (also |just |always )?(said|says|told|thinks|believes|mentioned|complained)\b"
TO_THEM = r"\b(to|with|tell|told|ask|asked) (my|her|his|the) (mother|mom|father|dad|sister|brother|friend|boss|teacher|doctor|colleague|roommate)s? (also |just |always )?(said|says|told|thinks|believes|mentioned|complained)\b"
BIG = r"\b(moved|moving|exam|resigned|quit|hired|divorced|graduated|emigrated|married|engaged|pregnant|surgery|hospital|diagnosed)\b"
JOKE = r"\b(just kidding|joking|lol|pretend)\b"
QUESTION = r"\?|\b(why|how come|is it|are you|do you|would you|what)\b"
STRONG_ASK = r"\b(i want you to|please|you must|never again|from now on|every time|stop|don't)\b"
WEAK_ASK = r"\b(you should|you have to|i don't want|not allowed|remember to|you need)\b"
HEDGE = r"\b(maybe|perhaps|might|not sure|can't|cannot|try to|possibly)\b"
ACCEPT = r"\b(i promise|i will|agreed|understood|of course|no problem|noted|will do|won't)\b"
FIRM = r"\b(i promise|agreed|won't)\b"
AGREE = r"^(ok|okay|yes|yeah|sure|fine|agreed|sounds good|good|do it|go ahead|let's|up to you|whatever you|you decide)\b"
VETO = r"\b(but|however|no|not|don't|instead|wait|why|how|rather)\b"
CLAUSE = r"^[^\p{L}\p{N}]*([^,.!?;\n]*)([,.!?;\n]?)"
STAMPED = r"^[A-Za-z_]{1,14} \([^)]*\): *"
DATED = r"^\d{4}-\d{1,2}-\d{1,2}[, ]*"

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F))


def normal_quote(quote: Column) -> Column:
    """For finding only: full-width forms narrowed, lower case, letters and digits alone."""
    return F.regexp_replace(F.lower(F.translate(quote, _WIDE, _NARROW)), r"[^\p{L}\p{N}]+", "")


def quote_in(quote: Column, source: Column) -> Column:
    q = normal_quote(quote)
    return (q != "") & F.contains(normal_quote(source), q)


def capped_quote(quote: Column, limit: int = 120, least: int = 20) -> Column:
    """At most `limit` characters, up to the last stop or space in them unless that leaves less than `least`."""
    head = F.substring(F.trim(quote), 1, limit)
    upto = F.regexp_extract(head, r"(?s)^(.*[.!?;,\s])", 1)
    return F.when(F.length(F.trim(quote)) <= limit, F.trim(quote)).when(F.length(upto) > least, F.trim(upto)).otherwise(F.trim(head))


def _kind(content: Column, rules: list[tuple[str, str]]) -> Column:
    out, low = F.when(F.lit(False), F.lit("")), F.lower(content)
    for name, pattern in rules:
        out = out.when(low.rlike(pattern), name)
    return out


def category(subject: Column, content: Column) -> Column:
    """The kind of a fact, from its words and its subject; null where the owner's words tell nothing."""
    return (
        F.when(subject == GROUP, SHARED_KIND)
        .when(subject == AIDE, F.coalesce(_kind(content, AIDE_WORDS), F.lit("other")))
        .when(subject == OWNER, F.coalesce(_kind(content, OWN_WORDS), F.when(F.lower(content).rlike(BIG), "life_change")))
    )


def role_check(subject: Column, kind: Column, actors: Column, confirmed: Column) -> Column:
    """Why these speakers can't yield such a fact, or null."""
    has = lambda x: F.array_contains(actors, x)
    only_aide = (F.size(actors) == 1) & has(AIDE)
    known = subject.isin(OWNER, *CONFIG.assistants)
    kinds = F.when(subject == OWNER, kind.isin(*OWN_KINDS)).otherwise(kind.isin(*AIDE_KINDS))
    shared = (
        F.when(~(has(OWNER) & (F.size(actors) >= 2)), "one-sided").when(~confirmed, "not-confirmed")
        .when(kind.isNotNull() & (kind != SHARED_KIND), "group-kind").when((kind == SHARED_KIND) & ~has(AIDE), "agreement-needs-assistant")
    )
    own = (
        F.when((F.size(actors) > 0) & known & ~F.array_contains(actors, subject), F.when(only_aide, "assistant-only-subject").otherwise("speaker-is-not-subject"))
        .when(only_aide & kind.isNotNull() & ~kind.isin(*AIDE_KINDS), "assistant-only-kind")
        .when(kind.isin(*OWN_KINDS) & ~has(OWNER), "owner-kind-without-owner")
        .when(kind.isNotNull() & (F.size(actors) > 0) & known & ~kinds, "kind-not-allowed")
    )
    return F.when((kind == SHARED_KIND) & (subject != GROUP), "agreement-not-group").when(subject == GROUP, shared).otherwise(own)


def reported_speech(content: Column) -> Column:
    """Somebody else's words retold, but not what is said to them."""
    low = F.lower(content)
    return low.rlike(REPORTED) & ~low.rlike(TO_THEM)


def plain(content: Column) -> Column:
    """Without the speaker's stamp and a leading date."""
    return F.regexp_replace(F.regexp_replace(content, STAMPED, ""), DATED, "")


def grounded(content: Column, source: Column | None, least: float = 0.3, said: Column | None = None) -> Column:
    """Whether enough bigrams of a fact are in what was said; a fact of fewer than four passes.  `said` are the bigrams of the source, if they are known."""
    grams = text.bigrams(plain(content))
    return (F.size(grams) < 4) | (text.coverage(grams, text.bigrams(source) if said is None else said) >= least)


def char_cover(content: Column, source: Column) -> Column:
    """The part of a fact's distinct letters that are in what was said; 1 for fewer than four."""
    letters = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}]+", ""), ""), lambda x: x != ""))
    mine = letters(plain(content))
    return F.when(F.size(mine) < 4, 1.0).otherwise(F.size(F.array_intersect(mine, letters(source))) / F.size(mine))


def postcheck(subject: Column, kind: Column, content: Column, quote: Column, source: Column, said: Column | None = None) -> Column:
    """Why a candidate is refused after all, or null.  `said` are the bigrams of the source, if they are known."""
    low = F.lower(content)
    promise = (subject.isin(*CONFIG.assistants) | kind.isin(*AIDE_KINDS)) & low.rlike(PROMISE)
    wins = promise | ((subject == OWNER) & ~content.rlike(STAMPED) & low.rlike(LASTING))
    out = (
        F.when(F.length(quote) < 4, "no-quote").when(~quote_in(quote, source), "quote-not-said").when(F.trim(content) == "", "empty")
        .when(F.trim(subject) == "", "vague-subject").when((subject != AIDE) & ~content.rlike(STAMPED) & F.lower(plain(content)).rlike(PRONOUN), "pronoun-subject")
    )
    for name, pattern, soft in REFUSED:
        out = out.when(low.rlike(pattern) & ~wins if soft else low.rlike(pattern), name)
    out = out.when(low.rlike(RIVAL) & low.rlike(VERDICT), "verdict-on-others").when((subject != AIDE) & reported_speech(content), "retelling")
    return out.when(~grounded(content, source, said=said) & (char_cover(content, source) < 0.4), "ungrounded")


def request_reason(line: Column) -> Column:
    """Why a line of the owner's lays nothing down, or null."""
    low = F.lower(line)
    return F.when(low.rlike(JOKE), "joke").when(low.rlike(QUESTION) & ~low.rlike(STRONG_ASK), "question").when(low.rlike(STRONG_ASK) | low.rlike(WEAK_ASK), None).otherwise("no-request")


def accept_reason(line: Column) -> Column:
    """Why a line of the assistant's promises nothing, or null."""
    low = F.lower(text.without_thoughts(line))
    return F.when(low == "", "thoughts").when(low.rlike(HEDGE) & ~low.rlike(FIRM), "hedged").when(low.rlike(ACCEPT), None).otherwise("no-accept")


def consents(line: Column) -> Column:
    """Whether the first clause of a line agrees: it opens with consent, takes nothing back and is no question."""
    clause, end = F.trim(F.lower(F.regexp_extract(line, CLAUSE, 1))), F.regexp_extract(line, CLAUSE, 2)
    return (clause != "") & (end != "?") & ~clause.rlike(VETO) & clause.rlike(AGREE)


def confidence(subject: Column, kind: Column, actor: Column) -> Column:
    return F.when((subject == GROUP) | actor.isin(*CONFIG.assistants), 0.6).when((actor == OWNER) & (subject == OWNER) & kind.isin(*OWN_KINDS), 0.9).otherwise(0.5)


def priority(subject: Column, kind: Column, content: Column, actor: Column) -> Column:
    """What may still enter when a slice has had its share."""
    low = F.lower(content)
    own = (kind.isin("decision", "correction", "preference") & low.rlike(LASTING)) | (kind.isin("life_change", "decision") & low.rlike(BIG))
    return F.coalesce(F.when((subject == OWNER) & (actor == OWNER), own).when((subject == AIDE) & (actor == AIDE), kind.isin(*AIDE_KINDS) & low.rlike(PROMISE)), F.lit(False))
