"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bigrams(text: Column) -> Column:
    """Distinct two-character windows without white space; a shorter text is its own gram."""
    s = F.regexp_replace(F.lower(text), r"\s+", "")
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.length(s)
    many = F.array_distinct(F.zip_with(F.slice(chars, 1, n - 1), F.slice(chars, 2, n - 1), lambda a, b: F.concat(a, b)))
    return F.when(n >= 2, many).when(n == 1, F.array(s)).otherwise(F.array().cast("array<string>"))


def plain_bounds(pattern: str) -> str:
    r"""`pattern` with ``\b`` as SQL engines read it: between letters of ASCII and anything else; Java counts é as a letter of a word as well."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def windows(text: Column, n: int) -> Column:
    """The distinct runs of n characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    out = chars
    for k in range(1, n):
        # An empty slice begins behind the end where the text is too short.
        out = F.zip_with(F.slice(out, 1, F.greatest(F.size(chars) - k, F.lit(0))), F.slice(chars, k + 1, F.greatest(F.size(chars) - k, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_distinct(out)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def coverage(query: Column, text: Column) -> Column:
    """Shared grams over the query's grams."""
    return F.coalesce(F.size(F.array_intersect(query, text)) / F.nullif(F.size(query), F.lit(0)), F.lit(0.0))


def card(text: Column) -> Column:
    """A discovery card: the first sentence if it has 8 to 40 characters, else the first 40 with a mark."""
    body = F.trim(F.regexp_replace(text, r"\s+", " "))
    first = F.regexp_extract(body, r"^[^.!?]*[.!?]?", 0)
    return F.when(F.length(first).between(8, 40), first).when(F.length(body) <= 40, body).otherwise(F.concat(F.substring(body, 1, 40), F.lit("…")))


STOP = ("the", "and", "for", "that", "this", "with", "was", "are", "what", "when", "where", "who", "how", "did", "does", "you", "your", "our", "his", "her", "its", "from", "have", "has", "had", "not", "but", "she", "him", "they", "them")


def all_keywords(text: Column) -> Column:
    """The distinct Latin words of three letters and more that are no stop words, in the order they come."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOP)))


def keywords(text: Column, k: int = 6) -> Column:
    """Up to k of them, to ask with."""
    return F.slice(all_keywords(text), 1, k)


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)))


#: Cues of clause types, the strongest first, with confidences (an English rule pack).
CLAUSES = [
    ("preference", r"\b(like|likes|love|loves|prefer|prefers|hate|hates|favou?rite)\b", 0.9),
    ("procedural", r"\b(how to|always|never|must|should|every time|step)\b", 0.8),
    ("semantic", r"\b(is|are|was|were|means|called|named)\b", 0.7),
]


def clause_type(text: Column) -> Column:
    """(fact_type, confidence) of a text: each clause votes; the best kind that isn't episodic wins by confidence scaled with its share."""
    clauses = F.filter(F.split(F.lower(text), r"[.!?;,\n]+"), lambda c: F.length(F.trim(c)) >= 3)
    n = F.size(clauses)
    found = []
    for name, pattern, confidence in CLAUSES:
        mine = _voted(clauses, pattern)
        found.append(F.when(mine > 0, F.struct(F.least(F.lit(0.98), confidence * (0.75 + 0.25 * mine / n)).alias("confidence"), F.lit(name).alias("fact_type"))))
    best = F.array_max(F.array_compact(F.array(*found)))
    plain = F.struct(F.lit(0.5).alias("confidence"), F.lit("episodic").alias("fact_type"))
    return F.when(best.isNull() | (best["confidence"] < 0.55), plain).otherwise(best)


def _voted(clauses: Column, pattern: str) -> Column:
    return F.size(F.filter(clauses, lambda c: c.rlike(pattern)))


#: What is said in answer, by itself (an English rule pack); a picture or two says as little.
ACKS = ("ok", "okay", "yes", "yep", "yeah", "no", "nope", "sure", "thanks", "thankyou", "thx", "gotit", "fine", "great", "k", "lol", "haha", "hm", "hmm", "done", "nice", "right", "alright", "bye", "goodnight", "morning")
PICTURE = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
HEARTBEAT = r"(?i)^(?:heartbeat(?:_ok)?|ping|pong|keep-?alive|alive|tick)\s*[:.!]?$"
TOOL = r"(?i)^(?:<(?:tool_result|function_results)|\[?tool[ _]?(?:result|output)|std(?:out|err)\s*:|exit code\s*:?\s*[0-9]|\$ \S|>>> )"
ERROR_LINE = r"(?i)^\s*(?:(?:[a-z_]+\.)*[a-z]*(?:error|exception|traceback|fatal|warn(?:ing)?|errno)\b|[0-9]{4}-[0-9]{2}-[0-9]{2}[ t][0-9:.,]+\s*\[?(?:error|warn|fatal))"
SHORTEST = 4
#: Reasons for which a message is left out altogether; the others stay as context.
LEFT_OUT = ("heartbeat", "tool-output", "json-blob", "error-log")


def prefilter(message: Column, blob: Column | None = None, thought: Column | None = None) -> Column:
    """Why nothing is to be found in a message, or null: an answer, a sign of life, too little, a tool's output, JSON, a log of errors, a thought.

    An error log begins with a line of an error and half of its lines are such.  `blob` and `thought` (`pool.is_json_blob`, `pool.is_thinking`; the latter for
    an assistant's words alone) are the tests of the message that need more than patterns.
    """
    t = F.trim(message)
    core = F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    errors = F.size(F.filter(lines, lambda x: x.rlike(ERROR_LINE)))
    log = F.coalesce(F.get(lines, F.lit(0)).rlike(ERROR_LINE) & (errors * 2 >= F.size(lines)), F.lit(False))
    out = F.when(core.isin(*ACKS) | ((core == "") & t.rlike(PICTURE)), "ack").when(t.rlike(HEARTBEAT), "heartbeat").when(F.length(core) < SHORTEST, "too-short").when(t.rlike(TOOL), "tool-output")
    if blob is not None:
        out = out.when(blob, "json-blob")
    out = out.when(log, "error-log")
    return out if thought is None else out.when(thought, "thought")


#: Slots with the pattern that fills them (an English registry).
SLOTS = [("contact_phone", r"\+[0-9][0-9 ()-]{7,}"), ("contact_email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"), ("license", r"(?i)licen[cs]e"), ("number", r"[0-9]{3,}")]


def slot(text: Column) -> Column:
    """(key, value) of the first slot whose pattern is found."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("key"), F.lit("").alias("value")))
    for key, pattern in SLOTS:
        out = out.when(text.rlike(pattern), F.struct(F.lit(key).alias("key"), F.regexp_extract(text, pattern, 0).alias("value")))
    return out


def token_estimate(text: Column) -> Column:
    """0.75 for each CJK character and 0.3 for any other."""
    cjk = F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}]"))
    return F.round(0.75 * cjk + 0.3 * (F.length(text) - cjk), 2)


def entropy(text: Column) -> Column:
    """Bits for each character, from the frequencies of the characters; none for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


#: What looks like a key: long runs of the letters of keys; those with much information in each character are masked.
KEYLIKE = r"[A-Za-z0-9_-]{20,}"


def keylike(text: Column, least: float = 3.5) -> Column:
    """The runs that look like random keys, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(KEYLIKE), F.lit(0)), lambda t: entropy(t) >= least)


def masked(token: Column, kind: str) -> Column:
    """Kind, first four and last two characters."""
    return F.concat(F.lit(f"[{kind}:"), F.substring(token, 1, 4), F.lit("…"), F.right(token, F.lit(2)), F.lit("]"))


def without_thoughts(text: Column) -> Column:
    """Without tagged thoughts, also where the opening or the closing tag is lost."""
    paired = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(paired, r"(?s)^.*</think>", ""), r"(?s)<think>.*$", ""))


def clipped(text: Column, limit: int) -> Column:
    """At most `limit` characters, up to the last end of a sentence in their second half, if there is one."""
    head = F.substring(text, 1, limit)
    upto = F.regexp_extract(head, r"(?s)^(.*[.!?。！？])", 1)
    return F.when(F.length(text) <= limit, text).when(F.length(upto) * 2 >= limit, upto).otherwise(head)


def snippet(text: Column, term: Column, reach: int = 30) -> Column:
    """The places of the first two hits of a term, `reach` characters around each, joined where they meet; null without a hit."""
    low = F.lower(text)
    first = F.instr(low, term)
    rest = low.substr(first + F.length(term), F.length(low))
    again = F.instr(rest, term)
    second = F.when(again > 0, first + F.length(term) + again - 1)
    start = lambda at: F.greatest(at - reach, F.lit(1))
    stop = lambda at: F.least(at + F.length(term) - 1 + reach, F.length(text))
    cut = lambda a, b: text.substr(a, b - a + 1)
    two = F.when(start(second) <= stop(first) + 1, cut(start(first), stop(second))).otherwise(F.concat(cut(start(first), stop(first)), F.lit(" … "), cut(start(second), stop(second))))
    return F.when(first > 0, F.when(second.isNull(), cut(start(first), stop(first))).otherwise(two))


def compound(text: Column) -> Column:
    """Whether a fact says several things: 50 characters and more, two clauses and more, and no transcript."""
    clauses = F.filter(F.split(text, r"[.!?;]+\s*"), lambda c: F.length(F.trim(c)) >= 8)
    return (F.length(text) >= 50) & (F.size(clauses) >= 2) & ~text.rlike(r"(?m)^[A-Za-z]+: ")


def slot_gate(text: Column, pinned: Column, verified: Column) -> Column:
    """(keep, slots, importance, confidence): pinned facts stay, others need a slot."""
    n = sum((text.rlike(p).cast("int") for _, p in SLOTS), F.lit(0))
    importance = F.least(F.lit(1.0), 0.3 + 0.12 * n + F.when(F.length(text) >= 30, 0.1).otherwise(0.0))
    return F.struct((pinned | (n > 0)).alias("keep"), n.cast("long").alias("slots"), F.round(importance, 6).alias("importance"), F.round(0.6 + 0.1 * verified.cast("int"), 6).alias("confidence"))
