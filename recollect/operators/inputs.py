"""What comes in: wrappers taken off, gates before a recall, and the marks that tell what a message is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Wrappers of attachments and notices, and what looks like a path (fixed values).
BLOCKS = (r"(?is)<system-reminder\b[^>]*>.*?</system-reminder>", r"(?is)<task-notification\b[^>]*>.*?</task-notification>")
LINES = r"(?im)^\s*[(\[]?\s*(images? (also )?saved locally|attachments? saved|image_path\s*=|photo|sticker|voice|video)\b[^\n]*$"
PATHS = r"(?i)(/home/\w+/\S+|/tmp/\S+|\S+\.(jpe?g|png|webp|gif|mp4|mov|pdf|ogg|mp3))"
CHANNEL = r"(?s)<channel[^>]*>(.*?)</channel>"
EXPLICIT = r"(?i)\b(remember|recall|last time|you said|we talked|earlier|previously)\b"
WORKING = r"(?i)\b(deploy|commit|branch|server|script|config|database|log)\b"
LONGEST = 700
#: What points at something: dates, names in capitals, identifiers; the first two do so strongly.
STRONG = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[A-Z][A-Za-z0-9]*[A-Z0-9][A-Za-z0-9]*"
MARK = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[A-Za-z][A-Za-z0-9_.-]{3,}"
COMMON = ("http", "https", "json", "text", "post", "photo", "image", "images", "file", "files", "message", "true", "false", "null", "none", "user", "assistant", "system", "this", "that", "with", "from", "have", "what", "when", "where", "they", "them", "then")
LOW_INFO = r"(?i)^\s*(that one|this one|and then|what about it|ok|yes|no|continue|go on|it)?\W*$"
CHOICE = r"(?i)\b(which|choose|buy|pick|order|use)\b"
LIKING = r"(?i)\b(like|likes|love|hate|prefer|favou?rite|allergic)\b"


def without_wrappers(message: Column) -> Column:
    out = message
    for pattern in (*BLOCKS, LINES, PATHS):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(F.regexp_replace(out, r"[ \t]+", " "))


def incoming(message: Column) -> Column:
    """The last channel's body if there is one, else the message."""
    bodies = F.regexp_extract_all(message, F.lit(CHANNEL), F.lit(1))
    return F.trim(F.when(F.size(bodies) > 0, F.element_at(bodies, -1)).otherwise(message))


def clean_context(message: Column) -> Column:
    """Without tags, and white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(incoming(message), r"<[^>]+>", " "), r"\s+", " "))


def skip_reason(message: Column, longest: int = LONGEST) -> Column:
    return F.when(message.rlike(BLOCKS[0]), "system").when((F.length(message) > longest) & ~message.rlike(EXPLICIT), "long-paste")


def marks(message: Column) -> Column:
    """The distinct words that point at something, in the order they come."""
    return F.array_distinct(F.filter(F.regexp_extract_all(message, F.lit(MARK), F.lit(0)), lambda w: ~F.lower(w).isin(*COMMON)))


def keyword_relevant(found: Column, content: Column) -> Column:
    """Whether a text holds two strong marks, a strong and another one, or two others."""
    low = F.lower(content)
    hit = F.filter(found, lambda m: F.contains(low, F.lower(m)))
    strong = F.size(F.filter(hit, lambda m: m.rlike(f"^(?:{STRONG})$")))
    return (strong >= 2) | ((strong >= 1) & (F.size(hit) > strong)) | (F.size(hit) - strong >= 2)


def trigger(message: Column) -> Column:
    """Why a message calls for a recall: its words, or those of work; else an empty string."""
    return F.when(message.rlike(EXPLICIT), "recall").when(message.rlike(WORKING), "work").otherwise("")


def forced(current: Column, before: Column, candidate: Column, grams: Column) -> Column:
    """Relevant whatever a judge says: a reply without content whose context has a strong mark of the candidate, or a choice and a liking
    that share a bigram (grams: the number of those)."""
    low = F.lower(candidate)
    carried = F.exists(marks(before), lambda m: m.rlike(f"^(?:{STRONG})$") & F.contains(low, F.lower(m)))
    return (current.rlike(LOW_INFO) & carried) | (current.rlike(CHOICE) & candidate.rlike(LIKING) & ~current.rlike(EXPLICIT) & (grams > 0))


def pinned_only_if_relevant(hits: DataFrame, least: int = 9) -> DataFrame:
    """Hits without the pinned ones that score below `least` or fail a guard; hits: pinned, judge, compatible."""
    return hits.filter(~F.col("pinned") | ((F.coalesce("judge", F.lit(0)) >= least) & F.col("compatible")))


def ordered_union(*sources: DataFrame) -> DataFrame:
    """query_id, fact_id, source, place: candidates of all sources in the order given, each fact where it comes first; sources: query_id, fact_id, rank."""
    each = [s.select("query_id", "fact_id", "rank", F.lit(k).alias("source")) for k, s in enumerate(sources)]
    both = each[0]
    for s in each[1:]:
        both = both.unionByName(s)
    first = both.groupBy("query_id", "fact_id").agg(F.min(F.struct("source", "rank")).alias("at")).select("query_id", "fact_id", "at.source", "at.rank")
    w = Window.partitionBy("query_id").orderBy("source", "rank", "fact_id")
    return first.withColumn("place", F.row_number().over(w)).drop("rank")
