"""Who a question asks about, and whose matter a fact is (an English rule pack; names come from the configuration)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.config import CONFIG

ASSISTANT = CONFIG.assistants[0]
#: Words of the owner's side and of the assistant's, in a question and as names in a fact.
EDGE = r"[^\p{L}\p{N}_]"  # between words of any alphabet
OWNER_ASKED = rf"(^|{EDGE})(i|my|me|we|our|she|{CONFIG.owner})({EDGE}|$)"
ASSISTANT_ASKED = rf"(^|{EDGE})(you|your|yours|{ASSISTANT})({EDGE}|$)"
OWNER_NAMED = rf"(^|{EDGE})(she|{CONFIG.owner})({EDGE}|$)"
ASSISTANT_NAMED = rf"(^|{EDGE}){ASSISTANT}({EDGE}|$)"
#: Persons of the asking itself, which say nothing of whom it is about.
FRAME = r"\b(do|can|could|will|would) you (remember|know|recall|tell|find|check)\b|\b(tell|remind|show) me\b"
STAMP = r"\(\s*\d{4}-\d{2}-\d{2}[^)]*\)"
SPEAKER = r"^[^:\n]{1,12}:"
PREFIXED = r"^\s*[^:\n(]{1,12}\s*(\(\s*\d{4}-\d{2}-\d{2}[^)]*\))?\s*:"
#: How far into a fact a name is taken for its subject.
HEAD = 24


def body(content: Column) -> Column:
    """The words alone, without the record's stamps and its speaker."""
    return F.regexp_replace(F.regexp_replace(content, STAMP, ""), SPEAKER, "")


def asked_subject(question: Column) -> Column:
    """The owner or the assistant, if the question is about just one of them; else null."""
    core = F.regexp_replace(F.lower(question), FRAME, "")
    owner, other = core.rlike(OWNER_ASKED), core.rlike(ASSISTANT_ASKED)
    return F.when(owner & ~other, CONFIG.owner).when(other & ~owner, ASSISTANT)


def inferred_who(question: Column) -> Column:
    """The only one who is asked about or named, of all actors; else null."""
    core = F.regexp_replace(F.lower(question), FRAME, "")
    named = [F.when(core.rlike(OWNER_ASKED), CONFIG.owner), F.when(core.rlike(ASSISTANT_ASKED), ASSISTANT), *(F.when(F.contains(core, F.lit(x)), x) for x in CONFIG.assistants[1:])]
    found = F.array_compact(F.array(*named))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def belongs_to(subject: Column, content: Column, actors: Column, want: Column) -> Column:
    """Whether a fact is a matter of `want`.  What can't be told passes; actors: who said what supports it."""
    words = F.lower(body(content))
    head = F.substring(words, 1, HEAD)
    owner, other = head.rlike(OWNER_NAMED), head.rlike(ASSISTANT_NAMED)
    start = F.ltrim(words)
    lead = F.when(start.startswith(ASSISTANT), ASSISTANT).when(start.startswith(CONFIG.owner), CONFIG.owner)
    return (
        F.when(subject == CONFIG.group, True)
        .when(content.rlike(PREFIXED) & (owner != other), F.when(want == CONFIG.owner, owner).otherwise(other))
        .when(subject.isNotNull() & (subject != want), False)
        .when(lead.isNotNull() & (lead != want), False)
        .when((subject == want) & (F.size(actors) > 0) & ~F.array_contains(actors, want), False)
        .otherwise(True)
    )


def for_subject(hits: DataFrame) -> DataFrame:
    """Only the hits that belong to whom the question asks about; all where that is unclear.  hits: want, subject, content, actors."""
    return hits.filter(F.col("want").isNull() | belongs_to(F.col("subject"), F.col("content"), F.col("actors"), F.col("want")))


def preferred(hits: DataFrame) -> DataFrame:
    """All hits, with ``place``: those that belong to whom the question asks about come first; hits: query_id, rank and as above."""
    mine = F.col("want").isNull() | belongs_to(F.col("subject"), F.col("content"), F.col("actors"), F.col("want"))
    w = Window.partitionBy("query_id").orderBy(F.desc("mine"), "rank")
    return hits.withColumn("mine", mine).withColumn("place", F.row_number().over(w))


def says_near(content: Column, topic: str, pattern: str, reach: int = 14) -> Column:
    """Whether a pattern stands within so many characters of a topic."""
    return content.rlike(rf"(?is)(?:{pattern}).{{0,{reach}}}{topic}|{topic}.{{0,{reach}}}(?:{pattern})")
