"""Routing, gates and checks, as rule tables that become CASE expressions; the first rule that holds wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import text

#: Front gate: what is not worth a recall (an English rule pack; fixed values).
FRONT = [
    ("control", r"^/[a-z]"),
    ("task", r"(?i)^\s*#?\s*(task|system|cron)\s*:"),
    ("probe", r"(?i)^(ping|test|health ?check)\W*$"),
    ("short-ack", r"(?i)^(ok|yes|no|yep|nope|sure|thx|k)\W*$"),
    ("symbols", r"^[^\p{L}\p{N}]{1,6}$"),
]
#: Cues of routes and of kinds of memory to look in first.
DEEP = r"(?i)\b(remember|recall|last time|you said|we talked|earlier|previously|when did|how long ago)\b"
SKIP = r"(?i)^(hi|hello|hey|good (morning|night)|thanks|bye)\W*$"
TASKS = [("preference", r"(?i)\b(like|prefer|favou?rite|want)\b"), ("procedural", r"(?i)\b(how (do|to)|steps|procedure|usually)\b"), ("episodic", r"(?i)\b(when|yesterday|last|ago|happened)\b")]
EMOTIONS = [("sad", r"(?i)\b(sad|cry|lonely|miss)\b"), ("angry", r"(?i)\b(angry|furious|annoyed)\b"), ("happy", r"(?i)\b(happy|glad|great|wonderful)\b"), ("anxious", r"(?i)\b(worried|anxious|afraid)\b")]
EXPECTED = [("date", r"(?i)\b(when|what day|which day|date)\b"), ("number", r"(?i)\b(how many|how much|how old)\b"), ("person", r"(?i)\b(who|whose)\b"), ("place", r"(?i)\bwhere\b")]
PRESENT = {"date": r"\b\d{4}\b|\b\d{1,2}[/.-]\d{1,2}\b", "number": r"\d", "person": r"\b\p{Lu}\p{Ll}+", "place": r"(?i)\b(in|at|near|from)\s+\p{Lu}"}


def first_match(column: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in rules:
        out = out.when(column.rlike(pattern), name)
    return out


def clean_message(column: Column) -> Column:
    """Without a leading header in brackets and time stamps at the beginnings of lines."""
    return F.trim(F.regexp_replace(F.regexp_replace(column, r"(?m)^\[\d{1,2}:\d{2}(:\d{2})?\]\s*", ""), r"^\s*<header>.*?</header>\s*", ""))


def front_gate(column: Column) -> Column:
    return first_match(F.trim(column), FRONT)


def task_class(column: Column) -> Column:
    return F.coalesce(first_match(column, TASKS), F.lit("semantic"))


def emotion(column: Column) -> Column:
    return first_match(column, EMOTIONS)


def route(column: Column) -> Column:
    """(mode, limit): skip, light or deep."""
    choose = lambda mode, limit: F.struct(F.lit(mode).alias("mode"), F.lit(limit).alias("limit"))
    few = F.size(text.keywords(column)) == 0
    return F.when(front_gate(column).isNotNull() | column.rlike(SKIP), choose("skip", 0)).when(column.rlike(DEEP), choose("deep", 12)).when(few, choose("skip", 0)).otherwise(choose("light", 6))


def satisfied(question: Column, answers: Column) -> tuple[Column, Column]:
    """(what the question expects, whether one of the first five answers has it)."""
    wanted = first_match(question, EXPECTED)
    has = F.lit(True)
    for name, pattern in PRESENT.items():
        has = F.when(wanted == name, _any(answers, pattern)).otherwise(has)
    return wanted, has


def _any(answers: Column, pattern: str) -> Column:
    return F.exists(F.slice(answers, 1, 5), lambda a: a.rlike(pattern))


def sufficiency(coverage: Column, ratio: Column, hits: Column, conflict: Column, expired: Column) -> Column:
    """(confidence, verdict) of a recall: enough, tip-of-tongue or escalate."""
    raw = 0.7 * coverage + 0.3 * ratio
    value = F.when(expired, F.lit(0.0)).when(conflict, F.least(raw, F.lit(0.35))).otherwise(raw)
    verdict = F.when(value < 0.40, "escalate").when((value < 0.55) & (hits >= 3), "tip-of-tongue").otherwise("enough")
    return F.struct(F.round(value, 6).alias("confidence"), verdict.alias("verdict"))


def anti_echo(subject: Column, actors: Column, owner: str, group: str) -> Column:
    """A speaker's words only yield facts about that speaker; the group needs the owner and one more."""
    return F.when(subject == group, F.array_contains(actors, owner) & (F.size(actors) > 1)).otherwise(F.array_contains(actors, subject))


def fact_check(candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """candidates (chunk, subject, content, quote) with ``reason``: none if the quote is verbatim in the chunk, said by the subject, and no number is new."""
    at = candidates.join(lines.select("chunk", "actor", "body"), "chunk", "left")
    seen = at.groupBy(*candidates.columns).agg(
        F.bool_or(F.contains("body", F.col("quote"))).alias("verbatim"),
        F.bool_or(F.contains("body", F.col("quote")) & (F.col("actor") == F.col("subject"))).alias("own"),
    )
    new = F.size(F.array_except(text.numbers(F.col("content")), text.numbers(F.col("quote"))))
    reason = F.when(F.length("quote") < 4, "short-quote").when(~F.coalesce("verbatim", F.lit(False)), "not-verbatim").when(~F.coalesce("own", F.lit(False)), "echo").when(new > 0, "number")
    return seen.withColumn("reason", reason).drop("verbatim", "own")


def capped(rows: DataFrame, group: str, most: int = 3, priority_most: int = 5) -> DataFrame:
    """The first `most` rows of each group in order, and up to `priority_most` if they have priority; rows: id, priority."""
    w = Window.partitionBy(group).orderBy("id")
    return rows.withColumn("n", F.row_number().over(w)).filter((F.col("n") <= most) | (F.col("priority") & (F.col("n") <= priority_most))).drop("n")
