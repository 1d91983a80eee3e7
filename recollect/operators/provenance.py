"""Who said it: effective speakers, echo, votes, conflicts and the health of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.config import CONFIG, Config

#: A line that quotes another speaker at its beginning, as ``[name] text``.
LEADING = r"^\[([a-z_]+)\]\s*"


def effective(evidence: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """evidence with effective_actor: a leading block names the speaker; an unknown name gives none."""
    name = F.nullif(F.regexp_extract("content", LEADING, 1), F.lit(""))
    return evidence.withColumn("effective_actor", F.when(name.isNull(), F.col("actor")).when(name.isin(*known), name))


def support(fact_evidence: DataFrame, evidence: DataFrame) -> DataFrame:
    """fact_id, n_support, n_owner, actors (sorted): the speakers of supporting evidence; fact_evidence: fact_id, evidence_id, role, subject.

    Evidence without a known speaker does not count.
    """
    said = evidence.select(F.col("id").alias("evidence_id"), "effective_actor")
    both = fact_evidence.filter("role = 'support'").join(said, "evidence_id").filter("effective_actor IS NOT NULL")
    found = both.groupBy("fact_id").agg(F.count("*").alias("n_support"), F.count_if(F.col("effective_actor") == F.col("subject")).alias("n_owner"), F.array_sort(F.collect_set("effective_actor")).alias("actors"))
    every = fact_evidence.select("fact_id", "subject").distinct()
    return every.join(found, "fact_id", "left").withColumns({"n_support": F.coalesce("n_support", F.lit(0)), "n_owner": F.coalesce("n_owner", F.lit(0)), "actors": F.coalesce("actors", F.array().cast("array<string>"))})


def echo_only(row: DataFrame, config: Config = CONFIG) -> Column:
    """Whether a fact rests on others' words alone; confirmed and pinned facts and those without evidence never do."""
    group_ok = F.array_contains("actors", config.owner) & (F.size("actors") > 1)
    owned = F.when(F.col("subject") == config.group, group_ok).otherwise(F.array_contains("actors", F.col("subject")))
    return (F.col("n_support") > 0) & ~owned & (F.col("status") != "confirmed") & ~F.col("pinned")


def consolidated(votes: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Groups with enough votes: of each root the greatest weight counts, once.  votes: subject, key, value, root, day, weight, fact_id."""
    group = ["subject", "key", "value"]
    best = votes.groupBy(*group, "root").agg(F.max_by(F.struct("weight", "day", "fact_id"), F.struct("weight", -F.col("fact_id"))).alias("v"))
    out = best.groupBy(*group).agg(
        F.round(F.sum("v.weight"), 6).alias("votes"),
        F.count_if(F.col("v.weight") == 1).alias("owner_votes"),
        F.count_distinct("v.day").alias("days"),
        F.count("*").alias("roots"),
    )
    return out.filter((F.col("votes") >= config.votes) & (F.col("days") >= config.vote_days) & (F.col("owner_votes") >= 1))


def conflicts(slots: DataFrame) -> DataFrame:
    """(subject, key) with more than one value."""
    return slots.groupBy("subject", "key").agg(F.array_sort(F.collect_set("value")).alias("vs")).filter(F.size("vs") > 1).select("subject", "key", F.array_join("vs", ",").alias("values"), F.size("vs").alias("n_values"))


def newest_marks(marks: DataFrame) -> DataFrame:
    return marks.groupBy("old_id").agg(F.max_by("new_id", F.struct("marked_at", "new_id")).alias("new_id"))


def stale_reason(owner: str = CONFIG.owner) -> Column:
    """Why a pair of an old and a new fact is no supersession: the first rule that it breaks, or ``ok``.  A null never passes a rule.

    Of both sides: id, subject, status, pinned, at, valid_to, key, value, polarity (as old_... and new_...); own (whether the owner's own words
    support the new one) and slot (the question that both answer, where somebody has named it).
    """
    o, n = (lambda c: F.col(f"old_{c}")), (lambda c: F.col(f"new_{c}"))
    fails = lambda rule: ~F.coalesce(rule, F.lit(False))
    both_keys = o("key").isNotNull() & n("key").isNotNull()
    same = o("value").eqNullSafe(n("value")) & o("polarity").eqNullSafe(n("polarity"))
    return (
        F.when(o("status").isNull() | n("status").isNull(), "unknown-fact")
        .when(o("id") == n("id"), "same-row")
        .when(~o("subject").eqNullSafe(n("subject")), "subject")
        .when(fails(n("subject") == owner), "not-owner")
        .when((o("status") != "candidate") | F.coalesce(o("pinned"), F.lit(False)) | o("valid_to").isNotNull(), "old-not-plain")
        .when(~n("status").isin("candidate", "confirmed") | n("valid_to").isNotNull(), "new-not-live")
        .when(fails(o("at") < n("at")), "not-later")
        .when(fails(F.col("own")), "not-own-words")
        .when(both_keys & (o("key") != n("key")), "key")
        .when(both_keys & same, "same-value")
        .when(~both_keys & fails(F.trim("slot") != ""), "no-slot")
        .otherwise("ok")
    )


def stale_checked(pairs: DataFrame, facts: DataFrame, said: DataFrame, owner: str = CONFIG.owner) -> DataFrame:
    """`pairs` (old_id, new_id, slot) with ``reason``.

    facts: fact_id, subject, status, pinned, valid_from, created_at, valid_to, key, value, polarity; said: fact_id and actor of supporting evidence.
    A fact is as old as its valid_from says, or else its created_at.
    """
    when = F.coalesce("valid_from", "created_at").alias("at")
    side = lambda p: facts.select("subject", "status", "pinned", when, "valid_to", "key", "value", "polarity", "fact_id").toDF(*(f"{p}_{c}" for c in ("subject", "status", "pinned", "at", "valid_to", "key", "value", "polarity", "id")))
    mine = said.filter(F.col("actor") == owner).select(F.col("fact_id").alias("new_id"), F.lit(True).alias("own")).distinct()
    both = pairs.join(side("old"), "old_id", "left").join(side("new"), "new_id", "left").join(mine, "new_id", "left")
    return both.select(*pairs.columns, stale_reason(owner).alias("reason"))


def stale_annotated(rows: DataFrame, marks: DataFrame, facts: DataFrame, config: Config = CONFIG) -> DataFrame:
    """`rows` (fact_id, score and more) with ``newer_id`` and ``slot`` of the newest mark that still holds, and the score weakened by it.

    A mark (old_id, new_id, slot) lapses when the old fact is confirmed, pinned or closed since, or the new one is no longer live.
    """
    plain = facts.filter("status = 'candidate' AND NOT coalesce(pinned, false) AND valid_to IS NULL").select(F.col("fact_id").alias("old_id"))
    fresh = facts.filter(F.col("status").isin(*config.live) & F.col("valid_to").isNull()).select(F.col("fact_id").alias("new_id"), F.coalesce("valid_from", "created_at").alias("at"))
    held = marks.join(plain, "old_id").join(fresh, "new_id")
    newest = held.groupBy(F.col("old_id").alias("fact_id")).agg(F.max_by(F.struct(F.col("new_id").alias("newer_id"), "slot"), F.struct("at", "new_id")).alias("m")).select("fact_id", "m.*")
    both = rows.join(newest, "fact_id", "left")
    return both.withColumn("score", F.col("score") * F.when(F.col("newer_id").isNotNull(), config.stale_factor).otherwise(1.0))


def verified(evidence: DataFrame, lines: DataFrame) -> DataFrame:
    """evidence with state: verified (equal text), uncertain (contained either way), broken (no line, or another text); lines: path, turn, line."""
    both = evidence.join(lines, ["path", "turn"], "left")
    same = F.sha2("content", 256) == F.sha2("line", 256)
    part = F.contains(F.col("line"), F.col("content")) | F.contains(F.col("content"), F.col("line"))
    return both.withColumn("state", F.when(F.col("line").isNull(), "broken").when(same, "verified").when(part, "uncertain").otherwise("broken"))


def first_seen_vote(votes: DataFrame) -> DataFrame:
    """The same choice of a vote of each root as a window: the row that counts."""
    w = Window.partitionBy("subject", "key", "value", "root").orderBy(F.desc("weight"), "fact_id")
    return votes.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
