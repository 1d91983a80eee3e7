"""Reports and plans over groups: exams of recall, quotas, coverage of summaries, contradictions, marks, hand-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import text


def exam(ranks: DataFrame, expected: DataFrame) -> DataFrame:
    """(asked, found, top3, mean_rank) of expected (query_id, fact_id) among ranks (query_id, fact_id, rank); one row."""
    at = expected.join(ranks, ["query_id", "fact_id"], "left")
    return at.agg(F.count("*").alias("asked"), F.count("rank").alias("found"), F.count_if(F.col("rank") <= 3).alias("top3"), F.round(F.avg("rank"), 6).alias("mean_rank"))


def quota(rows: DataFrame, most: int, hours: int) -> DataFrame:
    """(session, day, used, over): rows (session, ts) of each day of a zone so many hours ahead of UTC, and those beyond the quota."""
    day = F.to_date(F.col("ts") + F.expr(f"INTERVAL {hours} HOURS"))
    return rows.groupBy("session", day.alias("day")).agg(F.count("*").alias("used")).withColumn("over", F.greatest(F.col("used") - most, F.lit(0)))


def covered(members: DataFrame, summaries: DataFrame, least: float = 0.5) -> DataFrame:
    """(cluster, own, best, covered): the greatest number of a cluster's members in one earlier summary; members: cluster, id, summaries: parent, id."""
    m, s = members.select("cluster", "id").distinct(), summaries.select("parent", "id").distinct()
    # A summary gets the clusters of each of its ids as one list.  One that stands in a list counts one; only those that stand there again are counted.
    lists = s.join(m.groupBy("id").agg(F.collect_list("cluster").alias("of")), "id")
    held = lists.groupBy("parent").agg(F.array_sort(F.flatten(F.collect_list("of"))).alias("of"))
    again = held.select("parent", F.explode(F.filter("of", lambda c, i: (i > 0) & (F.get("of", i - 1) == c))).alias("cluster"))
    most = again.groupBy("parent", "cluster").agg((F.count("*") + 1).alias("n")).groupBy("cluster").agg(F.max("n").alias("n"))
    once = m.join(s.select("id").distinct(), "id", "left_semi").select("cluster", F.lit(1).alias("one")).distinct()
    out = m.groupBy("cluster").agg(F.count("*").alias("own")).join(once, "cluster", "left").join(most, "cluster", "left")
    out = out.select("cluster", "own", F.coalesce("n", "one", F.lit(0)).cast("long").alias("best"))
    return out.withColumn("covered", F.col("best") >= least * F.col("own"))


def contradicted(slots: DataFrame, single: list[str]) -> DataFrame:
    """Clusters with two values of a slot that holds one, or both polarities of one value; slots: cluster, key, value, polarity."""
    values = slots.filter(F.col("key").isin(*single)).groupBy("cluster", "key").agg(F.count_distinct("value").alias("n"))
    signs = slots.groupBy("cluster", "key", "value").agg(F.count_distinct("polarity").alias("n"))
    return values.filter("n > 1").select("cluster", F.lit("value").alias("why")).union(signs.filter("n > 1").select("cluster", F.lit("polarity").alias("why"))).distinct()


#: What a summary says about how often, how sure, of whom and why (an English rule pack; patterns that any engine reads).
OFTEN = r"(?i)\b(?:often|usually|frequently|repeatedly|several times|many times|again and again|always|constantly|every (?:day|week|time))\b"
ALWAYS = r"(?i)\b(?:always|constantly|every (?:day|week|time))\b"
STANCE = r"(?i)\b(?:likes?|loves?|hates?|prefers?|wants?|hopes?|thinks?|believes?|plans?|decide[sd]?|refuse[sd]?|fears?|worries|agree[sd]?|insists?|avoids?|promise[sd]?)\b"
VAGUE = r"(?i)\b(?:someone|somebody|something|a certain|some (?:person|thing|place)|the other (?:person|party))\b"
BARE = r"(?i)\b(?:mention(?:s|ed)?|talk(?:s|ed)?|speaks?|spoke|discuss(?:es|ed)?|says?|said|asks?|asked|topics?|things|matters)\b"
CAUSE = r"(?i)\b(?:because|therefore|thus|hence|so that|due to|as a result|leads? to|led to|cause[sd]?|results? in)\b"
SUMMARY_CHARS, CITED, CITED_DAYS = (8, 200), 2, 2


def summary_checked(summaries: DataFrame, members: DataFrame, contradicted: DataFrame, secret: Column) -> DataFrame:
    """(cluster, reason): why a summary of a cluster can't stand, the first rule that it breaks, or ``ok``.

    summaries: cluster, summary, cited (ids); members: cluster, id, content, own (whether the owner said it), day, events (of one source each);
    contradicted: cluster; secret: whether ``summary`` holds one.  A word of frequency needs two events (three if it says always) on two days and something
    that was liked, decided or the like; a cause needs a cited text with a cause that shares three pairs of characters with the summary.
    """
    often, always, stance, vague, bare_of, cause = map(text.plain_bounds, (OFTEN, ALWAYS, STANCE, VAGUE, BARE, CAUSE))
    cited = summaries.select("cluster", "summary", F.explode(F.array_distinct("cited")).alias("id")).join(members, ["cluster", "id"], "left")
    bare = text.bigrams(F.regexp_replace("summary", cause, ""))
    caused = F.coalesce(F.col("content").rlike(cause) & (F.size(F.array_intersect(bare, text.bigrams(F.col("content")))) >= 3), F.lit(False))
    found = cited.withColumn("caused", caused).groupBy("cluster").agg(
        F.count("*").alias("n"), F.bool_and(F.coalesce("own", F.lit(False))).alias("all_own"), F.count_distinct("day").alias("days"), F.size(F.array_distinct(F.flatten(F.collect_list("events")))).alias("events"),
        F.bool_or("caused").alias("supported"), F.array_distinct(F.flatten(F.collect_list(text.numbers(F.col("content"))))).alias("known"),
    )
    both = summaries.join(found, "cluster", "left").join(contradicted.select("cluster", F.lit(True).alias("against")).distinct(), "cluster", "left")
    s, n = F.col("summary"), lambda c: F.coalesce(c, F.lit(0))
    body = F.trim(F.coalesce(s, F.lit("")))
    needed = F.when(s.rlike(always), 3).otherwise(2)
    reason = (
        F.when((body == "") | (F.upper(body) == "NONE"), "none").when(~F.length(body).between(*SUMMARY_CHARS) | F.contains(body, F.lit("\n")), "length").when(secret, "secret")
        .when(body.rlike(text.plain_bounds(r"(?i)^(?:i|we|my|our)\b")), "first-person").when((n("n") > 0) & ~F.coalesce("all_own", F.lit(False)), "others-words").when(n("n") < CITED, "too-few").when(n("days") < CITED_DAYS, "one-day")
        .when(F.coalesce("against", F.lit(False)), "contradiction").when(body.rlike(often) & (n("events") < needed), "frequency").when(body.rlike(vague), "vague")
        .when(body.rlike(often) & ~body.rlike(stance) & body.rlike(bare_of), "bare-frequency").when(body.rlike(cause) & ~F.coalesce("supported", F.lit(False)), "cause")
        .when(F.size(F.array_except(text.numbers(body), F.coalesce("known", F.array().cast("array<string>")))) > 0, "number").otherwise("ok")
    )
    return both.select("cluster", reason.alias("reason"))


def mark_plan(marks: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact_id, action) of the marks a reader set: ticks reject, pins confirm; both at once conflict, pinned facts refuse a tick, others skip.

    marks: fact_id, tick, pin; facts: fact_id, status, pinned.
    """
    both = marks.join(facts.select("fact_id", "status", "pinned"), "fact_id", "left")
    action = (
        F.when(F.col("status").isNull(), "missing")
        .when(F.col("tick") & F.col("pin"), "conflict")
        .when(F.col("tick") & F.col("pinned"), "refused")
        .when(F.col("tick") & (F.col("status") == "candidate"), "reject")
        .when(F.col("pin") & F.col("status").isin("candidate", "confirmed"), "confirm")
        .otherwise("skipped")
    )
    return both.select("fact_id", action.alias("action"))


def handoff(turns: DataFrame, last: int, clip: int) -> DataFrame:
    """(path, turns, page): the last turns of each session, in order, each clipped; turns: path, id, actor, occurred_at, content."""
    w = Window.partitionBy("path").orderBy(F.desc("occurred_at"), F.desc("id"))
    kept = turns.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= last)
    line = F.concat(F.col("actor"), F.lit(": "), F.substring(F.regexp_replace("content", r"\s+", " "), 1, clip))
    lines = F.array_sort(F.collect_list(F.struct("occurred_at", "id", line.alias("line"))))
    return kept.groupBy("path").agg(F.count("*").alias("turns"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("page"))


def corrections(turns: DataFrame, cue: str) -> DataFrame:
    """(id, path, corrected_id): a turn of another speaker right after the one it corrects, with a cue in it."""
    w = Window.partitionBy("path").orderBy("occurred_at", "id")
    said = turns.withColumns({"corrected_id": F.lag("id").over(w), "by": F.lag("actor").over(w)})
    return said.filter((F.col("by") != F.col("actor")) & F.col("content").rlike(cue)).select("id", "path", "corrected_id")


def quoted(notes: DataFrame, turns: DataFrame, hours: int = 24) -> DataFrame:
    """Each note (note_id, path, quote, noted_at) with the newest turn of its session, at most so many hours old, that holds its quote."""
    near = (F.col("occurred_at") <= F.col("noted_at")) & (F.col("occurred_at") >= F.col("noted_at") - F.expr(f"INTERVAL {hours} HOURS"))
    met = notes.join(turns.select("path", F.col("id").alias("turn_id"), "occurred_at", "content"), "path").filter(near & F.contains("content", F.col("quote")))
    return met.groupBy("note_id").agg(F.max_by("turn_id", F.struct("occurred_at", "turn_id")).alias("turn_id"))


def direct_read(cards: DataFrame, budget: int = 400) -> DataFrame:
    """Cards (query_id, rank, fact_id, size) whose whole texts may be read at once: while their running size stays within the budget."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cards.withColumn("upto", F.sum("size").over(w)).filter(F.col("upto") <= budget)


def probe(matches: DataFrame, sims: DataFrame) -> DataFrame:
    """(query_id, fact_id, relevance): the share of a question's rare terms in the fact, or its similarity if that is greater.

    matches: query_id, fact_id, term, df, hit; sims: query_id, fact_id, sim.
    """
    idf = 1 / F.log2(F.col("df") + 2)
    lexical = matches.groupBy("query_id", "fact_id").agg((F.sum(F.when(F.col("hit"), idf).otherwise(0.0)) / F.sum(idf)).alias("lexical"))
    both = lexical.join(sims, ["query_id", "fact_id"], "left")
    return both.select("query_id", "fact_id", F.round(F.greatest("lexical", F.coalesce("sim", F.lit(0.0))), 6).alias("relevance"))


def relevance_to_goals(rows: DataFrame, goals: DataFrame, key: str = "fact_id") -> DataFrame:
    """(key, relevance): the greatest share of a row's grams in one open goal, times its kind's weight; rows: key, grams; goals: grams, weight."""
    aims = goals.select(F.xxhash64("grams", "weight").alias("goal"), "weight", F.array_distinct("grams").alias("grams")).dropDuplicates(["goal"])
    held = rows.select(key, F.size("grams").alias("size"), F.explode(F.array_distinct("grams")).alias("g"))
    met = held.join(aims.select("goal", "weight", F.explode("grams").alias("g")), "g").groupBy(key, "size", "goal", "weight").agg(F.count("*").alias("shared")).filter("shared >= 2")
    best = met.groupBy(key).agg(F.max(F.col("shared") / F.col("size") * F.col("weight")).alias("best"))
    return rows.select(key).join(best, key, "left").select(key, F.round(F.coalesce("best", F.lit(0.0)), 6).alias("relevance"))


def sharing(rows: DataFrame, asked: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, fact_id, shared): rows and questions that share at least so many grams, by an equi-join; rows: fact_id, g; asked: query_id, q."""
    left, right = rows.select("fact_id", F.explode(F.array_distinct("g")).alias("x")), asked.select("query_id", F.explode(F.array_distinct("q")).alias("x"))
    return left.join(right, "x").groupBy("query_id", "fact_id").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
