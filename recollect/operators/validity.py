"""What held when: facts of a slot as intervals without gaps, and questions about a moment.

A slot is a subject and a key.  Its facts in the order of their times (and ids) make a sequence of values; where the value changes an interval begins, and
it ends where the next one begins.  A slot may hold a large part of all facts, so it is cut into spans of `SPAN_DAYS`: changes within a span are found by a window over
the span, and what is carried from one span into the next by a window over one row for each span.

Results for odd input: facts without a subject, key or time make no interval; a null value is a value like any other (nothing is known from then on);
facts that a judge has turned down (``update`` false) change nothing; of facts of one moment the one of the greatest id holds, and the others make no
interval; a question before the first fact has no answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = ["subject", "key"]
SPAN_DAYS = 30


def _span(at: str) -> Column:
    return F.floor(F.unix_date(F.to_date(at)) / SPAN_DAYS)


def _facts(facts: DataFrame) -> DataFrame:
    """The facts that count, one for each slot and moment."""
    rows = facts.filter("subject IS NOT NULL AND key IS NOT NULL AND at IS NOT NULL")
    if "update" in facts.columns:
        rows = rows.filter(F.coalesce("update", F.lit(True)))
    newest = F.max_by(F.struct("fact_id", "value"), "fact_id").alias("f")
    return rows.groupBy(*SLOT, "at").agg(newest).select(*SLOT, "at", "f.*").withColumn("span", _span("at"))


def _carried(rows: DataFrame, what: list[str]) -> DataFrame:
    """For each span of a slot the last row of the spans before it: `what`, as before_..., and ``first``, whether there is none."""
    last = rows.groupBy(*SLOT, "span").agg(F.max_by(F.struct(*what), "at").alias("last"))
    w = Window.partitionBy(*SLOT).orderBy("span")
    return last.withColumn("b", F.lag("last").over(w)).select(*SLOT, "span", F.col("b").isNull().alias("first"), *(F.col("b").getField(c).alias(f"before_{c}") for c in what))


def changes(facts: DataFrame) -> DataFrame:
    """subject, key, at, value, fact_id of the facts whose value is not that of the fact before; facts: subject, key, at, value, fact_id and perhaps update."""
    rows = _facts(facts)
    w = Window.partitionBy(*SLOT, "span").orderBy("at")
    both = rows.withColumns({"n": F.row_number().over(w), "before": F.lag("value").over(w)}).join(_carried(rows, ["value"]), [*SLOT, "span"])
    begins = F.when(F.col("n") > 1, ~F.col("value").eqNullSafe(F.col("before"))).otherwise(F.col("first") | ~F.col("value").eqNullSafe(F.col("before_value")))
    return both.filter(begins).select(*SLOT, "at", "value", "fact_id")


def intervals(facts: DataFrame) -> DataFrame:
    """subject, key, valid_from, valid_to (null: still), value, fact_id (that begins it)."""
    rows = changes(facts).withColumn("span", _span("at"))
    w = Window.partitionBy(*SLOT, "span").orderBy("at")
    # The end is the next change in the span, or else the first one of the next span that has any.
    first = rows.groupBy(*SLOT, "span").agg(F.min("at").alias("starts"))
    ends = first.withColumn("next_span", F.lead("starts").over(Window.partitionBy(*SLOT).orderBy("span"))).drop("starts")
    both = rows.withColumn("next", F.lead("at").over(w)).join(ends, [*SLOT, "span"])
    return both.select(*SLOT, F.col("at").alias("valid_from"), F.coalesce("next", "next_span").alias("valid_to"), "value", "fact_id")


def as_of(known: DataFrame, questions: DataFrame) -> DataFrame:
    """`questions` (question_id, subject, key, at) with value, fact_id and since of the interval that holds then; known: `intervals`.

    Questions stand among the beginnings of a span, in the order of time; one that is before all of them gets what was carried into the span.
    """
    starts = known.select(*SLOT, F.col("valid_from").alias("at"), F.struct(F.col("valid_from").alias("since"), "value", "fact_id").alias("held"), F.lit(None).cast("string").alias("question_id")).withColumn("span", _span("at"))
    asked = questions.select(*SLOT, "at", F.lit(None).cast(starts.schema["held"].dataType).alias("held"), F.col("question_id").cast("string").alias("question_id")).withColumn("span", _span("at"))
    both = starts.unionByName(asked)
    w = Window.partitionBy(*SLOT, "span").orderBy("at", F.col("question_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("now", F.last("held", ignorenulls=True).over(w)).filter("question_id IS NOT NULL")
    last = both.groupBy(*SLOT, "span").agg(F.max_by("held", F.when(F.col("held").isNotNull(), F.col("at"))).alias("last"))
    before = Window.partitionBy(*SLOT).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*SLOT, "span", F.last("last", ignorenulls=True).over(before).alias("carried"))
    found = here.join(carried, [*SLOT, "span"]).select(F.col("question_id").cast(questions.schema["question_id"].dataType).alias("question_id"), F.coalesce("now", "carried").alias("f"))
    return questions.join(found.select("question_id", "f.value", "f.fact_id", "f.since"), "question_id", "left")


def refolded(known: DataFrame, facts: DataFrame, late: DataFrame) -> DataFrame:
    """The intervals after late facts have come: those of their slots anew, all others as they are; facts: all facts, without the late ones."""
    touched = late.select(*SLOT).distinct()
    again = intervals(facts.join(touched, SLOT, "left_semi").unionByName(late))
    return known.join(touched, SLOT, "left_anti").unionByName(again)


def backfilled(known: DataFrame, facts: DataFrame) -> DataFrame:
    """fact_id and valid_to of facts that are open in the store though a later value holds: what a first run over old facts writes."""
    rows = _facts(facts).select(*SLOT, "at", "fact_id").join(facts.filter("valid_to IS NULL").select("fact_id"), "fact_id", "left_semi")
    asked = rows.select(F.col("fact_id").alias("question_id"), *SLOT, "at")
    held = as_of(known, asked).select(F.col("question_id").alias("fact_id"), *SLOT, F.col("since").alias("valid_from"))
    return held.join(known.filter("valid_to IS NOT NULL").select(*SLOT, "valid_from", "valid_to"), [*SLOT, "valid_from"]).select("fact_id", "valid_to")


def promoted(facts: DataFrame, winners: DataFrame) -> DataFrame:
    """fact_id and status of facts that votes have settled: those that say what won are confirmed, open ones that say something else of the slot become uncertain.

    facts: fact_id, subject, key, value, status, pinned; winners: subject, key, value (`provenance.consolidated`).  A slot with two winners settles nothing.
    """
    one = winners.groupBy(*SLOT).agg(F.collect_set("value").alias("v")).filter(F.size("v") == 1).select(*SLOT, F.get("v", F.lit(0)).alias("won"))
    open_ = facts.filter("status = 'candidate' AND NOT coalesce(pinned, false)").join(one, SLOT)
    return open_.select("fact_id", F.when(F.col("value").eqNullSafe(F.col("won")), "confirmed").otherwise("uncertain").alias("status"))
