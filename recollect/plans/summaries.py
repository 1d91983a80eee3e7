"""Summaries of clusters and their checks, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import redaction
from recollect.operators import reports
from recollect.plans.memory import q
from recollect.plans.queries import query
from recollect.sources import bindings as B

#: What a summary begins with, by conversation, before words of the cited turn.
BEGIN = ("", "they often mention ", "they always like ", "someone said ", "because of it ", "I think ", "they often prefer ", "they like 777 ", "they decided due to ")
_BEGIN = "CASE conv_id % 9 " + " ".join(f"WHEN {k} THEN '{b}'" for k, b in enumerate(BEGIN)) + " END"
_LAST = "CASE WHEN conv_id % 7 = 0 THEN 3 WHEN conv_id % 11 = 0 THEN 0 ELSE 4 END"


def _has(pattern: str, of: str = "s") -> str:
    return f"regexp_matches({of}, {q(pattern)})"


def _pairs(of: str) -> str:
    bare = f"regexp_replace(lower({of}), '\\s+', '', 'g')"
    return f"list_distinct(list_transform(range(1, length({bare})), lambda i: substr({bare}, i, 2)))"


@query("summary_checks", B.with_tables("evidence", then=rf"""WITH m AS (SELECT conv_id AS cluster, turn, content, turn % 2 = 0 OR conv_id % 13 = 0 AS own, CAST(occurred_at AS DATE) + CAST(turn // 2 AS INTEGER) AS day, (conv_id + turn) % 3 AS event FROM evidence),
    s AS (SELECT conv_id AS cluster, trim(any_value({_BEGIN}) || substr(any_value(content) FILTER (turn = 0), 1, 40)) AS s, any_value({_LAST}) AS upto FROM evidence GROUP BY conv_id),
    c AS (SELECT s.cluster, s.s, m.*, {_has(reports.CAUSE, "content")} AND len(list_intersect({_pairs(f"regexp_replace(s, {q(reports.CAUSE)}, '', 'g')")}, {_pairs("content")})) >= 3 AS caused FROM s JOIN m ON m.cluster = s.cluster AND turn <= upto AND turn % 2 = 0),
    g AS (SELECT cluster, count(*) AS n, bool_and(own) AS all_own, count(DISTINCT day) AS days, count(DISTINCT event) AS events, bool_or(caused) AS supported, flatten(list(regexp_extract_all(content, '[0-9]+'))) AS known FROM c GROUP BY cluster)
    SELECT s.cluster, CASE WHEN s = '' OR upper(s) = 'NONE' THEN 'none' WHEN length(s) NOT BETWEEN 8 AND 200 OR contains(s, chr(10)) THEN 'length' WHEN {_has("(?i)^(?:i|we|my|our)" + chr(92) + "b")} THEN 'first-person' WHEN n > 0 AND NOT all_own THEN 'others-words' WHEN coalesce(n, 0) < 2 THEN 'too-few' WHEN days < 2 THEN 'one-day'
    WHEN s.cluster % 17 = 0 THEN 'contradiction' WHEN {_has(reports.OFTEN)} AND events < CASE WHEN {_has(reports.ALWAYS)} THEN 3 ELSE 2 END THEN 'frequency' WHEN {_has(reports.VAGUE)} THEN 'vague' WHEN {_has(reports.OFTEN)} AND NOT {_has(reports.STANCE)} AND {_has(reports.BARE)} THEN 'bare-frequency'
    WHEN {_has(reports.CAUSE)} AND NOT supported THEN 'cause' WHEN len(list_filter(regexp_extract_all(s, '[0-9]+'), lambda x: NOT list_contains(known, x))) > 0 THEN 'number' ELSE 'ok' END AS reason FROM s LEFT JOIN g USING (cluster)"""))  # fmt: skip
def summary_checks(spark, d):
    said = B.evidence(spark, d)
    day = F.date_add(F.to_date("occurred_at"), F.floor(F.col("turn") / 2).cast("int"))
    members = said.select(F.col("conv_id").alias("cluster"), F.col("turn").cast("long").alias("id"), "content", ((F.col("turn") % 2 == 0) | (F.col("conv_id") % 13 == 0)).alias("own"), day.alias("day"), F.array(((F.col("conv_id") + F.col("turn")) % 3).cast("string")).alias("events"))
    begin = F.element_at(F.array(*map(F.lit, BEGIN)), (F.col("conv_id") % 9 + 1).cast("int"))
    cited = F.collect_list(F.when((F.col("turn") % 2 == 0) & (F.col("turn") <= F.expr(_LAST)), F.col("turn").cast("long")))
    first = F.first(F.when(F.col("turn") == 0, F.col("content")), ignorenulls=True)
    summaries = said.groupBy("conv_id").agg(F.trim(F.concat(F.first(begin), F.substring(first, 1, 40))).alias("summary"), cited.alias("cited")).withColumnRenamed("conv_id", "cluster")
    against = summaries.filter("cluster % 17 = 0").select("cluster")
    return reports.summary_checked(summaries, members, against, redaction.redacted(F.col("summary")) != F.col("summary"))


