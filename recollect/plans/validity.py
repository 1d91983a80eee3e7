"""Queries about what held when, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.operators import graphs, validity
from recollect.plans.queries import query
from recollect.sources import bindings as B

#: The status of a customer group's orders of one priority, as a slot that changes; every ninth order is turned down.
_FACTS = """f AS (SELECT o_custkey % 20 AS subject, substr(o_orderpriority, 1, 1) AS key, CAST(o_orderdate AS TIMESTAMP) AS ts, CASE WHEN o_orderkey % 11 > 0 THEN o_orderstatus END AS value, o_orderkey AS fact_id FROM orders WHERE o_orderkey % 9 > 0 AND o_orderdate IS NOT NULL),
    u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY subject, key, ts ORDER BY fact_id DESC) = 1),
    c AS (SELECT * FROM u WINDOW w AS (PARTITION BY subject, key ORDER BY ts) QUALIFY row_number() OVER w = 1 OR value IS DISTINCT FROM lag(value) OVER w),
    i AS (SELECT subject, key, ts AS valid_from, lead(ts) OVER (PARTITION BY subject, key ORDER BY ts) AS valid_to, value, fact_id FROM c)"""


def _facts(spark, d):
    k = F.col("o_orderkey")
    value = F.when(k % 11 > 0, F.col("o_orderstatus"))
    return B.table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("subject"), F.substring("o_orderpriority", 1, 1).alias("key"), F.col("o_orderdate").cast("timestamp").alias("at"), value.alias("value"), k.alias("fact_id"), (k % 9 > 0).alias("update"))


@query("validity_intervals", f"WITH {_FACTS} SELECT subject, key, valid_from::DATE AS valid_from, valid_to::DATE AS valid_to, value, fact_id FROM i")
def validity_intervals(spark, d):
    out = validity.intervals(_facts(spark, d))
    return out.withColumns({"valid_from": F.to_date("valid_from"), "valid_to": F.to_date("valid_to")})


@query("state_as_of", f"""WITH {_FACTS}, q AS (SELECT event_id AS question_id, user_id % 20 AS subject, CAST(1 + event_id % 5 AS VARCHAR) AS key, TIMESTAMP '1992-01-01' + to_days(CAST(event_id * 37 % 2700 AS INTEGER)) AS ts FROM events)
    SELECT question_id, value, fact_id FROM q LEFT JOIN i ON i.subject = q.subject AND i.key = q.key AND valid_from <= q.ts AND (valid_to IS NULL OR valid_to > q.ts)""")  # fmt: skip
def state_as_of(spark, d):
    e = F.col("event_id")
    at = F.date_add(F.lit("1992-01-01").cast("date"), (e * 37 % 2700).cast("int")).cast("timestamp")
    asked = B.table(spark, d, "events").select(e.alias("question_id"), (F.col("user_id") % 20).alias("subject"), (1 + e % 5).cast("string").alias("key"), at.alias("at"))
    return validity.as_of(graphs.saved(validity.intervals(_facts(spark, d))), asked).select("question_id", "value", "fact_id")
