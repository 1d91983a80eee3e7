"""The benchmark of four arms over conversations, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.config import CONFIG
from recollect.operators import benchmark, graphs
from recollect.plans.queries import query
from recollect.sources import bindings as B

#: A question is four words of a turn, its haystack the turns of five conversations.
GROUP, K = 5, 10
_BASE = f"""WITH q AS (SELECT id AS question_id, actor AS kind, conv_id // {GROUP} AS g, array_to_string(regexp_extract_all(lower(content), '[a-z0-9]+')[3:6], ' ') AS question FROM evidence WHERE turn = 1),
    h AS (SELECT question_id, id AS passage_id, content, regexp_extract_all(lower(content), '[a-z0-9]+') AS words FROM q JOIN evidence ON conv_id // {GROUP} = g), s AS (SELECT question_id, count(*) AS n, avg(len(words)) AS mean FROM h GROUP BY question_id),
    a AS (SELECT DISTINCT question_id, unnest(regexp_extract_all(question, '[a-z0-9]+')) AS term FROM q), tf AS (SELECT h.question_id, passage_id, term, len(words) AS dl, len(list_filter(words, lambda w: w = term)) AS tf FROM h JOIN a ON a.question_id = h.question_id AND length(term) > 2 AND list_contains(words, term)),
    df AS (SELECT question_id, term, count(*) AS df FROM tf GROUP BY ALL),
    lx AS (SELECT question_id, passage_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS bm25, round(sum(1 / log2(df + 2)), 6) AS rare FROM tf JOIN df USING (question_id, term) JOIN s USING (question_id) GROUP BY ALL),
    z AS (SELECT question_id, passage_id, regexp_replace(lower(content), '\\s+', '', 'g') AS s FROM h), y AS (SELECT question_id, regexp_replace(lower(question), '\\s+', '', 'g') AS s FROM q),
    hg AS (SELECT DISTINCT question_id, passage_id, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS g FROM z), qg AS (SELECT DISTINCT question_id, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS g FROM y),
    qn AS (SELECT question_id, count(*) AS size FROM qg GROUP BY ALL), gr AS (SELECT question_id, passage_id, round(count(*) / any_value(size), 6) AS score FROM hg JOIN qg USING (question_id, g) JOIN qn USING (question_id) GROUP BY ALL),
    t3 AS (SELECT question_id, 'bm25' AS arm, passage_id, bm25 AS score FROM lx UNION ALL SELECT question_id, 'rare', passage_id, rare FROM lx UNION ALL SELECT question_id, 'grams', passage_id, score FROM gr),
    r3 AS (SELECT question_id, arm, passage_id, row_number() OVER (PARTITION BY question_id, arm ORDER BY score DESC, passage_id) AS rank FROM t3 QUALIFY rank <= {CONFIG.rrf_k}),
    hy AS (SELECT question_id, 'hybrid' AS arm, passage_id, row_number() OVER (PARTITION BY question_id ORDER BY round(sum(1.0::DOUBLE / ({CONFIG.rrf_k} + rank)), 9) DESC, passage_id) AS rank FROM r3 GROUP BY question_id, passage_id),
    fd AS (SELECT * FROM r3 UNION ALL SELECT * FROM hy), sc AS (SELECT q.question_id, kind, arm.arm AS arm, CASE WHEN rank <= {K} THEN 1 ELSE 0 END AS hit, CASE WHEN rank <= {K} THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END AS rr
    FROM q CROSS JOIN (SELECT unnest(['bm25', 'rare', 'grams', 'hybrid']) AS arm) LEFT JOIN fd ON fd.question_id = q.question_id AND fd.arm = arm.arm AND passage_id = q.question_id)""".replace("(SELECT unnest(['bm25', 'rare', 'grams', 'hybrid']) AS arm)", "(SELECT unnest(['bm25', 'rare', 'grams', 'hybrid']) AS arm) arm")


def scored(spark, d):
    said = B.evidence(spark, d)
    words = F.slice(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]+"), F.lit(0)), 3, 4)
    asked = said.filter("turn = 1").select(F.col("id").alias("question_id"), F.col("actor").alias("kind"), F.expr(f"conv_id div {GROUP}").alias("g"), F.array_join(words, " ").alias("question"))
    stacks = asked.select("question_id", "g").join(said.select(F.expr(f"conv_id div {GROUP}").alias("g"), F.col("id").alias("passage_id"), "content"), "g").drop("g")
    found = benchmark.ranked(asked, stacks, K)
    return graphs.saved(benchmark.judged(asked, found, asked.select("question_id", F.col("question_id").alias("passage_id")), K))


@query("benchmark_arms", B.with_tables("evidence", then=f"{_BASE} SELECT arm, kind, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr FROM sc GROUP BY ALL"))
def benchmark_arms(spark, d):
    return benchmark.summary(scored(spark, d))


@query("benchmark_difference")
def benchmark_difference(spark, d):
    """How much better the fused arm is than BM25, by kind of question, with an interval."""
    return benchmark.paired(scored(spark, d), "hybrid", "bm25", value="rr")
