"""Queries over a persisted inverted index of statements, with the equivalent SQL over the statements themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.config import CONFIG
from recollect.operators import graphs, index
from recollect.plans.queries import _values, query, terms
from recollect.sources import bindings as B

WORDS = [("q1", 1, "the"), ("q1", 2, "thand"), ("q2", 1, "hath"), ("q2", 2, "onnt"), ("q3", 1, "of"), ("q3", 2, "nowhere")]
#: Terms to look for; those with a letter beyond ASCII may be looked for by their runs.
PARTS = [("q1", 1, "thand"), ("q1", 2, "é onn"), ("q1", 3, "e"), ("q2", 1, "nd of th"), ("q2", 2, "ühandth"), ("q3", 1, "of"), ("q3", 2, "xyzzy"), ("q3", 3, "ärthwh erhe")]
STAGES = ["user", "assistant_a", "system"]
_T = f"t(query_id, term_rank, term) AS {_values(PARTS)}"


def built(facts) -> str:
    """The path of an index of the facts, of two batches."""
    path = graphs.folder(facts.sparkSession, "index")
    for batch in (0, 1):
        index.append(facts.filter(F.pmod("fact_id", F.lit(2)) == batch), path, batch)
    return path


@query("indexed_bm25", B.with_tables("statements", then=f"""WITH t(query_id, term_rank, term) AS {_values(WORDS)}, d AS (SELECT fact_id, regexp_extract_all(lower(content), '[a-z0-9]+') AS words FROM statements),
    s AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM d), tf AS (SELECT query_id, fact_id, term, len(words) AS dl, len(list_filter(words, lambda w: w = term)) AS tf FROM d JOIN t ON list_contains(words, term)),
    df AS (SELECT term, count(DISTINCT fact_id) AS df FROM tf GROUP BY term),
    r AS (SELECT query_id, fact_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score FROM tf JOIN df USING (term), s GROUP BY ALL)
    SELECT query_id, fact_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 10"""))  # fmt: skip
def indexed_bm25(spark, d):
    found, _ = index.bm25(spark, built(B.statements(spark, d)), terms(spark, WORDS))
    return found


@query("indexed_parts", B.with_tables("statements", then=f"WITH {_T} SELECT DISTINCT term, fact_id FROM statements JOIN t ON contains(lower(content), term)"))
def indexed_parts(spark, d):
    facts = B.statements(spark, d)
    return index.containing(spark, built(facts), facts, terms(spark, PARTS))


_FORMS = f"""fm AS (SELECT DISTINCT query_id, term, unnest(CASE WHEN regexp_full_match(term, '[\\x00-\\x7F]*') THEN [term] ELSE list_concat([term], list_transform(range(1, length(term) - 2), lambda i: substr(term, i, 4)),
    list_transform(range(1, length(term) - 1), lambda i: substr(term, i, 3)), list_transform(range(1, length(term)), lambda i: substr(term, i, 2))) END) AS form FROM t),
    df AS (SELECT query_id, term, form, count(DISTINCT fact_id) AS df FROM fm JOIN statements ON contains(lower(content), form) WHERE length(form) >= 2 GROUP BY ALL),
    us AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, term ORDER BY df, length(form) DESC, form) AS INTEGER) AS place FROM df WHERE df <= {CONFIG.too_common} QUALIFY place <= 3)"""


@query("usable_forms", B.with_tables("statements", then=f"WITH {_T}, {_FORMS} SELECT * FROM us"))
def usable_forms(spark, d):
    facts = B.statements(spark, d)
    return index.usable_forms(spark, built(facts), facts, terms(spark, PARTS))


@query("rarest_terms", B.with_tables("statements", then=f"""WITH {_T}, {_FORMS}, b AS (SELECT t.query_id, t.term, coalesce(form, t.term) AS form, coalesce(df, 0) AS df FROM (SELECT DISTINCT query_id, term FROM t) t LEFT JOIN us ON us.query_id = t.query_id AND us.term = t.term AND place = 1)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY df = 0, df, length(form) DESC, form) AS INTEGER) AS term_rank, form AS term, term AS whole FROM b"""))  # fmt: skip
def rarest_terms(spark, d):
    facts, asked = B.statements(spark, d), terms(spark, PARTS)
    return index.rarest_first(index.usable_forms(spark, built(facts), facts, asked), asked)


@query("layered_recall")
def layered_recall(spark, d):
    """Stage after stage (whose words they are) by terms and their forms."""
    said = B.statements(spark, d)
    act = (F.pmod(F.col("fact_id") * 7919, F.lit(1000)) / 1000).alias("act")
    facts = said.select("fact_id", "content", F.col("subject").alias("layer_of"), act, F.when(F.col("fact_id") % 5 == 0, "cold").otherwise("active").alias("layer"))
    probed = index.probe(spark, built(said), facts, terms(spark, PARTS), limit=3)
    return index.layered(probed, STAGES)
