"""Queries for the pool of a question and the whole recall, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.config import CONFIG
from recollect.operators import pool, recall
from recollect.plans.dialogue import _SUPERSEDED, ENTITIES, dictionary
from recollect.plans.memory import AIDE, _IN_ORDER, hit, q
from recollect.plans.queries import _DOT, _QV, ACTIVE, FLOOR, STANCE_ACTOR, TERMS, _values, query, query_vectors, terms
from recollect.sources import bindings as B

CAP, TOP = 40, 10
MESSAGES = [("q1", "where is waser and what of outhe"), ("q2", "thean?"), ("q3", "ping"), ("q4", "nothing of the kind")]
ALIASES = [(r"(?i)\bbirthday\b|\bborn\b", ["birth", "born"]), (r"(?i)\bthe\b", ["article"])]
#: Chinese questions and the characters at which a run is cut (fixed values).
CHINESE = [(1, "上次那个星光湾是哪年的事"), (2, "还记得小白的生日吗"), (3, "我们在北京大学图书馆里看了Python文档2024"), (4, "好"), (5, "星光湾和星光湾")]
STOP, CUES = "的了吗呢吧啊是在和与我们你他她它那个这哪年里看", "上次|还记得|记得|说过"


def _facts(spark, d):
    facts = recall.with_activation(recall.not_disowned(recall.live(B.facts(spark, d)), B.stances(spark, d), STANCE_ACTOR), B.now())
    return facts.withColumns({"extracted": F.col("fact_id") % 3 == 0, "spoken": (F.col("subject") == AIDE) & (F.col("fact_id") % 4 == 0)})


def _pool(spark, d):
    v = B.vectors(spark, d)
    return pool.build(_facts(spark, d), terms(spark), dictionary(spark), v, query_vectors(v), cap=CAP, floor=FLOOR, own="own_id")


def _lexical(p: str, where: str) -> str:
    return f"""{p}m AS (SELECT query_id, fact_id, min(term_rank) AS term_rank, any_value(act) AS act FROM fx JOIN t ON contains(lower(content), term) WHERE {where} GROUP BY ALL),
    {p}k AS (SELECT * FROM {p}m QUALIFY row_number() OVER (PARTITION BY query_id, term_rank ORDER BY act DESC, fact_id) <= {CONFIG.per_term}),
    {p}x AS (SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY term_rank, act DESC, fact_id) AS rank FROM {p}k)"""


_NAMED = "SELECT term, fact_id, CAST(row_number() OVER (PARTITION BY term ORDER BY pinned DESC, status = 'confirmed' DESC, valid_from DESC, fact_id DESC) AS INTEGER) AS place FROM {facts} JOIN dict ON contains(lower(content), term) QUALIFY place <= 30"
_OWNED = f"""cs AS (SELECT fact_id, stance FROM stances WHERE actor = '{STANCE_ACTOR}' QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY created_at DESC, id DESC) = 1),
    live AS (SELECT facts.* FROM facts LEFT JOIN cs USING (fact_id) WHERE status IN {CONFIG.live} AND coalesce(stance, 'none') <> 'disown')"""
_POOLED = f"""{_OWNED}, {ACTIVE}, t(query_id, term_rank, term) AS {_values(TERMS)}, dict(term, kind) AS {_values(ENTITIES)}, {_QV},
    fx AS (SELECT *, fact_id % 3 = 0 AS extracted, subject = '{AIDE}' AND fact_id % 4 = 0 AS spoken FROM act), {_lexical("l", "true")}, {_lexical("d", "extracted")},
    vs AS (SELECT query_id, v.fact_id, {_DOT} AS sim FROM vectors v JOIN fx USING (fact_id) JOIN qv ON v.fact_id <> own_id),
    vc AS (SELECT query_id, fact_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, fact_id) AS rank FROM vs) WHERE rank <= {CONFIG.vector_k} AND sim >= {FLOOR}),
    en AS (SELECT query_id, fact_id, place AS rank FROM ({_NAMED.format(facts="fx")}) e JOIN t USING (term)),
    ch AS (SELECT query_id, fact_id, 'lexical' AS channel, rank, 1.0::DOUBLE AS weight FROM lx UNION ALL SELECT query_id, fact_id, 'distilled', rank, 1.0 FROM dx UNION ALL SELECT query_id, fact_id, 'vector', rank, 1.0 FROM vc UNION ALL SELECT query_id, fact_id, 'entity', rank, {pool.ENTITY_WEIGHT} FROM en),
    fu AS (SELECT query_id, fact_id, sum(weight / ({CONFIG.rrf_k} + rank)) AS r0, array_to_string(list_sort(list(DISTINCT channel)), ',') AS via FROM ch GROUP BY ALL),
    fs AS (SELECT fu.query_id, fu.fact_id, via, r0 + {pool.SIMILAR}::DOUBLE * greatest(0.0::DOUBLE, coalesce(sim, 0.0) - 0.5::DOUBLE) AS rrf FROM fu LEFT JOIN vc USING (query_id, fact_id)),
    sc AS (SELECT query_id, fact_id, via, act, spoken, valid_from, content, round((rrf + CASE WHEN pinned THEN {CONFIG.pin_bonus}::DOUBLE WHEN status = 'confirmed' THEN {CONFIG.confirmed_bonus}::DOUBLE ELSE 0.0::DOUBLE END) * CASE WHEN layer = 'cold' THEN {CONFIG.cold_factor}::DOUBLE ELSE 1.0::DOUBLE END
        * CASE WHEN NOT pinned AND status <> 'confirmed' THEN 0.4::DOUBLE + 0.6::DOUBLE * fresh ELSE 1.0::DOUBLE END, 6) AS score FROM fs JOIN fx USING (fact_id)),
    wide AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, act DESC, fact_id) <= {3 * CAP}), pool AS (SELECT query_id, fact_id, valid_from, content FROM wide),
    {_SUPERSEDED}, su AS (SELECT query_id, id AS fact_id, new_id FROM dd JOIN nw USING (query_id, k) WHERE valid_from < newest),
    fi AS (SELECT wide.query_id, wide.fact_id, via, act, spoken, valid_from, new_id AS superseded_by, round(score * CASE WHEN new_id IS NOT NULL THEN {CONFIG.stale_factor}::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM wide LEFT JOIN su USING (query_id, fact_id)),
    cu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, act DESC, fact_id) AS n FROM fi QUALIFY n <= {CAP}),
    po AS (SELECT query_id, fact_id, score, via, CAST(row_number() OVER (PARTITION BY query_id ORDER BY spoken, n) AS INTEGER) AS place, superseded_by, valid_from FROM cu)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("recall_pool", _recursive(B.with_tables("facts", "stances", "vectors", then=f"WITH {_POOLED} SELECT query_id, fact_id, score, via, place, superseded_by FROM po")))
def recall_pool(spark, d):
    return _pool(spark, d)


@query("recall_topk", _recursive(B.with_tables("facts", "stances", "vectors", then=f"WITH {_POOLED} SELECT query_id, fact_id, place FROM po WHERE place <= {TOP}")))
def recall_topk(spark, d):
    """The benchmark's interface: the first of the pool, without gates or scorers."""
    return _pool(spark, d).filter(F.col("place") <= TOP).select("query_id", "fact_id", "place")


_GATED = "m AS (SELECT query_id, CASE query_id WHEN 'q3' THEN 'probe' END AS blocked FROM (VALUES ('q1'), ('q2'), ('q3'), ('q4')) v(query_id))"


@query("recall_decisions", _recursive(B.with_tables("facts", "stances", "vectors", then=f"""WITH {_POOLED}, {_GATED}, x AS (SELECT query_id, fact_id, valid_from, CAST(fact_id * 7919 % 1000 AS DOUBLE) / 1000 AS xs FROM po),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(xs / {pool.STEP}::DOUBLE) DESC, valid_from DESC NULLS LAST, xs DESC, fact_id) AS ord FROM x),
    c AS (SELECT query_id, fact_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ord) AS INTEGER) AS place FROM o WHERE xs >= 0.45::DOUBLE QUALIFY place <= 2)
    SELECT m.query_id, CASE WHEN blocked IS NOT NULL THEN 'frontgate:' || blocked WHEN NOT EXISTS (SELECT 1 FROM x WHERE x.query_id = m.query_id) THEN 'no-hits' WHEN fact_id IS NULL THEN 'below-threshold' ELSE 'selected' END AS decision, fact_id, place FROM m LEFT JOIN c USING (query_id)""")))  # fmt: skip
def recall_decisions(spark, d):
    messages = spark.createDataFrame(MESSAGES, "query_id string, text string")
    dated = B.facts(spark, d).select("fact_id", "valid_from")
    scored = lambda p: p.select("query_id", "fact_id").join(dated, "fact_id").withColumn("xscore", (F.col("fact_id") * 7919 % 1000).cast("double") / 1000)
    pooled = lambda asked: _pool(spark, d).join(recall.small(asked.select("query_id")), "query_id")
    return pool.recalled(messages, pooled, scored, F.lit(0.45))


@query("entity_facts", B.with_tables("live", then=f"WITH dict(term, kind) AS {_values(ENTITIES)} {_NAMED.format(facts='live')}"))
def entity_facts(spark, d):
    return pool.entity_facts(recall.live(B.facts(spark, d)), dictionary(spark).select("term"))


LONG_TERMS = [("q1", 1, "ertionthe"), ("q1", 2, "the"), ("q2", 1, "zzthation")]


@query("probe_windows", B.with_tables("live", then=f"""WITH t(query_id, term_rank, term) AS {_values(LONG_TERMS)}, di AS (SELECT query_id, term, term AS used, fact_id FROM live JOIN t ON contains(lower(content), term)),
    cu AS (SELECT DISTINCT query_id, term, substr(term, i, 4) AS w FROM (SELECT *, unnest(range(1, length(term) - 2)) AS i FROM t ANTI JOIN di USING (query_id, term) WHERE length(term) > 4)),
    me AS (SELECT query_id, term, w, fact_id FROM live JOIN cu ON contains(lower(content), w)), df AS (SELECT query_id, term, w, count(*) AS df FROM me GROUP BY ALL),
    be AS (SELECT query_id, term, w FROM df QUALIFY row_number() OVER (PARTITION BY query_id, term ORDER BY df, w) = 1)
    SELECT query_id, term, used, fact_id FROM di UNION ALL SELECT query_id, term, w, fact_id FROM me JOIN be USING (query_id, term, w)"""))  # fmt: skip
def probe_windows(spark, d):
    return pool.probe_or_windows(recall.live(B.facts(spark, d)), terms(spark, LONG_TERMS))


STEMS = ["tion", "ing"]
_STEM = "^[a-z]{1,20}(?:" + "|".join(STEMS) + ")$"


@query("question_forms", B.with_tables("evidence", then=f"""WITH l AS (SELECT id, content, lag(content) OVER (PARTITION BY path ORDER BY turn) AS before, list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+'), lambda w: {hit('w', _STEM)}) AS s,
    list_filter(regexp_extract_all(lower(content), '[a-z][a-z0-9]{{2,}}'), lambda w: NOT list_contains(['the'], w)) AS w FROM evidence)
    SELECT id, array_to_string({_IN_ORDER("s")}, ',') AS compounds, CASE WHEN content = '' THEN 0 WHEN length(regexp_replace(content, '\\s+', '', 'g')) < 12 AND coalesce(before, '') <> '' THEN 2 ELSE 1 END AS questions,
    CASE WHEN {hit("content", ALIASES[0][0])} THEN 2 ELSE 0 END + CASE WHEN {hit("content", ALIASES[1][0])} THEN 1 ELSE 0 END AS spellings FROM l"""))  # fmt: skip
def question_forms(spark, d):
    w = Window.partitionBy("path").orderBy("turn")
    rows = B.evidence(spark, d).withColumn("before", F.lag("content").over(w))
    c = F.col("content")
    return rows.select(
        "id", F.array_join(pool.stem_compounds(c, STEMS), ",").alias("compounds"), F.size(pool.vector_questions(c, F.col("before"))).alias("questions"),
        F.size(pool.expanded(F.array().cast("array<string>"), c, ALIASES)).alias("spellings"),
    )


@query("cjk_keywords", f"""WITH c(id, m) AS {_values(CHINESE)}, r AS (SELECT id, regexp_extract_all(regexp_replace(regexp_replace(m, '{CUES}', '', 'g'), '[{STOP}]', ' ', 'g'), '[\\x{{4E00}}-\\x{{9FFF}}]{{2,}}|[A-Za-z]{{3,}}|[0-9]{{2,}}') AS w FROM c),
    u AS (SELECT DISTINCT id, unnest(w) AS w FROM r), p AS (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY length(w) DESC, w) AS n FROM u)
    SELECT c.id, coalesce(string_agg(CASE WHEN regexp_matches(w, '^[A-Za-z0-9]') THEN w ELSE substr(w, 1, 8) END, ',' ORDER BY n), '') AS words FROM c LEFT JOIN p ON p.id = c.id AND n <= 3 GROUP BY c.id""")
def cjk_keywords(spark, d):
    rows = spark.createDataFrame(CHINESE, "id int, m string")
    return rows.select("id", F.array_join(pool.cjk_keywords(F.col("m"), STOP, CUES), ",").alias("words"))


@query("json_blobs", "SELECT event_id, true AS blob FROM events WHERE json_valid(props)")
def json_blobs(spark, d):
    return B.table(spark, d, "events").select("event_id", pool.is_json_blob(F.col("props")).alias("blob")).filter("blob")
