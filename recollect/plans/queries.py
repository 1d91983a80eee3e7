"""Queries over the driver's tables, one for each operator, with the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.config import CONFIG
from recollect.functions import redaction, scores, text
from recollect.operators import graphs, lifecycle, pool, provenance, recall, timeline
from recollect.sources import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW = f"TIMESTAMP '{CONFIG.now}'"
TERMS = [("q1", 1, "waser"), ("q1", 2, "outhe"), ("q2", 1, "thean")]
WORDS = [("q1", 1, "the"), ("q1", 2, "thand"), ("q2", 1, "hath"), ("q2", 2, "onnt")]
QUERY_VECTORS = {"q1": 0, "q2": 7}
FLOOR = 0.15
STANCE_ACTOR = "purchase"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def terms(spark, rows=TERMS):
    return spark.createDataFrame(rows, "query_id string, term_rank int, term string")


def query_vectors(vectors: DataFrame) -> DataFrame:
    pick = F.create_map(*(F.lit(x) for k, v in QUERY_VECTORS.items() for x in (v, k)))
    return vectors.select(F.element_at(pick, F.col("fact_id").cast("int")).alias("query_id"), F.col("fact_id").alias("own_id"), F.col("vec").alias("query_vec")).filter(F.col("own_id").isin(*QUERY_VECTORS.values()))


def active(spark, d):
    return recall.with_activation(recall.live(B.facts(spark, d)), B.now())


ACTIVE = f"act AS (SELECT *, {scores.ACTIVATION_SQL} AS act, {scores.DECAY_SQL} AS fresh FROM live)"

# -- filters and state ----------------------------------------------------------------------------


@query("live_facts", B.with_tables("live", then="SELECT fact_id, subject, fact_type, status FROM live"))
def live_facts(spark, d):
    return recall.live(B.facts(spark, d)).select("fact_id", "subject", "fact_type", "status")


@query("current_stances", B.with_tables("stances", then="SELECT fact_id, actor, id, stance FROM stances QUALIFY row_number() OVER (PARTITION BY fact_id, actor ORDER BY created_at DESC, id DESC) = 1"))
def current_stances(spark, d):
    return recall.current_stances(B.stances(spark, d)).select("fact_id", "actor", "id", "stance")


@query("disowned_filter", B.with_tables("live", "stances", then=f"""WITH c AS (SELECT fact_id, stance FROM stances WHERE actor = '{STANCE_ACTOR}' QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY created_at DESC, id DESC) = 1)
    SELECT fact_id, coalesce(stance, 'none') AS stance FROM live LEFT JOIN c USING (fact_id) WHERE coalesce(stance, 'none') <> 'disown'"""))  # fmt: skip
def disowned_filter(spark, d):
    return recall.not_disowned(recall.live(B.facts(spark, d)), B.stances(spark, d), STANCE_ACTOR).select("fact_id", "stance")


@query("activation_topk", B.with_tables("live", then=f"WITH {ACTIVE} SELECT fact_id, act, round(fresh, 6) AS fresh FROM act ORDER BY act DESC, fact_id LIMIT 50"))
def activation_topk(spark, d):
    return active(spark, d).select("fact_id", "act", F.round("fresh", 6).alias("fresh")).orderBy(F.desc("act"), "fact_id").limit(50)


@query("hot_cold_migration", B.with_tables("live", then=f"""WITH {ACTIVE} SELECT fact_id, layer, new_layer FROM (SELECT fact_id, layer, CASE WHEN pinned THEN layer WHEN layer = 'active' AND act < {CONFIG.cold_below} THEN 'cold'
    WHEN layer = 'cold' AND act >= {CONFIG.active_from} THEN 'active' ELSE layer END AS new_layer FROM act) WHERE layer <> new_layer"""))  # fmt: skip
def hot_cold_migration(spark, d):
    return lifecycle.migrated(active(spark, d)).filter("layer <> new_layer").select("fact_id", "layer", "new_layer")


@query("store_stats", B.with_tables("facts", then="SELECT status, count(*) AS n, count_if(pinned) AS pinned, count_if(status IN ('candidate', 'confirmed')) AS live FROM facts GROUP BY status"))
def store_stats(spark, d):
    return B.facts(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.count_if("pinned").alias("pinned"), F.count_if(F.col("status").isin(*CONFIG.live)).alias("live"))


@query("layer_histogram", B.with_tables("live", then="SELECT layer, fact_type, count(*) AS n FROM live GROUP BY ALL"))
def layer_histogram(spark, d):
    return recall.live(B.facts(spark, d)).groupBy("layer", "fact_type").agg(F.count("*").alias("n"))


# -- recall ---------------------------------------------------------------------------------------

_T = f"t(query_id, term_rank, term) AS {_values(TERMS)}"
_COLD = f"CASE WHEN layer = 'cold' THEN {CONFIG.cold_factor}::DOUBLE ELSE 1.0::DOUBLE END"


@query("lexical_search", B.with_tables("live", then=f"""WITH {ACTIVE}, t(query_id, term_rank, term) AS {_values(TERMS[1:] + [("q1", 1, "the")])},
    h AS (SELECT query_id, fact_id, count(*) AS n, any_value(act * {_COLD}) AS s FROM act JOIN t ON contains(lower(content), term) GROUP BY ALL),
    w AS (SELECT query_id, count(*) AS wanted FROM t GROUP BY ALL)
    SELECT query_id, fact_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, fact_id) AS INTEGER) AS rank FROM h JOIN w USING (query_id) WHERE n = wanted QUALIFY rank <= 20"""))  # fmt: skip
def lexical_search(spark, d):
    return recall.search(active(spark, d), terms(spark, [*TERMS[1:], ("q1", 1, "the")]))


@query("term_rarity_order", B.with_tables("live", then=f"""WITH {_T}, f AS (SELECT query_id, term, (SELECT count(*) FROM live WHERE contains(lower(content), term)) AS df FROM t)
    SELECT query_id, term, df, CAST(row_number() OVER (PARTITION BY query_id ORDER BY df = 0, df, length(term) DESC, term) AS INTEGER) AS place FROM f"""))  # fmt: skip
def term_rarity_order(spark, d):
    return recall.rarity_order(recall.live(B.facts(spark, d)), terms(spark))


@query("bm25_topk", B.with_tables("live", then=f"""WITH t(query_id, term_rank, term) AS {_values(WORDS)}, d AS (SELECT fact_id, regexp_extract_all(lower(content), '[a-z0-9]+') AS words FROM live),
    s AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM d), tf AS (SELECT query_id, fact_id, term, len(words) AS dl, len(list_filter(words, lambda w: w = term)) AS tf FROM d JOIN t ON list_contains(words, term)),
    df AS (SELECT term, count(DISTINCT fact_id) AS df FROM tf GROUP BY term),
    r AS (SELECT query_id, fact_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score FROM tf JOIN df USING (term), s GROUP BY ALL)
    SELECT query_id, fact_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 10"""))  # fmt: skip
def bm25_topk(spark, d):
    return recall.bm25(recall.live(B.facts(spark, d)), terms(spark, WORDS))


_QV = "qv AS (SELECT CASE fact_id " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in QUERY_VECTORS.items()) + f" END AS query_id, fact_id AS own_id, vec AS query_vec FROM vectors WHERE fact_id IN {tuple(QUERY_VECTORS.values())})"
_DOT = "round(list_sum(list_transform(list_zip(vec, query_vec), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 6)"


@query("vector_topk", B.with_tables("vectors", then=f"""WITH {_QV} SELECT query_id, fact_id, sim, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, fact_id, {_DOT} AS sim,
    row_number() OVER (PARTITION BY query_id ORDER BY {_DOT} DESC, fact_id) AS rank FROM vectors JOIN qv ON fact_id <> own_id) WHERE rank <= {CONFIG.vector_k} AND sim >= {FLOOR}"""))  # fmt: skip
def vector_topk(spark, d):
    v = B.vectors(spark, d)
    return recall.vector_channel(v, query_vectors(v), CONFIG.vector_k, FLOOR, "own_id")


_CHANNELS = f"""{ACTIVE}, {_T}, {_QV},
    lm AS (SELECT query_id, fact_id, min(term_rank) AS term_rank, any_value(act) AS act FROM act JOIN t ON contains(lower(content), term) GROUP BY ALL),
    lk AS (SELECT * FROM lm QUALIFY row_number() OVER (PARTITION BY query_id, term_rank ORDER BY act DESC, fact_id) <= {CONFIG.per_term}),
    lx AS (SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY term_rank, act DESC, fact_id) AS rank FROM lk),
    vs AS (SELECT query_id, v.fact_id, {_DOT} AS sim FROM vectors v JOIN act USING (fact_id) JOIN qv ON v.fact_id <> own_id),
    vc AS (SELECT query_id, fact_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, fact_id) AS rank FROM vs) WHERE rank <= {CONFIG.vector_k} AND sim >= {FLOOR}),
    fu AS (SELECT query_id, fact_id, sum(1.0::DOUBLE / ({CONFIG.rrf_k} + rank)) AS rrf, string_agg(channel, ',' ORDER BY channel) AS via
        FROM (SELECT *, 'lexical' AS channel FROM lx UNION ALL SELECT *, 'vector' AS channel FROM vc) GROUP BY ALL)"""


def _fused(spark, d, facts):
    v = B.vectors(spark, d)
    mine = v.join(facts.select("fact_id"), "fact_id")
    return recall.fuse(("lexical", recall.lexical_channel(facts, terms(spark))), ("vector", recall.vector_channel(mine, query_vectors(v), CONFIG.vector_k, FLOOR, "own_id")))


@query("rrf_fusion", B.with_tables("live", "vectors", then=f"WITH {_CHANNELS} SELECT query_id, fact_id, round(rrf, 6) AS rrf, via FROM fu"))
def rrf_fusion(spark, d):
    return _fused(spark, d, active(spark, d)).withColumn("rrf", F.round("rrf", 6))


@query("hybrid_recall", B.with_tables("facts", "stances", "vectors", then=f"""WITH cs AS (SELECT fact_id, stance FROM stances WHERE actor = '{STANCE_ACTOR}' QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY created_at DESC, id DESC) = 1),
    live AS (SELECT facts.* FROM facts LEFT JOIN cs USING (fact_id) WHERE status IN {CONFIG.live} AND coalesce(stance, 'none') <> 'disown'), {_CHANNELS},
    sc AS (SELECT query_id, fact_id, via, act, round((rrf + CASE WHEN pinned THEN {CONFIG.pin_bonus}::DOUBLE WHEN status = 'confirmed' THEN {CONFIG.confirmed_bonus}::DOUBLE ELSE 0.0::DOUBLE END) * {_COLD}
        * CASE WHEN NOT pinned AND status <> 'confirmed' THEN 0.4::DOUBLE + 0.6::DOUBLE * fresh ELSE 1.0::DOUBLE END, 6) AS score FROM fu JOIN act USING (fact_id))
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, act DESC, fact_id) AS INTEGER) AS rank, fact_id, score, via, act FROM sc QUALIFY rank <= {CONFIG.keep}"""))  # fmt: skip
def hybrid_recall(spark, d):
    facts = recall.with_activation(recall.not_disowned(recall.live(B.facts(spark, d)), B.stances(spark, d), STANCE_ACTOR), B.now())
    return recall.hybrid(facts, _fused(spark, d, facts))


@query("crossencoder_select", B.with_tables("live", then="""WITH p AS (SELECT subject AS query_id, fact_id, CAST(fact_id * 7919 % 1000 AS DOUBLE) / 1000 AS xscore, pinned FROM live),
    k AS (SELECT *, row_number() OVER w AS place, first_value(xscore) OVER w AS best FROM p WHERE xscore >= CASE WHEN pinned THEN 0.8 ELSE 0.45 END WINDOW w AS (PARTITION BY query_id ORDER BY xscore DESC, fact_id))
    SELECT query_id, fact_id, xscore, CAST(place AS INTEGER) AS place FROM k WHERE place <= 2 AND xscore >= 0.7::DOUBLE * best"""))  # fmt: skip
def crossencoder_select(spark, d):
    pool = recall.live(B.facts(spark, d)).select(F.col("subject").alias("query_id"), "fact_id", ((F.col("fact_id") * 7919 % 1000).cast("double") / 1000).alias("xscore"), "pinned")
    return recall.select_scored(pool, F.when(F.col("pinned"), 0.8).otherwise(0.45)).drop("pinned")


@query("judge_select", B.with_tables("live", then="""WITH p AS (SELECT subject AS query_id, fact_id, fact_id * 31 % 11 AS judge, fact_type FROM live)
    SELECT query_id, fact_id, judge, CAST(row_number() OVER (PARTITION BY query_id ORDER BY judge DESC, fact_id) AS INTEGER) AS place FROM p WHERE judge >= CASE fact_type WHEN 'episodic' THEN 9 WHEN 'preference' THEN 7 ELSE 8 END QUALIFY place <= 2"""))  # fmt: skip
def judge_select(spark, d):
    least = F.when(F.col("fact_type") == "episodic", 9).when(F.col("fact_type") == "preference", 7).otherwise(8)
    w = Window.partitionBy("query_id").orderBy(F.desc("judge"), "fact_id")
    pool = recall.live(B.facts(spark, d)).select(F.col("subject").alias("query_id"), "fact_id", (F.col("fact_id") * 31 % 11).alias("judge"), least.alias("least"))
    return pool.filter("judge >= least").withColumn("place", F.row_number().over(w)).filter("place <= 2").drop("least")


# -- provenance -----------------------------------------------------------------------------------

_EFF = f"""e AS (SELECT *, nullif(regexp_extract(content, '^\\[([a-z_]+)\\]\\s*', 1), '') AS named FROM evidence),
    ev AS (SELECT * EXCLUDE (named), CASE WHEN named IS NULL THEN actor WHEN named IN {tuple(B.SUBJECTS[:-1])} THEN named END AS effective_actor FROM e)"""


def _effective(spark, d):
    return provenance.effective(B.evidence(spark, d), tuple(B.SUBJECTS[:-1]))


@query("evidence_effective", B.with_tables("evidence", then=f"WITH {_EFF} SELECT id, actor, effective_actor, locator FROM ev"))
def evidence_effective(spark, d):
    return _effective(spark, d).select("id", "actor", "effective_actor", "locator")


_FE = "fe AS (SELECT fact_id, subject, status, pinned, (fact_id % (SELECT max(conv_id) + 1 FROM evidence)) * 1000 + k AS evidence_id, CASE WHEN (fact_id + k) % 5 = 0 THEN 'contradict' ELSE 'support' END AS role FROM facts, range(0, 4) r(k))"


def _links(spark, d):
    size = B.table(spark, d, "conversations").agg((F.max("conv_id") + 1).alias("size"))
    rows = B.facts(spark, d).select("fact_id", "subject", "status", "pinned").join(F.broadcast(size), F.lit(True)).withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    return rows.select("fact_id", "subject", "status", "pinned", (F.col("fact_id") % F.col("size") * 1000 + F.col("k")).alias("evidence_id"), F.when((F.col("fact_id") + F.col("k")) % 5 == 0, "contradict").otherwise("support").alias("role"))


_SUP = f"""{_FE}, {_EFF}, su AS (SELECT fact_id, count(*) AS n_support, count_if(effective_actor = subject) AS n_owner, list_sort(list(DISTINCT effective_actor)) AS actors
    FROM fe JOIN ev ON evidence_id = ev.id WHERE role = 'support' AND effective_actor IS NOT NULL GROUP BY fact_id),
    sp AS (SELECT f.fact_id, f.subject, f.status, f.pinned, coalesce(n_support, 0) AS n_support, coalesce(n_owner, 0) AS n_owner, coalesce(actors, []) AS actors FROM facts f LEFT JOIN su USING (fact_id))"""


@query("provenance_summary", B.with_tables("facts", "evidence", then=f"WITH {_SUP} SELECT fact_id, subject, n_support, n_owner, array_to_string(actors, ',') AS actors FROM sp"))
def provenance_summary(spark, d):
    return provenance.support(_links(spark, d), _effective(spark, d)).select("fact_id", "subject", "n_support", "n_owner", F.array_join("actors", ",").alias("actors"))


@query("echo_only", B.with_tables("facts", "evidence", then=f"""WITH {_SUP} SELECT fact_id, subject, n_support FROM sp WHERE n_support > 0 AND status <> 'confirmed' AND NOT pinned
    AND NOT CASE WHEN subject = '{CONFIG.group}' THEN list_contains(actors, '{CONFIG.owner}') AND len(actors) > 1 ELSE list_contains(actors, subject) END"""))  # fmt: skip
def echo_only(spark, d):
    found = provenance.support(_links(spark, d), _effective(spark, d)).join(B.facts(spark, d).select("fact_id", "status", "pinned"), "fact_id")
    return found.filter(provenance.echo_only(found)).select("fact_id", "subject", "n_support")


@query("vote_consolidation", B.with_tables("votes", then=f"""WITH b AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY subject, key, value, root ORDER BY weight DESC, fact_id) = 1)
    SELECT subject, key, value, round(sum(weight), 6) AS votes, count_if(weight = 1) AS owner_votes, count(DISTINCT day) AS days, count(*) AS roots FROM b GROUP BY subject, key, value
    HAVING round(sum(weight), 6) >= {CONFIG.votes} AND count(DISTINCT day) >= {CONFIG.vote_days} AND count_if(weight = 1) >= 1"""))  # fmt: skip
def vote_consolidation(spark, d):
    return provenance.consolidated(B.votes(spark, d))


@query("slot_conflicts", B.with_tables("votes", then="SELECT subject, key, string_agg(value, ',' ORDER BY value) AS values, CAST(count(*) AS INTEGER) AS n_values FROM (SELECT DISTINCT subject, key, value FROM votes) GROUP BY subject, key HAVING count(*) > 1"))
def slot_conflicts(spark, d):
    return provenance.conflicts(B.votes(spark, d))


@query("evidence_health", B.with_tables("facts", "evidence", then=f"""WITH {_FE} SELECT fact_id, count(ev.id) AS n_evidence, count_if(ev.id IS NULL) AS missing, count_if(ev.actor <> fe.subject) AS secondhand,
    round(avg(CASE WHEN ev.actor = fe.subject THEN 1.0::DOUBLE WHEN ev.id IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END), 6) AS weight,
    bool_or(f.fact_type IN ('semantic', 'procedural') AND f.valid_from < {NOW} - INTERVAL 180 DAYS) AS stale
    FROM fe JOIN facts f USING (fact_id) LEFT JOIN evidence ev ON evidence_id = ev.id GROUP BY fact_id"""))  # fmt: skip
def evidence_health(spark, d):
    said = B.evidence(spark, d).select(F.col("id").alias("evidence_id"), "actor", F.lit(True).alias("there"))
    rows = _links(spark, d).join(said, "evidence_id", "left").join(B.facts(spark, d).select("fact_id", "fact_type", "valid_from"), "fact_id")
    weight = F.when(F.col("actor") == F.col("subject"), 1.0).when(F.col("there").isNull(), 0.0).otherwise(0.5)
    old = F.col("fact_type").isin("semantic", "procedural") & (F.col("valid_from") < F.expr(f"TIMESTAMP_NTZ '{CONFIG.now}' - INTERVAL 180 DAYS"))
    return rows.groupBy("fact_id").agg(F.count("there").alias("n_evidence"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("actor") != F.col("subject")).alias("secondhand"), F.round(F.avg(weight), 6).alias("weight"), F.bool_or(old).alias("stale"))


@query("stale_marks_latest", B.with_tables("marks", then="SELECT old_id, arg_max(new_id, (marked_at, new_id)) AS new_id FROM marks GROUP BY old_id"))
def stale_marks_latest(spark, d):
    return provenance.newest_marks(B.marks(spark, d))


_STATE = """st AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 < 3 THEN 0 ELSE o_custkey % 5 END AS s, CASE WHEN o_orderkey % 9 = 0 THEN 'superseded' WHEN o_orderkey % 9 < 7 THEN 'candidate' ELSE 'confirmed' END AS status,
    o_orderkey % 37 = 0 AS pinned, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS valid_from, CASE WHEN o_orderkey % 26 <> 0 THEN o_orderdate END AS created_at, CASE WHEN o_orderkey % 41 = 0 THEN o_orderdate END AS valid_to,
    CASE WHEN o_orderkey % 7 > 1 THEN 'k' || o_custkey % 2 * (o_orderkey % 3 // 2) END AS key, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 2 AS VARCHAR) END AS value, o_orderkey % 4 > 0 AS polarity FROM orders),
    own AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'N'), pr AS (SELECT old_id, CASE WHEN old_id % 17 = 0 THEN old_id WHEN old_id % 19 = 0 THEN -1 ELSE new_id END AS new_id,
    CASE old_id % 5 WHEN 0 THEN 'what is it' WHEN 1 THEN ' ' END AS slot FROM marks),
    ch AS (SELECT pr.*, CASE WHEN o.status IS NULL OR n.status IS NULL THEN 'unknown-fact' WHEN o.id = n.id THEN 'same-row' WHEN o.s <> n.s THEN 'subject' WHEN n.s <> 0 THEN 'not-owner'
    WHEN o.status <> 'candidate' OR o.pinned OR o.valid_to IS NOT NULL THEN 'old-not-plain' WHEN n.status NOT IN ('candidate', 'confirmed') OR n.valid_to IS NOT NULL THEN 'new-not-live'
    WHEN NOT coalesce(coalesce(o.valid_from, o.created_at) < coalesce(n.valid_from, n.created_at), false) THEN 'not-later' WHEN own.id IS NULL THEN 'not-own-words'
    WHEN o.key <> n.key THEN 'key' WHEN o.key = n.key AND o.value IS NOT DISTINCT FROM n.value AND o.polarity = n.polarity THEN 'same-value'
    WHEN (o.key IS NULL OR n.key IS NULL) AND coalesce(trim(slot), '') = '' THEN 'no-slot' ELSE 'ok' END AS reason
    FROM pr LEFT JOIN st o ON o.id = pr.old_id LEFT JOIN st n ON n.id = pr.new_id LEFT JOIN own ON own.id = pr.new_id)"""


def _stale_facts(spark, d):
    k, when = F.col("o_orderkey"), lambda c: F.when(c, F.col("o_orderdate"))
    status = F.when(k % 9 == 0, "superseded").when(k % 9 < 7, "candidate").otherwise("confirmed")
    subject = F.when(F.col("o_custkey") % 5 < 3, CONFIG.owner).otherwise(F.element_at(F.array(*map(F.lit, B.SUBJECTS)), (F.col("o_custkey") % 5 + 1).cast("int")))
    key = F.when(k % 7 > 1, F.concat(F.lit("k"), (F.col("o_custkey") % 2 * F.floor(k % 3 / 2)).cast("int")))
    value = F.when(k % 11 != 0, (k % 2).cast("string"))
    return B.table(spark, d, "orders").select(
        k.alias("fact_id"), subject.alias("subject"), status.alias("status"), (k % 37 == 0).alias("pinned"), when(k % 13 != 0).alias("valid_from"), when(k % 26 != 0).alias("created_at"), when(k % 41 == 0).alias("valid_to"),
        key.alias("key"), value.alias("value"), (k % 4 > 0).alias("polarity"),
    )


def _stale_pairs(spark, d):
    """The next order of a customer, now and then the order itself or none that is known; supported by the owner where a line was not returned."""
    old = F.col("old_id")
    pairs = B.marks(spark, d).select("old_id", F.when(old % 17 == 0, old).when(old % 19 == 0, -1).otherwise(F.col("new_id")).alias("new_id"), F.when(old % 5 == 0, "what is it").when(old % 5 == 1, " ").alias("slot"))
    said = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.when(F.col("l_returnflag") == "N", CONFIG.owner).otherwise(CONFIG.assistants[0]).alias("actor"))
    return provenance.stale_checked(pairs, _stale_facts(spark, d), said)


@query("stale_gate", B.with_tables("marks", then=f"WITH {_STATE} SELECT reason, count(*) AS n FROM ch GROUP BY reason"))
def stale_gate(spark, d):
    return _stale_pairs(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query("stale_annotated", B.with_tables("marks", then=f"""WITH {_STATE}, mk AS (SELECT old_id, CASE WHEN old_id % 3 = 0 THEN old_id ELSE new_id END AS new_id, slot FROM ch WHERE reason IN ('ok', 'no-slot', 'same-value', 'key', 'not-own-words', 'old-not-plain', 'new-not-live')),
    h AS (SELECT mk.*, coalesce(n.valid_from, n.created_at) AS happened FROM mk JOIN st o ON o.id = old_id AND o.status = 'candidate' AND NOT o.pinned AND o.valid_to IS NULL JOIN st n ON n.id = new_id AND n.status IN ('candidate', 'confirmed') AND n.valid_to IS NULL),
    b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY old_id ORDER BY happened DESC NULLS LAST, new_id DESC) = 1)
    SELECT id AS fact_id, new_id AS newer_id, slot, CASE WHEN new_id IS NULL THEN 1.0 ELSE {CONFIG.stale_factor} END::DOUBLE AS score FROM st LEFT JOIN b ON old_id = id"""))  # fmt: skip
def stale_annotated(spark, d):
    kept = _stale_pairs(spark, d).filter(F.col("reason").isin("ok", "no-slot", "same-value", "key", "not-own-words", "old-not-plain", "new-not-live"))
    marks = kept.withColumn("new_id", F.when(F.col("old_id") % 3 == 0, F.col("old_id")).otherwise(F.col("new_id")))
    facts = _stale_facts(spark, d)
    return provenance.stale_annotated(facts.select("fact_id", F.lit(1.0).alias("score")), marks, facts).select("fact_id", "newer_id", "slot", "score")


@query("evidence_verify", B.with_tables("evidence", then="""WITH l AS (SELECT path, turn, CASE WHEN turn % 3 = 0 THEN content WHEN turn % 3 = 1 THEN content || '!' ELSE 'other' END AS line FROM evidence WHERE turn <> 5)
    SELECT id, CASE WHEN line IS NULL THEN 'broken' WHEN content = line THEN 'verified' WHEN contains(line, content) OR contains(content, line) THEN 'uncertain' ELSE 'broken' END AS state FROM evidence LEFT JOIN l USING (path, turn)"""))  # fmt: skip
def evidence_verify(spark, d):
    e = B.evidence(spark, d)
    line = F.when(F.col("turn") % 3 == 0, F.col("content")).when(F.col("turn") % 3 == 1, F.concat("content", F.lit("!"))).otherwise("other")
    return provenance.verified(e, e.filter("turn <> 5").select("path", "turn", line.alias("line"))).select("id", "state")


# -- sessions and time ----------------------------------------------------------------------------


@query("context_window", B.with_tables("evidence", then="SELECT id, path, list(id) OVER (PARTITION BY path ORDER BY occurred_at, id ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS l FROM evidence").replace("SELECT id, path, list(id)", "SELECT id, path, array_to_string(l, ',') AS around FROM (SELECT id, path, list(id)") + ")")
def context_window(spark, d):
    return timeline.context_window(B.evidence(spark, d)).withColumn("around", F.array_join(F.col("around").cast("array<string>"), ","))


@query("turn_dedupe", """WITH RECURSIVE l AS (SELECT event_id AS id, user_id, ts, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT id, user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, id) AS run FROM l),
    k(user_id, run, ts) AS (SELECT user_id, run, min(ts) FROM r GROUP BY ALL UNION ALL SELECT k.user_id, k.run, min(r.ts) FROM k JOIN r ON r.user_id = k.user_id AND r.run = k.run AND epoch_us(r.ts) - epoch_us(k.ts) > 21600000000 GROUP BY k.user_id, k.run)
    SELECT min(id) AS id, user_id FROM k JOIN r USING (user_id, run, ts) GROUP BY user_id, run, ts""")
def turn_dedupe(spark, d):
    e = B.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("path"), F.col("event_type").alias("actor"), F.lit("").alias("content"), F.col("ts").alias("occurred_at"))
    return timeline.without_repeats(e, 6 * 3600).select("id", F.col("path").alias("user_id"))


@query("interval_dedupe", """SELECT event_id, user_id FROM events a WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'view' AND b.user_id = a.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 900000000)""")
def interval_dedupe(spark, d):
    """Clicks with no view of the same user within 15 minutes: an equi-join on the user and a time slot, not a join of all pairs."""
    width = 900_000_000
    e = B.table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    slot = F.floor(F.col("us") / width)
    side = e.filter("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("us").alias("v"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("s"))
    clicks = e.filter("event_type = 'click'").withColumn("slot", slot)
    near = (F.col("user_id") == F.col("u")) & (F.col("slot") == F.col("s")) & (F.abs(F.col("us") - F.col("v")) <= width)
    return clicks.join(side, near, "left_anti").select("event_id", "user_id")


@query("session_due_state", f"""WITH s AS (SELECT user_id AS session, count(*) AS n, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id)
    SELECT session, n, CASE WHEN (epoch_us({NOW}) - epoch_us(b)) / 60000000.0 >= {CONFIG.idle_minutes + 2880} THEN 'idle' WHEN (epoch_us({NOW}) - epoch_us(b)) / 60000000.0 < {CONFIG.settle_minutes} THEN 'settling'
    WHEN n >= {CONFIG.cap_messages} OR (epoch_us({NOW}) - epoch_us(a)) / 60000000.0 >= {CONFIG.cap_hours * 60} THEN 'capped' ELSE 'waiting' END AS state FROM s""")
def session_due_state(spark, d):
    from dataclasses import replace

    pending = B.table(spark, d, "events").select(F.col("user_id").alias("session"), "ts")
    return timeline.due_sessions(pending, B.now(), replace(CONFIG, idle_minutes=CONFIG.idle_minutes + 2880)).select("session", "n", "state")


@query("session_windows", """WITH e AS (SELECT user_id, ts, event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 10800000000, true) AS fresh FROM events),
    g AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e)
    SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM g GROUP BY user_id, g""")
def session_windows(spark, d):
    e = B.table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", f"{CONFIG.idle_minutes} minutes")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).drop("session_window")


@query("greedy_chunks", B.with_tables("evidence", then=f"""WITH RECURSIVE r AS (SELECT id, path, length(content) AS n, row_number() OVER (PARTITION BY path ORDER BY occurred_at, id) AS k FROM evidence),
    g AS (SELECT id, path, k, n AS size, 0 AS chunk FROM r WHERE k = 1 UNION ALL SELECT r.id, r.path, r.k, CASE WHEN size > 0 AND size + n > {CONFIG.chunk_chars} THEN n ELSE size + n END, CASE WHEN size > 0 AND size + n > {CONFIG.chunk_chars} THEN chunk + 1 ELSE chunk END FROM g JOIN r ON r.path = g.path AND r.k = g.k + 1)
    SELECT id, path, chunk FROM g""".replace("WITH RECURSIVE ", "WITH ", 1)).replace("WITH ", "WITH RECURSIVE ", 1))  # fmt: skip
def greedy_chunks(spark, d):
    return timeline.greedy_chunks(B.evidence(spark, d))


_CARDS = (
    "kw AS (SELECT fact_id, subject, valid_from, list_filter(regexp_extract_all(lower(content), '[a-z][a-z0-9]{2,}'), lambda w: NOT list_contains(%s, w)) AS w FROM live),"
    " k AS (SELECT fact_id, subject, valid_from, list_filter(w, lambda x, i: list_position(w, x) = i)[1:6] AS words FROM kw)"
) % (str(list(text.STOP)),)


_ALL_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z][a-z0-9]{2,}'), lambda w: NOT list_contains(%s, w)))" % (str(list(text.STOP)),)


@query("later_siblings", B.with_tables("statements", then=f"""WITH g AS (SELECT fact_id, subject, valid_from, unnest({_ALL_WORDS}) AS g FROM statements),
    m AS (SELECT a.fact_id, b.fact_id AS later_id, b.valid_from AS later_at, count(*) AS shared FROM g a JOIN g b ON a.subject = b.subject AND a.g = b.g AND b.valid_from > a.valid_from + INTERVAL 12 HOURS GROUP BY ALL HAVING count(*) >= 3)
    SELECT fact_id, later_id, shared, CAST(row_number() OVER (PARTITION BY fact_id ORDER BY shared DESC, later_at DESC, later_id) AS INTEGER) AS place FROM m QUALIFY place <= 5"""))  # fmt: skip
def later_siblings(spark, d):
    return timeline.later_siblings(B.statements(spark, d).withColumn("words", text.all_keywords(F.col("content"))))


@query("timeline_candidates", B.with_tables("statements", then=f"""WITH g AS (SELECT fact_id, subject, CAST(valid_from AS DATE) AS day, unnest({_ALL_WORDS}) AS g FROM statements),
    m AS (SELECT a.fact_id, b.fact_id AS earlier_id, a.g, b.day FROM g a JOIN g b ON a.subject = b.subject AND a.g = b.g AND b.day < a.day QUALIFY row_number() OVER (PARTITION BY a.fact_id, a.g ORDER BY b.day DESC, b.fact_id DESC) <= 4)
    SELECT fact_id, earlier_id, CAST(row_number() OVER (PARTITION BY fact_id ORDER BY day DESC, earlier_id DESC) AS INTEGER) AS place FROM (SELECT DISTINCT fact_id, earlier_id, day FROM m) QUALIFY place <= 6"""))  # fmt: skip
def timeline_candidates(spark, d):
    return timeline.timeline_candidates(B.statements(spark, d).withColumn("words", text.all_keywords(F.col("content"))))


# -- similarity and clusters ------------------------------------------------------------------------

_GRAMS = "list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i, 2)))"
_SETS = f"s AS (SELECT fact_id, subject, valid_from, regexp_replace(lower(content), '\\s+', '', 'g') AS s FROM statements), g AS (SELECT fact_id AS id, subject, valid_from, list_sort(CASE WHEN length(s) >= 2 THEN {_GRAMS} WHEN length(s) = 1 THEN [s] ELSE [] END) AS g FROM s)"
_JACCARD = "round(len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6)"


def _said(spark, d):
    return B.statements(spark, d).select(F.col("fact_id").alias("id"), "subject", "valid_from", text.bigrams(F.col("content")).alias("grams"))


@query("bigram_jaccard_pairs", B.with_tables("statements", then=f"""WITH {_SETS}, k AS (SELECT min(id) AS id, subject, g, count(*) AS n FROM g WHERE len(g) > 0 GROUP BY subject, g)
    SELECT a.id AS a, b.id AS b, a.subject, a.n AS n_a, b.n AS n_b, {_JACCARD} AS jaccard FROM k a JOIN k b ON a.subject = b.subject AND a.id < b.id
    AND least(len(a.g), len(b.g)) >= {CONFIG.near_duplicate}::DOUBLE * greatest(len(a.g), len(b.g)) - 1e-9 WHERE {_JACCARD} >= {CONFIG.near_duplicate}"""))  # fmt: skip
def bigram_jaccard_pairs(spark, d):
    """Pairs of classes of equal gram sets, named by their least id, with the numbers of their members."""
    classes, _ = graphs.gram_classes(_said(spark, d), "subject")
    n = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"))
    return graphs.jaccard_pairs(classes, CONFIG.near_duplicate, "subject").join(n("a"), "a").join(n("b").join(classes.select(F.col("id").alias("b"), "subject"), "b"), "b").select("a", "b", "subject", "n_a", "n_b", "jaccard")


@query("near_dup_leaders")
def near_dup_leaders(spark, d):
    """The report of near duplicates: statements of the last 14 days, each with its leader."""
    recent = _said(spark, d).filter(F.col("valid_from") >= F.expr(f"TIMESTAMP_NTZ '{CONFIG.now}' - INTERVAL 14 DAYS"))
    classes, members = graphs.gram_classes(recent, "subject")
    led = graphs.leaders(graphs.jaccard_pairs(classes, 0.7, "subject"), classes.select("id"))
    return members.join(led.withColumnRenamed("id", "class"), "class").select("id", "leader")


THRESHOLD = 0.4
_SIM = "round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 6)"
_COMP = f"""p AS (SELECT a.fact_id AS a, b.fact_id AS b FROM vectors a JOIN vectors b ON a.fact_id < b.fact_id WHERE {_SIM} >= {THRESHOLD}),
    u AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(id, x) AS (SELECT fact_id, fact_id FROM vectors UNION SELECT r.id, u.b FROM r JOIN u ON r.x = u.a), k AS (SELECT id, min(x) AS component FROM r GROUP BY id)"""


def _nodes(spark, d):
    return B.vectors(spark, d).select(F.col("fact_id").alias("id"), "vec")


@query("cosine_components", B.with_tables("vectors", then=f"WITH {_COMP} SELECT id, component FROM k").replace("WITH ", "WITH RECURSIVE ", 1))
def cosine_components(spark, d):
    v = _nodes(spark, d)
    return graphs.components(graphs.cosine_links(v, THRESHOLD), v)


@query("upgma_clusters")
def upgma_clusters(spark, d):
    return graphs.linked_clusters(_nodes(spark, d), THRESHOLD)


@query("cluster_eligibility")
def cluster_eligibility(spark, d):
    """Clusters of three and more, two of them the owner's own, on two days and more."""
    of = graphs.linked_clusters(_nodes(spark, d), 0.3)
    facts = B.facts(spark, d).select(F.col("fact_id").alias("id"), "subject", F.to_date("valid_from").alias("day"))
    own = F.col("subject") == CONFIG.owner
    out = of.join(facts, "id").groupBy("cluster").agg(F.count("*").alias("size"), F.count_if(own).alias("own"), F.count_distinct(F.when(own, F.col("day"))).alias("days"))
    return out.withColumn("eligible", (F.col("size") >= 3) & (F.col("own") >= 2) & (F.col("days") >= 2))


@query("members_hash", B.with_tables("vectors", then=f"WITH {_COMP} SELECT component, count(*) AS n, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS members_hash FROM k GROUP BY component").replace("WITH ", "WITH RECURSIVE ", 1))
def members_hash(spark, d):
    v = _nodes(spark, d)
    of = graphs.components(graphs.cosine_links(v, THRESHOLD), v)
    return of.groupBy("component").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ","), 256).alias("members_hash"))


# -- text -----------------------------------------------------------------------------------------


@query("latin_keywords", B.with_tables("live", then=f"WITH {_CARDS} SELECT fact_id, array_to_string(words, ',') AS words FROM k"))
def latin_keywords(spark, d):
    return recall.live(B.facts(spark, d)).select("fact_id", F.array_join(text.keywords(F.col("content")), ",").alias("words"))


@query("card_text", B.with_tables("facts", then="""WITH c AS (SELECT fact_id, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS body FROM facts), f AS (SELECT *, regexp_extract(body, '^[^.!?]*[.!?]?') AS first FROM c)
    SELECT fact_id, CASE WHEN length(first) BETWEEN 8 AND 40 THEN first WHEN length(body) <= 40 THEN body ELSE substr(body, 1, 40) || '…' END AS card FROM f"""))  # fmt: skip
def card_text(spark, d):
    return B.facts(spark, d).select("fact_id", text.card(F.col("content")).alias("card"))


#: A message of every kind, from what was said.
_EVERY_KIND = "CASE turn % 9 WHEN 1 THEN '{\"abcd\": [' || turn || ']}' WHEN 2 THEN 'Error: ' || replace(content, chr(10), ' ') || chr(10) || 'TypeError at x' WHEN 3 THEN 'Warning: once' || chr(10) || 'a' || chr(10) || content || chr(10) || 'b' WHEN 4 THEN 'OK!' WHEN 5 THEN '$ ls ' || content WHEN 6 THEN 'ping' WHEN 7 THEN '{\"wxyz\": \"' || turn || '\", [,],{},}' ELSE content END"
_ERROR_LINE = text.ERROR_LINE.replace("'", "''")


@query("prefilter_reasons", B.with_tables("evidence", then=rf"""WITH m AS (SELECT actor, trim({_EVERY_KIND}) AS t FROM evidence), c AS (SELECT *, lower(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) AS core, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS l FROM m),
    r AS (SELECT actor, CASE WHEN core IN {text.ACKS} OR (core = '' AND regexp_matches(t, '{text.PICTURE}')) THEN 'ack' WHEN regexp_matches(t, '{text.HEARTBEAT}') THEN 'heartbeat' WHEN length(core) < {text.SHORTEST} THEN 'too-short' WHEN regexp_matches(t, '{text.TOOL}') THEN 'tool-output'
    WHEN regexp_full_match(t, '(?s)[{{\[].*[}}\]]') AND (json_valid(t) OR length(regexp_replace(t, '[^{{}}\[\]":,]', '', 'g')) > 0.18 * length(t)) THEN 'json-blob'
    WHEN len(l) > 0 AND regexp_matches(l[1], '{_ERROR_LINE}') AND 2 * len(list_filter(l, lambda x: regexp_matches(x, '{_ERROR_LINE}'))) >= len(l) THEN 'error-log' ELSE 'kept' END AS reason FROM c)
    SELECT reason, actor, count(*) AS n FROM r GROUP BY ALL"""))  # fmt: skip
def prefilter_reasons(spark, d):
    message = F.expr(_EVERY_KIND.replace("chr(10)", "char(10)"))
    rows = B.evidence(spark, d).select("actor", message.alias("t"))
    return rows.select(F.coalesce(text.prefilter(F.col("t"), pool.is_json_blob(F.col("t"))), F.lit("kept")).alias("reason"), "actor").groupBy("reason", "actor").agg(F.count("*").alias("n"))


@query("numbers_supported", B.with_tables("evidence", then="""WITH x AS (SELECT id, list_distinct(regexp_extract_all(content, '[0-9]+')) AS n, lag(content) OVER (PARTITION BY path ORDER BY turn) AS before FROM evidence)
    SELECT id, len(n) AS numbers, len(list_filter(n, lambda v: NOT contains(coalesce(before, ''), v))) AS unsupported FROM x""".replace("len(", "len(")))  # fmt: skip
def numbers_supported(spark, d):
    w = Window.partitionBy("path").orderBy("turn")
    rows = B.evidence(spark, d).select("id", text.numbers(F.col("content")).alias("n"), F.coalesce(F.lag("content").over(w), F.lit("")).alias("before"))
    return rows.select("id", F.size("n").cast("long").alias("numbers"), F.size(F.filter("n", lambda v: ~F.contains(F.col("before"), v))).cast("long").alias("unsupported"))


@query("overlap_score", B.with_tables("evidence", then=f"""WITH s0 AS (SELECT id, path, turn, regexp_replace(lower(content), '\\s+', '', 'g') AS s FROM evidence), g AS (SELECT id, path, turn, CASE WHEN length(s) >= 2 THEN {_GRAMS} WHEN length(s) = 1 THEN [s] ELSE [] END AS g FROM s0),
    p AS (SELECT id, g, lag(g) OVER (PARTITION BY path ORDER BY turn) AS q FROM g) SELECT id, round(coalesce(len(list_intersect(q, g))::DOUBLE / nullif(len(q), 0), 0), 6) AS coverage FROM p"""))  # fmt: skip
def overlap_score(spark, d):
    w = Window.partitionBy("path").orderBy("turn")
    rows = B.evidence(spark, d).select("id", "path", "turn", text.bigrams(F.col("content")).alias("g")).withColumn("q", F.lag("g").over(w))
    return rows.select("id", F.round(text.coverage(F.col("q"), F.col("g")), 6).alias("coverage"))


@query("key_match", B.with_tables("facts", then="SELECT fact_id, CASE " + " ".join(f"WHEN regexp_matches(content, '{p}') THEN '{k}'" for k, p in text.SLOTS) + " END AS key, CASE " + " ".join(f"WHEN regexp_matches(content, '{p}') THEN regexp_extract(content, '{p}')" for _, p in text.SLOTS) + " END AS value FROM facts WHERE key IS NOT NULL"))
def key_match(spark, d):
    return B.facts(spark, d).withColumn("s", text.slot(F.col("content"))).filter("s IS NOT NULL").select("fact_id", "s.key", "s.value")


_CLAUSES = "list_filter(string_split_regex(lower(content), '[.!?;,\\n]+'), lambda c: length(trim(c)) >= 3)"


@query("clause_classify", B.with_tables("evidence", then="WITH c AS (SELECT id, " + _CLAUSES + " AS cl FROM evidence), v AS (" + " UNION ALL ".join(f"SELECT id, '{n}' AS fact_type, least(0.98::DOUBLE, {conf}::DOUBLE * (0.75::DOUBLE + 0.25::DOUBLE * len(list_filter(cl, lambda x: regexp_matches(x, '{p}'))) / len(cl))) AS confidence, len(list_filter(cl, lambda x: regexp_matches(x, '{p}'))) AS n FROM c" for n, p, conf in text.CLAUSES)
    + """), b AS (SELECT id, fact_type, confidence FROM v WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, fact_type DESC) = 1)
    SELECT c.id, CASE WHEN confidence >= 0.55 THEN fact_type ELSE 'episodic' END AS fact_type, round(CASE WHEN confidence >= 0.55 THEN confidence ELSE 0.5::DOUBLE END, 6) AS confidence FROM c LEFT JOIN b ON b.id = c.id"""))  # fmt: skip
def clause_classify(spark, d):
    return B.evidence(spark, d).withColumn("c", text.clause_type(F.col("content"))).select("id", "c.fact_type", F.round("c.confidence", 6).alias("confidence"))


_TOKENS = r"[A-Za-z0-9](?:[A-Za-z0-9_+~=-]|[.:][A-Za-z0-9]){11,}"
#: A hexadecimal key that is assigned to a telling name.
_ASSIGNED = rf"(?i)(?:{'|'.join(redaction.NAMES)})\w{{0,12}}\s*[:=]\s*[\x22\x27]?[0-9a-f]{{20,}}\b"


@query("redaction_counts", B.with_tables("facts", then=rf"""WITH t AS (SELECT fact_id, unnest(regexp_extract_all(regexp_replace(content, 'https?://[^\s"''<>]+', ' ', 'g'), '{_TOKENS}')) AS t FROM facts),
    k AS (SELECT fact_id, count(*) AS n FROM t WHERE {" OR ".join(f"regexp_matches(t, '{p}')" for _, p in redaction.FORMATS)} GROUP BY fact_id)
    SELECT fact_id, coalesce(n, 0) AS known, len(regexp_extract_all(content, '{_ASSIGNED}')) AS assigned FROM facts LEFT JOIN k USING (fact_id) WHERE coalesce(n, 0) + len(regexp_extract_all(content, '{_ASSIGNED}')) > 0"""))  # fmt: skip
def redaction_counts(spark, d):
    """Tokens of public key formats outside of addresses, and hexadecimal keys that are assigned."""
    bare = F.regexp_replace("content", r"https?://[^\s\"'<>]+", " ")
    found = F.filter(F.regexp_extract_all(bare, F.lit(_TOKENS), F.lit(0)), lambda t: reduce(or_, (t.rlike(p) for _, p in redaction.FORMATS)))
    rows = B.facts(spark, d).select("fact_id", F.size(found).cast("long").alias("known"), F.regexp_count("content", F.lit(_ASSIGNED)).cast("long").alias("assigned"))
    return rows.filter("known + assigned > 0")


@query("length_buckets", B.with_tables("evidence", then="""SELECT actor, CASE WHEN length(content) <= 12 THEN '0-12' WHEN length(content) <= 20 THEN '13-20' WHEN length(content) <= 40 THEN '21-40' WHEN length(content) <= 100 THEN '41-100' ELSE '101+' END AS bucket, count(*) AS n FROM evidence GROUP BY ALL"""))
def length_buckets(spark, d):
    n = F.length("content")
    bucket = F.when(n <= 12, "0-12").when(n <= 20, "13-20").when(n <= 40, "21-40").when(n <= 100, "41-100").otherwise("101+")
    return B.evidence(spark, d).groupBy("actor", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("promotion_audit", B.with_tables("facts", "evidence", then="""WITH f AS (SELECT subject AS actor, count(*) AS facts FROM facts GROUP BY 1), e AS (SELECT actor, count(*) AS said FROM evidence GROUP BY 1)
    SELECT coalesce(f.actor, e.actor) AS actor, coalesce(facts, 0) AS facts, coalesce(said, 0) AS said, round(facts::DOUBLE / said, 6) AS ratio FROM f FULL JOIN e ON f.actor = e.actor"""))  # fmt: skip
def promotion_audit(spark, d):
    f = B.facts(spark, d).groupBy(F.col("subject").alias("actor")).agg(F.count("*").alias("facts"))
    e = B.evidence(spark, d).groupBy("actor").agg(F.count("*").alias("said"))
    return f.join(e, "actor", "full").select("actor", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("said", F.lit(0)).alias("said"), F.round(F.col("facts") / F.col("said"), 6).alias("ratio"))


# -- working set, telemetry, bin --------------------------------------------------------------------

_KINDS = dict(zip(("view", "click", "purchase", "error", "signup"), CONFIG.bounds, strict=True))


@query("working_set_bound", "WITH r AS (SELECT event_id AS id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n, CASE event_type " + " ".join(f"WHEN '{e}' THEN {CONFIG.bounds[k]}" for e, k in _KINDS.items()) + " END AS bound FROM events) SELECT id, CASE WHEN n <= bound THEN 'open' ELSE 'evicted' END AS status FROM r")
def working_set_bound(spark, d):
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv)), F.col("event_type"))
    rows = B.table(spark, d, "events").select(F.col("user_id").alias("session"), kind.alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("updated_at"))
    return lifecycle.bounded(rows, CONFIG.bounds).select("id", "status")


@query("telemetry_report", """SELECT o_orderpriority AS mode, l_returnflag AS memory_type, count(*) AS hits, count(DISTINCT o_orderkey) AS runs, count_if(l_linenumber <= 2) AS selected, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS skipped,
    round(avg(o_totalprice / 1000), 6) AS mean_latency, round(max(o_totalprice / 1000), 6) AS max_latency FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def telemetry_report(spark, d):
    """Orders and their lines are added up by the order before they meet, so that what is distinct needs no table of keys for each answer."""
    latency = F.col("o_totalprice") / 1000
    orders = B.table(spark, d, "orders").groupBy("o_orderkey", "o_orderpriority").agg(
        F.count("*").alias("n"), F.bool_or(F.col("o_orderstatus") == "F").alias("skipped"), F.count(latency).alias("timed"), F.sum(latency).alias("latency"), F.max(latency).alias("most"),
    )
    lines = B.table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("hits"), F.count_if(F.col("l_linenumber") <= 2).alias("selected"))
    times = lambda c, by: F.sum(F.col(c) * F.col(by))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("mode"), F.col("l_returnflag").alias("memory_type")).agg(
        times("hits", "n").alias("hits"), F.count("*").alias("runs"), times("selected", "n").alias("selected"), F.count_if("skipped").alias("skipped"),
        F.round(times("hits", "latency") / F.nullif(times("hits", "timed"), F.lit(0)), 6).alias("mean_latency"), F.round(F.max("most"), 6).alias("max_latency"),
    )


@query("cooldown", f"""SELECT user_id FROM (SELECT DISTINCT user_id FROM events) u WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND event_type = 'click' AND ts > {NOW} - INTERVAL 5760 MINUTES AND ts <= {NOW})""")
def cooldown(spark, d):
    e = B.table(spark, d, "events")
    recent = e.filter((F.col("event_type") == "click") & (F.col("ts") > F.expr(f"TIMESTAMP_NTZ '{CONFIG.now}' - INTERVAL 5760 MINUTES")) & (F.col("ts") <= B.now()))
    return e.select("user_id").distinct().join(recent, "user_id", "left_anti")


_BIN = "ar AS (SELECT o_custkey AS batch_id, o_orderkey AS fact_id, o_orderdate AS opened_at FROM orders), rs AS (SELECT o_custkey AS batch_id, o_orderkey AS fact_id FROM orders WHERE o_orderstatus = 'F')"


def _bin(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("fact_id"), F.col("o_orderdate").alias("opened_at"), "o_orderstatus")
    return o.drop("o_orderstatus"), o.filter("o_orderstatus = 'F'").select("batch_id", "fact_id")


@query("trash_listing", f"""WITH {_BIN}, j AS (SELECT ar.batch_id, opened_at, rs.fact_id AS back FROM ar LEFT JOIN rs USING (batch_id, fact_id)), g AS (SELECT batch_id, count_if(back IS NULL) AS in_bin, count(back) AS restored, max(opened_at) AS o FROM j GROUP BY 1)
    SELECT batch_id, in_bin, restored, CASE WHEN in_bin = 0 THEN 'restored' WHEN o + INTERVAL {CONFIG.bin_days} DAYS < {NOW} THEN 'expired' ELSE 'open' END AS state FROM g""")
def trash_listing(spark, d):
    return lifecycle.bin_listing(*_bin(spark, d), B.now())


@query("archive_restore", f"WITH {_BIN} SELECT batch_id, fact_id FROM ar ANTI JOIN rs USING (batch_id, fact_id)")
def archive_restore(spark, d):
    archive, back = _bin(spark, d)
    return archive.join(back, ["batch_id", "fact_id"], "left_anti").select("batch_id", "fact_id")


@query("derived_pending", B.with_tables("live", "vectors", then="SELECT fact_id, subject FROM live ANTI JOIN vectors USING (fact_id)"))
def derived_pending(spark, d):
    return recall.live(B.facts(spark, d)).join(B.vectors(spark, d).select("fact_id"), "fact_id", "left_anti").select("fact_id", "subject")


@query("stratified_pick", B.with_tables("live", then="""WITH s AS (SELECT subject, count(*) AS n, sum(count(*)) OVER () AS a FROM live GROUP BY subject),
    r AS (SELECT subject, fact_id AS id, row_number() OVER (PARTITION BY subject ORDER BY sha256(CAST(fact_id AS VARCHAR)), fact_id) AS place FROM live) SELECT subject, id, CAST(place AS INTEGER) AS place FROM r JOIN s USING (subject) WHERE place <= floor(60 * n / a)"""))  # fmt: skip
def stratified_pick(spark, d):
    return lifecycle.quota_picks(recall.live(B.facts(spark, d)).withColumnRenamed("fact_id", "id"), "subject", 60)


@query("vault_groups", B.with_tables("live", then="SELECT subject, fact_type, fact_id // 500 AS shelf, count(*) AS n, string_agg('- [' || CASE WHEN pinned THEN 'x' ELSE ' ' END || '] #' || fact_id, chr(10) ORDER BY fact_id) AS page FROM live GROUP BY ALL"))
def vault_groups(spark, d):
    line = F.concat(F.lit("- ["), F.when(F.col("pinned"), "x").otherwise(" "), F.lit("] #"), F.col("fact_id"))
    rows = recall.live(B.facts(spark, d)).withColumns({"shelf": F.expr("fact_id div 500"), "line": line})
    return rows.groupBy("subject", "fact_type", "shelf").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_id", "line"))), lambda x: x["line"]), "\n").alias("page"))


@query("relation_closure", B.with_tables("facts", then="""WITH r(fact_id, root, depth) AS (SELECT fact_id, fact_id, 0 FROM facts WHERE fact_id % 10 = 0 UNION ALL SELECT f.fact_id, r.root, depth + 1 FROM facts f JOIN r ON r.fact_id = f.fact_id - 1 WHERE f.fact_id % 10 <> 0)
    SELECT fact_id, root, CAST(depth AS INTEGER) AS depth FROM r""").replace("WITH ", "WITH RECURSIVE ", 1))
def relation_closure(spark, d):
    """Each fact's root along the chains of derived facts, by doubling: after k rounds a pointer spans 2^k edges."""
    i = F.col("fact_id")
    state = graphs.saved(B.facts(spark, d).select("fact_id", F.when(i % 10 == 0, i).otherwise(i - 1).alias("up"), F.when(i % 10 == 0, 0).otherwise(1).alias("depth")))
    while True:
        above = state.select(i.alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        new = graphs.saved(state.join(above, "up").select("fact_id", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("up") != F.col("up2")).alias("moved")))
        state = new.drop("moved")
        if new.filter("moved").limit(1).count() == 0:
            return state.select("fact_id", F.col("up").alias("root"), "depth")


@query("events_props_json", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def events_props_json(spark, d):
    return B.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("k"))


from recollect.plans import arms, dialogue, indexed, memory, named, pools, store, summaries, validity  # noqa: E402, F401  register their queries here
