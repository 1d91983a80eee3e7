"""Queries for entities, routing, supersession within a pool, hand-off and reports, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.config import CONFIG
from recollect.functions import text
from recollect.operators import entities, gates, graphs, recall, reports, supersession
from recollect.plans.queries import _GRAMS, _JACCARD, _SETS, ACTIVE, WORDS, _said, _values, active, query, terms
from recollect.sources import bindings as B

POOL = 40
#: A small dictionary of the words of the driver's texts.
ENTITIES = [("thean", "person"), ("the", "thing"), ("outhe", "thing"), ("ertion", "place"), ("tion", "place"), ("waser", "person"), ("haan", "thing"), ("anha", "person")]
GOALS = [("where the station is", 1.0), ("the name of that person", 0.9), ("und der stadt", 0.7)]
QUESTIONS = [("p1", "the ertion of that"), ("p2", "der einen und das")]
#: What opens a correction in the driver's texts.
CUE = r"(?i)\b(was|not|wh)\b"


def _case(rules, column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for n, p in rules) + " END"


def _grams(name: str, source: str, key: str, expr: str) -> str:
    """A table (key, g) of distinct bigrams of an expression."""
    return f"{name}_s AS (SELECT {key}, regexp_replace(lower({expr}), '\\s+', '', 'g') AS s FROM {source}), {name} AS (SELECT {key}, CASE WHEN length(s) >= 2 THEN {_GRAMS} WHEN length(s) = 1 THEN [s] ELSE [] END AS g FROM {name}_s)"


# -- old and new ------------------------------------------------------------------------------------

_POOL = f"""t(query_id, term_rank, term) AS {_values(WORDS)}, hit AS (SELECT DISTINCT query_id, fact_id, act, valid_from, content FROM act JOIN t ON list_contains(regexp_extract_all(lower(content), '[a-z0-9]+'), term)),
    pool AS (SELECT query_id, fact_id, valid_from, content FROM hit QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY act DESC, fact_id) <= {POOL})"""


def pool(spark, d):
    facts = active(spark, d).select("fact_id", "act", "valid_from", "content")
    hit = facts.join(recall.word_matches(facts, terms(spark, WORDS)).select("query_id", "fact_id").distinct(), "fact_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("act"), "fact_id")
    return graphs.saved(hit.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= POOL).select("query_id", "fact_id", "valid_from", "content"))


#: Groups of one matter within a pool, from the tables pool and t: members dd (query_id, id, k, valid_from) and the newest of each, nw.
_SUPERSEDED = """se AS (SELECT query_id, fact_id, unnest(string_split_regex(lower(content), '[.!?]\\s+')) AS s, generate_subscripts(string_split_regex(lower(content), '[.!?]\\s+'), 1) AS sn FROM pool),
    wo AS (SELECT query_id, fact_id, sn, unnest(list_distinct(regexp_extract_all(s, '[a-z0-9'']+'))) AS word FROM se),
    sz AS (SELECT query_id, count(*) AS n FROM pool GROUP BY ALL), df AS (SELECT query_id, word, count(DISTINCT fact_id) AS df FROM wo GROUP BY ALL),
    ra AS (SELECT query_id, word, df FROM df JOIN sz USING (query_id) WHERE length(word) > 2 AND df <= greatest(2, n // 2)),
    ak AS (SELECT ra.query_id, word, df FROM ra JOIN t ON t.query_id = ra.query_id AND t.term = word),
    an AS (SELECT query_id, word AS anchor FROM ak QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY df, length(word) DESC, word) = 1),
    ks AS (SELECT wo.* FROM wo JOIN ra USING (query_id, word) WHERE (query_id, fact_id, sn) IN (SELECT (query_id, fact_id, sn) FROM wo JOIN ak USING (query_id, word))),
    pr AS (SELECT x.query_id, x.fact_id AS a, y.fact_id AS b, count(*) AS n, bool_or(x.word = anchor) AS anchored FROM ks x JOIN ks y ON x.query_id = y.query_id AND x.word = y.word AND x.fact_id < y.fact_id JOIN an ON an.query_id = x.query_id GROUP BY x.query_id, x.fact_id, y.fact_id, x.sn, y.sn),
    ed AS (SELECT query_id, a, b FROM pr GROUP BY ALL HAVING max(n) >= 2 AND bool_or(anchored)),
    un AS (SELECT query_id, a, b FROM ed UNION SELECT query_id, b, a FROM ed),
    re(query_id, id, x) AS (SELECT query_id, fact_id, fact_id FROM pool UNION SELECT re.query_id, re.id, un.b FROM re JOIN un ON re.query_id = un.query_id AND re.x = un.a),
    co AS (SELECT query_id, id, min(x) AS k FROM re GROUP BY ALL), dd AS (SELECT co.query_id, id, k, valid_from FROM co JOIN pool ON pool.query_id = co.query_id AND fact_id = id WHERE valid_from IS NOT NULL),
    nw AS (SELECT query_id, k, id AS new_id, valid_from AS newest FROM dd QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY valid_from DESC, id) = 1)"""


@query("in_pool_supersession", B.with_tables("live", then=f"""WITH RECURSIVE {ACTIVE}, {_POOL},
    {_SUPERSEDED}
    SELECT query_id, id AS old_id, new_id FROM dd JOIN nw USING (query_id, k) WHERE valid_from < newest""".replace("WITH RECURSIVE ", "WITH ", 1)).replace("WITH ", "WITH RECURSIVE ", 1))  # fmt: skip
def in_pool_supersession(spark, d):
    return supersession.superseded(pool(spark, d), terms(spark, WORDS).select("query_id", F.col("term").alias("word")))


# -- entities ---------------------------------------------------------------------------------------


def dictionary(spark):
    return spark.createDataFrame(ENTITIES, "term string, kind string")


_DICT = f"dict(term, kind) AS {_values(ENTITIES)}"


@query("entity_spans", B.with_tables("evidence", then=f"""WITH {_DICT}, h AS (SELECT id, lower(content) AS low, term, kind, unnest(range(1, length(content) + 1)) AS pos FROM evidence JOIN dict ON contains(lower(content), term)),
    s AS (SELECT id, term, kind, pos, pos + length(term) AS stop FROM h WHERE substr(low, pos, length(term)) = term)
    SELECT id, term, kind, CAST(pos - 1 AS BIGINT) AS pos FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.id = s.id AND o.pos <= s.pos AND o.stop >= s.stop AND (o.pos < s.pos OR o.stop > s.stop))"""))  # fmt: skip
def entity_spans(spark, d):
    return entities.spans(B.evidence(spark, d).select("id", "content"), dictionary(spark))


@query("entity_frequency", B.with_tables("live", then=f"""WITH {_DICT}, f AS (SELECT term, kind, (SELECT count(*) FROM live WHERE contains(lower(content), term)) AS df FROM dict)
    SELECT term, kind, df, round(1 / (1 + 0.001::DOUBLE * pow(greatest(df - 1, 0)::DOUBLE, 2)), 6) AS weight FROM f"""))
def entity_frequency(spark, d):
    return entities.frequency(recall.live(B.facts(spark, d)), dictionary(spark))


# -- routing and gates --------------------------------------------------------------------------------

_WORDS = f"len(list_filter(regexp_extract_all(lower(content), '[a-z][a-z0-9]{{2,}}'), lambda w: NOT list_contains({list(text.STOP)}, w)))"


@query("route_counts", B.with_tables("evidence", then=f"""WITH r AS (SELECT actor, CASE WHEN {_case(gates.FRONT, "trim(content)")} IS NOT NULL OR regexp_matches(content, '{gates.SKIP}') THEN 'skip' WHEN regexp_matches(content, '{gates.DEEP}') THEN 'deep' WHEN {_WORDS} = 0 THEN 'skip' ELSE 'light' END AS mode FROM evidence)
    SELECT actor, mode, CASE mode WHEN 'deep' THEN 12 WHEN 'light' THEN 6 ELSE 0 END AS quota, count(*) AS n FROM r GROUP BY ALL"""))  # fmt: skip
def route_counts(spark, d):
    rows = B.evidence(spark, d).select("actor", gates.route(F.col("content")).alias("r"))
    return rows.groupBy("actor", F.col("r.mode").alias("mode"), F.col("r.limit").alias("quota")).agg(F.count("*").alias("n"))


@query("task_classes", B.with_tables("evidence", then=f"SELECT coalesce({_case(gates.TASKS, 'content')}, 'semantic') AS task, coalesce({_case(gates.EMOTIONS, 'content')}, 'none') AS emotion, count(*) AS n FROM evidence GROUP BY ALL"))
def task_classes(spark, d):
    c = F.col("content")
    return B.evidence(spark, d).groupBy(gates.task_class(c).alias("task"), F.coalesce(gates.emotion(c), F.lit("none")).alias("emotion")).agg(F.count("*").alias("n"))


@query("answer_types", B.with_tables("evidence", then=f"""WITH q AS (SELECT id, content, lag(content) OVER (PARTITION BY path ORDER BY turn) AS before FROM evidence), w AS (SELECT *, {_case(gates.EXPECTED, "before")} AS wanted FROM q)
    SELECT id, wanted, CASE wanted {" ".join(f"WHEN '{k}' THEN regexp_matches(content, '{p}')" for k, p in gates.PRESENT.items())} ELSE true END AS has FROM w WHERE before IS NOT NULL"""))  # fmt: skip
def answer_types(spark, d):
    w = Window.partitionBy("path").orderBy("turn")
    rows = B.evidence(spark, d).withColumn("before", F.lag("content").over(w)).filter("before IS NOT NULL")
    wanted, has = gates.satisfied(F.col("before"), F.array("content"))
    return rows.select("id", wanted.alias("wanted"), has.alias("has"))


@query("recall_sufficiency", B.with_tables("facts", then="""WITH r AS (SELECT fact_id, access_count AS hits, 0.7::DOUBLE * confidence + 0.3::DOUBLE * importance AS raw, status FROM facts),
    v AS (SELECT fact_id, hits, CASE WHEN status = 'superseded' THEN 0.0::DOUBLE WHEN status = 'uncertain' THEN least(raw, 0.35::DOUBLE) ELSE raw END AS value FROM r)
    SELECT fact_id, round(value, 6) AS confidence, CASE WHEN value < 0.40::DOUBLE THEN 'escalate' WHEN value < 0.55::DOUBLE AND hits >= 3 THEN 'tip-of-tongue' ELSE 'enough' END AS verdict FROM v"""))  # fmt: skip
def recall_sufficiency(spark, d):
    c = gates.sufficiency(F.col("confidence"), F.col("importance"), F.col("access_count"), F.col("status") == "uncertain", F.col("status") == "superseded")
    return B.facts(spark, d).select("fact_id", c.alias("c")).select("fact_id", "c.confidence", "c.verdict")


@query("slot_gate", B.with_tables("facts", then=f"""WITH n AS (SELECT fact_id, content, pinned, status, {" + ".join(f"CAST(regexp_matches(content, '{p}') AS BIGINT)" for _, p in text.SLOTS)} AS slots FROM facts)
    SELECT fact_id, pinned OR slots > 0 AS keep, slots, round(least(1.0::DOUBLE, 0.3::DOUBLE + 0.12::DOUBLE * slots + CASE WHEN length(content) >= 30 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 6) AS importance, round(0.6::DOUBLE + 0.1::DOUBLE * CAST(status = 'confirmed' AS INTEGER), 6) AS confidence FROM n"""))  # fmt: skip
def slot_gate(spark, d):
    return B.facts(spark, d).select("fact_id", text.slot_gate(F.col("content"), F.col("pinned"), F.col("status") == "confirmed").alias("g")).select("fact_id", "g.*")


@query("compound_facts", B.with_tables("facts", then="SELECT fact_id, len(list_filter(string_split_regex(content, '[.!?;]+\\s*'), lambda c: length(trim(c)) >= 8)) AS clauses FROM facts WHERE length(content) >= 50 AND clauses >= 2 AND NOT regexp_matches(content, '(?m)^[A-Za-z]+: ')"))
def compound_facts(spark, d):
    clauses = F.size(F.filter(F.split("content", r"[.!?;]+\s*"), lambda c: F.length(F.trim(c)) >= 8)).cast("long")
    return B.facts(spark, d).filter(text.compound(F.col("content"))).select("fact_id", clauses.alias("clauses"))


# -- scores -------------------------------------------------------------------------------------------


@query("token_estimates", B.with_tables("facts", then="SELECT fact_id, round(0.75::DOUBLE * len(regexp_extract_all(content, '[\\x{4E00}-\\x{9FFF}]')) + 0.3::DOUBLE * (length(content) - len(regexp_extract_all(content, '[\\x{4E00}-\\x{9FFF}]'))), 2) AS tokens FROM facts"))
def token_estimates(spark, d):
    return B.facts(spark, d).select("fact_id", text.token_estimate(F.col("content")).alias("tokens"))


@query("key_entropy", B.with_tables("facts", then="""WITH t AS (SELECT DISTINCT fact_id, unnest(regexp_extract_all(content, '[A-Za-z0-9_-]{20,}')) AS token FROM facts), c AS (SELECT fact_id, token, unnest(string_split(token, '')) AS ch FROM t),
    n AS (SELECT fact_id, token, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL) SELECT fact_id, token, round(-sum(n::DOUBLE / length(token) * log2(n::DOUBLE / length(token))), 4) AS bits FROM n GROUP BY ALL"""))  # fmt: skip
def key_entropy(spark, d):
    found = B.facts(spark, d).select("fact_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(text.KEYLIKE), F.lit(0)))).alias("token"))
    return found.select("fact_id", "token", F.round(text.entropy(F.col("token")), 4).alias("bits"))


@query("snippets", B.with_tables("live", then=f"""WITH t(term) AS (VALUES ('waser'), ('thean')), a AS (SELECT fact_id, term, content AS c, length(term) AS n, length(content) AS z, instr(lower(content), term) AS f FROM live JOIN t ON contains(lower(content), term)),
    b AS (SELECT *, instr(substr(lower(c), f + n), term) AS again FROM a), p AS (SELECT *, CASE WHEN again > 0 THEN f + n + again - 1 END AS s FROM b),
    w AS (SELECT *, greatest(f - 30, 1) AS a1, least(f + n - 1 + 30, z) AS b1, greatest(s - 30, 1) AS a2, least(s + n - 1 + 30, z) AS b2 FROM p)
    SELECT fact_id, term, CASE WHEN s IS NULL THEN substr(c, a1, b1 - a1 + 1) WHEN a2 <= b1 + 1 THEN substr(c, a1, b2 - a1 + 1) ELSE substr(c, a1, b1 - a1 + 1) || ' … ' || substr(c, a2, b2 - a2 + 1) END AS snippet FROM w"""))  # fmt: skip
def snippets(spark, d):
    t = spark.createDataFrame([("waser",), ("thean",)], "term string")
    facts = recall.live(B.facts(spark, d))
    met = facts.join(recall.containing(facts.select("fact_id", F.lower("content").alias("low")), t, "fact_id", "low"), "fact_id")
    return met.select("fact_id", "term", text.snippet(F.col("content"), F.col("term")).alias("snippet"))


_G = f"goals AS (SELECT g, weight FROM ({_values([(i, t, w) for i, (t, w) in enumerate(GOALS)])}) v(i, t, weight), LATERAL (SELECT regexp_replace(lower(t), '\\s+', '', 'g') AS s), LATERAL (SELECT {_GRAMS} AS g))"


@query("goal_relevance", B.with_tables("live", then=f"""WITH {_grams("fg", "live", "fact_id", "content")}, {_G},
    m AS (SELECT fact_id, f.g AS fgr, len(list_intersect(f.g, goals.g)) AS n, weight FROM fg f, goals) SELECT fact_id, round(max(CASE WHEN n >= 2 THEN n::DOUBLE / len(fgr) * weight ELSE 0.0::DOUBLE END), 6) AS relevance FROM m GROUP BY fact_id"""))  # fmt: skip
def goal_relevance(spark, d):
    rows = recall.live(B.facts(spark, d)).select("fact_id", text.bigrams(F.col("content")).alias("grams"))
    goals = spark.createDataFrame(GOALS, "text string, weight double").select(text.bigrams(F.col("text")).alias("grams"), "weight")
    return reports.relevance_to_goals(rows, goals)


_Q = f"qs AS (SELECT query_id, g FROM ({_values(QUESTIONS)}) v(query_id, t), LATERAL (SELECT regexp_replace(lower(t), '\\s+', '', 'g') AS s), LATERAL (SELECT {_GRAMS} AS g))"


@query("pinned_candidates", B.with_tables("live", then=f"""WITH pin AS (SELECT fact_id, content FROM live WHERE pinned), {_grams("pg", "pin", "fact_id", "content")}, {_Q},
    m AS (SELECT query_id, fact_id, len(list_intersect(qs.g, pg.g)) AS shared FROM pg, qs) SELECT query_id, fact_id, shared, CAST(row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, fact_id) AS INTEGER) AS place FROM m WHERE shared >= 2 QUALIFY place <= 3"""))  # fmt: skip
def pinned_candidates(spark, d):
    q = spark.createDataFrame(QUESTIONS, "query_id string, text string").select("query_id", text.bigrams(F.col("text")).alias("q"))
    pinned = recall.live(B.facts(spark, d)).filter("pinned").select("fact_id", text.bigrams(F.col("content")).alias("g"))
    w = Window.partitionBy("query_id").orderBy(F.desc("shared"), "fact_id")
    return reports.sharing(pinned, q).withColumn("place", F.row_number().over(w)).filter("place <= 3")


@query("lexical_probe", B.with_tables("live", then=f"""WITH {ACTIVE}, {_POOL}, df AS (SELECT term, (SELECT count(*) FROM live WHERE contains(lower(content), term)) AS df FROM (SELECT DISTINCT term FROM t)),
    m AS (SELECT pool.query_id, fact_id, df, contains(lower(pool.content), term) AS hit, confidence FROM pool JOIN live USING (fact_id) JOIN t ON t.query_id = pool.query_id JOIN df USING (term))
    SELECT query_id, fact_id, round(greatest(sum(CASE WHEN hit THEN 1 / log2(df + 2) ELSE 0.0::DOUBLE END) / sum(1 / log2(df + 2)), any_value(confidence) - 0.3::DOUBLE), 6) AS relevance FROM m GROUP BY ALL"""))  # fmt: skip
def lexical_probe(spark, d):
    """The cheap relevance of what is in the pool of each question."""
    facts = recall.live(B.facts(spark, d))
    df = recall.document_frequency(facts, terms(spark, WORDS))
    hits = pool(spark, d)
    met = hits.join(recall.small(df), "query_id").withColumn("hit", F.contains(F.lower("content"), F.col("term")))
    sims = hits.select("query_id", "fact_id").join(facts.select("fact_id", (F.col("confidence") - 0.3).alias("sim")), "fact_id")
    return reports.probe(met.select("query_id", "fact_id", "term", "df", "hit"), sims)


_BODY = "trim(regexp_replace(content, '\\s+', ' ', 'g'))"
_MADE = f"CASE WHEN length(regexp_extract({_BODY}, '^[^.!?]*[.!?]?')) BETWEEN 8 AND 40 THEN regexp_extract({_BODY}, '^[^.!?]*[.!?]?') WHEN length({_BODY}) <= 40 THEN {_BODY} ELSE substr({_BODY}, 1, 40) || '…' END"


@query("card_discovery", B.with_tables("live", then=f"""WITH {ACTIVE}, t(query_id, term_rank, term) AS {_values(WORDS)}, c AS (SELECT fact_id, act, layer, lower({_MADE}) AS card FROM act),
    h AS (SELECT query_id, fact_id, count(*) AS n, any_value(act) AS act, any_value(layer) AS layer FROM c JOIN t ON contains(card, term) GROUP BY ALL), o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, act DESC, fact_id) <= 24),
    s AS (SELECT query_id, fact_id, round(n * act * CASE WHEN layer = 'cold' THEN {CONFIG.echo_factor}::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM o) SELECT query_id, fact_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 8"""))  # fmt: skip
def card_discovery(spark, d):
    cards = active(spark, d).select("fact_id", "act", F.lower(text.card(F.col("content"))).alias("card"), (F.col("layer") == "cold").alias("echo"))
    return recall.discover(cards, terms(spark, WORDS), 8)


# -- notes, hand-off, reports --------------------------------------------------------------------------


@query("note_duplicates", B.with_tables("statements", then=f"""WITH {_SETS}, k AS (SELECT min(id) AS id, subject, CAST(valid_from AS DATE) AS day, g FROM g WHERE len(g) > 0 GROUP BY ALL)
    SELECT a.id AS a, b.id AS b, a.subject, {_JACCARD} AS jaccard FROM k a JOIN k b ON a.subject = b.subject AND a.id < b.id AND abs(date_diff('day', a.day, b.day)) <= 14
    AND least(len(a.g), len(b.g)) >= {CONFIG.near_duplicate}::DOUBLE * greatest(len(a.g), len(b.g)) - 1e-9 WHERE {_JACCARD} >= {CONFIG.near_duplicate}"""))  # fmt: skip
def note_duplicates(spark, d):
    """Pairs of notes of one subject at most 14 days apart; notes of one day with equal grams are one, named by the least id.

    A note lies in the slot of its days and the next one, so notes only meet those of about a month.
    """
    notes = _said(spark, d).withColumn("day", F.to_date("valid_from"))
    classes, _ = graphs.gram_classes(notes, "subject", "day")
    slot = F.floor(F.unix_date("day") / 15)
    slotted = classes.withColumn("slot", F.explode(F.array(slot, slot + 1)))
    days = lambda x: classes.select(F.col("id").alias(x), F.col("day").alias(f"day_{x}"))
    pairs = graphs.jaccard_pairs(slotted, CONFIG.near_duplicate, "subject", "slot").distinct().join(days("a"), "a").join(days("b").join(classes.select(F.col("id").alias("b"), "subject"), "b"), "b")
    return pairs.filter(F.abs(F.date_diff("day_a", "day_b")) <= 14).select("a", "b", "subject", "jaccard")


@query("daily_quota", "SELECT user_id AS session, CAST(ts + INTERVAL 8 HOURS AS DATE) AS day, count(*) AS used, greatest(count(*) - 3, 0) AS over FROM events GROUP BY ALL")
def daily_quota(spark, d):
    return reports.quota(B.table(spark, d, "events").select(F.col("user_id").alias("session"), "ts"), 3, 8)


@query("summary_coverage", """WITH m AS (SELECT DISTINCT l_suppkey AS cluster, l_partkey AS id FROM lineitem), s AS (SELECT DISTINCT l_orderkey AS parent, l_partkey AS id FROM lineitem), o AS (SELECT cluster, count(*) AS own FROM m GROUP BY 1),
    x AS (SELECT cluster, parent, count(*) AS n FROM m JOIN s USING (id) GROUP BY ALL), b AS (SELECT cluster, max(n) AS best FROM x GROUP BY 1) SELECT cluster, own, coalesce(best, 0) AS best, coalesce(best, 0) >= 0.5 * own AS covered FROM o LEFT JOIN b USING (cluster)""")  # fmt: skip
def summary_coverage(spark, d):
    li = B.table(spark, d, "lineitem")
    return reports.covered(li.select(F.col("l_suppkey").alias("cluster"), F.col("l_partkey").alias("id")), li.select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("id")))


@query("cluster_contradictions", """WITH v AS (SELECT l_suppkey AS cluster, l_returnflag AS key, l_linestatus AS value, l_linenumber > 5 AS polarity FROM lineitem)
    SELECT cluster, 'value' AS why FROM v WHERE key IN ('N') GROUP BY cluster, key HAVING count(DISTINCT value) > 1 UNION SELECT cluster, 'polarity' FROM v GROUP BY cluster, key, value HAVING count(DISTINCT polarity) > 1""")  # fmt: skip
def cluster_contradictions(spark, d):
    slots = B.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cluster"), F.col("l_returnflag").alias("key"), F.col("l_linestatus").alias("value"), (F.col("l_linenumber") > 5).alias("polarity"))
    return reports.contradicted(slots, ["N"])


@query("vault_marks", B.with_tables("facts", then="""WITH m AS (SELECT o_orderkey AS fact_id, o_orderstatus = 'F' AS tick, o_custkey % 2 = 0 AS pin FROM orders WHERE o_orderstatus = 'F' OR o_custkey % 2 = 0)
    SELECT fact_id, CASE WHEN status IS NULL THEN 'missing' WHEN tick AND pin THEN 'conflict' WHEN tick AND pinned THEN 'refused' WHEN tick AND status = 'candidate' THEN 'reject' WHEN pin AND status IN ('candidate', 'confirmed') THEN 'confirm' ELSE 'skipped' END AS action FROM m LEFT JOIN facts USING (fact_id)"""))  # fmt: skip
def vault_marks(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("fact_id"), (F.col("o_orderstatus") == "F").alias("tick"), (F.col("o_custkey") % 2 == 0).alias("pin"))
    return reports.mark_plan(o.filter("tick OR pin"), B.facts(spark, d))


@query("handoff_pages", B.with_tables("evidence", then="""WITH r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY occurred_at DESC, id DESC) AS n FROM evidence)
    SELECT path, count(*) AS turns, string_agg(actor || ': ' || substr(regexp_replace(content, '\\s+', ' ', 'g'), 1, 80), chr(10) ORDER BY occurred_at, id) AS page FROM r WHERE n <= 4 GROUP BY path"""))  # fmt: skip
def handoff_pages(spark, d):
    return reports.handoff(B.evidence(spark, d), 4, 80)


@query("corrections", B.with_tables("evidence", then=f"""WITH l AS (SELECT id, path, actor, content, lag(id) OVER w AS corrected_id, lag(actor) OVER w AS speaker FROM evidence WINDOW w AS (PARTITION BY path ORDER BY occurred_at, id))
    SELECT id, path, corrected_id FROM l WHERE speaker <> actor AND regexp_matches(content, '{CUE}')"""))
def corrections(spark, d):
    return reports.corrections(B.evidence(spark, d), CUE)


@query("quote_sources", B.with_tables("evidence", then="""WITH n AS (SELECT id AS note_id, path, substr(content, 1, 12) AS quote, occurred_at + INTERVAL 30 MINUTES AS noted_at FROM evidence WHERE length(content) >= 12)
    SELECT note_id, max_by(id, (occurred_at, id)) AS turn_id FROM n JOIN evidence e ON e.path = n.path AND occurred_at <= noted_at AND occurred_at >= noted_at - INTERVAL 24 HOURS AND contains(content, quote) GROUP BY note_id"""))  # fmt: skip
def quote_sources(spark, d):
    e = B.evidence(spark, d)
    notes = e.filter(F.length("content") >= 12).select(F.col("id").alias("note_id"), "path", F.substring("content", 1, 12).alias("quote"), (F.col("occurred_at") + F.expr("INTERVAL 30 MINUTES")).alias("noted_at"))
    return reports.quoted(notes, e)


_RANKS = f"WITH {ACTIVE}, r AS (SELECT subject AS query_id, fact_id, row_number() OVER (PARTITION BY subject ORDER BY act DESC, fact_id) AS rank FROM act)"


@query("recall_exam", B.with_tables("live", then=f"{_RANKS}, k AS (SELECT * FROM r WHERE rank <= 10) SELECT count(*) AS asked, count(rank) AS found, count_if(rank <= 3) AS top3, round(avg(rank), 6) AS mean_rank FROM (SELECT subject AS query_id, fact_id FROM live WHERE pinned) e LEFT JOIN k USING (query_id, fact_id)"))
def recall_exam(spark, d):
    facts = active(spark, d)
    w = Window.partitionBy("query_id").orderBy(F.desc("act"), "fact_id")
    ranks = facts.select(F.col("subject").alias("query_id"), "fact_id", "act").withColumn("rank", F.row_number().over(w)).filter("rank <= 10")
    return reports.exam(ranks, facts.filter("pinned").select(F.col("subject").alias("query_id"), "fact_id"))


@query("direct_read", B.with_tables("live", then=f"{_RANKS}, z AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, fact_id, length(substr(content, 1, 90)) AS size FROM r JOIN live USING (fact_id)) SELECT *, CAST(sum(size) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM z QUALIFY upto <= 400"))
def direct_read(spark, d):
    w = Window.partitionBy("query_id").orderBy(F.desc("act"), "fact_id")
    facts = active(spark, d).select(F.col("subject").alias("query_id"), "fact_id", "act", F.length(F.substring("content", 1, 90)).cast("long").alias("size"))
    return reports.direct_read(facts.withColumn("rank", F.row_number().over(w)).drop("act"))
