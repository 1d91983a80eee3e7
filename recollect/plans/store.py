"""Queries for records, sessions, hand-off notes, splits, decisions and names, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.config import CONFIG
from recollect.functions import redaction, text
from recollect.operators import entities, lifecycle, provenance, recall, records, timeline, value_gate
from recollect.plans.memory import AIDE, GROUP, OWNER, grams, hit, names, q
from recollect.plans.queries import _BIN, _EFF, _FE, _SUP, NOW, _bin, _effective, _links, active, query
from recollect.sources import bindings as B
from recollect.streaming import ingest

SPOKEN = rf"^({OWNER}|{AIDE}|me): "


@query("narrowed_facts", B.with_tables("live", then=f"SELECT fact_id, subject FROM live WHERE subject = '{OWNER}' AND fact_type IN ('semantic', 'preference') AND fact_id % 3 = 0 AND NOT {hit('content', SPOKEN)}"))
def narrowed_facts(spark, d):
    facts = recall.live(B.facts(spark, d)).withColumn("reason", F.when(F.col("fact_id") % 3 == 0, "extract-llm-v1").otherwise("rules"))
    return recall.narrowed(facts, who=OWNER, types=["semantic", "preference"], extracted=True, spoken=SPOKEN).select("fact_id", "subject")


@query("pinned_list", B.with_tables("live", then="SELECT subject, fact_id, CAST(row_number() OVER (PARTITION BY subject ORDER BY valid_from DESC, fact_id DESC) AS INTEGER) AS place FROM live WHERE pinned"))
def pinned_list(spark, d):
    w = Window.partitionBy("subject").orderBy(F.desc("valid_from"), F.desc("fact_id"))
    return recall.live(B.facts(spark, d)).filter("pinned").select("subject", "fact_id", F.row_number().over(w).alias("place"))


# -- evidence -------------------------------------------------------------------------------------


@query("citations", B.with_tables("facts", "evidence", then=f"WITH {_FE} SELECT fact_id, evidence_id, role, actor, locator FROM fe JOIN evidence ON id = evidence_id"))
def citations(spark, d):
    return records.citations(_links(spark, d), B.evidence(spark, d))


_STATES = """l AS (SELECT path, turn, CASE WHEN turn % 3 = 0 THEN content WHEN turn % 3 = 1 THEN content || '!' ELSE 'other' END AS line FROM evidence WHERE turn <> 5),
    st AS (SELECT id, CASE WHEN line IS NULL THEN 'broken' WHEN content = line THEN 'verified' WHEN contains(line, content) OR contains(content, line) THEN 'uncertain' ELSE 'broken' END AS state FROM evidence LEFT JOIN l USING (path, turn))"""


@query("degraded_evidence", B.with_tables("facts", "evidence", then=f"WITH {_FE}, {_STATES} SELECT fact_id, evidence_id, state FROM fe JOIN st ON id = evidence_id WHERE role = 'support' AND status IN {CONFIG.live} AND state <> 'verified'"))
def degraded_evidence(spark, d):
    e = B.evidence(spark, d)
    line = F.when(F.col("turn") % 3 == 0, F.col("content")).when(F.col("turn") % 3 == 1, F.concat("content", F.lit("!"))).otherwise("other")
    return records.degraded(_links(spark, d), provenance.verified(e, e.filter("turn <> 5").select("path", "turn", line.alias("line"))).select("id", "state"))


@query("overlay_report", B.with_tables("evidence", then=f"WITH {_EFF} SELECT actor, coalesce(effective_actor, 'unknown') AS effective_actor, count(*) AS n, CAST(count_if(actor IS DISTINCT FROM effective_actor) AS BIGINT) AS changed FROM ev GROUP BY ALL"))
def overlay_report(spark, d):
    rows = _effective(spark, d)
    return rows.groupBy("actor", F.coalesce("effective_actor", F.lit("unknown")).alias("effective_actor")).agg(F.count("*").alias("n"), F.count_if(~F.col("actor").eqNullSafe(F.col("effective_actor"))).alias("changed"))


_LETTERS = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


@query("block_corroboration", B.with_tables("evidence", then=f"""WITH b AS (SELECT id, path, actor, CASE WHEN turn % 2 = 0 THEN substr(content, 1, 5) ELSE content END AS body FROM evidence),
    n AS (SELECT id, path, actor, {_LETTERS.format("body")} AS n FROM b) SELECT n.id, length(n) >= 4 AND EXISTS (SELECT 1 FROM evidence e WHERE e.path = n.path AND e.actor = n.actor AND e.id <> n.id AND contains({_LETTERS.format("e.content")}, n)) AS corroborated FROM n"""))  # fmt: skip
def block_corroboration(spark, d):
    """Blocks that quote the beginning of a line, or all of it: is it said elsewhere in the session?"""
    e = B.evidence(spark, d)
    blocks = e.select("id", "path", "actor", F.when(F.col("turn") % 2 == 0, F.substring("content", 1, 5)).otherwise(F.col("content")).alias("body"))
    return records.corroborated(blocks, e).select("id", "corroborated")


_TAGGED = f"""{_SUP}, s AS (SELECT fact_id, sp.subject, content, fact_id % 13 = 0 AS note, CASE WHEN n_support > 0 AND sp.status <> 'confirmed' AND NOT sp.pinned AND NOT CASE WHEN sp.subject = '{GROUP}' THEN list_contains(actors, '{OWNER}') AND len(actors) > 1 ELSE list_contains(actors, sp.subject) END
    THEN array_to_string(actors, ', ') ELSE '' END AS echo FROM sp JOIN facts USING (fact_id))"""


@query("render_tags", B.with_tables("facts", "evidence", then=f"""WITH {_TAGGED} SELECT fact_id, CASE WHEN echo <> '' THEN '[second-hand: ' || echo || ']' ELSE '' END || CASE WHEN note THEN '[own note]' ELSE '' END || CASE WHEN subject = '{AIDE}' AND {hit('content', records.SAID)} THEN '[own words]' ELSE '' END AS tag FROM s"""))
def render_tags(spark, d):
    rows = provenance.support(_links(spark, d), _effective(spark, d)).join(B.facts(spark, d).select("fact_id", "status", "pinned", "content"), "fact_id")
    echo = F.when(provenance.echo_only(rows), F.col("actors")).otherwise(F.array().cast("array<string>"))
    return rows.select("fact_id", records.tags(echo, F.col("fact_id") % 13 == 0, records.spoken(F.col("subject"), F.col("content"))).alias("tag"))


# -- records --------------------------------------------------------------------------------------


@query("record_dumps", B.with_tables("facts", "stances", "evidence", then=f"""WITH {_FE}, l AS (SELECT fact_id, string_agg(evidence_id || ':' || role, ',' ORDER BY evidence_id) AS links FROM fe GROUP BY 1), s AS (SELECT fact_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS said FROM stances GROUP BY 1)
    SELECT fact_id, sha256(content) AS sha, coalesce(links, '') AS links, coalesce(said, '') AS said FROM facts LEFT JOIN l USING (fact_id) LEFT JOIN s USING (fact_id)"""))  # fmt: skip
def record_dumps(spark, d):
    of = records.dumped(B.facts(spark, d).select("fact_id", "content"), links=_links(spark, d).select("fact_id", "evidence_id", "role"), stances=B.stances(spark, d).select("fact_id", "id", "stance"))
    joined = lambda a, f: F.array_join(F.transform(a, f), ",")
    return of.select(
        "fact_id", F.sha2("record.fact.content", 256).alias("sha"),
        joined("record.links", lambda x: F.concat_ws(":", x["evidence_id"], x["role"])).alias("links"), joined("record.stances", lambda x: x["id"].cast("string")).alias("said"),
    )


@query("expired_batches", f"WITH {_BIN}, o AS (SELECT batch_id FROM ar GROUP BY 1 HAVING max(opened_at) + INTERVAL {CONFIG.bin_days} DAYS <= {NOW} AND batch_id % 7 <> 0) SELECT batch_id, fact_id FROM ar SEMI JOIN o USING (batch_id) ANTI JOIN rs USING (batch_id, fact_id)")
def expired_batches(spark, d):
    archive, back = _bin(spark, d)
    return records.expired(archive, back, archive.filter("batch_id % 7 = 0").select("batch_id").distinct(), B.now()).select("batch_id", "fact_id")


@query("telemetry_runs", B.with_tables("evidence", then="SELECT id AS run_id, substr(sha256(content), 1, 16) AS query_hash, CAST(ceil(length(content) / 1.6::DOUBLE) AS BIGINT) AS tokens, id % 4 AS returned FROM evidence WHERE actor = 'user'"))
def telemetry_runs(spark, d):
    e = B.evidence(spark, d).filter(F.col("actor") == OWNER)
    messages = e.select(F.col("id").alias("run_id"), F.col("content").alias("text"), F.lit("recall").alias("decision"), F.lit(1.0).alias("latency_ms"))
    hits = e.filter("id % 4 > 0").select(F.col("id").alias("run_id"), F.explode(F.sequence(F.lit(1), F.col("id").cast("int") % 4)).alias("rank")).select("run_id", F.col("rank").cast("long").alias("fact_id"), "rank", F.lit(0.5).alias("score"), F.lit("…").alias("snippet"))
    return records.telemetry(messages, hits)[0].select("run_id", "query_hash", F.col("tokens").cast("long").alias("tokens"), "returned")


@query("split_checks", B.with_tables("evidence", "statements", then=f"""WITH a AS (SELECT evidence_id, fact_id AS n, content AS atom, CASE WHEN fact_id % 50 = 7 THEN content || ' 777' ELSE content END AS c FROM statements),
    r AS (SELECT e.id, n, c, CASE WHEN length(trim(c)) NOT BETWEEN 4 AND 120 THEN 'atom-length' WHEN length(atom) < 4 OR NOT contains(e.content, atom) THEN 'quote-not-verbatim'
        WHEN len(list_filter(regexp_extract_all(c, '[0-9]+'), lambda x: NOT list_contains(regexp_extract_all(e.content, '[0-9]+'), x))) > 0 THEN 'invented-number'
        WHEN len({grams("c")}) = 0 THEN 'not-from-original' WHEN len(list_intersect({grams("c")}, {grams("e.content")}))::DOUBLE / len({grams("c")}) < 0.6 THEN 'not-from-original' WHEN trim(c) = trim(e.content) THEN 'duplicate-atom' END AS reason FROM evidence e JOIN a ON evidence_id = e.id),
    g AS (SELECT id, count(*) AS atoms, count(DISTINCT trim(c)) AS d, arg_min(reason, n) FILTER (reason IS NOT NULL) AS reason FROM r GROUP BY id)
    SELECT e.id AS fact_id, coalesce(atoms, 0) AS atoms, CASE WHEN coalesce(atoms, 0) < 2 THEN 'atomic' WHEN atoms > 6 THEN 'too-many-atoms' WHEN reason IS NOT NULL THEN reason WHEN d < atoms THEN 'duplicate-atom' ELSE 'split' END AS verdict FROM evidence e LEFT JOIN g ON g.id = e.id"""))  # fmt: skip
def split_checks(spark, d):
    """Turns as compound facts, their sentences as proposed atoms; every fiftieth has a number of its own."""
    atom = F.when(F.col("fact_id") % 50 == 7, F.concat("content", F.lit(" 777"))).otherwise(F.col("content"))
    atoms = B.statements(spark, d).select(F.col("evidence_id").alias("fact_id"), F.col("fact_id").alias("n"), atom.alias("content"), F.col("content").alias("quote"))
    return records.splits(B.evidence(spark, d).select(F.col("id").alias("fact_id"), "content"), atoms)


_SLOTS = " + ".join(f"CAST({hit('content', p)} AS INTEGER)" for _, p in text.SLOTS)
_VERDICT = "fact_id % 3 = 0"


@query("unified_decisions", B.with_tables("facts", then=f"""WITH r AS (SELECT fact_id, subject, content, pinned, fact_id % 4 AS ne, fact_id % 4 // 2 AS nv, fact_id % 9 = 0 AS dup, {_SLOTS} AS slots, CASE WHEN {_VERDICT} THEN fact_id % 5 <> 0 END AS mp, CASE WHEN fact_id % 2 = 0 THEN subject ELSE '{GROUP}' END AS ms FROM facts),
    w AS (SELECT *, CASE WHEN pinned THEN 'pinned' WHEN NOT regexp_matches(content, '[\\p{{L}}\\p{{N}}]') THEN 'no-text' WHEN ne = 0 THEN 'no-evidence' WHEN nv = 0 THEN 'not-verified' WHEN dup THEN 'duplicate'
        WHEN mp IS NOT NULL AND NOT (ms = '{GROUP}' AND ne < 2) THEN CASE WHEN mp THEN 'model-yes' ELSE 'model-no' END WHEN slots > 0 THEN 'rule-yes' ELSE 'rule-no' END AS why FROM r)
    SELECT fact_id, why IN ('pinned', 'model-yes', 'rule-yes') AS promote, why, round(least(0.95::DOUBLE, 0.3::DOUBLE + 0.12::DOUBLE * CASE WHEN why = 'model-yes' THEN 2 ELSE slots END + CASE WHEN length(content) >= 30 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 2) AS importance,
    round(CASE WHEN why = 'model-yes' THEN 0.5::DOUBLE * least(1.0::DOUBLE, 0.6::DOUBLE + 0.1::DOUBLE * nv) + 0.5::DOUBLE * 0.75::DOUBLE ELSE least(1.0::DOUBLE, 0.6::DOUBLE + 0.1::DOUBLE * nv) END, 2) AS confidence FROM w"""))  # fmt: skip
def unified_decisions(spark, d):
    i = F.col("fact_id")
    slots = sum((F.col("content").rlike(p).cast("int") for _, p in text.SLOTS), F.lit(0))
    rows = B.facts(spark, d).select("fact_id", "subject", "content", "pinned", (i % 4).alias("n_evidence"), F.expr("fact_id % 4 div 2").alias("n_verified"), (i % 9 == 0).alias("duplicate"), slots.alias("slots"))

    def judge(df):
        """A plug-in that judges every third fact."""
        verdict = {"model_promote": F.when(i % 3 == 0, i % 5 != 0), "model_subject": F.when(i % 2 == 0, F.col("subject")).otherwise(GROUP), "model_quote": F.substring("content", 1, 5), "model_confidence": F.lit(0.75), "model_slots": F.lit(2)}
        return df.withColumns(verdict)

    return records.decided(records.with_model(rows, judge)).select("fact_id", "promote", "why", "importance", "confidence")


# -- sessions -------------------------------------------------------------------------------------

HEADER = r"^(the|to|die|la|le)([^\p{L}]|$)"


@query("background_sessions", B.with_tables("evidence", then=f"WITH f AS (SELECT path, arg_min(content, turn) FILTER (actor = '{OWNER}' AND trim(content) <> '') AS first FROM evidence GROUP BY path) SELECT path, coalesce({hit('lower(ltrim(first))', HEADER)}, false) AS background FROM f"))
def background_sessions(spark, d):
    turns = B.evidence(spark, d).select("path", F.col("turn").alias("line"), "actor", F.lower("content").alias("content"))
    return records.background(turns, HEADER)


@query("evidence_window", B.with_tables("evidence", then=f"SELECT id, actor FROM evidence WHERE occurred_at >= TIMESTAMP '2024-01-10' AND occurred_at < TIMESTAMP '2024-02-20' AND actor IN {names((OWNER, AIDE))}"))
def evidence_window(spark, d):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return records.evidence_window(B.evidence(spark, d), at("2024-01-10 00:00:00"), at("2024-02-20 00:00:00"), [OWNER, AIDE]).select("id", "actor")


@query("previous_sessions", B.with_tables("evidence", then="""WITH s AS (SELECT path, min(occurred_at) AS a, max(occurred_at) AS b, count(*) AS n FROM evidence GROUP BY path)
    SELECT x.path, arg_max(y.path, (y.b, y.path)) AS previous FROM s x LEFT JOIN s y ON y.b < x.a AND y.b >= x.a - INTERVAL 24 HOURS AND y.n >= 3 AND y.path <> x.path GROUP BY x.path"""))  # fmt: skip
def previous_sessions(spark, d):
    return records.previous_sessions(B.evidence(spark, d).groupBy("path").agg(F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last"), F.count("*").alias("turns")))


@query("side_stream", f"""WITH e AS (SELECT user_id AS stream, event_id AS id, ts, props AS said FROM events WHERE epoch_us(ts) <= epoch_us({NOW}) + 10000000 AND trim(props) <> '')
    SELECT stream, id, CASE WHEN length(said) > 8 THEN substr(said, 1, 8) || '…' ELSE said END AS said, CAST(row_number() OVER (PARTITION BY stream ORDER BY ts DESC, id DESC) AS INTEGER) AS back FROM e QUALIFY back <= 3""")  # fmt: skip
def side_stream(spark, d):
    messages = B.table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("id"), "ts", F.col("props").alias("said"))
    return records.side_stream(messages, B.now(), 3, clip=8).select("stream", "id", "said", "back")


@query("split_sides", """WITH s AS (SELECT user_id, min(ts) AS began, max(ts) AS ended FROM events WHERE event_type = 'click' GROUP BY user_id)
    SELECT user_id, CASE WHEN ts < began THEN 'before' WHEN ts <= ended THEN 'during' ELSE 'after' END AS side, count(*) AS n FROM events JOIN s USING (user_id) WHERE event_type = 'view' GROUP BY ALL""")  # fmt: skip
def split_sides(spark, d):
    e = B.table(spark, d, "events")
    of = e.filter("event_type = 'click'").groupBy("user_id").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"))
    return records.sides_of(e.filter("event_type = 'view'").join(of, "user_id")).groupBy("user_id", "side").agg(F.count("*").alias("n"))


_CURSOR = "cu AS (SELECT user_id AS session, (user_id * 37) % (SELECT max(event_id) FROM events) AS last_id, CAST(user_id % 4 AS INTEGER) AS fails, min(ts) AS failed_at FROM events GROUP BY user_id HAVING user_id % 3 = 0)"
_WAIT = "CASE coalesce(fails, 0) WHEN 0 THEN 0 " + " ".join(f"WHEN {k + 1} THEN {m}" for k, m in enumerate(CONFIG.backoff_minutes)) + " END"


@query("due_rows", f"""WITH {_CURSOR}, p AS (SELECT user_id AS session, event_id AS id, ts, last_id, fails, failed_at FROM events LEFT JOIN cu ON session = user_id WHERE last_id IS NULL OR event_id > last_id),
    s AS (SELECT session, count(*) AS n, min(ts) AS a, max(ts) AS b FROM p GROUP BY session),
    st AS (SELECT session, CASE WHEN (epoch_us({NOW}) - epoch_us(b)) / 60000000.0 >= {CONFIG.idle_minutes} THEN 'idle' WHEN (epoch_us({NOW}) - epoch_us(b)) / 60000000.0 < {CONFIG.settle_minutes} THEN 'settling' WHEN n >= {CONFIG.cap_messages} OR (epoch_us({NOW}) - epoch_us(a)) / 60000000.0 >= {CONFIG.cap_hours * 60} THEN 'capped' ELSE 'waiting' END AS state FROM s)
    SELECT session, id, state FROM p JOIN st USING (session) WHERE state IN ('idle', 'capped') AND (state = 'idle' OR epoch_us(ts) <= epoch_us({NOW}) - {CONFIG.settle_minutes * 60_000_000})
    AND epoch_us(coalesce(failed_at, TIMESTAMP '1970-01-01')) + {_WAIT} * 60000000::BIGINT <= epoch_us({NOW})""")  # fmt: skip
def due_rows(spark, d):
    e = B.table(spark, d, "events")
    top = e.agg(F.max("event_id")).first()[0]
    cursor = e.groupBy(F.col("user_id").alias("session")).agg(F.min("ts").cast("timestamp").alias("failed_at")).filter("session % 3 = 0")
    cursor = cursor.select("session", (F.col("session") * 37 % top).alias("last_id"), (F.col("session") % 4).cast("int").alias("fails"), "failed_at")
    pending = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), "ts")
    return ingest.take_due(pending, cursor, B.now()).select("session", "id", "state")


# -- reports --------------------------------------------------------------------------------------


@query("scored_by_type", "SELECT l_returnflag AS kind, CAST(count_if(l_linestatus = 'F') AS BIGINT) AS correct, count(*) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def scored_by_type(spark, d):
    return records.scored_by_type(B.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), (F.col("l_linestatus") == "F").alias("correct")))


@query("members_by_day", B.with_tables("live", then="SELECT subject, fact_id, CAST(row_number() OVER (PARTITION BY subject ORDER BY CAST(valid_from AS DATE), fact_id) AS INTEGER) AS place FROM live"))
def members_by_day(spark, d):
    w = Window.partitionBy("subject").orderBy(F.to_date("valid_from"), "fact_id")
    return recall.live(B.facts(spark, d)).select("subject", "fact_id", F.row_number().over(w).alias("place"))


@query("sampled_facts", B.with_tables("live", then="SELECT fact_id FROM live ORDER BY sha256('audit:' || fact_id), fact_id LIMIT 25"))
def sampled_facts(spark, d):
    return records.sampled(recall.live(B.facts(spark, d)), 25, "audit", "fact_id").select("fact_id")


# -- names ----------------------------------------------------------------------------------------

ALIASES = {"thean": "thean", "waser": "thean", "outhe": "outhe", "ertion": "ertion", "nding": "nding"}
PARENTS = {"nding": "ertion"}
FOREIGN = ["shth"]
_FOUND = " UNION ".join(f"SELECT fact_id, trim(unnest(regexp_extract_all(content, {q(p)}, 1))) AS term, {k} AS p, '{kind}' AS kind FROM live" for k, (kind, p) in enumerate(entities.FOUND, 2))
_GENERIC = f"(kind <> 'config' AND (lower(term) IN {names(entities.GENERIC)} OR (kind IN ('named', 'quoted') AND length(term) <= 2)))"


@query("entity_discovery", B.with_tables("live", then=f"""WITH f AS ({_FOUND}), k AS (SELECT term, arg_min(kind, p) AS kind, count(DISTINCT fact_id) AS facts FROM f WHERE length(term) >= 2 GROUP BY term)
    SELECT term, kind, facts, kind IN ('title', 'named', 'ident') AND NOT {_GENERIC} AS direct FROM k"""))
def entity_discovery(spark, d):
    return entities.discovered(recall.live(B.facts(spark, d)))


def _in(c: str) -> str:
    return "list_distinct(list_transform(list_filter([" + ", ".join(f"{{'a': '{a}', 'n': '{n}'}}" for a, n in ALIASES.items()) + f"], lambda g: contains(lower(coalesce({c}, '')), g.a)), lambda g: g.n))"


_UP = "CASE n " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PARENTS.items()) + " END"


@query("entity_verdicts", B.with_tables("evidence", then=f"""WITH l AS (SELECT id, content, lag(content) OVER w AS source, lag(content, 2) OVER w AS context FROM evidence WINDOW w AS (PARTITION BY path ORDER BY turn)),
    m AS (SELECT id, unnest({_in("content")}) AS n, {_in("source")} AS s, {_in("context")} AS x, {_in("regexp_replace(content, '[(][^()]{1,20}[)]', ' ', 'g')")} AS b, contains(concat_ws(chr(10), source, context), '{FOREIGN[0]}') AS f FROM l),
    v AS (SELECT id, CASE WHEN list_contains(s, n) THEN 'ok' WHEN list_contains(s, {_UP}) THEN CASE WHEN f THEN 'review' ELSE 'ok' END
        WHEN list_contains(x, n) THEN CASE WHEN len(list_filter(s, lambda y: y <> n)) > 0 OR ({_UP} IS NOT NULL AND f) THEN 'review' ELSE 'ok' END WHEN list_contains(x, {_UP}) THEN 'review'
        WHEN NOT list_contains(b, n) THEN 'strip' WHEN len(list_filter(s, lambda y: y <> n)) > 0 THEN 'reject' ELSE 'review' END AS v FROM m),
    g AS (SELECT id, CASE WHEN bool_or(v = 'reject') THEN 'reject' WHEN bool_or(v = 'review') THEN 'review' WHEN bool_or(v = 'strip') THEN 'strip' ELSE 'ok' END AS verdict FROM v GROUP BY id)
    SELECT l.id, coalesce(verdict, 'ok') AS verdict FROM l LEFT JOIN g USING (id)"""))  # fmt: skip
def entity_verdicts(spark, d):
    w = Window.partitionBy("path").orderBy("turn")
    rows = B.evidence(spark, d).select("id", "content", F.lag("content").over(w).alias("source"), F.lag("content", 2).over(w).alias("context"))
    return entities.attribution(rows, ALIASES, PARENTS, FOREIGN).select("id", "verdict")


# -- snippets and notes ---------------------------------------------------------------------------


@query("best_windows")
def best_windows(spark, d):
    words = F.array(*map(F.lit, ("thean", "waser", "outhe")))
    return active(spark, d).select("fact_id", records.best_window(F.col("content"), words).alias("window"))


@query("chunk_sizes")
def chunk_sizes(spark, d):
    """The chunks of sessions with their sizes."""
    chunks = timeline.greedy_chunks(B.evidence(spark, d))
    return chunks.join(B.evidence(spark, d).select("id", F.length("content").alias("n")), "id").groupBy("path", "chunk").agg(F.sum("n").alias("chars"), F.count("*").alias("lines"))


@query("redaction_masks")
def redaction_masks(spark, d):
    """How many secrets of each kind are masked in the documents."""
    masked = B.facts(spark, d).select("fact_id", redaction.redacted(F.col("content")).alias("clean"))
    return masked.select("fact_id", F.explode(redaction.masks(F.col("clean"))).alias("m")).select("fact_id", "m.kind", "m.n")


@query("handoff_notes")
def handoff_notes(spark, d):
    """What a new session is given of each session's note, which lists its first lines as summary and its last ones as pending."""
    w = Window.partitionBy("path").orderBy("turn")
    line = F.concat(F.lit("- "), F.regexp_replace("content", r"\s+", " "))
    rows = B.evidence(spark, d).withColumns({"n": F.row_number().over(w), "line": line})
    lines = lambda low, high: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n").between(low, high), F.struct("n", "line")))), lambda x: x["line"]), "\n")
    notes = rows.groupBy("path").agg(F.concat(F.lit("## Summary\n"), lines(1, 3), F.lit("\n## Pending\n"), lines(4, 6), F.lit("\n## State\n"), lines(7, 8)).alias("note"), F.max("occurred_at").alias("last"))
    return notes.select("path", records.injected(F.col("note"), F.col("last"), B.now()).alias("injected"))


# -- working set and bin --------------------------------------------------------------------------


@query("working_set_put", "SELECT user_id AS session, event_type AS kind, props AS content, min(event_id) AS id, max(value) AS confidence, max(ts) AS updated_at FROM events GROUP BY ALL")
def working_set_put(spark, d):
    rows = B.table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("kind"), F.col("props").alias("content"), F.col("event_id").alias("id"), F.col("value").alias("confidence"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    return lifecycle.put(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")).drop("created_at")


@query("working_set_close", "SELECT event_id AS id, CASE WHEN event_type <> 'error' AND event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'dropped' END WHEN event_type = 'error' THEN 'evicted' ELSE 'open' END AS status FROM events")
def working_set_close(spark, d):
    e = B.table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "evicted").otherwise("open").alias("status"))
    done = e.filter("event_id % 3 = 0").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "done").otherwise("dropped").alias("to"))
    return lifecycle.closed(rows, done, B.now()).select("id", "status")


def _state(spark, d):
    return B.facts(spark, d).select("fact_id", F.lit(1).alias("version"), "status", "layer", F.col("pinned").alias("user_pinned"))


def _deleted(spark, d):
    picks = B.facts(spark, d).filter("fact_id % 3 = 0").select("fact_id", (F.col("fact_id") % 7).alias("batch_id"), F.lit("noise").alias("category"))
    return lifecycle.deleted(_state(spark, d), picks, B.now())


@query("bin_deletes", B.with_tables("facts", then=f"SELECT fact_id, 2 AS version, CASE WHEN status IN {CONFIG.live} THEN 'invalid' ELSE status END AS status, 'cold' AS layer FROM facts WHERE fact_id % 3 = 0 AND NOT pinned"))
def bin_deletes(spark, d):
    return _deleted(spark, d)[1].drop("user_pinned")


@query("bin_restores", B.with_tables("facts", then="SELECT fact_id, 3 AS version, status, layer FROM facts WHERE fact_id % 3 = 0 AND NOT pinned AND fact_id % 7 = 2"))
def bin_restores(spark, d):
    archive, state = _deleted(spark, d)
    return lifecycle.restored(state, archive, F.lit(2), B.now())[1].drop("user_pinned")


# -- other sources and replays --------------------------------------------------------------------


@query("mailbox_rows", f"SELECT 'id' || event_id AS locator, CASE event_type WHEN 'view' THEN '{OWNER}' ELSE '{AIDE}' END AS actor, props AS content FROM events WHERE ts < {NOW} - INTERVAL 2 DAYS AND event_id % 11 <> 0 AND length(trim(props)) >= 2 AND NOT regexp_matches(props, '\"k\": 1[}}]') AND event_type IN ('view', 'click') AND event_id % 10 <> 0")
def mailbox_rows(spark, d):
    e = B.table(spark, d, "events")
    messages = e.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("sender"), F.col("props").alias("text"), (F.col("event_id") % 11 == 0).alias("imported"))
    done = e.filter("event_id % 10 = 0").select(F.concat(F.lit("id"), "event_id").alias("locator"))
    return records.mailbox(messages, done, F.expr(f"TIMESTAMP_NTZ '{CONFIG.now}' - INTERVAL 2 DAYS"), {"view": OWNER, "click": AIDE}, '"k": 1}').drop("occurred_at")


_CLASS = f"CASE WHEN NOT {hit('content', records.OWN_FAULT)} AND NOT slot AND (length(content) < 25 OR (length(content) <= 120 AND {hit('content', records.ASKS)})) THEN NULL WHEN {hit('content', records.SUGGESTS)} THEN 'suggestion' WHEN length(content) >= 150 AND {hit('content', records.TECHNICAL)} THEN 'technical' ELSE 'other' END"


@query("own_speech_classes", B.with_tables("statements", then=f"WITH s AS (SELECT fact_id, content, {hit('content', '[0-9]{2,}')} AS slot FROM statements WHERE subject = '{AIDE}') SELECT fact_id, {_CLASS} AS pool FROM s"))
def own_speech_classes(spark, d):
    rows = B.statements(spark, d).filter(F.col("subject") == AIDE)
    return rows.select("fact_id", records.own_speech_class(F.col("content"), F.col("content").rlike("[0-9]{2,}")).alias("pool"))


def _share(c: str) -> str:
    return f"(len(g) < 4 OR len(list_intersect(g, {grams(c)}))::DOUBLE / len(g) >= 0.3)"


@query("gate_replay", B.with_tables("evidence", "statements", then=f"""WITH c AS (SELECT id, coalesce(lag(content) OVER w, '') AS one, coalesce(string_agg(content, ' ') OVER (PARTITION BY path ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS three FROM evidence WINDOW w AS (PARTITION BY path ORDER BY turn)),
    s AS (SELECT subject, one, three, {grams("content")} AS g FROM statements JOIN c ON c.id = evidence_id) SELECT subject, {_share("one")} AS by_line, {_share("three")} AS by_window, count(*) AS n FROM s GROUP BY ALL"""))  # fmt: skip
def gate_replay(spark, d):
    """What is grounded in the line before, and what in the three lines before: how many facts a wider window would let in."""
    w = Window.partitionBy("path").orderBy("turn")
    lines = B.evidence(spark, d).select(F.col("id").alias("evidence_id"), F.coalesce(F.lag("content").over(w), F.lit("")).alias("one"), F.array_join(F.collect_list("content").over(w.rowsBetween(-3, -1)), " ").alias("three"))
    lines = lines.select("evidence_id", text.bigrams(F.col("one")).alias("one"), text.bigrams(F.col("three")).alias("three"))  # once for a line, not for each of its sentences
    rows = B.statements(spark, d).join(lines, "evidence_id")
    by = lambda c: value_gate.grounded(F.col("content"), None, said=F.col(c))
    return rows.groupBy("subject", by("one").alias("by_line"), by("three").alias("by_window")).agg(F.count("*").alias("n"))
