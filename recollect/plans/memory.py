"""Queries for owners, the value gate, inputs, entities and evidence reports, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.config import CONFIG
from recollect.functions import text
from recollect.operators import inputs, ownership, provenance, recall, value_gate
from recollect.plans.dialogue import ENTITIES
from recollect.plans.queries import _GRAMS, _SUP, ACTIVE, WORDS, _effective, _links, _values, active, query, terms
from recollect.sources import bindings as B

OWNER, AIDE, GROUP = CONFIG.owner, CONFIG.assistants[0], CONFIG.group


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def hit(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def without(column: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({column}, {q(pattern)}, '{by}', 'g')"


def case(rules, column: str, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {hit(column, r[1])} THEN '{r[0]}'" for r in rules) + f" ELSE {otherwise} END"


def names(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def grams(expr: str) -> str:
    """The distinct bigrams of an expression."""
    return f"(SELECT CASE WHEN length(s) >= 2 THEN {_GRAMS} WHEN length(s) = 1 THEN [s] ELSE [] END FROM (SELECT regexp_replace(lower({expr}), '\\s+', '', 'g') AS s))"


# -- whose matter ---------------------------------------------------------------------------------

_CORE = without("lower(content)", ownership.FRAME)
_ASKED = f"CASE WHEN {hit('core', ownership.OWNER_ASKED)} AND NOT {hit('core', ownership.ASSISTANT_ASKED)} THEN '{OWNER}' WHEN {hit('core', ownership.ASSISTANT_ASKED)} AND NOT {hit('core', ownership.OWNER_ASKED)} THEN '{AIDE}' END"
_NAMED = "list_filter([" + ", ".join([f"CASE WHEN {hit('core', ownership.OWNER_ASKED)} THEN '{OWNER}' END", f"CASE WHEN {hit('core', ownership.ASSISTANT_ASKED)} THEN '{AIDE}' END", *(f"CASE WHEN contains(core, '{x}') THEN '{x}' END" for x in CONFIG.assistants[1:])]) + "], lambda x: x IS NOT NULL)"


@query("asked_subjects", B.with_tables("evidence", then=f"WITH c AS (SELECT id, {_CORE} AS core FROM evidence) SELECT id, {_ASKED} AS asked, CASE WHEN len({_NAMED}) = 1 THEN {_NAMED}[1] END AS who FROM c"))
def asked_subjects(spark, d):
    c = F.col("content")
    return B.evidence(spark, d).select("id", ownership.asked_subject(c).alias("asked"), ownership.inferred_who(c).alias("who"))


_BODY = f"regexp_replace({without('content', ownership.STAMP)}, {q(ownership.SPEAKER)}, '')"


def _belongs(want: str) -> str:
    """SQL over subject, content, actors and words (the lower-case body)."""
    mine = f"CASE WHEN {want} = '{OWNER}' THEN {hit('words[1:24]', ownership.OWNER_NAMED)} ELSE {hit('words[1:24]', ownership.ASSISTANT_NAMED)} END"
    return f"""CASE WHEN subject = '{GROUP}' THEN true WHEN {hit('content', ownership.PREFIXED)} AND {hit('words[1:24]', ownership.OWNER_NAMED)} <> {hit('words[1:24]', ownership.ASSISTANT_NAMED)} THEN {mine}
        WHEN subject <> {want} THEN false WHEN starts_with(ltrim(words), '{AIDE}') AND {want} <> '{AIDE}' THEN false WHEN starts_with(ltrim(words), '{OWNER}') AND {want} <> '{OWNER}' THEN false
        WHEN subject = {want} AND len(actors) > 0 AND NOT list_contains(actors, {want}) THEN false ELSE true END"""


def _supported(spark, d):
    facts = B.facts(spark, d)
    return facts.join(provenance.support(_links(spark, d), _effective(spark, d)).select("fact_id", "actors"), "fact_id")


@query("belongs_to_asked", B.with_tables("facts", "evidence", then=f"WITH {_SUP}, w AS (SELECT f.fact_id, f.subject, content, actors, lower({_BODY}) AS words FROM facts f JOIN sp USING (fact_id)) SELECT fact_id, {_belongs(q(OWNER))} AS owners, {_belongs(q(AIDE))} AS assistants FROM w"))
def belongs_to_asked(spark, d):
    of = lambda want: ownership.belongs_to(F.col("subject"), F.col("content"), F.col("actors"), F.lit(want))
    return _supported(spark, d).select("fact_id", of(OWNER).alias("owners"), of(AIDE).alias("assistants"))


_RANKED = f"""{ACTIVE}, t(query_id, term_rank, term) AS {_values(WORDS)}, h AS (SELECT query_id, fact_id, any_value(act) AS act FROM act JOIN t ON list_contains(regexp_extract_all(lower(content), '[a-z0-9]+'), term) GROUP BY ALL),
    k AS (SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY act DESC, fact_id) AS rank, CASE query_id WHEN 'q1' THEN '{OWNER}' END AS want FROM h)"""


def _hits(spark, d):
    """Ranked hits of two questions; the first asks about the owner, the second about nobody in particular."""
    facts = active(spark, d)
    met = facts.join(recall.word_matches(facts, terms(spark, WORDS)).select("query_id", "fact_id").distinct(), "fact_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("act"), "fact_id")
    ranked = met.withColumns({"rank": F.row_number().over(w), "want": F.when(F.col("query_id") == "q1", OWNER)})
    return ranked.select("query_id", "fact_id", "rank", "want", "subject", "content").join(_supported(spark, d).select("fact_id", "actors"), "fact_id")


@query("prefer_subject", B.with_tables("live", "evidence", then=f"""WITH {_RANKED}, {_SUP}, w AS (SELECT k.*, f.subject, content, actors, lower({_BODY}) AS words FROM k JOIN facts f USING (fact_id) JOIN sp USING (fact_id)), m AS (SELECT *, want IS NULL OR {_belongs("want")} AS mine FROM w)
    SELECT query_id, fact_id, mine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY mine DESC, rank) AS INTEGER) AS place FROM m"""))  # fmt: skip
def prefer_subject(spark, d):
    return ownership.preferred(_hits(spark, d)).select("query_id", "fact_id", "mine", "place")


TOPIC, DONE, NOT_YET = "thean", r"\bis\b|\bwas\b", r"\bnot\b|\bfor\b"


def _near(pattern: str) -> str:
    return hit("content", rf"(?is)(?:{pattern}).{{0,14}}{TOPIC}|{TOPIC}.{{0,14}}(?:{pattern})")


@query("state_conflicts", B.with_tables("live", then=f"SELECT subject, CAST(count_if({_near(DONE)}) AS BIGINT) AS done, CAST(count_if({_near(NOT_YET)}) AS BIGINT) AS not_yet FROM live WHERE contains(lower(content), '{TOPIC}') GROUP BY subject HAVING done > 0 AND not_yet > 0"))
def state_conflicts(spark, d):
    says = lambda p: F.count_if(ownership.says_near(F.col("content"), TOPIC, p))
    rows = recall.live(B.facts(spark, d)).filter(F.contains(F.lower("content"), F.lit(TOPIC)))
    return rows.groupBy("subject").agg(says(DONE).alias("done"), says(NOT_YET).alias("not_yet")).filter("done > 0 AND not_yet > 0")


# -- the value gate -------------------------------------------------------------------------------

_LOW = "lower(content)"
_KIND = f"""CASE WHEN subject = '{GROUP}' THEN '{value_gate.SHARED_KIND}' WHEN subject = '{AIDE}' THEN {case(value_gate.AIDE_WORDS, _LOW, "'other'")}
    WHEN subject = '{OWNER}' THEN coalesce({case(value_gate.OWN_WORDS, _LOW)}, CASE WHEN {hit(_LOW, value_gate.BIG)} THEN 'life_change' END) END"""
_CANDIDATES = f"c AS (SELECT fact_id, evidence_id, path, subject, content, {_KIND} AS kind FROM statements)"


def _candidates(spark, d):
    return B.statements(spark, d).withColumn("kind", value_gate.category(F.col("subject"), F.col("content")))


@query("inferred_kinds", B.with_tables("statements", then=f"WITH {_CANDIDATES} SELECT subject, coalesce(kind, 'none') AS kind, count(*) AS n FROM c GROUP BY ALL"))
def inferred_kinds(spark, d):
    return _candidates(spark, d).groupBy("subject", F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


_OWN = names(value_gate.OWN_KINDS)
_AIDES = names(value_gate.AIDE_KINDS)
_KNOWN = names((OWNER, *CONFIG.assistants))
_ROLE = f"""CASE WHEN kind = 'agreement' AND subject <> '{GROUP}' THEN 'agreement-not-group'
    WHEN subject = '{GROUP}' THEN CASE WHEN NOT (list_contains(actors, '{OWNER}') AND len(actors) >= 2) THEN 'one-sided' WHEN NOT confirmed THEN 'not-confirmed' WHEN kind <> 'agreement' THEN 'group-kind'
        WHEN kind = 'agreement' AND NOT list_contains(actors, '{AIDE}') THEN 'agreement-needs-assistant' END
    WHEN len(actors) > 0 AND subject IN {_KNOWN} AND NOT list_contains(actors, subject) THEN CASE WHEN actors = ['{AIDE}'] THEN 'assistant-only-subject' ELSE 'speaker-is-not-subject' END
    WHEN actors = ['{AIDE}'] AND kind NOT IN {_AIDES} THEN 'assistant-only-kind' WHEN kind IN {_OWN} AND NOT list_contains(actors, '{OWNER}') THEN 'owner-kind-without-owner'
    WHEN len(actors) > 0 AND subject IN {_KNOWN} AND NOT CASE WHEN subject = '{OWNER}' THEN kind IN {_OWN} ELSE kind IN {_AIDES} END THEN 'kind-not-allowed' END"""


@query("role_gate", B.with_tables("facts", "evidence", then=f"""WITH {_SUP}, c AS (SELECT f.fact_id, f.subject, content, actors, f.fact_id % 2 = 0 AS confirmed, {_KIND.replace("subject", "f.subject")} AS kind FROM facts f JOIN sp USING (fact_id))
    SELECT subject, coalesce({_ROLE}, 'ok') AS reason, count(*) AS n FROM c GROUP BY ALL"""))  # fmt: skip
def role_gate(spark, d):
    rows = _supported(spark, d).withColumn("kind", value_gate.category(F.col("subject"), F.col("content")))
    reason = value_gate.role_check(F.col("subject"), F.col("kind"), F.col("actors"), F.col("fact_id") % 2 == 0)
    return rows.groupBy("subject", F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


_NORMAL = lambda c: f"regexp_replace(lower(translate({c}, '{value_gate._WIDE}', '{value_gate._NARROW.replace(chr(39), chr(39) * 2)}')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_PLAIN = f"regexp_replace(regexp_replace(content, {q(value_gate.STAMPED)}, ''), {q(value_gate.DATED)}, '')"
_LETTERS = lambda c: f"list_distinct(list_filter(string_split(regexp_replace(lower({c}), '[^\\p{{L}}]+', '', 'g'), ''), lambda x: x <> ''))"
_WINS = f"((subject IN {names(CONFIG.assistants)} OR coalesce(kind IN {_AIDES}, false)) AND {hit(_LOW, value_gate.PROMISE)}) OR (subject = '{OWNER}' AND NOT {hit('content', value_gate.STAMPED)} AND {hit(_LOW, value_gate.LASTING)})"
_REPORTED = f"({hit(_LOW, value_gate.REPORTED)} AND NOT {hit(_LOW, value_gate.TO_THEM)})"
_POST = (
    f"CASE WHEN length(quote) < 4 THEN 'no-quote' WHEN NOT ({_NORMAL('quote')} <> '' AND contains({_NORMAL('source')}, {_NORMAL('quote')})) THEN 'quote-not-said' WHEN trim(content) = '' THEN 'empty' WHEN trim(subject) = '' THEN 'vague-subject'"
    f" WHEN subject <> '{AIDE}' AND NOT {hit('content', value_gate.STAMPED)} AND {hit(f'lower({_PLAIN})', value_gate.PRONOUN)} THEN 'pronoun-subject' "
    + " ".join(f"WHEN {hit(_LOW, p)}{f' AND NOT ({_WINS})' if soft else ''} THEN '{n}'" for n, p, soft in value_gate.REFUSED)
    + f" WHEN {hit(_LOW, value_gate.RIVAL)} AND {hit(_LOW, value_gate.VERDICT)} THEN 'verdict-on-others' WHEN subject <> '{AIDE}' AND {_REPORTED} THEN 'retelling'"
    " WHEN NOT (len(g) < 4 OR len(list_intersect(g, sg))::DOUBLE / len(g) >= 0.3) AND CASE WHEN len(la) < 4 THEN 1.0 ELSE len(list_intersect(la, lb))::DOUBLE / len(la) END < 0.4 THEN 'ungrounded' END"
)


@query("postcheck_reasons", B.with_tables("statements", then=f"""WITH {_CANDIDATES}, b AS (SELECT path, id, lag(content) OVER (PARTITION BY path ORDER BY turn) AS before FROM evidence),
    s AS (SELECT c.*, CASE WHEN fact_id % 4 = 0 THEN coalesce(before, '') ELSE e.content END AS source, c.content[1:60] AS quote FROM c JOIN evidence e ON e.id = evidence_id JOIN b ON b.id = evidence_id),
    g AS (SELECT *, {grams(_PLAIN)} AS g, {grams("source")} AS sg, {_LETTERS(_PLAIN)} AS la, {_LETTERS("source")} AS lb FROM s)
    SELECT subject, coalesce({_POST}, 'kept') AS reason, count(*) AS n FROM g GROUP BY ALL"""))  # fmt: skip
def postcheck_reasons(spark, d):
    """Candidates with the line they are said to come from: their own, or for every fourth the line before, which mostly doesn't hold them."""
    w = Window.partitionBy("path").orderBy("turn")
    lines = B.evidence(spark, d).select(F.col("id").alias("evidence_id"), F.col("content").alias("line"), F.coalesce(F.lag("content").over(w), F.lit("")).alias("before"))
    lines = lines.withColumns({f"{c}_grams": text.bigrams(F.col(c)) for c in ("line", "before")})  # once for a line, not for each of its sentences
    of = lambda end: F.when(F.col("fact_id") % 4 == 0, F.col(f"before{end}")).otherwise(F.col(f"line{end}"))
    rows = _candidates(spark, d).join(lines, "evidence_id").withColumns({"source": of(""), "said": of("_grams")})
    reason = value_gate.postcheck(F.col("subject"), F.col("kind"), F.col("content"), F.substring("content", 1, 60), F.col("source"), F.col("said"))
    return rows.groupBy("subject", F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_REQUEST = f"CASE WHEN {hit('a', value_gate.JOKE)} THEN 'joke' WHEN {hit('a', value_gate.QUESTION)} AND NOT {hit('a', value_gate.STRONG_ASK)} THEN 'question' WHEN {hit('a', value_gate.STRONG_ASK)} OR {hit('a', value_gate.WEAK_ASK)} THEN NULL ELSE 'no-request' END"
_ACCEPTED = f"CASE WHEN b = '' THEN 'thoughts' WHEN {hit('b', value_gate.HEDGE)} AND NOT {hit('b', value_gate.FIRM)} THEN 'hedged' WHEN {hit('b', value_gate.ACCEPT)} THEN NULL ELSE 'no-accept' END"
_FIRST = f"trim(lower(regexp_extract(content, {q(value_gate.CLAUSE)}, 1)))"


@query("requests_accepted", B.with_tables("evidence", then=f"""WITH l AS (SELECT id, lower(lag(content) OVER w) AS a, lag(actor) OVER w AS asker, actor, trim(lower(content)) AS b FROM evidence WINDOW w AS (PARTITION BY path ORDER BY turn))
    SELECT id, coalesce({_REQUEST}, {_ACCEPTED}, 'ok') AS reason FROM l WHERE asker = '{OWNER}' AND actor = '{AIDE}'"""))  # fmt: skip
def requests_accepted(spark, d):
    """What the owner asks for and the assistant's next line: why they don't make an agreement, or ok."""
    w = Window.partitionBy("path").orderBy("turn")
    rows = B.evidence(spark, d).withColumns({"line": F.lag("content").over(w), "asker": F.lag("actor").over(w)}).filter((F.col("asker") == OWNER) & (F.col("actor") == AIDE))
    return rows.select("id", F.coalesce(value_gate.request_reason(F.col("line")), value_gate.accept_reason(F.col("content")), F.lit("ok")).alias("reason"))


@query("consents", B.with_tables("evidence", then=f"SELECT id, {_FIRST} <> '' AND regexp_extract(content, {q(value_gate.CLAUSE)}, 2) <> '?' AND NOT {hit(_FIRST, value_gate.VETO)} AND {hit(_FIRST, value_gate.AGREE)} AS consents FROM evidence WHERE actor = '{OWNER}'"))
def consents(spark, d):
    return B.evidence(spark, d).filter(F.col("actor") == OWNER).select("id", value_gate.consents(F.col("content")).alias("consents"))


@query("gate_confidence", B.with_tables("statements", then=f"""WITH {_CANDIDATES} SELECT fact_id, CASE WHEN subject = '{GROUP}' OR subject IN {names(CONFIG.assistants)} THEN 0.6::DOUBLE WHEN subject = '{OWNER}' AND kind IN {_OWN} THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
    coalesce(CASE WHEN subject = '{OWNER}' THEN (kind IN ('decision', 'correction', 'preference') AND {hit(_LOW, value_gate.LASTING)}) OR (kind IN ('life_change', 'decision') AND {hit(_LOW, value_gate.BIG)})
        WHEN subject = '{AIDE}' THEN kind IN {_AIDES} AND {hit(_LOW, value_gate.PROMISE)} END, false) AS priority FROM c"""))  # fmt: skip
def gate_confidence(spark, d):
    s, k, c = F.col("subject"), F.col("kind"), F.col("content")
    return _candidates(spark, d).select("fact_id", value_gate.confidence(s, k, s).alias("confidence"), value_gate.priority(s, k, c, s).alias("priority"))


# -- what comes in --------------------------------------------------------------------------------

_WRAPPED = "html"
for _p in (*inputs.BLOCKS, inputs.LINES, inputs.PATHS):
    _WRAPPED = without(_WRAPPED, _p, " ")
_WRAPPED = f"trim({without(_WRAPPED, '[ ' + chr(92) + 't]+', ' ')})"


@query("clean_messages", f"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS clean, length({_WRAPPED}) AS unwrapped,
    CASE WHEN {hit('html', inputs.BLOCKS[0])} THEN 'system' WHEN length(html) > {inputs.LONGEST} AND NOT {hit('html', inputs.EXPLICIT)} THEN 'long-paste' END AS skipped FROM pages""")  # fmt: skip
def clean_messages(spark, d):
    h = F.col("html")
    return B.table(spark, d, "pages").select("page_id", F.sha2(inputs.clean_context(h), 256).alias("clean"), F.length(inputs.without_wrappers(h)).cast("long").alias("unwrapped"), inputs.skip_reason(h).alias("skipped"))


_MARKS = lambda c: f"list_filter(regexp_extract_all({c}, {q(inputs.MARK)}), lambda w: NOT list_contains({list(inputs.COMMON)}, lower(w)))"
_IN_ORDER = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"


@query("distinctive_marks", B.with_tables("evidence", then=f"WITH m AS (SELECT id, content, {_MARKS('content')} AS m FROM evidence) SELECT id, array_to_string({_IN_ORDER('m')}, ',') AS marks, {case([('recall', inputs.EXPLICIT), ('work', inputs.WORKING)], 'content', chr(39) * 2)} AS why FROM m"))
def distinctive_marks(spark, d):
    c = F.col("content")
    return B.evidence(spark, d).select("id", F.array_join(inputs.marks(c), ",").alias("marks"), inputs.trigger(c).alias("why"))


_STRONG = "^(?:" + inputs.STRONG + ")$"


@query("keyword_gate", B.with_tables("evidence", then=f"""WITH l AS (SELECT id, content, lag(content) OVER (PARTITION BY path ORDER BY turn) AS before FROM evidence), m AS (SELECT id, content, before, list_distinct({_MARKS('before')}) AS m FROM l WHERE before IS NOT NULL),
    h AS (SELECT id, content, before, m, list_filter(m, lambda x: contains(lower(content), lower(x))) AS h FROM m), s AS (SELECT *, len(list_filter(h, lambda x: {hit('x', _STRONG)})) AS s FROM h)
    SELECT id, s >= 2 OR (s >= 1 AND len(h) > s) OR len(h) - s >= 2 AS relevant, ({hit('content', inputs.LOW_INFO)} AND len(list_filter(m, lambda x: {hit('x', _STRONG)} AND contains(lower(content), lower(x)))) > 0)
        OR ({hit('before', inputs.CHOICE)} AND {hit('content', inputs.LIKING)} AND NOT {hit('before', inputs.EXPLICIT)} AND len(list_intersect({grams('before')}, {grams('content')})) > 0) AS forced FROM s"""))  # fmt: skip
def keyword_gate(spark, d):
    """Each line as a candidate for the one before it."""
    w = Window.partitionBy("path").orderBy("turn")
    rows = B.evidence(spark, d).withColumn("before", F.lag("content").over(w)).filter("before IS NOT NULL")
    c, b = F.col("content"), F.col("before")
    shared = F.size(F.array_intersect(text.bigrams(b), text.bigrams(c)))
    low_info = c.rlike(inputs.LOW_INFO) & F.exists(inputs.marks(b), lambda m: m.rlike(_STRONG) & F.contains(F.lower(c), F.lower(m)))
    return rows.select("id", inputs.keyword_relevant(inputs.marks(b), c).alias("relevant"), (low_info | inputs.forced(b, F.lit(""), c, shared)).alias("forced"))


_PINNED = "p AS (SELECT 'q' || (fact_id % 2 + 1) AS query_id, fact_id, fact_id AS rank FROM live WHERE pinned)"


@query("ordered_candidates", B.with_tables("live", then=f"""WITH {_RANKED}, {_PINNED}, u AS (SELECT query_id, fact_id, rank, 0 AS source FROM p UNION ALL SELECT query_id, fact_id, rank, 1 FROM k), f AS (SELECT query_id, fact_id, min((source, rank)) AS a FROM u GROUP BY ALL)
    SELECT query_id, fact_id, CAST(a[1] AS INTEGER) AS source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY a[1], a[2], fact_id) AS INTEGER) AS place FROM f""".replace("min((source, rank))", "min([source, rank])")))  # fmt: skip
def ordered_candidates(spark, d):
    pinned = recall.live(B.facts(spark, d)).filter("pinned").select(F.concat(F.lit("q"), F.col("fact_id") % 2 + 1).alias("query_id"), "fact_id", F.col("fact_id").alias("rank"))
    return inputs.ordered_union(pinned, _hits(spark, d).withColumn("rank", F.col("rank").cast("long")))


@query("pinned_by_relevance", B.with_tables("live", then="SELECT fact_id, pinned FROM live WHERE NOT pinned OR (fact_id * 31 % 11 >= 9 AND fact_id % 3 <> 0)"))
def pinned_by_relevance(spark, d):
    hits = recall.live(B.facts(spark, d)).withColumns({"judge": F.col("fact_id") * 31 % 11, "compatible": F.col("fact_id") % 3 != 0})
    return inputs.pinned_only_if_relevant(hits).select("fact_id", "pinned")


_DICT = f"dict(term, kind) AS {_values(ENTITIES)}"
