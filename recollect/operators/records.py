"""Writers and readers around the store: dumps, expiry, splits, labels, windows of earlier sessions, hand-off notes, reports."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.config import CONFIG, Config
from recollect.functions import redaction, text

#: Versions of the algorithms, which every run is stamped with.
VERSIONS = {"engine": "2", "gate": "2", "pool": "2", "scores": "1"}


def stamped(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"v_{k}": F.lit(v) for k, v in VERSIONS.items()})


# -- dumps and expiry -----------------------------------------------------------------------------


def dumped(facts: DataFrame, **children: DataFrame) -> DataFrame:
    """fact_id and ``record``, a struct of the fact and, by name, the sorted array of its rows in each child table."""
    out = facts.select("fact_id", F.struct(*facts.columns).alias("fact"))
    for name, child in children.items():
        rest = [c for c in child.columns if c != "fact_id"]
        lists = child.groupBy("fact_id").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
        out = out.join(lists, "fact_id", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out.select("fact_id", F.struct("fact", *children).alias("record"))


def expired(archive: DataFrame, restored: DataFrame, done: DataFrame, now: Column, config: Config = CONFIG) -> DataFrame:
    """The rows (batch_id, fact_id) of batches whose time in the bin is over, that were neither restored nor exported yet.

    archive: batch_id, fact_id, opened_at; restored: batch_id, fact_id; done: batch_id.
    """
    until = F.col("opened_at") + F.expr(f"INTERVAL {config.bin_days} DAYS")
    over = archive.groupBy("batch_id").agg(F.max("opened_at").alias("opened_at")).filter(until <= now).select("batch_id")
    left = archive.select("batch_id", "fact_id").join(over, "batch_id").join(done.select("batch_id"), "batch_id", "left_anti")
    return left.join(restored, ["batch_id", "fact_id"], "left_anti")


def export(rows: DataFrame, records: DataFrame, path: str) -> DataFrame:
    """Writes the records of expired rows as compressed JSON lines by batch, reads them back, and returns what the log gets: batch_id, fact_id, sha.

    A batch whose lines don't come back as they were written raises an error, and nothing is logged.
    """
    lines = rows.join(records, "fact_id").select("batch_id", "fact_id", F.to_json("record").alias("line"))
    lines.write.partitionBy("batch_id").option("compression", "gzip").json(path)
    back = rows.sparkSession.read.schema("fact_id long, line string, batch_id long").json(path)
    digest = lambda df: df.select("batch_id", "fact_id", F.sha2("line", 256).alias("sha"))
    written, read = digest(lines), digest(back)
    if not written.exceptAll(read).isEmpty() or not read.exceptAll(written).isEmpty():
        raise ValueError(f"what was written to {path} does not come back")
    return read


def telemetry(messages: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, hits) to append.  messages: run_id, text, decision, latency_ms; hits: run_id, fact_id, rank, score, snippet.  No text is kept."""
    runs = messages.select("run_id", F.substring(F.sha2("text", 256), 1, 16).alias("query_hash"), "decision", "latency_ms", F.ceil(F.length("text") / 1.6).alias("tokens"))
    found = hits.groupBy("run_id").agg(F.count("*").alias("returned"))
    runs = stamped(runs.join(found, "run_id", "left").withColumn("returned", F.coalesce("returned", F.lit(0))))
    return runs, hits.select("run_id", "fact_id", "rank", "score", F.length("snippet").alias("snippet_chars"))


# -- splits ---------------------------------------------------------------------------------------


def atom_reason(original: Column, content: Column, quote: Column, shortest: int = 4, longest: int = 120, overlap: float = 0.6) -> Column:
    """Why an atom can't stand for a part of the original, or null."""
    strange = redaction.let(text.bigrams(content), lambda grams: (F.size(grams) == 0) | (text.coverage(grams, text.bigrams(original)) < overlap))
    return (
        F.when(redaction.redacted(content) != content, "secret")
        .when(~F.length(F.trim(content)).between(shortest, longest), "atom-length")
        .when((F.length(quote) < 4) | ~F.contains(original, quote), "quote-not-verbatim")
        .when(F.size(F.array_except(text.numbers(content), text.numbers(original))) > 0, "invented-number")
        .when(strange, "not-from-original")
        .when(F.trim(content) == F.trim(original), "duplicate-atom")
    )


def splits(facts: DataFrame, atoms: DataFrame, most: int = 6) -> DataFrame:
    """fact_id, atoms, verdict: split if there are two to `most` atoms that all stand, distinct ones; else atomic or the first reason.

    facts: fact_id, content; atoms: fact_id, n (order), content, quote.  Fewer atoms, or more, decide by their number alone: those are counted and not
    compared with the fact.
    """
    ids = facts.groupBy("fact_id").agg(F.count("*").alias("copies"))
    numbers = atoms.groupBy("fact_id").agg(F.count("*").alias("atoms")).join(ids, "fact_id").select("fact_id", (F.col("atoms") * F.col("copies")).alias("atoms"))
    few = numbers.filter(F.col("atoms").between(2, most)).select("fact_id")
    each = atoms.withColumnRenamed("content", "atom").join(few, "fact_id", "left_semi").join(facts.select("fact_id", "content"), "fact_id").withColumn("reason", atom_reason(F.col("content"), F.col("atom"), F.col("quote")))
    first = F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("n")))
    found = numbers.join(each.groupBy("fact_id").agg(F.count_distinct(F.trim("atom")).alias("distinct"), first.alias("reason")), "fact_id", "left")
    verdict = F.when(F.coalesce("atoms", F.lit(0)) < 2, "atomic").when(F.col("atoms") > most, "too-many-atoms").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("distinct") < F.col("atoms"), "duplicate-atom").otherwise("split")
    return facts.select("fact_id").join(found, "fact_id", "left").select("fact_id", F.coalesce("atoms", F.lit(0)).alias("atoms"), verdict.alias("verdict"))


def rolled_back(log: DataFrame, batch_id: Column) -> DataFrame:
    """What undoes a batch of splits: the parents come back, the atoms go.  log: batch_id, parent_id, atom_id."""
    mine = log.filter(F.col("batch_id") == batch_id)
    parents = mine.select(F.col("parent_id").alias("fact_id"), F.lit("candidate").alias("status")).distinct()
    return parents.unionByName(mine.select(F.col("atom_id").alias("fact_id"), F.lit("invalid").alias("status")))


# -- decisions ------------------------------------------------------------------------------------


def decided(rows: DataFrame, config: Config = CONFIG) -> DataFrame:
    """`rows` with promote, why, importance and confidence: guards, then the plug-in's verdict if it is sound, else the rules.

    rows: subject, content, pinned, n_evidence, n_verified, duplicate, slots (by rule), and of the plug-in (all null without one) model_promote,
    model_subject, model_quote, model_confidence and model_slots.
    """
    empty = ~F.col("content").rlike(r"[\p{L}\p{N}]")
    sound = F.col("model_promote").isNotNull() & F.contains("content", F.coalesce("model_quote", F.lit(""))) & F.col("model_subject").isin(F.col("subject"), F.lit(config.group)) & F.col("model_confidence").between(0, 1)
    shared = F.col("model_subject") == config.group
    by_model = sound & ~(shared & (F.col("n_evidence") < 2))  # the group needs two voices
    by_rule = F.col("pinned") | ((F.col("n_verified") > 0) & (F.col("slots") > 0))
    why = (
        F.when(F.col("pinned"), "pinned").when(empty, "no-text").when(F.col("n_evidence") == 0, "no-evidence").when(F.col("n_verified") == 0, "not-verified").when(F.col("duplicate"), "duplicate")
        .when(by_model, F.when(F.col("model_promote"), "model-yes").otherwise("model-no")).when(by_rule, "rule-yes").otherwise("rule-no")
    )
    n = F.when(why == "model-yes", F.col("model_slots")).otherwise(F.col("slots"))
    importance = F.least(F.lit(0.95), 0.3 + 0.12 * n + F.when(F.length("content") >= 30, 0.1).otherwise(0.0))
    base = F.least(F.lit(1.0), 0.6 + 0.1 * F.col("n_verified"))
    sure = F.when(why == "model-yes", 0.5 * base + 0.5 * F.col("model_confidence")).otherwise(base)
    return rows.withColumns({"promote": why.isin("pinned", "model-yes", "rule-yes"), "why": why, "importance": F.round(importance, 2), "confidence": F.round(sure, 2)})


# -- labels ---------------------------------------------------------------------------------------

SAID = r"^\s*(me|[^(:\n]{1,14} \([^)]*\)):"


def spoken(subject: Column, content: Column) -> Column:
    """Whether a fact only repeats what the assistant said."""
    return (subject == CONFIG.assistants[0]) & content.rlike(SAID)


def tags(echo_from: Column, self_note: Column, said: Column) -> Column:
    """What is put before a fact where it is shown: second-hand and from whom, the assistant's own note, its own words."""
    return F.concat(F.when(F.size(echo_from) > 0, F.concat(F.lit("[second-hand: "), F.array_join(F.array_sort(echo_from), ", "), F.lit("]"))).otherwise(""), F.when(self_note, "[own note]").otherwise(""), F.when(said, "[own words]").otherwise(""))


# -- sessions before this one ---------------------------------------------------------------------


def background(turns: DataFrame, header: str) -> DataFrame:
    """(path, background): whether the first words of the owner in a session are the header of a task; turns: path, line, actor, content."""
    mine = turns.filter((F.col("actor") == CONFIG.owner) & (F.trim("content") != ""))
    first = mine.groupBy("path").agg(F.min_by("content", "line").alias("first"))
    return turns.select("path").distinct().join(first, "path", "left").select("path", F.coalesce(F.ltrim("first").rlike(header), F.lit(False)).alias("background"))


def evidence_window(evidence: DataFrame, since: Column, until: Column, actors: list[str]) -> DataFrame:
    """Evidence of known actors from `since` up to, but not at, `until`."""
    return evidence.filter((F.col("occurred_at") >= since) & (F.col("occurred_at") < until) & F.col("actor").isin(*actors))


def previous_sessions(sessions: DataFrame, hours: int = 24, least: int = 3) -> DataFrame:
    """(path, previous): the newest session that ended before this one began, within so many hours, with at least so many turns.

    sessions: path, first, last, turns.  Ends and beginnings meet on slots of that length, so a session only sees those near it.
    """
    width = hours * 3600
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    ends = sessions.filter(F.col("turns") >= least).select(F.col("path").alias("previous"), F.col("last").alias("ended"), slot("last").alias("slot"))
    begins = sessions.select("path", "first", F.explode(F.array(slot("first"), slot("first") - 1)).alias("slot"))
    met = begins.join(ends, "slot").filter((F.col("ended") < F.col("first")) & (F.col("ended") >= F.col("first") - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("path") != F.col("previous")))
    best = met.groupBy("path").agg(F.max(F.struct("ended", "previous")).getField("previous").alias("previous"))
    return sessions.select("path").join(best, "path", "left")


def side_stream(messages: DataFrame, until: Column, limit: int, clip: int = 800, slack: int = 10) -> DataFrame:
    """The last `limit` messages of each stream up to some seconds after `until`, in order, each at most `clip` characters; messages: stream, id, ts, said."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) <= F.unix_micros(until.cast("timestamp")) + slack * 1_000_000
    w = Window.partitionBy("stream").orderBy(F.desc("ts"), F.desc("id"))
    short = F.when(F.length("said") > clip, F.concat(F.substring("said", 1, clip), F.lit("…"))).otherwise(F.col("said"))
    kept = messages.filter(at & (F.trim("said") != "")).withColumn("back", F.row_number().over(w)).filter(F.col("back") <= limit)
    return kept.select("stream", "id", "ts", short.alias("said"), "back")


def sides_of(turns: DataFrame) -> DataFrame:
    """`turns` (stream, ts) with ``side``: before, during or after the session (began, ended) they are set beside."""
    return turns.withColumn("side", F.when(F.col("ts") < F.col("began"), "before").when(F.col("ts") <= F.col("ended"), "during").otherwise("after"))


# -- hand-off notes -------------------------------------------------------------------------------

SECTIONS = ("summary", "pending", "state")


def sections(note: Column) -> dict[str, Column]:
    """The items of each known section of a note: lines ``- item`` under ``## name`` until the next heading."""
    out = {}
    for name in SECTIONS:
        body = F.regexp_extract(F.concat(note, F.lit("\n#")), rf"(?is)(?:^|\n)#+ *{name}[^\n]*\n(.*?)\n#", 1)
        items = F.regexp_extract_all(F.concat(F.lit("\n"), body), F.lit(r"\n\s*[-*] *([^\n]+)"), F.lit(1))
        out[name] = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != "none"))
    return out


def injected(note: Column, last: Column, today: Column, days: int = 14, most: int = 1200, line: int = 120) -> Column:
    """What a new session is given of a note: nothing if it is older than `days`; else its sections, cut to `most` characters.

    Where it is too long, items go from the end: first those of the summary, then of the state, and last of what is pending.
    """
    short = lambda x: F.when(F.length(x) > line, F.concat(F.substring(x, 1, line - 1), F.lit("…"))).otherwise(x)
    s = {k: F.transform(v, short) for k, v in sections(note).items()}
    size = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x) + 3)
    titled = lambda k, a: F.when(F.size(a) > 0, F.concat(F.lit(f"{k}:\n- "), F.array_join(a, "\n- "))).otherwise("")
    head = F.concat(F.lit("[hand-off, last message "), F.date_format(last, "yyyy-MM-dd HH:mm"), F.lit("; a note, not said just now]"))

    def fit(items: Column, room: Column) -> Column:
        """The first items that fit in so many characters."""
        kept = F.aggregate(items, F.struct(F.lit(0).alias("size"), F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct(
            (a["size"] + F.length(x) + 3).alias("size"), (a["n"] + (a["on"] & (a["size"] + F.length(x) + 3 <= room)).cast("int")).alias("n"), (a["on"] & (a["size"] + F.length(x) + 3 <= room)).alias("on")))
        return F.slice(items, F.lit(1), kept["n"])

    room = F.lit(most) - F.length(head) - 40  # titles
    pending = fit(s["pending"], room)
    state = fit(s["state"], room - size(pending))
    summary = fit(s["summary"], room - size(pending) - size(state))
    parts = F.filter(F.array(titled("Summary", summary), titled("Pending", pending), titled("State", state)), lambda x: x != "")
    text_ = F.when(F.size(parts) > 0, F.concat(head, F.lit("\n"), F.array_join(parts, "\n"))).otherwise("")
    return F.when(F.date_diff(today, last) > days, "").otherwise(text_)


# -- snippets and replies -------------------------------------------------------------------------


def best_window(doc: Column, words: Column, limit: int = 300) -> Column:
    """At most `limit` characters around the sentence with most of the words: it, what follows, then what comes before, as it fits."""
    sentences = F.filter(F.split(F.regexp_replace(doc, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")
    count = lambda s: F.aggregate(words, F.lit(0), lambda n, w: n + F.size(F.split(F.lower(s), F.concat(F.lit(r"\Q"), w, F.lit(r"\E")), -1)) - 1)
    scored = F.transform(sentences, lambda s, i: F.struct(count(s).alias("n"), i.alias("i")))
    best = F.array_max(scored)
    grow = lambda a, s, text_: F.when(a["on"] & (F.length(a["out"]) + 1 + F.length(s) <= limit), F.struct(text_.alias("out"), F.lit(True).alias("on"))).otherwise(F.struct(a["out"].alias("out"), F.lit(False).alias("on")))
    start = F.struct(F.element_at(sentences, best["i"] + 1).alias("out"), F.lit(True).alias("on"))
    after = F.aggregate(F.slice(sentences, best["i"] + 2, F.size(sentences)), start, lambda a, s: grow(a, s, F.concat(a["out"], F.lit(" "), s)))
    again = F.struct(after["out"].alias("out"), F.lit(True).alias("on"))
    both = F.aggregate(F.reverse(F.slice(sentences, 1, best["i"])), again, lambda a, s: grow(a, s, F.concat(s, F.lit(" "), a["out"])))
    return F.when(F.length(doc) <= limit, doc).when((F.size(sentences) == 0) | (best["n"] == 0), F.substring(doc, 1, limit)).otherwise(both["out"])


def closed(text: str) -> str | None:
    """The longest JSON object that a cut-off one still is: its last incomplete part dropped or its open string closed, and its open brackets closed.

    A text is read once.  A stack holds the brackets that are open; wherever a value is whole the place is noted with the stack.  An open string is
    a value unless it is a key; an escape that is cut off goes with it.
    """
    import json

    begin = text.find("{")
    if begin < 0:
        return None
    stack: list[str] = []
    cuts: list[tuple[int, str]] = []  # the places up to which everything is whole, and what is open there
    at, key = begin, False
    while at < len(text):
        c = text[at]
        if c == '"':
            end = at + 1
            while end < len(text) and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            is_key = bool(stack) and stack[-1] == "}" and key
            if end >= len(text):
                held = text[at + 1 :]
                for drop in range(min(7, len(held) + 1)):  # an escape is six characters at most
                    tried = text[begin:at] + '"' + held[: len(held) - drop] + '"' + "".join(reversed(stack))
                    if not is_key and _object(tried):
                        return tried
                break
            at = end + 1
            if not is_key:
                cuts.append((at, "".join(reversed(stack))))
            continue
        if c in "{[":
            stack.append("}" if c == "{" else "]")
            key = c == "{"
            cuts.append((at + 1, "".join(reversed(stack))))
        elif c in "}]":
            if not stack or stack[-1] != c:
                break
            stack.pop()
            cuts.append((at + 1, "".join(reversed(stack))))
            key = False
            if not stack:
                break
        elif c == ",":
            key = bool(stack) and stack[-1] == "}"
        elif c == ":":
            key = False
        elif not c.isspace():
            end = at
            while end < len(text) and text[end] not in ',:]}"{[' and not text[end].isspace():
                end += 1
            if end < len(text) or text[at:end] in ("true", "false", "null"):  # a number that may go on is not whole
                cuts.append((end, "".join(reversed(stack))))
            at = end
            continue
        at += 1
    # The last of them is an object, unless the text was no JSON before it was cut off: then some places before it are tried.
    return next((out for cut, closers in reversed(cuts[-64:]) if _object(out := text[begin:cut] + closers)), None)


def _object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def tolerant_json(reply: Column) -> Column:
    """The JSON object of a model's reply, without fences, talk around it and commas before a closing bracket; of one that was cut off the longest
    object that it still is; null if there is none."""
    @F.pandas_udf("string")
    def repaired(replies: pd.Series) -> pd.Series:
        return replies.map(lambda t: closed(t) if isinstance(t, str) else None)

    bare = F.regexp_replace(F.trim(reply), r"(?i)^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    mended = F.regexp_replace(inner, r",\s*([}\]])", "$1")
    out = F.when(F.lit(False), F.lit(""))
    for t in (bare, inner, mended, repaired(F.regexp_replace(F.regexp_extract(bare, r"(?s)(\{.*)$", 1), r",\s*([}\]])", "$1"))):
        out = out.when(F.trim(t).startswith("{") & F.try_parse_json(t).isNotNull(), t)
    return out


def worth_rewriting(message: Column, direct: Column, least: int = 6) -> Column:
    """Whether a message is worth the cost of a rewrite: no entity leads the way already, and it says something."""
    bare = F.regexp_replace(message, r"\s+", "")
    return ~direct & (F.length(bare) >= least) & bare.rlike(r"[\p{L}\p{N}]")


# -- reports --------------------------------------------------------------------------------------


def citations(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each fact's evidence with its place and speaker, which is the answer to "why"."""
    return links.join(evidence.select(F.col("id").alias("evidence_id"), "actor", "locator"), "evidence_id").select("fact_id", "evidence_id", "role", "actor", "locator")


def degraded(links: DataFrame, states: DataFrame) -> DataFrame:
    """Live facts that evidence supports which is broken or uncertain by now; states: id, state."""
    bad = states.filter(F.col("state").isin("broken", "uncertain")).select(F.col("id").alias("evidence_id"), "state")
    return links.filter((F.col("role") == "support") & F.col("status").isin(*CONFIG.live)).join(bad, "evidence_id").select("fact_id", "evidence_id", "state")


def corroborated(blocks: DataFrame, evidence: DataFrame, least: int = 4) -> DataFrame:
    """Embedded blocks (id, path, actor, body) whose words another row of the same session and speaker holds."""
    norm = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    said = evidence.select("path", "actor", F.col("id").alias("other"), norm("content").alias("said"))
    asked = blocks.withColumn("n", norm("body")).filter(F.length("n") >= least)
    hits = asked.join(said, ["path", "actor"]).filter((F.col("id") != F.col("other")) & F.contains("said", F.col("n"))).select("id").distinct()
    return blocks.join(hits.withColumn("corroborated", F.lit(True)), "id", "left").withColumn("corroborated", F.coalesce("corroborated", F.lit(False)))


def scored_by_type(items: DataFrame) -> DataFrame:
    """kind, correct, total for each kind and for all (kind null); items: kind, correct."""
    return items.rollup("kind").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))


def sampled(rows: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """`n` rows drawn by a hash, the same ones each time."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def with_model(rows: DataFrame, judge: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """`rows` with the columns of a plug-in's verdict; nulls where there is none.  `judge` takes and returns a DataFrame."""
    if judge is not None:
        return judge(rows)
    types = {"model_promote": "boolean", "model_subject": "string", "model_quote": "string", "model_confidence": "double", "model_slots": "int"}
    return rows.withColumns({k: F.lit(None).cast(t) for k, t in types.items()})


# -- other sources --------------------------------------------------------------------------------


def mailbox(messages: DataFrame, done: DataFrame, until: Column, known: dict[str, str], skip: str) -> DataFrame:
    """Evidence (locator, actor, content, occurred_at) of a log of messages: those before a cut-off, of known senders, with words, and not taken yet.

    messages: id, ts, sender, text, imported; done: locator.
    """
    actors = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    said = F.trim(F.coalesce("text", F.lit("")))
    rows = messages.filter((F.col("ts") < until) & ~F.coalesce("imported", F.lit(False)) & (F.length(said) >= 2) & ~said.rlike(skip))
    rows = rows.select(F.concat(F.lit("id"), "id").alias("locator"), F.element_at(actors, F.col("sender")).alias("actor"), said.alias("content"), F.col("ts").alias("occurred_at"))
    return rows.filter("actor IS NOT NULL").join(done.select("locator"), "locator", "left_anti")


SUGGESTS = r"(?i)\b(you could|you should|how about|why not|shall we)\b"
TECHNICAL = r"(?i)\b(code|server|database|function|error|file|script)\b"
OWN_FAULT = r"(?i)\b(my mistake|i was wrong|sorry)\b"
ASKS = r"\?\s*$"


def own_speech_class(body: Column, slot: Column) -> Column:
    """Which pool of the assistant's own sentences one belongs to when they are condensed (suggestion, technical or other), or null for none:
    short ones without a slot and bare questions stay out, unless they own up to a fault."""
    n = F.length(body)
    out = ~body.rlike(OWN_FAULT) & ~slot & ((n < 25) | ((n <= 120) & body.rlike(ASKS)))
    return F.when(out, None).when(body.rlike(SUGGESTS), "suggestion").when((n >= 150) & body.rlike(TECHNICAL), "technical").otherwise("other")
