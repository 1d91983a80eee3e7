"""The pool of a question: channels fused, weakened and cut; and the whole recall with scorers that the caller gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.config import CONFIG, Config
from recollect.functions import scores, text
from recollect.operators import gates, graphs, recall, supersession

#: What a fact gains for each unit of similarity above a half.
SIMILAR = 0.1
ENTITY_WEIGHT = 1.5
#: Scores closer than this are equal, and the newer fact comes first.
STEP = 0.1


def entity_facts(facts: DataFrame, dictionary: DataFrame, limit: int = 30) -> DataFrame:
    """term, fact_id, place: the facts that name a term, pinned ones first, then confirmed, then newer ones."""
    rows = facts.select("fact_id", F.lower("content").alias("low"))
    met = facts.join(recall.containing(rows, dictionary, "fact_id", "low"), "fact_id")
    w = Window.partitionBy("term").orderBy(F.desc("pinned"), F.desc(F.col("status") == "confirmed"), F.desc("valid_from"), F.desc("fact_id"))
    return met.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select("term", "fact_id", "place")


def weighted_fusion(channels: DataFrame, similarities: DataFrame) -> DataFrame:
    """query_id, fact_id, rrf, via and sim; channels: query_id, fact_id, channel, rank, weight.  What is similar gains a little more."""
    part = F.col("weight") / (CONFIG.rrf_k + F.col("rank"))
    fused = channels.groupBy("query_id", "fact_id").agg(F.sum(part).alias("rrf"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("via"))
    both = fused.join(similarities, ["query_id", "fact_id"], "left")
    return both.withColumn("rrf", F.col("rrf") + SIMILAR * F.greatest(F.lit(0.0), F.coalesce("sim", F.lit(0.0)) - 0.5))


def build(
    facts: DataFrame, questions: DataFrame, dictionary: DataFrame, vectors: DataFrame, query_vectors: DataFrame, *, cap: int = 40, floor: float = CONFIG.vector_floor, own: str | None = None, config: Config = CONFIG
) -> DataFrame:
    """query_id, fact_id, score, via, place, superseded_by: the pool of each question.

    facts: live and not disowned, with act, fresh, extracted (whether an extractor wrote it) and spoken (whether it only repeats the
    assistant).  questions: query_id, term_rank, term.  Channels are lexical, distilled (lexical among extracted facts), vector and
    entity (of the dictionary's terms that the question holds).
    """
    near = recall.vector_channel(vectors.join(facts.select("fact_id"), "fact_id"), query_vectors, config.vector_k, floor, own)
    asked = questions.join(recall.small(dictionary), "term").select("query_id", "term")
    named = entity_facts(facts, asked.select("term").distinct()).join(recall.small(asked), "term").select("query_id", "fact_id", F.col("place").alias("rank"))
    side = lambda df, name, weight=1.0: df.select("query_id", "fact_id", F.lit(name).alias("channel"), "rank", F.lit(weight).alias("weight"))
    channels = side(recall.lexical_channel(facts, questions), "lexical").unionByName(side(recall.lexical_channel(facts.filter("extracted"), questions), "distilled"))
    channels = channels.unionByName(side(near, "vector")).unionByName(side(named, "entity", ENTITY_WEIGHT))
    fused = weighted_fusion(channels, near.groupBy("query_id", "fact_id").agg(F.max("sim").alias("sim")))
    hits = facts.join(fused, "fact_id")
    score = scores.adjusted(F.col("rrf"), pinned=F.col("pinned"), status=F.col("status"), layer=F.col("layer"), fresh=F.col("fresh"), dated=F.col("valid_from").isNotNull(), config=config)
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("act"), "fact_id")
    wide = graphs.saved(hits.withColumn("score", F.round(score, 6)).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= max(3 * cap, 60)).drop("n"))
    old = supersession.superseded(wide.select("query_id", "fact_id", "valid_from", "content"), questions.select("query_id", F.col("term").alias("word")))
    known = wide.join(old.select("query_id", F.col("old_id").alias("fact_id"), F.col("new_id").alias("superseded_by")), ["query_id", "fact_id"], "left")
    final = F.round(F.col("score") * F.when(F.col("superseded_by").isNotNull(), config.stale_factor).otherwise(1.0), 6)
    cut = known.withColumn("score", final).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= cap)
    # What the assistant only said comes last, whatever its score.
    last = Window.partitionBy("query_id").orderBy("spoken", "n")
    return cut.withColumn("place", F.row_number().over(last)).select("query_id", "fact_id", "score", "via", "place", "superseded_by")


def by_scorer(pool: DataFrame) -> DataFrame:
    """`pool` with ``order``: by score in steps, then by date, then by score; pool: query_id, fact_id, xscore, valid_from."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.floor(F.coalesce("xscore", F.lit(0.0)) / STEP)), F.desc_nulls_last("valid_from"), F.desc("xscore"), "fact_id")
    return pool.withColumn("order", F.row_number().over(w))


def recalled(messages: DataFrame, pool: Callable[[DataFrame], DataFrame], scorer: Callable[[DataFrame], DataFrame], threshold: Column, most: int = 2) -> DataFrame:
    """query_id, decision, fact_id, place: the whole recall of a batch of messages (query_id, text).

    A message that the front gate stops is not looked up.  `pool` gives the pool of the messages that pass, `scorer` adds ``xscore``
    to it (and valid_from); at most `most` facts at their threshold are chosen, in the order of `by_scorer`.
    """
    gated = messages.withColumn("blocked", gates.front_gate(F.col("text")))
    asked = gated.filter("blocked IS NULL").select("query_id", "text")
    scored = by_scorer(scorer(pool(asked)))
    w = Window.partitionBy("query_id").orderBy("order")
    chosen = scored.filter(F.col("xscore") >= threshold).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("query_id", "fact_id", "place")
    pooled = scored.select("query_id").distinct().withColumn("pooled", F.lit(True))
    reason = F.when(F.col("blocked").isNotNull(), F.concat(F.lit("frontgate:"), "blocked")).when(F.col("pooled").isNull(), "no-hits").when(F.col("fact_id").isNull(), "below-threshold").otherwise("selected")
    return gated.join(pooled, "query_id", "left").join(chosen, "query_id", "left").select("query_id", reason.alias("decision"), "fact_id", "place")


def stem_compounds(message: Column, stems: list[str]) -> Column:
    """Words of a message that end in one of the stems and say more than it."""
    words = F.regexp_extract_all(F.lower(message), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: w.rlike(f"^[a-z]{{1,20}}(?:{'|'.join(stems)})$")))


def vector_questions(message: Column, before: Column, short: int = 12) -> Column:
    """What is embedded for a message: itself, and if it is short also with the line before it."""
    brief = (F.length(F.regexp_replace(message, r"\s+", "")) < short) & (F.coalesce(before, F.lit("")) != "")
    return F.array_distinct(F.array_compact(F.array(F.when(message != "", message), F.when(brief, F.trim(F.concat(F.substring(before, 1, 120), F.lit(" "), message))))))


def expanded(terms: Column, message: Column, aliases: list[tuple[str, list[str]]]) -> Column:
    """`terms` and behind them other spellings of what the message asks for."""
    out = terms
    for pattern, more in aliases:
        out = F.when(message.rlike(pattern), F.array_union(out, F.array(*map(F.lit, more)))).otherwise(out)
    return out


def cjk_keywords(message: Column, stop: str, cues: str, k: int = 3) -> Column:
    """Up to k words of a Chinese message: runs of its characters cut at stop characters (not glued over them), and Latin words and numbers;
    longest first, then in order; at most eight characters of a run."""
    bare = F.regexp_replace(F.regexp_replace(message, cues, ""), f"[{stop}]", " ")
    runs = F.regexp_extract_all(bare, F.lit(r"[\x{4E00}-\x{9FFF}]{2,}|[A-Za-z]{3,}|[0-9]{2,}"), F.lit(0))
    ordered = F.transform(F.array_sort(F.array_distinct(F.transform(runs, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))), lambda x: x["w"])
    return F.slice(F.transform(ordered, lambda w: F.when(w.rlike("^[A-Za-z0-9]"), w).otherwise(F.substring(w, 1, 8))), 1, k)


def probe_or_windows(facts: DataFrame, terms: DataFrame, window: int = 4) -> DataFrame:
    """query_id, term, used, fact_id: facts that hold a term; where none does, those that hold its rarest window of so many characters."""
    direct = recall.term_matches(facts, terms).select("query_id", "term", F.col("term").alias("used"), "fact_id")
    missing = terms.join(direct.select("query_id", "term").distinct(), ["query_id", "term"], "left_anti").filter(F.length("term") > window)
    starts = F.sequence(F.lit(1), F.length("term") - (window - 1))
    cut = missing.select("query_id", "term_rank", F.col("term").alias("whole"), F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("term"), i, F.lit(window))))).alias("term"))
    met = graphs.saved(recall.term_matches(facts, cut).select("query_id", "whole", "term", "fact_id"))
    df = met.groupBy("query_id", "whole", "term").agg(F.count("*").alias("df"))
    best = df.groupBy("query_id", "whole").agg(F.min(F.struct("df", "term")).getField("term").alias("term"))
    return direct.unionByName(met.join(best, ["query_id", "whole", "term"]).select("query_id", F.col("whole").alias("term"), F.col("term").alias("used"), "fact_id"))


def is_thinking(message: Column) -> Column:
    """Whether a message is mainly a thought aloud: its first sentence is one, and such sentences make up 85 % of it."""
    starts = r"(?i)^(let me|let's|the user|i should|i need to|i'll|i will|i think|i want to|now i|hmm|wait[,.]|so (the|she|he|i)\b|looking at|it seems|it looks|based on|first,|next,|my (response|reply|plan|goal)\b)"
    sentences = F.filter(F.transform(F.split(text.without_thoughts(message), r"(?<=[.!?。！？])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")
    cjk = lambda s: F.length(F.regexp_replace(s, r"[^\x{4E00}-\x{9FFF}]", ""))
    thought = lambda s: (F.length(s) >= 12) & (cjk(s) < 0.15 * F.greatest(F.length(F.regexp_replace(s, r"[^\p{L}]", "")), F.lit(1))) & s.rlike(starts)
    size = lambda a: F.aggregate(a, F.lit(0), lambda n, s: n + F.length(s))
    return F.coalesce(thought(F.get(sentences, F.lit(0))) & (size(F.filter(sentences, thought)) >= 0.85 * size(sentences)), F.lit(False))


def is_json_blob(message: Column, density: float = 0.18) -> Column:
    """Whether a message is JSON, or in brackets and mostly its punctuation."""
    t = F.trim(message)
    return t.rlike(r"(?s)^[{\[].*[}\]]$") & (F.try_parse_json(t).isNotNull() | (F.length(F.regexp_replace(t, r'[^{}\[\]":,]', "")) > density * F.length(t)))


def prefiltered(message: Column, assistant: Column) -> Column:
    """Why nothing is to be found in a message, with all tests; whether an assistant said it decides if it may be a thought."""
    return text.prefilter(message, is_json_blob(message), assistant & is_thinking(message))
