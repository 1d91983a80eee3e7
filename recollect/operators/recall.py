"""Recall: lexical, vector and BM25 search, reciprocal-rank fusion and selection, for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.config import CONFIG, Config
from recollect.functions import scores, text

#: Queries come in batches; a batch is sent to all tasks only up to this many rows.
SMALL = 10_000
#: Up to so many terms are looked for in each text; more meet the texts by equi-joins.
SCAN = 200


def is_small(df: DataFrame) -> bool:
    return df.limit(SMALL + 1).count() <= SMALL


def small(df: DataFrame) -> DataFrame:
    """`df` marked for broadcast if it is known to be small, else as it is: only for joins that have equal keys, which are then shuffled."""
    return F.broadcast(df) if is_small(df) else df


def live(facts: DataFrame, config: Config = CONFIG) -> DataFrame:
    return facts.filter(F.col("status").isin(*config.live))


def narrowed(facts: DataFrame, *, who: str | None = None, types: list[str] | None = None, extracted: bool = False, spoken: str | None = None) -> DataFrame:
    """`facts` of one subject, of some types, written by an extractor (by ``reason``), and without those that begin as `spoken` says."""
    for on, keep in ((who, lambda: F.col("subject") == who), (types, lambda: F.col("fact_type").isin(*types)), (extracted, lambda: F.col("reason").startswith("extract-llm-")), (spoken, lambda: ~F.col("content").rlike(spoken))):
        if on:
            facts = facts.filter(keep())
    return facts


def current_stances(stances: DataFrame) -> DataFrame:
    """The latest stance of each actor on each fact."""
    newest = F.max_by(F.struct("id", "stance", "created_at"), F.struct("created_at", "id"))
    return stances.groupBy("fact_id", "actor").agg(newest.alias("s")).select("fact_id", "actor", "s.*")


def not_disowned(facts: DataFrame, stances: DataFrame, actor: str) -> DataFrame:
    """`facts` with ``stance`` of the actor (none without one), without the disowned."""
    mine = current_stances(stances.filter(F.col("actor") == actor)).select("fact_id", "stance")
    return facts.join(mine, "fact_id", "left").withColumn("stance", F.coalesce("stance", F.lit("none"))).filter("stance <> 'disown'")


def with_activation(facts: DataFrame, now: Column) -> DataFrame:
    fresh = scores.decay(scores.age_days(F.col("valid_from"), now), F.col("fact_type"))
    act = scores.activation(F.col("pinned"), F.col("importance"), fresh, F.col("access_count"), F.col("confidence"))
    return facts.withColumns({"fresh": fresh, "act": act})


def containing(rows: DataFrame, terms: DataFrame, key: str, low: str, scan: int = SCAN) -> DataFrame:
    """(key, term): each row whose lower-case text `low` holds a term; terms: term.

    A few terms are looked for in each text, one pass.  More of them meet the texts' runs of up to three characters by equi-joins, each by its rarest
    run, so that no run is hot because many terms begin with it; what is found is then looked at.
    """
    asked = terms.select("term").distinct().filter(F.length("term") > 0)
    texts = rows.select(key, F.col(low).alias("_low"))
    if asked.limit(scan + 1).count() <= scan:
        return texts.join(F.broadcast(asked), F.contains("_low", F.col("term"))).select(key, "term")
    size = F.least(F.length("term"), F.lit(3))
    parts = F.transform(F.sequence(F.lit(1), F.length("term") - size + 1), lambda i: F.substring(F.col("term"), i, size))
    cut = asked.select("term", F.explode(F.array_distinct(parts)).alias("_run"))
    runs = texts.select(key, F.explode(F.concat(*(text.windows(F.col("_low"), n) for n in (1, 2, 3)))).alias("_run"))
    runs = runs.join(cut.select("_run").distinct(), "_run", "left_semi")
    df = runs.groupBy("_run").agg(F.count("*").alias("n"))
    rarest = cut.join(df, "_run", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_run")).alias("r")).filter("r.n > 0")
    near = runs.join(rarest.select("term", F.col("r._run").alias("_run")), "_run").select(key, "term")
    return near.join(texts, key).filter(F.contains("_low", F.col("term"))).select(key, "term")


def term_matches(facts: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, term, term_rank and the columns of every fact whose text holds the term; terms: query_id, term_rank, term; facts have a ``fact_id``."""
    if terms.limit(SCAN + 1).count() <= SCAN:
        return facts.join(F.broadcast(terms), F.contains(F.lower("content"), F.col("term")))
    rows = facts.select("fact_id", F.lower("content").alias("low"))
    return facts.join(containing(rows, terms, "fact_id", "low").join(terms, "term"), "fact_id")


def word_matches(facts: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, term, fact_id, tf and len (of the fact, in words): words of facts that are asked for, by an equi-join; terms: query_id, term."""
    words = facts.select("fact_id", tokens(F.col("content")).alias("words")).select("fact_id", F.size("words").alias("len"), F.explode("words").alias("term"))
    asked = terms.select("query_id", "term").distinct()
    held = words.join(small(asked.select("term").distinct()), "term", "left_semi").groupBy("fact_id", "term", "len").agg(F.count("*").alias("tf"))
    return held.join(small(asked), "term")


def document_frequency(facts: DataFrame, terms: DataFrame) -> DataFrame:
    hits = containing(facts.select("fact_id", F.lower("content").alias("low")), terms, "fact_id", "low").groupBy("term").agg(F.count("*").alias("df"))
    return terms.join(hits, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))


def rarity_order(facts: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms of each query: rarest first, absent ones last, longer first among equals."""
    w = Window.partitionBy("query_id").orderBy(F.col("df") == 0, "df", F.desc(F.length("term")), "term")
    return document_frequency(facts, terms).select("query_id", "term", "df", F.row_number().over(w).alias("place"))


def search(facts: DataFrame, terms: DataFrame, limit: int = 20, config: Config = CONFIG) -> DataFrame:
    """Facts that hold all terms of a query, by activation (halved when cold); facts need act."""
    wanted = terms.groupBy("query_id").agg(F.count("*").alias("wanted"))
    hits = term_matches(facts, terms).groupBy("query_id", "fact_id").agg(F.count("*").alias("n"), F.first("act").alias("act"), F.first("layer").alias("layer"))
    found = hits.join(small(wanted), "query_id").filter("n = wanted")
    score = F.col("act") * F.when(F.col("layer") == "cold", config.cold_factor).otherwise(1.0)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "fact_id")
    return found.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query_id", "fact_id", "score", "rank")


def lexical_channel(facts: DataFrame, terms: DataFrame, config: Config = CONFIG) -> DataFrame:
    """query_id, fact_id, rank: the first term that finds a fact claims it; at most `per_term` facts for a term."""
    first = term_matches(facts, terms).groupBy("query_id", "fact_id").agg(F.min("term_rank").alias("term_rank"), F.first("act").alias("act"))
    each = Window.partitionBy("query_id", "term_rank").orderBy(F.desc("act"), "fact_id")
    kept = first.withColumn("n", F.row_number().over(each)).filter(F.col("n") <= config.per_term)
    w = Window.partitionBy("query_id").orderBy("term_rank", F.desc("act"), "fact_id")
    return kept.select("query_id", "fact_id", F.row_number().over(w).alias("rank"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_channel(vectors: DataFrame, queries: DataFrame, k: int, floor: float, own: str | None = None) -> DataFrame:
    """query_id, fact_id, sim, rank: the k most similar vectors of each query above the floor; queries: query_id, query_vec.

    A few query rows go to the vectors, which stay where they are.  Many are dealt to blocks, as the vectors are, and each pair of blocks is
    one task that keeps the best of each query.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "fact_id")
    if is_small(queries):
        met = vectors.join(F.broadcast(queries), F.col("fact_id") != F.col(own) if own else F.lit(True))
        scored = met.select("query_id", "fact_id", F.round(dot(F.col("vec"), F.col("query_vec")), 6).alias("sim"))
    else:
        scored = _tiled(vectors.select("fact_id", "vec"), queries.select("query_id", "query_vec", F.col(own).alias("own") if own else F.lit(None).cast("long").alias("own")), k)
    return scored.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= k) & (F.col("sim") >= floor)).select("query_id", "fact_id", "sim", "rank")


def _tiled(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """query_id, fact_id, sim: of each query the k best of every block of vectors."""
    import numpy as np
    import pandas as pd

    parts = lambda df: max(1, -(-df.count() // block))
    rows, asked = parts(vectors), parts(queries)
    deal = lambda df, key, n, other, m, mine: df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = deal(vectors, "fact_id", rows, "j", asked, "i"), deal(queries, "query_id", asked, "i", rows, "j")

    def best(key, v, q):
        if not len(v) or not len(q):
            return pd.DataFrame({"query_id": q["query_id"][:0], "fact_id": v["fact_id"][:0], "sim": np.zeros(0)})
        v = v.sort_values("fact_id")
        ids = v["fact_id"].to_numpy()
        sim = np.round(np.stack(q["query_vec"]).astype(float) @ np.stack(v["vec"]).astype(float).T, 6)
        sim[q["own"].to_numpy(dtype=float, na_value=np.nan)[:, None] == ids[None]] = -np.inf
        at = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(sim, at, 1)
        out = pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy(), at.shape[1]), "fact_id": ids[at].ravel(), "sim": top.ravel()})
        return out[np.isfinite(out["sim"])]

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, f"query_id {queries.schema['query_id'].dataType.simpleString()}, fact_id long, sim double")


def fuse(*channels: tuple[str, DataFrame]) -> DataFrame:
    """query_id, fact_id, rrf and via (the channels, sorted): reciprocal-rank fusion."""
    parts = [df.select("query_id", "fact_id", F.lit(name).alias("channel"), scores.rrf(F.col("rank")).alias("part")) for name, df in channels]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("query_id", "fact_id").agg(F.sum("part").alias("rrf"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("via"))


def hybrid(facts: DataFrame, fused: DataFrame, config: Config = CONFIG) -> DataFrame:
    """The `keep` best facts of each query after bonuses and factors; facts need act and fresh."""
    hits = facts.join(fused, "fact_id")
    score = scores.adjusted(F.col("rrf"), pinned=F.col("pinned"), status=F.col("status"), layer=F.col("layer"), fresh=F.col("fresh"), dated=F.col("valid_from").isNotNull(), config=config)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("act"), "fact_id")
    ranked = hits.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= config.keep)
    return ranked.select("query_id", "rank", "fact_id", "score", "via", "act")


def tokens(content: Column) -> Column:
    return F.regexp_extract_all(F.lower(content), F.lit("[a-z0-9]+"), F.lit(0))


def bm25(facts: DataFrame, terms: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, fact_id, score, rank.  Only the terms asked for are counted, one pass over the texts."""
    size = facts.select(F.size(tokens(F.col("content"))).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    tf = word_matches(facts, terms)
    df = tf.select("term", "fact_id").distinct().groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(df, "term").join(F.broadcast(size), F.lit(True))  # size: one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "fact_id")
    return scored.groupBy("query_id", "fact_id").agg(F.round(F.sum(part), 6).alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def select_scored(pool: DataFrame, threshold: Column, most: int = 2, follow: float = 0.7) -> DataFrame:
    """Rows at or above their threshold, best first; the second must have `follow` of the first's score."""
    w = Window.partitionBy("query_id").orderBy(F.desc("xscore"), "fact_id")
    kept = pool.filter(F.col("xscore") >= threshold).withColumns({"place": F.row_number().over(w), "best": F.first("xscore").over(w)})
    return kept.filter((F.col("place") <= most) & (F.col("xscore") >= follow * F.col("best"))).drop("best")


def discover(cards: DataFrame, terms: DataFrame, limit: int, config: Config = CONFIG) -> DataFrame:
    """query_id, fact_id, score, rank: three times the limit by terms found on the card, then echoes weakened, ordered anew and cut.

    cards: fact_id, card (lower case), act, echo.
    """
    met = containing(cards, terms, "fact_id", "card").join(small(terms), "term")
    hits = met.groupBy("query_id", "fact_id").agg(F.count("*").alias("n")).join(cards.select("fact_id", "act", "echo"), "fact_id")
    first = Window.partitionBy("query_id").orderBy(F.desc("n"), F.desc("act"), "fact_id")
    more = hits.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= 3 * limit)
    score = F.round(F.col("n") * F.col("act") * F.when(F.col("echo"), config.echo_factor).otherwise(1.0), 6)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "fact_id")
    return more.withColumn("score", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query_id", "fact_id", "score", "rank")
