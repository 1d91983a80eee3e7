"""A retrieval benchmark with a haystack for each question: four arms, their scores by kind of question, and intervals for the difference of two.

Every statistic is local to a question's haystack: document frequency, lengths and ranks are grouped by the question, so all questions run in one job and a
passage is counted in each haystack that it lies in.  The arms are ``bm25``, ``rare`` (the sum of the weights of the question's words that a passage holds),
``grams`` (the share of the question's pairs of characters) and ``hybrid`` (reciprocal-rank fusion of the three).

Results for odd input: a question without a known word has no ranks in the arms that need one; a passage without text is never found; a question without an
answer among its passages counts as a miss; dates that are not of the form ``2023/07/15 (Sat) 13:17`` are null; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.config import CONFIG
from recollect.functions import scores, text
from recollect.operators.recall import tokens

ITEM = """question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, haystack_dates array<string>,
    haystack_sessions array<array<struct<role: string, content: string, has_answer: boolean>>>"""
ARMS = ("bm25", "rare", "grams", "hybrid")
K1, B = 1.2, 0.75


def moment(date: Column) -> Column:
    """The time of ``2023/07/15 (Sat) 13:17``."""
    form = r"^(\d{4}/\d{2}/\d{2}) \([^)]*\) (\d{2}:\d{2})$"
    return F.try_to_timestamp(F.regexp_replace(F.when(date.rlike(form), date), form, "$1 $2"), F.lit("yyyy/MM/dd HH:mm"))


def load(spark: SparkSession, path: str, types: list[str] | None = None, n: int = 0, seed: int = 7) -> DataFrame:
    """The items of JSON files (a list, or one object a line): of some types, and of these `n` by a hash with a seed, the same ones in every run."""
    rows = spark.read.schema(ITEM).option("multiLine", True).json(path)
    if types:
        rows = rows.filter(F.col("question_type").isin(*types))
    return rows.orderBy(F.xxhash64(F.lit(seed), "question_id"), "question_id").limit(n) if n > 0 else rows


def passages(items: DataFrame, roles: tuple[str, ...] = ("user",)) -> DataFrame:
    """question_id, passage_id, content, at, answers: the turns of the roles in each question's haystack."""
    sessions = items.select("question_id", F.posexplode(F.arrays_zip(F.col("haystack_session_ids").alias("sid"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))).alias("s", "x"))
    turns = sessions.select("question_id", "x.sid", moment(F.col("x.date")).alias("at"), F.posexplode("x.turns").alias("t", "turn"))
    kept = turns.filter(F.col("turn.role").isin(*roles))
    return kept.select("question_id", F.concat_ws("#t", "sid", F.col("t").cast("string")).alias("passage_id"), F.col("turn.content").alias("content"), "at", F.coalesce("turn.has_answer", F.lit(False)).alias("answers"))


def ranked(questions: DataFrame, haystacks: DataFrame, k: int = 10) -> DataFrame:
    """question_id, arm, passage_id, rank (up to k); questions: question_id, question; haystacks: question_id, passage_id, content.

    A passage meets its question once, and is counted where they meet: its words and pairs of characters are never rows.
    """
    from recollect.operators.graphs import saved

    asked = questions.select("question_id", F.filter(F.array_distinct(tokens(F.col("question"))), lambda t: F.length(t) > 2).alias("terms"), text.bigrams(F.col("question")).alias("pairs"))
    body = F.coalesce("content", F.lit(""))
    met = haystacks.join(asked, "question_id").select("question_id", "passage_id", tokens(body).alias("words"), text.bigrams(body).alias("grams"), "terms", "pairs")
    found = F.transform("terms", lambda t: F.struct(t.alias("term"), F.size(F.filter("words", lambda w: w == t)).alias("tf")))
    shared = F.size(F.array_intersect("grams", "pairs"))
    met = saved(met.select("question_id", "passage_id", F.size("words").alias("len"), F.filter(found, lambda x: x["tf"] > 0).alias("found"), shared.alias("shared"), F.size("pairs").alias("size")))
    size = met.groupBy("question_id").agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    tf = met.select("question_id", "passage_id", "len", F.inline("found")).groupBy("question_id", "passage_id", "len", "term").agg(F.sum("tf").alias("tf"))
    df = tf.groupBy("question_id", "term").agg(F.count("*").alias("df"))
    both = saved(tf.join(df, ["question_id", "term"]).join(size, "question_id"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    lexical = saved(both.groupBy("question_id", "passage_id").agg(F.round(F.sum(part), 6).alias("bm25"), F.round(F.sum(1 / F.log2(F.col("df") + 2)), 6).alias("rare")))
    grams = met.filter("shared > 0").groupBy("question_id", "passage_id").agg(F.round(F.sum("shared") / F.first("size"), 6).alias("score"))
    one = lambda df, arm, score: df.select("question_id", F.lit(arm).alias("arm"), "passage_id", F.col(score).alias("score"))
    w = Window.partitionBy("question_id", "arm").orderBy(F.desc("score"), "passage_id")
    three = one(lexical, "bm25", "bm25").unionByName(one(lexical, "rare", "rare")).unionByName(one(grams, "grams", "score"))
    three = saved(three.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(k, CONFIG.rrf_k)))
    fused = three.groupBy("question_id", "passage_id").agg(F.round(F.sum(scores.rrf(F.col("rank"))), 9).alias("score")).withColumn("arm", F.lit("hybrid"))
    fused = fused.withColumn("rank", F.row_number().over(w))
    return three.drop("score").unionByName(fused.drop("score").select("question_id", "arm", "passage_id", "rank")).filter(F.col("rank") <= k)


def judged(questions: DataFrame, found: DataFrame, answers: DataFrame, k: int = 10) -> DataFrame:
    """question_id, kind, arm, hit (0 or 1), rr (the reciprocal rank of the first answer); questions: question_id, kind; answers: question_id, passage_id."""
    first = found.join(answers.select("question_id", "passage_id").distinct(), ["question_id", "passage_id"]).groupBy("question_id", "arm").agg(F.min("rank").alias("rank"))
    every = questions.select("question_id", "kind").withColumn("arm", F.explode(F.array(*map(F.lit, ARMS))))
    both = every.join(first, ["question_id", "arm"], "left")
    return both.select("question_id", "kind", "arm", F.when(F.col("rank") <= k, 1).otherwise(0).alias("hit"), F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("rr"))


def summary(scored: DataFrame) -> DataFrame:
    """arm, kind, n, hits, hit_rate, mrr."""
    return scored.groupBy("arm", "kind").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("rr"), 6).alias("mrr"))


def poisson(unit: Column) -> Column:
    """A number drawn from the Poisson distribution of mean 1 by a number from 0 to 1 (up to 8, beyond which there is a millionth)."""
    import math

    below, out = 0.0, F.lit(9)
    steps = []
    for n in range(9):
        below += math.exp(-1) / math.factorial(n)
        steps.append((below, n))
    for bound, n in reversed(steps):
        out = F.when(unit < bound, n).otherwise(out)
    return out


def paired(scored: DataFrame, arm: str, other: str, rounds: int = 400, seed: int = 7, value: str = "hit") -> DataFrame:
    """kind, n, difference (of the arms' means), low and high: an interval of 95 % by the bootstrap over questions.

    In each round a question counts a Poisson number of times, drawn by a hash of the question and the round, so rounds need no resampled table and
    are the same in every run and partitioning.
    """
    side = lambda a, to: scored.filter(F.col("arm") == a).select("question_id", "kind", F.col(value).alias(to))
    both = side(arm, "a").join(side(other, "b"), ["question_id", "kind"]).select("question_id", "kind", (F.col("a") - F.col("b")).cast("double").alias("d"))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "round", "question_id"), 11) / float(1 << 53)
    drawn = both.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", poisson(unit))
    means = drawn.groupBy("kind", "round").agg((F.sum(F.col("w") * F.col("d")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ends = means.groupBy("kind").agg(F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("difference")).join(ends, "kind")
