"""Operator 4: quality rules, with robust multivariate outliers by minimum-covariance-determinant estimates.

A document that passes the base rules is described by three statistics: the logarithm of its mean word length,
the square root of its share of characters that are neither letters nor digits, and the logarithm of its distinct words
over that of its words.  Each is taken as the distance from the group's median and scaled by sqrt(n / (n + `SETTLED`)) for n
words, because short texts scatter more.  A group is a language and source, or the language, or all documents, whichever is
the first with `LEAST` documents; its estimate is over all documents that belong to it, whichever their own group is.

The estimate of a group is the mean and covariance of the part `ALPHA` of its vectors whose covariance has the least
determinant, sought by concentration steps from three fixed starts: medians with median absolute deviations, mean and covariance of
all, and the covariance of directions from the median.  The part closest by a start's distances gives a mean and covariance, these give
new distances, and so on; no step raises the determinant, and a start is done when it falls by less than `SETTLES` of it.
Of the three ends the one of least determinant is taken.  Equal vectors
count once, so that copies don't pass for a narrow distribution.  Documents beyond the `TAIL` quantile of the
squared Mahalanobis distance are rejected.  All steps are aggregations over the vectors; a step's estimates are a small
written table, one row for each group, so Spark knows its size and broadcasts it or not by its own threshold.

Results for odd input: a null text has no words and fails the base rules; null languages and sources are groups of
their own; repeated rows give equal rows; groups (in the end all documents) with fewer than `LEAST` documents reject none;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole_text, written

WHITE = r"[\x20\x09-\x0D]+"
WINDOW = 8
LEAST = 100
ALPHA = 0.6
SETTLES = 1e-3
SETTLED = 1000
TAIL = 1e-9
#: Standard deviations below which a group's spread is not believed, for each statistic.
FLOORS = (0.012, 0.006, 0.004)
STATISTICS = ("x1", "x2", "x3")
PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


# -- base ----------------------------------------------------------------------------------------


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the statistics x1 to x3."""
    text = whole_text()
    words = docs.select(*keep, text.alias("_text"), F.filter(F.split(text, WHITE), lambda w: w != "").alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = words.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_text", r"[\p{L}\p{M}\p{N}\s]+", "")).cast("long").alias("_marks"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    at = lambda i, k: F.get(F.col("_hashes"), i + k)
    starts = F.sequence(F.lit(0), F.size("_hashes") - WINDOW)
    windows = F.when(F.size("_hashes") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))))
    hashed = counted.select(
        *keep, "n_words", "word_chars", "n_symbols", "_marks",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_hashes")).alias("_distinct"),
        windows.alias("_windows"),
    )
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = hashed.withColumn("_sorted", F.when(again, ordered)).drop("_windows")
    same = lambda x, i, k: F.coalesce(F.get(F.col("_sorted"), i + k)["h"] == x["h"], F.lit(False))
    found = F.sort_array(F.array_compact(F.transform("_sorted", lambda x, i: F.when(same(x, i, -1) | same(x, i, 1), x["i"]))))
    covered = F.aggregate(
        found,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - i)).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    n, chars = F.col("n_words"), F.col("word_chars")
    out = sorted_.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_sorted")
    out = out.withColumn("base_failed", (n < 20) | (100 * F.col("n_repeat_words") > 30 * n))
    return out.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(n > 1, F.log(chars / n)).alias("x1"),
        F.when(n > 1, F.sqrt(F.col("_marks") / chars)).alias("x2"),
        F.when(n > 1, F.log(F.col("_distinct").cast("double")) / F.log(n.cast("double"))).alias("x3"),
    )


# -- estimates -----------------------------------------------------------------------------------


def chi3(x: float) -> float:
    """Chi-squared distribution function with three degrees of freedom."""
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2)


def chi3_quantile(p: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi3(mid) < p else (low, mid)
    return low


def consistency(alpha: float) -> float:
    """What the covariance of the closest part `alpha` of a normal distribution is multiplied by to be that of the whole."""
    q = chi3_quantile(alpha)
    chi5 = chi3(q) - math.sqrt(2 / math.pi) * q**1.5 * math.exp(-q / 2) / 3
    return alpha / chi5


def inverse(c: dict[tuple[int, int], Column]) -> tuple[Column, list[Column]]:
    """The determinant and the inverse of a symmetric 3 by 3 matrix, in the order of PAIRS."""
    m = lambda i, j: c[min(i, j), max(i, j)]
    minor = lambda i, j: m((j + 1) % 3, (i + 1) % 3) * m((j + 2) % 3, (i + 2) % 3) - m((j + 1) % 3, (i + 2) % 3) * m((j + 2) % 3, (i + 1) % 3)
    det = sum(m(0, j) * minor(j, 0) for j in range(3))
    return det, [minor(i, j) / det for i, j in PAIRS]


def distance() -> Column:
    """Squared Mahalanobis distance of u1..u3 by m1..m3 and i00..i22."""
    d = [F.col(f"u{k + 1}") - F.col(f"m{k + 1}") for k in range(3)]
    return sum((F.col(f"i{i}{j}") * d[i] * d[j] * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))


def scaled(rows: DataFrame) -> DataFrame:
    """u1..u3 from x1..x3 and the medians c1..c3."""
    by = F.sqrt(F.col("n_words") / (F.col("n_words") + SETTLED))
    return rows.withColumns({f"u{k}": (F.col(f"x{k}") - F.col(f"c{k}")) * by for k in (1, 2, 3)})


def group_sizes(rows: DataFrame) -> DataFrame:
    """For each language and source of documents that passed the base rules: their group g (null if too few of all), and all the groups
    they count in (`counts_in`).

    A language, or the whole table, is only estimated if a part of it has fewer than LEAST documents and so falls back on it; but
    then over all of its documents.
    """
    sizes = written(rows.filter(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n")), "group-sizes")
    langs = sizes.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    whole = langs.agg(F.sum("n_lang").alias("n_all"), F.min("n_lang").alias("least_lang"))
    both = sizes.join(langs, F.col("lang").eqNullSafe(F.col("_lang"))).crossJoin(F.broadcast(whole))  # one row
    # Nulls are written, so that no source of a language shares the name of the language.
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    own, lang, all_ = F.when(F.col("n") >= LEAST, name("lang", "source")), F.when(F.col("n_lang") >= LEAST, name("lang")), F.when(F.col("n_all") >= LEAST, F.lit("{}"))
    counts_in = F.array_compact(F.array(own, F.when(F.col("least") < LEAST, lang), F.when(F.col("least_lang") < LEAST, all_)))
    return written(both.select("_lang", F.col("source").alias("_source"), F.coalesce(own, lang, all_).alias("g"), counts_in.alias("counts_in")), "groups")


def grouped(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """`rows` with their group as ``g`` and the groups they count in as ``counts_in``."""
    both = rows.join(sizes, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return both.drop("_lang", "_source")


def estimates(rows: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """For each group g with at least LEAST rows: medians c1..c3, mean m1..m3 and inverse covariance i00..i22 of the scaled statistics."""
    us = ("u1", "u2", "u3")
    rows = written(rows.select("g", "n_words", *STATISTICS), "vectors")
    large = rows.groupBy("g").agg(F.count("*").alias("size"), *(F.percentile_approx(x, 0.5, accuracy).alias(f"c{k}") for k, x in enumerate(STATISTICS, 1))).filter(F.col("size") >= LEAST)
    centres = written(large.drop("size"), "centres")
    vectors = scaled(rows.distinct().join(centres, "g")).select("g", *us)
    vectors = written(vectors, "scaled")
    ids = [f"i{i}{j}" for i, j in PAIRS]
    state = written(starts(vectors, us, accuracy), "estimate")
    done = None
    while True:
        # The bound comes with the estimate it was taken by, so that its second use reads and sends one table.
        by = [F.first(c).alias(c) for c in ("before", "m1", "m2", "m3", *ids)]
        far = vectors.join(state, "g").withColumn("d", distance()).groupBy("g", "start")
        bound = written(far.agg(F.percentile_approx("d", ALPHA, accuracy).alias("bound"), *by), "bound")
        near = vectors.join(bound, "g").filter(distance() <= F.col("bound"))
        state = written(shape(near.groupBy("g", "start", "before"), us, consistency(ALPHA)).withColumn("settled", F.coalesce(F.col("det") >= F.col("before") * (1 - SETTLES), F.lit(False))), "estimate")
        ends = state.filter("settled")
        done = ends if done is None else done.unionByName(ends)
        state = state.filter(~F.col("settled")).drop("before").withColumnRenamed("det", "before").drop("settled")
        if state.isEmpty():
            break
    best = done.groupBy("g").agg(F.min_by(F.struct("m1", "m2", "m3", *ids), F.struct("det", "start")).alias("b")).select("g", "b.*")
    return written(centres.join(best, "g"), "estimates")


def shape(groups, us: tuple[str, ...], factor: float) -> DataFrame:
    """Keys of `groups`, mean m1..m3, det and inverse i00..i22 of the covariance times `factor`, with no variance below its floor."""
    spread = groups.agg(*(F.avg(u).alias(f"m{k}") for k, u in enumerate(us, 1)), *(F.covar_pop(us[i], us[j]).alias(f"v{i}{j}") for i, j in PAIRS))
    keys = [c for c in spread.columns if not (c[0] in "mv" and c[1:].isdigit())]
    return spread.select(*keys, "m1", "m2", "m3", *inverted({(i, j): F.col(f"v{i}{j}") * factor for i, j in PAIRS}))


def inverted(c: dict[tuple[int, int], Column]) -> list[Column]:
    det, inv = inverse({(i, j): F.greatest(v, F.lit(FLOORS[i] ** 2)) if i == j else v for (i, j), v in c.items()})
    return [det.alias("det"), *(x.alias(f"i{i}{j}") for x, (i, j) in zip(inv, PAIRS, strict=True))]


def starts(vectors: DataFrame, us: tuple[str, ...], accuracy: int) -> DataFrame:
    """Three estimates for each g: g, start, before (the determinant before, none yet), m1..m3 and i00..i22."""
    spread = written(vectors.groupBy("g").agg(*(F.greatest(F.percentile_approx(F.abs(u), 0.5, accuracy) * 1.4826, F.lit(FLOORS[k])).alias(f"s{k}") for k, u in enumerate(us))), "spread")
    zero = [F.lit(0.0).alias(f"m{k}") for k in (1, 2, 3)]
    deviations = spread.select("g", *zero, *inverted({(i, j): F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0) for i, j in PAIRS}))
    classical = shape(vectors.groupBy("g"), us, 1.0)
    w = [F.col(u) / F.col(f"s{k}") for k, u in enumerate(us)]
    size = sum((x * x for x in w), F.lit(0.0))
    directions = vectors.join(spread, "g").withColumns({f"w{k}": F.when(size > 0, x / F.sqrt(size)).otherwise(0.0) for k, x in enumerate(w)})
    signs = directions.groupBy("g", "s0", "s1", "s2").agg(*(F.avg(F.col(f"w{i}") * F.col(f"w{j}")).alias(f"v{i}{j}") for i, j in PAIRS))
    signs = signs.select("g", *zero, *inverted({(i, j): 3 * F.col(f"v{i}{j}") * F.col(f"s{i}") * F.col(f"s{j}") for i, j in PAIRS}))
    each = [x.select("g", F.lit(k).alias("start"), F.lit(None).cast("double").alias("before"), "m1", "m2", "m3", *(f"i{i}{j}" for i, j in PAIRS)) for k, x in enumerate((deviations, classical, signs))]
    return each[0].unionByName(each[1]).unionByName(each[2])


def fit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups and their estimates of `rows` (of ``statistics`` with lang and source)."""
    sizes = group_sizes(rows)
    members = grouped(rows.filter(~F.col("base_failed")), sizes).drop("g").withColumn("g", F.explode("counts_in"))
    return sizes, estimates(members)


def judged(rows: DataFrame, sizes: DataFrame, of: DataFrame) -> DataFrame:
    """`rows` with ``kept`` and ``distance2``, the squared distance of those that were compared."""
    compared = scaled(grouped(rows, sizes).join(of, "g", "left")).withColumn("distance2", F.when(~F.col("base_failed"), distance()))
    # One comparison: a conjunction would be split, and its base part pushed down to where it repeats all the counting.
    far = F.when(F.col("base_failed"), F.lit(float("inf"))).otherwise(F.coalesce("distance2", F.lit(0.0)))
    kept = far <= chi3_quantile(1 - TAIL)
    return compared.withColumn("kept", kept).drop("g", "counts_in", "c1", "c2", "c3", "u1", "u2", "u3", "m1", "m2", "m3", *(f"i{i}{j}" for i, j in PAIRS))


def kept(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.

    The statistics are taken twice, once for the estimates and once where they judge the row they came from; so no text is moved.
    """
    sizes, of = fit(written(statistics(docs, "lang", "source"), "statistics"))
    rows = statistics(docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang", "source"), "_row", "lang", "source")
    return judged(rows, sizes, of).filter("kept").select("_row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(statistics(documents(spark, sf_dir), "doc_id", "lang", "source"), "statistics")
    return judged(rows, *fit(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
