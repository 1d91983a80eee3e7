"""Sessions, windows over turns, chunks and temporal joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.config import CONFIG, Config
from recollect.operators import graphs


def context_window(evidence: DataFrame, before: int = 8, after: int = 8) -> DataFrame:
    """Each line with the ids of those around it in its session."""
    w = Window.partitionBy("path").orderBy("occurred_at", "id").rowsBetween(-before, after)
    return evidence.select("id", "path", F.collect_list("id").over(w).alias("around"))


def without_repeats(evidence: DataFrame, seconds: int) -> DataFrame:
    """Turns without those that repeat the last *kept* turn of their session (same speaker and text) within `seconds` of it.

    Turns that repeat each other stand in one run.  The turn kept after a kept one is the first of the run beyond its `seconds`, which a range of
    the run's times finds for every turn; which turns are reached from the first of the run is followed by doubling, so a run of n turns takes log n steps.
    A null speaker or text repeats nothing.
    """
    us = F.unix_micros(F.col("occurred_at").cast("timestamp"))
    w = Window.partitionBy("path").orderBy("occurred_at", "id")
    same = (F.lag("actor").over(w) == F.col("actor")) & (F.lag("content").over(w) == F.col("content"))
    rows = evidence.withColumns({"_us": us, "_new": F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)})
    rows = rows.withColumn("_run", F.sum("_new").over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("path", "_run")))
    rows = graphs.saved(rows)
    times = rows.filter("_n > 1").groupBy("path", "_run", "_us").agg(F.min("id").alias("_first"))
    beyond = Window.partitionBy("path", "_run").orderBy("_us").rangeBetween(seconds * 1_000_000 + 1, Window.unboundedFollowing)
    steps = graphs.saved(times.withColumn("_to", F.min("_us").over(beyond)))
    kept = graphs.saved(steps.groupBy("path", "_run").agg(F.min("_us").alias("_us")))
    jumps = steps.select("path", "_run", "_us", "_to").filter("_to IS NOT NULL")
    while True:
        more = kept.join(jumps, ["path", "_run", "_us"]).select("path", "_run", F.col("_to").alias("_us"))
        both = graphs.saved(kept.unionByName(more).distinct())
        if both.count() == kept.count():
            break
        far = jumps.select("path", "_run", F.col("_us").alias("_to"), F.col("_to").alias("_far"))
        kept, jumps = both, graphs.saved(jumps.join(far, ["path", "_run", "_to"]).select("path", "_run", "_us", F.col("_far").alias("_to")))
    ids = kept.join(steps, ["path", "_run", "_us"]).select("path", "_run", F.col("_first").alias("id"))
    long = rows.filter("_n > 1").join(ids, ["path", "_run", "id"], "left_semi")
    return rows.filter("_n = 1").unionByName(long).select(*evidence.columns)


def greedy_chunks(evidence: DataFrame, budget: int = CONFIG.chunk_chars) -> DataFrame:
    """(id, path, chunk): a new chunk begins where the running size would pass the budget.

    The counter starts anew at each chunk, so lines are read in order; a task holds one batch of them and the counter, however long a session is.
    """

    def cut(batches):
        path, chunk, size = None, 0, 0
        for rows in batches:
            out = []
            for p, n in zip(rows["path"], rows["n"], strict=True):
                if p != path:
                    path, chunk, size = p, 0, 0
                elif size and size + n > budget:
                    chunk, size = chunk + 1, 0
                size += n
                out.append(chunk)
            yield pd.DataFrame({"id": rows["id"], "path": rows["path"], "chunk": out})

    sized = evidence.select("id", "path", F.col("occurred_at").cast("timestamp").alias("occurred_at"), F.length("content").alias("n"))
    return sized.repartition("path").sortWithinPartitions("path", "occurred_at", "id").mapInPandas(cut, "id long, path string, chunk int")


def due_sessions(pending: DataFrame, now: Column, config: Config = CONFIG) -> DataFrame:
    """(session, n, first, last, state): idle or capped sessions are due, but not within the settling time.  pending: session, ts."""
    each = pending.groupBy("session").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    passed = lambda c: (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(c).cast("timestamp"))) / F.lit(60_000_000.0)
    state = (
        F.when(passed("last") >= config.idle_minutes, "idle")
        .when(passed("last") < config.settle_minutes, "settling")
        .when((F.col("n") >= config.cap_messages) | (passed("first") >= config.cap_hours * 60), "capped")
        .otherwise("waiting")
    )
    return each.withColumn("state", state)


#: Facts that ask in one task, fewer where a subject is small, and facts that they meet there.
ASKING, LEAST, SPREAD, OFFERED = 131_072, 2048, 16, 262_144
_BEST = "unit long, later_id long, at long, shared int"


def _micros(facts: DataFrame, column: str) -> Column:
    """A moment as a number; one without a time zone by its own days and hours, whatever the session's zone."""
    if facts.schema[column].dataType.simpleString() != "timestamp_ntz":
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.expr(f"(unix_date(CAST({column} AS DATE)) * 86400L + hour({column}) * 3600 + minute({column}) * 60) * 1000000L + CAST(extract(SECOND FROM {column}) * 1000000 AS LONG)")


def _best(shared: int, gap: int, keep: int):
    """For one tile the best `keep` later facts of each fact that asks.  Counts of shared words are held for one fact at a time."""

    def best(tile: pa.Table) -> pa.Table:
        ids, at, asks = (tile.column(c).to_numpy() for c in ("id", "at", "asks"))
        lists = tile.column("words").combine_chunks()
        flat, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        offered = np.flatnonzero(~asks)
        offered = offered[np.lexsort((ids[offered], -at[offered]))]  # the newest first, as ties are decided
        n = size[offered]
        known, code = np.unique(flat[np.arange(n.sum()) + np.repeat(ends[offered] - np.cumsum(n) + n, n)], return_inverse=True)
        holders = np.repeat(np.arange(len(offered)), n)[np.argsort(code, kind="stable")]
        begin = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(known)))])
        counts = np.zeros(len(offered), np.uint8 if size.max(initial=0) < 256 else np.int32)
        asking = np.flatnonzero(asks) if len(known) else np.zeros(0, int)
        out = []
        for row, cut in zip(asking, np.searchsorted(-at[offered], -(at[asking] + gap)), strict=True):  # `cut` of them are late enough
            words = flat[ends[row] : ends[row + 1]]
            c = np.minimum(known.searchsorted(words), len(known) - 1)
            c = c[known[c] == words]
            if not cut or len(c) < shared:
                continue
            counts.fill(0)
            for x in c.tolist():
                counts[holders[begin[x] : begin[x + 1]]] += 1
            who = np.flatnonzero(counts[:cut] >= shared)
            if len(who) > keep:
                who = who[np.argpartition(who - counts[who].astype(np.int64) * len(offered), keep - 1)[:keep]]
            out.append((np.full(len(who), ids[row]), who, counts[who]))
        unit, who, n = (np.concatenate([x[c] for x in out]) if out else np.zeros(0, np.int64) for c in range(3))
        return pa.table({"unit": pa.array(unit, pa.int64()), "later_id": pa.array(ids[offered[who]], pa.int64()), "at": pa.array(at[offered[who]], pa.int64()), "shared": pa.array(n.astype(np.int32))})

    return best


def later_siblings(facts: DataFrame, shared: int = 3, hours: int = 12, keep: int = 5) -> DataFrame:
    """(fact_id, later_id, shared, place): later facts on the same subject that share at least so many words; facts: fact_id, subject, valid_from, words.

    Facts with one set of words and one time ask once, and of the facts with one set only the newest `keep` can be among the best of any fact.
    Nearly every two facts share a word, so no pairs are written: facts are dealt to blocks by their times, and blocks of those that ask and of those
    they may find meet in tiles, each in one task, which gives the best `keep` of each fact in it.  Work is quadratic in a subject; rows moved are
    facts times blocks, and a block is large.
    """
    rows = facts.filter(F.col("subject").isNotNull() & F.col("valid_from").isNotNull()).select(F.col("fact_id").alias("id"), "subject", "words", _micros(facts, "valid_from").alias("at"))
    rows = graphs.saved(rows.filter(F.size("words") >= shared).withColumn("words", F.array_sort(F.transform("words", lambda w: F.xxhash64(w)))))
    units = graphs.saved(rows.groupBy("subject", "words", "at").agg(F.min("id").alias("unit")))
    first = Window.partitionBy("subject", "words").orderBy(F.desc("at"), "id")
    offered = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= keep).drop("n")
    asks = _dealt(units.withColumnRenamed("unit", "id"), F.least(F.lit(ASKING), F.greatest(F.lit(LEAST), F.ceil(F.col("all") / SPREAD))))
    offered = _dealt(offered, F.lit(OFFERED))
    gap = hours * 3_600_000_000
    i = asks.groupBy("subject", F.col("part").alias("i")).agg(F.min("at").alias("low"))
    j = offered.groupBy("subject", F.col("part").alias("j")).agg(F.max("at").alias("high"))
    tiles = graphs.saved(i.join(j, "subject").filter(F.col("high") > F.col("low") + gap).select("subject", "i", "j"))
    placed = lambda rows, side, mine: rows.join(tiles.withColumn("part", F.col(side)), ["subject", "part"]).select("subject", "i", "j", "id", "at", "words", F.lit(mine).alias("asks"))
    best = placed(asks, "i", True).unionByName(placed(offered, "j", False)).groupBy("subject", "i", "j").applyInArrow(_best(shared, gap, keep), _BEST)
    w = Window.partitionBy("unit").orderBy(F.desc("shared"), F.desc("at"), "later_id")
    best = best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep).drop("at")
    of = rows.join(units, ["subject", "words", "at"]).select(F.col("id").alias("fact_id"), "unit")
    return of.join(best, "unit").select("fact_id", "later_id", F.col("shared").cast("long").alias("shared"), "place")


def _dealt(rows: DataFrame, block: Column) -> DataFrame:
    """`rows` with the ``part`` of their subject that they are in, about `block` of them by their times; `block` sees ``all``, the size of the subject.

    How many there are of each time gives every row a place in the order of times, ties by chance, without a sort of all.
    """
    times = rows.groupBy("subject", "at").agg(F.count("*").alias("n"))
    before, whole = Window.partitionBy("subject").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("subject")
    times = times.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "all": F.sum("n").over(whole)}).withColumn("block", block)
    part = F.floor((F.col("before") + F.pmod(F.xxhash64("id"), F.col("n"))) / F.col("block")).cast("int")
    return graphs.saved(rows.join(times, ["subject", "at"]).select("id", "subject", "words", "at", part.alias("part")))


def timeline_candidates(facts: DataFrame, per_term: int = 4, keep: int = 6) -> DataFrame:
    """(fact_id, earlier_id, place): facts of the subject from an earlier day that share a keyword, newest first; facts: fact_id, subject, valid_from, words.

    For each subject, word and day the newest facts of the days before are gathered by a window over days, so facts never meet facts.
    """
    at = ["subject", "g"]
    g = graphs.saved(facts.select("fact_id", "subject", F.to_date("valid_from").alias("day"), F.explode("words").alias("g")))
    of_day = Window.partitionBy(*at, "day").orderBy(F.desc("fact_id"))
    some = g.withColumn("n", F.row_number().over(of_day)).filter(F.col("n") <= per_term)
    days = some.groupBy(*at, "day").agg(F.sort_array(F.collect_list(F.struct("day", "fact_id")), asc=False).alias("own"))  # at most per_term
    before = F.collect_list("own").over(Window.partitionBy(*at).orderBy("day").rowsBetween(-per_term, -1))
    days = days.withColumn("earlier", F.slice(F.sort_array(F.flatten(before), asc=False), 1, per_term)).filter(F.size("earlier") > 0).drop("own")
    found = g.join(days, [*at, "day"]).select("fact_id", F.explode("earlier").alias("e")).select("fact_id", F.col("e.fact_id").alias("earlier_id"), F.col("e.day").alias("day")).distinct()
    w = Window.partitionBy("fact_id").orderBy(F.desc("day"), F.desc("earlier_id"))
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep).select("fact_id", "earlier_id", "place")
