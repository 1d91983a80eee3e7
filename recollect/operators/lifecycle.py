"""Append-only state: facts keep their meaning, a log of versions holds their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.config import CONFIG, Config


def current(log: DataFrame, key: str = "fact_id") -> DataFrame:
    """The latest version of each key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col("version")).alias("s")).select(key, "s.*")


def change(log: DataFrame, changes: DataFrame, now: Column, **values: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to append, changes that came too late).  changes: fact_id and expected (version); only those that match the log are made."""
    state = current(log)
    both = state.join(changes.select("fact_id", "expected"), "fact_id")
    good = both.filter("version = expected").drop("expected")
    late = both.filter("version <> expected").select("fact_id", "expected", "version")
    return good.withColumns({"version": F.col("version") + 1, "updated_at": now, **values}).select(*log.columns), late


def pin(log: DataFrame, changes: DataFrame, now: Column, on: bool = True):
    return change(log, changes, now, user_pinned=F.lit(on))


def confirm(log: DataFrame, changes: DataFrame, now: Column):
    return change(log, changes, now, status=F.lit("confirmed"))


def supersede(log: DataFrame, changes: DataFrame, now: Column, hard: bool = False):
    """Refused unless `hard`: pipelines only write soft marks."""
    if not hard:
        raise ValueError("superseding a fact needs hard=True")
    return change(log, changes, now, status=F.lit("superseded"), valid_to=now)


def invalidate(log: DataFrame, changes: DataFrame, now: Column, hard: bool = False):
    if not hard:
        raise ValueError("invalidating a fact needs hard=True")
    return change(log, changes, now, status=F.lit("invalid"), valid_to=now)


def touch(log: DataFrame, changes: DataFrame, now: Column):
    return change(log, changes, now, access_count=F.col("access_count") + 1, last_accessed=now)


def migrated(facts: DataFrame, config: Config = CONFIG) -> DataFrame:
    """facts with new_layer: active ones below the lower bound go cold, cold ones above the upper come back; pinned ones stay."""
    new = F.when(F.col("pinned"), F.col("layer")).when((F.col("layer") == "active") & (F.col("act") < config.cold_below), "cold").when((F.col("layer") == "cold") & (F.col("act") >= config.active_from), "active")
    return facts.withColumn("new_layer", F.coalesce(new, F.col("layer")))


def appended(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """The rows of `new` that `old` doesn't have yet, each once: what to append."""
    return new.dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti")


def bounded(rows: DataFrame, bounds: dict[str, int]) -> DataFrame:
    """rows (session, kind, id, updated_at) with status: the newest of each kind stay open, the rest are evicted."""
    w = Window.partitionBy("session", "kind").orderBy(F.desc("updated_at"), F.desc("id"))
    bound = F.element_at(F.create_map(*(F.lit(x) for kv in bounds.items() for x in kv)), F.col("kind"))
    return rows.withColumn("status", F.when(F.row_number().over(w) <= F.coalesce(bound, F.lit(0)), "open").otherwise("evicted"))


def bin_listing(archive: DataFrame, restored: DataFrame, now: Column, config: Config = CONFIG) -> DataFrame:
    """(batch_id, in_bin, restored, state); archive: batch_id, fact_id, opened_at; restored: batch_id, fact_id."""
    back = archive.join(restored.withColumn("back", F.lit(True)), ["batch_id", "fact_id"], "left")
    out = back.groupBy("batch_id").agg(F.count_if(F.col("back").isNull()).alias("in_bin"), F.count_if("back").alias("restored"), F.max("opened_at").alias("opened_at"))
    expired = F.col("opened_at") + F.make_interval(days=F.lit(config.bin_days)) < now
    return out.withColumn("state", F.when(F.col("in_bin") == 0, "restored").when(expired, "expired").otherwise("open")).drop("opened_at")


def quota_picks(rows: DataFrame, stratum: str, total: int) -> DataFrame:
    """A proportional pick of each stratum, in the order of a hash of the id: the same for every run."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    all_ = sizes.agg(F.sum("n").alias("all"))
    quota = sizes.join(F.broadcast(all_), F.lit(True)).select(stratum, F.floor(F.lit(total) * F.col("n") / F.col("all")).alias("quota"))
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.col("id").cast("string"), 256), "id")
    return rows.join(quota, stratum).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= F.col("quota")).select(stratum, "id", "place")


def put(rows: DataFrame, new: DataFrame) -> DataFrame:
    """The open working set with new entries: one of the same session, kind and content is renewed instead of kept twice.

    Both: session, kind, content, id, confidence, created_at, updated_at.
    """
    both = rows.unionByName(new)
    return both.groupBy("session", "kind", "content").agg(F.min("id").alias("id"), F.max("confidence").alias("confidence"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def closed(rows: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """rows (id, status, ...) with the open ones that `done` (id, to: done, dropped or evicted) names closed; others stay as they are."""
    to = done.filter(F.col("to").isin("done", "dropped", "evicted"))
    both = rows.join(to, "id", "left")
    on = (F.col("status") == "open") & F.col("to").isNotNull()
    return both.withColumns({"status": F.when(on, F.col("to")).otherwise(F.col("status")), "closed_at": F.when(on, now).otherwise(F.lit(None))}).drop("to")


def deleted(state: DataFrame, picks: DataFrame, now: Column, config: Config = CONFIG) -> tuple[DataFrame, DataFrame]:
    """(rows for the archive, rows for the state log) of facts put into the bin; pinned ones are refused.

    state: fact_id, version, status, layer, user_pinned; picks: fact_id, batch_id, category.
    """
    hit = state.join(picks, "fact_id").filter("NOT user_pinned")
    archive = hit.select("fact_id", "batch_id", "category", F.col("status").alias("prev_status"), F.col("layer").alias("prev_layer"), F.col("version").alias("prev_version"), F.lit("archived").alias("action"), now.alias("archived_at"))
    gone = F.when(F.col("status").isin(*config.live), "invalid").otherwise(F.col("status"))
    return archive, hit.select("fact_id", (F.col("version") + 1).alias("version"), gone.alias("status"), F.lit("cold").alias("layer"), "user_pinned")


def restored(state: DataFrame, archive: DataFrame, batch: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows for the archive, rows for the state log) that bring a batch back as it was; what is back already is left out."""
    mine = archive.filter(F.col("batch_id") == batch)
    out = mine.filter("action = 'archived'").join(mine.filter("action = 'restored'").select("fact_id"), "fact_id", "left_anti")
    back = out.select("fact_id", "batch_id", "category", "prev_status", "prev_layer", "prev_version", F.lit("restored").alias("action"), now.alias("archived_at"))
    rows = state.join(out.select("fact_id", "prev_status", "prev_layer"), "fact_id")
    return back, rows.select("fact_id", (F.col("version") + 1).alias("version"), F.col("prev_status").alias("status"), F.coalesce("prev_layer", "layer").alias("layer"), "user_pinned")
