"""Operator 5: shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has `nodes` places on a ring of 64-bit hashes; a row belongs to the next place clockwise from the hash of its
``doc_id``.  The load of a shard is bounded by its capacity, and the capacities are as equal as whole rows allow, so
the law ``rows`` holds: counts differ by one at most.  A shard with more rows than it can hold keeps an equal
portion of each of its arcs; the last rows of each arc go on clockwise to the next place whose shard has room.
Only rows beyond a capacity move, which is as few as can be, and a change of the number of shards moves only the
rows of the changed arcs and of the overflow.

Nothing is ranked in one task: rows are dealt by ranges of their hash and numbered within the sorted
ranges; a row's rank on the ring is the size of the ranges before it plus its number.  The rows of each arc are counted, and
the plan is made from these counts alone (one for each place on the ring, whatever the size of the table).

Results for odd input: a null text has size 1 and checksum 0; null ``doc_id`` rows share a hash like any repeated key;
rows of one key are split between shards where a capacity ends; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, whole_text, written

NODES = 64
#: Upper bits of a hash by which a row finds the few arcs that it can lie in.
LOOKUP_BITS = 12
ROW_BITS = 33  # of monotonically_increasing_id(): the number within a partition


@dataclass
class Arc:
    """Hashes from `low` to `high`, both included, which belong to `shard`."""

    low: int
    high: int
    shard: int


def ring(spark: SparkSession, shards: int, nodes: int = NODES) -> list[Arc]:
    """The arcs in ring order, from the least hash on; the last one wraps round to the first place."""
    places = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("node"))
    rows = places.select("shard", F.xxhash64(F.lit("place"), "shard", "node").alias("at")).orderBy("at", "shard").collect()  # shards x nodes rows
    arcs, low = [], -(2**63)
    for row in rows:
        if row["at"] >= low:
            arcs.append(Arc(low, row["at"], row["shard"]))
            low = row["at"] + 1
    if low < 2**63:
        arcs.append(Arc(low, 2**63 - 1, arcs[0].shard))
    return arcs


def plan(arcs: list[Arc], counts: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where the rows of each arc go, by their rank within it."""
    want = [0] * shards
    for arc, n in zip(arcs, counts, strict=True):
        want[arc.shard] += n
    least, more = divmod(sum(counts), shards)
    capacity = [least] * shards
    for s in sorted(range(shards), key=lambda s: (-want[s], s))[:more]:
        capacity[s] += 1
    keep = [n * capacity[a.shard] // want[a.shard] if want[a.shard] > capacity[a.shard] else n for a, n in zip(arcs, counts, strict=True)]
    spare = list(capacity)
    for a, n in zip(arcs, keep, strict=True):
        spare[a.shard] -= n
    for k, a in enumerate(arcs):  # what rounding down left
        if want[a.shard] > capacity[a.shard] and (more := min(spare[a.shard], counts[k] - keep[k])):
            keep[k] += more
            spare[a.shard] -= more
    slots, out = [0] * shards, []

    def send(k, first, n, s):
        out.append((k, first, first + n, s, slots[s]))
        slots[s] += n

    for k, a in enumerate(arcs):
        if keep[k]:
            send(k, 0, keep[k], a.shard)
    for k in range(len(arcs)):
        rank, j = keep[k], k
        while rank < counts[k]:
            j = (j + 1) % len(arcs)
            s = arcs[j].shard
            if n := min(spare[s], counts[k] - rank):
                send(k, rank, n, s)
                spare[s] -= n
                rank += n
    return out


def assign(docs: DataFrame, shards: int, nodes: int = NODES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and home_shard (the shard it would have without bounds)."""
    spark = docs.sparkSession
    arcs = ring(spark, shards, nodes)
    lookup = [(b, k, a.low, a.high, a.shard) for k, a in enumerate(arcs) for b in range(a.low >> 64 - LOOKUP_BITS, (a.high >> 64 - LOOKUP_BITS) + 1)]
    table = spark.createDataFrame(lookup, "bucket long, arc int, low long, high long, home_shard int")  # at most places + 2^LOOKUP_BITS rows
    bytes_ = F.encode(whole_text(), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(bytes_) + 1).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"))
    rows = rows.withColumn("hash", F.xxhash64("doc_id")).withColumn("bucket", F.shiftright("hash", 64 - LOOKUP_BITS))
    rows = rows.join(F.broadcast(table), (rows["bucket"] == table["bucket"]) & F.col("hash").between(F.col("low"), F.col("high")))
    rows = rows.select("doc_id", "size", "text_crc32", "hash", "arc", "home_shard", F.monotonically_increasing_id().alias("tie"))
    order = ["hash", "doc_id", "text_crc32", "tie"]
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "hash").withColumn("id", F.monotonically_increasing_id()), "ring")
    placed = placed.withColumns({"range": F.shiftright("id", ROW_BITS), "number": F.col("id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))})
    # A row for each range and for each arc that begins within it.
    parts = written(placed.groupBy("range", "arc").agg(F.count("*").alias("n")), "ring-counts")
    sizes = parts.groupBy("range").agg(F.sum("n").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    found = {r["arc"]: r["n"] for r in parts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # at most one row for each place on the ring
    counts = [found.get(k, 0) for k in range(len(arcs))]
    start, at = [], 0
    for n in counts:
        start.append(at)
        at += n
    moves = [(k, start[k] + a, start[k] + b, s, slot) for k, a, b, s, slot in plan(arcs, counts, shards)]
    to = spark.createDataFrame(moves, "arc int, first long, end long, shard int, first_slot long")
    ranked = placed.join(before, "range").withColumn("rank", F.col("before") + F.col("number"))
    return ranked.join(F.broadcast(to), "arc").filter("rank >= first AND rank < end").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - F.col("first")).alias("slot"), "home_shard"
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign(documents(spark, sf_dir), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
