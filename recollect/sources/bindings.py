"""The model's tables, derived from the driver's tables; the same derivations as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.config import CONFIG

SUBJECTS = [CONFIG.owner, *CONFIG.assistants, CONFIG.group]
TYPES = ["semantic", "episodic", "procedural", "preference"]
STANCES = ["own", "disown", "suspend"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def now() -> Column:
    return F.lit(CONFIG.now).cast("timestamp_ntz")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    actor = F.when(F.col("role") == "user", CONFIG.owner).when(F.col("role") == "assistant", CONFIG.assistants[0]).otherwise("system")
    path = F.concat(F.lit("conv:"), F.col("conv_id"))
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, conv_id, 0, turn * 10, 0)")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", actor.alias("actor"), path.alias("path"),
        F.concat(path, F.lit("#msg:"), F.col("turn")).alias("locator"), at.alias("occurred_at"), F.coalesce("text", F.lit("")).alias("content"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said, sentence by sentence: the short facts that similarity is about."""
    parts = F.filter(F.transform(F.split("content", r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: F.length(x) >= 3)
    said = evidence(spark, sf_dir).select("id", "path", "actor", "occurred_at", F.posexplode(parts).alias("k", "content"))
    return said.select((F.col("id") * 1000 + F.col("k") + 1).alias("fact_id"), F.col("id").alias("evidence_id"), "path", F.col("actor").alias("subject"), F.col("occurred_at").alias("valid_from"), "content")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    status = F.when(i % 20 < 14, "candidate").when(i % 20 < 17, "confirmed").when(i % 20 == 17, "superseded").when(i % 20 == 18, "invalid").otherwise("uncertain")
    return d.select(
        i.alias("fact_id"), _pick(SUBJECTS, i % 5).alias("subject"), _pick(TYPES, i % 4).alias("fact_type"), status.alias("status"),
        F.date_sub(F.lit("2024-01-01").cast("date"), (i % 400).cast("int")).cast("timestamp_ntz").alias("valid_from"),
        (i % 37 == 0).alias("pinned"), (i % 11).cast("int").alias("access_count"), F.when(i % 7 == 0, "cold").otherwise("active").alias("layer"),
        (0.3 + 0.1 * (i % 7)).alias("importance"), (0.4 + 0.1 * (i % 6)).alias("confidence"), F.coalesce("text", F.lit("")).alias("content"), "source",
    )


def stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("fact_id"), F.col("event_type").alias("actor"), _pick(STANCES, F.floor("value") % 3).alias("stance"), F.col("ts").alias("created_at"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        (F.col("o_custkey") % 50).alias("subject"), F.col("l_returnflag").alias("key"), F.col("l_linestatus").alias("value"), F.col("l_suppkey").alias("root"),
        F.to_date("o_orderdate").alias("day"), F.when(F.col("l_linenumber") == 1, 1.0).otherwise(1 / 3).alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fact_id"), F.col("embedding").alias("vec"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new: an order and the next one of the same customer."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_orderkey").alias("old_id"), F.lead("o_orderkey").over(w).alias("new_id"), F.col("o_custkey").alias("subject"), F.lead("o_orderdate").over(w).alias("marked_at")).filter("new_id IS NOT NULL")


def _case(values: list[str], index: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


SQL = {
    "evidence": f"""SELECT conv_id * 1000 + turn AS id, conv_id, turn, CASE role WHEN 'user' THEN '{CONFIG.owner}' WHEN 'assistant' THEN '{CONFIG.assistants[0]}' ELSE 'system' END AS actor,
        'conv:' || conv_id AS path, 'conv:' || conv_id || '#msg:' || turn AS locator,
        TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(conv_id AS INTEGER)) + to_minutes(turn * 10) AS occurred_at, coalesce(text, '') AS content FROM conversations""",
    "facts": f"""SELECT doc_id AS fact_id, {_case(SUBJECTS, "doc_id % 5")} AS subject, {_case(TYPES, "doc_id % 4")} AS fact_type,
        CASE WHEN doc_id % 20 < 14 THEN 'candidate' WHEN doc_id % 20 < 17 THEN 'confirmed' WHEN doc_id % 20 = 17 THEN 'superseded' WHEN doc_id % 20 = 18 THEN 'invalid' ELSE 'uncertain' END AS status,
        TIMESTAMP '2024-01-01 00:00:00' - to_days(CAST(doc_id % 400 AS INTEGER)) AS valid_from, doc_id % 37 = 0 AS pinned, CAST(doc_id % 11 AS INTEGER) AS access_count,
        CASE WHEN doc_id % 7 = 0 THEN 'cold' ELSE 'active' END AS layer, 0.3::DOUBLE + 0.1::DOUBLE * (doc_id % 7) AS importance, 0.4::DOUBLE + 0.1::DOUBLE * (doc_id % 6) AS confidence,
        coalesce(text, '') AS content, source FROM documents""",
    "stances": f"SELECT event_id AS id, user_id AS fact_id, event_type AS actor, {_case(STANCES, 'CAST(floor(value) AS BIGINT) % 3')} AS stance, ts AS created_at FROM events",
    "votes": """SELECT o_custkey % 50 AS subject, l_returnflag AS key, l_linestatus AS value, l_suppkey AS root, CAST(o_orderdate AS DATE) AS day,
        CASE WHEN l_linenumber = 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / 3 END AS weight, l_orderkey * 10 + l_linenumber AS fact_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "vectors": "SELECT vec_id AS fact_id, embedding AS vec FROM embeddings",
    "marks": """SELECT * FROM (SELECT o_orderkey AS old_id, lead(o_orderkey) OVER w AS new_id, o_custkey AS subject, lead(o_orderdate) OVER w AS marked_at
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE new_id IS NOT NULL""",
    "statements": """SELECT id * 1000 + r.i AS fact_id, id AS evidence_id, path, actor AS subject, occurred_at AS valid_from, parts[r.i] AS content
        FROM (SELECT *, list_filter(list_transform(string_split_regex(content, '[.!?\\n]+'), lambda x: trim(x)), lambda x: length(x) >= 3) AS parts FROM evidence) p, LATERAL (SELECT unnest(range(1, len(p.parts) + 1)) AS i) r""",
    "live": f"SELECT * FROM facts WHERE status IN {CONFIG.live}",
}
_NEEDS = {"live": ["facts"], "statements": ["evidence"]}


def with_tables(*names: str, then: str) -> str:
    """SQL with the named tables as common table expressions."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + ("," if then.lstrip().lower().startswith("with ") else "") + " " + (then.lstrip()[5:] if then.lstrip().lower().startswith("with ") else then)
