"""Reading chat transcripts (JSON lines), exported conversations and digests into evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "type string, timestamp string, isMeta boolean, isSidechain boolean, message struct<role string, content string>"
BLOCKS = "array<struct<type: string, text: string, name: string, input: struct<text: string>>>"
EXPORT = "array<struct<uuid string, name string, chat_messages array<struct<uuid string, sender string, text string, created_at string>>>>"


def parsed(lines: DataFrame) -> DataFrame:
    """path, line, role, body and ts of each spoken record; lines: path, line, value.  Meta and side records, and bad JSON, are left out.

    A message is text or blocks; text blocks and the text that a tool is given count, thoughts do not.
    """
    rows = lines.withColumn("r", F.from_json("value", RECORD)).filter(F.col("r").isNotNull())
    rows = rows.filter(~F.coalesce(F.col("r.isMeta"), F.lit(False)) & ~F.coalesce(F.col("r.isSidechain"), F.lit(False)))
    content = F.col("r.message.content")
    blocks = F.from_json(content, BLOCKS)
    said = F.filter(F.transform(blocks, lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_use", b["input"]["text"])), lambda t: t.isNotNull())
    body = F.when(F.ltrim(content).startswith("["), F.coalesce(F.array_join(said, "\n"), content)).otherwise(content)
    return rows.select("path", "line", F.col("r.message.role").alias("role"), F.trim(body).alias("body"), F.to_timestamp("r.timestamp").alias("ts")).filter(F.length("body") > 0)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, line (from 1) and value of each line of the files; a file is numbered by its reader, so files are the unit of work."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\n")).alias("line", "value")).withColumn("line", F.col("line") + 1).filter(F.length("value") > 0)


CHANNEL = r"(?s)<channel\s+([^>]*)>(.*?)(?:</channel>|\z)"
#: Beginnings of texts that a program puts into a user's turn, and what stands for an attachment (of the transcripts' format).
NOT_SPOKEN = ("This session is being continued", "<command", "<local-command", "Caveat:", "[Request interrupted", "<system-reminder", "<task-notification")
ATTACHED = r"\((?:Images? also|Files) saved locally[^)]*\)|\[Image: [^\]]*\]"


def blocks(message: Column) -> Column:
    """Array of (sender_id, sender, ts, body) of the channel blocks of a message, in order; one that is never closed reaches to the end."""
    attribute = lambda attrs, name: F.nullif(F.regexp_extract(attrs, rf'(?<!\w){name}="([^"]*)"', 1), F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(message, F.lit(CHANNEL), F.lit(1)).alias("a"), F.regexp_extract_all(message, F.lit(CHANNEL), F.lit(2)).alias("b"))
    return F.transform(both, lambda x: F.struct(attribute(x["a"], "user_id").alias("sender_id"), attribute(x["a"], "user").alias("sender"), attribute(x["a"], "ts").alias("ts"), F.trim(F.regexp_replace(x["b"], r"^\s+|\s+$", "")).alias("body")))


def sender_of(sender_id: Column, sender: Column, by_id: dict[str, str], by_name: dict[str, str]) -> Column:
    """The actor of a sender by id or by name, null where neither is known or the two disagree; a name of digits alone is an id."""
    look = lambda known, key: F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), key) if known else F.lit(None).cast("string")
    first = F.coalesce(look(by_id, F.trim(sender_id)), F.when(sender.rlike(r"^\s*[0-9]+\s*$"), look(by_id, F.trim(sender))))
    second = look(by_name, F.trim(sender))
    return F.when(first.isNotNull() & second.isNotNull() & (first != second), None).otherwise(F.coalesce(first, second))


def first_words(lines: DataFrame) -> DataFrame:
    """path and the first text of a user in it."""
    order = "line" if "line" in lines.columns else "position"
    return _records(lines, order).filter("role = 'user' AND trim(text) <> ''").groupBy("path").agg(F.min_by("text", order).alias("first"))


def background(lines: DataFrame, header: str) -> DataFrame:
    """path of the sessions whose first words of the user begin with `header`: tasks that a program has set."""
    return first_words(lines).filter(F.ltrim("first").startswith(header)).select("path")


def _records(lines: DataFrame, order: str) -> DataFrame:
    """path, line or position, role, text (of a user: all text blocks), parts (of an assistant), stamp, aside."""
    rows = lines.withColumn("r", F.from_json("value", RECORD)).filter(F.col("r.message").isNotNull())
    content = F.col("r.message.content")
    parts = F.when(F.ltrim(content).startswith("["), F.from_json(content, BLOCKS))
    text = F.when(parts.isNull(), content).otherwise(F.array_join(F.filter(F.transform(parts, lambda b: F.when(b["type"] == "text", b["text"])), lambda t: t.isNotNull()), "\n"))
    aside = F.coalesce(F.col("r.isMeta"), F.lit(False)) | F.coalesce(F.col("r.isSidechain"), F.lit(False))
    return rows.select("path", order, F.col("r.message.role").alias("role"), text.alias("text"), parts.alias("parts"), F.col("r.timestamp").alias("stamp"), aside.alias("aside"))


def harvested(lines: DataFrame, header: str, by_id: dict[str, str], by_name: dict[str, str], owner: str, assistant: str, reply: str = "reply", least: int = 8, tasks: DataFrame | None = None) -> DataFrame:
    """What was said, a row for each channel block: path, line (or position), part, actor, body, ts; actor is null for an unknown sender.

    A user's message is channel blocks, each of its own sender, or else words of the owner; those that a program has put there, asides and tasks
    (`background`) are left out, and so are attachments.  An assistant says what it gives to a tool whose name has `reply` in it, and texts of `least`
    characters or more, as one row each; blocks that stand there are no messages.  Thoughts are not said.  `tasks` (path) says which sessions are tasks
    where `lines` are only a part of them.
    """
    order = "line" if "line" in lines.columns else "position"
    rows = _records(lines, order)
    stamp = F.to_timestamp("stamp")
    found = rows.filter("role = 'user'").withColumn("blocks", blocks(F.col("text")))
    sent = found.select("path", order, F.posexplode("blocks").alias("part", "b"), stamp.alias("ts"))
    sent = sent.filter((F.col("b.body") != "") & ~F.col("b.body").rlike(r"^\s*<[^>]+>\s*$"))
    sent = sent.select("path", order, "part", sender_of(F.col("b.sender_id"), F.col("b.sender"), by_id, by_name).alias("actor"), F.col("b.body").alias("body"), F.coalesce(F.to_timestamp("b.ts"), "ts").alias("ts"))
    begins = lambda c, some: F.coalesce(*[F.when(c.startswith(x), True) for x in some], F.lit(False))
    plain = found.filter((F.size("blocks") == 0) & ~F.col("aside") & ~begins(F.ltrim("text"), NOT_SPOKEN)).join(background(lines, header) if tasks is None else tasks, "path", "left_anti")
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ATTACHED, ""), r"\n{2,}", "\n"), r"^\s+|\s+$", ""))
    plain = plain.select("path", order, F.lit(0).alias("part"), F.lit(owner).alias("actor"), body.alias("body"), stamp.alias("ts")).filter("body <> ''")
    own = rows.filter("role = 'assistant'").select("path", order, F.posexplode("parts").alias("part", "b"), stamp.alias("ts"))
    said = F.when((F.col("b.type") == "tool_use") & F.contains("b.name", F.lit(reply)), F.col("b.input.text")).when(F.col("b.type") == "text", F.col("b.text"))
    own = own.select("path", order, "part", F.lit(assistant).alias("actor"), F.regexp_replace(said, r"^\s+|\s+$", "").alias("body"), "ts", F.col("b.type").alias("type"))
    own = own.filter((F.length("body") > 0) & ((F.col("type") == "tool_use") | (F.length("body") >= least))).drop("type")
    return sent.unionByName(plain).unionByName(own)


def windowed(spark: SparkSession, path: str, since: Column, until: Column, roles: list[str]) -> DataFrame:
    """What known roles said in the transcripts from `since` up to, but not at, `until`, in order."""
    rows = parsed(read_lines(spark, path))
    return rows.filter((F.col("ts") >= since) & (F.col("ts") < until) & F.col("role").isin(*roles)).orderBy("ts", "path", "line")


def exported(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """locator, role, body and ts of the messages of the named conversations in an export."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", EXPORT)).alias("c")).filter(F.col("c.name").isin(*names))
    rows = whole.select("c.uuid", F.explode("c.chat_messages").alias("m"))
    return rows.select(F.concat(F.lit("conv:"), "uuid", F.lit("#msg:"), "m.uuid").alias("locator"), F.col("m.sender").alias("role"), F.col("m.text").alias("body"), F.to_timestamp("m.created_at").alias("ts"))


BULLET = r"^\s*[-*]\s+(.*?)\s*\(lines?\s+(\d+)(?:-(\d+))?\)\s*$"


def digest(lines: DataFrame) -> DataFrame:
    """path, statement, low and high of the bullets ``- statement (lines 3-7)``."""
    part = lambda k: F.regexp_extract("value", BULLET, k)
    rows = lines.filter(F.col("value").rlike(BULLET))
    low = part(2).cast("int")
    return rows.select("path", part(1).alias("statement"), low.alias("low"), F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), low).alias("high"))


def located(quotes: DataFrame, lines: DataFrame, width: int = 64) -> DataFrame:
    """Each quote (path, quote, low, high) with the first line in its range that contains it.

    Ranges and lines meet on a block of `width` lines, so this is an equi-join however long the files are.
    """
    block = lambda c: F.floor(F.col(c) / width)
    asked = quotes.withColumn("block", F.explode(F.sequence(block("low"), block("high"))))
    met = asked.join(lines.select("path", "line", "body").withColumn("block", block("line")), ["path", "block"])
    hits = met.filter(F.col("line").between(F.col("low"), F.col("high")) & F.contains("body", F.col("quote")))
    first = hits.groupBy("path", "quote", "low", "high").agg(F.min("line").alias("line"))
    return quotes.join(first, ["path", "quote", "low", "high"], "left")


def speaker(sender_id: Column, name: Column, known: dict[str, str]) -> Column:
    """The actor of a sender when id and name agree, else null; known: id to name."""
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv)) if known else F.create_map().cast("map<string,string>")
    return F.when(F.element_at(table, sender_id) == name, name)
