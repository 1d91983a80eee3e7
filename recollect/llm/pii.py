"""Operator 10: personal data, and the terms that give it away.

Base spans are emails, IPs, card numbers and phone numbers by pattern.  Their values are the protected entities.
The corpus then tells which words of the texts that hold an entity reveal it.  With document frequencies as probabilities, an
entity e carries IC(e) = -log2 P(e) bits, and a term t reveals PMI(e; t) = log2 (P(e, t) / (P(e) P(t))) of them.  A term
whose part PMI / IC reaches `GENERALISE` is a span of the kind ``term`` wherever it stands in a text that holds that entity: it is
replaced by the kind of entity that it points to (``[EMAIL TERM]``), or removed if the part reaches `REMOVE`.  A pair
must be seen in `SUPPORT` different texts, so that a word of one text (or of its copies) is not taken for a habit; with 1, every pair counts.

An entity of fewer different texts (``rare``) shares all rare words of its one or two texts with them, most of them by chance.  There the unit of co-occurrence
is the sentence: a term that stands in a sentence with the entity, and in no text without it, reveals all of the entity's information as far
as the corpus tells.  As that rests on one or two texts, the part is shrunk by texts / (texts + `SHRINK`): such terms are generalised, not removed.
`coverage` counts the entities of each number of texts, and those with telling terms.

A part of at least `GENERALISE` needs P(t) <= P(e, t) / P(e) * P(e)^GENERALISE <= P(e)^GENERALISE: the term must be rare.  So terms
are counted first, over all texts, and only those that are rare enough for an entity meet it, within the texts that hold the entity.

The patterns never read a character more than a few times: runs are matched possessively and begin where a run begins (or the
last match ended), which gives the same matches as the plain patterns.

Results for odd input: null and empty texts have no spans; copies and repeated rows get equal spans; rows with one
``doc_id`` are told apart by their texts; a null ``doc_id`` is kept; an empty table gives no rows; ``cleaned`` keeps all columns
of its input and changes only texts with spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole_text, written
from .spans import blanked, joined, matches, replaced

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
SHRINK = 0.1
#: Where a sentence ends (before white space) or a line does.
SENTENCE = r"(?<=[.!?])\s|\n"
GENERALISE = 0.85
REMOVE = 0.98
WORD = r"\p{L}{3,}+"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = digits(value)
    digit = lambda i: F.substring(d, F.length(d) - i, F.lit(1)).cast("int")  # noqa: E731  i from the right, from 0
    doubled = lambda i: digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(i)).otherwise(digit(i)))
    return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(False)


def _octets(value: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def _spans(text: Column, kind: str, pattern: str, gate: Column, holds: Callable[[Column], Column]) -> Column:
    kept = F.filter(matches(text, pattern), lambda m: holds(m["value"]))
    spans = F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return F.when(gate, spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) by kind as in KINDS, then by start."""
    digit = text.rlike("[0-9]")
    rules = [
        ("email", EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        ("ip", IP, digit & F.contains(text, F.lit(".")), _octets),
        ("card", CARD, digit, luhn),
        ("phone", PHONE, digit & F.contains(text, F.lit("+")), lambda v: F.length(digits(v)).between(9, 15)),
    ]
    return F.concat(*(_spans(text, *rule) for rule in rules))


def entity(span: Column) -> Column:
    """What a span refers to, in one spelling."""
    return F.concat_ws(":", span["kind"], F.when(span["kind"].isin("card", "phone"), digits(span["value"])).otherwise(F.lower(span["value"])))


def terms_of(text: Column) -> Column:
    """The distinct words of a text, without its email addresses (the other kinds have no letters)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(text, EMAIL, " ")), F.lit(WORD), F.lit(0)))


def _entities(docs: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """The texts with their entities (copies are one row with their number): text, text_hash, entity, copies, n_e, texts; all texts; and their number."""
    rows = docs.select(whole_text().alias("_text")).withColumn("_base", base_spans(F.col("_text")))
    some = F.size("_base") > 0
    entities = F.when(some, F.array_distinct(F.transform("_base", entity)))
    base = written(rows.select(F.xxhash64("_text").alias("text_hash"), entities.alias("entities"), F.when(some, F.col("_text")).alias("text")), "pii-base")
    n = float(base.count())
    there = base.filter("entities IS NOT NULL")
    held = there.select("text_hash", F.explode("entities").alias("entity")).groupBy("entity", "text_hash").agg(F.count("*").alias("copies"))
    sizes = held.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts")).filter(F.col("n_e") < n)
    return written(held.join(sizes, "entity"), "pii-entities"), there.select("text_hash", "text"), n


def _frequent(asked: DataFrame, texts: DataFrame, counts: DataFrame, n: float, support: int) -> DataFrame:
    """entity, term, text_hash, part of the entities and terms that meet in `support` texts or more."""
    asked = asked.filter(F.col("texts") >= support).withColumn("rare", F.pow(F.col("n_e") / n, F.lit(GENERALISE)) * n)
    most = asked.agg(F.max("rare")).first()[0] or 0.0
    seldom = counts.filter((F.col("n_t") >= support) & (F.col("n_t") <= most))
    words = texts.join(asked.select("text_hash").distinct(), "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text_hash", F.explode(terms_of(F.col("text"))).alias("term"))
    pairs = asked.join(words.join(seldom, "term"), "text_hash").filter("n_t <= rare")
    pairs = written(pairs.select("entity", "term", "text_hash", "copies", "n_e", "n_t"), "pii-pairs")
    both = pairs.groupBy("entity", "term", "n_e", "n_t").agg(F.sum("copies").alias("n_et"), F.count("*").alias("texts")).filter(F.col("texts") >= support)
    pmi = F.log2(F.col("n_et") * F.lit(n) / (F.col("n_e") * F.col("n_t")))
    part = pmi / F.log2(F.lit(n) / F.col("n_e"))
    telling = both.withColumn("part", part).filter(F.col("part") >= GENERALISE).select("entity", "term", "part")
    return pairs.select("entity", "term", "text_hash").join(telling, ["entity", "term"])


def _seldom(asked: DataFrame, texts: DataFrame, counts: DataFrame, support: int) -> DataFrame:
    """entity, term, text_hash, part of the entities of fewer texts: terms of their sentences that no text without them has."""
    rare = asked.filter(F.col("texts") < support)
    sentences = texts.join(rare.select("text_hash").distinct(), "text_hash", "left_semi").dropDuplicates(["text_hash"])
    sentences = sentences.select("text_hash", F.explode(F.split("text", SENTENCE)).alias("s")).filter(F.col("s").rlike("[0-9@]"))
    met = sentences.select("text_hash", F.array_distinct(F.transform(base_spans(F.col("s")), entity)).alias("e"), terms_of(F.col("s")).alias("t")).filter("size(e) > 0 AND size(t) > 0")
    pairs = met.select("text_hash", "t", F.explode("e").alias("entity")).select("text_hash", "entity", F.explode("t").alias("term")).distinct()
    pairs = pairs.join(rare, ["entity", "text_hash"])
    alone = pairs.groupBy("entity", "term", "texts").agg(F.sum("copies").alias("n_et")).join(counts, "term").filter("n_et = n_t")
    part = F.col("texts") / (F.col("texts") + SHRINK)
    return pairs.select("entity", "term", "text_hash").join(alone.select("entity", "term", part.alias("part")), ["entity", "term"])


def _telling(docs: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """Entities, and for each telling term of a text: entity, term, text_hash, part."""
    asked, texts, n = _entities(docs)
    # Terms are counted over all texts; every count is kept, as rare entities need the least and frequent ones the greater.
    counts = docs.select(F.explode(terms_of(whole_text())).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    counts = written(counts, "pii-terms")
    return asked, _frequent(asked, texts, counts, n, support).unionByName(_seldom(asked, texts, counts, support))


def telling_terms(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """For each text that has some: text_hash and ``telling``, an array of (term, part, kind), one for each term.

    part is the greatest part of an entity's information that the term reveals, kind that entity's kind.
    """
    _, telling = _telling(docs, support)
    best = F.max(F.struct("part", F.substring_index("entity", ":", 1).alias("kind"))).alias("b")
    each = telling.groupBy("text_hash", "term").agg(best)
    return written(each.groupBy("text_hash").agg(F.sort_array(F.collect_list(F.struct("term", "b.part", "b.kind"))).alias("telling")), "pii-telling")


def coverage(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """texts (the number of different texts that hold an entity), entities, and how many of these have a telling term."""
    asked, telling = _telling(docs, support)
    each = asked.select("entity", "texts").distinct().join(telling.select("entity").distinct().withColumn("told", F.lit(1)), "entity", "left")
    return each.groupBy("texts").agg(F.count("*").alias("entities"), F.count("told").alias("with_terms"))


def marked(rows: DataFrame, support: int = SUPPORT) -> DataFrame:
    """`rows` (which have ``_text``) with ``base``, the base spans, and ``terms``: (start, end, part, points_to) of each place of a telling term."""
    telling = telling_terms(rows.select(F.col("_text").alias("text")), support).withColumnRenamed("text_hash", "_hash")
    both = rows.withColumns({"base": base_spans(F.col("_text")), "_hash": F.xxhash64("_text")}).join(telling, "_hash", "left")
    of = lambda word: F.element_at(F.filter("telling", lambda t: t["term"] == F.lower(word)), 1)
    words = F.filter(matches(blanked(F.col("_text"), EMAIL), WORD), lambda m: F.exists("telling", lambda t: t["term"] == F.lower(m["value"])))
    places = F.transform(words, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), of(m["value"])["part"].alias("part"), of(m["value"])["kind"].alias("points_to")))
    none = F.array().cast("array<struct<start:int,end:int,part:double,points_to:string>>")
    return both.withColumn("terms", F.when(F.col("telling").isNotNull(), places).otherwise(none)).drop("telling", "_hash")


def found(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """doc_id, text_hash, ``base`` and ``terms`` of each row."""
    rows = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("_text")), support)
    return rows.select("doc_id", F.xxhash64("_text").alias("text_hash"), "base", "terms")


def cleaned(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """`docs` with each span in ``text`` replaced: base spans by their kind, terms by the kind that they point to, or by nothing."""
    rows = marked(docs.select(F.struct(*docs.columns).alias("_row"), whole_text().alias("_text")), support)
    named = lambda kind, more: F.concat(F.lit("["), F.upper(kind), F.lit(more))
    label = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), named(s["kind"], "]").alias("label"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["part"] >= REMOVE, F.lit("")).otherwise(named(t["points_to"], " TERM]")).alias("label"))),
    )
    text = F.when(F.size("base") + F.size("terms") > 0, replaced(F.col("_text"), F.array_sort(label))).otherwise(F.col("_row.text"))
    return rows.select(F.col("_row").withField("text", text).alias("_row")).select("_row.*")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    terms = F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return rows.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, terms)).alias("spans"))
