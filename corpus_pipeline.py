"""A pipeline over ``documents``: quality rules, language ID, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents``.

Results for odd input: null and empty texts fail the quality rules; without labelled rows the language stage keeps all texts with a letter; of rows
that are equal in ``doc_id`` and text one stays; ``n_chars`` is set anew after personal data is gone, if there is such a column and it was not null; an
empty table gives no rows; further columns go through all stages but the last unchanged, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import langid, packing, pii, quality, simhash
from recollect.llm.common import documents, few_rows_a_batch, written

#: Score of language ID below which a document goes.
SURE = 0.5
#: Candidates for near-duplicates: one of five fingerprints (of pairs of words and distinct words) within four bits, 155 covering tables.
PRINTS, RADIUS = 5, 4
#: A link then needs this Jaccard similarity of the sets of five-word shingles.
SIMILAR = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are outliers of their language and source, go."""
    return quality.kept(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or whose language is unsure, go.  Without a labelled row there is nothing to judge by: all with a letter stay."""
    few_rows_a_batch(spark)
    model = langid.fit(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rest = [c for c in docs.columns if c != "text"]
    found = langid.predict(docs.select(F.struct(*rest).alias("_row"), "text"), model, ("_row", "text"))
    kept = found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= SURE))
    return kept.select(*(F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (verified by their five-word shingles) stays."""
    few_rows_a_batch(spark)
    return simhash.kept_similar(docs, PRINTS, RADIUS, SIMILAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; terms that give it away are generalised or removed."""
    clean = pii.cleaned(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    few_rows_a_batch(spark)
    return packing.pieces(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", sequences),
]
#: SQL has neither the estimates nor the tokenizer: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
