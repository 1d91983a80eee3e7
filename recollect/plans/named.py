"""Queries about names in what was said, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.operators import names
from recollect.plans.queries import _values, query
from recollect.sources import bindings as B

#: Words of the conversations that stand for names; one has a parent, and one word says that a text is about somewhere else.
ALIASES = [("the", "The"), ("of", "Of"), ("and", "And"), ("thean", "The"), ("ti", "Ti"), ("erhe", "Of")]
PARENTS = [("Ti", "The")]
FOREIGN = ["shth"]


def _aliases(spark):
    return spark.createDataFrame(ALIASES, "alias string, name string")


@query("name_mentions", B.with_tables("evidence", then=f"""WITH a(alias, name) AS {_values(ALIASES)}, w AS (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS alias FROM evidence)
    SELECT id, name, count(*) AS n FROM w JOIN a USING (alias) GROUP BY ALL"""))  # fmt: skip
def name_mentions(spark, d):
    found = names.mentions(B.evidence(spark, d).select("id", "content"), _aliases(spark))
    return found.groupBy("id", "name").agg(F.count("*").alias("n"))


@query("supported_names")
def supported_names(spark, d):
    """Whether the turn before supports the names in a turn, and the one before that as its context."""
    w = Window.partitionBy("path").orderBy("turn")
    rows = B.evidence(spark, d).select("id", "content", F.lag("content").over(w).alias("source"), F.lag("content", 2).over(w).alias("context"), F.lit("the").alias("subject"), F.col("actor"))
    out = names.supported(rows, _aliases(spark), spark.createDataFrame(PARENTS, "name string, parent string"), FOREIGN)
    return out.select("id", "verdict", F.array_join("names", ",").alias("names"))
