"""A persisted inverted index over words and runs of characters, and the searches that read only a part of it.

The index is a folder of Parquet tables, to which batches of facts are appended:

* ``lengths``: fact_id, words (the length of a fact in words), block;
* ``words`` and ``runs``: for a term and a block of facts one row with the facts that hold it, in the order of their ids: ids, and for words how often
  (tfs) and their lengths (lens); ``most`` and ``shortest`` bound what any fact of the block can score.  Runs are those of 2, 3 and 4 characters;
* ``batches``: the batches that are whole.  What a broken run has left is not read.

A block holds facts of about the same length, some `BLOCK` of them, so a frequent term is spread over many rows, and bounds of blocks differ: `bm25` reads the
most promising blocks of a query first, and then only those that can still beat what it has found.  A substring is found by its rarest run: facts
that hold it are looked at, whatever the other runs hold.  Questions and terms meet the index by equi-joins; nothing is broadcast without a bound.

Results for odd input: null and empty texts have no postings and a length of 0; a fact that is appended again under a batch number that is there is
left out; equal ids of one batch count once; terms of no character find nothing; a term of one character is looked for in the texts themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.config import CONFIG, Config
from recollect.functions import text
from recollect.operators import recall
from recollect.operators.graphs import saved
from recollect.operators.recall import small, tokens

BLOCK = 1024
#: Blocks that one task of a batch makes.
TOGETHER = 8
RUNS = (2, 3, 4)
K1, B = 1.2, 0.75
#: Blocks of a query that are read before the bounds are compared.
FIRST = 4


def append(facts: DataFrame, path: str, batch: int) -> None:
    """Adds `facts` (fact_id, content) to the index at `path` as a batch; a batch that is there already is left as it is."""
    spark = facts.sparkSession
    if _batches(spark, path).filter(F.col("batch") == batch).limit(1).count():
        return
    part = f"batch={batch}"
    low = F.lower(F.coalesce("content", F.lit("")))
    # Facts of one band of lengths are dealt to as many blocks as they need; a band is a doubling of the length.
    rows = facts.select("fact_id", low.alias("low")).dropDuplicates(["fact_id"]).withColumn("len", F.size(tokens(F.col("low"))))
    rows = saved(rows.withColumn("band", F.when(F.col("len") == 0, 0).otherwise(F.floor(F.log2("len")) + 1).cast("int")))
    sizes = saved(rows.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))  # some thirty rows
    placed = rows.join(F.broadcast(sizes), "band").select("fact_id", "low", "len", F.struct("band", F.pmod(F.xxhash64("fact_id"), F.col("parts")).cast("int").alias("part")).alias("block"))
    placed.select("fact_id", F.col("len").alias("words"), "block").write.mode("overwrite").parquet(f"{path}/lengths/{part}")
    # Texts move to the tasks of their blocks; terms are made and gathered there, so that no posting is shuffled.
    blocks = sizes.agg(F.sum("parts")).first()[0] or 1
    placed = placed.repartition(max(min(blocks, spark.sparkContext.defaultParallelism), -(-blocks // TOGETHER)), "block")
    counted = placed.select("block", "fact_id", "len", F.explode(tokens(F.col("low"))).alias("term")).groupBy("block", "term", "fact_id", "len").agg(F.count("*").cast("int").alias("tf"))
    posting = F.array_sort(F.collect_list(F.struct("fact_id", "tf", "len"))).alias("p")
    words = counted.groupBy("block", "term").agg(posting, F.count("*").alias("n"), F.max("tf").alias("most"), F.min("len").alias("shortest"))
    words.select("term", "block", "n", "most", "shortest", F.col("p.fact_id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/words/{part}")
    runs = placed.select("block", "fact_id", F.explode(F.array_distinct(F.concat(*(text.windows(F.col("low"), n) for n in RUNS)))).alias("term"))
    runs = runs.groupBy("block", "term").agg(F.array_sort(F.collect_list("fact_id")).alias("ids"), F.count("*").alias("n"))
    runs.select("term", "block", "ids", "n").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/runs/{part}")
    spark.range(1).select(F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(f"{path}/batches")


def _batches(spark: SparkSession, path: str) -> DataFrame:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batches")
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema("batch long").parquet(f"{path}/batches").distinct() if there else spark.createDataFrame([], "batch long")


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the index: the rows of whole batches."""
    whole = sorted(r["batch"] for r in _batches(spark, path).collect())  # a number for each batch
    if not whole:
        raise ValueError(f"there is no index at {path}")
    return spark.read.option("basePath", f"{path}/{name}").parquet(*(f"{path}/{name}/batch={b}" for b in whole))


def frequency(spark: SparkSession, path: str, terms: DataFrame, name: str = "words") -> DataFrame:
    """term and df of the words, or runs, that are in the index."""
    return table(spark, path, name).select("term", "n").join(small(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))


def _part(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25(spark: SparkSession, path: str, terms: DataFrame, k: int = 10, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(query_id, fact_id, score, rank) and what was read for it: (query_id, blocks, read), the blocks with a word of the query and those that were opened."""
    asked = terms.select("query_id", "term").distinct()
    size = table(spark, path, "lengths").agg(F.count("*").alias("n_facts"), F.avg("words").alias("mean"))  # one row
    index = table(spark, path, "words")
    met = index.select("term", "block", "batch", "n", "most", "shortest").join(asked, "term")
    df = met.select("term", "block", "batch", "n").distinct().groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.col("n_facts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = saved(asked.join(df, "term").join(F.broadcast(size), F.lit(True)).select("query_id", "term", idf.alias("idf"), "mean"))
    bounds = met.select("query_id", "term", "block", "batch", "most", "shortest").join(weights, ["query_id", "term"])
    bounds = bounds.groupBy("query_id", "block", "batch").agg(F.sum(F.col("idf") * _part(F.col("most"), F.col("shortest"), F.col("mean"))).alias("bound"))
    w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "batch", "block")
    bounds = saved(bounds.withColumn("place", F.row_number().over(w)))

    def scored(blocks: DataFrame) -> DataFrame:
        """The facts of the chosen blocks (query_id, block, batch), with their scores."""
        wanted = small(saved(blocks.join(weights, "query_id")))
        opened = index.join(wanted, ["term", "block", "batch"]).select("query_id", "idf", "mean", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p"))
        return opened.groupBy("query_id", F.col("p.ids").alias("fact_id")).agg(F.round(F.sum(F.col("idf") * _part(F.col("p.tfs"), F.col("p.lens"), F.col("mean"))), 6).alias("score"))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "fact_id")
    start = saved(scored(bounds.filter(F.col("place") <= first)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
    least = start.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    more = saved(bounds.filter(F.col("place") > first).join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") + 1e-6 >= F.col("least"))).select("query_id", "block", "batch"))
    both = start.drop("rank").unionByName(scored(more)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    read = bounds.groupBy("query_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("place") <= first).alias("at_first"))
    read = read.join(more.groupBy("query_id").agg(F.count("*").alias("later")), "query_id", "left")
    return both, read.select("query_id", "blocks", (F.col("at_first") + F.coalesce("later", F.lit(0))).alias("read"))


def containing(spark: SparkSession, path: str, facts: DataFrame, terms: DataFrame) -> DataFrame:
    """term and fact_id for each term (distinct rows, column term) and fact whose lower-case text holds it, by the term's rarest run."""
    low = F.lower(F.coalesce("content", F.lit("")))
    longest = F.least(F.length("term"), F.lit(max(RUNS)))
    asked = saved(terms.select("term").distinct())
    several = asked.filter(F.length("term") >= min(RUNS))
    starts = F.sequence(F.lit(1), F.length("term") - longest + 1)
    cut = saved(several.select("term", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("term"), i, longest)))).alias("run")))
    df = frequency(spark, path, cut.select(F.col("run").alias("term")), "runs")
    each = cut.join(df.withColumnRenamed("term", "run"), "run", "left")
    # A run that no fact has makes its term unfindable; else the rarest is looked up.
    rarest = saved(each.groupBy("term").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "run")).alias("r")).filter("r.df > 0").select("term", F.col("r.run").alias("run")))
    lists = table(spark, path, "runs").select(F.col("term").alias("run"), "ids")
    found = lambda some: lists.join(small(some), "run").select("term", F.explode("ids").alias("fact_id"))
    exact = found(rarest.filter(F.length("term") <= max(RUNS)))
    near = small(saved(found(rarest.filter(F.length("term") > max(RUNS)))))
    look = facts.select("fact_id", low.alias("low")).join(near, "fact_id").filter(F.contains("low", F.col("term"))).select("term", "fact_id")
    both = exact.unionByName(look)
    single = asked.filter(F.length("term") == 1)
    if single.isEmpty():
        return both
    return both.unionByName(recall.containing(facts.select("fact_id", low.alias("low")).filter("low <> ''"), single, "fact_id", "low").select("term", "fact_id"))


def forms(term: Column) -> Column:
    """The ways to write a term: itself, and if it is not plain ASCII its runs of 4, 3 and 2 characters, in order."""
    def runs_of(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(term) - n + 1), lambda i: F.substring(term, i, F.lit(n)))
        return F.when(F.length(term) > n, cut).otherwise(F.array().cast("array<string>"))

    runs = F.concat(*map(runs_of, sorted(RUNS, reverse=True)))
    whole = F.array(term)
    return F.filter(F.when(term.rlike(r"^[\x00-\x7F]*$"), whole).otherwise(F.array_distinct(F.concat(whole, runs))), lambda f: F.length(f) >= 2)


def usable_forms(spark: SparkSession, path: str, facts: DataFrame, terms: DataFrame, most: int = 3, config: Config = CONFIG) -> DataFrame:
    """query_id, term, form, df, place: the rarest forms of each term that 1 to `too_common` facts hold, longer first among equals; terms: query_id, term."""
    each = terms.select("query_id", "term").distinct().withColumn("form", F.explode(forms(F.col("term"))))
    held = containing(spark, path, facts, each.select(F.col("form").alias("term"))).groupBy(F.col("term").alias("form")).agg(F.count("*").alias("df"))
    w = Window.partitionBy("query_id", "term").orderBy("df", F.desc(F.length("form")), "form")
    return each.join(held.filter(F.col("df") <= config.too_common), "form").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("query_id", "term", "form", "df", "place")


def rarest_first(used: DataFrame, terms: DataFrame, most: int | None = None) -> DataFrame:
    """query_id, term_rank, term (its best form) of the terms to search by: rarest first, absent ones last and those of two ideographs dropped."""
    best = used.filter("place = 1").select("query_id", "term", "form", "df")
    both = terms.select("query_id", "term").distinct().join(best, ["query_id", "term"], "left").withColumns({"form": F.coalesce("form", "term"), "df": F.coalesce("df", F.lit(0))})
    both = both.filter((F.col("df") > 0) | ~F.col("term").rlike(r"^[\x{4E00}-\x{9FFF}]{2}$"))
    w = Window.partitionBy("query_id").orderBy(F.col("df") == 0, "df", F.desc(F.length("form")), "form")
    ranked = both.withColumn("term_rank", F.row_number().over(w))
    return (ranked.filter(F.col("term_rank") <= most) if most else ranked).select("query_id", "term_rank", F.col("form").alias("term"), F.col("term").alias("whole"))


def probe(spark: SparkSession, path: str, facts: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """query_id, layer, term_rank, fact_id, score: for each term and layer the `limit` facts that hold it, by activation, cold ones halved.

    A term of more than three characters that no fact of a layer holds is tried in its usable forms, twice `limit` facts in all.  facts: fact_id, content,
    layer_of (the layer it is in; one fact may be in several), act, layer.
    """
    config = CONFIG
    texts = facts.select("fact_id", "content").dropDuplicates(["fact_id"])
    score = F.col("act") * F.when(F.col("layer") == "cold", config.cold_factor).otherwise(1.0)
    each = facts.select("fact_id", F.col("layer_of").alias("stage"), F.round(score, 6).alias("score"))
    w = Window.partitionBy("query_id", "stage", "term_rank", "form_rank").orderBy(F.desc("score"), "fact_id")
    best = lambda df: saved(df.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit))
    found = best(containing(spark, path, texts, terms).join(small(terms), "term").join(each, "fact_id").select("query_id", "stage", "term_rank", "term", F.lit(0).alias("form_rank"), "fact_id", "score"))
    # Terms that a stage does not hold, by their forms.
    stages = saved(facts.select(F.col("layer_of").alias("stage")).distinct())
    long_terms = terms.filter(F.length("term") > 3)
    open_ = saved(long_terms.join(F.broadcast(stages), F.lit(True)).join(found.select("query_id", "term", "stage").distinct(), ["query_id", "term", "stage"], "left_anti"))  # stages are a fixed few
    used = usable_forms(spark, path, texts, open_)
    wider = saved(open_.join(used.select("query_id", "term", "form", F.col("place").alias("form_rank")), ["query_id", "term"]))
    other = containing(spark, path, texts, wider.select(F.col("form").alias("term"))).withColumnRenamed("term", "form")
    more = best(other.join(small(wider), "form").join(each, ["fact_id", "stage"]).select("query_id", "stage", "term_rank", "term", "form_rank", "fact_id", "score"))
    both = found.unionByName(more)
    once = both.groupBy("query_id", "stage", "term_rank", "fact_id", "score").agg(F.min(F.struct("form_rank", "n")).alias("o"))
    w = Window.partitionBy("query_id", "stage", "term_rank").orderBy("o", "fact_id")
    return once.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= 2 * limit).select("query_id", "stage", "term_rank", "fact_id", "score", "n")


def layered(probed: DataFrame, order: list[str], cap: int = 12, empty: int = 2) -> DataFrame:
    """query_id, rank, fact_id, stage, term_rank: stage after stage until `cap` facts are found or `empty` stages in a row gave none; what the rarest term
    found comes first, then by score.  A fact belongs to the first stage, and there to the rarest term, that finds it."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("stage"))
    first = probed.withColumn("at", place).filter("at > 0").groupBy("query_id", "fact_id").agg(F.min(F.struct("at", "term_rank", "stage", "score")).alias("f")).select("query_id", "fact_id", "f.*")
    each = first.groupBy("query_id", "at").agg(F.count("*").alias("new"))
    stages = first.select("query_id").distinct().withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(len(order))))).join(each, ["query_id", "at"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    above = Window.partitionBy("query_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("query_id").orderBy("at").rowsBetween(-empty, -1)
    stop = (F.coalesce(F.sum("new").over(above), F.lit(0)) >= cap) | ((F.count("*").over(last) == empty) & (F.sum("new").over(last) == 0))
    reached = stages.withColumn("stop", stop).withColumn("stopped", F.max("stop").over(Window.partitionBy("query_id").orderBy("at"))).filter("NOT stopped").select("query_id", "at")
    w = Window.partitionBy("query_id").orderBy("term_rank", F.desc("score"), "fact_id")
    return first.join(reached, ["query_id", "at"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap).select("query_id", "rank", "fact_id", "stage", "term_rank")
