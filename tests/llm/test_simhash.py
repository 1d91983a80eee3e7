"""Components of the near-duplicates: the work of a step follows its edges."""

import random

import pyarrow as pa

from recollect.llm import simhash


def test_few_edges_are_few_tasks(spark, monkeypatch):
    """A step over few edges is one task and not one for each partition of each shuffle; where they are dealt, the roots are the same."""
    rng = random.Random(3)
    pairs = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(2500)] + [(k, k + 1) for k in range(5000, 5060)]
    least = {k: k for p in pairs for k in p}
    for _ in range(60):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    want = sorted((a, b) for a, b in least.items() if a != b)
    edges, tasks, before = spark.createDataFrame(pairs, "a long, b long"), {}, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for few in (0, 50_000):
            monkeypatch.setattr(simhash, "FEW_EDGES", few)
            spark.sparkContext.setJobGroup(f"few-{few}", "components")
            assert sorted(map(tuple, simhash.components(edges).collect())) == want
            seen = spark.sparkContext.statusTracker()
            stages = {k for job in seen.getJobIdsForGroup(f"few-{few}") for k in seen.getJobInfo(job).stageIds}
            tasks[few] = sum(info.numCompletedTasks for k in stages if (info := seen.getStageInfo(k)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks[50_000] * 3 < tasks[0], tasks


def test_few_edges_are_few_jobs(spark):
    """A chain takes a dozen rounds of stars, each two queries to plan; few edges are tied together in one task, with the same roots."""
    rng = random.Random(7)
    ids = list({rng.randrange(-(2**62), 2**62) for _ in range(3000)})
    pairs = list(zip(ids, ids[1:], strict=False)) + [(5, 5), (7, 6), (6, 7)]
    spark.sparkContext.setJobGroup("chain", "components")
    try:
        got = sorted(map(tuple, simhash.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == sorted([(x, min(ids)) for x in ids if x != min(ids)] + [(7, 6)])
    assert len(jobs) <= 8, len(jobs)
    assert simhash.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_roots_of_batches():
    """Edges that come in portions, in any order and more than once, give the roots of a plain search."""
    for seed in range(50):
        rng = random.Random(seed)
        n = rng.choice([1, 2, 5, 60])
        pairs = [(a, b) for a, b in ((rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(2 * n)) if a != b]
        least = {k: k for p in pairs for k in p}
        for _ in least:
            for a, b in pairs:
                least[a] = least[b] = min(least[a], least[b])
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*pairs[k : k + 7], strict=True)], ["a", "b"]) for k in range(0, len(pairs), 7)]
        found = [row for out in simhash.roots_of(batches) for row in zip(*(c.to_pylist() for c in out.columns), strict=True)]
        assert sorted(found) == sorted((a, b) for a, b in least.items() if a != b)
