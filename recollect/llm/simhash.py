"""Operator 9: SimHash near-duplicates, found by covering locality-sensitive hashing.

Every bit position i gets a nonzero vector m(i) of r + 1 bits, and every nonzero vector v of r + 1 bits gives a
table whose mask keeps the positions with an odd number of common ones in m(i) and v.  The vectors of any r positions
span less than the whole space, so some v is orthogonal to all of them: two fingerprints that differ in at
most r bits agree under that mask.  Hence every such pair meets in one of the 2^(r+1) - 1 tables (15 for
r = 3, each keeping about half of the 64 bits) and no pair is lost.

Equal fingerprints are one node, so groups of copies cost nothing.  The first few tables are searched before the others, and
their components name the nodes: later, a bucket whose nodes all bear one name is passed over, so that a large family costs no
edges in each table.  Within a bucket a search from node to node (`forest`) finds a spanning forest of the links and not
all pairs.  Buckets of more than `TILE` nodes are dealt to parts (`linked`): every part also gets the few hubs of its bucket,
which ties a family together whatever its size, and then only the nodes outside the largest component are compared with other
parts.  Components come from alternating large and small stars.

``kept`` can also ask for a similarity of shingle sets (`similar_groups`): fingerprints find the candidates, and texts
of one component of candidates are compared by their sets, again from node to node and in parts.

Results for odd input: null and empty texts, and those of white space alone, have fingerprint zero and are linked like
others; fewer than three words are one shingle; repeated rows and ties give one row each, in the same component; a null
``doc_id`` is kept and counts as the largest; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, documents, whole_text, written
from .segments import slices

SEED = 42
BITS = 64
#: Nodes of a bucket that one task compares; larger buckets are dealt to parts.
TILE = 4096
#: Nodes of a divided bucket that every part of it gets, on average.
HUBS = 32
#: Shingles of a root that one task compares (8 bytes each).
SHINGLES = 1 << 20
LAST = 2**63 - 1  # stands for a null doc_id


def masks(radius: int = 3) -> list[int]:
    """The covering masks, as signed 64-bit numbers.

    The vectors of the positions are distinct as far as there are enough, and spread over all dimensions (the fairest of a few
    fixed shuffles), so that each mask keeps about half of the bits.
    """
    span = 1 << (radius + 1)
    fairest: tuple[int, list[int]] = (BITS + 1, [])
    for seed in range(16):
        vectors = np.random.RandomState(seed).permutation(np.arange(1, span))
        of = np.resize(vectors, BITS)
        odd = np.bitwise_count(of[None] & np.arange(1, span)[:, None]).astype(int) % 2
        uneven = int(np.abs(2 * odd.sum(axis=1) - BITS).max())
        if uneven < fairest[0]:
            fairest = uneven, [sum(1 << i for i in np.flatnonzero(row).tolist()) for row in odd]
    return [m - (1 << 64) if m >> 63 else m for m in fairest[1]]


# -- fingerprints --------------------------------------------------------------------------------


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and ASCII white space


def shingles(words: list[bytes], width: int) -> list[bytes] | Iterator[bytes]:
    """All runs of so many words, repeats included; fewer words are one run."""
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return map(b" ".join, zip(*(words[j:] for j in range(width)), strict=False))


def hashed(features) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(x, SEED) for x in features), np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a row of hash functions, from the values of the first (k = 0)."""
    if k == 0:
        return h
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


#: For each byte a word of eight counts, the k-th of which is its bit k.
_LANES = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(k) & np.uint64(1)) << np.uint64(8 * k) for k in range(8)), np.zeros(256, np.uint64))


def majority(hashes: list[np.ndarray], count: int = 1, portion: int = 300_000) -> np.ndarray:
    """`count` fingerprints for each array of hashes, as int64: a bit is 1 if it is in more than half of them."""
    ones = np.zeros((len(hashes), count, BITS), np.int64)
    held: list[tuple[int, np.ndarray]] = []

    def add():
        # Eight counts of a byte's bits go into one word, which holds at most 255 hashes; so texts are summed in pieces.
        sizes = [len(x) for _, x in held]
        joined = np.concatenate([x for _, x in held])
        owners = np.repeat([k for k, _ in held], [-(-n // 255) for n in sizes])
        starts = np.concatenate([np.arange(at, at + n, 255) for at, n in zip(np.cumsum([0, *sizes[:-1]]).tolist(), sizes, strict=True)])
        first = np.flatnonzero(np.diff(owners, prepend=-1))
        for j in range(count):
            words = _LANES[mixed(joined, j).astype("<u8").view(np.uint8).reshape(-1, 8)]
            pieces = np.add.reduceat(words, starts, axis=0).astype("<u8").view(np.uint8).reshape(len(starts), BITS)
            np.add.at(ones, (owners[first], j), np.add.reduceat(pieces, first, axis=0, dtype=np.int64))
        held.clear()

    size = 0
    for k, h in enumerate(hashes):
        for at in range(0, len(h), portion):
            held.append((k, h[at : at + portion]))
            size += len(held[-1][1])
            if size >= portion:
                add()
                size = 0
    if held:
        add()
    total = np.array([len(h) for h in hashes], np.int64)
    set_ = ones * 2 > total[:, None, None]
    return np.packbits(set_, axis=2, bitorder="little").reshape(len(hashes), -1).view("<i8").reshape(len(hashes), count)


def _printed(docs: DataFrame, features: Callable[[list[bytes]], np.ndarray], count: int) -> DataFrame:
    names = [f"fp{j}" for j in range(count)]

    def run(batches):
        for batch in slices(batches):
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            prints, n = majority([features(w) for w in words], count), pa.array([len(w) for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n, *(pa.array(prints[:, j]) for j in range(count))], ["doc_id", "text_hash", "n_words", *names])

    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_words long, " + ", ".join(f"{n} long" for n in names))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text, to tell rows of one doc_id apart) and fp, of all shingles of `width` words."""
    return _printed(docs, lambda words: hashed(shingles(words, width)), 1).select("doc_id", "text_hash", F.col("fp0").alias("fp"))


def several_fingerprints(docs: DataFrame, count: int) -> DataFrame:
    """doc_id, text_hash and fp0, fp1, ...: fingerprints by independent hash functions of all pairs of words and each distinct word.

    An edit changes few of these, so similar texts stay close; pairs of words keep long unrelated texts of one language apart.
    """
    return _printed(docs, lambda words: np.concatenate([hashed(set(words)), hashed(shingles(words, 2))]), count)


# -- links ---------------------------------------------------------------------------------------


def forest(label: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (label, label) that tie together what `near` links, directly or by others; rows of equal label are tied already.

    `near(x, others)` tells which of the rows `others` are linked to row x.  The search goes from row to row and compares each only
    with rows not reached yet, so that a dense family needs few comparisons.
    """
    left = np.argsort(label, kind="stable")
    a, b = [], []
    while len(left):
        first = label[left[0]]
        same = label[left] == first
        stack, left = left[same].tolist(), left[~same]
        while stack and len(left):
            hit = near(stack.pop(), left)
            if hit.any():
                reached = np.unique(label[left[hit]])
                a += [first] * len(reached)
                b += reached.tolist()
                along = np.isin(label[left], reached)
                stack += left[along].tolist()
                left = left[~along]
    return np.array(a, np.int64), np.array(b, np.int64)


def runs_of(batches, keys: int, most: float = float("inf")) -> Iterator[tuple[pa.Table, np.ndarray | None]]:
    """The record batches, sorted by their first `keys` columns, as tables of whole runs and the place where each run begins.

    Of a run of more than `most` rows portions are handed on as they come, with None for the places.
    """
    rest, over = None, None
    key = lambda table, at: tuple(table.column(k)[at].as_py() for k in range(keys))
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        for k in range(keys):
            c = table.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        starts, rest = np.concatenate([[0], np.flatnonzero(new)]), None
        if over is not None and key(table, 0) == over:
            end = int(starts[1]) if len(starts) > 1 else table.num_rows
            yield table.slice(0, end), None
            table, starts = table.slice(end), starts[1:] - end
            if not table.num_rows:
                continue
        over, last = None, int(starts[-1])
        if last:
            yield table.slice(0, last), starts[:-1]
        table = table.slice(last)
        if table.num_rows > most:
            yield table, None
            over = key(table, 0)
        else:
            rest = table
    if rest is not None:
        yield rest, np.array([0])


def tied_in(table: pa.Table, starts: np.ndarray, near_of: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all runs of a table with the column ``name``; `near_of(table)` makes the test of a run."""
    names = table.column("name").to_numpy()
    ends = np.append(starts[1:], len(names))
    several = (ends - starts > 1) & (np.minimum.reduceat(names, starts) != np.maximum.reduceat(names, starts))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, e in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
        x, y = forest(names[s:e], near_of(table.slice(s, e - s)))
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def linked(rows: DataFrame, near_of: Callable, hubs: int = HUBS) -> DataFrame:
    """Edges (a, b) of names that tie together all linked rows of a group.

    rows: g, parts (into how many the group is dealt), name, and what `near_of` looks at in the column ``held``.  Every part gets its rows and
    the hubs of its group.  Where a group is more than one component after that, the rows outside its largest one are compared with
    all parts; so every pair is tested that nothing ties together yet.
    """

    def of(keys):
        def run(batches):
            for table, starts in runs_of(batches, keys):
                a, b = tied_in(table, starts, near_of)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        return run

    def tested(tiles, *keys):
        return tiles.select(*keys, "name", "held").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(of(len(keys)), "a long, b long")

    part = F.pmod(F.xxhash64(F.lit("part"), "held"), F.col("parts")).cast("int")
    all_parts = F.sequence(F.lit(0), F.col("parts") - 1)
    large = rows.filter("parts > 1")
    sizes = large.groupBy("g").agg(F.count("*").alias("n"))
    hub = large.join(sizes, "g").filter(F.pmod(F.xxhash64(F.lit("hub"), "held"), F.col("n")) < hubs).withColumn("part", F.explode(all_parts))
    first = tested(rows.withColumn("part", part).unionByName(hub.drop("n")), "g", "part")
    if large.isEmpty():
        return first
    edges = written(first, "tied-in-parts")
    roots = components(edges, "tied-in-parts")
    named = large.join(roots.select(F.col("a").alias("name"), "root"), "name", "left").withColumn("name", F.coalesce("root", "name")).drop("root")
    each = named.groupBy("g", "parts", "name").agg(F.count("*").alias("n"))
    open_ = each.groupBy("g", "parts").agg(F.max_by("name", F.struct("n", "name")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("n")).filter("n > most")
    blocks = F.ceil(F.col("parts") * (F.col("n") - F.col("most")) / F.col("n")).cast("int")
    open_ = written(open_.select("g", "major", blocks.alias("blocks")), "open-groups")
    there = named.join(open_, "g").withColumn("part", part)
    minor = there.filter("name != major").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "held"), F.col("blocks")).cast("int")).withColumn("part", F.explode(all_parts))
    whole = there.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return edges.union(tested(whole.unionByName(minor), "g", "part", "block"))


#: Edges that one task ties together at once; more are taken through steps over all tasks.  A step is two queries of some ten stages, which the driver plans and keeps account of.
FEW_EDGES = 50_000


def roots_of(batches) -> Iterator[pa.RecordBatch]:
    """(a, root) as `components`, of edges (a, b) that are all in `batches`: the greater root of an edge is hung on the lesser one until no edge has two."""
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    ends = np.concatenate([np.zeros(0, np.int64), *(x for pair in zip(*held, strict=True) for x in pair)])
    nodes, codes = np.unique(ends, return_inverse=True)
    label, (u, v) = np.arange(len(nodes)), codes.reshape(2, -1)
    while len(u):
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label = label[label]
        u, v = label[u], label[v]
        u, v = u[u != v], v[u != v]
    under = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[under]), pa.array(nodes[label[under]])], ["a", "root"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, root) for every node that is not itself the least of its component; edges: (a, b), in any direction.

    Large star: the greater neighbours of a node are tied to the least neighbour.  Small star: the lesser ones are.  The
    tables of each step are written to the shared folder, so that lineage stays short.  At most `FEW_EDGES` are tied together in one task.
    """
    edges = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    sign, n = None, edges.count()
    while n > FEW_EDGES:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        tied = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = written(tied.filter("a != b").distinct(), name)
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == sign:
            break
        sign, n = tuple(row), row[0]
    if not n or n > FEW_EDGES:
        return edges.select("a", F.col("b").alias("root"))
    return written(edges.coalesce(1).mapInArrow(roots_of, "a long, root long"), name)


def families(nodes: DataFrame, prints: tuple[str, ...] = ("fp",), radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, root) as `components`, of nodes of which some fingerprint differs in at most `radius` bits; nodes: a, each once, and `prints`."""

    def near_of(table: pa.Table):
        fp = table.column("held").to_numpy()
        return lambda x, others: np.bitwise_count(fp[others] ^ fp[x]) <= radius

    def run(batches):
        for table, starts in runs_of(batches, 1, tile):
            if starts is None:
                yield pa.RecordBatch.from_arrays([table.column(k).combine_chunks() for k in (0, 1, 2)], ["a", "b", "fp"])
                continue
            fp, names = table.column("held").to_numpy(), table.column("name").to_numpy()
            sizes = np.diff(np.append(starts, len(fp)))
            two = starts[sizes == 2]
            two = two[(np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius) & (names[two] != names[two + 1])]
            more = starts[sizes > 2]
            picked = np.repeat(sizes > 2, sizes)
            a, b = tied_in(table.filter(pa.array(picked)).combine_chunks(), np.cumsum(sizes[sizes > 2]) - sizes[sizes > 2], near_of) if len(more) else (names[:0], names[:0])
            a, b = np.concatenate([names[two], a]), np.concatenate([names[two + 1], b])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "fp"])

    found = masks(radius)
    ahead = max(1, len(found) // 7)
    ties, roots = [], None
    for numbers in (range(ahead), range(ahead, len(found))):
        named = nodes.withColumn("name", F.col("a")) if roots is None else nodes.join(roots, "a", "left").withColumn("name", F.coalesce("root", "a"))
        each = named.select("name", F.posexplode(F.array(*prints)).alias("print", "held"))
        tables = F.posexplode(F.array(*(F.lit(found[t]) for t in numbers)))
        key = F.xxhash64("print", F.col("table") + numbers.start, F.col("held").bitwiseAND(F.col("mask")))
        buckets = each.select("print", "held", "name", tables.alias("table", "mask")).select(key.alias("bucket"), "name", "held")
        pairs = written(buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long, fp long"), "links")
        ties.append(pairs.filter("fp IS NULL").select("a", "b"))
        # Buckets beyond a tile, unless all of their nodes bear one name already.
        over = pairs.filter("fp IS NOT NULL").toDF("g", "name", "held")
        open_ = over.groupBy("g").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"), F.min("name").alias("x"), F.max("name").alias("y")).filter("x != y")
        open_ = written(open_.drop("x", "y"), "large-buckets")
        if not open_.isEmpty():
            ties.append(linked(written(over.join(open_, "g"), "large-buckets"), near_of))
        edges = ties[0]
        for more in ties[1:]:
            edges = edges.union(more)
        roots = components(edges)
    return roots


# -- groups --------------------------------------------------------------------------------------


def groups(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """doc_id, text_hash, fp, component_id (least doc_id of the component) and keep_hash (the text_hash of the row to keep)."""
    rows = written(fingerprints(docs, width), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text_hash")).alias("first")), "nodes")
    roots = families(nodes.select(F.col("fp").alias("a"), "fp"), ("fp",), radius).withColumnRenamed("a", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    first = placed.groupBy("root").agg(F.min("first").alias("least"))
    to = placed.join(first, "root").select("fp", F.nullif("least.doc_id", F.lit(LAST)).alias("component_id"), F.col("least.text_hash").alias("keep_hash"))
    return rows.join(to, "fp")


def similar_sets(similar: float) -> Callable:
    """The test of runs whose column ``held`` has sets of shingles: a Jaccard similarity of at least `similar`."""

    def near_of(table: pa.Table):
        lists = table.column("held").combine_chunks()
        offsets = lists.offsets.to_numpy()
        ends, values = offsets - offsets[0], lists.values.to_numpy()[offsets[0] : offsets[-1]]
        sizes = np.diff(ends)
        distinct, codes = np.unique(values, return_inverse=True)
        owner = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(codes, kind="stable")]
        many = np.bincount(codes, minlength=len(distinct))
        at = np.cumsum(many) - many

        def near(x, others):
            mine = codes[ends[x] : ends[x + 1]]
            n = many[mine]
            places = np.repeat(at[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[places], minlength=len(sizes))[others]
            return both + 1e-9 >= similar * (sizes[x] + sizes[others] - both)

        return near

    return near_of


def shingle_sets(texts: DataFrame, wanted: Filter, words: int = 5) -> DataFrame:
    """text_hash and shingles (the distinct shingles of so many words, as sorted XXH64; fewer words are one) of the rows whose ``key`` may be wanted.

    texts: key, text_hash, text.
    """

    def run(batches):
        for batch in slices(batches):
            batch = batch.filter(pa.array(wanted.has(batch.column(0).to_numpy(zero_copy_only=False))))
            sets = pa.array([np.unique(hashed(shingles(words_of(t), words))).view(np.int64) for t in batch.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), sets], ["text_hash", "held"])

    return texts.select("key", "text_hash", "text").mapInArrow(run, "text_hash long, held array<long>")


def _key(doc_id: Column, text_hash: Column) -> Column:
    """A row, as far as the operator tells rows apart."""
    return F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(LAST)), text_hash)


def similar_groups(docs: DataFrame, count: int = 5, radius: int = 4, similar: float = 0.8, words: int = 5, rows_per_task: int = 1024) -> DataFrame:
    """doc_id, text_hash, component_id and keep_hash as in `groups`, where a link also asks for a Jaccard similarity of at least `similar`.

    `count` fingerprints find the candidates: texts of which one differs in at most `radius` bits, and what is tied together by those.
    The similarity is that of sets of shingles of `words` words, of any two texts that are tied together.  Texts themselves
    aren't moved: only the sets of candidates are.
    """
    prints = tuple(f"fp{j}" for j in range(count))
    rows = written(several_fingerprints(docs, count), "fingerprints")
    texts = written(rows.groupBy("text_hash", "n_words", *prints).agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("first")), "texts")
    roots = families(texts.select(F.col("text_hash").alias("a"), *prints), prints, radius).withColumnRenamed("a", "text_hash")
    placed = texts.join(roots, "text_hash", "left").select("text_hash", "n_words", "first", F.coalesce("root", "text_hash").alias("g"))
    many = placed.groupBy("g").agg(F.count("*").alias("n"), F.sum("n_words").alias("size")).filter("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / rows_per_task), F.ceil(F.col("size") / SHINGLES), F.lit(1)).cast("int")
    candidates = written(placed.join(many.select("g", parts.alias("parts")), "g").select("g", "parts", "text_hash", "first"), "candidates")
    text = whole_text()
    wanted = Filter.of(candidates.select(_key(F.col("first"), F.col("text_hash"))))
    sets = shingle_sets(docs.select(_key(F.col("doc_id"), F.xxhash64(text)).alias("key"), F.xxhash64(text).alias("text_hash"), text.alias("text")), wanted, words)
    held = candidates.join(sets, "text_hash").dropDuplicates(["text_hash"]).select("g", "parts", F.col("text_hash").alias("name"), "held")
    same = components(linked(written(held, "shingles"), similar_sets(similar)), "similar")
    top = texts.join(same.withColumnRenamed("a", "text_hash"), "text_hash", "left").select("text_hash", F.coalesce("root", "text_hash").alias("root"), "first")
    least = top.groupBy("root").agg(F.min(F.struct(F.col("first").alias("doc_id"), "text_hash")).alias("least"))
    to = top.select("text_hash", "root").join(least, "root").select("text_hash", F.nullif("least.doc_id", F.lit(LAST)).alias("component_id"), F.col("least.text_hash").alias("keep_hash"))
    return rows.select("doc_id", "text_hash").join(to, "text_hash")


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of each component, with all columns of `docs`: the one of least doc_id, and of least text hash among those.

    found: doc_id, text_hash, component_id and keep_hash of each row of `docs`.  Only rows that may have to go are moved.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("keep_hash"))
    each = found.groupBy(_key(F.col("doc_id"), F.col("text_hash")).alias("key")).agg(F.bool_or(stays).alias("stays"), F.count("*").alias("n"))
    touched = written(each.filter(~F.col("stays") | (F.col("n") > 1)).select("key", "stays"), "touched")
    may = Filter.of(touched.select("key"))

    @F.arrow_udf("boolean")
    def has(keys: pa.Array) -> pa.Array:
        return pa.array(may.has(keys.to_numpy()))

    # The row is one value, so that none of its columns meets a column of this function.
    rows = docs.select(F.struct(*docs.columns).alias("row"), _key(F.col("doc_id"), F.xxhash64(whole_text())).alias("key"))
    rows = rows.withColumn("may", has("key"))
    doubtful = rows.filter("may").join(touched, "key", "left").filter(F.coalesce("stays", F.lit(True)))
    return rows.filter("NOT may").select("row.*").unionByName(doubtful.dropDuplicates(["key"]).select("row.*"))


def kept(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """One row of each component of `groups`, with all columns of `docs`."""
    return first_of_each(docs, groups(docs, radius, width))


def kept_similar(docs: DataFrame, count: int = 5, radius: int = 4, similar: float = 0.8) -> DataFrame:
    """One row of each component of `similar_groups`, with all columns of `docs`."""
    return first_of_each(docs, similar_groups(docs, count, radius, similar))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
