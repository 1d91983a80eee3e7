"""Operator 13: collocations, from suffix subtrees that are built group by group.

The suffixes of all pieces of text, as words and cut off at depth `LONGEST`, form a tree in which the count of a phrase is the
total of the leaves below it.  As in ERA the tree is parted vertically, by prefixes that few enough suffixes begin with for a subtree to fit in memory:

1.  Words are counted.  A phrase is no more frequent than any of its words, so a word that is rarer than `LEAST` ends a suffix.
2.  A word that begins few suffixes is a prefix by itself.  One that begins more than a quarter of `BUDGET` is taken together with the next
    word, and so on while words are that frequent: f(prefix) is at most the least f of its words, so every prefix that ends in a
    seldom word is small, and no scan for the counts of longer prefixes is needed.
3.  Prefixes are dealt to groups so that a group has a fourth of `BUDGET` suffixes on average, and groups to `PARTS` parts.  Tasks send each distinct
    suffix of a portion of text once, with its number; those of one part travel as one compressed row, in order, so that what they begin with costs
    little, and a portion makes no more rows where there are more groups.  What arrives is dealt to its groups a few portions' worth at a time.
4.  Each group is made into subtrees independently of the others, level by level; what is below a node of fewer than `LEAST` is cut off.  Nodes above
    the prefixes, the phrases of frequent words alone, belong to no group: tasks count them by themselves and send a row for each of a portion.

Which words are frequent is sent to the tasks as filters of at most 16 MB, whatever the corpus; what they let through wrongly costs time alone.

Scores, containment and ranks are joins and aggregations of the nodes.  Parts of phrases that are a thousandth of all words or more (at most a thousand of
each length) are looked up by a broadcast, so that no key of the other join is hot.

Results for odd input: null and empty texts have no words; a null ``lang`` is ``und``; repeated rows count as often as they are there;
ties are broken by count and then by phrase; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Filter, documents, whole_text, written

LONGEST = 4
#: A phrase that is rarer is no candidate; a longer candidate that has so many hundredths of its places covers it; ranks for each language.
LEAST, COVERED, FIRST = 30, 80, 2000
SCALE = 2_000_000
#: About as many suffixes make up a group at most.
BUDGET = 500_000
#: Texts are handled in portions of about so many bytes, and rows sent in batches of so many.
PORTION, ROWS = 5 << 20, 50_000
#: Parts that all groups are dealt to, whatever their number; each lies in one task, which works off its groups one after the other.
PARTS = 512
#: Parts among which the ranks of one language are dealt.
SPREAD = 64
#: The rows of a phrase of frequent words alone are dealt to one part for each so many words of the corpus.
DEALT = 10_000_000_000

WORD, BLANK, BREAK = range(3)
_KINDS = np.full(256, WORD, np.uint8)
_KINDS[[0x20, 0x09]] = BLANK
_KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CUT = regex.compile(rb"[.,;:!?\x0A-\x0D]")


def portions(batches, size: int) -> Iterator[tuple[str, bytes]]:
    """(language, texts joined by a line break) of about `size` bytes or less; a text that is longer is cut where a piece ends."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            text = text.as_py()
            while len(text) > size and (m := _CUT.search(text, size)):
                yield lang, text[: m.start()]
                text = text[m.end() :]
            held.setdefault(lang, []).append(text)
            total += len(text) + 1
            if total >= size:
                yield from ((x, b"\n".join(texts)) for x, texts in held.items())
                held, total = {}, 0
    yield from ((x, b"\n".join(texts)) for x, texts in held.items())


class Words:
    """The words of a portion: ``codes`` into ``distinct``, and the number of the piece that each is in."""

    def __init__(self, data: bytes):
        data = np.frombuffer(data.translate(_LOWER), np.uint8)
        kind = _KINDS[data]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = kind == WORD
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        array = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside[1:-1] == 1])).dictionary_encode()
        self.codes, self.distinct = array.indices.to_numpy(), array.dictionary
        self.pieces = np.cumsum(kind == BREAK, dtype=np.int32)[starts]

    def keys(self, lang: str) -> np.ndarray:
        """Spark's ``xxhash64(lang, word)`` of each distinct word."""
        seed = xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)
        return np.fromiter((xxh64_intdigest(w.as_py(), seed) for w in self.distinct.cast(pa.binary())), np.uint64, len(self.distinct))


def _counted(batches):
    for lang, data in portions(batches, PORTION):
        words = Words(data)
        n = np.bincount(words.codes, minlength=len(words.distinct))
        for k in range(0, len(n), ROWS):
            part = words.distinct.slice(k, ROWS)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, pa.array(n[k : k + ROWS], pa.int64())], ["lang", "word", "f"])


def leaves(words: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns of codes, in order, and how often each is there."""
    wide = max(int(w.max(initial=0)) for w in words).bit_length()
    if wide * len(words) <= 64:
        key = words[0].astype(np.uint64)
        for w in words[1:]:
            key = (key << np.uint64(wide)) | w.astype(np.uint64)
        key, n = np.unique(key, return_counts=True)
        mask = np.uint64((1 << wide) - 1)
        return [((key >> np.uint64(wide * k)) & mask).astype(np.int64) for k in reversed(range(len(words)))], n
    order = np.lexsort(words[::-1])
    rows = [w[order] for w in words]
    new = np.ones(len(order), bool)
    new[1:] = np.any([r[1:] != r[:-1] for r in rows], axis=0)
    at = np.flatnonzero(new)
    return [r[at].astype(np.int64) for r in rows], np.diff(np.append(at, len(order)))


def _join(columns: list[pa.Array]) -> pa.Array:
    return pc.binary_join_element_wise(*columns, " ", null_handling="skip") if len(columns) > 1 else columns[0]


def suffixes(frequent: Filter, hot: Filter, groups: int, parts: int):
    """A function that makes texts into packed rows of (group, lang, suffix, n), by part.  A group's number tells the length of its prefixes, too; if that is
    beyond LONGEST, its rows are whole phrases of frequent words."""

    def run(batches):
        salt = np.uint64(TaskContext.get().partitionId() % parts)
        for lang, data in portions(batches, PORTION):
            words = Words(data)
            keys = words.keys(lang)
            often = frequent.has(keys)
            if not often.any():
                continue
            # Codes from 1, 0 is behind the end; a suffix ends with its piece and before a word that is seldom.
            code = np.where(often, np.cumsum(often), 0).astype(np.int32)
            at = np.flatnonzero(often[words.codes])
            first, piece = code[words.codes[at]], words.pieces[at]
            follows = np.append((np.diff(at) == 1) & (np.diff(piece) == 0), False)
            columns, goes_on = [first], follows
            for k in range(1, LONGEST):
                if k > 1:
                    goes_on = np.append(goes_on[1:], False) & follows
                columns.append(np.where(goes_on, np.append(first[k:], np.zeros(min(k, len(first)), first.dtype)), 0))
            strings, keys = words.distinct.filter(pa.array(often)), np.append(np.uint64(0), keys[often])
            heavy = np.append(False, hot.has(keys[1:]))
            del words, data, at, piece
            columns, n = leaves(columns)
            leading, lead = np.ones(len(n), bool), np.zeros(len(n), np.int64)
            for depth, c in enumerate(columns, 1):
                leading &= heavy[c]
                lead += leading
                # Nodes above all prefixes: each distinct run of `depth` frequent words, with the number of suffixes that begin with it.
                some = np.flatnonzero(leading)
                if len(some):
                    above = [x[some] for x in columns[:depth]]
                    new = np.append(True, np.any([x[1:] != x[:-1] for x in above], axis=0))
                    mixed = _group(keys, above, np.full(int(new.sum()), LONGEST), np.flatnonzero(new)) ^ salt
                    whole = LONGEST * groups + (Filter.mixed(mixed, 7) % np.uint64(groups)).astype(np.int64)
                    yield from _packed(lang, strings, [x[new] for x in above], np.add.reduceat(n[some], np.flatnonzero(new)), whole, PARTS)
            prefix = lead + 1
            rest = np.flatnonzero((prefix <= LONGEST) & (np.stack(columns)[np.minimum(lead, LONGEST - 1), np.arange(len(n))] > 0))  # a suffix of frequent words alone is done
            columns, n, prefix = [c[rest] for c in columns], n[rest], prefix[rest]
            group = (prefix - 1) * groups + (_group(keys, columns, prefix, slice(None)) % np.uint64(groups)).astype(np.int64)
            yield from _packed(lang, strings, columns, n, group, PARTS)

    return run


def _group(keys: np.ndarray, columns: list[np.ndarray], length: np.ndarray, at) -> np.ndarray:
    """A number from the keys of the first `length` words of some rows of `columns`."""
    mixed = keys[columns[0][at]]
    for k, c in enumerate(columns[1:], 2):
        mixed = np.where(length >= k, Filter.mixed(mixed ^ (keys[c[at]] + np.uint64(k)), k), mixed)
    return Filter.mixed(mixed, 0)


def _packed(lang: str, strings: pa.Array, columns: list[np.ndarray], n: np.ndarray, group: np.ndarray, parts: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of `PACKED`: those of a group in one, or with `parts` rows of `DEALT_OUT`: those of a part in one."""
    key = group % parts if parts else group
    order = np.argsort(key, kind="stable")
    for k in range(0, len(order), ROWS):
        at = order[k : k + ROWS]
        text = _join([strings.take(pa.array(c[at] - 1, mask=c[at] == 0)) for c in columns])
        first, *out = _runs(text, n[at], group[at], key[at])
        yield pa.RecordBatch.from_arrays([pa.array(key[at][first]), pa.array([lang] * len(first), pa.string()), *out], ["part" if parts else "group", "lang", *SENT])


def _runs(text: pa.Array, n: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple:
    """Where each run of equal keys begins, and of each the columns `SENT`: its suffixes as lines, then their numbers and groups, compressed."""
    lines = pc.binary_join_element_wise(text, "", "\n")  # no word has a line break
    ends, data = np.frombuffer(lines.buffers()[1], np.int32)[: len(text) + 1], memoryview(lines.buffers()[2])
    first = np.flatnonzero(np.append(True, np.diff(key) != 0))
    last, n, group = np.append(first[1:], len(text)), n.astype("<u4"), group.astype("<u4")
    raw = [bytes(data[ends[a] : ends[b]]) + n[a:b].tobytes() + group[a:b].tobytes() for a, b in zip(first, last, strict=True)]
    return first, pa.array(last - first), pa.array(map(len, raw), pa.int64()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary())


SENT = ("rows", "size", "packed")
PACKED = "group long, lang string, rows long, size long, packed binary"
DEALT_OUT = PACKED.replace("group", "part")


def unpacked(table: pa.Table) -> pa.Table:
    """The rows (group, lang, suffix, n) of packed ones."""
    rows, texts, n, group = table.column("rows").to_numpy(), [], [], []
    for x, size, many in zip(table.column("packed"), table.column("size").to_pylist(), rows.tolist(), strict=True):
        raw = pa.decompress(x.as_buffer(), size, "zstd", asbytes=True)
        texts.append(raw[: size - 8 * many - 1])
        n.append(np.frombuffer(raw, "<u4", many, size - 8 * many))
        group.append(np.frombuffer(raw, "<u4", many, size - 4 * many))
    suffix = pc.split_pattern(pa.array(texts, pa.binary()).view(pa.string()), "\n").flatten()
    owner = pa.array(np.repeat(np.arange(len(rows)), rows))
    return pa.table({"group": np.concatenate(group).astype(np.int64), "lang": table.column("lang").take(owner), "suffix": suffix, "n": np.concatenate(n).astype(np.int64)})


def _regrouped(batches) -> Iterator[pa.RecordBatch]:
    """Rows of `PACKED` from those of `DEALT_OUT`, some portions' worth of them at a time."""
    held, size = [], 0

    def packed():
        table = unpacked(pa.Table.from_batches(held))
        group, lang = table.column("group").to_numpy(), table.column("lang").combine_chunks().dictionary_encode()
        key = group * len(lang.dictionary) + lang.indices.to_numpy()
        order, suffix, n = np.argsort(key, kind="stable"), table.column("suffix").combine_chunks(), table.column("n").to_numpy()
        for k in range(0, len(order), ROWS):
            at = order[k : k + ROWS]
            first, *out = _runs(suffix.take(pa.array(at)), n[at], group[at], key[at])
            yield pa.RecordBatch.from_arrays([pa.array(group[at][first]), lang.take(pa.array(at[first])).cast(pa.string()), *out], ["group", "lang", *SENT])

    for batch in batches:
        for k, more in enumerate(batch.column("size").to_pylist()):
            held.append(batch.slice(k, 1))
            size += more
            if size >= 4 * PORTION:
                yield from packed()
                held, size = [], 0
    if held:
        yield from packed()


def _by_group(batches) -> Iterator[pa.Table]:
    """The rows of each group from rows of `PACKED` that lie together."""
    held, now = [], None
    for batch in batches:
        group = batch.column("group").to_numpy()
        first = np.flatnonzero(np.append(len(group) > 0, np.diff(group) != 0))
        for a, b in zip(first, np.append(first[1:], len(group)), strict=True):
            if held and group[a] != now:
                yield unpacked(pa.Table.from_batches(held))
                held = []
            now = group[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield unpacked(pa.Table.from_batches(held))


def subtrees(table: pa.Table, groups: int, least: int) -> pa.Table:
    """The nodes (lang, phrase, words, f) of a group's subtrees that are there `least` times, from its prefixes down.  For whole phrases it adds up their rows."""
    shortest = table.column("group")[0].as_py() // groups + 1
    if shortest > LONGEST:
        sums = table.group_by(["lang", "suffix"]).aggregate([("n", "sum")])
        words = pc.add(pc.count_substring(sums.column("suffix"), " "), 1)
        return pa.table({"lang": sums.column("lang"), "phrase": sums.column("suffix"), "words": words.cast(pa.int32()), "f": sums.column("n_sum")})
    n = table.column("n").to_numpy()
    langs = table.column("lang").combine_chunks().dictionary_encode()
    lists = pc.split_pattern(table.column("suffix").combine_chunks(), " ")
    flat = lists.flatten().dictionary_encode()
    size = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(n)), size)
    words = np.zeros((len(n), LONGEST), np.int32)  # codes from 1
    words[owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)] = flat.indices.to_numpy() + 1
    node, rows, out = langs.indices.to_numpy().astype(np.int64), np.arange(len(n)), []
    for depth in range(1, LONGEST + 1):
        on = words[rows, depth - 1] > 0
        rows, node = rows[on], node[on]
        if not len(rows):
            break
        branch = node * (len(flat.dictionary) + 1) + words[rows, depth - 1]
        order = np.argsort(branch, kind="stable")
        new = np.append(True, np.diff(branch[order]) > 0)
        totals = np.add.reduceat(n[rows[order]], np.flatnonzero(new))
        node = np.empty(len(rows), np.int64)
        node[order] = np.cumsum(new) - 1
        kept = np.full(len(totals), True) if depth < shortest else totals >= least
        if depth >= shortest:
            at = rows[order[np.flatnonzero(new)]][kept]
            phrase = _join([flat.dictionary.take(pa.array(words[at, k] - 1)) for k in range(depth)])
            out.append(pa.table({"lang": langs.take(pa.array(at)).cast(pa.string()), "phrase": phrase, "words": pa.array(np.full(len(at), depth, np.int32)), "f": totals[kept]}))
        rows, node = rows[kept[node]], node[kept[node]]
    return pa.concat_tables(out)


def nodes(df: DataFrame, lang: str, text: str, least: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to LONGEST words that are there `least` times: lang, phrase, words, f; and the words of each language: lang, n."""
    rows = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), whole_text(text).alias("text"))
    words = written(rows.mapInArrow(_counted, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")), "phrase-words")
    key = F.xxhash64("lang", "word")
    frequent = words.filter(F.col("f") >= least)
    total = frequent.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    groups, spread = 1 + 4 * (total // budget), 1 + total // DEALT
    run = suffixes(Filter.of(frequent.select(key)), Filter.of(words.filter(F.col("f") > budget // 4).select(key)), groups, spread)
    together = rows.mapInArrow(run, DEALT_OUT).repartition("part").mapInArrow(_regrouped, PACKED).sortWithinPartitions("group")

    def grown(batches):
        for table in _by_group(batches):
            yield from subtrees(table, groups, least).to_batches()

    parts = together.mapInArrow(grown, "lang string, phrase string, words int, f long")
    found = parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)  # phrases that were dealt to several parts
    return written(found, "phrase-nodes"), words.groupBy("lang").agg(F.sum("f").alias("n"))


def scored(found: DataFrame, all_words: int) -> DataFrame:
    """For each phrase of two words or more its least-scoring cut: lang, phrase, words, a, l, r, score."""
    phrases = found.filter("words > 1").withColumnRenamed("f", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    part = F.expr("explode(array(struct(0 AS side, substring_index(phrase, ' ', k) AS part), struct(1 AS side, substring_index(phrase, ' ', k - words) AS part)))")
    asked = cuts.withColumn("p", part).select("lang", "phrase", "words", "a", "k", "p.side", "p.part")
    known = found.select("lang", F.col("phrase").alias("part"), "f")
    # Phrases of one length are no more than there are words, so at most a thousand of each length have a thousandth of them.
    hot = known.filter(F.col("f") >= -(-all_words // 1000)).withColumnRenamed("f", "hot")
    asked = asked.join(F.broadcast(hot), ["lang", "part"], "left")
    elsewhere = F.when(F.col("hot").isNull(), F.col("part")).otherwise(F.concat(F.lit("\n"), "phrase"))  # no phrase has a line break
    asked = asked.withColumn("part", elsewhere).join(known, ["lang", "part"], "left").withColumn("f", F.coalesce("hot", "f"))
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("f")))
    cut = asked.groupBy("lang", "phrase", "words", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    score = F.expr(f"CAST(CAST(a AS DECIMAL(20, 0)) * {SCALE} AS DECIMAL(30, 0)) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cut.groupBy("lang", "phrase", "words", "a").agg(best).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def covered(found: DataFrame) -> DataFrame:
    """For each shorter phrase inside a phrase of three words or more: lang, phrase and the greatest count of such longer ones."""
    words = F.split("phrase", " ")
    inner = lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
    three = F.when(F.col("words") > 3, inner(3)).otherwise(F.array().cast("array<string>"))
    return found.filter("words > 2").select("lang", "f", F.explode(F.concat(inner(2), three)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, share: int = COVERED, first: int = FIRST, budget: int = BUDGET) -> DataFrame:
    """The `first` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found, totals = nodes(df, lang, text, least, budget)
    totals = written(totals, "phrase-totals")
    all_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    left = scored(found, all_words).join(covered(found), ["lang", "phrase"], "left")
    wide = lambda c: F.col(c).cast("decimal(20, 0)")  # noqa: E731  products may pass 64 bits
    left = left.filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * share))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
    near = left.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("place") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def _grams(k: int) -> str:
    return f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase FROM p WHERE len(w) >= {k}"


def _cut(k: int, words: int) -> str:
    part = lambda a, b: f"array_to_string(string_split(phrase, ' ')[{a}:{b}], ' ')"
    return f"SELECT lang, phrase, f AS a, {k} AS cut, {part(1, k)} AS lp, {part(k + 1, words)} AS rp FROM f WHERE k = {words}"


def _inner(i: int, size: int, words: int) -> str:
    return f"SELECT lang, array_to_string(string_split(phrase, ' ')[{i}:{i + size - 1}], ' ') AS phrase, f FROM f WHERE k = {words}"


OP13_SQL = rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
    p AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM d), g AS ({" UNION ALL ".join(_grams(k) for k in range(1, LONGEST + 1))}),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
    c AS ({" UNION ALL ".join(_cut(k, words) for words in range(2, LONGEST + 1) for k in range(1, words))}),
    s AS (SELECT c.*, l.f AS l, r.f AS r, CAST((CAST({SCALE} AS HUGEINT) * a) // (l.f + r.f) AS BIGINT) AS score FROM c JOIN f l ON l.lang = c.lang AND l.phrase = lp JOIN f r ON r.lang = c.lang AND r.phrase = rp),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    i AS (SELECT lang, phrase, max(f) AS longer FROM ({" UNION ALL ".join(_inner(i, size, words) for words in range(3, LONGEST + 1) for size in range(2, words) for i in range(1, words - size + 2))}) GROUP BY ALL),
    x AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {COVERED} * a)
    SELECT lang, rank, phrase, a, l, r, n, score FROM x JOIN n USING (lang) WHERE rank <= {FIRST}"""
