"""Names in texts by a packed trie, and whether what was said supports the names in a fact.

A dictionary of aliases becomes sorted arrays: a transition is a node and a character, its target the place in the array.  A portion of texts is matched from all
its places at once, one character deeper in each step, so work is in proportion to what still matches; no substring is made.  What is found in a portion
is sent on before the next one, so memory is bounded by a portion, however many rows Spark hands over at once.  A dictionary of up to
`PART` aliases goes to the tasks as one trie.  A larger one is dealt to parts, and each part meets each block of texts in one task.

Of the matches in a text the longest are taken first, and what overlaps one that is taken is none: an alias inside a longer one says nothing.
ASCII aliases are whole words, in any case; aliases of one character never name anybody, but may support a name.

Results for odd input: null and empty texts and aliases have no matches; an alias of two names goes to the name that sorts first; equal lengths are taken from
the left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = 50_000
#: Code points that are matched at once, and texts of a block where the dictionary is dealt to parts.
PORTION, BLOCK = 1 << 18, 5000
SPANS = "name string, alias string, start int, end int"


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of some texts, one after the other, and where each begins."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def folded(text: str) -> str:
    """Lower case that keeps the number of characters."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Trie:
    def __init__(self, terms: list[str]):
        self.terms = terms
        cp, begin = _points(terms)
        sizes, node = np.diff(begin), np.zeros(len(terms), np.int64)
        self.levels: list[np.ndarray] = []  # of each depth the sorted transitions: node * 2^21 + character
        self.final: list[np.ndarray] = []  # of each depth and node the term that ends there, or -1
        for depth in range(int(sizes.max(initial=0))):
            on = np.flatnonzero(sizes > depth)
            keys, at = np.unique((node[on] << 21) | cp[begin[on] + depth], return_inverse=True)
            node[on] = at
            final = np.full(len(keys), -1)
            done = on[sizes[on] == depth + 1]
            final[node[done]] = done
            self.levels.append(keys)
            self.final.append(final)

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(number of the text, term, start, end) of every match."""
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= PORTION):
                size += len(texts[last])
                last += 1
            yield from self._matches(texts[first:last], first)
            first = last

    def _matches(self, texts: list[str], offset: int) -> Iterator[tuple[int, int, int, int]]:
        cp, begin = _points(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(begin))
        at, node = np.arange(len(cp)), np.zeros(len(cp), np.int64)
        for depth, (keys, final) in enumerate(zip(self.levels, self.final, strict=True)):
            inside = at + depth < begin[owner[at] + 1]
            at, node = at[inside], node[inside]
            if not len(at):
                return
            wanted = (node << 21) | cp[at + depth]
            place = np.minimum(keys.searchsorted(wanted), len(keys) - 1)
            hit = keys[place] == wanted
            at, node = at[hit], place[hit]
            for p, n in zip(at[final[node] >= 0].tolist(), final[node][final[node] >= 0].tolist(), strict=True):
                k = int(owner[p])
                yield offset + k, n, p - int(begin[k]), p - int(begin[k]) + depth + 1


def _whole(text: str, term: str, start: int, end: int) -> bool:
    """An alias of plain letters, digits and joints is no part of a word."""
    if not all(c.isascii() and (c.isalnum() or c in "_.-") for c in term):
        return True
    plain = lambda c: c.isascii() and c.isalnum()
    return not (start and plain(text[start - 1])) and not (end < len(text) and plain(text[end]))


def longest_first(found: list[tuple[int, int]]) -> list[int]:
    """The numbers of the spans that are taken, the longest first, from the left among equals."""
    taken: list[tuple[int, int]] = []
    kept = []
    for k in sorted(range(len(found)), key=lambda k: (found[k][0] - found[k][1], found[k])):
        s, e = found[k]
        if not any(s < te and ts < e for ts, te in taken):
            taken.append((s, e))
            kept.append(k)
    return sorted(kept, key=lambda k: found[k])


def _all(frame: pd.DataFrame, trie: Trie, names: list[str]) -> pd.DataFrame:
    texts = [folded(t) if isinstance(t, str) else "" for t in frame["content"]]
    rows = [(k, n, s, e) for k, n, s, e in trie.matches(texts) if _whole(texts[k], trie.terms[n], s, e)]
    number, term, start, end = np.array(rows, np.int64).reshape(-1, 4).T
    # Kinds of columns are given: one without rows would be of floats, which Arrow takes for no text.
    held = lambda values: np.array(values, object)[term]
    return pd.DataFrame({"id": frame["id"].to_numpy()[number], "name": held(names), "alias": held(trie.terms), "start": start, "end": end})


def _portions(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows in runs of at most `PORTION` characters; a longer text is one by itself."""
    sizes = [len(t) if isinstance(t, str) else 0 for t in frame["content"]]
    first, size = 0, 0
    for k, n in enumerate(sizes):
        if k > first and size + n > PORTION:
            yield frame.iloc[first:k]
            first, size = k, 0
        size += n
    yield frame.iloc[first:]


def _taken(found: pd.DataFrame) -> pd.DataFrame:
    kept = [i for _, g in found.groupby("id", sort=False) for i in g.index[longest_first(list(zip(g["start"], g["end"], strict=True)))]]
    return found.loc[kept]


def dictionary(aliases: DataFrame) -> DataFrame:
    """(alias in lower case, name), one row for an alias; aliases: alias, name."""
    return aliases.select(F.lower(F.trim("alias")).alias("alias"), "name").filter("alias <> '' AND name IS NOT NULL").groupBy("alias").agg(F.min("name").alias("name"))


def mentions(texts: DataFrame, aliases: DataFrame, part: int = PART) -> DataFrame:
    """(id, name, alias, start, end) of the names in each text; texts: id (distinct), content; aliases: alias, name."""
    terms = dictionary(aliases).filter(F.length("alias") > 1)
    schema = f"id {texts.schema['id'].dataType.simpleString()}, {SPANS}"
    rows = texts.select("id", "content")
    few = terms.limit(part + 1).collect()  # at most `part`, or it is not used
    if len(few) <= part:
        pairs = sorted((r["alias"], r["name"]) for r in few)

        def run(frames):
            trie, names = Trie([a for a, _ in pairs]), [n for _, n in pairs]
            for frame in frames:
                for some in _portions(frame):
                    yield _taken(_all(some, trie, names))

        return rows.mapInPandas(run, schema)
    parts, blocks = -(-terms.count() // part), max(1, -(-rows.count() // BLOCK))
    deal = lambda df, key, n, other, m, mine: df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = deal(rows, "id", blocks, "part", parts, "block"), deal(terms, "alias", parts, "block", blocks, "part")

    def both(frame: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("alias")
        return _all(frame, Trie(held["alias"].tolist()), held["name"].tolist())

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(both, schema)

    def choose(frames):
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            last = frame["id"].iloc[-1]
            rest, frame = frame[frame["id"] == last], frame[frame["id"] != last]
            yield _taken(frame)
        if rest is not None:
            yield _taken(rest)

    return found.repartition("id").sortWithinPartitions("id", "start", F.desc("end")).mapInPandas(choose, schema)


def match_order(found: DataFrame, known: DataFrame) -> DataFrame:
    """(id, name, place): the names of each text in the order in which to follow them: direct ones first, then those of fewer facts, longer and earlier ones.

    known: name, direct, df.
    """
    each = found.groupBy("id", "name").agg(F.max(F.col("end") - F.col("start")).alias("long"), F.min("start").alias("start")).join(known, "name", "left")
    w = Window.partitionBy("id").orderBy(F.desc(F.coalesce("direct", F.lit(False))), F.coalesce("df", F.lit(0)), F.desc("long"), "start", "name")
    return each.select("id", "name", F.row_number().over(w).alias("place"))


#: ``Ann (08-03 20:26):`` before a text says who spoke and names nobody in it; a note in brackets.
LABEL = r"^[^:：（(\n]{1,10}[（(][^）)]{0,30}[）)][:：]"
NOTE = r"[（(][^（）()]{1,20}[）)]"


def supported(rows: DataFrame, aliases: DataFrame, parents: DataFrame, foreign: list[str], config_subjects: dict[str, str] | None = None) -> DataFrame:
    """(id, verdict, names): whether what was said supports the names in a fact: ok, strip, review or reject; names are those that decided it.

    rows: id, content, source (the words that the fact rests on), context, subject, actor.  The subject is a name that needs support as well, and
    the speaker of the source supports his own.  A name that the source has is ok; so is one whose parent the source has, but in a foreign context it is reviewed; one that
    only the context has is reviewed if the source names others (or it has a parent in a foreign context), and one whose parent the context has is
    reviewed.  Otherwise a name that stands in notes alone is stripped, one against which the source names others is rejected, and the rest is reviewed.
    """
    label = F.regexp_replace("content", LABEL, "")
    fields = {"c": label, "b": F.regexp_replace(label, NOTE, " "), "s": F.col("source"), "x": F.col("context")}
    texts = rows.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.alias("content")) for k, v in fields.items()))).alias("t")).select(F.concat_ws(":", "t.field", F.col("id").cast("string")).alias("id"), "t.content")
    found = mentions(texts.filter("content <> ''"), aliases)
    sets = found.select(F.substring("id", 1, 1).alias("field"), F.substring("id", 3, 40).alias("id"), "name").groupBy("id").agg(*(F.collect_set(F.when(F.col("field") == k, F.col("name"))).alias(k) for k in fields))
    short = dictionary(aliases).filter(F.length("alias") == 1)
    letters = rows.select(F.col("id").cast("string").alias("id"), F.explode(F.array_distinct(F.split(F.lower("source"), ""))).alias("alias")).join(short, "alias").groupBy("id").agg(F.collect_set("name").alias("loose"))
    subjects = dictionary(aliases)
    if config_subjects:
        subjects = dictionary(aliases.select("alias", "name").unionByName(aliases.sparkSession.createDataFrame(list(config_subjects.items()), "alias string, name string")))
    one = lambda c, to: rows.select(F.col("id").cast("string").alias("id"), F.lower(c).alias("alias")).join(subjects, "alias").select("id", F.col("name").alias(to))
    none = F.array().cast("array<string>")
    whole = rows.select(F.col("id").cast("string").alias("id"), *([F.exists(F.array(*map(F.lit, foreign)), lambda w: F.contains(F.concat_ws("\n", "source", "context"), w)).alias("f")] if foreign else [F.lit(False).alias("f")]))
    both = whole.join(sets, "id", "left").join(letters, "id", "left").join(one("subject", "of"), "id", "left").join(one("actor", "by"), "id", "left")
    both = both.select("id", "f", "of", *(F.coalesce(k, none).alias(k) for k in ("c", "b", "x", "loose")), F.array_union(F.coalesce("s", none), F.array_compact(F.array("by"))).alias("s"))
    both = both.withColumn("loose", F.array_union("s", "loose"))
    need = F.array_union("c", F.array_compact(F.array("of")))
    each = both.withColumn("name", F.explode_outer(need)).join(parents.select("name", F.col("parent").alias("up")), "name", "left")
    has = lambda a, n: F.coalesce(F.array_contains(a, F.col(n)), F.lit(False))
    others = F.size(F.array_remove("s", F.col("name"))) > 0
    verdict = (
        F.when(F.col("name").isNull() | has("loose", "name"), "ok").when(has("loose", "up"), F.when(F.col("f"), "review").otherwise("ok"))
        .when(has("x", "name"), F.when(others | (F.col("up").isNotNull() & F.col("f")), "review").otherwise("ok")).when(has("x", "up"), "review")
        .when(has("c", "name") & ~has("b", "name") & ~F.col("name").eqNullSafe(F.col("of")), "strip").when(has("c", "name") & others, "reject").otherwise("review")
    )
    rank = F.array_position(F.array(*map(F.lit, ("ok", "strip", "review", "reject"))), F.col("v"))
    judged = each.withColumn("v", verdict).withColumn("r", rank).groupBy("id").agg(F.max("r").alias("r"), F.collect_set(F.struct("r", "name")).alias("n"))
    names = F.when(F.col("r") > 1, F.array_sort(F.transform(F.filter("n", lambda x: x["r"] == F.col("r")), lambda x: x["name"]))).otherwise(none)
    return judged.select(F.col("id").cast(rows.schema["id"].dataType).alias("id"), F.element_at(F.array(*map(F.lit, ("ok", "strip", "review", "reject"))), F.col("r").cast("int")).alias("verdict"), names.alias("names"))
