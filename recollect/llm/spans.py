"""Places of pattern matches in a text, by built-in functions alone; work grows with a text's length and the number of matches (times its logarithm)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a block, of which parts of a text are cut.
BLOCK = 2048


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, also where it is looked at within a loop."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of integers what it and all before it come to; by doubling, so in n log n steps.

    `combine` takes the value of a place and that of an earlier one, which is null before the first.
    """
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, values, lambda a, k: F.transform(a, lambda x, i: combine(x, F.get(a, i - F.pow(F.lit(2.0), k).cast("int")))))


def sums(values: Column) -> Column:
    return scan(values, lambda x, before: x + F.coalesce(before, F.lit(0)))


def greatest_so_far(values: Column) -> Column:
    return scan(values, F.greatest)  # which passes over nulls


def matches(text: Column, pattern: str, size: Callable[[Column], Column] = F.length) -> Column:
    """Array of (start, end, value) of all matches, leftmost and non-overlapping; code points (or what `size` counts), end exclusive.

    The text between two matches is what splitting at the pattern leaves, so a match ends at the sum of all
    that comes before.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), size)

    def placed(found):
        both = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda v, gap: gap + size(v))
        return let(sums(both), lambda ends: F.transform(found, lambda v, i: F.struct((F.get(ends, i) - size(v)).alias("start"), F.get(ends, i).alias("end"), v.alias("value"))))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return let(values, lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def blanked(text: Column, pattern: str) -> Column:
    """`text` with every code point of a match as a space."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    return F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], F.coalesce(F.repeat(F.lit(" "), F.length(p["value"])), F.lit("")))), "")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined, in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The text from start to end, of its blocks."""
    last = F.greatest(end - 1, start)
    numbers = F.sequence((start / BLOCK).cast("int"), (last / BLOCK).cast("int"))
    at = lambda k: F.greatest(start - k * BLOCK, F.lit(0))
    part = lambda k: F.substring(F.get(blocks, k), at(k) + 1, F.least(end - k * BLOCK, F.lit(BLOCK)) - at(k))
    return F.when(end > start, F.array_join(F.transform(numbers, part), "")).otherwise("")


def replaced(text: Column, spans: Column) -> Column:
    """`text` with each span (start, end, label), in ascending order of start, replaced by its label; what overlaps is replaced once."""

    def of(blocks, spans):
        def with_ends(ends):
            before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
            each = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(_cut(blocks, before(i), s["start"]), s["label"])).otherwise(""))
            tail = _cut(blocks, F.coalesce(F.get(ends, F.size(spans) - 1), F.lit(0)), F.length(text))
            return F.concat(F.array_join(each, ""), tail)

        return let(greatest_so_far(F.transform(spans, lambda s: s["end"])), with_ends)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: let(spans, lambda s: of(blocks, s)))
