"""Operator 2: license scans by ordered signature rules.

A text is reduced to its lower-case words, and each rule is a regular expression over them.  Hundreds of rules stand for the
wording of licenses, their notices and addresses (written by hand in `signatures`) and for their names, alone and with each of their
versions, in several phrases (from the table of names below).  Each rule has a priority.  A rule is only tried on texts that hold its
keyword, and no rule on texts without any of a few words (`GATES`).  Of
the places found, one that lies within a place of a rule of the same or a higher priority is suppressed; among equal places the
higher priority stays, then the earlier rule.  Base phrases always stay.

Results for odd input: a null text is an empty one, with no words and no label; a text without a license has empty labels, null
places and score 0; repeated rows give equal rows; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole_text
from .signatures import BODY, HEADER, HINT, SIGNATURES, URL
from .spans import greatest_so_far, let, sums

WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Names of licenses as words, and versions (fixed values).
LICENSES = [
    ("gpl", ["gnu general public license", "gnu gpl", "gpl"], ["1.0", "2.0", "3.0"]),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"], ["2.0", "2.1", "3.0"]),
    ("agpl", ["gnu affero general public license", "affero general public license", "gnu agpl", "agpl"], ["1.0", "3.0"]),
    ("gfdl", ["gnu free documentation license", "gfdl"], ["1.1", "1.2", "1.3"]),
    ("apache", ["apache license", "apache software license", "apache public license"], ["1.0", "1.1", "2.0"]),
    ("mpl", ["mozilla public license", "mpl"], ["1.0", "1.1", "2.0"]),
    ("epl", ["eclipse public license", "epl"], ["1.0", "2.0"]),
    ("cddl", ["common development and distribution license", "cddl"], ["1.0", "1.1"]),
    ("cpl", ["common public license"], ["1.0"]),
    ("eupl", ["european union public license", "european union public licence", "eupl"], ["1.0", "1.1", "1.2"]),
    ("osl", ["open software license"], ["1.0", "2.0", "2.1", "3.0"]),
    ("afl", ["academic free license"], ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("artistic", ["artistic license"], ["1.0", "2.0"]),
    ("bsd", ["bsd license", "berkeley software distribution license"], []),
    ("bsd-0-clause", ["bsd zero clause license", "0bsd", "zero clause bsd license"], []),
    ("bsd-2-clause", ["2 clause bsd license", "bsd 2 clause license", "simplified bsd license", "freebsd license"], []),
    ("bsd-3-clause", ["3 clause bsd license", "bsd 3 clause license", "new bsd license", "modified bsd license"], []),
    ("bsd-4-clause", ["4 clause bsd license", "bsd 4 clause license", "original bsd license"], []),
    ("mit", ["mit license", "mit licence", "mit x11 license", "expat license"], []),
    ("isc", ["isc license"], []),
    ("zlib", ["zlib license", "zlib libpng license"], []),
    ("boost", ["boost software license"], ["1.0"]),
    ("psf", ["python software foundation license", "psf license"], ["2.0"]),
    ("ms-pl", ["microsoft public license"], []),
    ("ms-rl", ["microsoft reciprocal license"], []),
    ("wtfpl", ["do what the fuck you want to public license", "wtfpl"], []),
    ("unlicense", ["the unlicense"], []),
    ("ofl", ["sil open font license", "open font license"], ["1.0", "1.1"]),
    ("odbl", ["open database license", "odbl"], ["1.0"]),
    ("odc-by", ["open data commons attribution license"], ["1.0"]),
    ("cc0", ["cc0", "creative commons zero"], ["1.0"]),
    ("cc-by", ["cc by", "creative commons attribution", "creative commons by"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-sa", ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nc", ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nd", ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution no derivatives"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nc-sa", ["cc by nc sa", "creative commons attribution noncommercial sharealike"], ["2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nc-nd", ["cc by nc nd", "creative commons attribution noncommercial noderivatives"], ["2.0", "2.5", "3.0", "4.0"]),
    ("public-domain", ["public domain"], []),
]
GRANT = "(?:licensed|released|distributed|published|available|provided|redistributed) under (?:the )?(?:terms of the )?"
LATER = " (?:or (?:any )?later(?: version)?|or at your option any later version|and later)"
#: Priorities, from a bare name to a machine-readable tag; a hundredth is the score.
NAME, GRANTED, VERSIONED, GRANTED_VERSION, OR_LATER, TAGGED = 30, 50, 60, 70, 80, 95
BASE_SCORE = 40
LEVELS = tuple(sorted({NAME, HINT, GRANTED, VERSIONED, GRANTED_VERSION, HEADER, OR_LATER, BODY, URL, TAGGED - 1, TAGGED}))
#: Parts of words, one of which is in the keyword of each rule or in what its pattern always has (`ungated`): without any no rule can match.
GATES = (
    "licen", "software", "copy", "permission", "redistribut", "public", "gpl", "mpl", "epl", "eupl", "cddl", "gfdl", "odbl", "wtfpl", "0bsd", "cc", "creative", "terms", "warrant", "gnu", "free",
    "exception", "network", "material", "font", "altered", "circumvent", "cecill", "beer", "fuck", "invariant", "sil org ofl", "spdx",
)
_SPAN = "array<struct<start:int,end:int,priority:int,number:int,label:string>>"


@dataclass
class Rule:
    number: int
    label: str
    priority: int
    keyword: str
    pattern: str  # over words with single spaces between and around them


def rules() -> list[Rule]:
    out: list[Rule] = []

    def add(label, priority, keyword, body):
        out.append(Rule(len(out), label, priority, keyword, f"(?<= ){body}(?= )"))

    for label, names, versions in LICENSES:
        tag = label.replace("-", " ")
        for name in names:
            suffix = "(?: license| licence)?"
            for v in versions:
                major, minor = v.split(".")
                number = f"{suffix} (?:version |v |v)?{major} {minor}" if minor != "0" else f"{suffix} (?:version |v |v)?{major}(?: 0)?"
                add(f"{label}-{v}", VERSIONED, name, name + number)
                add(f"{label}-{v}", GRANTED_VERSION, name, GRANT + name + number)
                if "gpl" in label or label == "gfdl":
                    add(f"{label}-{v}-or-later", OR_LATER, name, name + number + LATER)
            add(label, NAME, name, name)
            add(label, GRANTED, name, GRANT + name)
        for v in versions:
            major, minor = v.split(".")
            add(f"{label}-{v}", TAGGED, "spdx license identifier", f"spdx license identifier {tag} {major} {minor}(?: only)?")
        add(label, TAGGED - 1 if versions else TAGGED, "spdx license identifier", f"spdx license identifier {tag}")
    for label, priority, keyword, body in SIGNATURES:
        add(label, priority, keyword, body)
    return out


def ungated() -> list[Rule]:
    """Rules that could match without any of GATES; there must be none."""

    def always(pattern: str) -> str:
        """A pattern without its optional parts and its choices."""
        old = None
        while old != pattern:
            old, pattern = pattern, re.sub(r"\((?:\?:|\?<=)?[^()]*\)(?:\?|\{0,\d+\}\??)?", "\0", pattern)
        return pattern

    return [r for r in rules() if not any(g in r.keyword or g in always(r.pattern) for g in GATES)]


def words_of(text: Column) -> Column:
    """The words of a lower-case text, with one space before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, GAP, " ")), F.lit(" "))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def places(words: Column, pattern: Column) -> Column:
    """Array of (start, end) of all matches in words from 0, end exclusive."""
    found = F.transform(F.regexp_extract_all(words, pattern, F.lit(0)), _spaces)
    gaps = F.transform(F.split(words, pattern, -1), _spaces)

    def placed(n):
        both = F.zip_with(n, F.slice(gaps, 1, F.size(n)), lambda x, gap: x + gap)
        return let(sums(both), lambda ends: F.transform(n, lambda x, i: F.struct((F.get(ends, i) - x - 1).alias("start"), F.get(ends, i).alias("end"))))

    return let(found, lambda n: F.when(F.size(n) > 0, placed(n)).otherwise(F.array().cast("array<struct<start:int,end:int>>")))


def detections(words: Column) -> Column:
    """All places of all rules whose keyword is there: array of (start, end, priority, number, label)."""
    by_keyword: dict[str, list[Rule]] = {}
    for r in rules():
        by_keyword.setdefault(r.keyword, []).append(r)
    groups = F.array(
        *(
            F.struct(
                F.lit(f" {k} ").alias("keyword"),
                F.array(*(F.struct(F.lit(r.number).alias("number"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.pattern).alias("pattern")) for r in rs)).alias("rules"),
            )
            for k, rs in by_keyword.items()
        )
    )
    tried = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(words, g["keyword"])), lambda g: g["rules"]))
    spans = F.transform(
        tried,
        lambda r: F.transform(
            places(words, r["pattern"]),
            lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), r["priority"].alias("priority"), r["number"].alias("number"), r["label"].alias("label")),
        ),
    )
    return F.flatten(spans)


def surviving(spans: Column) -> Column:
    """The spans that no span of the same or a higher priority contains.

    In order of start (then longest, then highest priority, then rule), a span is contained if an earlier one of such a priority
    ends no sooner; so the furthest end so far of each priority and those above it is all that has to be known.
    """
    key = lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), (-s["priority"]).alias("c"), s["number"].alias("d"), s["label"].alias("e"))

    def of(ordered):
        furthest = F.struct(*(greatest_so_far(F.transform(ordered, lambda s: F.when(-s["c"] >= p, -s["b"]).otherwise(-1))).alias(f"p{p}") for p in LEVELS))

        def free(ends):
            def stays(s, i):
                end = F.lit(-1)
                for p in LEVELS:
                    end = F.when(-s["c"] == p, F.coalesce(F.get(ends[f"p{p}"], i - 1), F.lit(-1))).otherwise(end)
                return end < -s["b"]

            return F.filter(ordered, stays)

        return let(furthest, free)

    kept = let(F.array_sort(F.transform(spans, key)), of)
    return F.transform(kept, lambda s: F.struct(s["a"].alias("start"), (-s["b"]).alias("end"), (-s["c"]).alias("priority"), s["d"].alias("number"), s["e"].alias("label")))


def scanned(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` and n_words, ``base`` (array of (start, end, label)) and ``spans`` (the surviving detections)."""
    low = docs.select(*keep, F.lower(whole_text()).alias("_low"))
    gate = F.lit(False)
    for word in GATES:
        gate = gate | F.contains("_low", F.lit(word))
    words = low.select(*keep, F.regexp_count("_low", F.lit(WORD)).cast("long").alias("n_words"), F.when(gate, words_of(F.col("_low"))).alias("_words"))
    bases = F.array(*(F.struct(F.lit(f"(?<= ){p}(?= )").alias("pattern"), F.lit(label).alias("label")) for p, label in BASE.items()))
    base = F.flatten(
        F.transform(bases, lambda b: F.transform(places(F.col("_words"), b["pattern"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), b["label"].alias("label"))))
    )
    there = F.col("_words").isNotNull()
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    found = words.select(*keep, "n_words", F.when(there, base).otherwise(none).alias("base"), F.when(there, detections(F.col("_words"))).otherwise(F.array().cast(_SPAN)).alias("_all"))
    return found.select(*keep, "n_words", "base", F.when(F.size("_all") > 0, surviving(F.col("_all"))).otherwise(F.array().cast(_SPAN)).alias("spans"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(documents(spark, sf_dir), "doc_id")
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    starts = F.transform("base", lambda s: s["start"].cast("long"))
    best = F.array_max(F.concat(F.transform("spans", lambda s: s["priority"]), F.when(F.size("base") > 0, F.array(F.lit(BASE_SCORE))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(F.transform("base", lambda s: s["label"])).alias("base_labels"),
        listed(F.concat(F.transform("base", lambda s: s["label"]), F.transform("spans", lambda s: s["label"]))).alias("labels"),
        (best / 100).cast("double").alias("score"),
    )
