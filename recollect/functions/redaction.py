"""Masking of secrets in texts.

A text is cut into tokens (addresses of the web, and runs of twelve signs of keys or more), and each token is judged by itself and by what leads to it:

* a token of a public key format (`FORMATS`), whatever surrounds it;
* a token behind ``Bearer``, or behind a telling name (`NAMES`) and what assigns it, if its signs are mixed or it is a long hexadecimal number;
* a part of an address, and a long token anywhere, if its signs are mixed.

How mixed a token is: the share of its letters and digits that follow one of another class (small, capital, digit) directly.  Keys change class at every
second sign or so, words, names of files, dates and paths hardly ever; so no dictionary and no frequencies are needed.  UUIDs and hexadecimal digests stay unless they are
assigned to a telling name (UUIDs stay there as well), and so do public keys, what is assigned to an id, and names of files.

A mask keeps the kind, the first four characters and the last two, and is no token itself, so a text that is masked twice is masked once.  Null stays null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"https?://[^\s\"'<>]+|[A-Za-z0-9](?:[A-Za-z0-9_+~=-]|[.:](?=[A-Za-z0-9])){11,}"
#: Public key formats, by the beginning of a token (fixed values).
FORMATS = [
    ("github", r"^(?:github_pat_\w{20,}|gh[opsur]_[A-Za-z0-9]{20,})"),
    ("gitlab", r"^glpat-[\w-]{20,}"),
    ("sk", r"^sk-[\w-]{16,}"),
    ("slack", r"^xox[a-z]?-[A-Za-z0-9-]{10,}"),
    ("aws", r"^A(?:KI|SI)A[0-9A-Z]{16}$"),
    ("google", r"^AIza[\w-]{35}"),
    ("tg", r"^[0-9]{8,10}:[\w-]{35}$"),
    ("jwt", r"^eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{5,}"),
]
#: Names of what is secret; 密钥, 令牌, 口令 and 密码 are key, token and passwords.
NAMES = ("secret", "token", "password", "passwd", "passphrase", "credential", "api[ _-]?key", "access[ _-]?key", "private[ _-]?key", "auth[ _-]?key", "密钥", "令牌", "口令", "密码")
NAMED = rf"(?i)(?:{'|'.join(NAMES)})\w{{0,12}}['\"]?\s*(?:=>|:=|[:=：]|\bis\b|是|为|\s)\s*[`'\"“‘]?$"
BEARER = r"(?i)\bbearer\s+$"
#: What leads to a token that is public: the type of a public key, or an id.
PUBLIC = r"(?:(?:ssh|ecdsa)-[a-z0-9@.-]+\s+|(?i:id)['\"`]?\s*[:=]\s*['\"`]?)$"
UUID = r"^\p{XDigit}{8}(?:-\p{XDigit}{4}){3}-\p{XDigit}{12}$"
HEX = r"^\p{XDigit}+$"
#: A letter or digit that follows one of another class.
CHANGE = r"(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"
SEGMENT = r"[A-Za-z0-9_-]{16,}"


@dataclass(frozen=True)
class Limits:
    """From which share of changes a token counts as mixed, and the least lengths of what is assigned, of hexadecimal keys and of tokens anywhere."""

    named_mixed: float = 0.2
    mixed: float = 0.25
    named: int = 16
    digest: int = 20
    anywhere: int = 32


LIMITS = Limits()


def mask(kind: str, token: Column) -> Column:
    return F.concat(F.lit(f"[redacted:{kind}:"), F.substring(token, 1, 4), F.lit("…"), F.right(token, F.lit(2)), F.lit("]"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is looked at."""
    return F.element_at(F.transform(F.array(value), use), 1)


def rewritten(text: Column, pattern: str, by: Callable[[Column, Column, Column], Column]) -> Column:
    """`text` with each match replaced by what `by` makes of it, of what leads to it (from the match before on) and of the text behind it."""

    def joined(s):
        lead = lambda i: F.concat(F.when(i > 0, F.get(s["found"], i - 1)).otherwise(""), F.get(s["gaps"], i))
        each = F.transform(s["found"], lambda v, i: F.concat(F.get(s["gaps"], i), by(v, lead(i), F.get(s["gaps"], i + 1))))
        return F.concat(F.array_join(each, ""), F.element_at(s["gaps"], -1))

    both = lambda t: F.struct(F.split(t, pattern, -1).alias("gaps"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found"))
    return let(text, lambda t: F.when(t.rlike(pattern), let(both(t), joined)).otherwise(t))


def mixed(token: Column) -> Column:
    """The share of letters and digits that follow one of another class; 0 for a token without two digits and a letter."""
    signs = F.length(F.regexp_replace(token, "[^A-Za-z0-9]", ""))
    return F.when(token.rlike("[A-Za-z]") & token.rlike("[0-9].*[0-9]"), F.regexp_count(token, F.lit(CHANGE)) / signs).otherwise(0.0)


def kind_of(token: Column, lead: Column, rest: Column, limits: Limits = LIMITS) -> Column:
    """The kind of secret that a token is, or null."""
    out = F.when(token.rlike(UUID), F.lit(None).cast("string"))
    for kind, pattern in FORMATS:
        out = out.when(token.rlike(pattern), kind)
    digest = token.rlike(HEX)
    telling = F.when(digest, (F.length(token) >= limits.digest) & token.rlike("[0-9]") & token.rlike("[A-Fa-f]")).otherwise((F.length(token) >= limits.named) & (mixed(token) >= limits.named_mixed))
    out = out.when(lead.rlike(BEARER) & (F.length(token) >= limits.named), "bearer").when(lead.rlike(NAMED) & telling, "named")
    anywhere = (F.length(token) >= limits.anywhere) & ~digest & (mixed(token) >= limits.mixed)
    file = token.rlike(r"\.[A-Za-z0-9]{2,5}$") & ~token.rlike(r"\..*\.")
    return out.when(anywhere & ~lead.rlike(PUBLIC) & ~file, "random")


def _address(url: Column, limits: Limits) -> Column:
    """An address with its mixed parts masked, but for names of files."""

    def part(v, lead, rest):
        secret = ~v.rlike(UUID) & ~v.rlike(HEX) & (mixed(v) >= limits.mixed) & ~rest.rlike(r"^\.[A-Za-z0-9]{2,5}(?:$|[?#])")
        return F.when(secret, mask("url", v)).otherwise(v)

    return rewritten(url, SEGMENT, part)


def redacted(text: Column, limits: Limits = LIMITS) -> Column:
    """`text` with its secrets masked."""

    def by(token, lead, rest):
        found = let(kind_of(token, lead, rest, limits), lambda kind: F.when(kind.isNull(), token).otherwise(F.concat(F.lit("[redacted:"), kind, F.lit(":"), F.substring(token, 1, 4), F.lit("…"), F.right(token, F.lit(2)), F.lit("]"))))
        return F.when(token.rlike("^https?://"), _address(token, limits)).otherwise(found)

    return rewritten(text, TOKEN, by)


def masks(text: Column) -> Column:
    """How many secrets of each kind were masked in a text: (kind, n), sorted."""
    kinds = F.regexp_extract_all(text, F.lit(r"\[redacted:([a-z]+):"), F.lit(1))
    return F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k.alias("kind"), F.size(F.filter(kinds, lambda x: x == k)).alias("n")))
