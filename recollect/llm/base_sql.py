"""The columns of the operators' contracts that SQL can express, as queries of their own with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .licenses import BASE, op2_licenses
from .pii import op10_pii
from .quality import op4_quality


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.length("base_sha256").alias("digest_chars"))


def _places(phrase: str) -> str:
    words = phrase.split()
    here = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"list_filter(range(1, len(w) + 1), lambda i: {here})"


_PHRASES = list(BASE.items())
_CARD = "list_transform(list_reverse(string_split(regexp_replace(v, '[^0-9]', '', 'g'), '')), lambda c: CAST(c AS INTEGER))"
_LUHN = f"list_sum(list_transform({_CARD}, lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)) % 10 = 0"
_DIGITS = "length(regexp_replace(v, '[^0-9]', '', 'g'))"

SQL = {
    "base_licenses": f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        p AS (SELECT doc_id, w, {", ".join(f"{_places(p)} AS p{k}" for k, (p, _) in enumerate(_PHRASES))} FROM d),
        a AS (SELECT *, list_concat({", ".join(f"p{k}" for k in range(len(_PHRASES)))}) AS al FROM p)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(al) AS BIGINT) AS n_base, list_min(al) - 1 AS first_word, list_max(al) - 1 AS last_word,
        array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(_PHRASES))}], lambda x: x IS NOT NULL)), ',') AS base_labels FROM a""",
    "base_quality": """WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        x AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
        y AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM x), z AS (SELECT DISTINCT r, i + k AS at FROM y, range(0, 8) s(k) WHERE n > 1), rep AS (SELECT r, count(*) AS n FROM z GROUP BY r),
        l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS l FROM d)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed
        FROM d JOIN l USING (r) LEFT JOIN rep USING (r)""",
    "base_pii": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        e AS (SELECT r, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS n_email, regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)') AS ips, regexp_extract_all(t, '[0-9]([ -]?[0-9])+') AS cards, regexp_extract_all(t, '\\+[0-9][ ().0-9-]+[0-9]') AS phones FROM d)
        SELECT doc_id, CAST(n_email AS BIGINT) AS n_email, CAST(len(list_filter(ips, lambda v: len(list_filter(string_split(v, '.'), lambda p: TRY_CAST(p AS HUGEINT) IS NULL OR CAST(p AS HUGEINT) > 255)) = 0)) AS BIGINT) AS n_ip,
        CAST(len(list_filter(cards, lambda v: {_DIGITS} BETWEEN 13 AND 19 AND {_LUHN})) AS BIGINT) AS n_card, CAST(len(list_filter(phones, lambda v: {_DIGITS} BETWEEN 9 AND 15)) AS BIGINT) AS n_phone, 64 AS digest_chars FROM d JOIN e USING (r)""",
}
