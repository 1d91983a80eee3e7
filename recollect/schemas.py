"""Schemas of the tables, and validators that stand in for triggers and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVIDENCE = "id long, ext_id string, captured_at timestamp, occurred_at timestamp, source_kind string, source_actor string, source_path string, source_locator string, content string, content_sha256 string, verification_status string, verified_at timestamp"
FACTS = "fact_id long, ext_id string, subject string, fact_type string, content string, content_sha256 string, valid_from timestamp, supersedes_id long, created_at timestamp"
FACT_STATE = "fact_id long, version int, status string, valid_to timestamp, layer string, user_pinned boolean, importance double, emotion double, confidence double, access_count int, last_accessed timestamp, updated_at timestamp"
ENUMS = {
    "fact_type": ("semantic", "episodic", "procedural", "preference"),
    "status": ("candidate", "confirmed", "superseded", "invalid", "uncertain"),
    "layer": ("active", "cold"),
    "tier": ("primary", "secondary", "derived"),
    "verification_status": ("verified", "unverified", "uncertain", "broken"),
    "source_kind": ("chat", "file", "tool_result", "human_stated", "external"),
}


def bad_enums(df: DataFrame) -> DataFrame:
    """Rows with a value outside its domain."""
    wrong = F.lit(False)
    for name, values in ENUMS.items():
        if name in df.columns:
            wrong = wrong | ~F.coalesce(F.col(name).isin(*values), F.lit(False))
    return df.filter(wrong)


def bad_scores(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a score outside 0 to 1; null is allowed."""
    wrong = F.lit(False)
    for c in columns:
        wrong = wrong | F.coalesce(~F.col(c).between(0, 1), F.lit(False))
    return df.filter(wrong)


def changed(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of an append-only table that are gone from, or altered in, the new state; must be empty."""
    return old.select(*key).join(new.select(*key), list(key), "left_anti")


def orphans(child: DataFrame, parent: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose reference leads nowhere."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")
