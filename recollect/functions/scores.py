"""Scores as column expressions, and the same as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.config import CONFIG, Config


def age_days(at: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400_000_000.0)


def decay(age: Column, kind: Column, config: Config = CONFIG) -> Column:
    """0.5 ^ (age / half-life of the type); an unknown or negative age counts as half."""
    half = F.lit(config.other_half_life)
    for name, days in config.half_lives.items():
        half = F.when(kind == name, days).otherwise(half)
    return F.when(age.isNull() | (age < 0), 0.5).otherwise(F.pow(F.lit(0.5), age / half))


def rounded(value: Column, places: int) -> Column:
    """`value` rounded as SQL engines round a double: scaled, rounded half away from zero and scaled back.  F.round works on the shortest decimal
    writing instead, which lifts 0.81725 to 0.8173 though the double lies below it; scores that tie in SQL would come apart."""
    scale = F.lit(float(10**places))
    return F.round(value * scale) / scale


def activation(pinned: Column, importance: Column, fresh: Column, access: Column, confidence: Column, emotion: Column | None = None, context: Column | None = None) -> Column:
    value = F.coalesce(importance, F.lit(0.5)) * (0.4 + 0.6 * fresh) + F.least(access, F.lit(8)) * 0.06 + F.coalesce(confidence, F.lit(0.5)) * 0.4
    if emotion is not None:
        value = value + F.coalesce(emotion, F.lit(0.0)) * 0.15
    if context is not None:
        value = value + F.coalesce(context, F.lit(0.0)) * 0.8
    return F.when(pinned, F.lit(10.0)).otherwise(rounded(value, 4))


def rrf(rank: Column, weight: float = 1.0, config: Config = CONFIG) -> Column:
    return F.lit(weight) / (config.rrf_k + rank)


def adjusted(score: Column, *, pinned: Column, status: Column, layer: Column, fresh: Column, dated: Column, goal: Column | None = None, hinted: Column | None = None, echo: Column | None = None, stale: Column | None = None, summary: Column | None = None, config: Config = CONFIG) -> Column:
    """The chain of bonuses and factors, in this order; a missing input is neutral."""
    confirmed = status == "confirmed"
    out = score + F.when(pinned, config.pin_bonus).when(confirmed, config.confirmed_bonus).otherwise(0.0)
    if goal is not None:
        out = out + config.goal_weight * goal
    if hinted is not None:
        out = out + F.when(hinted, config.hint_bonus).otherwise(0.0)
    if echo is not None:
        out = out * F.when(echo, config.echo_factor).otherwise(1.0)
    out = out * F.when(layer == "cold", config.cold_factor).otherwise(1.0)
    out = out * F.when(dated & ~pinned & ~confirmed, 0.4 + 0.6 * fresh).otherwise(1.0)
    if summary is not None:
        out = out * F.when(summary, config.summary_factor).otherwise(1.0)
    if stale is not None:
        out = out * F.when(stale, config.stale_factor).otherwise(1.0)
    return out


AGE_SQL = f"(epoch_us(TIMESTAMP '{CONFIG.now}') - epoch_us(valid_from)) / 86400000000.0::DOUBLE"
DECAY_SQL = f"pow(0.5::DOUBLE, ({AGE_SQL}) / CASE fact_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in CONFIG.half_lives.items()) + f" ELSE {CONFIG.other_half_life}::DOUBLE END)"
ACTIVATION_SQL = f"CASE WHEN pinned THEN 10.0::DOUBLE ELSE round(importance * (0.4::DOUBLE + 0.6::DOUBLE * {DECAY_SQL}) + least(access_count, 8) * 0.06::DOUBLE + confidence * 0.4::DOUBLE, 4) END"
