"""Score expressions: confidence, completeness, salience, rates and boosts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The parts of the composite confidence, and the prior, half-life and limits of salience.
RELIABILITY, COMPLETENESS, BEHAVIOUR = 0.30, 0.25, 0.45
ALPHA, BETA, HALF_LIFE_DAYS = 2.0, 1.0, 45.0


def completeness(description: Column, n_commands: Column, n_techniques: Column, first_observed: Column, n_sources: Column, n_platforms: Column, gap: Column) -> Column:
    """How complete a draft's context is, 0 to 100; missing fields count as empty."""
    n = F.coalesce(F.length(description), F.lit(0))
    points = F.when(n > 100, 25).when(n > 30, 15).when(n > 0, 5).otherwise(0)
    for test, worth in (
        (n_commands > 0, 25),
        (n_techniques >= 1, 15),
        (n_techniques >= 2, 5),
        (F.coalesce(first_observed, F.lit("")) != "", 10),
        (n_sources > 0, 10),
        (n_platforms > 0, 5),
        (~F.coalesce(gap, F.lit(False)), 5),
    ):
        points = points + F.when(test, worth).otherwise(0)
    return F.least(points, F.lit(100))


def composite_confidence(reliability: Column, complete: Column, behaviour: Column) -> Column:
    """Weighted parts, cut to a whole number from 0 to 100; reliability and behaviour are 50 if missing."""
    half = F.lit(50)
    total = RELIABILITY * F.coalesce(reliability, half) + COMPLETENESS * complete + BEHAVIOUR * F.coalesce(behaviour, half)
    return F.least(F.greatest(total.cast("int"), F.lit(0)), F.lit(100))


def age_days(then: Column, now: Column) -> Column:
    """Days between two times, 0 at least."""
    return F.greatest((F.unix_micros(now) - F.unix_micros(then)) / F.lit(86_400_000_000.0), F.lit(0.0))


def salience(hits: Column, misses: Column, occurrences: Column, last_seen: Column, now: Column) -> Column:
    """Share of hits with a mild prior, times decay by age, times the log of occurrences; no decay for a null time."""
    rate = (hits + ALPHA) / (hits + misses + ALPHA + BETA)
    recency = F.coalesce(F.pow(F.lit(0.5), age_days(last_seen, now) / HALF_LIFE_DAYS), F.lit(1.0))
    return rate * recency * F.log1p(F.greatest(occurrences, F.lit(0)))


def rate(agreed: Column, total: Column) -> Column:
    """agreed / total to three places; null for no total."""
    return F.when(total > 0, F.round(agreed / total, 3))


def lane(bucket: Column) -> Column:
    """possible goes to review, all else to the bundle; a missing bucket counts as probable."""
    return F.when(F.coalesce(bucket, F.lit("probable")) == "possible", "review").otherwise("bundle")
