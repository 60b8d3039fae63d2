"""Scores as column expressions: recency, boosts, evidence, decisions, formats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE = 180
RECENCY_WEIGHT, PRIMARY, SECONDARY, VERSION_WEIGHT, AUTHORITY_WEIGHT = 0.1, 0.1, 0.05, 0.1, 0.05
FLOOR, STRONG, GAP, CONFLICT_GAP, TOPICS, MASK_CAP = 0.5229, 0.90, 0.20, 0.005, 2, 5
ANSWERABLE, PARTIAL = 0.80, 0.60
#: Cost per token by model; other models cost nothing.
PRICES = {"small": (0.15e-6, 0.6e-6), "large": (2.5e-6, 10e-6)}


def rate(part: Column, whole: Column) -> Column:
    """Per cent, 0 of nothing."""
    return F.coalesce(F.try_divide(F.lit(100.0) * part, whole), F.lit(0.0))


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    out = F.try_divide(part.cast("double"), whole)
    return out if empty is None else F.coalesce(out, F.lit(empty))


def recency(modified: Column, as_of: Column, half_life: int = HALF_LIFE) -> Column:
    """Half for every half-life of whole days; 1 for the future, 0 without a date."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(modified)
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(F.floor(seconds / 86400), F.lit(0)) / half_life), F.lit(0.0))


def domain_boost(domain: Column, wanted: Column) -> Column:
    """PRIMARY for the first wanted domain, SECONDARY for the others."""
    rest = F.when(F.size(wanted) > 1, F.array_contains(F.slice(wanted, F.lit(2), F.size(wanted)), domain)).otherwise(False)
    return F.coalesce(F.when(F.get(wanted, F.lit(0)) == domain, PRIMARY).when(rest, SECONDARY), F.lit(0.0))


def boosted(raw: Column, recent: Column, domain: Column, fit: Column, tier: Column) -> Column:
    """The score to rank by; raw itself stays for thresholds."""
    return raw + RECENCY_WEIGHT * recent + domain + VERSION_WEIGHT * fit + AUTHORITY_WEIGHT * tier


def tier_of(site: Column, tiers: Mapping[str, float], default: float = 1.0) -> Column:
    if not tiers:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in tiers.items() for x in p)), site), F.lit(default))


def evidence(fit: Column, authority: Column, w_fit: float = 0.8, w_authority: float = 0.2) -> Column:
    return (w_fit * fit + w_authority * authority) / ((w_fit + w_authority) or 1.0)


def overall(mean: Column, coverage: Column, duplication: Column, weights: Sequence[float] = (0.5, 0.3, 0.2)) -> Column:
    a, b, c = weights
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (a * mean + b * coverage + c * (1 - duplication)) / ((a + b + c) or 1.0)))


def answerability(conflicting: Column, deprecated: Column, documents: Column, score: Column) -> Column:
    return (
        F.when(conflicting, "conflicting_evidence")
        .when(deprecated, "outdated_evidence")
        .when(documents == 0, "not_enough_evidence")
        .when(score >= ANSWERABLE, "answerable")
        .when(score >= PARTIAL, "partially_answerable")
        .otherwise("not_enough_evidence")
    )


def result_bucket(failed: Column, retries: Column, status: Column) -> Column:
    bad = failed | status.isin("failed", "blocked", "not_enough_evidence")
    return F.when(bad, "failure").when(retries > 0, "requery").when(status.isin("answerable", "partially_answerable"), "success").otherwise("failure")


def cost(model: Column, prompt: Column, completion: Column, prices: Mapping[str, tuple[float, float]] = PRICES) -> Column:
    out = F.lit(0.0)
    for name, (a, b) in prices.items():
        out = F.when(model == name, F.bround(prompt * F.lit(a) + completion * F.lit(b), 6)).otherwise(out)
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def backoff(attempt: Column, most: int = 60) -> Column:
    return F.least(F.lit(most).cast("double"), F.pow(F.lit(2.0), attempt))


def progress(done: Column, failed: Column, total: Column) -> Column:
    return F.when(total > 0, F.bround((done + failed) / total * 100, 2)).otherwise(0.0)


def router_gate(domains: Column, confidence: Column, least: float = 0.5) -> Column:
    """No domains where the router isn't confident."""
    return F.when(confidence < least, F.array().cast("array<string>")).otherwise(domains)


def tokens_text(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fK", n / 1e3)).otherwise(F.format_string("%d", n.cast("long")))


def duration_text(ms: Column) -> Column:
    return F.when(ms >= 1000, F.format_string("%.1fs", ms / 1e3)).otherwise(F.format_string("%dms", ms.cast("long")))


def usd_text(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 2))


def token_label(n: Column) -> Column:
    return F.concat(F.format_number(n.cast("long"), 0), F.lit(" 토큰"))


def duration_label(ms: Column) -> Column:
    whole = F.concat(F.bround(ms, 0).cast("long").cast("string"), F.lit("ms"))
    return F.when(ms <= 0, "0ms").when(ms < 1000, whole).otherwise(F.concat(F.format_string("%.1f", ms / 1000), F.lit("초")))


def percent_label(value: Column) -> Column:
    near = F.abs(value - F.bround(value, 0)) < 0.05
    return F.when(near, F.concat(F.bround(value, 0).cast("long").cast("string"), F.lit("%"))).otherwise(F.concat(F.format_string("%.1f", value), F.lit("%")))


def bar_width(value: Column) -> Column:
    """The width of a bar in per cent, between 6 and 100."""
    return F.bround(F.greatest(F.lit(6.0), F.least(F.lit(100.0), value)), 0)


def axis_top(value: Column) -> Column:
    """The top of a chart's axis: rounded up to 10, 1 or 0.01 by magnitude."""
    return F.when(value >= 10, F.ceil(value / 10) * 10.0).when(value >= 1, F.ceil(value) * 1.0).otherwise(F.ceil(value * 100) / 100.0)
