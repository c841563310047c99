"""Column rules of risk scoring. Confidence is counted in integer thousandths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points in thousandths, thresholds, ranks.
CODE, GAP, SCANNER, DEPENDENCY, DEVELOPER, SECOND_SOURCE, INFERENCE_ONLY, PER_ASSUMPTION = 350, 300, 250, 300, 300, 100, 200, -150
FLOOR, FLOOR_CERTAINTY, VISIBLE, HIGH, MEDIUM, SOON = 400, 800, 250, 700, 400, 500
SEVERITIES = ("critical", "high", "medium", "low")
PRIORITIES = ("fix_now", "fix_soon", "monitor")
CATEGORY_POINTS = {"code": CODE, "scanner": SCANNER, "dependency": DEPENDENCY, "developer": DEVELOPER}


def severity(impact: Column, likelihood: Column) -> Column:
    risk = impact * likelihood
    return F.when(risk >= 20, "critical").when(risk >= 12, "high").when(risk >= 6, "medium").when(risk.isNotNull(), "low")


def priority(severity_: Column, milli: Column) -> Column:
    return (
        F.when(severity_ == "critical", "fix_now")
        .when(severity_ == "high", F.when(milli >= SOON, "fix_now").otherwise("fix_soon"))
        .when((severity_ == "medium") & (milli >= SOON), "fix_soon")
        .otherwise("monitor")
    )


def confidence_label(milli: Column) -> Column:
    return F.when(milli >= HIGH, "high").when(milli >= MEDIUM, "medium").otherwise("low")


def visible(milli: Column) -> Column:
    return milli >= VISIBLE


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """Place in a fixed order; unknown values come last."""
    return F.coalesce(*(F.when(value == v, i) for i, v in enumerate(order)), F.lit(len(order)))


def category(kind: Column, source: Column, rule_id: Column) -> Column:
    """What an evidence item counts as. A gap's rule prefix is looked at first; scanner and dependency
    items count only from their own sources; assumptions and inferences are no observation."""
    return (
        F.when(F.coalesce(rule_id.startswith("gap:"), F.lit(False)), "gap")
        .when(kind.isin("code", "config", "route"), "code")
        .when((kind == "scanner") & (source == "semgrep"), "scanner")
        .when((kind == "dependency") & (source == "osv"), "dependency")
        .when(kind == "developer_answer", "developer")
        .when(kind == "inference", "inference")
    )


def gap_points(certainty: Column) -> Column:
    """Half up, as floor(x + 0.5); the certainty is clamped and a value that is no number adds nothing."""
    clamped = F.when(~F.isnan(certainty), F.greatest(F.lit(0.0), F.least(F.lit(1.0), certainty)))
    return F.floor(clamped * GAP + 0.5)


def milli_certainty(certainty: Column) -> Column:
    clamped = F.when(~F.isnan(certainty), F.greatest(F.lit(0.0), F.least(F.lit(1.0), certainty)))
    return F.floor(clamped * 1000 + 0.5)


def token_cost(input_: Column, output: Column, cache_read: Column, cache_write: Column, price_in: float, price_out: float) -> Column:
    """Dollars; cached reads cost a tenth of input, cache writes a quarter more. Reasoning is part of output."""
    return (input_ * price_in + cache_read * (price_in * 0.1) + cache_write * (price_in * 1.25) + output * price_out) / 1_000_000
