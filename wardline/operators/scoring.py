"""Confidence, severity, basis and priority of findings from their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import scoring as S
from wardline.session import dealt


def best_per_location(items: DataFrame, key: str = "threat_id") -> DataFrame:
    """One item for each finding, file and line: most points, the first among equals. Gaps and items without a
    place are all kept, since two controls missing on one line are two facts."""
    single = F.col("category").eqNullSafe("gap") | F.col("file").isNull() | F.col("line").isNull()
    w = Window.partitionBy(key, F.when(single, F.col("pos")), single, "file", "line").orderBy(F.desc("points"), "pos")
    # dealt by the finding alone, which serves this window and the sums by finding that follow: one shuffle, not two
    return items.repartition(key).withColumn("__n", F.row_number().over(w)).where(single | (F.col("__n") == 1)).drop("__n")


def confidence(threats: DataFrame, citations: DataFrame) -> DataFrame:
    """threats with milli, confidence, basis and the sums behind them.

    threats: threat_id, assumptions (count), cwe (array). citations: threat_id, pos, kind, source, rule_id,
    file, line, certainty and gap_cwe (null unless a gap). A finding without citations gets what its
    assumptions leave of zero. Points count once for each category; the assumption penalty for each one.
    """
    cat = S.category(F.col("kind"), F.col("source"), F.col("rule_id"))
    points = F.coalesce(*(F.when(F.col("category") == k, F.lit(v)) for k, v in S.CATEGORY_POINTS.items()), F.when(F.col("category") == "gap", F.coalesce(S.gap_points(F.col("certainty")), F.lit(0))), F.lit(0))
    kept = best_per_location(citations.withColumn("category", cat).withColumn("points", points.cast("int")))
    is_ = lambda c: F.col("category") == c
    observed = ["code", "scanner", "dependency", "developer", "gap"]
    sums = kept.groupBy("threat_id").agg(
        *(F.coalesce(F.max(F.when(is_(c), F.col("points"))), F.lit(0)).alias(f"{c}_points") for c in observed),
        F.count_distinct(F.when(F.col("category").isin(observed), F.col("category"))).alias("n_categories"),
        F.coalesce(F.bool_or(is_("gap")), F.lit(False)).alias("has_gap"),
        F.coalesce(F.bool_or(is_("inference")), F.lit(False)).alias("has_inference"),
        F.coalesce(F.bool_or(F.col("category").isin([c for c in observed if c != "gap"])), F.lit(False)).alias("observed"),
        F.coalesce(F.sum(F.when(is_("gap"), S.milli_certainty(F.col("certainty")))), F.lit(0)).alias("certainty_sum"),
        F.array_distinct(F.flatten(F.collect_list(F.when(is_("gap"), F.col("gap_cwe"))))).alias("gap_cwes"),
    )
    d = threats.join(dealt(sums), "threat_id", "left")
    n = F.coalesce("n_categories", F.lit(0))
    total = sum((F.coalesce(f"{c}_points", F.lit(0)) for c in observed), F.lit(0))
    total = total + F.when(n >= 2, S.SECOND_SOURCE).otherwise(0) + F.when((n == 0) & F.coalesce("has_inference", F.lit(False)), S.INFERENCE_ONLY).otherwise(0)
    raw = total + S.PER_ASSUMPTION * F.coalesce("assumptions", F.lit(0))
    clamped = F.greatest(F.lit(0), F.least(F.lit(1000), raw))
    lifted = (n == 1) & F.coalesce("has_gap", F.lit(False)) & (F.col("certainty_sum") >= S.FLOOR_CERTAINTY) & (F.size("cwe") > 0) & (F.size(F.array_except("cwe", "gap_cwes")) == 0)
    milli = F.when(lifted & (clamped < S.FLOOR), S.FLOOR).otherwise(clamped).cast("int")
    return (
        d.withColumn("milli", milli)
        .withColumn("confidence", F.col("milli") / 1000)
        .withColumn("basis", F.when(F.coalesce("observed", F.lit(False)), "observed").otherwise("inferred"))
        .select(*threats.columns, "milli", "confidence", "basis")
    )


def score(threats: DataFrame, citations: DataFrame) -> DataFrame:
    """confidence() with severity, confidence_label, priority, visible. threats also has impact and likelihood."""
    sev = S.severity(F.col("impact"), F.col("likelihood"))
    return (
        confidence(threats, citations)
        .withColumn("severity", sev)
        .withColumn("confidence_label", S.confidence_label(F.col("milli")))
        .withColumn("priority", S.priority(F.col("severity"), F.col("milli")))
        .withColumn("visible", S.visible(F.col("milli")))
    )


def inherit_classification(threats: DataFrame, gaps: DataFrame, fallback: str = "A06:2025") -> DataFrame:
    """Findings that only rest on gaps and name no category take the union of their gaps', else the fallback.

    threats: threat_id, owasp (array), gap_only; gaps: threat_id, owasp (array)."""
    own = gaps.groupBy("threat_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("owasp")))).alias("__gap"))
    d = threats.join(own, "threat_id", "left")
    taken = F.when(F.size(F.coalesce("__gap", F.array().cast("array<string>"))) > 0, F.col("__gap")).otherwise(F.array(F.lit(fallback)))
    return d.withColumn("owasp", F.when(F.col("gap_only") & (F.size("owasp") == 0), taken).otherwise(F.col("owasp"))).drop("__gap")


# How a category of evidence is put into words where points would mislead, in order.
QUALITATIVE = (
    ("code", "Confirmed in code"), ("gap", "A missing control was detected"), ("scanner", "Confirmed by a scanner rule"), ("dependency", "Confirmed by a known vulnerable dependency"),
    ("developer", "Confirmed by a developer answer"), ("inference", "Rests on an inference, used only because nothing else supports it"),
)


def explain(threats: DataFrame, citations: DataFrame) -> DataFrame:
    """(threat_id, exact, lines): why a finding has its confidence. threats: threat_id, milli, assumptions; citations as in
    confidence(). Without a gap the lines carry the points, and exact says whether they add up to what is stored; with
    one, whose certainty is not stored, they say what is there and whether the floor applied."""
    c = citations.withColumn("category", S.category(F.col("kind"), F.col("source"), F.col("rule_id"))).where("category is not null")
    has = c.groupBy("threat_id").agg(F.collect_set("category").alias("__c"))
    d = threats.join(has, "threat_id", "left").withColumn("__c", F.coalesce("__c", F.array().cast("array<string>")))
    there = lambda k: F.array_contains("__c", k)
    solid = [k for k, _ in QUALITATIVE if k != "inference"]
    points = {k: v for k, v in S.CATEGORY_POINTS.items() if k in solid and k != "gap"}
    count = F.size(F.array_intersect("__c", F.array(*map(F.lit, solid))))
    alone = (count == 0) & there("inference")
    total = sum((F.when(there(k), v).otherwise(0) for k, v in points.items()), F.lit(0)) + F.when(count >= 2, 100).otherwise(0) + F.when(alone, 200).otherwise(0) - 150 * F.col("assumptions")
    exact = ~there("gap") & (F.greatest(F.lit(0), F.least(F.lit(1000), total)) == F.col("milli"))
    numbered = [F.when(there(k), F.lit(f"{k} +{v}")) for k, v in points.items()] + [F.when(count >= 2, F.lit("two kinds of evidence +100")), F.when(alone, F.lit("inference +200")), F.when(F.col("assumptions") > 0, F.format_string("assumptions -%d", 150 * F.col("assumptions")))]
    only_gaps = there("gap") & (F.size(F.array_except("__c", F.array(F.lit("gap"), F.lit("inference")))) == 0)
    floor = F.when(only_gaps & (F.col("milli") == 400), F.lit("Raised to the minimum of 40 %")).when(only_gaps & (F.col("milli") < 400), F.lit("Not raised to the minimum of 40 %"))
    worded = [F.when(there(k), F.lit(text)) for k, text in QUALITATIVE] + [F.when(F.col("assumptions") > 0, F.format_string("Lowered by %d unconfirmed assumptions", "assumptions")), floor]
    kept = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return d.select("threat_id", exact.alias("exact"), F.when(exact, kept(numbered)).otherwise(kept(worded)).alias("lines"))
