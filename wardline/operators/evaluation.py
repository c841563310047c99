"""Measures of findings against labels and of runs against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(a: Column, b: Column) -> Column:
    """Null where the denominator is zero."""
    return F.try_divide(a.cast("double"), b)


def confusion(rows: DataFrame, truth: Column, said: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, false_rate."""
    n = lambda c: F.count(F.when(c, 1))
    d = rows.agg(n(truth & said).alias("tp"), n(~truth & said).alias("fp"), n(truth & ~said).alias("fn"), n(~truth & ~said).alias("tn"))
    return d.select("*", rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), rate(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_rate"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement and Cohen's kappa of two labels; null without pairs or where chance alone agrees always."""
    p = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))  # at most categories squared
    left, right = p.groupBy(F.col(a).alias("k")).agg(F.sum("n").alias("x")), p.groupBy(F.col(b).alias("k")).agg(F.sum("n").alias("y"))
    zero = F.lit(0).cast("bigint")
    seen = p.select(F.col("n").alias("total"), F.when(F.col(a) == F.col(b), F.col("n")).otherwise(zero).alias("same"), zero.alias("chance"))
    by_chance = left.join(right, "k").select(zero.alias("total"), zero.alias("same"), (F.col("x") * F.col("y")).alias("chance"))
    both = seen.unionByName(by_chance).agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("total", "same", "chance")))
    po, pe = rate(F.col("same"), F.col("total")), rate(F.col("chance"), F.col("total") * F.col("total"))
    return both.select(F.col("total").alias("n"), po.alias("agreement"), F.try_divide(po - pe, F.when(pe != 1, 1 - pe)).alias("kappa"))


def pairwise_jaccard(keys: DataFrame, run: str = "run", key: str = "key") -> DataFrame:
    """(a, b, jaccard) of each two runs' key sets; two empty sets would be 1. The number of runs is small by
    nature; keys are joined within their own value only, through an array of the runs that have them."""
    k = keys.select(run, key).distinct()
    sizes = k.groupBy(run).agg(F.count("*").alias("n"))
    having = k.groupBy(key).agg(F.array_sort(F.collect_list(run)).alias("runs"))
    pairs = having.select(F.explode("runs").alias("a"), "runs").select("a", F.explode("runs").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct(F.col(run).alias("run"), "n"))).alias("all"))
    every = listed.select(F.explode("all").alias("p"), "all").select("p", F.explode("all").alias("q")).where("p.run < q.run").select(F.col("p.run").alias("a"), F.col("p.n").alias("na"), F.col("q.run").alias("b"), F.col("q.n").alias("nb"))
    return every.join(pairs, ["a", "b"], "left").select("a", "b", (F.coalesce("common", F.lit(0)) / (F.col("na") + F.col("nb") - F.coalesce("common", F.lit(0)))).alias("jaccard"))


def presence(keys: DataFrame, run: str = "run", key: str = "key") -> DataFrame:
    """(runs, keys): how many keys are in how many runs."""
    return keys.groupBy(key).agg(F.count_distinct(run).alias("runs")).groupBy("runs").agg(F.count("*").alias("keys"))


def agreement(rows: DataFrame, n_runs: int, value: str, run: str = "run", key: str = "key") -> DataFrame:
    """Of the keys in every run: how many have one value in all of them."""
    in_all = rows.groupBy(key).agg(F.count_distinct(run).alias("r"), F.count_distinct(value).alias("v")).where(F.col("r") == n_runs)
    return in_all.agg(F.count("*").alias("keys"), F.count(F.when(F.col("v") == 1, 1)).alias("same")).select("keys", "same", rate(F.col("same"), F.col("keys")).alias("share"))


def crosstab(rows: DataFrame, code: str, run: str, runs: list) -> DataFrame:
    """code by run counts, zero filled, in one pass."""
    return rows.groupBy(code).agg(*(F.count(F.when(F.col(run) == r, 1)).alias(f"run_{r}") for r in runs))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number differs, with both numbers; empty where the two are equal as multisets."""
    both = a.select("*", F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select("*", F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    return both.groupBy(*a.columns).agg(F.sum("__a").alias("n_a"), F.sum("__b").alias("n_b")).where("n_a <> n_b")


def duplicate_findings(matches: DataFrame) -> DataFrame:
    """(finding, duplicate): a finding is a duplicate if each issue it matches was matched by an earlier one.
    matches: finding (in order), issue."""
    first = matches.withColumn("f", F.min("finding").over(Window.partitionBy("issue")))
    return first.groupBy("finding").agg(F.bool_and(F.col("f") < F.col("finding")).alias("duplicate"))


def match_findings(findings: DataFrame, issues: DataFrame) -> DataFrame:
    """(finding, issue) with the same file and a kind that the issue names as gap kind or rule. One equi-join."""
    kinds = issues.select("issue", "file", F.explode(F.array_distinct(F.filter(F.array("gap_kind", "rule_id"), lambda x: x.isNotNull()))).alias("kind"))
    return findings.join(kinds, ["file", "kind"]).select("finding", "issue").distinct()


def falsified_controls(gaps: DataFrame, controls: DataFrame) -> DataFrame:
    """Controls that a gap contradicts: the same kind, and the same file or a gap of the whole repository. Two
    equi-joins in place of a join with an OR."""
    same_file = controls.join(gaps.select("kind", "file").distinct(), ["kind", "file"], "left_semi")
    whole = controls.join(gaps.where("scope = 'repository'").select("kind").distinct(), "kind", "left_semi")
    return same_file.select(*controls.columns).unionByName(whole.select(*controls.columns)).distinct()


def by_class(items: DataFrame, classes: str, hit: str) -> DataFrame:
    """planted, found and missed for each class; an item of several classes counts in each. A1..A10 in number order."""
    d = items.select(F.explode(F.split(F.regexp_replace(classes, r"\s+", ""), "[;,]")).alias("class"), hit).where("class <> ''")
    out = d.groupBy("class").agg(F.count("*").alias("planted"), F.count(F.when(F.col(hit), 1)).alias("found"))
    return out.select("class", "planted", "found", (F.col("planted") - F.col("found")).alias("missed"), F.try_to_number(F.regexp_extract("class", r"(\d+)", 1), F.lit("9999")).cast("int").alias("place"))


def pooled(counts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows and one total row (key null): sums of counts, not means of rates."""
    return counts.rollup(key).agg(*(F.sum(c).alias(c) for c in columns))


def run_digest(rows: DataFrame, run: str = "run") -> DataFrame:
    """(run, sha256) of each run's rows in any order. Row digests are sorted and hashed by their first three digits, then
    the 4,096 parts, so a large run is no single array."""
    columns = sorted(c for c in rows.columns if c != run)
    line = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    whole = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    parts = rows.select(run, line.alias("h")).groupBy(run, F.substring("h", 1, 3).alias("part")).agg(whole("h").alias("h"))
    return parts.groupBy(run).agg(whole(F.concat_ws(":", "part", "h")).alias("sha256"))


def stats(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"))


def question_value(groups: DataFrame) -> DataFrame:
    """(group, value) = largest severity weight * (1 - mean confidence) * log2(1 + n). groups: group, weight, confidence."""
    return groups.groupBy("group").agg((F.max("weight") * (1 - F.avg("confidence")) * F.log2(F.lit(1) + F.count("*"))).alias("value"))


def usage_totals(ledger: DataFrame) -> DataFrame:
    """Totals by analysis; a call and attempt counts once, calls without an id always."""
    known = ledger.where("call_id is not null").dropDuplicates(["call_id", "attempt"])
    return known.unionByName(ledger.where("call_id is null")).groupBy("analysis_id").agg(F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")))


def finding_order() -> list:
    """The order of reported findings: file, line, source, kind."""
    return ["file", "line", "source", "kind"]


def consistency(rows: DataFrame) -> DataFrame:
    """(measure, runs, value): how alike runs of one repository are. rows: run, key, severity, milli. Sizes, the mean
    similarity of each two runs' keys, the keys that every run has, and of those the share with one severity."""
    n_runs = rows.select("run").distinct().count()  # a handful by nature
    sizes = rows.groupBy("run").agg(F.count_distinct("key").alias("n"))
    say = lambda d, name, c: d.select(F.lit(name).alias("measure"), F.lit(n_runs).cast("bigint").alias("runs"), F.col(c).cast("double").alias("value"))
    keys = rows.select("run", "key").distinct()
    in_all = presence(keys).where(F.col("runs") == n_runs).agg(F.coalesce(F.sum("keys"), F.lit(0)).alias("v"))
    return (
        say(sizes.agg(F.min("n").alias("v")), "smallest run", "v").unionByName(say(sizes.agg(F.max("n").alias("v")), "largest run", "v"))
        .unionByName(say(pairwise_jaccard(keys).agg(F.avg("jaccard").alias("v")), "mean similarity", "v")).unionByName(say(in_all, "keys of all runs", "v"))
        .unionByName(say(agreement(rows, n_runs, "severity"), "same severity", "share"))
    )
