"""Requests and scanner results at the door: errors, allowlists, client keys, coalescing, finding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.guards import redact
from wardline.functions.text import one_line, owasp_codes

# Wording of upstream failures and the code it stands for; the first that matches decides.
UPSTREAM = (
    ("TIMEOUT", r"timed out|timeout|etimedout|abort"),
    ("UPSTREAM_RATE_LIMITED", r"rate limit|secondary rate|too many requests|\b429\b|(?s)(?=.*(?:\b403\b|forbidden))(?=.*(?:limit|quota|abuse))"),
    ("REPO_NOT_FOUND", r"\b404\b|not found|\b403\b|forbidden"),
    ("REPO_TOO_LARGE", r"too large|exceeds|size limit"),
)


def error_code(message: Column, otherwise: str = "AI_FAILURE") -> Column:
    """The code of an upstream failure; ``otherwise`` where its wording says nothing. A refusal that speaks of a limit is a
    rate limit, any other refusal hides what is there."""
    return F.coalesce(*(F.when(F.lower(message).rlike(p), F.lit(c)) for c, p in UPSTREAM), F.lit(otherwise))


def provider_category(status: Column, message: Column) -> Column:
    """What an answer of a model service means: auth, quota, rate, input, overload or unknown."""
    return (
        F.when(status.isin(401, 403), "auth").when(status == 402, "quota").when((status == 429) & message.rlike("(?i)quota|billing|credit"), "quota").when(status == 429, "rate")
        .when(status.isin(400, 413, 422), "input").when(status >= 500, "overload").otherwise("unknown")
    )


def client_key(forwarded: Column) -> Column:
    """The right-most hop, which the nearest proxy wrote; else unknown."""
    hop = F.trim(F.element_at(F.split(F.coalesce(forwarded, F.lit("")), ","), -1))
    return F.when(hop == "", "unknown").otherwise(hop)


def allowed_owners(requests: DataFrame, setting: str | None) -> DataFrame:
    """Requests of allowed owners. No setting allows all; a setting without one valid name allows none."""
    if setting is None or not setting.strip():
        return requests
    names = F.filter(F.transform(F.split(F.lit(setting), ","), lambda x: F.lower(F.trim(x))), lambda x: x.rlike(r"^[a-z0-9](?:[a-z0-9-]{0,38})\z"))
    return requests.where(F.array_contains(names, F.lower("owner")))


def coalesced(requests: DataFrame) -> DataFrame:
    """requests (id, owner, repo, ref, level, started, ended) with job: the running one of the same repository, ref and
    level that a request joins, else itself. Owner and repository match in any case."""
    w = Window.partitionBy(F.lower("owner"), F.lower("repo"), "ref", "level").orderBy("started", "id")
    until = F.max(F.coalesce("ended", F.lit("9999-12-31").cast("timestamp"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = requests.withColumn("__new", F.when(F.col("started") < until, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    return d.withColumn("job", F.first("id").over(Window.partitionBy(F.lower("owner"), F.lower("repo"), "ref", "level", "__run").orderBy("started", "id"))).drop("__new", "__run")


FINDING = "check_id string, path string, start struct<line: int>, end struct<line: int>, extra struct<message: string, severity: string, metadata: struct<cwe: array<string>, owasp: array<string>>>"


def scanner_rows(responses: DataFrame, files: DataFrame, column: str = "response") -> DataFrame:
    """(repo, rule_id, path, start_line, end_line, message, severity, cwe, owasp, snippet) of scanner envelopes
    {results: [...]}. Rows without rule, path or line, or whose end is before the start, are skipped; the snippet comes
    from the content we hold. Sorted duplicates of rule, path and line are one; texts are redacted."""
    raw = responses.select("repo", F.explode(F.from_json(column, f"results array<struct<{FINDING}>>")["results"]).alias("r"))
    d = raw.select(
        "repo", F.col("r.check_id").alias("rule_id"), "r.path", F.col("r.start.line").alias("start_line"), F.coalesce("r.end.line", "r.start.line").alias("end_line"), F.coalesce("r.extra.message", F.lit("")).alias("message"),
        F.col("r.extra.severity").alias("severity"), F.transform("r.extra.metadata.cwe", lambda x: F.regexp_extract(x, r"(CWE-\d+)", 1)).alias("cwe"), "r.extra.metadata.owasp",
    ).where((F.coalesce("rule_id", F.lit("")) != "") & (F.coalesce("path", F.lit("")) != "") & (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")))
    # dealt and sorted by file once: duplicates and the join with contents both go by it
    w = Window.partitionBy("repo", "path", "rule_id", "start_line").orderBy("end_line", "message")
    one = d.repartition("repo", "path").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    held = files.select("repo", "path", F.split("content", "\n").alias("__lines"))
    cut = F.array_join(F.slice("__lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return one.join(held, ["repo", "path"], "left").select(
        "repo", "rule_id", "path", "start_line", "end_line", one_line(redact(F.col("message")), 300).alias("message"), "severity",
        F.filter(F.coalesce("cwe", F.array().cast("array<string>")), lambda x: x != "").alias("cwe"), owasp_codes(F.coalesce("owasp", F.array().cast("array<string>"))).alias("owasp"),
        F.when(F.col("start_line") <= F.size("__lines"), redact(cut)).alias("snippet"),
    )


def evidence_ids(evidence: DataFrame) -> DataFrame:
    """evidence (run_id, prefix, file, line, summary) with dense ids ev-<prefix>-<n> in file, line, summary order."""
    w = Window.partitionBy("run_id", "prefix").orderBy("file", "line", "summary")
    return evidence.withColumn("id", F.concat(F.lit("ev-"), "prefix", F.lit("-"), F.row_number().over(w).cast("string")))


def output_issues(threats: DataFrame, loaded: DataFrame, gaps: DataFrame, text: str = "title") -> DataFrame:
    """(run_id, kind, detail): files that were never loaded, hostile wording in findings, and runs without a finding
    though a gap shows a route without sign-in. threats: run_id, threat_id, files, title; loaded: run_id, path; gaps: run_id,
    kind, certainty."""
    from wardline.functions.guards import hostile

    cited = threats.select("run_id", "threat_id", F.explode("files").alias("path"))
    unknown = cited.join(loaded.select("run_id", "path").distinct(), ["run_id", "path"], "left_anti").select("run_id", F.lit("unknown_file").alias("kind"), F.concat_ws(" ", "threat_id", "path").alias("detail"))
    also = F.col(text).rlike(r"(?i)\b(?:ignore|disregard|forget)\s+(?:all\s+|any\s+)?(?:the\s+)?(?:previous|prior|earlier|above|preceding)\s+(?:findings?|threats?)\b")
    echo = threats.where((F.size(hostile(F.col(text))) > 0) | also).select("run_id", F.lit("injection_echo").alias("kind"), F.col("threat_id").alias("detail"))
    empty = gaps.where("kind = 'authn_missing' and certainty >= 0.7").select("run_id").distinct().join(threats.select("run_id").distinct(), "run_id", "left_anti").select("run_id", F.lit("empty_while_exposed").alias("kind"), F.lit(None).cast("string").alias("detail"))
    return unknown.unionByName(echo).unionByName(empty)


def language_histogram(files: DataFrame) -> DataFrame:
    """(repo, language, n, place): source files by ending, most first, ties by the first seen (pos)."""
    ext = F.regexp_extract(F.lower("path"), r"\.([a-z0-9]+)\z", 1)
    g = files.where(ext != "").groupBy("repo", ext.alias("language")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "first"))).drop("first")
