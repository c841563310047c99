"""Dependencies matched to advisories: versions, ranges, alias groups, capped findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.versions import in_range, is_registry_range, severity_rank, version_key
from wardline.operators.windows import components

MOST_FINDINGS, MOST_DETAILS, BATCH = 40, 400, 500


def locked_versions(files: DataFrame) -> DataFrame:
    """(repo, lock_dir, key, version) of package-lock files of version 2 and 3; links and broken files have none."""
    parsed = F.from_json("content", "lockfileVersion int, packages map<string, struct<version: string, link: boolean>>")
    locks = files.where(F.col("path").rlike(r"(^|/)package-lock\.json\z")).select("repo", F.regexp_replace("path", r"/?[^/]*\z", "").alias("lock_dir"), parsed.alias("l"))
    rows = locks.where(F.col("l.lockfileVersion").isin(2, 3)).select("repo", "lock_dir", F.explode("l.packages").alias("key", "p"))
    return rows.where(F.col("p.version").isNotNull() & ~F.coalesce("p.link", F.lit(False))).select("repo", "lock_dir", "key", F.col("p.version").alias("version"))


def minimum_of_range(spec: Column) -> Column:
    """Lowest version that a registry range of one comparator names: ^1.2, ~1.2.3, >=1, 1.x; null for others."""
    first = F.split(F.trim(F.get(F.split(spec, r"\|\|"), F.lit(0))), r"\s+")
    bare = F.regexp_replace(F.get(first, F.lit(0)), r"^(?:>=|\^|~>?|=|v)+", "")
    zeroed = F.regexp_replace(F.regexp_replace(bare, r"\.[xX*](?=\.|\z)", ".0"), r"[+].*\z", "")
    core, pre = F.regexp_extract(zeroed, r"^(\d+(?:\.\d+){0,2})", 1), F.regexp_extract(zeroed, r"^\d+(?:\.\d+){0,2}(-[0-9A-Za-z.-]+)?\z", 1)
    full = F.concat(core, F.when(~core.contains("."), ".0.0").when(~core.rlike(r"\..*\."), ".0").otherwise(""), pre)
    return F.when(is_registry_range(spec) & zeroed.rlike(r"^\d+(?:\.\d+){0,2}(?:-[0-9A-Za-z.-]+)?\z"), full)


def resolve(deps: DataFrame, locks: DataFrame) -> DataFrame:
    """deps (repo, name, spec, dev, file) with version and version_exact: from the nearest lockfile above the manifest
    that lists the package (its own workspace's copy before the hoisted one), else the lowest of its range."""
    manifest_dir = F.regexp_replace("file", r"/?[^/]*\z", "")
    parts = F.split(manifest_dir, "/")
    dirs = F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    d = deps.withColumn("__id", F.concat_ws("\u0001", "repo", "file", "name"))
    steps = d.select("__id", "repo", "name", manifest_dir.alias("__own"), F.explode(dirs).alias("lock_dir"))
    local = F.regexp_replace(F.expr("substring(__own, length(lock_dir) + 1)"), "^/", "")
    keys = steps.select("__id", "repo", "lock_dir", F.posexplode(F.array(F.concat(local, F.when(local == "", "").otherwise("/"), F.lit("node_modules/"), "name"), F.concat(F.lit("node_modules/"), "name"))).alias("far", "key"))
    hits = keys.join(locks, ["repo", "lock_dir", "key"])
    best = hits.groupBy("__id").agg(F.min_by("version", F.struct((-F.length("lock_dir")).alias("near"), "far")).alias("__locked"))
    low = minimum_of_range(F.col("spec"))
    return d.join(best, "__id", "left").select(*deps.columns, F.coalesce("__locked", low).alias("version"), F.col("__locked").isNotNull().alias("version_exact")).where("version is not null")


def intervals(advisories: DataFrame) -> DataFrame:
    """(id, name, introduced, fixed, last_affected) of advisories (id, affected array<struct<name, ecosystem, ranges
    array<struct<events array<map<string,string>>>>>>): an introduced event opens what the next one closes; one left
    open has no end."""
    events = (
        advisories.select("id", F.explode("affected").alias("a")).where("a.ecosystem = 'npm'").select("id", "a.name", F.explode("a.ranges").alias("r"))
        .select("id", "name", F.col("r.events").alias("e"))
    )
    of = lambda i, key: F.try_element_at(F.get("e", i), F.lit(key))
    closing = F.transform(F.sequence(F.lit(0), F.size("e") - 1), lambda i: F.struct(
        F.when(of(i, "fixed").isNotNull() | of(i, "last_affected").isNotNull(), of(i - 1, "introduced")).otherwise(of(i, "introduced")).alias("introduced"),
        of(i, "fixed").alias("fixed"), of(i, "last_affected").alias("last_affected"),
        (of(i, "introduced").isNotNull() & (i < F.size("e") - 1)).alias("inner"),
    ))
    return events.where(F.size("e") > 0).select("id", "name", F.explode(closing).alias("x")).where(~F.col("x.inner")).select("id", "name", "x.introduced", "x.fixed", "x.last_affected")


def match(resolved: DataFrame, advisories: DataFrame) -> DataFrame:
    """(name, version, id, fixed_version) of affected versions, one query for each name and version. The fix is the
    lowest of the intervals that hold the version; null where one of those has none."""
    versions = resolved.select("name", "version").distinct().withColumn("__v", version_key(F.col("version")))
    i = intervals(advisories).withColumns({"__a": version_key(F.when(F.col("introduced") == "0", None).otherwise(F.col("introduced"))), "__b": version_key(F.col("fixed")), "__c": version_key(F.col("last_affected"))})
    hit = versions.join(i, "name").where(in_range(F.col("__v"), F.col("__a"), F.col("__b"), F.col("__c")))
    return hit.groupBy("name", "version", "id").agg(F.min_by("fixed", "__b").alias("fixed_version"))


def alias_groups(found: DataFrame, advisories: DataFrame) -> DataFrame:
    """One row for each group of advisories of a name and version that share ids or aliases: representative (highest
    rank, then smallest id), members, and the highest fix of the members."""
    about = advisories.select("id", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), severity_rank(F.col("severityScore"), F.col("severityLabel")).alias("rank"))
    own = F.concat_ws("\u0001", "name", "version", "id")
    rows = found.join(about, "id").withColumn("__node", own)
    edges = rows.select(F.col("__node").alias("a"), F.explode(F.transform("aliases", lambda x: F.concat_ws("\u0001", "name", "version", x))).alias("b"))
    roots = components(edges)
    d = rows.join(roots, rows["__node"] == roots["node"], "left").withColumn("__root", F.coalesce("root", "__node"))
    best = F.struct("rank", F.transform(F.split("id", ""), lambda c: -F.ascii(c)).alias("low"), "id")
    return d.groupBy("name", "version", "__root").agg(F.max(best)["id"].alias("id"), F.max("rank").alias("rank"), F.array_sort(F.collect_set("id")).alias("members"), F.max_by("fixed_version", version_key(F.col("fixed_version"))).alias("fixed_version")).drop("__root")


def findings(resolved: DataFrame, groups: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    """The first ``most`` findings of a repository: severity, runtime before development, name, id, file; with the
    number left out. The cap is the feature: a report."""
    d = resolved.join(groups, ["name", "version"])
    w = Window.partitionBy("repo").orderBy(F.desc("rank"), "dev", "name", "id", "file")
    return d.withColumn("place", F.row_number().over(w)).withColumn("omitted", F.greatest(F.lit(0), F.count("*").over(Window.partitionBy("repo")) - most)).where(F.col("place") <= most)


def detail_order(found: DataFrame, most: int = MOST_DETAILS) -> DataFrame:
    """Advisory ids to fetch: most referenced first."""
    return found.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(most)


def query_batches(resolved: DataFrame, size: int = BATCH, parts: int = 256) -> DataFrame:
    """Distinct names and versions with the batch (part, number) each is asked in, at most ``size`` in any. Rows are numbered
    within ``parts`` parts by hash, so no task holds all of them; at most one batch of each part is not full."""
    d = resolved.select("name", "version").distinct().withColumn("part", F.pmod(F.xxhash64("name", "version"), F.lit(parts)).cast("int"))
    n = F.row_number().over(Window.partitionBy("part").orderBy("name", "version"))
    return d.select("name", "version", F.struct("part", F.floor((n - 1) / size).cast("int").alias("number")).alias("batch"))


SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,99}\z"  # ids become parts of addresses


def zip_answers(asked: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, failed): the advisories of each query by its place in a batch, and the batches whose answer is no list of as many
    results as were asked, by name, with both numbers; of those nothing is found. asked: batch, pos (from 0), name, version;
    answers: batch, body (JSON {"results": [{"vulns": [{"id": ..}]}]}). Ids of another form are left out, a query without
    advisories has none. A batch without an answer failed; one with several answers too. Empty tables give empty ones."""
    read = answers.select("batch", F.from_json("body", "results array<struct<vulns: array<struct<id: string>>>>")["results"].alias("r"))
    one = read.groupBy("batch").agg(F.count("*").alias("answers"), F.any_value("r").alias("r"))
    sizes = asked.groupBy("batch").agg(F.count("*").alias("asked"))
    both = sizes.join(one, "batch", "left").withColumn("got", F.when(F.coalesce("answers", F.lit(0)) == 1, F.size("r")).otherwise(F.lit(-1)))
    both = both.withColumn("got", F.when(F.col("r").isNull(), -1).otherwise(F.col("got")))
    failed = both.where("got <> asked").select("batch", "asked", F.greatest("got", F.lit(-1)).alias("got"))
    by_place = both.where("got = asked").select("batch", F.posexplode("r").alias("pos", "x"))
    found = asked.join(by_place, ["batch", "pos"]).select("batch", "pos", "name", "version", F.explode("x.vulns").alias("v")).where(F.col("v.id").rlike(SAFE_ID))
    return found.select("batch", "pos", "name", "version", F.col("v.id").alias("id")), failed
