"""The graph of routers: which file mounts which, and the prefix that all mounts above a router add up to.

A mount is an edge (file, prefix, file). A file that one file mounts points to it; pointers are doubled up to a file that nothing
or more than one file mounts, so a router k mounts below is there after log2(k) rounds of one row a file. Only between those
tops is the closure made, also by doubling: each round joins the paths so far with themselves. A pair of files that two
different prefixes join has none, and nothing below it has: a wrong prefix is worse than a missing one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators import modules
from wardline.session import discard, materialize

MOUNT = r"""\b[A-Za-z_$][\w$]*\s*\.\s*use\(\s*(['"`])(/[^'"`]*)\1\s*,\s*([A-Za-z_$][\w$]*)\s*\)"""
PLAIN_MOUNT = r"\b[A-Za-z_$][\w$]*\s*\.\s*use\(\s*([A-Za-z_$][\w$]*)()\s*\)"
ENDINGS = ("", ".ts", ".js", ".tsx", ".jsx", "/index.ts", "/index.js")
MOST_ROUNDS = 40


def mounts(files: DataFrame) -> DataFrame:
    """(repo, file, target, prefix): files that a file mounts by a name it imports, each with its prefix, without a slash at
    its end; a mount without a path has an empty one. files: repo, path, bare."""
    at = lambda p, n: F.regexp_extract_all("bare", F.lit(p), F.lit(n))
    named = F.concat(F.arrays_zip(at(MOUNT, 2).alias("prefix"), at(MOUNT, 3).alias("name")), F.arrays_zip(at(PLAIN_MOUNT, 2).alias("prefix"), at(PLAIN_MOUNT, 1).alias("name")))
    used = files.select("repo", F.col("path").alias("file"), F.explode(named).alias("m")).select("repo", "file", "m.name", F.regexp_replace("m.prefix", r"/+\z", "").alias("prefix"))
    bound = modules.resolve(modules.bindings(files), files, ENDINGS)
    return used.join(bound, ["repo", "file", "name"]).where("target <> file").select("repo", "file", "target", "prefix").distinct()


def _one_prefix(paths: DataFrame) -> DataFrame:
    """One row for each pair of files; the prefix is null where there are two, or one is not known."""
    known = F.bool_and(F.col("prefix").isNotNull()) & (F.count_distinct("prefix") == 1)
    return paths.groupBy("repo", "file", "target").agg(F.when(known, F.min("prefix")).alias("prefix"))


def closure(edges: DataFrame) -> DataFrame:
    """(repo, file, target, prefix) of every two files with a path of mounts from one to the other. Files on a circle have no
    prefix. Rounds end when no pair and no prefix changes; each is a table in the shared folder and replaces the one before."""
    paths, before = materialize(_one_prefix(edges), "routers"), None
    for _ in range(MOST_ROUNDS):
        now = tuple(paths.agg(F.count("*"), F.count("prefix")).first())
        if now == before:
            return paths
        before = now
        on = paths.select("repo", F.col("file").alias("target"), F.col("target").alias("further"), F.col("prefix").alias("more"))
        longer = paths.join(on, ["repo", "target"]).select("repo", "file", F.col("further").alias("target"), F.concat("prefix", "more").alias("prefix"))
        done, paths = paths, materialize(_one_prefix(paths.unionByName(longer)), "routers")
        discard(done)
    raise RuntimeError("routers did not settle")


def tops(single: DataFrame) -> DataFrame:
    """(repo, file, top, prefix) of files that one file mounts: the first file above that is not of that kind, with the prefix from
    there. single: repo, file, top (what mounts it), prefix. A file on or below a circle of such files has no top and no row."""
    at, most, round_ = materialize(single.withColumn("open", F.lit(True)), "tops"), None, 0
    while True:
        above = at.select("repo", F.col("file").alias("top"), F.col("top").alias("higher"), F.col("prefix").alias("more"), F.col("open").alias("on"))
        step = at.where("open").join(above, ["repo", "top"], "left")
        moved = step.select("repo", "file", F.coalesce("higher", "top").alias("top"), F.when(F.col("higher").isNull(), F.col("prefix")).otherwise(F.concat("more", "prefix")).alias("prefix"), F.coalesce("on", F.lit(False)).alias("open"))
        done, at = at, materialize(at.where("not open").unionByName(moved), "tops")
        discard(done)
        round_ += 1
        left = at.where("open").count()
        most = at.count() if most is None and left else most
        # what is open after as many steps as there are files goes round
        if not left or 2**round_ > most:
            return at.where("not open").drop("open")


def router_prefixes(files: DataFrame) -> DataFrame:
    """(repo, file, prefix, roots) of every mounted file: the prefix under the applications, files that nothing mounts, that
    reach it, and their number. Null where they give two, or where a circle or a doubtful mount lies between. Repositories without
    a mount have no row; an empty table gives an empty one."""
    edges = materialize(_one_prefix(mounts(files)), "mounts")
    n = edges.groupBy("repo", "target").agg(F.count("*").alias("n"), F.first("file").alias("top"), F.first("prefix").alias("prefix"))
    below = materialize(n, "mounted")
    up = tops(below.where("n = 1").select("repo", F.col("target").alias("file"), "top", "prefix"))
    joints = below.where("n > 1").select("repo", "target")
    # mounts of joints, seen from the tops of the files that mount them; those of a file without a top come from no application
    into = edges.join(joints, ["repo", "target"], "left_semi").join(up.select("repo", "file", "top", F.col("prefix").alias("over")), ["repo", "file"], "left")
    into = into.join(below.where("n = 1").select("repo", F.col("target").alias("file"), F.lit(True).alias("inner")), ["repo", "file"], "left").where("inner is null or top is not null")
    every = closure(into.select("repo", F.coalesce("top", "file").alias("file"), "target", F.when(F.col("top").isNull(), F.col("prefix")).otherwise(F.concat("over", "prefix")).alias("prefix")))
    rooted = every.join(below.select("repo", F.col("target").alias("file")), ["repo", "file"], "left_anti").groupBy("repo", "target").agg(
        F.when(F.bool_and(F.col("prefix").isNotNull()) & (F.count_distinct("prefix") == 1), F.min("prefix")).alias("prefix"), F.count("*").alias("roots")
    )
    found = joints.join(rooted, ["repo", "target"], "left").select("repo", F.col("target").alias("file"), "prefix", F.coalesce("roots", F.lit(0).cast("bigint")).alias("roots"))
    # what has a top that is a joint shares its roots; any other top is an application itself
    chained = below.where("n = 1").select("repo", F.col("target").alias("file")).join(up, ["repo", "file"], "left")
    shared = chained.join(found.select("repo", F.col("file").alias("top"), F.col("prefix").alias("before"), "roots"), ["repo", "top"], "left")
    own = F.when(F.col("roots").isNull(), F.col("prefix")).otherwise(F.concat("before", "prefix"))
    return found.unionByName(shared.select("repo", "file", own.alias("prefix"), F.when(F.col("top").isNull(), F.lit(0)).otherwise(F.coalesce("roots", F.lit(1))).cast("bigint").alias("roots")))


def joined(prefix: Column, path: Column) -> Column:
    """A route's path under a prefix, without a doubled or lost slash."""
    left = F.regexp_replace(F.coalesce(prefix, F.lit("")), r"/+\z", "")
    own = F.when(path.isin("", "/"), F.lit("")).when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when((left == "") & (own == ""), F.lit("/")).otherwise(F.concat(left, own))
