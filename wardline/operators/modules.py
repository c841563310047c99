"""What names a file binds to other files: imports, requires, instances, and the files that relative specifiers mean.

files: repo, path, bare (comments blank, strings kept). All patterns run on bare text in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import materialize

NAME = r"[A-Za-z_$][\w$]*"
QUOTED = r"""["']([^"']+)["']"""
REQUIRE_ONE = r"\b(?:const|let|var)\s+(" + NAME + r")\s*=\s*require\(\s*" + QUOTED + r"\s*\)"
REQUIRE_SOME = r"\b(?:const|let|var)\s*\{([^}]*)\}\s*=\s*require\(\s*" + QUOTED + r"\s*\)"
IMPORT_ONE = r"\bimport\s+(?:\*\s+as\s+)?(" + NAME + r")\s*(?:,\s*\{[^}]*\}\s*)?from\s*" + QUOTED
IMPORT_SOME = r"\bimport\s+(?:" + NAME + r"\s*,\s*)?\{([^}]*)\}\s*from\s*" + QUOTED
INSTANCE = r"\b(?:const|let|var)\s+(" + NAME + r")\s*=\s*new\s+(" + NAME + r")\s*\("
ENDINGS = ("", ".js", ".ts", "/index.js", "/index.ts")


def matches(text: Column, pattern: str) -> Column:
    """The first two groups of every match of a pattern that begins with a word, in order. The text is searched once; the groups
    are read from the matches."""
    at = lambda m, n: F.regexp_extract(m, pattern, n)
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(at(m, 1).alias("a"), at(m, 2).alias("b")))


def bindings(files: DataFrame) -> DataFrame:
    """(repo, file, name, spec, form): each name that an import or a require of a file binds. form is require or import; of several
    bindings of a name in a file the last counts, lists after single names."""
    forms = ((REQUIRE_ONE, "require", ""), (REQUIRE_SOME, "require", ":"), (IMPORT_ONE, "import", ""), (IMPORT_SOME, "import", r"\s+as\s+"))
    found = None
    for n, (pattern, form, renames) in enumerate(forms):
        each = files.where(F.col("bare").contains(form)).select("repo", F.col("path").alias("file"), F.posexplode(matches(F.col("bare"), pattern)).alias("i", "m"))
        if renames:  # a list of names, the local one after the sign
            each = each.select("repo", "file", "i", F.col("m.b").alias("b"), F.posexplode(F.split("m.a", ",")).alias("j", "part"))
            name, spec = F.trim(F.element_at(F.split(F.trim("part"), renames), -1)), F.col("b")
        else:
            each, name, spec = each.withColumn("j", F.lit(0)), F.col("m.a"), F.col("m.b")
        one = each.select("repo", "file", name.alias("name"), spec.alias("spec"), F.lit(form).alias("form"), F.struct(F.lit(n).alias("n"), "i", "j").alias("place")).where(F.col("name").rlike(r"\A" + NAME + r"\z"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("repo", "file", "name").agg(F.max_by(F.struct("spec", "form"), "place").alias("x")).select("repo", "file", "name", "x.spec", "x.form")


def base_of(file: Column, spec: Column) -> Column:
    """The path that a relative specifier means, seen from a file; one that leaves the repository begins with two dots."""
    steps = F.filter(F.concat(F.slice(F.split(file, "/"), F.lit(1), F.size(F.split(file, "/")) - 1), F.split(spec, "/")), lambda s: (s != ".") & (s != ""))
    inside = lambda acc: (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
    up = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when((s == "..") & (F.size(acc) > 0), F.when(inside(acc), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s)))).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(up, "/")


def resolve(refs: DataFrame, files: DataFrame, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """refs (repo, file, spec, ..) that mean a file there is, with target: the path with the first ending that exists. Packages and
    paths that are not there drop out. One equi-join on whole paths; what refs are made of is read once."""
    d = materialize(refs.where(F.col("spec").startswith(".")).withColumn("__base", base_of(F.col("file"), F.col("spec"))), "refs")
    asked = d.select("repo", "__base").distinct()
    tried = asked.select("repo", "__base", F.posexplode(F.array(*(F.concat("__base", F.lit(e)) for e in endings))).alias("p", "path"))
    hit = tried.join(files.select("repo", "path"), ["repo", "path"], "left_semi").groupBy("repo", "__base").agg(F.min_by("path", "p").alias("target"))
    return d.join(hit, ["repo", "__base"]).drop("__base")


def instances(files: DataFrame, bound: DataFrame) -> DataFrame:
    """(repo, file, instance, class, target): names that a file gives to new objects of a class that it requires from a
    file. bound: bindings that resolve() found a target for. The last one counts."""
    made = files.select("repo", F.col("path").alias("file"), F.posexplode(matches(F.col("bare"), INSTANCE)).alias("i", "m")).select("repo", "file", "i", F.col("m.a").alias("instance"), F.col("m.b").alias("name"))
    known = made.join(bound.select("repo", "file", "name", "target"), ["repo", "file", "name"])
    w = Window.partitionBy("repo", "file", "instance").orderBy(F.desc("i"))
    return known.withColumn("n", F.row_number().over(w)).where("n = 1").select("repo", "file", "instance", F.col("name").alias("class"), "target")
