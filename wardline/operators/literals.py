"""Literals inside calls: every call of a name that a package binds, with each option it is given, at any depth.

The names come from imports by a join; a small reader then walks one file's calls by the brackets of its masked text, and the
result is rows (call, key path, literal or not) for DataFrame rules to read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import paths
from wardline.operators import modules
from wardline.operators.code_facts import arguments

_entry = re.compile(r"""\s*(?:([A-Za-z_$][\w$]*)|(['"])([^'"]*)\2)\s*:""")
_literal = re.compile(r"""(?:true|false|null|undefined|-?\d+(?:\.\d+)?|(['"`])([^'"`]*)\1)\Z""")
OPTIONS = "repo string, file string, line int, call int, package string, path string, kind string, value string"
# Libraries that set session cookies, and where their options stand.
SESSION_LIBRARIES = {"express-session": "cookie.", "cookie-session": ""}


def options_in(bare: str, masked: str, begin: int, end: int, path: str = "") -> Iterator[tuple[str, str, str | None]]:
    """(path, kind, value) of the value between two places: an object and its entries, a literal, or something else."""
    text = bare[begin:end].strip()
    if text.startswith("{") and text.endswith("}"):
        yield path, "object", None
        start = begin + bare[begin:end].index("{") + 1
        spans, _ = arguments(bare[:end], masked[:end], start)
        for a, b in spans:
            m = _entry.match(bare, a, b)
            if m:
                key = m[1] or m[3]
                yield from options_in(bare, masked, m.end(), b, f"{path}.{key}" if path else key)
            else:
                name = re.match(r"\s*([A-Za-z_$][\w$]*)\s*\Z", bare[a:b])
                yield (f"{path}.{name[1]}" if path else name[1]) if name else f"{path}.*" if path else "*", "other", None
        return
    m = _literal.match(text)
    yield path, "literal" if m else "other", (m[2] if m[1] else text) if m else None


def calls_in(bare: str, masked: str, names: list[tuple[str, str]]) -> Iterator[tuple[int, int, str, str, str, str | None]]:
    """(line, call, package, path, kind, value) of the first argument of each call of the named functions, and of requires called at
    once; calls that never close are left out. Calls are numbered by their place in the file."""
    found = []
    for name, package in names:
        found += [(m.end(), package) for m in re.finditer(rf"(?<![\w$.]){re.escape(name)}\s*\(", masked)]
    for m in re.finditer(r"\brequire\s*\(\s*(['\"])([^'\"]+)\1\s*\)\s*\(", bare):
        if m[2] in {p for _, p in names} | set(SESSION_LIBRARIES):
            found.append((m.end(), m[2]))
    for n, (start, package) in enumerate(sorted(set(found))):
        spans, after = arguments(bare, masked, start)
        if after > len(masked):
            continue
        line = bare.count("\n", 0, start) + 1
        for path, kind, value in options_in(bare, masked, *spans[0]) if spans else [("", "none", None)]:
            yield line, n, package, path, kind, value


def call_options(files: DataFrame, packages: tuple[str, ...]) -> DataFrame:
    """OPTIONS rows of all calls of what the packages' default imports bind. files: repo, path, bare, masked. Empty tables give none."""
    source = files.where(paths.is_scannable(F.col("path"))).where(F.col("bare").rlike("|".join(re.escape(p) for p in packages)))
    bound = modules.bindings(source).where(F.col("spec").isin(*packages)).groupBy("repo", F.col("file").alias("path")).agg(F.sort_array(F.collect_set(F.struct("name", "spec"))).alias("names"))
    held = source.select("repo", "path", "bare", "masked").join(bound, ["repo", "path"], "left").withColumn("names", F.coalesce("names", F.array().cast("array<struct<name:string,spec:string>>")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in OPTIONS.split(", ")]
        for pdf in batches:
            rows = [(r, p, *x) for r, p, bare, masked, names in zip(pdf["repo"], pdf["path"], pdf["bare"], pdf["masked"], pdf["names"], strict=True) for x in calls_in(bare, masked, [(n["name"], n["spec"]) for n in names])]
            yield pd.DataFrame(rows, columns=columns)

    return held.mapInPandas(run, OPTIONS).where(F.col("package").isin(*packages))


def session_cookies(files: DataFrame) -> DataFrame:
    """(repo, file, line, library, http_only, secure, same_site, and explicit, which of them are set): what the session cookies of every
    call get. An option that is no literal is unknown; so is every one where the options, or the cookie's, are no object
    literal; one that is absent has the library's default. same_site is null where none is sent."""
    o = call_options(files, tuple(SESSION_LIBRARIES))
    key = ["repo", "file", "line", "call", "package"]
    prefix = F.coalesce(*(F.when(F.col("package") == p, F.lit(x)) for p, x in SESSION_LIBRARIES.items()))
    at = lambda path: F.max(F.when(F.col("path") == path, F.struct("kind", "value")))
    g = o.withColumn("prefix", prefix).groupBy(*key, "prefix").agg(at("").alias("whole"), at("cookie").alias("cookie"), *(at(F.concat("prefix", F.lit(n))).alias(n) for n in ("httpOnly", "secure", "sameSite")))
    blind = (F.col("whole.kind") != "object") | ((F.col("prefix") != "") & F.coalesce(F.col("cookie.kind") != "object", F.lit(False)))

    def told(name: str, literal: Column, default: Column) -> Column:
        x = F.col(name)
        return F.when(blind, F.lit("unknown")).when(x.isNull(), default).when(x["kind"] != "literal", F.lit("unknown")).otherwise(literal)

    flag = lambda name: F.when(F.col(f"{name}.value").isin("true", "false"), F.col(f"{name}.value")).otherwise("unknown")
    site = F.lower("sameSite.value")
    none = F.lit(None).cast("string")
    sent = F.when(site.isin("strict", "lax", "none"), site).when(site == "true", "strict").when(site == "false", none).otherwise("unknown")
    explicit = F.filter(F.array(*(F.when(blind | F.col(n).isNotNull(), F.lit(n)) for n in ("httpOnly", "secure", "sameSite"))), lambda x: x.isNotNull())
    return g.select("repo", "file", "line", F.col("package").alias("library"), told("httpOnly", flag("httpOnly"), F.lit("true")).alias("http_only"), told("secure", flag("secure"), F.lit("false")).alias("secure"), told("sameSite", sent, none).alias("same_site"), explicit.alias("explicit"))
