"""Facts from files: scripts, manifests, routes, environment names, masks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import paths


def script_summary(files: DataFrame, content: str) -> DataFrame:
    """files with the numbers of script tags and of those with a source, and whether a policy meta is there."""
    c = F.col(content)
    n = lambda p: F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0))).cast("bigint")
    return files.withColumns({
        "scripts": n(r"(?i)<script\b[^>]*>"),
        "external": n(r"""(?i)<script\b[^>]*\bsrc\s*=\s*["'][^"']+"""),
        "csp": c.rlike(r"(?i)<meta[^>]+content-security-policy"),
    })


def external_scripts(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, src, host, integrity) of each script tag with an absolute source."""
    tags = files.select(path, F.explode(F.regexp_extract_all(content, F.lit(r"(?i)<script\b[^>]*>"), F.lit(0))).alias("tag"))
    src = F.regexp_extract("tag", r"""(?i)\bsrc\s*=\s*["']([^"']+)["']""", 1)
    return tags.select(path, src.alias("src"), F.col("tag").rlike(r"(?i)\bintegrity\s*=").alias("integrity")).where(F.col("src").rlike(r"^(https?:)?//")).withColumn("host", F.lower(F.regexp_extract("src", r"^(?:https?:)?//([^/:?#]+)", 1)))


def manifest_dependencies(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, name, spec, dev) of package manifests; a name in both lists counts as no development one. Broken JSON has none."""
    parsed = F.from_json(content, "dependencies map<string,string>, devDependencies map<string,string>, optionalDependencies map<string,string>")
    d = files.where(F.col(path).rlike(r"(^|/)package\.json\z")).select(path, parsed.alias("m"))
    entries = lambda field, order, dev: d.select(path, F.explode(f"m.{field}").alias("name", "spec"), F.lit(order).alias("o"), F.lit(dev).alias("dev"))
    every = entries("dependencies", 0, False).unionByName(entries("optionalDependencies", 1, False)).unionByName(entries("devDependencies", 2, True))
    return every.groupBy(path, "name").agg(F.min(F.struct("o", "spec", "dev")).alias("x")).select(path, "name", "x.spec", "x.dev")


def env_names(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, name, line): names only, never values; the first line of each name in a file."""
    lines = files.select(path, F.posexplode(F.split(content, "\n")).alias("i", "text"))
    example = F.col(path).rlike(r"(^|/)\.env\.example\z")
    declared = lines.where(example).select(path, F.regexp_extract("text", r"^\s*(?:export\s+)?([A-Z_a-z][A-Z_a-z0-9]*)\s*=", 1).alias("name"), "i")
    direct = F.regexp_extract_all("text", F.lit(r"process\.env\.([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    bracket = F.regexp_extract_all("text", F.lit(r"""process\.env\[["']([A-Za-z_][A-Za-z0-9_]*)["']\]"""), F.lit(1))
    used = lines.where(~example).select(path, F.explode(F.concat(direct, bracket)).alias("name"), "i")
    return declared.unionByName(used).where("name <> ''").groupBy(path, "name").agg((F.min("i") + 1).alias("line"))


def route_handlers(files: DataFrame, path: str, content: str, *keys: str) -> DataFrame:
    """(keys, path, method, url) of file-based route handlers: exported methods; a page API without a method test is ALL."""
    exported = F.regexp_extract_all(content, F.lit(r"(?m)^export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"), F.lit(1))
    app = files.select(*keys, path, paths.app_route(F.col(path)).alias("url"), F.explode(F.array_distinct(exported)).alias("method")).where("url is not null")
    inner = F.regexp_extract(path, r"(?:^|/)pages/api/(.+?)(?:/index)?\.(?:ts|tsx|js|jsx)\z", 1)
    url = F.concat(F.lit("/api/"), F.array_join(F.transform(F.split(inner, "/"), paths.route_segment), "/"))
    tested = F.regexp_extract_all(content, F.lit(r"""req\.method\s*[=!]==?\s*["'](GET|POST|PUT|PATCH|DELETE)["']"""), F.lit(1))
    pages = files.where(F.col(path).rlike(r"(?:^|/)pages/api/.+\.(?:ts|tsx|js|jsx)\z")).select(*keys, path, url.alias("url"), F.explode(F.when(F.size(tested) > 0, F.array_sort(F.array_distinct(tested))).otherwise(F.array(F.lit("ALL")))).alias("method"))
    return app.unionByName(pages).select(*keys, path, "method", "url")


#: A comment or a string, as one token. A slash after a backslash opens no comment, so a regular expression like /\\/*$/ blanks
#: nothing; a comment or backtick string left open runs to the end, a quote left open to the end of its line. Each way
#: begins with its character, by which the search skips ahead; only strings have a group.
_token = re.compile(
    r"/(?<!\\/)(?:/[^\n]*|\*(?:[^*]|\*(?!/))*+(?:\*/)?)"
    r"""|"(?P<a>(?:\\[\s\S]|[^"\\\n])*+\\?)"?|'(?P<b>(?:\\[\s\S]|[^'\\\n])*+\\?)'?|`(?P<c>(?:\\[\s\S]|[^`\\])*+\\?)`?"""
)
_visible = re.compile(r"[^\n]")


def mask_both(code: str) -> tuple[str, str]:
    """The code with comments and what is inside quotes as blanks, and with comments alone as blanks; newlines and places stay."""
    masked, bare, at = [], [], 0
    for m in _token.finditer(code):
        before = code[at : m.start()]
        blank = _visible.sub(" ", m[0])
        if m.lastgroup is None:
            masked += [before, blank]
            bare += [before, blank]
        else:
            group = m.lastgroup
            a, b = m.start(group) - m.start(), m.end(group) - m.start()
            masked += [before, m[0][:a], blank[a:b], m[0][b:]]
            bare += [before, m[0]]
        at = m.end()
    return "".join([*masked, code[at:]]), "".join([*bare, code[at:]])


def mask_text(code: str, strings: bool = True) -> str:
    """Comments, and with ``strings`` what is inside quotes, as blanks; newlines and places stay."""
    return mask_both(code)[0 if strings else 1]


def with_masks(files: DataFrame, content: str = "content") -> DataFrame:
    """files with masked and bare, both of one pass: a lexer has state, so it runs in Arrow batches, once for each file."""
    @F.pandas_udf("masked string, bare string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([(None, None) if t is None else mask_both(t) for t in s], columns=["masked", "bare"])

    return files.withColumn("__m", mask(F.col(content))).withColumns({"masked": F.col("__m.masked"), "bare": F.col("__m.bare")}).drop("__m")


def masked(files: DataFrame, content: str, name: str = "masked", strings: bool = True) -> DataFrame:
    """files with one of the two masks as a column of that name."""
    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else mask_text(t, strings))

    return files.withColumn(name, mask(F.col(content)))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n"))


def served_html(path: Column) -> Column:
    """A page that would be served: outside tests, documents, samples and builds."""
    p = F.translate(path, "\\", "/")
    return p.rlike(r"(?i)\.html?\z") & ~p.rlike(r"(?i)(^|/)(?:tests?|__tests__|e2e|examples?|fixtures?|docs?|node_modules|coverage)/")


def without_html_comments(content: Column) -> Column:
    """HTML comments, an unclosed one to the end, as blanks: lines and places stay. Built of splits, so it runs in the JVM."""
    parts = F.split(content, "<!--", -1)
    blank = lambda x: F.regexp_replace(x, r"[^\n]", " ")
    close = lambda x: F.instr(x, "-->")
    # a part after an opening mark is blank up to its closing one; further opening marks inside are a part of it
    def step(acc, x):
        at = close(x)
        inside = F.when(at > 0, F.concat(blank(F.concat(F.lit("<!--"), F.substring(x, F.lit(1), at + 2))), F.substring(x, at + 3, F.length(x)))).otherwise(blank(F.concat(F.lit("<!--"), x)))
        return F.struct(F.concat(acc["text"], inside).alias("text"))

    start = F.struct(F.get(parts, F.lit(0)).alias("text"))
    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), start, step)["text"]


# What shows a platform by use.
WORKER_MODULE = r"\bexport\s+default\s*\{\s*(?:async\s+)?fetch\s*[(:,]"
WORKER_LISTENER = r"""\baddEventListener\s*\(\s*(?:'fetch'|"fetch"|`fetch`)"""
FIREBASE_USE = r"""\bfirebase\s*\.\s*initializeApp\s*\(|\bfrom\s*(?:'firebase/app'|"firebase/app"|`firebase/app`)"""


def _line(text: Column, pattern: str) -> Column:
    return F.size(F.split(F.get(F.split(text, pattern, 2), F.lit(0)), "\n"))


def usage_frameworks(files: DataFrame) -> DataFrame:
    """(repo, name, category, file, line, origin) of platforms that code shows by use: a worker's entry point, and the Firebase
    client. files: repo, path, masked, bare. One row for each platform and file."""
    js = files.where(F.translate("path", "\\", "/").rlike(paths.SCANNED_ENDING))
    entry = F.when(F.col("masked").rlike(WORKER_MODULE), _line(F.col("masked"), WORKER_MODULE)).when(F.col("bare").rlike(WORKER_LISTENER), _line(F.col("bare"), WORKER_LISTENER))
    cloud = F.when(F.col("bare").rlike(FIREBASE_USE), _line(F.col("bare"), FIREBASE_USE))
    found = F.filter(F.array(F.struct(F.lit("cloudflare-workers").alias("name"), F.lit("edge_runtime").alias("category"), entry.alias("line")), F.struct(F.lit("firebase").alias("name"), F.lit("cloud").alias("category"), cloud.alias("line"))), lambda x: x["line"].isNotNull())
    return js.select("repo", F.col("path").alias("file"), F.explode(found).alias("x")).select("repo", "x.name", "x.category", "file", "x.line", F.lit("usage").alias("origin"))


# How a worker compares paths and methods, and how many routes are listed.
WORKER_EQUALS = r"""\bpathname\s*===?\s*['"`](/[^'"`\n]*)['"`]"""
WORKER_PREFIX = r"""\bpathname\s*\.\s*startsWith\s*\(\s*['"`](/[^'"`\n]*)['"`]"""
WORKER_METHOD = r"""\b(?:req|request)\s*\.\s*method\s*[!=]==?\s*['"`]([A-Za-z]+)['"`]"""
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
WORKER_ROUTES = 20


def worker_routes(files: DataFrame) -> DataFrame:
    """(repo, file, method, url) of files with a worker's entry point: the paths it compares with, each with the methods it
    compares with; every path or method where it compares none. At most 20 a file: the cap is a feature of the list."""
    entry = files.where(F.col("masked").rlike(WORKER_MODULE) | F.col("bare").rlike(WORKER_LISTENER))
    c = lambda p: F.regexp_extract_all("content", F.lit(p), F.lit(1))
    under = F.transform(c(WORKER_PREFIX), lambda p: F.concat(F.regexp_replace(p, r"/+\z", ""), F.lit("/*")))
    named = lambda found, other: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(other)))
    urls = named(F.array_distinct(F.concat(c(WORKER_EQUALS), under)), "*")
    methods = named(F.array_distinct(F.filter(F.transform(c(WORKER_METHOD), F.upper), lambda m: m.isin(*METHODS))), "ALL")
    pairs = F.slice(F.flatten(F.transform(urls, lambda u: F.transform(methods, lambda m: F.struct(m.alias("method"), u.alias("url"))))), 1, WORKER_ROUTES)
    return entry.select("repo", F.col("path").alias("file"), F.explode(pairs).alias("x")).select("repo", "file", "x.method", "x.url")
