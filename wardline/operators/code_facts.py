"""Facts from code that needs nesting: routes with middleware, handler bodies, guards, stores, deployments, cookies.

Each file is one row and is read once, in Arrow batches; the results are small rows that later joins combine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import paths
from wardline.operators.extract import mask_text, route_handlers

ROUTE_SCHEMA = "repo string, file string, line int, method string, path string, middleware array<string>, body string"
USE_SCHEMA = "repo string, file string, line int, prefix string, names array<string>"

_route = re.compile(r"\b([A-Za-z_$][\w$]*)\s*\.\s*(get|post|put|patch|delete|all)\s*\(\s*(['\"`])")
_use = re.compile(r"\b([A-Za-z_$][\w$]*)\s*\.\s*use\s*\(")
_name = re.compile(r"[A-Za-z_$][\w$.]*")
_router = re.compile(r"app|router|server|routes?|api|express", re.I)


def arguments(code: str, masked: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """Spans of the arguments of a call whose opening bracket is just before ``start``, by brackets of the masked text,
    and the place after the closing bracket; an unclosed call ends with the text."""
    spans, depth, at, begin = [], 0, start, start
    while at < len(masked):
        c = masked[at]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            if depth == 0:
                break
            depth -= 1
        elif c == "," and depth == 0:
            spans.append((begin, at))
            begin = at + 1
        at += 1
    if code[begin:at].strip():
        spans.append((begin, at))
    return spans, at + 1


def _names(text: str, masked: str) -> list[str]:
    """Names of a middleware argument: a name, a call's name, or those of an array."""
    inner = masked.strip()
    if re.match(r"(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)", inner):
        return []
    if inner.startswith("["):
        spans, _ = arguments(text, masked, masked.index("[") + 1)
        return [n for a, b in spans for n in _names(text[a:b], masked[a:b])]
    m = _name.match(inner)
    return [m[0]] if m else []


def routes_in(code: str) -> list[tuple[int, str, str, list[str], str]]:
    """(line, method, path, middleware, handler text) of each call that registers a handler on an app or router."""
    masked, out, line, seen = mask_text(code), [], 1, 0
    for m in _route.finditer(masked):
        if not _router.search(m[1]):
            continue
        spans, _ = arguments(code, masked, masked.index("(", m.end(2)) + 1)
        if len(spans) < 2:
            continue  # app.get("setting")
        path = code[spans[0][0] : spans[0][1]].strip()
        if path[:1] not in "'\"`" or path[-1:] != path[:1]:
            continue
        names = [n for a, b in spans[1:-1] for n in _names(code[a:b], masked[a:b])]
        a, b = spans[-1]
        line, seen = line + code.count("\n", seen, m.start()), m.start()
        out.append((line, m[2].upper(), path[1:-1], names, masked[a:b].strip()))
    return out


def uses_in(code: str) -> list[tuple[int, str | None, list[str]]]:
    """(line, prefix or None, middleware names) of each .use() call on an app or router."""
    masked, out, line, seen = mask_text(code), [], 1, 0
    for m in _use.finditer(masked):
        if not _router.search(m[1]):
            continue
        spans, _ = arguments(code, masked, m.end())
        prefix, names = None, []
        for k, (a, b) in enumerate(spans):
            text = code[a:b].strip()
            if k == 0 and text[:1] in "'\"`" and text[-1:] == text[:1]:
                prefix = text[1:-1]
            else:
                names += _names(code[a:b], masked[a:b])
        line, seen = line + code.count("\n", seen, m.start()), m.start()
        out.append((line, prefix, names))
    return out


def _scan(files: DataFrame, reader, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            rows = [(repo, path, *found) for repo, path, code in zip(pdf["repo"], pdf["path"], pdf["content"], strict=True) if code for found in reader(code)]
            yield pd.DataFrame(rows, columns=names)

    return files.where(paths.is_scannable(F.col("path"))).select("repo", "path", "content").mapInPandas(run, schema)


def express_routes(files: DataFrame) -> DataFrame:
    return _scan(files, routes_in, ROUTE_SCHEMA)


def use_calls(files: DataFrame) -> DataFrame:
    return _scan(files, uses_in, USE_SCHEMA)


def mount_prefixes(files: DataFrame, uses: DataFrame) -> DataFrame:
    """(repo, file, prefix): a router's file under the one prefix it is mounted on; files with two are left out, as
    their prefix is unknown. Imports are resolved against the paths there are, with the usual endings."""
    bind = r"""(?:import\s+([A-Za-z_$][\w$]*)\s+from\s*|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*require\s*\(\s*)['"](\.{1,2}/[^'"]+)['"]"""
    line = files.select("repo", "path", F.explode(F.split("content", "\n")).alias("text")).where(F.col("text").rlike(bind))
    bound = line.select("repo", F.col("path").alias("file"), F.coalesce(F.nullif(F.regexp_extract("text", bind, 1), F.lit("")), F.regexp_extract("text", bind, 2)).alias("name"), F.regexp_extract("text", bind, 3).alias("spec"))
    mounts = uses.where("prefix is not null").select("repo", "file", "prefix", F.explode("names").alias("name")).join(bound, ["repo", "file", "name"])
    steps = F.filter(F.concat(F.filter(F.split(F.regexp_replace("file", r"[^/]*\z", ""), "/"), lambda s: s != ""), F.split("spec", "/")), lambda s: s != ".")
    up = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(s))))
    target = F.array_join(up, "/")
    candidates = mounts.select("repo", "prefix", F.explode(F.transform(F.array(*map(F.lit, ("", ".js", ".ts", ".mjs", ".cjs", "/index.js", "/index.ts"))), lambda e: F.concat(target, e))).alias("path"))
    hit = candidates.join(files.select("repo", "path"), ["repo", "path"], "left_semi").groupBy("repo", F.col("path").alias("file")).agg(F.count_distinct("prefix").alias("n"), F.min("prefix").alias("prefix"))
    return hit.where("n = 1").drop("n")


def all_routes(files: DataFrame) -> DataFrame:
    """(repo, route_id, method, url, file, line, framework, middleware, body): every file kind in one table with dense
    ids in file, line, method, url order; prefixes of mounted routers put in front."""
    uses = use_calls(files)
    ex = express_routes(files).join(mount_prefixes(files, uses).withColumnRenamed("prefix", "mount"), ["repo", "file"], "left")
    url = F.regexp_replace(F.concat(F.coalesce("mount", F.lit("")), F.lit("/"), "path"), "/{2,}", "/")
    ex = ex.select("repo", "method", F.when(F.length(url) > 1, F.regexp_replace(url, r"/\z", "")).otherwise(url).alias("url"), "file", "line", F.lit("express").alias("framework"), "middleware", "body")
    every = ex.unionByName(route_handlers_by_repo(files))
    w = Window.partitionBy("repo").orderBy("file", "line", "method", "url")
    return every.withColumn("route_id", F.concat(F.lit("route-"), F.row_number().over(w).cast("string")))


def route_handlers_by_repo(files: DataFrame) -> DataFrame:
    """File-based handlers of many repositories, in the columns of all_routes."""
    framework = F.when(F.col("path").rlike(r"(?:^|/)pages/api/"), "next_pages").otherwise("next_app")
    h = route_handlers(files.withColumn("masked_body", F.coalesce(F.col("content"), F.lit(""))), "path", "content", "repo", "masked_body")
    return h.select("repo", "method", "url", F.col("path").alias("file"), F.lit(1).alias("line"), framework.alias("framework"), F.array().cast("array<string>").alias("middleware"), F.col("masked_body").alias("body"))


# What shows a signed-in user, a role, and where a token is checked.
SESSION_CHECK = r"\b(?:getServerSession|getSession|currentUser|requireUser|requireAuth|verifyToken|isAuthenticated)\s*\(|\breq\s*\.\s*(?:user|session\s*\.\s*user\w*|auth)\b|\bjwt\s*\.\s*verify\s*\("
GUARD_NAME = r"(?i)auth|protect|require(?:User|Login|Role|Admin|Permission)|isAdmin|verify(?:Token|Jwt|Session|User)|logged_?in|with(?:Role|Permission)|jwt|clerk|guard|session(?:Guard|Required)"
LIMITER_NAME = r"(?i)limit"
# What shows that a caller may, not only that someone is signed in; each with its name.
ROLE_SIGNALS = (
    ("requireRole", r"\brequireRole\b"),
    ("hasRole", r"\bhasRole\b"),
    ("isAdmin", r"\bisAdmin\b"),
    ("role comparison", r"\brole\s*===?\s*['\"`]"),
    ("roles.includes", r"\broles?\s*\.\s*includes\s*\("),
    ("scope check", r"\bscopes?\s*\.\s*includes\s*\("),
    ("owner comparison", r"\b(?:owner|ownerId|authorId|createdBy)\s*[!=]==?"),
    ("user id comparison", r"\breq\s*\.\s*user\s*\.\s*(?:id|_id|userId)\s*[!=]==?|[!=]==?\s*req\s*\.\s*user\s*\.\s*(?:id|_id|userId)\b"),
    ("owner-scoped query", r"\b(?:userId|user_id|ownerId|owner|authorId)\s*:\s*(?:req\s*\.\s*user|session\s*\.\s*user|user\s*\.\s*id|currentUser)"),
    ("permission call", r"\b(?:can|authorize|checkPermission|hasPermission|assertPermission|requirePermission|ability)\w*\s*\("),
    ("role wrapper", r"\bwith(?:Role|Permission)\w*\s*\("),
)
# Calls that are a sign-in check by themselves.
GUARD_SIGNALS = ("passport.authenticate", "getServerSession", "getSession", "verifyToken", "requireAuth", "isAuthenticated", "ensureLoggedIn")
WRAPPED_EXPORT = r"(?m)^export\s+const\s+[A-Z]+\s*(?::[^=\n]*)?=\s*([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\("


def is_guard(name: Column) -> Column:
    """A name that reads as a sign-in check; a limiter slows requests and checks nobody."""
    return name.rlike(GUARD_NAME) & ~name.rlike(LIMITER_NAME)


def _seen(tests: list[tuple[Column, Column]]) -> Column:
    """Names of the tests that hold, in their order."""
    return F.filter(F.array(*(F.when(test, name) for name, test in tests)), lambda x: x.isNotNull())


def route_auth(routes: DataFrame) -> DataFrame:
    """(repo, route_id, status, signals, role_checks, admin). Authenticated: a guard among the middleware or a session check in
    the handler, or the handler's export wrapped in a guard; unknown: middleware of another name; a limiter alone shows nothing.
    signals: the guards and calls that say so, by name. role_checks: names of the role signals in middleware and handler, each once."""
    guards = F.filter("middleware", is_guard)
    wrapper = F.regexp_extract("body", WRAPPED_EXPORT, 1)
    wrapped = F.coalesce((F.col("framework") == "next_app") & is_guard(wrapper), F.lit(False)) if "framework" in routes.columns else F.lit(False)
    other = F.filter("middleware", lambda m: ~is_guard(m) & ~m.rlike("(?i)limit|valid|schema|upload|parse|log|cors"))
    status = F.when((F.size(guards) > 0) | wrapped | F.col("body").rlike(SESSION_CHECK), "authenticated").when(F.size(other) > 0, "unknown").otherwise("unauthenticated")
    said = F.concat_ws("\n", F.array_join("middleware", " "), "body")
    calls = _seen([(F.lit(g), said.contains(g)) for g in GUARD_SIGNALS] + [(F.lit("auth()"), said.rlike(r"\bauth\s*\(")), (wrapper, wrapped)])
    roles = _seen([(F.lit(name), said.rlike(pattern)) for name, pattern in ROLE_SIGNALS])
    return routes.select("repo", "route_id", status.alias("status"), F.array_distinct(F.concat(calls, F.coalesce(guards, F.array().cast("array<string>")))).alias("signals"), roles.alias("role_checks"), paths.is_admin_path(F.col("url")).alias("admin"))


def token_checks(files: DataFrame) -> DataFrame:
    """(repo, file, line, kind): tokens verified, and tokens whose payload is only decoded."""
    lines = files.where(paths.is_scannable(F.col("path"))).select("repo", F.col("path").alias("file"), F.posexplode(F.split("bare", "\n")).alias("i", "text"))
    verified = r"\bjwt\s*\.\s*verify\s*\(|\bjwtVerify\s*\(|\bverifyIdToken\s*\(|\bcrypto\s*\.\s*subtle\s*\.\s*verify\s*\("
    decoded = r"\bjwt\s*\.\s*decode\s*\(|\bjwt_?[dD]ecode\s*\(|\bdecodeJwt\s*\(|\.\s*split\s*\(\s*['\"`]\.['\"`]\s*\)\s*\[\s*1\s*\]"
    kind = F.when(F.col("text").rlike(verified), "verified").when(F.col("text").rlike(decoded), "decoded_unverified")
    return lines.select("repo", "file", (F.col("i") + 1).alias("line"), kind.alias("kind")).where("kind is not null")


def deployments(files: DataFrame) -> DataFrame:
    """(repo, kind, name, ports, file, line) of container builds, compose services, infrastructure and hosting files."""
    base = F.element_at(F.split("path", "/"), -1)
    lines = files.select("repo", F.col("path").alias("file"), base.alias("base"), F.posexplode(F.split("content", "\n")).alias("i", "text"))
    docker = lines.where(F.lower("base").rlike(r"^dockerfile(?:\.|\z)") & F.col("text").rlike(r"(?i)^\s*(?:EXPOSE|FROM)\s"))
    exposed = F.transform(F.regexp_extract_all(F.regexp_extract("text", r"(?i)^\s*EXPOSE\s+(.*)", 1), F.lit(r"\d+"), F.lit(0)), lambda p: p.cast("int"))
    containers = docker.groupBy("repo", "file").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(exposed)))).alias("ports"), (F.min("i") + 1).alias("line")).select("repo", F.lit("container").alias("kind"), F.col("file").alias("name"), "ports", "file", "line")
    compose = lines.where(F.col("base").rlike(r"^(?:docker-)?compose.*\.ya?ml\z"))
    w = Window.partitionBy("repo", "file").orderBy("i")
    top = F.last(F.when(F.col("text").rlike(r"^[\w-]+\s*:"), F.regexp_extract("text", r"^([\w-]+)", 1)), ignorenulls=True).over(w)
    service = F.last(F.when(F.col("text").rlike(r"^ {2}[\w.-]+\s*:"), F.struct(F.regexp_extract("text", r"^ {2}([\w.-]+)", 1).alias("name"), (F.col("i") + 1).alias("line"))), ignorenulls=True).over(w)
    inside = compose.withColumns({"top": top, "service": service}).where("top = 'services' and service is not null")
    port = F.when(F.col("text").rlike(r"^\s*-\s*['\"]?(?:[\d.]+:)?\d+:\d+"), F.regexp_extract("text", r":(\d+)['\"]?(?:/\w+)?['\"]?\s*(?:#.*)?\z", 1))
    services = inside.groupBy("repo", "file", "service").agg(F.array_sort(F.collect_set(F.try_to_number(port, F.lit("99999")).cast("int"))).alias("ports")).select("repo", F.lit("service").alias("kind"), "service.name", "ports", "file", "service.line")
    none = F.array().cast("array<int>")
    tf = lines.where(F.col("base").endswith(".tf") & F.col("text").rlike(r'^\s*resource\s+"[^"]+"\s+"[^"]+"')).select("repo", F.lit("infrastructure").alias("kind"), F.regexp_extract("text", r'^\s*resource\s+"([^"]+)"', 1).alias("name"), none.alias("ports"), "file", (F.col("i") + 1).alias("line"))
    host = F.when(F.col("base") == "vercel.json", "vercel").when(F.col("base").rlike(r"^serverless\.ya?ml\z"), "serverless").when(F.col("base").rlike(r"^wrangler\.(?:toml|jsonc?)\z"), "worker")
    hosts = lines.where("i = 0").select("repo", F.lit("hosting").alias("kind"), host.alias("name"), none.alias("ports"), "file", F.lit(1).alias("line")).where("name is not null")
    jobs = lines.where(F.col("file").rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml\z") & F.col("text").rlike(r"(?i)\b(?:deploy|release|publish)\b")).groupBy("repo", "file").agg((F.min("i") + 1).alias("line")).select("repo", F.lit("workflow").alias("kind"), F.col("file").alias("name"), none.alias("ports"), "file", "line")
    return containers.unionByName(services).unionByName(tf).unionByName(hosts).unionByName(jobs)
