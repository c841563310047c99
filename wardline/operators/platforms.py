"""Frameworks, libraries and stores: what manifests declare, pages load and code uses.

files: repo, path, content, bare (comments blank). Patterns run in the JVM; occurrences() gives every match its line without
leaving it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.extract import served_html, usage_frameworks, without_html_comments

# Fixed values, down to EMPTIED: packages and their category, families by scope, addresses that name a library, kinds of
# stores by package and by call, keys of the browser's storage that name a secret.
CATEGORIES = {
    "web": ("express", "next", "fastify", "koa", "hono", "@nestjs/core", "nestjs"),
    "auth": ("passport", "next-auth", "jsonwebtoken", "jose", "express-session", "bcrypt", "bcryptjs", "argon2", "firebase-admin"),
    "database": ("pg", "mysql2", "mongoose", "mongodb", "prisma", "@prisma/client", "sequelize", "typeorm", "drizzle-orm", "redis", "ioredis"),
    "cloud": ("aws-sdk", "firebase"),
    "payments": ("stripe",),
    "security_middleware": ("helmet", "cors", "express-rate-limit", "csurf", "express-validator", "zod", "joi"),
    "upload": ("multer", "formidable", "busboy"),
    "templating": ("ejs", "pug", "handlebars"),
    "http_client": ("axios", "node-fetch", "got"),
}
SCOPES = {"@auth/": "auth", "@clerk/": "auth", "@supabase/": "auth", "@aws-sdk/": "cloud", "@google-cloud/": "cloud", "@nestjs/": "web"}
PACKAGE_HOST = r"(?:^|\.)(?:jsdelivr\.net|unpkg\.com|esm\.sh|skypack\.dev)\z"
FIREBASE_PATH = r"^/firebasejs/([\w.-]+)/"
PACKAGE_PATH = r"^/(?:npm/)?((?:@[\w.-]+/)?[\w.-]+)@([\w.^~-]+)"
ARCHIVE_PATH = r"^/ajax/libs/([\w.-]+)/([\w.-]+)/"
STORE_PACKAGES = {
    "postgres": ("pg", "postgres"), "mysql": ("mysql2",), "mongodb": ("mongoose", "mongodb"), "prisma": ("prisma", "@prisma/client"), "redis": ("redis", "ioredis"), "sqlite": ("better-sqlite3", "sqlite3"),
}
STORE_CALLS = (
    ("new Pool", "postgres", r"\bnew\s+Pool\s*\("), ("new Client", "unknown", r"\bnew\s+Client\s*\("), ("createPool", "mysql", r"\bcreatePool\s*\("), ("mongoose.connect", "mongodb", r"\bmongoose\s*\.\s*connect\s*\("),
    ("new MongoClient", "mongodb", r"\bnew\s+MongoClient\s*\("), ("new PrismaClient", "prisma", r"\bnew\s+PrismaClient\s*\("), ("createClient", "unknown", r"\bcreateClient\s*\("),
    ("firebase.firestore", "firestore", r"\bfirebase\s*\.\s*firestore\s*\(\s*\)"), ("getFirestore", "firestore", r"\bgetFirestore\s*\("), ("setDoc", "firestore", r"\bsetDoc\s*\("),
)
STORE_IMPORTS = (
    ("redis", r"""from\s*['"`](?:redis|ioredis)['"`]|require\(\s*['"`](?:redis|ioredis)['"`]"""), ("postgres", r"""from\s*['"`]pg['"`]|require\(\s*['"`]pg['"`]"""), ("mysql", r"""from\s*['"`]mysql2?"""), ("mongodb", r"""from\s*['"`]mongodb['"`]"""),
)
STORAGE_WRITE = r"\b(?:localStorage|sessionStorage)\s*\.\s*setItem\s*\("
SECRET_NAME = r"(?i)api[_-]?key|secret|token|passw|credential|jwt|bearer|private[_-]?key"
HARMLESS_NAME = r"(?i)expir|ttl\b|count|_name$|name$|version|time|csrf|xsrf|public|publishable|anon|recaptcha|turnstile|captcha|hcaptcha"
EMPTIED = r"""^\s*,\s*(?:(['"`])\1|null|undefined)\s*\)"""


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def occurrences(text: Column, pattern: str) -> Column:
    """An array of (head, lead, rest, line, at): each match of a pattern, the text since the match before and up to the next one, the
    1-based line it begins on and the number of characters up to its end."""
    heads, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    before = lambda measure: F.transform(pieces, lambda p, i: measure(p) + F.when(i > 0, measure(F.get(heads, i - 1))).otherwise(0))
    breaks, lengths = before(newlines), before(F.length)
    total = lambda counts, i, start: F.aggregate(F.slice(counts, F.lit(1), i + 1), start, lambda a, b: a + b)
    return F.transform(heads, lambda h, i: F.struct(h.alias("head"), F.get(pieces, i).alias("lead"), F.get(pieces, i + 1).alias("rest"), total(breaks, i, F.lit(1)).alias("line"), total(lengths, i, F.length(h)).alias("at")))


def found(files: DataFrame, text: Column, pattern: str, *keep: str) -> DataFrame:
    """(repo, file, .., head, rest, line) of every match in files."""
    return files.select("repo", F.col("path").alias("file"), *keep, F.explode(occurrences(text, pattern)).alias("x")).select("repo", "file", *keep, "x.head", "x.rest", "x.line")


def category_of(name: Column) -> Column:
    """The category of a package, or null where it is in none."""
    exact = [F.when(name.isin(*packages), F.lit(c)) for c, packages in CATEGORIES.items()]
    return F.coalesce(*exact, *(F.when(name.startswith(p), F.lit(c)) for p, c in SCOPES.items()))


def manifest_frameworks(files: DataFrame) -> DataFrame:
    """(repo, name, category, version, origin, file, line, dev) of declared packages of a category; in both lists: no development
    package. The line is that of the name in its own list. Broken JSON declares none."""
    m = files.where(F.col("path").rlike(r"(^|/)package\.json\z")).withColumn("m", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>"))
    each = lambda field, dev: m.select("repo", "path", "content", F.explode(f"m.{field}").alias("name", "version"), F.lit(dev).alias("dev"), F.lit(f'"{field}"').alias("section"))
    d = each("dependencies", False).unionByName(each("devDependencies", True)).withColumn("category", category_of(F.col("name"))).where("category is not null")
    place = F.expr("""locate(concat('"', name, '"'), content, greatest(locate(section, content), 1))""")
    line = newlines(F.substring("content", F.lit(1), F.when(place > 0, place).otherwise(F.expr("""locate(concat('"', name, '"'), content)""")))) + 1
    rows = d.select("repo", "name", "path", F.struct("dev", "version", "category", line.alias("line")).alias("x"))
    return rows.groupBy("repo", F.col("path").alias("file"), "name").agg(F.min("x").alias("x")).select("repo", "name", "x.category", F.coalesce("x.version", F.lit("")).alias("version"), F.lit("manifest").alias("origin"), "file", "x.line", "x.dev")


def script_tags(files: DataFrame) -> DataFrame:
    """(repo, file, src, external, integrity, line) of script tags with a source in served pages, comments left out."""
    value = r"""(?i)\bsrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
    # step by step on arrays, so that no condition is written out again for every use of what it reads
    inside = F.transform(occurrences(F.col("__page"), r"(?i)<script\b"), lambda x: F.struct(F.regexp_extract(x["rest"], r"\A([^>]*)>", 1).alias("a"), x["line"].alias("line")))
    tags = F.transform(inside, lambda x: F.struct(F.concat(*(F.regexp_extract(x["a"], value, i) for i in (1, 2, 3))).alias("src"), x["a"].rlike(r"(?i)\bintegrity\s*=").alias("integrity"), x["line"].alias("line")))
    pages = files.where(served_html(F.col("path"))).select("repo", F.col("path").alias("file"), without_html_comments(F.col("content")).alias("__page"))
    t = pages.select("repo", "file", F.explode(F.filter(tags, lambda x: x["src"] != "")).alias("x"))
    return t.select("repo", "file", "x.src", F.col("x.src").rlike(r"(?i)^(?:https?:)?//").alias("external"), "x.integrity", "x.line")


def library(src: Column) -> Column:
    """(name, version) of the library that a script's address loads: of the forms that public hosts use, else the host's name."""
    clean = lambda x: F.substring(F.regexp_replace(x, r"[^\w@./-]", ""), 1, 80)
    named = lambda name, version: F.struct(clean(name).alias("name"), clean(version).alias("version"))

    def of(u: Column) -> Column:
        part = lambda p, i: F.regexp_extract(u["path"], p, i)
        return (
            F.when(u["path"].rlike(FIREBASE_PATH), named(F.lit("firebase"), part(FIREBASE_PATH, 1))).when(u["path"].rlike(PACKAGE_PATH) & u["host"].rlike(PACKAGE_HOST), named(part(PACKAGE_PATH, 1), part(PACKAGE_PATH, 2)))
            .when(u["path"].rlike(ARCHIVE_PATH), named(part(ARCHIVE_PATH, 1), part(ARCHIVE_PATH, 2))).when(u["host"] != "", named(u["host"], F.lit("")))
        )

    host = F.lower(F.regexp_extract(src, r"(?i)^(?:https?:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(src, r"(?i)^(?:https?:)?//[^/?#]*([^?#]*)", 1)
    return F.get(F.transform(F.array(F.struct(host.alias("host"), path.alias("path"))), of), F.lit(0))


def page_libraries(files: DataFrame) -> DataFrame:
    """(repo, name, category, version, origin, file, line, dev): libraries that served pages load from other origins, each
    once a page, at its first tag."""
    t = script_tags(files).where("external").withColumn("l", library(F.col("src"))).where("l is not null")
    first = t.groupBy("repo", "file", F.col("l.name").alias("name")).agg(F.min(F.struct("line", "src", "l")).alias("x"))
    return first.select("repo", "name", F.coalesce(category_of(F.col("name")), F.lit("browser_library")).alias("category"), F.col("x.l.version").alias("version"), F.lit("cdn").alias("origin"), "file", "x.line", F.lit(False).alias("dev"))


def frameworks(files: DataFrame) -> DataFrame:
    """All of them: declared, loaded by pages, used by code."""
    used = usage_frameworks(files).select("repo", "name", "category", F.lit("").alias("version"), "origin", "file", "line", F.lit(False).alias("dev"))
    return manifest_frameworks(files).unionByName(page_libraries(files)).unionByName(used)


def storage_writes(files: DataFrame) -> DataFrame:
    """(repo, file, storage, key, line): writes to the browser's storage under a key that names a secret, but none that empties
    it. A key that is a name counts by itself and by the text that a const of the file gives it."""
    declared = r"""\bconst\s+([A-Za-z_$][\w$.]*)\s*=\s*(['"`])([^'"`\n]*)\2"""
    consts = F.arrays_zip(F.regexp_extract_all("bare", F.lit(declared), F.lit(1)).alias("n"), F.regexp_extract_all("bare", F.lit(declared), F.lit(3)).alias("v"))
    source = files.where(F.translate("path", "\\", "/").rlike(r"\.(?:ts|tsx|js|jsx|mjs|cjs)\z")).select("repo", F.col("path").alias("file"), "bare", consts.alias("consts"))
    quoted, name = r"""\A\s*(['"`])([^'"`\n]*)\1""", r"\A\s*([A-Za-z_$][\w$.]*)"
    # step by step on arrays, so that no condition is written out again for every use of what it reads
    read = F.transform(occurrences(F.col("bare"), STORAGE_WRITE), lambda x: F.struct(
        F.regexp_extract(x["head"], r"\A(\w+)", 1).alias("storage"), F.when(x["rest"].rlike(quoted), F.regexp_extract(x["rest"], quoted, 2)).alias("literal"), F.nullif(F.regexp_extract(x["rest"], name, 1), F.lit("")).alias("ident"),
        F.regexp_replace(x["rest"], f"{quoted}|{name}", "").alias("after"), x["line"].alias("line"),
    ))
    known = F.transform(read, lambda x: F.struct(*(x[c].alias(c) for c in ("storage", "literal", "ident", "after", "line")), F.get(F.filter("consts", lambda k: k["n"] == x["ident"]), F.lit(0))["v"].alias("value")))
    says = lambda c, p: F.coalesce(c.rlike(p), F.lit(False))
    plain = lambda c: F.when(c.rlike(r"^[\w.:-]{1,64}\z"), c)
    secret = F.filter(known, lambda x: says(x["literal"], SECRET_NAME) | says(x["ident"], SECRET_NAME) | says(x["value"], SECRET_NAME))
    kept = F.filter(secret, lambda x: ~says(F.coalesce(x["literal"], x["value"], x["ident"], F.lit("")), HARMLESS_NAME) & ~x["after"].rlike(EMPTIED))
    writes = F.transform(kept, lambda x: F.struct(x["storage"].alias("storage"), F.coalesce(plain(x["literal"]), plain(x["value"]), x["ident"], F.lit("unnamed key")).alias("key"), x["line"].alias("line")))
    return source.select("repo", "file", F.explode(writes).alias("x")).select("repo", "file", "x.storage", "x.key", "x.line")


def datastores(files: DataFrame, frameworks_: DataFrame) -> DataFrame:
    """(repo, kind, name, origin, file, line): declared packages, connecting calls (whose kind the imports settle where the call
    alone does not), rules files, and secrets in the browser's storage. A store seen in several ways stays several rows."""
    package = F.coalesce(*(F.when(F.col("name").isin(*ps), F.lit(k)) for k, ps in STORE_PACKAGES.items()), F.lit("unknown"))
    declared = frameworks_.where("category = 'database'").select("repo", package.alias("kind"), "name", F.lit("dependency").alias("origin"), "file", "line")
    imported = F.coalesce(*(F.when(F.col("content").rlike(p), F.lit(k)) for k, p in STORE_IMPORTS), F.lit("unknown"))
    source = files.where(F.col("path").rlike(r"\.(?:ts|tsx|js|jsx|mjs|cjs)\z")).withColumn("imported", imported)
    calls = found(source, F.col("content"), "|".join(p for _, _, p in STORE_CALLS), "imported")  # one pass for all; the match says which
    meant = calls.withColumn("c", F.coalesce(*(F.when(F.col("head").rlike(p), F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"))) for n, k, p in STORE_CALLS)))
    used = meant.select("repo", F.when(F.col("c.kind") == "unknown", F.col("imported")).otherwise(F.col("c.kind")).alias("kind"), "c.name", F.lit("usage").alias("origin"), "file", "line")
    rules = files.where(F.element_at(F.split("path", "/"), -1) == "firestore.rules").select("repo", F.lit("firestore").alias("kind"), F.lit("firestore.rules").alias("name"), F.lit("config").alias("origin"), F.col("path").alias("file"), F.lit(1).alias("line"))
    kept = storage_writes(files).select("repo", F.lit("browser_storage").alias("kind"), F.concat_ws(" ", "storage", "key").alias("name"), F.lit("usage").alias("origin"), "file", "line")
    return reduce(DataFrame.unionByName, (declared, used, rules, kept))
