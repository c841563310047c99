"""Repository paths as columns: tiers, source files, routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and endings that decide a path's tier.
IGNORED_DIRS = ("node_modules", "dist", "build", ".next", "out", "coverage", "vendor", ".git", "__pycache__", ".venv", "public", "assets")
BINARY_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "bmp", "avif", "pdf", "zip", "gz", "tgz", "tar", "7z", "rar", "mp4", "mov",
    "webm", "mp3", "wav", "woff", "woff2", "ttf", "otf", "eot", "exe", "dll", "so", "dylib", "class", "jar", "bin", "wasm", "lockb",
)
LOCKFILES = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "poetry.lock", "uv.lock", "pipfile.lock", "gemfile.lock", "composer.lock", "cargo.lock", "go.sum")
SCANNED_LOCKFILES = ("package-lock.json",)
SOURCE_EXTENSIONS = (
    "js", "jsx", "mjs", "cjs", "ts", "tsx", "vue", "svelte", "py", "rb", "go", "java", "kt", "kts", "scala", "php", "rs", "cs",
    "swift", "c", "cc", "cpp", "h", "hpp", "dart", "ex", "exs", "lua", "pl", "sql", "sh", "bash",
)
LOW_DIRS = ("test", "tests", "__tests__", "__mocks__", "e2e", "docs", "doc", "examples", "example", "scripts")
HIGH_DIRS = ("routes", "controllers", "middleware", "models", "prisma")
MEDIUM_DIRS = ("src", "lib", "server", "api", "config")
MAX_FILE_BYTES, MAX_LOCKFILE_BYTES = 200 * 1024, 1024 * 1024
TIERS = ("high", "medium", "low", "ignore")


def _parts(path: Column) -> tuple[Column, Column, Column, Column]:
    """Lower-case path, its directories, base name and ending."""
    lower = F.lower(F.regexp_replace(F.translate(path, "\\", "/"), r"^\.?/", ""))
    segments = F.split(lower, "/")
    base = F.element_at(segments, -1)
    return lower, F.slice(segments, F.lit(1), F.size(segments) - 1), base, F.regexp_extract(base, r"^.+\.([^.]*)\z", 1)


def _first_of(dirs: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.filter(dirs, lambda d: d.isin(*names)), F.lit(0))


def classify(path: Column, size: Column) -> Column:
    """struct<tier, reason>. What is ignored comes first, then lockfiles, low, high, medium; the rest is low ("other").
    An unknown size is no reason to ignore."""
    lower, dirs, base, ext = _parts(path)
    ignored, low, high, medium = (_first_of(dirs, names) for names in (IGNORED_DIRS, LOW_DIRS, HIGH_DIRS, MEDIUM_DIRS))
    say = lambda tier, reason: F.struct(F.lit(tier).alias("tier"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    return (
        F.when((base.rlike(r"^\.env(?:rc|[._-].*)?\z") | (ext == "env")) & (base != ".env.example"), say("ignore", "environment file (never fetched)"))
        .when(ignored.isNotNull(), say("ignore", F.concat(ignored, F.lit("/ is not first-party source"))))
        .when(ext.isin(*BINARY_EXTENSIONS), say("ignore", F.concat(F.lit("binary or media (."), ext, F.lit(")"))))
        .when(base.rlike(r"\.min\.(js|mjs|css)\z"), say("ignore", "minified file"))
        .when(base.isin(*SCANNED_LOCKFILES) & (size > MAX_LOCKFILE_BYTES), say("ignore", "lockfile over 1 MiB (too large to fetch)"))
        .when(~base.isin(*SCANNED_LOCKFILES) & (size > MAX_FILE_BYTES), say("ignore", "over 200 KB"))
        .when(base.isin(*LOCKFILES), say("medium", "dependencies"))
        .when(low.isNotNull(), say("low", F.concat(low, F.lit("/"))))
        .when(base.rlike(r"\.(test|spec)\.[a-z]+\z") | base.rlike(r"_test\.(go|py|rb)\z") | base.rlike(r"^test_.+\.py\z"), say("low", "test"))
        .when(ext.isin("md", "mdx", "rst"), say("low", "documentation"))
        .when(base == "package.json", say("high", "package manifest"))
        .when(high.isNotNull(), say("high", F.concat(high, F.lit("/"))))
        .when(lower.rlike("auth|session|login|admin"), say("high", "authentication or administration"))
        .when(base == "schema.prisma", say("high", "data schema"))
        .when(lower.rlike(r"(^|/)app/(.+/)?route\.(ts|js)\z"), say("high", "app router route handler"))
        .when(lower.rlike(r"(^|/)pages/api/"), say("high", "pages API route"))
        .when(base.rlike(r"^(server|app)\.(ts|js)\z") | lower.rlike(r"^(src/)?index\.(ts|js)\z"), say("high", "application entry point"))
        .when((base == "dockerfile") | base.startswith("dockerfile."), say("high", "container build"))
        .when(base.rlike(r"^docker-compose.*\.ya?ml\z"), say("high", "container orchestration"))
        .when(base.endswith(".tf"), say("high", "infrastructure as code"))
        .when(base.isin("serverless.yml", "vercel.json"), say("high", "deployment config"))
        .when(base.startswith("next.config."), say("high", "framework config"))
        .when(base.isin("firebase.json", "firestore.rules", "storage.rules"), say("high", "Firebase config and rules"))
        .when(base == ".env.example", say("high", "documents required environment"))
        .when(base.endswith(".graphql"), say("high", "GraphQL schema"))
        .when(F.array_contains(dirs, "config"), say("medium", "config/"))
        .when(medium.isNotNull() & ext.isin(*SOURCE_EXTENSIONS), say("medium", F.concat(F.lit("source in "), medium, F.lit("/"))))
        .otherwise(say("low", "other"))
    )


def is_source_file(path: Column) -> Column:
    _, _, base, ext = _parts(path)
    return ext.isin(*SOURCE_EXTENSIONS) & ~base.isin(*LOCKFILES)


# Endings, directories and names that decide whether rules read a file.
SCANNED_ENDING = r"\.(?:ts|tsx|js|jsx|mjs|cjs)\z"
UNSCANNED_DIR = r"(?i)(^|/)(?:tests?|__tests__|__mocks__|mocks?|e2e|examples?|fixtures?|docs?|scripts|stories|bin|tools)/"
UNSCANNED_BUILD = r"(^|/)(?:node_modules|dist|build|\.next|coverage)/"
UNSCANNED_NAME = r"\.(?:test|spec|stories)\.[jt]sx?\z"


def is_scannable(path: Column) -> Column:
    """JavaScript and TypeScript that is first-party source: no tests, samples, documents, tools or builds."""
    p = F.translate(path, "\\", "/")
    return p.rlike(SCANNED_ENDING) & ~p.rlike(UNSCANNED_DIR) & ~p.rlike(UNSCANNED_NAME) & ~p.rlike(UNSCANNED_BUILD)


def app_route(path: Column) -> Column:
    """URL of an App Router handler file: groups and private folders are no part of it; null for other files."""
    inner = F.regexp_extract(path, r"(?:^|/)app/((?:.+/)?)route\.(?:ts|tsx|js|jsx|mjs)\z", 1)
    segments = F.filter(F.split(inner, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)\z"))
    private = F.exists(segments, lambda s: s.startswith("_"))
    return F.when(path.rlike(r"(?:^|/)app/(?:.+/)?route\.(?:ts|tsx|js|jsx|mjs)\z") & ~private, F.concat(F.lit("/"), F.array_join(F.transform(segments, route_segment), "/")))


def route_segment(segment: Column) -> Column:
    """[id] becomes :id, [...rest] and [[...rest]] become *."""
    return F.when(segment.rlike(r"^\[\[?\.\.\..+\]\]?\z"), "*").otherwise(F.regexp_replace(segment, r"^\[(.+)\]\z", ":$1"))


def is_admin_path(path: Column) -> Column:
    return F.exists(F.split(F.lower(path), "/"), lambda s: s.rlike(r"^admins?\z|^administrat"))


def model_bound(reason: Column) -> Column:
    """Whether a file may go to a model: lockfiles are read for advisories only."""
    return ~reason.eqNullSafe(F.lit("dependencies"))
