"""Windows of code for a batch of elements: request handlers in their files, what they call one step on, and the startup file.

files: repo, path, content, bare. Definitions are found line by line, calls in the text of a handler's window; a call is
followed by joins, (file, instance) to (file, class) to (file, method), never by running anything. Only the walk over the
few candidates of a batch is sequential, since what a cap admits depends on what was admitted before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators import modules
from wardline.operators.windows import skip_fit, walk
from wardline.session import materialize

# Windows of an element, lines of a window and of the startup file, characters of a batch.
HANDLERS, CALLS, LINES, STARTUP_LINES, BUDGET = 4, 4, 40, 200, 21_000
DEFINITIONS = (
    r"^\s*this\.([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?(?:function\s*[\w$]*\s*)?\(\s*req\b",
    r"^\s*(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(\s*req\b",
    r"^\s*(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?\(\s*req\b",
)
METHODS = (r"^\s*this\.([A-Za-z_$][\w$]*)\s*=", r"^\s*(?:async\s+)?([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*\{", r"^\s*([A-Za-z_$][\w$]*)\s*:\s*(?:async\s+)?(?:function\b|\()")
CALL = r"\b([A-Za-z_$][\w$]*)\.([A-Za-z_$][\w$]*)\s*\("
REGISTERS = r"\b(?:app|router)\s*\.\s*(?:get|post|put|patch|delete|all)\s*\("
STARTS = (r"\bexpress\s*\(\s*\)", r"\.listen\s*\(|\bcreateServer\s*\(")


def _first(line: Column, patterns: tuple[str, ...]) -> Column:
    """The name in the first pattern that a line matches, or null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in patterns))


def _held(value: Column, use) -> Column:
    """use(value), the value made once: as a lambda's variable it is not made again at each place that names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _defined(files: DataFrame, of) -> DataFrame:
    """(repo, file, name, line, lo, hi, of): functions whose first parameter is the request, with what of(text) makes of the window from
    there on. Only definitions leave the row of their file, never all its lines."""

    def found(f: Column) -> Column:
        each = F.transform(f["seen"], lambda x, i: F.struct(_first(x, DEFINITIONS).alias("name"), (i + 1).alias("line")))
        window = lambda d: F.array_join(F.slice(f["lines"], d["line"], F.lit(LINES)), "\n")
        hi = lambda d: F.least(F.size(f["lines"]), d["line"] + LINES - 1)
        return F.transform(F.filter(each, lambda d: d["name"].isNotNull()), lambda d: F.struct(d["name"].alias("name"), d["line"].alias("line"), hi(d).alias("hi"), _held(window(d), of).alias("of")))

    held = F.struct(F.split("content", "\n").alias("lines"), F.split("bare", "\n").alias("seen"))
    each = files.select("repo", F.col("path").alias("file"), F.explode(_held(held, found)).alias("d"))
    return each.select("repo", "file", "d.name", "d.line", F.col("d.line").alias("lo"), "d.hi", "d.of")


def handler_definitions(files: DataFrame) -> DataFrame:
    """(repo, file, name, line, lo, hi, text): functions whose first parameter is the request, with the window from there on."""
    return _defined(files, lambda text: text).withColumnRenamed("of", "text")


def method_definitions(files: DataFrame) -> DataFrame:
    """(repo, file, name, lo, hi, text): the first line where a file defines a method of each name, with its window."""
    each = files.select("repo", F.col("path").alias("file"), F.posexplode(F.split("bare", "\n")).alias("i", "seen"))
    names = F.array_distinct(F.array(*(F.regexp_extract("seen", p, 1) for p in METHODS)))
    first = each.select("repo", "file", F.explode(names).alias("name"), "i").where("name <> ''").groupBy("repo", "file", "name").agg((F.min("i") + 1).alias("lo"))
    held = files.select("repo", F.col("path").alias("file"), F.split("content", "\n").alias("lines"))
    return first.join(held, ["repo", "file"]).select("repo", "file", "name", "lo", F.least(F.size("lines"), F.col("lo") + LINES - 1).alias("hi"), F.array_join(F.slice("lines", F.col("lo"), F.lit(LINES)), "\n").alias("text"))


def serves_http(files: DataFrame) -> DataFrame:
    """(repo, file) of files that define a request handler or register a route."""
    hit = F.exists(F.split("bare", "\n"), lambda x: _first(x, DEFINITIONS).isNotNull()) | F.col("bare").rlike(REGISTERS)
    return files.where(hit).select("repo", F.col("path").alias("file"))


def called_methods(files: DataFrame, asked: DataFrame, handlers: DataFrame) -> DataFrame:
    """(repo, file, line, place, label, target, lo, hi, cost): calls of methods of required classes in the windows of handlers, with the
    window of the method each means; of equal calls in a file the first, by handler and place. asked: the files of the handlers;
    handlers: repo, file, line, and calls, what CALL finds in the window."""
    bound = modules.resolve(modules.bindings(asked).where("form = 'require'"), files)
    owners = materialize(modules.instances(asked, bound), "owners")
    each = handlers.select("repo", "file", "line", F.posexplode("calls").alias("place", "call"))
    first = each.groupBy("repo", "file", "call").agg(F.min(F.shiftleft(F.col("line").cast("bigint"), 31) + F.col("place")).alias("at"))
    calls = first.select(
        "repo", "file", F.shiftright("at", 31).cast("int").alias("line"), (F.col("at") % (1 << 31)).cast("int").alias("place"), F.substring_index("call", ".", 1).alias("instance"), F.regexp_extract("call", r"\.([\w$]+)", 1).alias("name")
    )
    meant = calls.join(owners, ["repo", "file", "instance"])
    found = method_definitions(files.join(owners.select("repo", F.col("target").alias("path")).distinct(), ["repo", "path"], "left_semi")).withColumnRenamed("file", "target").withColumn("cost", F.length("text") + 1)
    return meant.join(found, ["repo", "target", "name"]).select("repo", "file", "line", "place", F.concat("class", F.lit("."), "name").alias("label"), "target", "lo", "hi", "cost")


def startup_files(files: DataFrame) -> DataFrame:
    """(repo, file, lo, hi, cost): of each repository the file that makes the application and listens; the shallowest, then
    the first by name."""
    f = files.where(F.col("path").rlike(r"\.(?:js|ts|mjs|cjs)\z") & F.col("bare").rlike(STARTS[0]) & F.col("bare").rlike(STARTS[1]))
    lines = F.split("content", "\n")
    each = F.struct(F.size(F.split("path", "/")).alias("depth"), "path", F.least(F.size(lines), F.lit(STARTUP_LINES)).alias("hi"), (F.length(F.array_join(F.slice(lines, F.lit(1), F.lit(STARTUP_LINES)), "\n")) + 1).alias("cost"))
    return f.groupBy("repo").agg(F.min(each).alias("b")).select("repo", F.col("b.path").alias("file"), F.lit(1).alias("lo"), "b.hi", "b.cost")


def placed_windows(elements: DataFrame, files: DataFrame, startup: DataFrame | None = None, budget: int = BUDGET) -> DataFrame:
    """(repo, batch, place, kind, file, lo, hi, label, taken): handler windows, then those of called methods, then the startup
    file, each place of a file once in a batch, in the order of elements, files, lines and calls; taken: whether it fits the
    budget of the batch, in that order, others passed over.

    elements: repo, batch, element (its place), path, pos (the file's place in it). startup: (repo, batch) of the batches that
    are offered the startup file; all where null. An element has at most four windows of each kind that are new to its batch.
    Files that are not there have none; an empty table gives an empty one.

    No text moves: a window is its lines and what it costs. Of equal calls in a file only the first is offered: if an
    element passes it over, its caps or what was seen pass over the later ones too."""
    sized = lambda t: F.struct((F.length(t) + 1).alias("cost"), F.regexp_extract_all(t, F.lit(CALL), F.lit(0)).alias("calls"))
    asked = files.join(elements.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    h = materialize(_defined(asked, sized).select("repo", "file", "name", "line", "lo", "hi", "of.cost", "of.calls"), "handlers")
    calls = called_methods(files, asked, h)
    own = elements.select("repo", "batch", "element", "pos", F.col("path").alias("file")).distinct()
    one = own.join(h, ["repo", "file"]).select("repo", "batch", "element", "pos", "line", F.lit(-1).alias("place"), F.lit("handler").alias("kind"), "file", "lo", "hi", F.col("name").alias("label"), "cost")
    two = own.join(calls, ["repo", "file"]).select("repo", "batch", "element", "pos", "line", "place", F.lit("method").alias("kind"), F.col("target").alias("file"), "lo", "hi", "label", "cost")
    order = ["element", "pos", "line", "place"]
    candidates = materialize(one.unionByName(two), "windows")

    def step(state, element: int, kind: str, file: str, lo: int):
        at, n, m, open_, seen = state
        if element != at:
            n, m = 0, 0
        new = (file, lo) not in seen
        if kind == "handler":
            open_ = n < HANDLERS
            taken = open_ and new
            n += taken
        else:
            taken = open_ and m < CALLS and new
            m += taken
        return (element, n, m, open_, seen | {(file, lo)} if taken else seen), taken

    keys = ["repo", "batch", *order]
    admitted = walk(candidates, ["repo", "batch"], order, ["element", "kind", "file", "lo"], lambda: (None, 0, 0, False, frozenset()), step, "__ok", "boolean").where("__ok").select(*keys)
    windows = candidates.join(admitted, keys).withColumn("rank", F.when(F.col("kind") == "handler", 0).otherwise(1))
    batches = (elements.select("repo", "batch") if startup is None else startup.select("repo", "batch")).distinct()
    start = batches.join(startup_files(files), "repo").select("repo", "batch", F.lit(0).alias("element"), F.lit(0).alias("pos"), F.lit(0).alias("line"), F.lit(0).alias("place"), F.lit("startup").alias("kind"), "file", "lo", "hi", F.col("file").alias("label"), "cost", F.lit(2).alias("rank"))
    every = materialize(windows.unionByName(start.select(*windows.columns)), "offered")
    fitted = skip_fit(every, ["repo", "batch"], "cost", ["rank", *order], budget)
    return fitted.select("repo", "batch", F.struct("rank", *order).alias("place"), "kind", "file", "lo", "hi", "label", "taken")


def extra_windows(elements: DataFrame, files: DataFrame, startup: DataFrame | None = None, budget: int = BUDGET) -> DataFrame:
    """(repo, batch, place, kind, file, lo, hi, label, text, taken): placed_windows with their texts. A text is cut once for each
    window of a file and joined to the batches last."""
    placed = materialize(placed_windows(elements, files, startup, budget), "placed")
    spans = placed.groupBy("repo", F.col("file").alias("path")).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    cut = lambda lines: lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), F.array_join(F.slice(lines, s["lo"], s["hi"] - s["lo"] + 1), "\n").alias("text"))
    each = files.join(spans, ["repo", "path"]).select("repo", F.col("path").alias("file"), F.explode(_held(F.struct(F.split("content", "\n").alias("lines"), "spans"), lambda f: F.transform(f["spans"], cut(f["lines"])))).alias("w"))
    texts = each.select("repo", "file", "w.*")
    return placed.join(texts, ["repo", "file", "lo", "hi"]).select("repo", "batch", "place", "kind", "file", "lo", "hi", "label", "text", "taken")
