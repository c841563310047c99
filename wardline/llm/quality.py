"""Quality rules from histograms, in DataFrame functions only.

Each text gives two histograms: characters by class, and a language's common words (with one bin for all
other words). A language's reference is the sum of the histograms of all its texts. A text is rejected when
its Jensen-Shannon distance (square root of the divergence, base 2) to its reference is too large; texts too
short for a histogram to mean anything are not judged by it. Texts in other languages are compared with the
characters of all of them together; words are judged for the four languages in COMMON only. The references are made
of all rows, the poor ones that they serve to find among them, so they lean a little towards those. Counts and references cover every row; the references are one row for
each listed language and one for the rest, so they are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, materialize, put_aside

#: Frequent function words of each language.
COMMON = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on", "are", "with", "as", "be"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
}
BINS = 16
#: Characters of a class are counted by taking all others out. Letters that are not upper case are the rest.
CLASSES = {"upper": r"[^\p{Lu}]+", "digits": r"[^0-9]+", "symbols": r"[^#*$%&|<>]+", "points": r"""[^.,;:!?'"()\-]+"""}
#: Largest distances of the two histograms, and of both together.
CHARS_FAR, WORDS_FAR, SUM_FAR = 0.30, 0.35, 0.42
#: Least characters and words from which a histogram is compared; the sum of both distances asks for more words.
LEAST_CHARS, LEAST_WORDS, LEAST_SUM_WORDS = 200, 50, 100
MIN_WORDS, MAX_REPEAT = 50, 50

Q = "__quality"


def measure(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """docs with one struct column, Q, of counts. Null text has none; a null language is another language."""
    lang = F.lower(F.col(lang_column)) if lang_column in docs.columns else F.lit(None).cast("string")
    key = F.when(lang.isin(*COMMON), lang).otherwise("")
    text = F.coalesce(F.col(text_column), F.lit(""))
    d = docs.withColumns({"__text": text, "__lang": key, "__words": F.filter(F.split(text, WHITE), lambda w: w != "")})
    window = F.when(
        F.size("__words") >= 3,
        F.transform(F.slice("__hash", F.lit(1), F.size("__hash") - 2), lambda h, i: F.xxhash64(h, F.get("__hash", i + 1), F.get("__hash", i + 2))),
    )
    spoken = F.filter("__lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    everything = sorted({w for ws in COMMON.values() for w in ws})
    listed = reduce(lambda c, k: c.when(F.col("__lang") == k, F.array(*map(F.lit, COMMON[k]))), list(COMMON)[1:], F.when(F.col("__lang") == next(iter(COMMON)), F.array(*map(F.lit, next(iter(COMMON.values()))))))
    counts = {name: F.length(F.regexp_replace("__text", others, "")).cast("bigint") for name, others in CLASSES.items()}
    d = d.withColumns({
        "__hash": F.transform("__words", lambda w: F.xxhash64(w)),
        "__lines": F.split("__text", "\n"),
        "__common": F.filter(F.transform("__words", F.lower), lambda w: w.isin(everything)),
        "__listed": F.coalesce(listed, F.array().cast("array<string>")),
        "__n": F.size("__words").cast("bigint"),
        "__chars": F.length("__text").cast("bigint"),
        "__word_chars": F.length(F.regexp_replace("__text", WHITE, "")).cast("bigint"),
    } | {f"__{k}": c for k, c in counts.items()})
    d = d.withColumns({"__window": window, "__spoken": spoken, "__hist": F.transform("__listed", lambda r: F.size(F.filter("__common", lambda w: w == r)).cast("bigint"))})
    # equal windows become neighbours; all their words are covered, the first occurrence's too
    ranked = F.when(F.size(F.array_distinct("__window")) < F.size("__window"), F.array_sort(F.transform("__window", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("__ranked", ranked)
    same = lambda s, i: F.coalesce(F.get("__ranked", i)["h"] == s["h"], F.lit(False))
    starts = F.filter("__ranked", lambda s, i: same(s, i - 1) | same(s, i + 1))
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))))
    return d.withColumn(
        Q,
        F.struct(
            F.col("__lang").alias("lang"), F.col("__n").alias("n_words"), F.col("__word_chars").alias("word_chars"), F.col("__symbols").alias("n_symbols"),
            (F.size("__spoken") - F.size(F.array_distinct("__spoken"))).cast("bigint").alias("n_dup_lines"),
            F.when(F.col("__ranked").isNull(), F.lit(0)).otherwise(covered).cast("bigint").alias("n_repeat_words"),
            F.col("__chars").alias("n_chars"),
            F.array("__upper", "__digits", "__symbols", "__points", F.col("__chars") - F.col("__word_chars"), F.col("__word_chars") - F.col("__upper") - F.col("__digits") - F.col("__symbols") - F.col("__points")).alias("chars"),
            F.col("__hist").alias("words"),
        ),
    ).select(*docs.columns, Q)


def references(measured: DataFrame) -> DataFrame:
    """One row for each listed language and the rest: the summed histograms. Pre-aggregated before the shuffle."""
    n_classes = len(CLASSES) + 2
    return measured.groupBy(F.col(f"{Q}.lang").alias("__lang")).agg(
        F.array(*(F.sum(F.get(f"{Q}.chars", F.lit(i))) for i in range(n_classes))).alias("__ref_chars"),
        F.array(*(F.coalesce(F.sum(F.get(f"{Q}.words", F.lit(i))), F.lit(0)) for i in range(BINS)), F.sum(f"{Q}.n_words")).alias("__ref_words"),
    )


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two count arrays, each with a sum above zero."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    share = lambda x, whole: F.transform(x, lambda v: F.try_divide(v, whole))
    p, q = share(a, total(a)), share(b, total(b))
    log_term = lambda x, m: F.when(x > 0, x * F.log2(F.try_divide(x, m))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: log_term(x, (x + y) / 2) + log_term(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2))


def judge(measured: DataFrame, refs: DataFrame) -> DataFrame:
    """measured with base_failed, chars_far, words_far and kept inside Q."""
    q = lambda name: F.col(f"{Q}.{name}")
    d = measured.join(F.broadcast(refs), q("lang") == F.col("__lang"), "left")
    base_failed = (q("n_words") < MIN_WORDS) | (100 * q("n_repeat_words") > MAX_REPEAT * q("n_words"))
    common = F.aggregate(q("words"), F.lit(0).cast("bigint"), lambda s, v: s + v)
    own = F.concat(q("words"), F.array(q("n_words") - common))
    ref = F.concat(F.slice("__ref_words", 1, BINS), F.array(F.get("__ref_words", F.lit(BINS)) - F.aggregate(F.slice("__ref_words", 1, BINS), F.lit(0).cast("bigint"), lambda s, v: s + v)))
    d = d.withColumns({"__own": own, "__ref": ref})
    chars_far = F.when(q("n_chars") >= LEAST_CHARS, distance(q("chars"), F.col("__ref_chars")))
    words_far = F.when((q("n_words") >= LEAST_WORDS) & (q("lang") != ""), distance(F.col("__own"), F.col("__ref")))
    d = d.withColumns({"__base": base_failed, "__cd": chars_far, "__wd": words_far})
    kept = ~F.col("__base") & (F.coalesce("__cd", F.lit(0.0)) <= CHARS_FAR) & (F.coalesce("__wd", F.lit(0.0)) <= WORDS_FAR)
    kept &= (q("n_words") < LEAST_SUM_WORDS) | (F.coalesce(F.col("__cd") + F.col("__wd"), F.lit(0.0)) <= SUM_FAR)
    return d.withColumn(Q, F.col(Q).withField("base_failed", F.col("__base")).withField("chars_far", F.col("__cd")).withField("words_far", F.col("__wd")).withField("kept", kept)).select(*measured.columns)


def rate_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """One row for each row of docs. Null and empty texts have no words and fail the base rule. Repeated rows and
    rows without an id pass through. An empty table gives an empty one. Texts are read once; only the counts
    are kept for the comparison."""
    columns = [id_column, text_column] + [lang_column] * (lang_column in docs.columns)
    m = materialize(measure(docs.select(*columns), text_column, lang_column).select(id_column, Q), "quality")
    out = judge(m, references(m))
    return out.select(id_column, *(f"{Q}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_far", "words_far")))


def keep_documents(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows that are kept, with all their columns. Rows and counts are written once, so that neither the
    references nor the verdict measure a text again; texts are never shuffled. Null and empty texts go; an empty table
    gives an empty one."""
    docs, back = put_aside(docs)
    m = materialize(measure(docs, text_column, lang_column), "quality")
    return judge(m, references(m)).where(F.col(f"{Q}.kept")).select(*docs.columns).withColumnsRenamed(back)
