import math
import random
import re
import unicodedata
from collections import Counter

import pytest

from wardline.llm import quality as Q

WHITE = re.compile("[\x20\x09-\x0d]+")


def measures(text, lang):
    text = text or ""
    ws = [w for w in WHITE.split(text) if w]
    windows = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {p for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WHITE.sub("", x)]
    upper, digits = sum(unicodedata.category(c) == "Lu" for c in text), sum(c in "0123456789" for c in text)
    symbols, points = sum(c in "#*$%&|<>" for c in text), sum(c in ".,;:!?'\"()-" for c in text)
    wc = sum(map(len, ws))
    low = [w.lower() for w in ws]
    words = [low.count(w) for w in Q.COMMON.get(lang, ())]
    return dict(n_words=len(ws), word_chars=wc, n_symbols=symbols, n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(covered), chars=[upper, digits, symbols, points, len(text) - wc, wc - upper - digits - symbols - points], words=words, n_chars=len(text))


def js(a, b):
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    kl = lambda x, y: sum(u * math.log2(u / ((u + v) / 2)) for u, v in zip(x, y, strict=True) if u)
    return math.sqrt(max(0, (kl(p, q) + kl(q, p)) / 2))


def by_hand(rows):
    m = [(i, (lang or "").lower() if (lang or "").lower() in Q.COMMON else "", measures(t, (lang or "").lower())) for i, t, lang in rows]
    out = []
    for i, lang, x in m:
        group = [y for _, g, y in m if g == lang]
        base = x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]
        cd = js(x["chars"], [sum(c) for c in zip(*(y["chars"] for y in group), strict=True)]) if x["n_chars"] >= Q.LEAST_CHARS else 0
        wd = 0
        if x["n_words"] >= Q.LEAST_WORDS and lang:
            other = lambda y: [*y["words"], y["n_words"] - sum(y["words"])]
            wd = js(other(x), [sum(c) for c in zip(*map(other, group), strict=True)])
        both = x["n_words"] >= Q.LEAST_SUM_WORDS and lang and x["n_chars"] >= Q.LEAST_CHARS and cd + wd > Q.SUM_FAR
        out.append((i, *(x[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base, not base and cd <= Q.CHARS_FAR and wd <= Q.WORDS_FAR and not both))
    return sorted(out, key=repr)


NOUNS = "river stone valley people summer garden window letter market winter forest bridge harbour morning kettle lantern orchard meadow thunder candle".split()
_r = random.Random(12)


def clean():
    return ". ".join(" ".join(_r.choice(Q.COMMON["en"]) if _r.random() < 0.35 else _r.choice(NOUNS) + _r.choice(NOUNS)[:3] for _ in range(12)).capitalize() for _ in range(16)) + "."


CLEAN = clean()
ROWS = [
    (1, CLEAN, "en"), (2, CLEAN.replace("forest", "inn") + "\nA line.\nA line.", "EN"), (3, CLEAN.upper().replace(" ", "!! "), "en"), (4, CLEAN.replace(" ", "*** "), "en"),
    (5, "short", "en"), (6, None, "en"), (7, "", None), (8, "spam ham eggs " * 40, "en"), (9, "Über die Straße und das Haus in der Stadt " * 3, "de"), (1, CLEAN, "en"),
    (None, CLEAN, "xx"), (10, "x " * 20000, "fr"), (11, "a\n\n \nb\nb\n", "es"), (12, "éÉ Ünï \t\v word " * 30, "fr"),
    *((20 + i, clean(), "en") for i in range(40)),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id bigint, text string, lang string, kept int").repartition(3)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = sorted((tuple(r[c] for c in columns) for r in Q.rate_documents(df).collect()), key=repr)
    assert got == by_hand(ROWS)
    kept = sorted(((r.doc_id, r.text) for r in Q.keep_documents(df).collect()), key=repr)
    want = {(r[0]) for r in by_hand(ROWS) if r[-1]}
    assert {k[0] for k in kept} == want and 1 in want and 3 not in want and 4 not in want
    assert Q.keep_documents(df).columns == df.columns


def test_empty_table_and_no_language(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert Q.rate_documents(df).count() == 0 and Q.keep_documents(df).count() == 0
    assert Q.rate_documents(spark.createDataFrame([(1, CLEAN)], "doc_id bigint, text string")).first().kept is True


def test_distance(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1, 0], [0, 1]), ([1, 1], [2, 2]), ([3, 1], [1, 2])], "a array<bigint>, b array<bigint>")
    got = [r[0] for r in df.select(Q.distance(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 0.0, js([3, 1], [1, 2])])
