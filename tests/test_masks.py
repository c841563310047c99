"""Masks against a reader of one character at a time."""

import random

import pytest

from wardline.operators.extract import mask_both, with_masks


def plain(code, strings):
    out, i, n = list(code), 0, len(code)

    def blank(a, b):
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        escaped = i > 0 and code[i - 1] == "\\"
        if code.startswith("//", i) and not escaped:
            end = code.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
            i = end
        elif code.startswith("/*", i) and not escaped:
            end = code.find("*/", i + 2)
            end = n if end < 0 else end + 2
            blank(i, end)
            i = end
        elif code[i] in "'\"`":
            quote, k = code[i], i + 1
            while k < n and code[k] != quote and not (code[k] == "\n" and quote != "`"):
                k += 2 if code[k] == "\\" else 1
            if strings:
                blank(i + 1, k)
            i = k + 1
        else:
            i += 1
    return "".join(out)


@pytest.mark.parametrize("code", [
    's.replace(/\\/*$/, "");\napp.use(helmet());', "x = /https:\\/\\/a/;\nhelmet();", "/* open\nhelmet()", "`a ${b}\nc", '"open\nhelmet();', "'\\", '"a\\"b" // c', "/**/x/***/y", "'a\\\nb'", "", "/", "\\//x\ny", "/*/ x */ y",
])
def test_cases(code):
    assert mask_both(code) == (plain(code, True), plain(code, False))


def test_escaped_slash_opens_no_comment():
    masked, bare = mask_both('s.replace(/\\/*$/, "x");\napp.use(helmet());\n')
    assert "helmet()" in masked and "helmet()" in bare and '"x"' in bare and '" "' in masked


def test_random_codes():
    rng = random.Random(4)
    for _ in range(4000):
        code = "".join(rng.choice("//**\\\"'`\n ab") for _ in range(rng.randrange(40)))
        assert mask_both(code) == (plain(code, True), plain(code, False)), code


def test_column(spark):
    rows = [("a", "f('x') // y"), ("b", None), ("c", "")]
    got = {r.path: (r.masked, r.bare) for r in with_masks(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {"a": ("f(' ')     ", "f('x')     "), "b": (None, None), "c": ("", "")}
    assert mask_both("`" + "a\\`" * 300_000 + "`")[0].strip() == "`" + " " * 900_000 + "`"
