"""Issue drafts against the same form written in plain Python, and their limits."""

import re
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from wardline.functions import text
from wardline.sources import issues

WHITE = "\t\n\v\f\r                  　﻿"
SPACES = re.compile(f"[{WHITE}]+")
n16 = lambda s: len(s.encode("utf-16-le")) // 2


def cut(s, n):
    out = ""
    for c in s:
        if n16(out) + n16(c) > n:
            break
        out += c
    return out


esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
line = lambda s: esc(SPACES.sub(" ", s or "").strip(WHITE))
pct = lambda s: quote(s, safe="-_.!~*'()")
path = lambda s: "/".join(map(pct, s.split("/")))


def plain(t, evidence):
    many = lambda xs: ", ".join(map(line, xs)) if xs else "None"
    head = [f"**Severity:** {t['severity'].capitalize()}", f"**Confidence:** {t['confidence_label'].capitalize()} ({t['confidence']}%)", f"**Basis:** {line(t['basis_label'])}"]
    head += [f"**STRIDE:** {many(t['stride'])}", f"**OWASP Top 10:2025:** {many(t['owasp'])}", f"**CWE:** {many(t['cwe'])}", f"**Affected components:** {many(t['affected'])}", "", "## Attack scenario", esc((t["scenario"] or "").strip(WHITE)), ""]
    tail = ["## Mitigation", esc((t["mitigation"] or "").strip(WHITE))]
    if t["steps"]:
        tail += ["", *(f"{i + 1}. {line(s)}" for i, s in enumerate(t["steps"]))]
    if t["code_location"]:
        tail += ["", "Where: `" + line(t["code_location"]).replace("`", "'") + "`"]
    tail += ["", f"_Generated for {line(t['repo'])} at `" + line(t["ref"]).replace("`", "'") + "`._"]
    lines = []
    for summary, place in evidence:
        if place is None:
            lines.append("- " + line(summary))
            continue
        m = re.match(r"(.*):(\d+)(?:-(\d+))?\Z", place)
        file, anchor = (m[1], f"#L{m[2]}" + (f"-L{m[3]}" if m[3] and int(m[3]) != int(m[2]) else "")) if m else (place, "")
        lines.append("- [`" + place.replace("`", "'") + f"`](https://github.com/{path(t['repo'])}/blob/{path(t['ref'])}/{path(file)}{anchor}) — {line(summary)}")
    for keep in range(len(lines), -1, -1):
        lost = len(lines) - keep
        said = [f"_{lost} more evidence item{'s' if lost > 1 else ''} omitted to fit the issue size limit._"] if lost else []
        body = "\n".join(head + (["## Evidence", *lines[:keep], *said, ""] if lines else []) + tail) + "\n"
        if n16(body) <= 6000:
            break
    else:
        body = cut(body, 5999) + "…"
    title = cut(SPACES.sub(" ", t["title"] or "").strip(WHITE), 200)
    ok = len(t["repo"].split("/")) == 2 and all(t["repo"].split("/"))
    url = f"https://github.com/{path(t['repo'])}/issues/new?title={pct(title)}&body={pct(body)}" if ok else ""
    return title, body, "" if len(url) > 7000 else url, len(url) > 7000


NAMES = "threat_id string, title string, severity string, confidence int, confidence_label string, basis_label string, stride array<string>, owasp array<string>, cwe array<string>, affected array<string>, scenario string, mitigation string, steps array<string>, code_location string, repo string, ref string"


@pytest.fixture(scope="module")
def made(spark):
    base = dict(title=" A  title\n<b> ", severity="high", confidence=45, confidence_label="medium", basis_label="Observed & <seen>", stride=["S Spoofing", "T Tampering"], owasp=[], cwe=["CWE-1"], affected=None, scenario=" One\nTwo <x> ", mitigation="Do it", steps=["a `b`", " c  d "], code_location="src/`a`.ts:1", repo="o/r", ref="main")
    threats = {
        "few": base, "none": base | dict(steps=None, code_location=None, title=None, mitigation=None), "many": base, "edge": base, "short": base,
        "long": base | dict(scenario="x" * 9000), "astral": base | dict(scenario="😀" * 3500, title="😀" * 150), "odd": base | dict(repo="o/r/x", ref="a b/c"), "wide": base | dict(scenario="é" * 3000), "space": base | dict(title="a 　b", ref="v1~!*'()"),
    }
    evidence = {
        "few": [("see\nhere <a>", "src/a b.ts:12-20"), ("one", "x`y.ts:3-3"), ("file", "src/a.ts"), ("no place", None)], "many": [(f"item {i} " + "y" * (i % 90), f"f{i}.ts:{i}") for i in range(300)],
        "edge": [("z" * 2400, None), ("z" * 2400, None), ("z" * 400, None), ("z", None)], "short": [("q", None)] * 3000, "long": [("lost", "a:1"), ("lost", "b:2")], "astral": [("😀" * 20, "é.ts:1-2")], "odd": [("x", "a:b:7")],
    }
    t = spark.createDataFrame([(k, *(v[c.split()[0]] for c in NAMES.split(", ")[1:])) for k, v in threats.items()], NAMES)
    e = spark.createDataFrame([(k, i, s, p) for k, xs in evidence.items() for i, (s, p) in enumerate(xs)] + [("nobody", 0, "s", None)], "threat_id string, pos int, summary string, place string")
    got = {r.threat_id: (r.title, r.body, r.url, r.too_long) for r in issues.issue_links(t, e).collect()}
    return got, {k: plain(v, evidence.get(k, [])) for k, v in threats.items()}, t, e


def test_same_as_plain(made):
    got, want, _, _ = made
    assert set(got) == set(want)
    for k in want:
        assert got[k] == want[k], k


def test_limits(made):
    got = made[0]
    assert all(n16(body) <= 6000 and len(url) <= 7000 for _, body, url, _ in got.values())
    assert "omitted" in got["many"][1] and got["odd"][2] == "" and not got["odd"][3] and got["wide"][3]


def test_empty(made):
    _, _, t, e = made
    assert issues.issue_links(t.limit(0), e).count() == 0
    assert issues.issue_links(t, e.limit(0)).where(F.col("body").contains("## Evidence")).count() == 0


def test_cut_units(spark):
    rows = [("a😀b", n) for n in range(5)] + [("😀￿😀", n) for n in range(6)] + [("", 3), (None, 3)]
    for s, n in rows:
        d = spark.createDataFrame([(s,)], "s string").select(text.cut_units(F.col("s"), n).alias("c"), text.units(F.col("s")).alias("u")).first()
        assert (d.c, d.u) == ((None, None) if s is None else (cut(s, n), n16(s))), (s, n)
