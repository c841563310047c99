"""Prefixes of mounted routers."""

import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import routers

from .test_handlers import files


def prefixes(spark, repo):
    return {r.file: (r.prefix, r.roots) for r in routers.router_prefixes(files(spark, {"r": repo})).collect()}


APP = ['const users = require("./routes/users");', "import admin from './routes/admin';", 'app.use("/api/v1/", users);', "app.use('/admin', admin);", '// app.use("/old", users);', "app.use(helmet);"]


def test_direct(spark):
    assert prefixes(spark, {"src/app.js": APP, "src/routes/users.js": [""], "src/routes/admin.ts": [""]}) == {"src/routes/users.js": ("/api/v1", 1), "src/routes/admin.ts": ("/admin", 1)}


def test_package_and_missing_file(spark):
    assert prefixes(spark, {"a.js": ['const r = require("some-pkg");', 'app.use("/x", r);', 'const s = require("./gone");', 'app.use("/y", s);']}) == {}


def test_two_prefixes_void_what_lies_below(spark):
    got = prefixes(spark, {
        "app.js": ['const r = require("./r");', 'app.use("/a", r);', 'app.use("/b", r);', 'const t = require("./t");', 'app.use("/t", t);'],
        "r.js": ['import s from "./s"', 'router.use("/s", s)'], "s.js": ['import u from "./u"', "router.use(u)"], "u.js": [""], "t.js": [""],
    })
    assert got == {"r.js": (None, 1), "s.js": (None, 1), "u.js": (None, 1), "t.js": ("/t", 1)}


def test_chain_and_joint(spark):
    chain = {"f0.js": ['import n from "./f1"', 'app.use("/p0", n)']} | {f"f{i}.js": [f'import n from "./f{i + 1}"', "router.use(n)" if i % 3 == 0 else f'router.use("/p{i}", n)'] for i in range(1, 21)} | {"f21.js": [""]}
    got = prefixes(spark, chain)
    assert got == {f"f{k}.js": ("".join(f"/p{i}" for i in range(k) if i == 0 or i % 3), 1) for k in range(1, 22)}
    # two applications that agree, and two that do not
    both = lambda p, q: {"a.js": ['import r from "./r"', f'app.use("{p}", r)'], "b.js": ['import r from "./r"', f'app.use("{q}", r)'], "r.js": [""]}
    assert prefixes(spark, both("/x", "/x/")) == {"r.js": ("/x", 2)} and prefixes(spark, both("/x", "/y")) == {"r.js": (None, 2)}


def test_circle(spark):
    got = prefixes(spark, {"a.js": ['import b from "./b"', 'router.use("/b", b)'], "b.js": ['import a from "./a"', 'router.use("/a", a)'], "app.js": ['import c from "./c"', 'app.use("/c", c)'], "c.js": [""]})
    assert got == {"a.js": (None, 0), "b.js": (None, 0), "c.js": ("/c", 1)}


@pytest.mark.parametrize(("prefix", "path", "want"), [("", "/x", "/x"), (None, "", "/"), ("/", "/x", "/x"), ("/a/", "/x", "/a/x"), ("/a", "x", "/a/x"), ("/a", "/", "/a"), ("/a", "", "/a")])
def test_joined(spark, prefix, path, want):
    assert spark.createDataFrame([(prefix, path)], "a string, b string").select(routers.joined(F.col("a"), F.col("b"))).first()[0] == want


def by_hand(edges):
    """{file: (prefix, roots)} of one repository, by a closure of all pairs."""
    pairs = {}
    for f, t, p in edges:
        pairs.setdefault((f, t), set()).add(p)
    one = {k: v.copy().pop() if len(v) == 1 else None for k, v in pairs.items()}
    while True:
        more = {k: {v} for k, v in one.items()}
        for (a, b), p in one.items():
            for (c, d), q in one.items():
                if b == c:
                    more.setdefault((a, d), set()).add(None if p is None or q is None else p + q)
        now = {k: next(iter(v)) if len(v) == 1 else None for k, v in more.items()}
        if now == one:
            break
        one = now
    below = {t for _, t, _ in edges}
    got = {t: [p for (f, x), p in one.items() if x == t and f not in below] for t in below}
    return {t: (ps[0] if len(set(ps)) == 1 else None, len(ps)) for t, ps in got.items()}


def test_pointers_agree_with_all_pairs_and_stay_few(spark, monkeypatch):
    rng = random.Random(3)
    graphs = {}
    for g in range(120):
        n = rng.randint(2, 9)
        pick = lambda: rng.randrange(n)
        tree = [(max(0, i - rng.randint(1, 3)), i) for i in range(1, n) if rng.random() < 0.85]
        graphs[f"g{g}"] = [(f"f{a}", f"f{b}", rng.choice(["", "/x", f"/p{b}"])) for a, b in tree + [(pick(), pick()) for _ in range(rng.randint(0, 3))] if a != b]
    graphs["chain"] = [(f"f{i}", f"f{i + 1}", f"/p{i}") for i in range(60)]
    rows = sorted({(r, *e) for r, es in graphs.items() for e in es})
    sizes, real = [], routers.materialize
    monkeypatch.setattr(routers, "materialize", lambda df, name: (lambda d: (sizes.append(d.where("repo = 'chain'").count()), d)[1])(real(df, name)))
    monkeypatch.setattr(routers, "mounts", lambda files: spark.createDataFrame(rows, "repo string, file string, target string, prefix string"))
    got = {}
    for r in routers.router_prefixes(None).collect():
        assert r.file not in got.setdefault(r.repo, {})
        got[r.repo][r.file] = (r.prefix, r.roots)
    assert got == {r: by_hand([x[1:] for x in rows if x[0] == r]) for r in graphs if any(x[0] == r for x in rows)}
    assert max(sizes) == 60  # all pairs of the chain are 1,830
