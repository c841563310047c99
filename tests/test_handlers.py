"""Handler windows on small repositories."""

import pytest

from wardline.operators import extract, handlers, modules

PAD = lambda n: [f"// row {i}" for i in range(n)]
ROUTES = ['const OrderStore = require("../data/orders").OrderStore;', "function Orders(db) {", "  const orderStore = new OrderStore(db);", "  this.list = (req, res, next) => {", "    orderStore.byUser(req.params.id, (e, rows) => {});", "  };", "}"]
STORE = ["function OrderStore(db) {", *PAD(60), "  this.byUser = (id, cb) => {", "    return { $where: `x == ${id}` };", "  };", "}"]
SERVER = ['const express = require("express");', "const app = express();", *PAD(100), "  // app.use(csrf());", "http.createServer(app).listen(4000);"]
SHOP = {"app/routes/orders.js": ROUTES, "app/data/orders.js": STORE, "server.js": SERVER}


def files(spark, repos):
    rows = [(r, p, "\n".join(lines)) for r, fs in repos.items() for p, lines in fs.items()]
    return extract.with_masks(spark.createDataFrame(rows, "repo string, path string, content string"))


def windows(spark, repos, elements, **how):
    e = spark.createDataFrame([(r, b, e, p, i) for r, b, e, ps in elements for i, p in enumerate(ps)], "repo string, batch long, element int, path string, pos int")
    rows = handlers.extra_windows(e, files(spark, repos), **how).orderBy("repo", "batch", "place").collect()
    return [(r.repo, r.batch, r.kind, r.file, r.lo, r.hi, r.label, r.taken) for r in rows]


def test_definitions(spark):
    code = ["this.a = (req, res) => {};", "async function b(req, res) {}", "const c = async (req, res) => {};", "this.notOne = (db) => {};", "// this.gone = (req, res) => {};", 'const t = "function x(req)";', "  let d = (request) => {};"]
    f = files(spark, {"r": {"a.js": code}})
    assert [(r.name, r.line) for r in handlers.handler_definitions(f).orderBy("line").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    m = files(spark, {"r": {"d.js": ["// this.m = () => {}", "this.m = () => {}", "  async n(a, b) {", "  o: function () {}", "  p: async (x) => 1", "this.m = 2", "  q (a)"]}})
    assert {(r.name, r.lo) for r in handlers.method_definitions(m).collect()} == {("m", 2), ("n", 3), ("o", 4), ("p", 5)}
    assert {(r.repo, r.file) for r in handlers.serves_http(files(spark, {"r": {"a.js": code, "b.js": ["router.get('/x', f)"], "c.js": ["// app.get('/')", "add(req)"]}})).collect()} == {("r", "a.js"), ("r", "b.js")}


@pytest.mark.parametrize(("file", "spec", "target"), [
    ("app/routes/a.js", "../data/orders", "app/data/orders.js"), ("app/routes/a.js", "./x", "app/routes/x/index.ts"), ("app/routes/a.js", "../../top.js", "top.js"), ("a.js", "./app/data/orders.js", "app/data/orders.js"),
    ("app/a.js", "express", None), ("app/a.js", "../data/missing", None), ("app/a.js", "../../../top", None),
])
def test_resolution(spark, file, spec, target):
    known = spark.createDataFrame([("r", p) for p in ("app/data/orders.js", "app/routes/x/index.ts", "top.js", "x")] + [("other", "app/data/missing.js")], "repo string, path string")
    got = modules.resolve(spark.createDataFrame([("r", file, spec)], "repo string, file string, spec string"), known).collect()
    assert [r.target for r in got] == ([target] if target else [])


def test_bindings(spark):
    code = ['const A = require("./a").A;', "const { B, C: D } = require('./b');", 'import E from "./e";', 'import F1, { G as H, I } from "./f";', 'import * as J from "./j";', "let A = require('./later');", 'const { x: { y } } = require("./no")']
    got = {(r.name, r.spec, r.form) for r in modules.bindings(files(spark, {"r": {"a.js": code}})).collect()}
    assert got >= {("A", "./later", "require"), ("B", "./b", "require"), ("D", "./b", "require"), ("E", "./e", "import"), ("F1", "./f", "import"), ("H", "./f", "import"), ("I", "./f", "import"), ("J", "./j", "import")}
    assert not {n for n, _, _ in got} & {"C", "G"}


def test_one_step_and_startup(spark):
    want = [("r", 0, "handler", "app/routes/orders.js", 4, 7, "list", True), ("r", 0, "method", "app/data/orders.js", 62, 65, "OrderStore.byUser", True), ("r", 0, "startup", "server.js", 1, 104, "server.js", True)]
    assert windows(spark, {"r": SHOP, "s": {"app/data/orders.js": ["x"]}}, [("r", 0, 0, ["app/routes/orders.js", "missing.js"])]) == want
    none = spark.createDataFrame([], "repo string, batch long")
    assert windows(spark, {"r": SHOP}, [("r", 0, 0, ["app/routes/orders.js"])], startup=none) == want[:2]


def test_caps_repeats_and_budget(spark):
    route = ['const D = require("./d");', *(f"const dao{i} = new D(db);" for i in range(10)), *(f"this.h{i} = (req, res) => {{ dao{i}.m(); dao{i}.n{i}(); }};" for i in range(10))]
    d = ["this.m = () => {", *PAD(50), "};", *(f"this.n{i} = () => {{" for i in range(10))]
    repos = {"r": {"r.js": route, "d.js": d, "q.js": route}}
    got = windows(spark, repos, [("r", 7, 0, ["r.js"]), ("r", 7, 1, ["r.js", "q.js"])])
    assert [(x[2], x[3], x[4]) for x in got] == [("handler", "r.js", n) for n in range(12, 20)] + [("method", "d.js", 1)] + [("method", "d.js", 53 + i) for i in range(7)]
    assert got[8][5] == 40 and got[0][5] == 21
    text = {(x[2], x[4]): x for x in windows(spark, repos, [("r", 7, 0, ["r.js"])], budget=900)}
    cost = lambda lo, hi: sum(len(x) + 1 for x in route[lo - 1 : hi])
    left, want = 900, []
    for n in range(12, 16):
        fits = cost(n, 21) <= left
        left -= cost(n, 21) if fits else 0
        want.append(fits)
    assert [text["handler", n][7] for n in range(12, 16)] == want and True in want and False in want


def test_empty(spark):
    assert windows(spark, {"r": {"lib/util.js": ["function add(a, b) { return a + b; }"]}}, [("r", 0, 0, ["lib/util.js"])]) == []
    e = spark.createDataFrame([], "repo string, batch long, element int, path string, pos int")
    assert handlers.extra_windows(e, files(spark, {"r": SHOP})).count() == 0


def test_windows_move_without_texts_and_equal_calls_once(spark, monkeypatch):
    written, real = {}, handlers.materialize
    monkeypatch.setattr(handlers, "materialize", lambda df, name: written.setdefault(name, real(df, name)))
    route = ['const D = require("./d");', "const dao = new D(db);", *(f"this.h{i} = (req, res) => {{ dao.m(); dao.m (); dao.k(); }};" for i in range(6))]
    e = spark.createDataFrame([("r", 0, 0, "r.js", 0), ("r", 0, 1, "r.js", 0)], "repo string, batch long, element int, path string, pos int")
    got = handlers.placed_windows(e, files(spark, {"r": {"r.js": route, "d.js": ["this.m = () => {};", "this.k = () => {};"]}})).orderBy("place").collect()
    assert [(x.kind, x.place.element, x.lo, x.place.place) for x in got] == [("handler", 0, n, -1) for n in (3, 4, 5, 6)] + [("handler", 1, n, -1) for n in (7, 8)] + [("method", 0, 1, 0), ("method", 0, 2, 2)]
    assert not {c for df in written.values() for c in df.columns} & {"text", "lines", "content"}
    # 6 handlers for both elements, and of 18 calls in windows m, m with a space, and k
    assert written["windows"].where("kind = 'handler'").count() == 12 and written["windows"].where("kind = 'method'").count() == 6
