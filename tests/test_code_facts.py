"""Facts that need nesting, from small repositories of our own."""

from wardline.operators import code_facts as cf
from wardline.operators import extract


def col(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


APP = """const users = require("./routes/users");
const limit = rateLimit({ windowMs: 1, max: [1, 2] });
app.use(helmet(), cors({ origin: ["a", "b"] }));
app.use("/users", requireAuth, users);
app.set("x", 1); app.get("env");
app.post("/login", limit, (req, res) => { res.send("a, b"); });
app.delete('/admin/items/:id', [requireAuth, hasRole("x")], async function (req, res) { await f({ a: 1 }); });
app.get(`/open`, mystery, handler); // app.get("/commented", x)
const s = "app.get('/string', h)";
"""
USERS = 'router.get("/:id", (req, res) => { if (req.user) res.json(jwt.decode(t)); });\napp.use(session({ secret: k, cookie: { httpOnly: false, secure: isProd, sameSite: "Lax" } }));\n'


def files(spark):
    rows = [
        ("r", "src/app.js", APP), ("r", "src/routes/users.js", USERS), ("r", "app/api/x/route.ts", "export async function GET() { return getServerSession(); }"), ("q", "app/api/x/route.ts", "export const POST = 1"), ("r", "tests/app.js", APP),
        ("r", "Dockerfile", "FROM node\nEXPOSE 80 443/tcp\n"), ("r", "docker-compose.yml", "version: 3\nservices:\n  db:\n    ports:\n      - \"5432:5432\"\n  web:\n    image: x\nvolumes:\n  data:\n"), ("r", "main.tf", 'resource "aws_s3_bucket" "b" {}\n'),
        ("r", "vercel.json", "{}"), ("r", ".github/workflows/ci.yml", "jobs:\n  deploy:\n"), ("r", "src/db.ts", "new Pool({}); localStorage.getItem('x')"),
    ]
    f = spark.createDataFrame(rows, "repo string, path string, content string")
    return extract.masked(extract.masked(f, "content"), "content", "bare", strings=False)


def test_routes_and_auth(spark):
    f = files(spark)
    routes = cf.all_routes(f)
    assert col(routes, "repo", "route_id", "method", "url", "file", "line") == [
        ("q", "route-1", "POST", "/api/x", "app/api/x/route.ts", 1), ("r", "route-1", "GET", "/api/x", "app/api/x/route.ts", 1), ("r", "route-2", "POST", "/login", "src/app.js", 6),
        ("r", "route-3", "DELETE", "/admin/items/:id", "src/app.js", 7), ("r", "route-4", "GET", "/open", "src/app.js", 8), ("r", "route-5", "GET", "/users/:id", "src/routes/users.js", 1),
    ]
    auth = {(r.repo, r.route_id): r for r in cf.route_auth(routes).collect()}
    status = {k: r.status for k, r in auth.items() if k[0] == "r"}
    assert status == {("r", "route-1"): "authenticated", ("r", "route-2"): "unauthenticated", ("r", "route-3"): "authenticated", ("r", "route-4"): "unknown", ("r", "route-5"): "authenticated"}
    assert auth["r", "route-3"].admin and auth["r", "route-3"].role_checks == ["hasRole"]
    assert col(cf.use_calls(f), "line", "prefix", "names") == [(2, None, ["session"]), (3, None, ["helmet", "cors"]), (4, "/users", ["requireAuth", "users"])]


def test_two_mounts_are_unknown(spark):
    f = spark.createDataFrame([("r", "a.js", 'const u = require("./u");\napp.use("/x", u); app.use("/y", u);'), ("r", "u.js", 'router.get("/z", h, (q, s) => 1)')], "repo string, path string, content string")
    assert cf.mount_prefixes(f, cf.use_calls(f)).count() == 0
    assert col(cf.all_routes(f), "url") == [("/z",)]


def test_other_facts(spark):
    f = files(spark)
    assert col(cf.token_checks(f), "file", "line", "kind") == [("src/routes/users.js", 1, "decoded_unverified")]
    assert col(cf.deployments(f), "kind", "name", "ports", "line") == [
        ("container", "Dockerfile", [80, 443], 1), ("hosting", "vercel", [], 1), ("infrastructure", "aws_s3_bucket", [], 1), ("service", "db", [5432], 3), ("service", "web", [], 6), ("workflow", ".github/workflows/ci.yml", [], 2),
    ]


def test_broken_code():
    assert cf.routes_in("app.get('/x', (a, b") == [(1, "GET", "/x", [], "(a, b")]
    assert cf.routes_in("") == [] and cf.uses_in("app.use(") == [(1, None, [])]


def test_signals_have_names(spark):
    rows = [
        ("1", "next_app", [], "export const POST = withAuth(async () => { const s = await getServerSession(); if (item.ownerId !== s.id) return; });"), ("2", "express", ["requireRole", "authLimiter"], "if (req.user.id === x.id && roles.includes('a') && user.role == 'b') can('read')"),
        ("3", "express", ["requireLogin", "isAdmin"], None), ("4", "express", [], "where: { userId: req.user.id }, scopes.includes('x'); auth(); withPermission(x)"), ("5", "express", [], "author(x); cannot"),
    ]
    r = spark.createDataFrame([("r", *x, "/x") for x in rows], "repo string, route_id string, framework string, middleware array<string>, body string, url string")
    got = {x.route_id: (x.status, x.signals, x.role_checks) for x in cf.route_auth(r).collect()}
    assert got["1"] == ("authenticated", ["getServerSession", "withAuth"], ["owner comparison"])
    assert got["2"] == ("authenticated", ["requireRole"], ["requireRole", "role comparison", "roles.includes", "user id comparison", "permission call"])
    assert got["3"] == ("authenticated", ["requireLogin", "isAdmin"], ["isAdmin"])
    assert got["4"] == ("authenticated", ["auth()"], ["scope check", "owner-scoped query", "role wrapper"])
    assert got["5"] == ("unauthenticated", [], [])
