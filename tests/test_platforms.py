"""Frameworks, libraries and stores of small repositories."""

import pytest
from pyspark.sql import functions as F

from wardline.operators import platforms

from .test_handlers import files


def col(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("name", "category"), [
    ("express", "web"), ("mongoose", "database"), ("firebase-admin", "auth"), ("jsonwebtoken", "auth"), ("stripe", "payments"), ("@supabase/ssr", "auth"), ("@aws-sdk/client-s3", "cloud"), ("@nestjs/core", "web"), ("@nestjs/jwt", "web"), ("react", None), ("left-pad", None), ("@auth", None),
])
def test_category(spark, name, category):
    assert spark.createDataFrame([(name,)], "n string").select(platforms.category_of(F.col("n"))).first()[0] == category


def test_manifests(spark):
    text = ['{ "prisma": { "seed": "x" },', ' "dependencies": {', '  "express": "^4.18.0",', '  "prisma": "5"', " },", ' "devDependencies": { "prisma": "4",', '  "zod": "3" } }']
    got = col(platforms.manifest_frameworks(files(spark, {"r": {"package.json": text, "a/package.json": ["{broken"], "b/package.json": ['{"dependencies": []}'], "my-package.json": text}})), "name", "category", "version", "line", "dev", "file")
    assert got == [("express", "web", "^4.18.0", 3, False, "package.json"), ("prisma", "database", "5", 4, False, "package.json"), ("zod", "security_middleware", "3", 7, True, "package.json")]


def test_page_libraries(spark):
    page = [
        "<html><script>inline()</script>", '<script src="https://www.gstatic.com/firebasejs/10.12.0/firebase-app.js"></script><script src="https://www.gstatic.com/firebasejs/10.12.0/firebase-auth.js"></script>', "<script", "  async", "  src='//cdn.jsdelivr.net/npm/chart.js@4.4.0/x.js' integrity='sha384-y'></script>",
        "<!-- <script src=https://unpkg.com/gone@1></script>", "--><script src=https://unpkg.com/@scope/pkg@1.2.3></script>", '<script src="/own.js"></script><scripts src="https://no.io/x.js">', '<SCRIPT SRC="https://User@WWW.Host.io:8080/a.js?b">',
    ]
    f = files(spark, {"r": {"index.html": page, "docs/index.html": page, "a.js": page}})
    assert col(platforms.page_libraries(f), "name", "category", "version", "line", "file") == [
        ("@scope/pkg", "browser_library", "1.2.3", 7, "index.html"), ("chart.js", "browser_library", "4.4.0", 3, "index.html"), ("firebase", "cloud", "10.12.0", 2, "index.html"), ("www.host.io", "browser_library", "", 9, "index.html"),
    ]
    assert [(r.line, r.external, r.integrity) for r in platforms.script_tags(f).orderBy("line", "src").collect()] == [(2, True, False), (2, True, False), (3, True, True), (7, True, False), (8, False, False), (9, True, False)]


def test_stores(spark):
    repo = {
        "package.json": ['{"dependencies": {"pg": "8", "typeorm": "1", "express": "4"}}'],
        "a.js": ['import { createClient } from "redis";', "const c = createClient({ url });", "new Client();"], "b.js": ["x(); createClient(", "  u); new Pool()", "new Pool()", "mongoose", "  .connect(u)"],
        "theme.js": ['localStorage.setItem("theme", t);', 'sessionStorage.setItem("csrf_token", t);', "localStorage.setItem('tokenExpiresAt', t);", 'localStorage.setItem("token", "");', "localStorage.setItem('jwt', null)"],
        "keep.js": ['const API_KEY_SLOT = "acme.key";', "localStorage.setItem(API_KEY_SLOT, k);", "sessionStorage", "  .setItem(`refresh_token`, t); // localStorage.setItem('token', x)", "localStorage.setItem(this.secretSlot, v);", 'localStorage.setItem("secret of ours", v)'],
        "firestore.rules": ["allow write: if true;"], "web.js": ["const db = getFirestore(app);"], "new Pool().txt": ["new Pool()"],
    }
    f = files(spark, {"r": repo})
    assert col(platforms.datastores(f, platforms.frameworks(f)), "kind", "name", "origin", "file", "line") == sorted([
        ("postgres", "pg", "dependency", "package.json", 1), ("unknown", "typeorm", "dependency", "package.json", 1), ("redis", "createClient", "usage", "a.js", 2), ("redis", "new Client", "usage", "a.js", 3), ("unknown", "createClient", "usage", "b.js", 1),
        ("postgres", "new Pool", "usage", "b.js", 2), ("postgres", "new Pool", "usage", "b.js", 3), ("mongodb", "mongoose.connect", "usage", "b.js", 4), ("firestore", "firestore.rules", "config", "firestore.rules", 1), ("firestore", "getFirestore", "usage", "web.js", 1),
        ("browser_storage", "localStorage acme.key", "usage", "keep.js", 2), ("browser_storage", "sessionStorage refresh_token", "usage", "keep.js", 3), ("browser_storage", "localStorage this.secretSlot", "usage", "keep.js", 5), ("browser_storage", "localStorage unnamed key", "usage", "keep.js", 6),
    ], key=repr)
    assert platforms.datastores(f.where("repo = 'x'"), platforms.frameworks(f.where("repo = 'x'"))).count() == 0
