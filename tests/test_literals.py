"""Options of calls, read to any depth, and session cookies from them."""

from wardline.operators import literals

from .test_handlers import files


def cookies(spark, **code):
    rows = literals.session_cookies(files(spark, {"r": {f"{k}.js": v for k, v in code.items()}})).collect()
    return sorted(((r.file, r.line, r.library, r.http_only, r.secure, r.same_site, tuple(r.explicit)) for r in rows), key=repr)


HEAD = 'const session = require("express-session");'


def test_defaults_and_nesting(spark):
    got = cookies(
        spark, a=[HEAD, "app.use(session({ secret: k }));"], b=[HEAD, "app.use(session({ httpOnly: false, cookie: {", "  httpOnly: false, // secure: true", "  nested: { secure: true }, sameSite: 'Lax' } }));"], c=[HEAD, "app.use(session(options));", "app.use(session());"], d=[HEAD, "session({ cookie: settings });", "session({ cookie: { secure: isProd, sameSite: true, httpOnly } })"],
        e=['import flat, { x } from "cookie-session";', "app.use(flat({ httpOnly: false, secure: true, sameSite: 'none', cookie: { secure: false } }));"], f=["app.use(require('express-session')({ cookie: { sameSite: false } }));"], g=["// session({})", "session({ cookie: { secure: true } });"], h=[HEAD, "x.session({}); mysession({}); session({ a: 1"],
        i=[HEAD, f"session({{ secret: '{'x' * 5000})}}', cookie: {{ secure: true }} }});"], j=['import s from "express-session"', "s({ ...base, 'cookie': { 'secure': false } });"],
    )
    unknown = ("unknown", "unknown", "unknown", ("httpOnly", "secure", "sameSite"))
    assert got == sorted([
        ("a.js", 2, "express-session", "true", "false", None, ()), ("b.js", 2, "express-session", "false", "false", "lax", ("httpOnly", "sameSite")), ("c.js", 2, "express-session", *unknown), ("c.js", 3, "express-session", *unknown), ("d.js", 2, "express-session", *unknown),
        ("d.js", 3, "express-session", "unknown", "unknown", "strict", ("httpOnly", "secure", "sameSite")), ("e.js", 2, "cookie-session", "false", "true", "none", ("httpOnly", "secure", "sameSite")), ("f.js", 1, "express-session", "true", "false", None, ("sameSite",)),
        ("i.js", 2, "express-session", "true", "true", None, ("secure",)), ("j.js", 2, "express-session", "true", "false", None, ("secure",)),
    ], key=repr)


def test_option_rows(spark):
    f = files(spark, {"r": {"a.js": ['import kit from "kit"', "kit({ a: { b: [1, 2], c: -1.5, d: `t` }, e, ...rest, f: g(1, 2), 'h-i': null }, 7); kit(\"s\")"]}})
    got = sorted((r.call, r.path, r.kind, r.value) for r in literals.call_options(f, ("kit",)).collect())
    assert got == sorted([(0, "", "object", None), (0, "a", "object", None), (0, "a.b", "other", None), (0, "a.c", "literal", "-1.5"), (0, "a.d", "literal", "t"), (0, "e", "other", None), (0, "*", "other", None), (0, "f", "other", None), (0, "h-i", "literal", "null"), (1, "", "literal", "s")], key=lambda x: x[:2])
    assert literals.call_options(f.where("repo = 'x'"), ("kit",)).count() == 0
