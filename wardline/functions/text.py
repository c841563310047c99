"""Text columns: normal forms, places, guards, tags, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories of the 2021 list in terms of the 2025 list.
OWASP_2021_TO_2025 = {
    "A01:2021": "A01:2025", "A02:2021": "A04:2025", "A03:2021": "A05:2025", "A04:2021": "A06:2025", "A05:2021": "A02:2025",
    "A06:2021": "A03:2025", "A07:2021": "A07:2025", "A08:2021": "A08:2025", "A09:2021": "A09:2025", "A10:2021": "A01:2025",
}


def norm(text: Column) -> Column:
    """Lower case, everything but letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tokens(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Different words of a-z and 0-9, lower-cased, without the stop words."""
    flat = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    words = F.array_distinct(F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " ")))
    return F.array_except(words, F.array(*map(F.lit, stopwords)).cast("array<string>")) if stopwords else words


def one_line(text: Column, most: int) -> Column:
    """White space runs become one space; longer texts end in an ellipsis within the limit."""
    flat = F.trim(F.regexp_replace(text, r"[\s ]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def location(path: Column, start: Column, end: Column) -> Column:
    """path[:a[-b]]; no range where both lines are equal or the end is unknown."""
    return F.when(start.isNull(), path).otherwise(F.concat(path, F.lit(":"), start.cast("string"), F.when(end.isNotNull() & (end != start), F.concat(F.lit("-"), end.cast("string"))).otherwise("")))


def csv_guard(text: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets a quote in front."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.5)


def owasp_codes(tags: Column) -> Column:
    """2025 codes named in an array of tags, in either edition's terms; distinct and sorted. A year is required."""
    # Spark's pattern is case-sensitive unless told; the year tells the editions apart
    found = F.flatten(F.transform(tags, lambda t: F.regexp_extract_all(F.upper(t), F.lit(r"\bA(?:0[1-9]|10):(?:2021|2025)\b"), F.lit(0))))
    table = F.create_map(*(F.lit(x) for kv in OWASP_2021_TO_2025.items() for x in kv))
    return F.array_sort(F.array_distinct(F.transform(found, lambda c: F.coalesce(F.try_element_at(table, c), c))))


def repository(url: Column) -> Column:
    """struct<ok, owner, name, ref, code> of a repository address or owner/name shorthand.

    Refused: over 500 characters, an @, dot-dot segments also in percent form, other hosts, missing parts."""
    text = F.trim(url)
    bare = F.regexp_replace(text, r"^(?i:https?://)?(?i:www\.)?", "")
    full = text.rlike(r"^(?i)(https?://|www\.)|^(?i)github\.com/")
    host_ok = F.lower(bare).startswith("github.com/")
    path = F.regexp_replace(F.when(full, F.regexp_replace(bare, r"^[^/]*/?", "")).otherwise(text), r"[?#].*\z", "")
    parts = F.split(F.regexp_replace(path, r"/+\z", ""), "/")
    owner, name = F.get(parts, F.lit(0)), F.regexp_replace(F.get(parts, F.lit(1)), r"\.git\z", "")
    ref = F.when(F.get(parts, F.lit(2)) == "tree", F.try_url_decode(F.array_join(F.slice(parts, F.lit(4), F.greatest(F.lit(0), F.size(parts) - 3)), "/")))
    code = (
        F.when(text.isNull() | (text == ""), "empty").when(F.length(text) > 500, "too_long")
        .when(text.contains("@") | F.lower(text).contains("%2e") | text.contains(".."), "unsafe")
        .when(full & ~host_ok, "host")
        .when(~F.coalesce(owner.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,38})\z") & name.rlike(r"^[A-Za-z0-9._-]{1,100}\z"), F.lit(False)), "shape")
    )
    ok = code.isNull()
    return F.struct(ok.alias("ok"), F.when(ok, owner).alias("owner"), F.when(ok, name).alias("name"), F.when(ok & (ref != ""), ref).alias("ref"), code.alias("code"))


ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def units(text: Column) -> Column:
    """Length in UTF-16 units, in which limits of web forms are counted: characters beyond the basic plane are two."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(F.length(F.regexp_replace(text, ASTRAL, "  ")))


def cut_units(text: Column, most: int) -> Column:
    """The first units of a text, at most so many; a character of two units is never split, it goes."""
    # each such character gets a second place behind it, which the cut either keeps or parts from it
    doubled = F.regexp_replace(text, f"({ASTRAL})", "$1\uffff")
    whole = F.regexp_replace(F.substring(doubled, 1, most), rf"{ASTRAL}\z", "")
    return F.regexp_replace(whole, f"({ASTRAL})\uffff", "$1")


def uri_component(text: Column) -> Column:
    """Percent form of all but letters, digits and -_.!~*'()."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
