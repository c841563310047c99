"""Versions as sortable columns, range membership, and CVSS v3 base scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the CVSS v3 specification.
ATTACK_VECTOR = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
ATTACK_COMPLEXITY = {"L": 0.77, "H": 0.44}
USER_INTERACTION = {"N": 0.85, "R": 0.62}
IMPACT = {"H": 0.56, "L": 0.22, "N": 0.0}
PRIVILEGES = {False: {"N": 0.85, "L": 0.62, "H": 0.27}, True: {"N": 0.85, "L": 0.68, "H": 0.5}}
LABEL_SCORE = {"CRITICAL": 9.5, "HIGH": 8.0, "MEDIUM": 5.5, "LOW": 2.5}

_VERSION = r"^v?(\d{1,15})(?:\.(\d{1,15}))?(?:\.(\d{1,15}))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\z"


def version_key(text: Column) -> Column:
    """A struct that sorts as versions do; null where the text is no version.

    Fields: core numbers, whether it is a release, and the identifiers before a release. An identifier is
    (is text, length of its number, itself), so numbers sort by value and before texts, and a list sorts
    before those that it begins.
    """
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, _VERSION, i)
    number = lambda i: F.when(part(i) == "", F.lit(0).cast("bigint")).otherwise(F.expr("1") * F.try_to_number(part(i), F.lit("999999999999999")).cast("bigint"))
    plain = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    pre = F.when(part(4) == "", F.array().cast("array<struct<text: boolean, size: int, id: string>>")).otherwise(
        F.transform(
            F.split(part(4), r"\."),
            lambda x: F.struct((~x.rlike(r"^\d+\z")).alias("text"), F.when(x.rlike(r"^\d+\z"), F.length(plain(x))).otherwise(0).alias("size"), F.when(x.rlike(r"^\d+\z"), plain(x)).otherwise(x).alias("id")),
        )
    )
    return F.when(t.rlike(_VERSION), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (part(4) == "").alias("release"), pre.alias("pre")))


def is_full_version(text: Column) -> Column:
    return F.trim(text).rlike(r"^v?\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?\z")


def is_registry_range(spec: Column) -> Column:
    return ~F.trim(spec).rlike(r"(?i)^(?:workspace:|file:|link:|portal:|git[+:]|github:|gitlab:|bitbucket:|https?:|npm:|\.{0,2}/|~/)")


def in_range(version: Column, introduced: Column, fixed: Column, last_affected: Column) -> Column:
    """Keys: introduced <= version, and version < fixed or <= last_affected, or no end. A null start is the first
    version. A version that cannot be read lies below all others."""
    started = introduced.isNull() | F.coalesce(version >= introduced, F.lit(False))
    return started & F.when(fixed.isNotNull(), F.coalesce(version < fixed, F.lit(True))).when(last_affected.isNotNull(), F.coalesce(version <= last_affected, F.lit(True))).otherwise(True)


def _weight(value: Column, table: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), value)


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once: an expression that is used often would be copied each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cvss_score(vector: Column) -> Column:
    """Base score of a v3.0 or v3.1 vector; null for anything else."""
    v = F.trim(vector)
    metrics = F.str_to_map(F.regexp_replace(v, r"^CVSS:3\.[01]/", ""), F.lit("/"), F.lit(":"))

    def weights(m: Column) -> Column:
        of = lambda name, table: _weight(F.try_element_at(m, F.lit(name)), table)
        changed = F.try_element_at(m, F.lit("S"))
        privileges = F.when(changed == "C", of("PR", PRIVILEGES[True])).when(changed == "U", of("PR", PRIVILEGES[False]))
        iss = 1 - (1 - of("C", IMPACT)) * (1 - of("I", IMPACT)) * (1 - of("A", IMPACT))
        exploit = 8.22 * of("AV", ATTACK_VECTOR) * of("AC", ATTACK_COMPLEXITY) * privileges * of("UI", USER_INTERACTION)
        return F.struct((changed == "C").alias("changed"), iss.alias("iss"), exploit.alias("exploit"))

    def raw(w: Column) -> Column:
        impact = F.when(w["changed"], 7.52 * (w["iss"] - 0.029) - 3.25 * F.pow(w["iss"] - 0.02, F.lit(15))).otherwise(6.42 * w["iss"])
        return F.struct(impact.alias("impact"), w["exploit"].alias("exploit"), w["changed"].alias("changed"))

    def base(x: Column) -> Column:
        whole = x["impact"] + x["exploit"]
        return F.when(x["impact"] <= 0, F.when(x["exploit"].isNotNull(), 0.0)).otherwise(F.least(F.when(x["changed"], 1.08 * whole).otherwise(whole), F.when(whole.isNotNull(), F.lit(10.0))))

    def round_up(r: Column) -> Column:
        scaled = F.floor(r * 100000 + 0.5)
        return F.when(r.isNull(), r).when(scaled % 10000 == 0, scaled / 100000).otherwise((F.floor(scaled / 10000) + 1) / 10)

    score = _let(_let(_let(_let(metrics, weights), raw), base), round_up)
    return F.when(v.rlike(r"^CVSS:3\.[01](/|\z)"), score)


def severity_label(score: Column) -> Column:
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score > 0, "LOW")


def label_from_text(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.when(t == "MODERATE", "MEDIUM").when(t.isin(*LABEL_SCORE), t)


def severity_rank(score: Column, label: Column) -> Column:
    return F.coalesce(score, *(F.when(label == k, F.lit(v)) for k, v in LABEL_SCORE.items()), F.lit(0.0))
