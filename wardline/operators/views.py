"""Ranked, faceted and counted views of findings and of the component graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import scoring as S
from wardline.session import dealt

# Component types by exposure.
EXTERNAL_TYPES, EDGE_TYPES = ("external_service", "auth_provider"), ("actor", "frontend")


def facet_filter(df: DataFrame, selection: dict[str, list]) -> DataFrame:
    """Any value within a facet, all facets together; an empty facet does not constrain. Array columns match by overlap."""
    arrays = {f.name for f in df.schema if f.dataType.typeName() == "array"}
    tests = [F.arrays_overlap(c, F.array(*map(F.lit, values))) if c in arrays else F.col(c).isin(*values) for c, values in selection.items() if values]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def toggle(selection: dict[str, list], facet: str, value) -> dict[str, list]:
    """The selection with the value in if it was out, and out if it was in."""
    have = selection.get(facet, [])
    return selection | {facet: [v for v in have if v != value] if value in have else [*have, value]}


def contains(columns: list[str], needle: str) -> Column:
    """Trimmed and case-insensitive; an empty needle matches all."""
    return F.lower(F.concat_ws("\n", *columns)).contains(needle.strip().lower())


def facet_options(df: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    """Distinct values in use, in their fixed order."""
    value = F.explode(column) if df.schema[column].dataType.typeName() == "array" else F.col(column)
    return df.select(value.alias("value")).distinct().select("value", S.rank(F.col("value"), order).alias("rank"))


def pivot_counts(df: DataFrame, group: str, column: str, values: tuple[str, ...]) -> DataFrame:
    """One count for each listed value, zero where there is none, in one pass."""
    return df.groupBy(group).agg(*(F.count(F.when(F.col(column) == v, 1)).alias(f"n_{v.lower()}") for v in values))


def ranked(df: DataFrame) -> DataFrame:
    """Place by priority, risk, confidence, id."""
    return df.orderBy(S.rank(F.col("priority"), S.PRIORITIES), F.desc(F.col("impact") * F.col("likelihood")), F.desc("milli"), "threat_id")


def fix_now(df: DataFrame, most: int = 5) -> DataFrame:
    return df.where("priority = 'fix_now'").orderBy(S.rank(F.col("severity"), S.SEVERITIES), F.desc("milli"), "threat_id").limit(most)


def node_stats(components: DataFrame, threats: DataFrame) -> DataFrame:
    """components (component_id) with threat_count and max_severity, null where there is none. threats: component_ids, severity."""
    stats = (
        threats.select(F.explode("component_ids").alias("component_id"), "severity").groupBy("component_id")
        .agg(F.count("*").alias("threat_count"), F.min(S.rank(F.col("severity"), S.SEVERITIES)).alias("r"))
    )
    names = F.array(*map(F.lit, S.SEVERITIES))
    return components.join(stats, "component_id", "left").select(*components.columns, F.coalesce("threat_count", F.lit(0)).alias("threat_count"), F.get(names, F.col("r")).alias("max_severity"))


def hidden_reason(hidden: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The most frequent reason, ties to the most basic, with the number of hidden findings."""
    return hidden.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), S.rank(F.col("reason"), order)).limit(1)


def exposure(components: DataFrame, flows: DataFrame) -> DataFrame:
    """components (id, type) with exposure: external and edge by type, edge where an actor sends to it, else internal."""
    actors = components.where("type = 'actor'").select(F.col("id").alias("source"))
    hit = flows.join(actors, "source", "left_semi").select(F.col("target").alias("id")).distinct().withColumn("__hit", F.lit(True))
    return components.join(hit, "id", "left").select(
        *components.columns, F.when(F.col("type").isin(*EXTERNAL_TYPES), "external").when(F.col("type").isin(*EDGE_TYPES) | F.col("__hit"), "edge").otherwise("internal").alias("exposure")
    )


def neighbours(components: DataFrame, flows: DataFrame, types: tuple[str, ...] = EXTERNAL_TYPES) -> DataFrame:
    """Ids of components of the types and of all that a flow joins to them."""
    core = components.where(F.col("type").isin(*types)).select("id")
    out = flows.join(core, flows.source == core.id, "left_semi").select(F.col("target").alias("id"))
    back = flows.join(core, flows.target == core.id, "left_semi").select(F.col("source").alias("id"))
    return core.unionByName(out).unionByName(back).distinct()


def edges_among(flows: DataFrame, shown: DataFrame) -> DataFrame:
    """Flows with both ends shown."""
    return flows.join(shown.select(F.col("id").alias("source")), "source", "left_semi").join(shown.select(F.col("id").alias("target")), "target", "left_semi").select(*flows.columns)


def diagram_view(components: DataFrame, flows: DataFrame, threats: DataFrame, view: str) -> tuple[DataFrame, DataFrame]:
    """Shown component ids and flows. threats: component_ids, owasp, stride (arrays); flows: source, target, data_class, crosses."""
    if view == "identity":
        by_type = components.where("type = 'auth_provider'").select("id")
        by_threat = threats.where(F.arrays_overlap("owasp", F.array(F.lit("A01:2025"), F.lit("A07:2025"))) | F.arrays_overlap("stride", F.array(F.lit("S"), F.lit("E")))).select(F.explode("component_ids").alias("id"))
        shown = by_type.unionByName(by_threat).distinct()
        return shown, edges_among(flows, shown)
    if view == "data_flows":
        edges = flows.where(F.col("data_class").isin("sensitive", "credential") | F.col("crosses"))
        return edges.select(F.explode(F.array("source", "target")).alias("id")).distinct(), edges
    if view == "external":
        shown = neighbours(components, flows)
        return shown, edges_among(flows, shown)
    return components.select("id"), flows


def reverse_edges(flows: DataFrame) -> DataFrame:
    """flows (pos, source, target) with reverse: an earlier flow runs the other way. Only the first flow of each
    direction is joined, so parallel flows do not multiply."""
    first = flows.groupBy(F.col("source").alias("__t"), F.col("target").alias("__s")).agg(F.min("pos").alias("__first"))
    return flows.join(first, (flows.source == first["__s"]) & (flows.target == first["__t"]), "left").select(*flows.columns, F.coalesce(F.col("__first") < F.col("pos"), F.lit(False)).alias("reverse"))


def first_boundary(members: DataFrame) -> DataFrame:
    """(component_id, boundary_id, first): each membership, and whether it is the component's first by pos."""
    w = Window.partitionBy("component_id").orderBy("pos", "boundary_id")
    return members.withColumn("first", F.row_number().over(w) == 1)


def gap_evidence_last(evidence: DataFrame) -> DataFrame:
    """Display order of a finding's evidence: gaps last, else as cited."""
    w = Window.partitionBy("threat_id").orderBy(F.coalesce(F.col("rule_id").startswith("gap:"), F.lit(False)), "pos")
    return evidence.withColumn("place", F.row_number().over(w))


def integrity_issues(threats: DataFrame, components: DataFrame, evidence: DataFrame, flows: DataFrame) -> DataFrame:
    """(path, issue): every reference that does not resolve, findings without support, and repeated ids."""
    def dangling(rows: DataFrame, owner: str, column: str, known: DataFrame, key: str) -> DataFrame:
        refs = rows.select(F.col(owner).alias("o"), F.posexplode(column).alias("i", "ref"))
        return refs.join(known.select(F.col(key).alias("ref")).distinct(), "ref", "left_anti").select(F.format_string(f"threats.%s.{column}[%d]", "o", "i").alias("path"), F.concat(F.lit("unknown id "), "ref").alias("issue"))

    def repeated(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.format_string(f"{name}.%s", key).alias("path"), F.lit("repeated id").alias("issue"))

    ends = flows.select(F.col("id").alias("o"), F.explode(F.create_map(F.lit("source"), F.col("source"), F.lit("target"), F.col("target"))).alias("side", "ref"))
    loose = ends.join(components.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti").select(F.format_string("flows.%s.%s", "o", "side").alias("path"), F.concat(F.lit("unknown id "), "ref").alias("issue"))
    bare = threats.where((F.size("evidence_ids") <= 0) & (F.coalesce(F.size("assumption_list"), F.lit(0)) <= 0)).select(F.format_string("threats.%s", "threat_id").alias("path"), F.lit("neither evidence nor assumption").alias("issue"))
    parts = [dangling(threats, "threat_id", "component_ids", components, "id"), dangling(threats, "threat_id", "evidence_ids", evidence, "id"), loose, bare, repeated(threats, "threat_id", "threats"), repeated(components, "id", "components"), repeated(evidence, "id", "evidence")]
    return reduce(DataFrame.unionByName, parts)


def cards(threats: DataFrame, components: DataFrame, evidence: DataFrame) -> DataFrame:
    """Card rows: component names (the id where unknown) and evidence places in cited order, confidence in per cent."""
    from wardline.functions.text import location

    named = (
        threats.select("threat_id", F.posexplode("component_ids").alias("i", "cid")).join(components.select(F.col("id").alias("cid"), "name"), "cid", "left")
        .groupBy("threat_id").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("name", "cid").alias("name")))).alias("n"))
    )
    placed = (
        threats.select("threat_id", F.posexplode("evidence_ids").alias("i", "eid")).join(dealt(evidence.select(F.col("id").alias("eid"), "file", "line_start", "line_end")), "eid")
        .groupBy("threat_id").agg(F.array_sort(F.collect_list(F.struct("i", location(F.col("file"), F.col("line_start"), F.col("line_end")).alias("place")))).alias("p"))
    )
    return threats.join(dealt(named), "threat_id", "left").join(dealt(placed), "threat_id", "left").select(
        "threat_id", "title", F.transform("n", lambda x: x["name"]).alias("components"), F.transform("p", lambda x: x["place"]).alias("places"), F.floor(F.col("milli") / 10 + 0.5).cast("int").alias("confidence_percent")
    )
