"""Drafted threat models: references, duplicates, questions, answers."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.text import tokens
from wardline.operators.windows import components, in_ranges, running_sums, walk
from wardline.session import materialize

SIMILAR, LEAST_VALUE, MOST_QUESTIONS, MOST_UNKNOWNS, BATCH_ELEMENTS = 0.6, 1.5, 3, 12, 2
# Which letters apply to an element, and common words that tell no two titles apart.
STRIDE_OF = {"actor": "SR", "external_service": "SR", "datastore": "TRID", "flow": "TID"}
STRIDE_DEFAULT = "STRIDE"
STOPWORDS = tuple((
    "a an and are as at be been but by can could does for from had has have how if in into is it its may might no not of on or so such than that the their "
    "them then there these they this those to was were which who will with would you your"
).split())


def stride_for(kind: Column, crosses: Column) -> Column:
    """Letters of an element; a flow that crosses a trust boundary can also be spoofed."""
    base = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in STRIDE_OF.items()), F.lit(STRIDE_DEFAULT))
    return F.when((kind == "flow") & F.coalesce(crosses, F.lit(False)), F.concat(F.lit("S"), base)).otherwise(base)


def drop_invented(components_: DataFrame, known_refs: DataFrame, flows: DataFrame, boundaries: DataFrame, unknowns: DataFrame) -> dict[str, DataFrame]:
    """What rests on real references: components (id, refs) with a known ref; flows between kept components, their
    boundary emptied where it is gone; boundaries (id, component_ids) and unknowns (id, component_ids) cut to kept ones."""
    kept_ids = components_.select("id", F.explode("refs").alias("ref")).join(known_refs.select("ref").distinct(), "ref", "left_semi").select("id").distinct()
    kept = components_.join(kept_ids, "id", "left_semi")

    def cut(rows: DataFrame, empty_stays: bool) -> DataFrame:
        each = rows.select(F.col("id").alias("__o"), F.posexplode("component_ids").alias("__i", "__c")).join(kept_ids.withColumnRenamed("id", "__c"), "__c", "left_semi")
        left = each.groupBy("__o").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__c"))), lambda x: x["__c"]).alias("__ids"))
        out = rows.join(left, rows["id"] == left["__o"], "left" if empty_stays else "inner")
        return out.withColumn("component_ids", F.coalesce("__ids", F.array().cast("array<string>"))).select(*rows.columns)

    bounds = cut(boundaries, False)
    ends = flows.join(kept_ids.select(F.col("id").alias("source")), "source", "left_semi").join(kept_ids.select(F.col("id").alias("target")), "target", "left_semi")
    with_bound = ends.join(bounds.select(F.col("id").alias("__b")), F.col("boundary_id") == F.col("__b"), "left").withColumn("boundary_id", F.col("__b")).select(*flows.columns)
    return {"components": kept, "flows": with_bound, "boundaries": bounds, "unknowns": cut(unknowns, True)}


def reference_issues(threats: DataFrame, elements: DataFrame, offered: DataFrame) -> DataFrame:
    """(threat_id, issues) of drafts whose element or evidence ids are not what was offered. threats: threat_id,
    element_ids, evidence_ids, assumptions; elements: element_id, batch (bool); offered: element_id, evidence_id."""
    named = threats.select("threat_id", F.explode("element_ids").alias("element_id"))
    unknown = named.join(elements.select("element_id"), "element_id", "left_anti").select("threat_id", F.concat(F.lit("unknown element "), "element_id").alias("issue"))
    in_batch = named.join(elements.where("batch"), "element_id", "left_semi").select("threat_id").distinct()
    outside = threats.join(in_batch, "threat_id", "left_anti").select("threat_id", F.lit("no element of its batch").alias("issue"))
    cited = threats.select("threat_id", F.explode("evidence_ids").alias("evidence_id"))
    allowed = named.join(offered, "element_id").select("threat_id", "evidence_id").distinct()
    foreign = cited.join(allowed, ["threat_id", "evidence_id"], "left_anti").select("threat_id", F.concat(F.lit("evidence not offered "), "evidence_id").alias("issue"))
    bare = threats.where((F.size("evidence_ids") <= 0) & (F.size("assumptions") <= 0)).select("threat_id", F.lit("no support").alias("issue"))
    return unknown.unionByName(outside).unionByName(foreign).unionByName(bare).groupBy("threat_id").agg(F.array_sort(F.collect_set("issue")).alias("issues"))


def is_placeholder(assumption: Column) -> Column:
    return F.trim(F.lower(assumption)).rlike(r"^(?:n/?a|none|unknown|tbd|todo|assumed|-+|\.+)?\.?\z") | (F.size(F.filter(F.split(F.trim(assumption), r"\s+"), lambda w: w != "")) < 2)


def duplicate_groups(threats: DataFrame, flow_ends: DataFrame) -> DataFrame:
    """(threat_id, group) of drafts that say the same: titles with token Jaccard of 0.6 or more, related by a shared
    component, a shared flow, or a component at the end of the other's flow. threats: threat_id, title, component_ids,
    flow_ids; flow_ends: flow_id, component_id. Pairs meet only in a shared block; groups are transitive."""
    by_component = threats.select("threat_id", F.explode("component_ids").alias("c")).select("threat_id", F.concat(F.lit("c:"), "c").alias("block"))
    flows = threats.select("threat_id", F.explode("flow_ids").alias("flow_id"))
    by_flow = flows.select("threat_id", F.concat(F.lit("f:"), "flow_id").alias("block"))
    by_end = flows.join(flow_ends, "flow_id").select("threat_id", F.concat(F.lit("c:"), "component_id").alias("block"))
    blocks = by_component.unionByName(by_flow).unionByName(by_end).distinct()
    words = threats.select("threat_id", tokens(F.col("title"), STOPWORDS).alias("w")).where(F.size("w") > 0)
    # a word is part of the block, so two titles meet only where they share one of their kept words
    each = blocks.join(words, "threat_id").select("threat_id", "block", F.size("w").alias("n"), "w", F.explode("w").alias("t"))
    often = each.groupBy("block", "t").agg(F.count("*").alias("c"))
    rank = F.row_number().over(Window.partitionBy("threat_id", "block").orderBy("c", "t"))
    kept = each.join(often, ["block", "t"]).withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.lit(SIMILAR) * F.col("n")) + 1).select("block", "t", "threat_id", "w")
    other = kept.select("block", "t", F.col("threat_id").alias("other"), F.col("w").alias("v"))
    same = F.size(F.array_intersect("w", "v"))
    pairs = kept.join(other, ["block", "t"]).where((F.col("threat_id") < F.col("other")) & (same / (F.size("w") + F.size("v") - same) >= SIMILAR)).select(F.col("threat_id").alias("a"), F.col("other").alias("b")).distinct()
    roots = components(pairs)
    return threats.select("threat_id").join(roots.select(F.col("node").alias("threat_id"), "root"), "threat_id", "left").select("threat_id", F.coalesce("root", "threat_id").alias("group"))


def merge_groups(threats: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each group: arrays united and sorted, the highest impact and likelihood each with its own reason,
    title and scenario of the smallest id."""
    d = threats.join(groups, "threat_id")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    arrays = [c for c in ("component_ids", "flow_ids", "evidence_ids", "assumptions", "stride", "owasp", "cwe") if c in threats.columns]
    top = lambda v, r: (F.max(v).alias(v), F.max_by(r, F.struct(v, (-F.xxhash64(r)).alias("o"))).alias(r))
    extra = [x for v, r in (("impact", "impact_reason"), ("likelihood", "likelihood_reason")) if r in threats.columns for x in top(v, r)]
    return d.groupBy("group").agg(F.min("threat_id").alias("threat_id"), F.min_by("title", "threat_id").alias("title"), *(union(c) for c in arrays), *extra).drop("group")


def numbered(threats: DataFrame) -> DataFrame:
    """threats of a run with dense ids in canonical order: first element, first letter, whole row as JSON."""
    letter = F.instr(F.lit("STRIDE"), F.get("stride", F.lit(0)))
    w = Window.partitionBy("run_id").orderBy(F.get("component_ids", F.lit(0)), letter, F.to_json(F.struct(*sorted(c for c in threats.columns if c != "run_id"))))
    return threats.withColumn("id", F.concat(F.lit("threat-"), F.row_number().over(w).cast("string")))


def gap_unknowns(gaps: DataFrame, unknowns: DataFrame, controls: DataFrame, most: int = MOST_UNKNOWNS) -> DataFrame:
    """Unknowns of a run: the model's that do not name a gap's control on a shared component, and one for each gap below
    0.7; certainty, then reach, then id, at most ``most``. gaps: run_id, gap_id, kind, certainty, component_ids;
    unknowns: run_id, id, description, component_ids; controls: kind, control."""
    weak = gaps.where("certainty < 0.7").join(controls.select("kind", "control"), "kind")
    own = weak.select("run_id", F.concat(F.lit("unknown-"), "gap_id").alias("id"), F.concat(F.lit("Whether "), "control", F.lit(" is in place")).alias("description"), "component_ids", "certainty")
    each = lambda d, *keep: d.select("run_id", *keep, F.explode("component_ids").alias("c"))
    named = each(unknowns, "id", "description").join(each(weak, "control"), ["run_id", "c"]).where(F.lower("description").contains(F.lower("control"))).select("run_id", "id").distinct()
    rest = unknowns.join(named, ["run_id", "id"], "left_anti").select("run_id", "id", "description", "component_ids", F.lit(None).cast("double").alias("certainty"))
    w = Window.partitionBy("run_id").orderBy(F.col("certainty").asc_nulls_last(), F.desc(F.size("component_ids")), "id")
    return own.unionByName(rest).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def question_candidates(unknowns: DataFrame, threats: DataFrame, most: int = MOST_QUESTIONS) -> DataFrame:
    """(run_id, unknown_id, n, value, place, reason): threats that depend on an unknown or touch its components make its
    value; below 1.5 or beyond three it is skipped, and the reason says so. threats: run_id, threat_id, weight,
    confidence, component_ids, unknown_ids."""
    direct = threats.select("run_id", "threat_id", F.explode("unknown_ids").alias("unknown_id"))
    touch = threats.select("run_id", "threat_id", F.explode("component_ids").alias("c")).join(unknowns.select("run_id", F.col("id").alias("unknown_id"), F.explode("component_ids").alias("c")), ["run_id", "c"]).select("run_id", "threat_id", "unknown_id")
    hit = direct.unionByName(touch).distinct().join(threats.select("run_id", "threat_id", "weight", "confidence"), ["run_id", "threat_id"]).join(unknowns.select("run_id", F.col("id").alias("unknown_id")), ["run_id", "unknown_id"], "left_semi")
    v = hit.groupBy("run_id", "unknown_id").agg(F.count("*").alias("n"), (F.max("weight") * (1 - F.avg("confidence")) * F.log2(F.lit(1) + F.count("*"))).alias("value"))
    w = Window.partitionBy("run_id", F.col("value") >= LEAST_VALUE).orderBy(F.desc("value"), "unknown_id")
    d = v.withColumn("place", F.row_number().over(w))
    return d.withColumn("reason", F.when(F.col("value") < LEAST_VALUE, "below the least value").when(F.col("place") > most, "beyond the number of questions"))


def cautious_default(options: DataFrame) -> DataFrame:
    """(question_id, option_index): the option that lowers likelihood and impact least, never one safer than doing
    nothing; the first among equals. options: question_id, option_index, impact_delta, likelihood_delta."""
    d = options.where((F.col("impact_delta") >= 0) & (F.col("likelihood_delta") >= 0))
    w = Window.partitionBy("question_id").orderBy(F.col("impact_delta") + F.col("likelihood_delta"), "option_index")
    return d.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("question_id", "option_index")


def apply_answers(threats: DataFrame, effects: DataFrame) -> DataFrame:
    """threats with impact and likelihood moved by the sum of their effects within 1..5 and assumptions that an answer
    settled taken away; findings left without evidence and assumptions go. Effects of one question that pull one finding
    both ways are dropped as a conflict. effects: threat_id, question_id, impact_delta, likelihood_delta, settles (array)."""
    w = Window.partitionBy("threat_id", "question_id")
    sign = F.signum(F.col("impact_delta") + F.col("likelihood_delta"))
    clean = effects.withColumn("__hi", F.max(sign).over(w)).withColumn("__lo", F.min(sign).over(w)).where("not (__hi > 0 and __lo < 0)")
    sums = clean.groupBy("threat_id").agg(F.sum("impact_delta").alias("__i"), F.sum("likelihood_delta").alias("__l"), F.flatten(F.collect_list("settles")).alias("__s"))
    d = threats.join(sums, "threat_id", "left")
    move = lambda c, by: F.greatest(F.lit(1), F.least(F.lit(5), F.col(c) + F.coalesce(by, F.lit(0)))).cast("int")
    out = d.withColumns({"impact": move("impact", "__i"), "likelihood": move("likelihood", "__l"), "assumption_list": F.array_except("assumption_list", F.coalesce("__s", F.array().cast("array<string>")))})
    return out.where((F.size("evidence_ids") > 0) | (F.size("assumption_list") > 0)).select(*threats.columns)


def match_answer(answers: DataFrame, options: DataFrame) -> DataFrame:
    """(question_id, option_index) of answers (question_id, text) that name exactly one option (question_id,
    option_index, label); skip and unsure are never options."""
    a = answers.where(~F.trim(F.lower("text")).isin("skip", "unsure"))
    hit = a.join(options, "question_id").where(F.trim(F.lower("text")).contains(F.trim(F.lower("label"))) | (F.trim("text") == (F.col("option_index") + 1).cast("string")))
    return hit.groupBy("question_id").agg(F.count("*").alias("n"), F.min("option_index").alias("option_index")).where("n = 1").drop("n")


def batches(components_: DataFrame, flows: DataFrame, size: int = BATCH_ELEMENTS) -> DataFrame:
    """(run_id, element_id, batch): every component and flow in one batch of at most ``size`` elements.

    A unit is a component, then the flows it is the source of, by id; flows without a known source are units of their own, after all
    others. Units go by id, whole, into the first batch with room, else a new one; a unit larger than a batch is cut into
    chunks, of which the last may leave room. Elements of a unit are numbered by ranges; first fit depends on all before, so the
    sizes of a run's chunks, nothing else, are walked with the open batches as carried state, by the room they have.
    components_: run_id, component_id; flows: run_id, flow_id, source. Repeated ids count once; empty tables give an empty one."""
    if size < 1:
        raise ValueError("a batch holds at least one element")
    known = components_.select("run_id", "component_id").distinct()
    f = flows.groupBy("run_id", F.col("flow_id").alias("element_id")).agg(F.min("source").alias("source"))
    owned = f.join(known.select("run_id", F.col("component_id").alias("source")), ["run_id", "source"], "left_semi").select("run_id", F.lit(0).alias("late"), F.col("source").alias("unit"), F.lit(1).alias("behind"), "element_id")
    loose = f.join(known.select("run_id", F.col("component_id").alias("source")), ["run_id", "source"], "left_anti").select("run_id", F.lit(1).alias("late"), F.col("element_id").alias("unit"), F.lit(0).alias("behind"), "element_id")
    every = known.select("run_id", F.lit(0).alias("late"), F.col("component_id").alias("unit"), F.lit(0).alias("behind"), F.col("component_id").alias("element_id")).unionByName(owned).unionByName(loose)
    order = ["behind", "element_id"]
    placed = running_sums(in_ranges(every, ["run_id", "late", "unit"], order, "units"), order, {"n": F.lit(1).cast("bigint")})
    chunked = materialize(placed.select("run_id", "late", "unit", F.floor(F.col("n_before") / size).alias("chunk"), "element_id"), "chunks")
    sizes = chunked.groupBy("run_id", "late", "unit", "chunk").agg(F.count("*").cast("int").alias("n"))

    def step(state: tuple[int, dict[int, list[int]]], n: int) -> tuple[tuple[int, dict[int, list[int]]], int]:
        used, open_ = state
        rooms = [r for r, held in open_.items() if r >= n and held]
        if rooms:
            room = min(rooms, key=lambda r: open_[r][0])
            at = heapq.heappop(open_[room])
        else:
            room, at, used = size, used, used + 1
        if room > n:
            heapq.heappush(open_.setdefault(room - n, []), at)
        return (used, open_), at

    packed = walk(sizes, ["run_id"], ["late", "unit", "chunk"], ["n"], lambda: (0, {}), step, "batch", "int").select("run_id", "late", "unit", "chunk", "batch")
    return chunked.join(packed, ["run_id", "late", "unit", "chunk"]).select("run_id", "element_id", "batch")


def limitation_notes(notes: DataFrame, most: int = 5) -> DataFrame:
    """(run_id, code, n, subjects): different subjects of a code in the order first seen, at most ``most`` listed."""
    first = notes.groupBy("run_id", "code", "subject").agg(F.min("pos").alias("pos"))
    return first.groupBy("run_id", "code").agg(F.count("subject").alias("n"), F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("subject").isNotNull(), F.struct("pos", "subject")))), lambda x: x["subject"]), 1, most).alias("subjects"))


def resolve_refs(refs: DataFrame, evidence: DataFrame, routes: DataFrame, files: DataFrame) -> DataFrame:
    """refs (ref) with resolved: an evidence id, a route id or a path. One equi-join with the three together."""
    known = evidence.select(F.col("id").alias("ref")).unionByName(routes.select(F.col("route_id").alias("ref"))).unionByName(files.select(F.col("path").alias("ref"))).distinct().withColumn("__k", F.lit(True))
    return refs.join(known, "ref", "left").select(*refs.columns, F.coalesce("__k", F.lit(False)).alias("resolved"))


def evidence_of_facts(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """facts (fact_id, file, line, prefix) with the first evidence at their place whose summary begins with the prefix.

    Neither facts nor evidence of a hot place meet one by one: what evidence says there, once for each length of a prefix asked
    there, is cut to that length and joined by equality to the prefixes."""
    place = ["file", "line"]
    asked = facts.select(*place, "prefix").where("prefix is not null").distinct()
    said = evidence.groupBy(*place, "summary").agg(F.min("id").alias("id"))
    lengths = asked.select(*place, F.length("prefix").alias("__n")).distinct()
    cut = said.join(lengths, place).where(F.length("summary") >= F.col("__n")).select(*place, F.expr("left(summary, __n)").alias("prefix"), "id")
    first = cut.groupBy(*place, "prefix").agg(F.min("id").alias("__id"))
    hit = facts.select("fact_id", *place, "prefix").join(first, [*place, "prefix"]).groupBy("fact_id").agg(F.min("__id").alias("evidence_id"))
    return facts.join(hit, "fact_id", "left")


def bind_facts(groups: DataFrame, components_: DataFrame) -> DataFrame:
    """(group_id, component_id) of fact groups (group_id, types, evidence_ids, files) and components (component_id, type,
    evidence_ids, files) of a compatible type that share evidence or a file, where each has the other alone; a name in
    common (group_name, name) breaks ties, and what stays ambiguous is left out."""
    def shared(column: str) -> DataFrame:
        g = groups.select("group_id", "types", F.explode(column).alias("k"))
        c = components_.select("component_id", "type", F.explode(column).alias("k"))
        return g.join(c, "k").where(F.array_contains("types", F.col("type"))).select("group_id", "component_id")

    pairs = shared("evidence_ids").unionByName(shared("files")).distinct()
    named = pairs.join(groups.select("group_id", "group_name"), "group_id").join(components_.select("component_id", "name"), "component_id").withColumn("same", F.lower("group_name") == F.lower("name"))
    by_group, by_component = Window.partitionBy("group_id"), Window.partitionBy("component_id")
    best = named.withColumn("__any", F.bool_or("same").over(by_group)).where(~F.coalesce("__any", F.lit(False)) | F.col("same"))
    alone = best.withColumns({"__a": F.count("*").over(by_group), "__b": F.count("*").over(by_component)})
    return alone.where("__a = 1 and __b = 1").select("group_id", "component_id")


def internal_components(components_: DataFrame, services: DataFrame) -> DataFrame:
    """Components (component_id, service_names) whose every named compose service is known and publishes no port."""
    each = components_.select("component_id", F.explode("service_names").alias("s")).withColumn("s", F.lower("s"))
    known = services.select(F.lower("name").alias("s"), F.size("ports").alias("__n"))
    ok = each.join(known, "s", "left").groupBy("component_id").agg(F.bool_and(F.coalesce(F.col("__n") == 0, F.lit(False))).alias("ok")).where("ok")
    return components_.join(ok.select("component_id"), "component_id", "left_semi")


def fit_for_demo(threats: DataFrame) -> DataFrame:
    """(run_id, fit): a run with a visible finding of each basis."""
    n = lambda b: F.count(F.when((F.col("basis") == b) & (F.col("milli") >= 250), 1))
    return threats.groupBy("run_id").agg(((n("observed") > 0) & (n("inferred") > 0)).alias("fit"))


def level_costs(spark) -> DataFrame:
    """Estimated dollars of a run by level; fixed values."""
    return spark.createDataFrame([(0, 0.3, 0.6), (1, 1.0, 1.5), (2, 3.0, 4.0), (3, 3.5, 5.0), (4, 4.0, 6.0)], "level int, low double, high double")


def cap_batches(batched: DataFrame, flows: DataFrame, gap_counts: DataFrame, most: int) -> DataFrame:
    """batched (run_id, batch, element_id) with kept: the ``most`` batches of a run with the most gaps, earlier ones among
    equals. A component weighs its gaps (run_id, component_id, gaps), a flow (run_id, flow_id, source) its own or those
    of its source."""
    w = gap_counts
    own = batched.join(w.select("run_id", F.col("component_id").alias("element_id"), F.col("gaps").alias("__own")), ["run_id", "element_id"], "left")
    ends = own.join(flows.select("run_id", F.col("flow_id").alias("element_id"), "source"), ["run_id", "element_id"], "left")
    d = ends.join(w.select("run_id", F.col("component_id").alias("source"), F.col("gaps").alias("__end")), ["run_id", "source"], "left")
    sums = d.groupBy("run_id", "batch").agg(F.sum(F.coalesce("__own", "__end", F.lit(0))).alias("score"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "batch"))
    return batched.join(sums.select("run_id", "batch", (place <= most).alias("kept")), ["run_id", "batch"])


#: What a model may not supply: scores and what follows from them.
SCORED_COLUMNS = ("milli", "confidence", "confidence_label", "basis", "severity", "priority", "visible")


def drafts(threats: DataFrame) -> DataFrame:
    """Findings as a model may draft them: without scored columns."""
    return threats.drop(*SCORED_COLUMNS)


def gap_evidence(gaps: DataFrame, evidence: DataFrame) -> DataFrame:
    """gaps (run_id, gap_id) with the evidence item that stands for each: ev-<gap id>."""
    return gaps.withColumn("id", F.concat(F.lit("ev-"), "gap_id")).join(evidence, ["run_id", "id"])
