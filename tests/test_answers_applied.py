"""Answers against a model written down by hand."""

from pyspark.sql import functions as F

from wardline.operators import answers as A

THREAT = "threat_id string, impact int, likelihood int, cwe array<string>, evidence_ids array<string>, assumption_list array<string>, impact_reason string, likelihood_reason string"
EVIDENCE = "id string, kind string, source string, summary string, rule_id string, file string, line int, certainty double, gap_cwe array<string>"
OPTION = "label: string, impact_delta: int, likelihood_delta: int, reason: string, resolution: string"
QUESTION = f"question_id string, place int, unknown_id string, text string, default_assumption string, otherwise struct<impact_delta: int, likelihood_delta: int, reason: string>, choices array<struct<{OPTION}>>, gap_evidence_id string, threat_ids array<string>, affected_ids array<string>"

YES, NO = ("Yes", 0, -2, "it is there", "clears_gap"), ("No", 1, 1, None, "confirms_gap")


def model(spark):
    threats = spark.createDataFrame([
        ("t1", 3, 3, [], ["gap-1"], [], "i", "l"), ("t2", 4, 5, [], ["gap-2", "code-1"], ["see unknown-b here", "see unknown-bc here"], "i", "l"),
        ("t3", 2, 2, [], ["code-1"], [], "i", "l"), ("t4", 2, 2, [], None, None, "i", "l"), ("t5", 1, 1, [], ["code-1"], ["b", "a"], "i", "l"),
    ], THREAT)
    evidence = spark.createDataFrame([
        ("gap-1", "code", "detector", "s", "gap:csrf_missing", "f", 1, 0.9, []), ("gap-2", "code", "detector", "s", "gap:authz_missing", "f", 2, 0.5, []),
        ("code-1", "code", "detector", "s", "r", "f", 3, None, None), ("loose", "code", "detector", "s", "r", "f", 4, None, None),
    ], EVIDENCE)
    q = lambda id_, place, unknown, gap, to: (id_, place, unknown, f"Is {id_}?", f"assume {id_}", (0, 1, "cautious"), [YES, NO], gap, to, ["t1", "t2"])
    questions = spark.createDataFrame([q("qa", 0, "unknown-a", "gap-1", ["t1"]), q("qb", 1, "unknown-b", "gap-2", ["t2"]), q("qc", 2, "unknown-c", None, ["t3", "t4"]), q("qd", 3, "unknown-d", None, None), q("qe", 4, "u", None, ["t3"])], QUESTION)
    return threats, evidence, questions


def test_answers(spark):
    answers = spark.createDataFrame([("qa", "answered", 0), ("qa", "answered", 0), ("qb", "answered", 1), ("qc", "answered", 0), ("qc", "skipped", None), ("qe", "answered", 7), ("zz", "skipped", None)], "question_id string, status string, option_index int")
    got = A.apply(*model(spark), answers)
    t = {r.threat_id: r for r in got["threats"].collect()}
    assert set(t) == {"t2", "t3", "t4", "t5"}  # t1 rested on the gap that the answer cleared
    assert t["t2"].evidence_ids == ["code-1", "ev-answer-qb", "gap-2"] and t["t2"].assumption_list == ["see unknown-bc here"]
    assert (t["t2"].impact, t["t2"].likelihood, t["t2"].impact_reason) == (5, 5, 'i Answer applied: "No": applied the option\'s effect.')
    assert t["t2"].milli == 350 + 150 + 300 + 100 - 150
    assert (t["t3"].likelihood, t["t3"].assumption_list, t["t3"].likelihood_reason) == (4, ["assume qc", "assume qe"], "l Answer applied: no answer: cautious; no answer: cautious.")
    assert t["t4"].evidence_ids == [] and t["t4"].assumption_list == ["assume qc"] and t["t4"].milli == 0
    assert t["t5"].assumption_list == ["b", "a"] and t["t5"].milli == 50  # not touched
    assert sorted(r.id for r in got["evidence"].collect()) == ["code-1", "ev-answer-qa", "ev-answer-qb", "gap-2"]
    assert got["evidence"].where("id = 'ev-answer-qb'").first().summary == "Developer: Is qb? -> No"
    assert {r.question_id: r.affected_ids for r in got["questions"].collect()} == {k: ["t2"] for k in ("qa", "qb", "qc", "qd", "qe")}
    assert sorted((r.code, r.subject, r.problem) for r in got["notes"].collect()) == [
        ("answer_not_applied", "qc", "conflicting answers"), ("answer_not_applied", "qe", "no such option"), ("internal", "qd", "no known effects"),
        ("internal", "zz", "unknown question"), ("threat_ruled_out_by_answer", "t1", "an answer cleared its only support"),
    ]


def test_reasons_follow_the_turn(spark):
    """Answered questions by id come before those that took a default by place."""
    threats, evidence, questions = model(spark)
    questions = questions.withColumn("threat_ids", F.array(F.lit("t3"))).where("question_id in ('qb', 'qc', 'qe')")
    answers = spark.createDataFrame([("qe", "answered", 1), ("qc", "unsure", None)], "question_id string, status string, option_index int")
    r = A.apply(threats, evidence, questions, answers)["threats"].where("threat_id = 't3'").first()
    assert r.likelihood_reason == 'l Answer applied: no answer: cautious; "No": applied the option\'s effect; no answer: cautious.'
    assert r.impact == 3 and r.likelihood == 5


def test_an_id_that_is_there_keeps_its_row(spark):
    threats, evidence, questions = model(spark)
    evidence = evidence.unionByName(evidence.where("id = 'loose'").withColumn("id", F.lit("ev-answer-qb")).withColumn("summary", F.lit("old")))
    answers = spark.createDataFrame([("qb", "answered", 1)], "question_id string, status string, option_index int")
    assert [r.summary for r in A.apply(threats, evidence, questions, answers)["evidence"].where("id = 'ev-answer-qb'").collect()] == ["old"]


def test_empty_tables(spark):
    threats, evidence, questions = model(spark)
    answers = spark.createDataFrame([], "question_id string, status string, option_index int")
    got = A.apply(threats.limit(0), evidence.limit(0), questions.limit(0), answers)
    assert all(d.count() == 0 for d in got.values())
    kept = A.apply(threats, evidence, questions.limit(0), answers)
    assert kept["threats"].count() == 5 and kept["notes"].count() == 0 and sorted(r.id for r in kept["evidence"].collect()) == ["code-1", "gap-1", "gap-2"]


def test_unknowns_are_whole_tokens(spark):
    d = spark.createDataFrame([("per unknown-csp.", "unknown-csp"), ("per unknown-csp-header", "unknown-csp"), ("xunknown-csp", "unknown-csp"), ("a.b", "a.b"), ("axb", "a.b"), (None, "a")], "text string, u string")
    assert [r.x for r in d.select(A.names_unknown(F.col("text"), F.col("u")).alias("x")).collect()] == [True, False, False, True, False, None]
