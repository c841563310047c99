"""What answers to questions do to a model: evidence cited or taken away, assumptions settled or made, scores moved, notes.

threats: threat_id, impact, likelihood, cwe, evidence_ids, assumption_list, impact_reason, likelihood_reason. evidence: id, kind, source,
summary, rule_id, file, line, certainty, gap_cwe. questions: question_id, place, unknown_id, text, default_assumption, otherwise
(struct of impact_delta, likelihood_delta, reason: what no answer does), choices (array of structs label, impact_delta,
likelihood_delta, reason, resolution), gap_evidence_id (null: no gap), threat_ids (null: effects are not known),
affected_ids. answers: question_id, status, option_index.

Answers meet questions by id, and what they do meets findings by id; findings that no question names are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators import scoring

# Ids of answers, what stands for a reason, the ends of a scale.
PREFIX, NO_REASON, LOW, HIGH = "ev-answer-", "applied the option's effect", 1, 5


def names_unknown(text: Column, unknown: Column) -> Column:
    """Whether a text names an id as a whole token; an id is no prefix of a longer one."""
    plain = F.regexp_replace(unknown, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.rlike(text, F.concat(F.lit(r"(?<![\w-])"), plain, F.lit(r"(?![\w-])")))


def resolve(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """questions with outcome (applied, default, or null where nothing is done), choice, turn (the order in which outcomes are
    reported: answered ones by id, then the rest by place) and problems (structs of code, problem).

    Copies of one answer are one answer. Different answers to a question are a conflict, and it is treated as if it had
    none. A question without a usable answer takes its default. Answers to questions that are not there come as rows
    without a place."""
    given = answers.groupBy("question_id").agg(
        F.count_distinct(F.struct("status", "option_index")).alias("__n"), F.min("status").alias("__status"), F.min("option_index").alias("__option")
    )
    d = questions.join(given, "question_id", "full_outer")
    known, effects = F.col("place").isNotNull(), F.col("threat_ids").isNotNull()
    one, answered = F.coalesce(F.col("__n") == 1, F.lit(False)), F.coalesce(F.col("__status") == "answered", F.lit(False))
    choice = F.when(one & answered, F.get("choices", F.col("__option")))
    says = ((F.col("__n") > 1, "answer_not_applied", "conflicting answers"), (one & ~known, "internal", "unknown question"), (known & ~effects, "internal", "no known effects"),
            (one & known & effects & answered & F.col("__option").isNull(), "answer_not_applied", "no option chosen"),
            (one & known & effects & answered & F.col("__option").isNotNull() & F.col("__choice").isNull(), "answer_not_applied", "no such option"),
            (F.col("__n").isNull() & effects, "internal", "no answer"))
    problems = F.filter(F.array(*(F.when(test, F.struct(F.lit(code).alias("code"), F.lit(text).alias("problem"))) for test, code, text in says)), lambda x: x.isNotNull())
    return d.withColumn("__choice", choice).select(
        *questions.columns, F.when(known & effects, F.when(F.col("__choice").isNotNull(), "applied").otherwise("default")).alias("outcome"), F.col("__choice").alias("choice"),
        F.struct((~one).alias("late"), F.when(one, F.col("question_id")).alias("id"), "place").alias("turn"), problems.alias("problems"),
    )


def changes(resolved: DataFrame) -> DataFrame:
    """(threat_id, impact_by, likelihood_by, cites, drops, assumes, settles, impact_notes, likelihood_notes): all that outcomes
    do to a finding. An answer that says the control is there takes the gap's evidence away and is not cited."""
    applied = F.col("outcome") == "applied"
    clears = applied & F.coalesce(F.col("choice.resolution") == "clears_gap", F.lit(False))
    part = lambda name: F.when(applied, F.col(f"choice.{name}")).otherwise(F.col(f"otherwise.{name}"))
    by = F.when(applied, F.concat(F.lit('"'), F.col("choice.label"), F.lit('"'))).otherwise("no answer")
    each = resolved.where("outcome is not null").select(
        F.explode("threat_ids").alias("threat_id"), "turn", part("impact_delta").alias("di"), part("likelihood_delta").alias("dl"),
        F.concat(by, F.lit(": "), F.coalesce(part("reason"), F.lit(NO_REASON))).alias("said"), F.when(applied & ~clears, F.concat(F.lit(PREFIX), "question_id")).alias("cite"),
        F.when(clears, F.col("gap_evidence_id")).alias("drop"), F.when(~applied, F.col("default_assumption")).alias("assume"), F.when(applied, F.col("unknown_id")).alias("settle"),
    )
    notes = lambda delta: F.transform(F.array_sort(F.collect_list(F.when(F.col(delta) != 0, F.struct("turn", "said")))), lambda x: x["said"])
    return each.groupBy("threat_id").agg(
        F.sum("di").alias("impact_by"), F.sum("dl").alias("likelihood_by"), *(F.collect_set(c).alias(name) for c, name in (("cite", "cites"), ("drop", "drops"), ("assume", "assumes"), ("settle", "settles"))),
        notes("di").alias("impact_notes"), notes("dl").alias("likelihood_notes"),
    )


def apply(threats: DataFrame, evidence: DataFrame, questions: DataFrame, answers: DataFrame) -> dict[str, DataFrame]:
    """threats as they stand after the answers, scored again; evidence that is still cited or that an answer made; questions
    (question_id, affected_ids without findings that went); notes (code, subject, problem).

    Scores stay within 1 to 5. Assumptions that name a settled unknown go. A finding left without evidence and
    assumptions goes, with a note. An id that evidence has already keeps its row. Scores are a function of a finding and
    what it cites, so those of untouched findings come out as they were. Empty tables give empty ones."""
    resolved = resolve(answers, questions)
    none = F.array().cast("array<string>")
    d = threats.join(changes(resolved), "threat_id", "left")
    touched = F.col("impact_by").isNotNull()
    tidy = lambda xs: F.array_sort(F.array_distinct(xs))
    cited = F.concat(F.array_except(F.coalesce("evidence_ids", none), "drops"), F.col("cites"))
    held = F.filter(F.coalesce("assumption_list", none), lambda a: ~F.exists("settles", lambda u: names_unknown(a, u)))
    move = lambda c: F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.col(c) + F.col(f"{c}_by"))).cast("int")
    noted = lambda c: F.when(F.size(f"{c}_notes") > 0, F.concat(F.col(f"{c}_reason"), F.lit(" Answer applied: "), F.array_join(f"{c}_notes", "; "), F.lit("."))).otherwise(F.col(f"{c}_reason"))
    new = {"evidence_ids": tidy(cited), "assumption_list": tidy(F.concat(held, "assumes")), "impact": move("impact"), "likelihood": move("likelihood"), "impact_reason": noted("impact"), "likelihood_reason": noted("likelihood")}
    d = d.select(*(F.when(touched, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in threats.columns), touched.alias("__touched"))
    bare = F.col("__touched") & (F.size("evidence_ids") == 0) & (F.size("assumption_list") == 0)
    gone, kept = d.where(bare).select("threat_id"), d.where(~bare).drop("__touched")

    made = resolved.where("outcome = 'applied'").select(
        F.concat(F.lit(PREFIX), "question_id").alias("id"), F.lit("developer_answer").alias("kind"), F.lit("developer").alias("source"),
        F.concat(F.lit("Developer: "), "text", F.lit(" -> "), F.col("choice.label")).alias("summary"),
    )
    pool = evidence.unionByName(made.join(evidence.select("id"), "id", "left_anti"), allowMissingColumns=True)
    uses = kept.select("threat_id", F.posexplode("evidence_ids").alias("pos", "id"))
    wanted = uses.select("id").unionByName(made.select("id")).distinct()
    scored = scoring.score(kept.withColumn("assumptions", F.coalesce(F.size("assumption_list"), F.lit(0))), uses.join(pool, "id")).drop("assumptions")

    left = questions.select("question_id", F.posexplode("affected_ids").alias("i", "threat_id")).join(gone, "threat_id", "left_anti")
    left = left.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "threat_id"))), lambda x: x["threat_id"]).alias("affected_ids"))
    asked = questions.select("question_id").join(left, "question_id", "left").select("question_id", F.coalesce("affected_ids", none).alias("affected_ids"))
    notes = resolved.select(F.explode("problems").alias("p"), F.col("question_id").alias("subject")).select("p.code", "subject", "p.problem")
    ruled_out = gone.select(F.lit("threat_ruled_out_by_answer").alias("code"), F.col("threat_id").alias("subject"), F.lit("an answer cleared its only support").alias("problem"))
    return {"threats": scored, "evidence": pool.join(wanted, "id", "left_semi"), "questions": asked, "notes": notes.unionByName(ruled_out)}
