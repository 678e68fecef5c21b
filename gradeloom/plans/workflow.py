"""Whole workflows: from labelled records and rubrics to a model, grades, their evaluation and reports."""

from __future__ import annotations

import html
import json
from collections.abc import Mapping
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import pii, records
from gradeloom.functions.text import normalize_answer
from gradeloom.operators import evaluation, joins, models, structured
from gradeloom.session import cut
from gradeloom.sources.rubrics import Rubric, check_rubrics, exam_table
from gradeloom.sources.tables import write_json, write_text

# Other names of fields.
NAMES = {
    "essay_id": ("essay_id", "record_id", "sample_id", "submission_id", "id"),
    "text": ("answer_text", "text_clean", "response_text", "text", "content", "essay"),
    "exam": ("exam_code", "exam_code_final", "exam_id", "test_code", "de_thi"),
    "split": ("split", "dataset_split"),
    "score": ("score_10", "gold_total", "total", "score"),
    "label": ("score_10", "gold_total", "total"),
    "eligible": ("training_eligible", "train_eligible"),
}
#: Fields that say whether a record is ready, whatever stands beside the word.
READY = "(^|_)ready(_|$)"
SPLITS = ("train", "validation", "test", "excluded_duplicate", "excluded_conflict")


def adapted(raw: DataFrame, order: Column | None = None, prefix: str = "IT04") -> DataFrame:
    """Records as essays: raw(value: a JSON object as text) -> essay_id, text, exam_id, split, gold_total, grade_band,
    training_eligible, ready, flags (array).

    Of each field the first name with a value counts, labels.* before the top level. A score that isn't a number is
    null. Without an id, records are numbered by their place in order. What isn't stated of eligibility follows from
    score and split.
    """
    at = lambda path: F.get_json_object("value", f"$.{path}")
    first = lambda *paths: records.first_of(*(at(p) for p in paths))
    d = raw
    if order is not None:
        from gradeloom.operators.sampling import ordinal

        d = ordinal(d, [order], "_at")
    else:
        d = d.withColumn("_at", F.monotonically_increasing_id() + 1)
    score = first(*(f"labels.{n}" for n in NAMES["label"]), *NAMES["score"]).try_cast("double")
    split = F.lower(F.coalesce(first(*NAMES["split"]), F.lit("unassigned")))
    split = F.when(split.isin("val", "dev"), "validation").otherwise(split)
    stated = lambda x, default: F.when(x.isNotNull(), records.truth(x)).otherwise(default)
    fields = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    value_of = lambda m, test: F.get(F.map_values(F.map_filter(m, lambda k, v: test(k) & (F.coalesce(v, F.lit("")) != ""))), F.lit(0))
    eligible = first(*NAMES["eligible"], "eligibility.training")
    ready = F.coalesce(value_of(fields(F.col("value")), lambda k: k.rlike(READY)), value_of(fields(at("eligibility")), lambda k: k != "training"))
    flags, kind = at("flags"), F.substring(F.coalesce(at("flags"), F.lit("")), 1, 1)
    listed = F.array_sort(F.coalesce(F.from_json(flags, "array<string>"), F.array().cast("array<string>")))
    mapped = records.flags_of_map(F.coalesce(F.from_json(flags, "map<string,string>"), F.create_map().cast("map<string,string>")))
    d = d.withColumns({"gold_total": score, "split": split})
    known = F.col("gold_total").isNotNull()
    return d.select(
        F.coalesce(first(*NAMES["essay_id"]), F.concat(F.lit(prefix + "-"), F.lpad(F.col("_at").cast("string"), 6, "0"))).alias("essay_id"),
        normalize_answer(F.coalesce(first(*NAMES["text"]), F.lit(""))).alias("text"),
        records.exam_name(F.coalesce(first(*NAMES["exam"]), F.lit(""))).alias("exam_id"),
        "split",
        "gold_total",
        F.coalesce(first("labels.grade_band", "grade_band"), F.lit("")).alias("grade_band"),
        stated(eligible, known & (F.col("split") == "train")).alias("training_eligible"),
        stated(ready, known & F.col("split").isin("train", "validation", "test")).alias("ready"),
        F.when(kind == "[", listed).when(kind == "{", mapped).otherwise(records.flags_of_text(flags)).alias("flags"),
    )


def prepared(essays: DataFrame, rubrics: Mapping[str, Rubric], least: int = 20, course: str = "IT04") -> dict[str, DataFrame]:
    """essays, gold and rejected of adapted() records, as projections of one plan that is cut once.

    Every copy of a repeated id is rejected, and what is neither eligible nor ready; no row but those of the training part
    stays eligible for training. Prompts and answer keys come from the rubrics.
    """
    spark = essays.sparkSession
    d = records.rejections(essays, "essay_id", "text", "exam_id", "split", "gold_total", least, SPLITS)
    idle = ~(F.col("training_eligible") | F.col("ready"))
    d = d.withColumn("reasons", F.when((F.col("reasons") == "") & idle, "not_eligible_or_ready").otherwise(F.col("reasons")))
    d = cut(d.withColumn("flags", F.array_join("flags", "|")))
    good = records.guarded(joins.lookup(d.where("reasons = ''"), exam_table(spark, rubrics), "exam_id"))
    c = F.col
    return {
        "essays": good.select("essay_id", "text", "exam_id", c("exam_id").alias("prompt_id"), "prompt_text", "answer_key", c("rubric_id").alias("rubric_file"), F.lit(course).alias("course_id"), c("essay_id").alias("student_hash"), F.lit("keep").alias("dataset_status"), "split", "training_eligible", "ready", "flags"),
        "gold": good.select("essay_id", "gold_total", "grade_band", "exam_id", "split", "training_eligible", "ready", "flags", F.lit("").alias("teacher_feedback"), F.lit("total_only").alias("label_granularity"), F.lit("standardized_gradebook").alias("label_source")),
        "rejected": d.where("reasons <> ''").select("essay_id", "exam_id", "split", "reasons", "flags"),
    }


def score_summary(df: DataFrame, by: str, score: str = "gold_total") -> DataFrame:
    """(by, count, mean, std, min, max), rounded to 4 digits; a spread that isn't defined is 0."""
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return df.groupBy(by).agg(F.count(score).alias("count"), zero(F.avg(score)).alias("mean"), zero(F.stddev_samp(score)).alias("std"), zero(F.min(score).cast("double")).alias("min"), zero(F.max(score).cast("double")).alias("max"))


def rubric_scores(essays: DataFrame, rubrics: Mapping[str, Rubric], text: str = "text", exam: str = "exam_id") -> tuple[DataFrame, DataFrame]:
    """(items, totals) of essays, each by the rubric of its exam; other exams have no row. One plan a rubric, of which there are few."""
    items, totals = None, None
    for name, r in rubrics.items():
        own = structured.item_scores(essays.where(F.col(exam) == name), "essay_id", text, r.items()).withColumns({"exam_id": F.lit(name), "label_status": F.lit("rule_based_estimate")})
        total = structured.rubric_totals(own, "essay_id")
        items, totals = (own, total) if items is None else (items.unionByName(own), totals.unionByName(total))
    return items, totals


def model_text(df: DataFrame) -> Column:
    """What the text model reads: exam, task and answer."""
    return F.concat_ws("\n", F.concat(F.lit("exam "), F.col("exam_id")), F.coalesce("prompt_text", F.lit("")), F.coalesce("text", F.lit("")))


def graded(essays: DataFrame, model: models.TextRidge, rubrics: Mapping[str, Rubric], weight: float = 0.70, least: float = 0.60) -> tuple[DataFrame, DataFrame]:
    """(scores, items) of the essays that are ready: model and rubric totals, the final total, its mode and flags."""
    d = essays.where(records.truth(F.col("ready"))) if "ready" in essays.columns else essays
    d = d.withColumn("exam_id", records.exam_name(F.col("exam_id"))).withColumn("_m", model_text(d))
    predicted = model.scores(d, "essay_id", "_m", None).select(F.col("essay_id").alias("_p"), F.col("total").alias("_raw"))
    items, totals = rubric_scores(d, rubrics)
    full = d.join(predicted, F.col("essay_id") == F.col("_p"), "left").join(totals.withColumnRenamed("essay_id", "_t"), F.col("essay_id") == F.col("_t"), "left")
    full = full.withColumn("section_coverage", F.coalesce("section_coverage", F.lit(0.0)))
    out = structured.final_grades(full.drop("flags"), "text", "_raw", weight, least)
    scores = out.select("essay_id", "exam_id", F.rint(F.col("_raw") / 0.25).alias("_q"), "rubric_total", "final_total", F.col("mode").alias("grading_mode"), "section_coverage", F.col("needs_review").alias("needs_human_review"), "flags", F.lit("total_only_for_training").alias("label_granularity"))
    return scores.withColumn("model_total", F.col("_q") * 0.25).drop("_q"), items


def evaluated(scores: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores with labels, figures of model_total and final_total by split); ids must be unique in both tables."""
    keep = [c for c in ("essay_id", "gold_total", "exam_id", "split") if c in gold.columns]
    both = joins.one_to_one(gold.select(*keep), scores, "essay_id", suffixes=("_gold", ""))
    if "split" not in both.columns:
        both = both.withColumn("split", F.lit("all"))
    each = [evaluation.totals(both, "gold_total", c, ("split",)).withColumn("score", F.lit(c)) for c in ("model_total", "final_total")]
    return both, each[0].unionByName(each[1])


def calibrated(essays: DataFrame, gold: DataFrame, model: models.TextRidge, rubrics: Mapping[str, Rubric], least: float = 0.60) -> tuple[float, DataFrame]:
    """(weight of the rubric, the grid it was chosen from) on the validation part; 0 without one. Test labels aren't read."""
    d = joins.one_to_one(essays.where(F.col("split") == "validation"), gold.select("essay_id", "gold_total"), "essay_id")
    d = d.withColumn("_m", model_text(d))
    predicted = model.scores(d, "essay_id", "_m", None).select(F.col("essay_id").alias("_p"), F.col("total").alias("model"))
    _, totals = rubric_scores(d, rubrics)
    full = d.join(predicted, F.col("essay_id") == F.col("_p")).join(totals.withColumnRenamed("essay_id", "_t"), F.col("essay_id") == F.col("_t"), "left")
    full = full.withColumns({"rubric_total": F.coalesce("rubric_total", F.lit(0.0)), "section_coverage": F.coalesce("section_coverage", F.lit(0.0))})
    grid = structured.calibrate_weight(full, "gold_total", "model", "rubric_total", "section_coverage", least)
    best = structured.best_weight(grid).first()
    return float(best.weight), grid


def rows_of(df: DataFrame, most: int = 1000) -> list[dict[str, Any]]:
    """A small table for a report."""
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


def run_all(spark: SparkSession, raw: DataFrame, rubrics: Mapping[str, Rubric], output: str | None = None, alpha: float = 12.0, rubric_weight: float | str = "auto") -> dict[str, Any]:
    """Prepare, check the rubrics, train, choose the weight, grade, evaluate: a report of each step; tables under "tables".

    raw(value): JSON objects as text. With output, tables go there as Parquet and reports as JSON, with a summary.
    """
    now = datetime.now(UTC).isoformat()
    problems = check_rubrics(rubrics)
    if problems:
        raise ValueError("; ".join(problems))
    essays_in = cut(adapted(raw))
    parts = prepared(essays_in, rubrics)
    essays, gold = cut(parts["essays"]), cut(parts["gold"])
    data = {"created_at": now, "n_input": essays_in.count(), "n_prepared": essays.count(), "n_ready": essays.where("ready").count(), "n_training_eligible": essays.where("training_eligible").count(), "n_rejected": parts["rejected"].count()}
    data |= {"by_split": rows_of(essays.groupBy("split").count()), "by_exam": rows_of(essays.groupBy("exam_id").count()), "scores": rows_of(score_summary(gold, "split")), "issues": rows_of(records.reason_counts(parts["rejected"], "reasons"))}
    if not data["n_prepared"]:
        raise ValueError("no record is left after the checks")
    usable = records.eligible_rows(essays)
    labelled = joins.one_to_one(usable, gold.select("essay_id", "gold_total"), "essay_id")
    train = labelled.where(F.col("split") == "train")
    model = models.fit_text_ridge(train.withColumn("_m", model_text(train)), "essay_id", "_m", "gold_total", alpha)
    fixed = str(rubric_weight).lower() != "auto"
    weight, grid = (float(rubric_weight), None) if fixed else calibrated(essays, gold, model, rubrics)
    scores, items = graded(essays, model, rubrics, weight)
    scores = cut(scores)
    both, figures = evaluated(scores, gold)
    tables = parts | {"essays": essays, "gold": gold, "scores": scores, "items": items, "review": scores.where("needs_human_review"), "scores_with_gold": both, "metrics": figures}
    report = {
        "data": data,
        "rubric": {"n_rubrics": len(rubrics), "n_items": sum(len(r.criteria) for r in rubrics.values()), "valid": True, "problems": []},
        "calibration": {"selected_weight": weight, "selection": "fixed" if fixed else "validation_mae", "candidates": rows_of(grid.orderBy("weight")) if grid is not None else []},
        "grading": {"n_scored": scores.count(), "modes": rows_of(scores.groupBy("grading_mode").count()), "n_review": scores.where("needs_human_review").count()},
        "evaluation": rows_of(figures.orderBy("split", "score")),
    }
    if output:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{output}/tables/{name}")
        for name, part in report.items():
            write_json(part, f"{output}/{name}.json")
        workflow_report(output, f"{output}/report")
    return report | {"tables": tables}


def workflow_report(root: str, output: str, title: str = "Workflow report") -> dict[str, Any]:
    """All JSON reports under a folder of the driver, but those in output, as one JSON, Markdown and HTML file; unreadable ones are left out."""
    stages = []
    for path in sorted(Path(root).glob("**/*.json")):
        if Path(output) in path.parents:
            continue
        try:
            stages.append({"file": str(path.relative_to(root)), "payload": json.loads(path.read_text(encoding="utf-8"))})
        except (OSError, ValueError):
            continue
    found = {"created_at": datetime.now(UTC).isoformat(), "n_stage_reports": len(stages), "stages": stages}
    dump = lambda x: json.dumps(x, ensure_ascii=False, indent=2)
    write_json(found, f"{output}/summary.json")
    write_text("\n".join([f"# {title}", "", *(f"## {s['file']}\n\n```json\n{dump(s['payload'])}\n```\n" for s in stages)]), f"{output}/report.md")
    parts = "".join(f"<section><h2>{html.escape(s['file'])}</h2><pre>{html.escape(dump(s['payload']))}</pre></section>" for s in stages)
    write_text(f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{parts}', f"{output}/report.html")
    return found


# --- other corpora ---------------------------------------------------------------------------------------------------


def prepare_declared(source: DataFrame, gold: DataFrame, rubrics: Mapping[str, Rubric], secret: str, policy: str = "quarantine", score: str = "Diem", feedback: str = "Nhan_Xet", declared: str = "De_Thi", course: str = "IT04") -> dict[str, DataFrame]:
    """essays, gold, audit, private ids and score summary of source(essay_id, text, source_exam) with labels.

    Exams are inferred from phrases and compared with the declared ones; what conflicts is put aside, corrected or kept by
    the policy. Ids become digests, and texts lose personal data, the name at the head of the id included. Ids must be
    unique in both tables, and each essay needs a label.
    """
    if policy not in ("quarantine", "correct", "trust-source"):
        raise ValueError(policy)
    if secret in ("", "change-me"):
        raise ValueError("a secret of your own is needed")
    labels = gold.select(F.col("essay_id").cast("string").alias("essay_id"), score, feedback, *([declared] if declared in gold.columns else []))
    d = joins.one_to_one(source.withColumn("essay_id", F.col("essay_id").cast("string")), labels, "essay_id", "left", (score,))
    named = records.exam_digit(F.col(declared)) if declared in d.columns else F.lit("")
    d = d.withColumn("declared_exam", F.when(named != "", named).otherwise(F.col("source_exam")))
    d = d.withColumn("_i", records.inferred_exam(F.col("text"))).withColumns({"inferred_exam": F.col("_i.exam"), "inference_hits": F.col("_i.hits")})
    conflict = (F.col("inferred_exam") != "") & (F.col("inference_hits") >= 2) & (F.col("inferred_exam") != F.col("declared_exam"))
    empty = F.length(F.trim(F.coalesce("text", F.lit("")))) < 20
    d = d.withColumns({"strong_conflict": conflict, "empty_text": empty})
    exam = F.when(F.col("strong_conflict"), F.col("inferred_exam")).otherwise(F.col("declared_exam")) if policy == "correct" else F.col("declared_exam")
    status = F.when(F.col("empty_text"), "quarantine_empty_text").when(F.col("strong_conflict") & F.lit(policy == "quarantine"), "quarantine_exam_conflict").otherwise("keep")
    number = F.regexp_extract("essay_id", pii.SUBMISSION, 1)
    submission = F.when(number != "", number).otherwise(F.col("essay_id"))
    masked = pii.scrub_name(pii.anonymize(F.coalesce("text", F.lit("")))["text"], F.trim(F.substring_index("essay_id", "_", 1)))
    masked = F.when(submission.rlike(r"^\d+$"), F.regexp_replace(masked, F.concat(F.lit(r"\b"), submission, F.lit(r"\b")), F.lit("<ID_NOI_BO>"))).otherwise(masked)
    d = d.withColumns({"exam_id": exam, "dataset_status": status, "anonymous": pii.spaced_digest("essay", F.col("essay_id"), secret, 16, "DM-"), "student_hash": pii.spaced_digest("student", submission, secret, 16, "SV-"), "clean": masked})
    d = cut(joins.lookup(d.drop("_i"), exam_table(source.sparkSession, rubrics), "exam_id"))
    c = F.col
    out = {
        "essays": d.select(c("anonymous").alias("essay_id"), c("clean").alias("text"), "exam_id", c("exam_id").alias("prompt_id"), "prompt_text", "answer_key", c("rubric_id").alias("rubric_file"), F.lit(course).alias("course_id"), "student_hash", "dataset_status"),
        "gold": d.select(c("anonymous").alias("essay_id"), c(score).cast("double").alias("gold_total"), F.coalesce(c(feedback).cast("string"), F.lit("")).alias("teacher_feedback"), "exam_id", F.lit("total_only").alias("label_granularity"), "dataset_status"),
        "audit": d.select(c("anonymous").alias("essay_id"), "source_exam", "declared_exam", "inferred_exam", "inference_hits", "strong_conflict", "empty_text", "exam_id", "dataset_status"),
        "private_ids": d.select(c("essay_id").alias("essay_id_private"), c("anonymous").alias("essay_id")),
    }
    return out | {"summary": score_summary(out["gold"].where("dataset_status = 'keep'"), "exam_id")}


def prepare_research(tables: Mapping[str, DataFrame], traits: tuple[str, ...], prefix: str = "VIT") -> dict[str, DataFrame]:
    """essays (and labels, if all traits are there) of several tables with a text column each; blank texts are dropped.

    Missing ids are numbered; if any id repeats, all are numbered anew, in the order of file and row.
    """
    from gradeloom.operators.sampling import ordinal

    union = None
    for name, df in sorted(tables.items()):
        d = df.withColumns({"source_file": F.lit(name), "_row": F.monotonically_increasing_id()})
        union = d if union is None else union.unionByName(d, allowMissingColumns=True)
    if union is None:
        raise ValueError("no table with a text column")
    d = union.withColumn("text", F.trim(F.coalesce(F.col("text").cast("string"), F.lit("")))).where("text <> ''")
    for c in ("essay_id", "prompt_id", "prompt_text", "student_id", "course_id"):
        d = d.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")) if c in d.columns else F.lit(""))
    d = ordinal(d, [F.col("source_file"), F.col("_row")], "_at")
    new = F.concat(F.lit(prefix), F.lpad(F.col("_at").cast("string"), 6, "0"))
    known = d.where("essay_id <> ''")
    repeats = not known.groupBy("essay_id").count().where("count > 1").isEmpty()
    d = d.withColumn("essay_id", new if repeats else F.when(F.col("essay_id") == "", new).otherwise(F.col("essay_id"))).drop("_at", "_row")
    core = ["essay_id", "text", "prompt_id", "prompt_text", "student_id", "course_id", "source_file"]
    out = {"essays": d.select(*core, *(c for c in d.columns if c not in core))}
    if all(t in d.columns for t in traits):
        total = sum((F.coalesce(F.col(t).try_cast("double"), F.lit(0.0)) for t in traits), F.lit(0.0))
        out["labels"] = d.select("essay_id", *traits, total.alias("total"))
    return out
