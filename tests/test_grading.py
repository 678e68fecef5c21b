"""Rubrics, rules, checked joins, features, prompts, the grader, workflows, sources."""

import json
import os
import zipfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from gradeloom import grading_queries, queries
from gradeloom.functions import pii, prompts, records, text
from gradeloom.operators import agreement, dedup, evaluation, joins, retrieval, sampling, structured
from gradeloom.plans import features, reports, workflow
from gradeloom.plans.grader import FunctionBackend, Grader, level_name, summary
from gradeloom.plans.rules import UnsafeExpression, apply_rules, check_rules
from gradeloom.sources import documents, platform, rubrics, simulated, tables

SF = "/root/testdata/sf0.001"
HERE = [k for k, f in queries.QUERIES.items() if f.__module__ == grading_queries.__name__]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", ["retrieve_of_course", "retrieve_passages"])
def test_large_index_is_searched_alike(spark, con, monkeypatch, name):
    monkeypatch.setattr(retrieval, "SMALL", 0)
    test_same_as_sql(spark, con, name)


@pytest.mark.parametrize("name", HERE)
def test_same_as_sql(spark, con, name):
    want, got = con.execute(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    word = lambda v: "null" if v is None or str(v) in ("nan", "<NA>") else f"{v + 0.0:.5f}".replace("-0.00000", "0.00000") if isinstance(v, float) else str(v)
    key = lambda df: sorted(tuple(map(word, r)) for r in df[cols].astype(object).itertuples(index=False))
    assert key(got) == key(want)


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(column.alias("x")).first().x


def test_upload_bytes_count_by_essay(spark):
    df = spark.createDataFrame([(k, "é" * 30) for k in "abc"] + [("d", "é" * 60), ("e", None)], "id string, t string")
    got = sorted((r.id, r.issue) for r in records.upload_issues(df, "id", "t", most_bytes=100).collect())
    assert got == [("d", "too_large"), ("e", "text_too_short")]


# --- rules -----------------------------------------------------------------------------------------------------------


def ruled(spark, rules, row, **kw):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'double'}" for k, v in row.items())
    return apply_rules(spark.createDataFrame([tuple(row.values())], names), rules, **kw).first()


def test_rule_actions(spark):
    row = {"n": 5.0, "total": 8.0, "a": 2.0, "b": 1.0}
    weights = {"a": (4.0, 0.5), "b": (2.0, 0.5)}
    assert ruled(spark, [{"id": "s", "when": "n > 1", "action": "set_criterion", "target": "a", "value": 4}], row, criteria=weights).final_total == 7.5
    assert ruled(spark, [{"id": "s", "when": "n > 1", "action": "set_total", "value": 12}], row).final_total == 12.0
    assert ruled(spark, [{"id": "s", "when": "n > 1", "action": "cap_total", "value_expr": "0.5 * scale_max"}], row).final_total == 5.0
    assert ruled(spark, [{"id": "s", "when": "n < 0.5 * min_words", "action": "subtract", "value": 9}], row).final_total == 0.0
    assert ruled(spark, [{"id": "s", "when": "", "action": "set_total", "value": 1}, {"id": "t"}], row).applied_rules == ""
    out = ruled(spark, [{"id": "r", "when": "n", "action": "review", "reason": "look"}, {"id": "z", "when": "not (n - 5)", "action": "zap"}], row)
    assert (out.flags, out.applied_rules, out.needs_review, out.review_reason) == ("", "r|z", True, "look; [z] unknown action: zap")
    assert ruled(spark, [{"id": "s", "when": "n > 1", "action": "cap_total", "value": 3}], row | {"total": None}).final_total is None


def test_truth_of_values(spark):
    row = {"n": 0.0, "s": "", "t": "x", "f": False, "total": 1.0}
    for when, hit in (("s", False), ("t", True), ("n or t", True), ("n and t", False), ("not s", True), ("f or n", False), ("1 if t else 0", True)):
        assert (ruled(spark, [{"id": "r", "when": when}], row).applied_rules == "r") == hit, when


def test_unsafe_rules(spark):
    rules = [{"id": "u", "when": "__import__('os')"}, {"id": "k", "when": "nothing > 1"}, {"id": "g", "when": "total > 0", "flag": "G"}]
    out = ruled(spark, rules, {"total": 1.0})
    assert out.flags == "G" and out.skipped_rules == "u: not allowed; k: nothing is not defined"
    for bad in rules[:2]:
        with pytest.raises(UnsafeExpression):
            ruled(spark, [bad], {"total": 1.0}, strict=True)
    assert check_rules(rules, ["x"]) == ["u: __import__ is not defined", "k: nothing is not defined"] and check_rules([{"id": "l", "when": "[x for x in total]"}]) == ["l: x is not defined"]


def test_null_scores_stay_null(spark):
    rows = [("a", "x" * 30, None, 5.0, 0.9), ("b", "x" * 30, 6.0, None, 0.0), ("c", "", None, None, None), ("d", "x" * 30, 20.0, 4.0, 0.1)]
    df = spark.createDataFrame(rows, "id string, text string, model double, rubric_total double, section_coverage double")
    got = {r.id: (r.final_total, r.flags) for r in structured.final_grades(df, "text", "model").collect()}
    assert got["a"] == (None, "NO_SCORE") and got["b"] == (6.0, "UNKNOWN_EXAM|LOW_SECTION_COVERAGE") and got["c"][0] == 0.0 and got["d"][0] == 10.0
    assert structured.calibrate_weight(df.withColumn("gold", F.lit(5.0)), "gold", "model", "rubric_total", "section_coverage").where("n <> 2").count() == 0


# --- texts -----------------------------------------------------------------------------------------------------------


def test_foreign_letters_are_no_diacritics(spark):
    assert one(spark, text.diacritic_ratio(F.col("c0")), "Größe für Mädchen") == 0.0
    assert one(spark, text.diacritic_ratio(F.col("c0")), "Đường về") == pytest.approx(4 / 7)


def test_headers(spark):
    strip = lambda t: one(spark, pii.strip_header(F.col("c0")), t)
    assert strip("Trả lời: đáp án là 12\nHết") == "Trả lời: đáp án là 12\nHết"
    assert strip("Họ và tên: A\n\nLớp: B\nBài làm là đây.\nLớp: C") == "Bài làm là đây.\nLớp: C"


def test_digests(spark):
    import hashlib
    import hmac

    for secret in ("k", "x" * 64, "x" * 65, "x" * 300):
        assert one(spark, pii.keyed_digest(F.col("c0"), secret), "Abc ") == hmac.new(secret.encode(), b"abc", hashlib.sha256).hexdigest()[:16]
    assert one(spark, pii.spaced_digest("essay", F.col("c0"), "k"), "a") != one(spark, pii.spaced_digest("student", F.col("c0"), "k"), "a")


def test_keywords_without_variants(spark):
    groups = F.array(F.lit("a|B"), F.lit(" | "), F.lit("z"))
    assert one(spark, text.keyword_coverage(F.col("c0"), groups), "b") == pytest.approx(1 / 3)
    assert one(spark, text.missing_keywords(F.col("c0"), groups), "b") == ["z"]


def test_signature_is_that_of_a_plain_version(spark):
    import hashlib

    a, b = dedup.coefficients(16)
    words = "một hai ba bốn năm sáu bảy".split()
    got = one(spark, dedup.signature(dedup.word_shingles(F.col("c0")), 16), " ".join(words))
    hs = [int(hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest()[:8], 16) for i in range(3)]
    assert got == [min((x * h + y) % dedup.PRIME for h in hs) for x, y in zip(a, b)]
    assert one(spark, dedup.signature(dedup.word_shingles(F.col("c0")), 16), "") == [dedup.PRIME] * 16


def test_banded_pairs(spark):
    base = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, base), (2, base + " end"), (3, " ".join(f"v{i}" for i in range(60))), (4, "")], "id long, text string")
    assert [(r.id_a, r.id_b) for r in dedup.banded_pairs(df, "id", "text").collect()] == [(1, 2)]


def test_null_blocks_have_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, base, None), (2, base + " end", None), (3, base + " other", "s"), (4, base, None)], "id long, text string, source string")
    pairs = dedup.near_pairs(df, "id", "text", ("source",))
    assert [(r.id_a, r.id_b, r.source) for r in pairs.collect()] == [(1, 2, None)]
    assert {(r.id_a, r.id_b) for r in dedup.with_copies(pairs, df, "id", "text", ("source",)).collect()} == {(1, 2), (1, 4)}


# --- joins -----------------------------------------------------------------------------------------------------------


def test_joins_check(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    twice = a.unionByName(a)
    assert joins.one_to_one(a, a, "id").columns == ["id", "v_x", "v_y"]
    for bad in (lambda: joins.one_to_one(a, twice, "id"), lambda: joins.one_to_one(twice, a, "id"), lambda: joins.one_to_one(a, a.where("id = 1"), "id", "left", ("v_y",)), lambda: joins.by_position(a, twice, [F.col("id")], [F.col("id")]), lambda: joins.reordered(a.where("id = 1"), a, "id")):
        with pytest.raises(Exception, match="unique|no |differ"):
            bad().collect()
    assert joins.reordered(a, twice, "id").count() == 4 and joins.lookup(twice, a.withColumnRenamed("v", "w"), "id").count() == 4


# --- rubrics and sources ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def rubric():
    return grading_queries.example()


def exam_rubrics(folder: Path):
    for e in range(1, 6):
        criteria = [{"key": f"cau_{1 + i // 4}{'abcd'[i % 4]}", "name": f"item {i}", "weight": 0.1, "max_score": 1.0, "description": f"Đáp số chuẩn: {1000 * e + 37 * i}", "levels": [{"name": "đúng", "score": 1.0}, {"name": "sai", "score": 0.0}]} for i in range(10)]
        (folder / f"exam_de_{e}.yaml").write_text(json.dumps({"rubric_id": f"exam_{e}", "name": f"Exam {e}", "criteria": criteria}, ensure_ascii=False), encoding="utf-8")
    return rubrics.load_rubrics(folder)


def test_rubric(tmp_path, rubric):
    assert rubric.problems() == [] and rubric.thresholds["min_words"] == 300 and rubric.keys == ["content", "argument", "style"]
    assert check_rules(list(rubric.rules), criteria=set(rubric.keys)) == []
    with pytest.warns(UserWarning, match="weights"):
        assert rubrics.rubric_of({"criteria": [{"key": "a", "weight": 0.4, "max_score": 2, "levels": [{"name": "x", "score": 1}]}]}).problems() == ["weights sum to 0.4000", "a: the top level 1.0 isn't the maximum 2.0"]
    found = exam_rubrics(tmp_path)
    assert sorted(found) == [f"De_{i}" for i in range(1, 6)] and rubrics.check_rubrics(found) == []
    assert found["De_1"].items()[0] == structured.Item("cau_1a", 1.0, "1000", ())
    (tmp_path / "exam_de_5.yaml").unlink()
    with pytest.raises(FileNotFoundError, match="De_5"):
        rubrics.load_rubrics(tmp_path)
    assert rubrics.load_rubric("example.json", Path(__file__).parent.parent / "rubrics").rubric_id == "example_v1"
    assert "| full | 4 |" in rubrics.handbook(rubric)


def test_yaml_rubric(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("rubric_id: r\ncriteria:\n  - {key: a, weight: 1, max_score: 2, levels: [{name: x, score: 2}]}\nrules:\n  - {id: q, when: 'a < 1', action: review}\n")
    found = rubrics.load_rubric(tmp_path / "r.yaml")
    assert (found.keys, found.weights, found.rules[0]["id"], found.scale_max) == (["a"], {"a": (2.0, 1.0)}, "q", 10.0)


@pytest.mark.parametrize("criterion, want", [({"answers": [1, 2]}, "1 | 2"), ({"scoring": {"answer": "x"}}, "x"), ({"description": "A. Đáp số  chuẩn : 12 "}, "12"), ({"description": " all "}, "all")])
def test_expected_answer(criterion, want):
    assert rubrics.expected_answer(criterion) == want


def test_writers_and_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1", 2.5, True), (2, "ạ<&\"", None, False)], "id long, t string, x double, b boolean").coalesce(1)
    tables.write_csv_file(df, f"{tmp_path}/out/a.csv")
    raw = Path(f"{tmp_path}/out/a.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfid,t,x,b") and b"'=1+1" in raw
    with pytest.raises(ValueError):
        tables.write_csv_file(df, f"{tmp_path}/out/b.csv", 1)
    tables.write_table(df, f"{tmp_path}/out/a.xlsx")
    assert documents.xlsx_rows(Path(f"{tmp_path}/out/a.xlsx").read_bytes())[2][1] == 'ạ<&"'
    tables.write_json({"x": Path("p"), "ạ": 1}, f"{tmp_path}/deep/er/j.json")
    assert json.loads(Path(f"{tmp_path}/deep/er/j.json").read_text()) == {"x": "p", "ạ": 1}
    (tmp_path / "essays").mkdir()
    (tmp_path / "essays" / "e1.txt").write_text("hello")
    assert tables.load(spark, f"{tmp_path}/essays").first().essay_id == "e1" and tables.load(spark, f"{tmp_path}/out/a.csv").count() == 2


def test_folders_of_tables(spark, tmp_path):
    (tmp_path / "dataset").mkdir()
    (tmp_path / "dataset" / "d.jsonl").write_text('﻿{"a": 1}\n\n{"a": 2}\n', encoding="utf-8")
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "x.jsonl").write_text("not json")
    (tmp_path / "deep" / "c.csv").write_text("bai_lam,q\nxin chào,1\n")
    (tmp_path / "deep" / "d.csv").write_text("q\n1\n")
    assert [json.loads(r.value)["a"] for r in tables.read_jsonl_folder(spark, str(tmp_path)).collect()] == [1, 2]
    found = tables.discover(spark, str(tmp_path), {"text": ["bai_lam"]})
    assert list(found) == ["deep/c.csv"] and found["deep/c.csv"].first().text == "xin chào"
    got = workflow.prepare_research({k: v.withColumn("trait", F.lit("2")) for k, v in found.items()}, ("trait",))
    assert got["essays"].first().essay_id == "VIT000001" and got["labels"].first().total == 2.0


def test_clean_sets(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "clean_de_1.csv.zip", "w") as z:
        z.writestr("in/clean.csv", "essay_id,text\nA_11_,một\n")
    (tmp_path / "clean_de_2.csv").write_text("essay_id,text,more\nB_12_,hai,x\n")
    (tmp_path / "clean_de_3.csv").mkdir()
    (tmp_path / "clean_de_3.csv" / "clean.csv").write_text("essay_id,text\nC_13_,ba\n")
    exams = ("De_1", "De_2", "De_3")
    got = {r.essay_id: r.source_exam for r in tables.load_clean_sets(spark, str(tmp_path), exams).collect()}
    assert got == {"A_11_": "De_1", "B_12_": "De_2", "C_13_": "De_3"}
    with pytest.raises(FileNotFoundError):
        tables.load_clean_sets(spark, str(tmp_path), (*exams, "De_4"))
    (tmp_path / "clean_de_4.csv").write_text("essay_id,text\nC_13_,bốn\n")
    with pytest.raises(Exception, match="unique"):
        tables.load_clean_sets(spark, str(tmp_path), (*exams, "De_4")).collect()


def test_simulated(spark, rubric):
    essays, gold, ratings = simulated.simulated(spark, rubric, 30)
    assert (essays.count(), gold.count(), ratings.count()) == (35, 30, 60) and gold.where("gold_total not between 0 and 10").count() == 0
    corr = gold.select(F.corr("latent_q", "gold_total")).first()[0]
    assert corr > 0.9 and essays.where("essay_id = 'E90005'").first().text == essays.where("essay_id = 'E00003'").first().text
    report = agreement.criteria_report(ratings, "essay_id", "rater_id", ("content", "total", "none")).collect()
    assert [r.criterion for r in report] == ["content", "total"] and all(r.n_double_scored == 30 and r.qwk_mean > 0.5 for r in report)


# --- prompts ---------------------------------------------------------------------------------------------------------

WORDS = prompts.Codec(lambda t: [sum(map(ord, w)) % 997 for w in t.split()], lambda ids: " ".join(map(str, ids)))


def test_prompts(spark, rubric):
    df = spark.createDataFrame([("e", "the essay", "task", None, 3.0, 1.5, 7.0)], "essay_id string, text string, prompt_text string, answer_key string, content double, gold_argument double, gold_total double")
    r = prompts.criterion_records(df, rubric, "text", keep=("essay_id",)).first()
    assert json.loads(r.assistant) == {"criteria": {"content": {"score": 3.0, "evidence": [], "comment": ""}, "argument": {"score": 1.5, "evidence": [], "comment": ""}}, "total": 7.0, "overall_comment": "", "flags": []}
    assert "### `content` Content" in r.user and "task" in r.user and prompts.WORDING["context"] not in r.user
    shown = df.select(prompts.user_prompt(rubric, F.col("text"), anchors=[{"text": "x" * 2000, "total": 5, "scores": {"a": 1}}])).first()[0]
    assert "x" * 1500 in shown and "x" * 1501 not in shown and '{"a": 1}' in shown


def test_packing(spark):
    long = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([("s", "short user", "the target"), ("s", long, "the target"), ("s", "u", " ".join(["t"] * 90)), ("s", "", "t")], "system string, user string, assistant string")
    got = prompts.fitted(df, WORDS, 60).collect()
    assert [r.error is None for r in got] == [True, True, False, False] and [r.truncated for r in got[:2]] == [False, True]
    assert got[1].packed_tokens <= 60 and got[1].packed_tokens >= 55 and got[1].labels.count(prompts.IGNORED) == got[1].packed_tokens - got[1].target_tokens
    audit = prompts.packing_audit(prompts.fitted(df, WORDS, 60)).first()
    assert (audit.n_records, audit.n_errors, audit.truncated_share) == (4, 2, 0.5)
    assert prompts.middle_cut(WORDS, long, 1).count(" ") == 0 and prompts.middle_cut(WORDS, long, 0) == ""


def test_shrinking(spark):
    df = spark.createDataFrame([("word " * 300, "base"), ("tiny", "base " * 900), (None, None)], "text string, base string")
    got = [r.text for r in prompts.shrunk(df, "text", "base", lambda t: len(t.split()), 100).collect()]
    assert len(got[0].split()) <= 100 and got[0].endswith("[cut to fit]") and got[1:] == ["tiny", ""]


def test_token_budget(spark):
    hits = spark.createDataFrame([("q", 1, 0.9, 1), ("q", 2, 0.8, 2), ("q", 3, 0.7, 3)], "k string, c long, score double, place int")
    chunks = spark.createDataFrame([(1, "a " * 5), (2, "b " * 50), (3, "c " * 5)], "c long, text string")
    queries_ = spark.createDataFrame([("q", "base"), ("r", "base " * 99), ("s", "base")], "k string, base string")
    run = lambda policy: {r.k: (r.n_passages, r.condition) for r in retrieval.packed(hits, "k", chunks, "c", "text", queries_, "base", lambda t: len(t.split()), 20, policy).collect()}
    assert run("skip") == {"q": (2, "eligible"), "r": (0, "base_prompt_too_long"), "s": (0, "no_retrieval_fit")} and run("break")["q"] == (1, "eligible")
    assert retrieval.context_audit(hits, "k", chunks, "c", ("text",)).count() == 3


@pytest.mark.parametrize("small", [0, 200_000])
def test_retrieval_loses_none_of_the_best(spark, monkeypatch, small):
    monkeypatch.setattr(retrieval, "FIRST", 1)
    monkeypatch.setattr(retrieval, "SMALL", small)
    import random

    r = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    text_of = lambda n: " ".join(r.choices(words, [1 / (i + 1) for i in range(40)], k=n))
    chunks = spark.createDataFrame([(i, text_of(20)) for i in range(150)], "c long, text string")
    asked = spark.createDataFrame([(i, text_of(12)) for i in range(20)], "q long, text string")
    got = {(r.q, r.place): r.score for r in retrieval.search(asked, "q", "text", chunks, "c", "text", 3).collect()}
    postings, idf = retrieval.index(chunks, "c", "text")
    q = retrieval.weighted(retrieval.counted(asked, "q", "text"), idf).select("term", F.col("id").alias("q"), F.col("w").alias("qw"))
    every = q.join(postings, "term").groupBy("q", "id").agg(F.sum(F.col("qw") * F.col("w")).alias("s")).toPandas()
    for k, part in every.groupby("q"):
        assert [got[k, i] for i in (1, 2, 3)] == pytest.approx(sorted(part["s"], reverse=True)[:3], abs=1e-6)


def test_saved_index(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "alpha beta", "yes"), (2, "alpha gamma", "false"), (3, " ", "1")], "c long, text string, ok string")
    fit = retrieval.index(retrieval.approved_chunks(chunks, "text", "ok"), "c", "text")
    retrieval.save_index(*fit, f"{tmp_path}/ix")
    asked = spark.createDataFrame([("q", "alpha")], "q string, text string")
    got = retrieval.search(asked, "q", "text", chunks, "c", "text", approved="ok", indexed=retrieval.load_index(spark, f"{tmp_path}/ix")).collect()
    assert [r.c for r in got] == [1] and retrieval.index(chunks, "c", "text", 2)[1].count() == 2


# --- grader and workflows --------------------------------------------------------------------------------------------


def test_grader(spark, rubric):
    essays, gold, _ = simulated.simulated(spark, rubric, 60)
    labelled = essays.join(gold.select("essay_id"), "essay_id", "left_semi")
    g = Grader(rubric, bags=2, trees=4).fit(labelled, gold)
    got = {r.essay_id: r for r in g.score(essays, messages={"EMPTY": "No text."}).collect()}
    assert len(got) == 65 and (got["E90001"].total, got["E90001"].flags) == (0.0, "EMPTY") and "No text." in got["E90001"].feedback
    assert all(0 <= r.total <= 10 and r.total % 0.25 == 0 and 0 <= r.confidence <= 1 for r in got.values())
    assert set(got["E00001"].asDict()) == {"essay_id", "total", "total_before_rules", "confidence", "needs_human_review", "review_reason", "flags", "applied_rules", "feedback", *rubric.keys, *(f"{k}__level" for k in rubric.keys)}
    truth = {r.essay_id: r.gold_total for r in gold.collect()}
    error = sum(abs(got[k].total_before_rules - v) for k, v in truth.items()) / len(truth)
    assert error < 1.5 and summary(g.score(essays, False)).first().n == 65


def test_backends(spark, rubric):
    essays, gold, _ = simulated.simulated(spark, rubric, 40)
    labelled = essays.join(gold.select("essay_id"), "essay_id", "left_semi")
    g = Grader(rubric, bags=1, trees=2, algorithm="ridge")
    with pytest.raises(RuntimeError):
        g.score(essays)
    g.add_backend(FunctionBackend("llm", ["content", "style"], lambda t: {"content": min(4, len(t) / 200), "style": "n/a"}))
    with pytest.raises(ValueError):
        g.add_backend(FunctionBackend("feature", [], lambda t: {}))
    g.fit(labelled, gold, labelled, gold)
    assert set(g.mix["content"]) == {"feature", "llm"} and sum(g.mix["content"].values()) == pytest.approx(1)
    assert g.score(essays, False).where("content is null or total is null").count() == 0
    g.close()


def test_level_names(spark):
    levels = [("none", 0.0), ("half", 1.0), ("full", 2.0)]
    df = spark.createDataFrame([(0.5,), (1.6,), (None,)], "x double")
    assert [r[0] for r in df.select(level_name(levels, F.col("x"))).collect()] == ["none", "full", None] and df.select(level_name([], F.col("x"))).first()[0] == ""


def test_semantic_features(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0]), (2, [0.0, 1.0], [1.0, 0.0])], "id long, v array<double>, p array<double>")
    anchors = spark.createDataFrame([([1.0, 0.0],), ([1.0, 1.0],)], "v array<double>")
    got = {r.id: r for r in features.semantic(df, "id", "v", "p", anchors).collect()}
    assert (got[1].sim_prompt, got[2].sim_prompt, got[1].sim_reference) == (1.0, 0.0, 1.0) and got[2].sim_reference_mean == pytest.approx(0.5**0.5 / 2)
    bare = features.semantic(df, "id", "v").first()
    assert (bare.sim_prompt, bare.sim_reference) == (0.5, 0.0)


def test_encoder(spark):
    base = "các bài viết về giáo dục đại học và nghề nghiệp"
    df = spark.createDataFrame([(i, f"{base} số {i}" if i % 2 else f"trái cây mùa hè ngon lắm {i}") for i in range(12)], "id long, text string")
    encode = features.tfidf_encoder(3, 1 << 10)(df, "text")
    got = {r.id: r.v for r in encode(df, "text", "v").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(got[a], got[b]))
    assert dot(1, 1) == pytest.approx(1) and dot(1, 3) > 0.9 > 0.5 > dot(1, 2)
    assert set(features.FEATURE_GROUPS["dien_dat"]) <= set(features.build_features(df.withColumn("essay_id", F.col("id").cast("string")), "essay_id").columns)


def test_run_all(spark, tmp_path):
    found = exam_rubrics(tmp_path)
    rows = []
    for i in range(60):
        e = 1 + i % 5
        answers = "\n".join(f"Câu {1 + k // 4}{'abcd'[k % 4]}: kết quả {1000 * e + 37 * k if (i + k) % 3 else 'không rõ'} vì thế" for k in range(10))
        rows.append(json.dumps({"essay_id": f"E{i}", "exam_code": f"de_0{e}", "answer_text": answers, "split": ("train", "train", "val", "test")[i % 4], "labels": {"score_10": 6 + i % 3}}, ensure_ascii=False))
    rows += [json.dumps({"essay_id": "E1", "answer_text": "twice " * 9, "exam_code": "de1", "split": "test", "score": 5}), json.dumps({"id": "bad", "text": "short", "split": "what", "score": 11})]
    report = workflow.run_all(spark, spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1), found, f"{tmp_path}/out")
    assert (report["data"]["n_input"], report["data"]["n_prepared"], report["data"]["n_rejected"]) == (62, 59, 3)
    rejected = {(r.essay_id, r.reasons) for r in report["tables"]["rejected"].collect()}
    assert ("E1", "duplicate_essay_id") in rejected and ("bad", "text_too_short|unknown_exam|invalid_split|invalid_or_missing_score") in rejected
    assert {r["grading_mode"] for r in report["grading"]["modes"]} == {"hybrid_rubric_model"} and report["tables"]["essays"].where("training_eligible and split <> 'train'").count() == 0
    assert {r["split"] for r in report["evaluation"]} == {"train", "validation", "test"} and 0 <= report["calibration"]["selected_weight"] <= 1
    assert report["tables"]["items"].count() == 590 and json.loads(Path(f"{tmp_path}/out/report/summary.json").read_text())["n_stage_reports"] == 5


def test_declared_exams(spark, tmp_path):
    found = exam_rubrics(tmp_path)
    phrases = "52 quân và 20 đường thẳng và 13 quân"
    source = spark.createDataFrame([("Lan Anh_77_x", f"Lan Anh viết về {phrases}, mã 77.", "De_2"), ("Bình_78_x", "Một bài làm đủ dài để chấm điểm.", "De_3"), ("C_79_x", "ngắn", "De_4")], "essay_id string, text string, source_exam string")
    gold = spark.createDataFrame([("Lan Anh_77_x", 7.0, "tốt"), ("Bình_78_x", 5.0, None), ("C_79_x", 1.0, "")], "essay_id string, Diem double, Nhan_Xet string")
    got = workflow.prepare_declared(source, gold, found, "secret")
    by_exam = {r.exam_id: r for r in got["essays"].collect()}
    assert by_exam["De_2"].dataset_status == "quarantine_exam_conflict" and "Lan Anh" not in by_exam["De_2"].text and "77" not in by_exam["De_2"].text and by_exam["De_2"].essay_id.startswith("DM-")
    assert by_exam["De_4"].dataset_status == "quarantine_empty_text" and by_exam["De_3"].prompt_text == "Exam 3"
    corrected = workflow.prepare_declared(source, gold, found, "secret", "correct")
    assert {r.exam_id for r in corrected["essays"].collect()} == {"De_1", "De_3", "De_4"} and got["summary"].first()["count"] == 1
    with pytest.raises(Exception, match="no Diem"):
        workflow.prepare_declared(source, gold.where("Diem > 2"), found, "secret")["essays"].collect()


def test_ablation(spark, tmp_path):
    assert [r.experiment_id for r in evaluation.ablation_plan(spark).where("use_rag").orderBy("experiment_id").collect()] == ["E", "G", "H"]
    for name, shift in (("a", 0), ("b", 1)):
        (tmp_path / f"pred_{name}.csv").write_text("essay_id,total\n" + "".join(f"{i},{i + shift}\n" for i in range(1, 6)))
    gold = spark.createDataFrame([(str(i), float(i)) for i in range(1, 9)], "essay_id string, gold_total double")
    got = evaluation.ablation_summary(evaluation.predictions(spark, str(tmp_path)), gold, "essay_id", "total", "gold_total")
    assert {r.experiment_id: (r.n, r.mae) for r in got.collect()} == {"a": (5, 0.0), "b": (5, 1.0)}
    same = lambda a, b: ([1.0] * len(a),) * 3
    texts = gold.withColumn("t", F.lit("x"))
    assert tuple(evaluation.feedback_similarity(texts, texts, "essay_id", "t", same).first()) == (8, 1.0, 1.0, 1.0)
    assert evaluation.paired_interval(gold.withColumnRenamed("gold_total", "v"), gold.select("essay_id", (F.col("gold_total") - 1).alias("v")), "essay_id", "v", 50).first().estimate == -1.0


def test_ordered_fingerprint(spark):
    import hashlib

    df = spark.createDataFrame([(2, None), (1, "x")], "id long, t string")
    assert reports.ordered_fingerprint(df, ["id", "t"], ["id"]) == hashlib.sha256(b"1\x1fx\n2\x1f\n").hexdigest()


def test_self_consistency_of_odd_runs(spark):
    rows = [("e", "c", 1, "3", "mid", ["a", "b"], ["F"]), ("e", "c", 2, "junk", "low", ["c"], ["F", " "]), ("e", "c", 3, "4", "mid", ["d"], None)]
    df = spark.createDataFrame(rows, "k string, c string, run int, score string, level string, ev array<string>, fl array<string>")
    r = agreement.self_consistency(df, "k", "c", "run", "score", "level", [0.0, 2.0, 4.0], 4.0, "ev", "fl").first()
    assert (r.score, r.level, r.evidence, r.flags, r.spread) == (2.0, "mid", ["a", "b", "c"], ["F"], 1.0)


def test_scoring_plan(spark):
    df = spark.range(40).withColumnRenamed("id", "k")
    plan = sampling.scoring_plan(df, "k", ["a", "b"], anchors=[1, 2, 3])
    assert plan.where("role = 'primary'").groupBy("rater_id").count().where("count <> 20").count() == 0
    assert plan.groupBy("k", "rater_id").count().join(plan.where("role = 'anchor'").select("k"), "k", "left_anti").where("count > 1").count() == 0
    assert plan.where("role = 'anchor'").count() == 2
    with pytest.raises(ValueError):
        sampling.scoring_plan(df, "k", ["a"])


def test_report_bundle_has_office_files(spark, tmp_path):
    reports.bundle({"a": spark.createDataFrame([(1, "x & y", None)], "id long, t string, z double"), "b": spark.range(2)}, f"{tmp_path}/r.zip", "Title")
    with zipfile.ZipFile(f"{tmp_path}/r.zip") as z:
        book, doc = z.read("report.xlsx"), z.read("report.docx")
    assert documents.xlsx_rows(book)[1][:2] == ["1", "x & y"] and [r[0] for r in documents.xlsx_rows(book, 2)] == ["id", "0", "1"]
    assert documents.docx_text(doc).split("\n")[0] == "Title" and "1 | x & y | " in documents.docx_text(doc)


def test_learning_platform(spark):
    sent = []

    def send(function, params):
        if function.endswith("assignments"):
            return {"courses": [{"id": params["courseids[0]"], "assignments": [{"id": 5, "name": "one"}]}]}
        if function.endswith("submissions"):
            return {"assignments": [{"assignmentid": 5, "submissions": [{"userid": 7, "status": "submitted", "plugins": [{"editorfields": [{"text": "<p>Bài &amp; ý</p>"}]}, {}]}, {"userid": 8}]}]}
        sent.append(params["userid"])
        return {"exception": "x", "message": "no such user"} if params["userid"] == 8 else None

    assert platform.assignments(spark, send, 3).first().name == "one"
    assert [(r.user_id, r.text.strip()) for r in platform.submissions(spark, send, 5).orderBy("user_id").collect()] == [(7, "Bài & ý"), (8, "")]
    grades = spark.createDataFrame([(8, 5.0, None, True), (7, 6.0, "ok", True)], "user_id long, grade double, feedback string, approved boolean")
    assert [(r["user_id"], r["ok"], r["error"]) for r in platform.push_grades(send, grades, 5)] == [(7, True, ""), (8, False, "no such user")]
    with pytest.raises(PermissionError):
        platform.push_grades(send, grades.withColumn("approved", F.col("user_id") == 7), 5)
    assert sent == [7, 8]
    with pytest.raises(RuntimeError):
        platform.assignments(spark, lambda f, p: {"errorcode": "denied"}, 1)
