import hashlib
import hmac
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from gradeloom import queries
from gradeloom.functions import text
from gradeloom.functions.pii import anonymize, keyed_digest
from gradeloom.plans.rules import UnsafeExpression, apply_rules, check_rules, compile_expression
from gradeloom.sources.tables import canonical, read_folder, read_jsonl, read_table, write_table

SF = "/root/testdata/sf0.001"


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(column.alias("x")).first().x


@pytest.mark.parametrize("name", ["resolve_gold", "qwk_observed", "krippendorff_alpha", "scoring_rules", "near_duplicate_pairs", "retrieve_passages", "student_split", "text_figures"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    want, got = con.execute(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    key = lambda df: sorted(tuple(round(v, 5) if isinstance(v, float) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))
    assert [str(r) for r in key(got)] == [str(r) for r in key(want)]


def test_normalisation(spark):
    assert one(spark, text.normalize_tone_marks(F.col("c0")), "hòa bình thủy lợi") == "hoà bình thuỷ lợi"
    out = one(spark, text.clean_text(F.col("c0")), "hayyyy quá 😀😀 !!!!")
    assert "hayyy" not in out and "😀" not in out and "!!!!" not in out
    assert one(spark, text.strip_invisible(F.col("c0")), "&amp;lt; 5 <i>x</i>\r\n") == " x \n"
    assert one(spark, text.keyword_coverage(F.col("c0"), F.array(F.lit("a|b"), F.lit("c"), F.lit("z"))), "b và c") == pytest.approx(2 / 3)


def test_personal_data(spark):
    found = one(spark, anonymize(F.col("c0")), "Họ tên: Nguyễn Văn A\nMSSV: 21A4010123\na.b@c.vn")
    assert "21A4010123" not in found.text and "a.b@c.vn" not in found.text and found.id == "21A4010123"
    want = hmac.new(b"key", b"abc", hashlib.sha256).hexdigest()[:16]
    assert one(spark, keyed_digest(F.col("c0"), "key"), "  ABC ") == want


def test_rules(spark):
    df = spark.createDataFrame([(100.0, 300.0, 8.0)], "n_words double, min_words double, total double")
    env = {c: F.col(c) for c in df.columns}
    assert df.select(compile_expression("n_words < 0.5 * min_words", env)).first()[0]
    assert df.select(compile_expression("-7 % 3 == 2 and 1 < 2 <= 2 and not 3 in [1, 2]", env)).first()[0]
    for bad in ("__import__('os')", "open('x')", "[x for x in y]", "n_words.real"):
        with pytest.raises((UnsafeExpression, KeyError)):
            compile_expression(bad, env)
    out = apply_rules(df, [{"id": "a", "when": "n_words < 200", "action": "cap_total", "value": 5, "stop": True}, {"id": "b", "when": "total > 0", "action": "set_total", "value": 1}, {"id": "c", "when": "nope > 1", "action": "flag"}]).first()
    assert (out.final_total, out.applied_rules) == (5.0, "a") and "nope" in out.skipped_rules
    assert check_rules([{"id": "a", "when": "x > 1", "action": "zap"}], ["y"]) == ["a: x is not defined", "a: unknown action zap"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 2), ("đó", 3)], "a string, b int")
    write_table(df, str(tmp_path / "t.csv"))
    assert {r.a for r in read_table(spark, str(tmp_path / "t.csv")).collect()} == {"'=1+1", "đó"}
    (tmp_path / "in" / "p1").mkdir(parents=True)
    (tmp_path / "in" / "p1" / "e1.txt").write_text("bài làm")
    row = read_folder(spark, str(tmp_path / "in")).first()
    assert (row.essay_id, row.prompt_id, row.text) == ("e1", "p1", "bài làm")
    (tmp_path / "ok.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert read_jsonl(spark, str(tmp_path / "ok.jsonl"), "a int").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnope\n')
    with pytest.raises(Exception, match="not JSON"):
        read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    assert canonical(df, {"text": ["content", "a"]}).columns == ["text", "b"]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
