import io
import json
import math
import os
import zipfile
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom import assessment_queries, queries
from gradeloom.functions import features, records, vietnamese
from gradeloom.functions.text import split_sentences
from gradeloom.operators import agreement, evaluation, models, retrieval, sampling, structured, traits
from gradeloom.plans import pipelines
from gradeloom.sources import documents
from gradeloom.streaming import submissions

SF = "/root/testdata/sf0.001"
HERE = [k for k, f in queries.QUERIES.items() if f.__module__ == assessment_queries.__name__ and k in queries.ORACLES]


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")


def column(df, c):
    return [r.x for r in df.select("id", c.alias("x")).orderBy("id").collect()]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", HERE)
def test_same_as_sql(spark, con, name):
    want, got = con.execute(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    word = lambda v: "null" if v is None or v != v else f"{v + 0.0:.5f}".replace("-0.00000", "0.00000") if isinstance(v, float) else str(v)
    key = lambda df: sorted(tuple(map(word, r)) for r in df[cols].astype(object).itertuples(index=False))
    assert key(got) == key(want)


def test_vietnamese(spark):
    d = texts(spark, "Ko được, VN đẹp; ok!", None, "")
    assert column(d, vietnamese.expand_abbreviations(F.col("text"))) == ["Không được, Việt nam đẹp; được!", None, ""]
    assert column(d, vietnamese.strip_marks("text"))[0] == "Ko duoc, VN dep; ok!"
    assert column(texts(spark, "é", None), vietnamese.nfc("text")) == ["é", None]
    words = ["nghiêng", "ngiêng", "kù", "cà", "quyển", "ghế", "gế", "phở", "xyz", "được", "pin", "pan"]
    want = [True, False, False, True, True, True, False, True, False, True, True, False]
    assert column(texts(spark, *words), vietnamese.is_syllable(F.col("text"))) == want


def test_sentences_and_features(spark):
    d = texts(spark, "Ông A. Nguyễn đến. Trước hết, vì vậy. xong", None, "")
    assert column(d, split_sentences(F.col("text")))[0] == ["Ông A.Nguyễn đến.", "Trước hết, vì vậy. xong"]
    first, null, empty = features.discourse(features.errors(features.surface(d))).orderBy("id").collect()
    assert (first.n_sentences, first.n_words, first.conn_trinh_tu, first.has_intro) == (2.0, 9.0, 1.0, 1.0)
    assert first.no_end_punct_rate == 0.5
    assert null.n_words == empty.n_words == 0.0 and null.mean_sentence_len == 0.0 and null.structure_score == empty.structure_score


def test_blanks_around_lines(spark):
    from gradeloom.functions.text import normalize_whitespace, segment_paragraphs

    d = texts(spark, " 0 a \n1 b \n\n\n\n\t2 c")
    assert column(d, normalize_whitespace(F.col("text"))) == ["0 a\n1 b\n\n2 c"]
    assert column(d, segment_paragraphs(F.col("text"))) == [["0 a \n1 b", "2 c"]]


def test_vocabulary_diversity(spark):
    ws = [f"w{(i * i) % 17}" for i in range(200)]

    def run(seq):
        count, start, seen = 0.0, 0, set()
        for i, w in enumerate(seq):
            seen.add(w)
            if len(seen) / (i - start + 1) <= 0.72:
                count, start, seen = count + 1, i + 1, set()
        if start < len(seq):
            count += (1 - len(seen) / (len(seq) - start)) / 0.28
        return len(seq) / count

    got = spark.createDataFrame([(ws,), (ws[:5],)], "w array<string>").select(features.mtld("w").alias("x")).collect()
    assert got[0].x == pytest.approx((run(ws) + run(ws[::-1])) / 2) and got[1].x == len(set(ws[:5]))


def test_lexical_by_hand(spark):
    low = "và một hai hai ba bốn".split()
    got = features.lexical(texts(spark, " ".join(low), ""), "id").orderBy("id").collect()
    c = Counter(low)
    entropy = -sum(v / 6 * math.log2(v / 6) for v in c.values())
    assert got[0].lexical_entropy == pytest.approx(entropy) and got[0].hapax_ratio == pytest.approx(4 / 5) and got[1].ttr == 0


def test_records(spark):
    raw = ['so {"total": 7.6}', '{"total": "8,25"} {"total": 1}', '{"total": 454}', '{"a": {"total": 3}} {"total": true} {"total": 2}', "7", None, '{"total": NaN}']
    assert column(texts(spark, *raw), records.total_in_json("text"))[:2] == [7.5, 8.25]
    rest = column(texts(spark, *raw), records.total_in_json("text"))[2:]
    assert rest[0] is None and rest[1] == 3.0 and rest[2:] == [None, None, None]
    assert column(texts(spark, 'x {"a": [1,],} y', "{nope"), records.repaired_json(F.col("text"))) == ['{"a": [1]}', None]
    assert column(texts(spark, " YES", "0", None, "có"), records.truth(F.col("text"))) == [True, False, False, True]
    assert column(texts(spark, "a, b;;c| "), records.flags_of_text(F.col("text"))) == [["a", "b", "c"]]
    assert column(texts(spark, "DE-01", "2023", "x", None), records.exam_name(F.col("text"))) == ["De_1", "De_2", "UNKNOWN", "UNKNOWN"]
    assert [r.exam for r in column(texts(spark, "52 QUÂN và 13 quân", "20 đường thẳng", None), records.inferred_exam(F.col("text")))] == ["De_1", "", ""]
    m = spark.createDataFrame([({"b": "1", "a": "true", "c": "no"},)], "m map<string,string>")
    assert m.select(records.flags_of_map(F.col("m")).alias("x")).first().x == ["a", "b"]
    assert records.check_rubric([{"key": "a", "weight": 0.5, "max_score": 2, "levels": [1]}, {"key": "a", "weight": 0.4, "max_score": 1, "levels": [1]}]) == ["key a repeats", "weights don't sum to 1", "a: the top level isn't the maximum"]
    d = spark.createDataFrame([("p", "t", 7.5, "train")], "p string, t string, total double, split string").withColumn("id", F.lit(1))
    row = records.instruction_records(d, "id", "p", "t", "total").first()
    assert row.input == "p\n\nt" and json.loads(row.output) == {"total": 7.5}


def test_structured_answers(spark):
    body = "Câu 1. Giải\na) 12 và 34\nb) chịu\nCâu 2. đáp số 7¹¹ × 3\nCÂU 2) lại 10/20"
    assert structured.sections_of(body) == {"cau_1": "Giải\na) 12 và 34\nb) chịu", "cau_1a": "12 và 34", "cau_1b": "chịu", "cau_2": "lại 10/20"}
    items = [structured.Item("cau_1a", 2, "12; 34"), structured.Item("cau_1b", 3, "55; 66", ("chịu",)), structured.Item("cau_2", 5, "99 | 10 / 20"), structured.Item("cau_3", 1, "12; 99")]
    got = {r.criterion: r for r in structured.item_scores(texts(spark, body, None), "id", "text", items).where("id = 0").collect()}
    assert [(got[k].score, got[k].match_type, got[k].confidence) for k in ("cau_1a", "cau_1b", "cau_2", "cau_3")] == [
        (2.0, "exact_answer_atoms", 0.95), (1.5, "method_keywords", 0.6), (5.0, "exact_answer_atoms", 0.95), (0.5, "partial_answer_atoms", 0.25)]
    total = structured.rubric_totals(structured.item_scores(texts(spark, body, None), "id", "text", items), "id").orderBy("id").collect()
    assert (total[0].rubric_total, total[0].section_coverage) == (9.0, 0.75) and total[1].section_coverage == 0
    assert structured.best_weight(spark.createDataFrame([], "weight double, mae double")).first().weight == 0.0
    snapped = structured.post_scores(spark.createDataFrame([("3.2", None), ("x", "1")], "a string, b string"), {"a": (0.5, 4, [0, 2, 4]), "b": (0.5, 1, [0, 1])}).collect()
    assert [(r.a, r.b, r.total) for r in snapped] == [(4.0, 0.0, 5.0), (0.0, 1.0, 5.0)]


def test_ridge_cuts_texts_into_terms_once_beside_the_vocabularies(spark, monkeypatch):
    calls, real = [], models._with_terms
    monkeypatch.setattr(models, "_with_terms", lambda *a: calls.append(1) or real(*a))
    t = spark.createDataFrame([(i, ("good " if i % 2 else "bad ") * 3 + f"text {i}", 9.0 if i % 2 else 3.0) for i in range(30)], "id int, text string, gold double")
    models.fit_text_ridge(t, "id", "text", "gold")
    assert len(calls) == 2  # for the vocabularies, and for counts that frequencies and model share


def test_severity_by_hand(spark):
    rng = np.random.default_rng(1)
    rows = [(int(e), int(r), float(rng.integers(0, 40)) / 4) for e in range(12) for r in rng.choice(4, 2, replace=False)]
    mu, theta, beta = np.mean([x for *_, x in rows]), dict.fromkeys(range(12), 0.0), dict.fromkeys(range(4), 0.0)
    for _ in range(30):
        theta = {e: np.mean([x - mu - beta[r] for i, r, x in rows if i == e]) for e in theta}
        beta = {r: np.mean([x - mu - theta[e] for e, i, x in rows if i == r]) for r in beta if any(i == r for _, i, _ in rows)} | {}
    got = agreement.rater_severity(spark.createDataFrame(rows, "e int, r int, x double"), "e", "r", "x").collect()
    assert {r.r: r.leniency for r in got} == pytest.approx(beta, abs=1e-9)


def test_severity_moves_cells_once(spark):
    def on_disk():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()))

    d = spark.range(200_000).select((F.col("id") % 50_000).alias("e"), (F.xxhash64("id") % 50).alias("r"), (F.col("id") % 41 / 4).alias("x"))
    before = on_disk()
    assert agreement.rater_severity(d, "e", "r", "x").count() == 99
    assert on_disk() - before < 15 << 20


def test_bootstrap_covers_the_mean(spark):
    d = spark.range(2000).withColumn("x", (F.col("id") % 10).cast("double"))
    r = evaluation.bootstrap(d, {"x": F.col("x")}, 200).first()
    se = math.sqrt(8.25 / 2000)
    assert r.estimate == 4.5 and 4.5 - 3 * se < r.low < 4.5 - se and 4.5 + se < r.high < 4.5 + 3 * se
    with pytest.raises(Exception, match="same keys"):
        evaluation.paired_delta(d.limit(2), d.limit(3), "id", "x").collect()


def test_quantile_bins_like_pandas(spark):
    import pandas as pd

    d = spark.range(8).withColumn("v", F.col("id"))
    got = [r.bin for r in sampling.quantile_bins(d, "v", "id", 3).orderBy("id").collect()]
    assert got == list(pd.qcut(pd.Series(range(1, 9)), 3, labels=False))
    assert sampling.quantile_bins(d.limit(0), "v", "id", 3).count() == 0
    pilot = sampling.stratified_pilot(spark.range(100).withColumn("n", F.col("id")), "id", "n", 20)
    assert {r.bin: r["count"] for r in pilot.groupBy("bin").count().collect()} == dict.fromkeys(range(5), 4)


def test_context_policies(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "q int, c int, place int")
    chunks = spark.createDataFrame([(10, "aaaa"), (11, "b" * 50), (12, "cc")], "c int, text string")
    skip, stop = (retrieval.context(hits, "q", chunks, "c", "text", 30, p).first() for p in ("skip", "break"))
    assert (skip.context, skip.n_passages) == ("[10] aaaa\n\n[12] cc", 2) and (stop.context, stop.n_passages) == ("[10] aaaa", 1)
    body = "\n".join(["x" * 99] * 30)
    pieces = retrieval.windows(body)
    assert max(map(len, pieces)) <= 1100 and pieces[0] == body[:1099] and pieces[-1].endswith(body[-80:])
    got = retrieval.chunked(spark.createDataFrame([("d", 1, body), ("d", 2, None), ("d", 3, body)], "d string, p int, t string"), "d", "p", "t").orderBy("piece").collect()
    assert [r.piece for r in got] == list(range(2 * len(pieces))) and [r.chunk for r in got[: len(pieces)]] == pieces


def test_models(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(5, 2, 200), rng.normal(5, 2, 200)
    d = spark.createDataFrame([(float(x), float(y), float(0.8 * x + 0.2 * y)) for x, y in zip(a, b)], "a double, b double, g double")
    w = models.fit_mix(d, ["a", "b"], "g")
    assert w == pytest.approx({"a": 0.8, "b": 0.2}, abs=1e-6) and models.fit_mix(d.limit(5), ["feature", "llm"][:0] or ["a", "b"], "g") == {"a": 0.5, "b": 0.5}
    assert models.nonnegative(np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([-1.0, 2.0])).tolist() == [0.0, 2.0]
    t = spark.createDataFrame([(i, ("tốt lắm " if i % 2 else "kém quá ") * 3 + f"bài {i}", 9.0 if i % 2 else 3.0) for i in range(40)], "id int, text string, gold double")
    model = models.fit_text_ridge(t, "id", "text", "gold", alpha=1.0)
    got = {r.id: r.total for r in model.scores(spark.createDataFrame([(1, "tốt lắm"), (2, "kém quá"), (3, None)], "id int, text string"), "id", "text").collect()}
    assert got[1] > 7 and got[2] < 5 and 5 <= got[3] <= 7
    with pytest.raises(ValueError, match="labelled rows"):
        models.fit_text_ridge(t.limit(3), "id", "text", "gold")
    f = spark.createDataFrame([(i, float(i % 7), None if i % 9 == 0 else float(i % 3), float(i % 7)) for i in range(60)], "id int, x double, y double, gold double")
    bagged = traits.fit_traits(f, "id", {"gold": ["x", "y"]}, bags=2, trees=20)["gold"]
    r = bagged.scores(f, "id").join(f.select("id", "gold"), "id").agg(F.avg(F.abs(F.col("mean") - F.col("gold")))).first()[0]
    assert r < 0.8 and traits.fit_traits(f.limit(2), "id", {"gold": ["x"]}) == {}


def test_cleaning(spark):
    good = "Học tập là một quá trình lâu dài và cần sự kiên trì của mỗi người. Vì vậy chúng ta phải cố gắng đọc sách, làm bài và hỏi thầy cô mỗi ngày."
    rows = [("a", good, "p"), ("b", good + " ", "p"), ("c", good + " Hết bài.", "p"), ("d", "ngắn", "p"), ("e", None, "p"), ("f", good, "q")]
    got = {r.essay_id: r for r in pipelines.clean(spark.createDataFrame(rows, "essay_id string, bai_lam string, prompt_id string")).collect()}
    assert {k: r.qc_decision for k, r in got.items()} == {"a": "keep", "b": "reject", "c": "keep", "d": "reject", "e": "reject", "f": "keep"}
    assert got["a"].dup_ratio == 1.0 and got["a"].dup_with == "b" and got["b"].qc_reasons == "copy_of (a)" and got["f"].dup_ratio == 0.0 and got["c"].dup_ratio > 0.8
    found = pipelines.clean_report(spark.createDataFrame(list(got.values()))).first()
    assert (found.n_input, found.n_output, found.n_rejected, found.n_exact_copies) == (6, 3, 3, 1)
    table = spark.createDataFrame([("1", good, "De 1", "val", "7"), ("2", good, "De 2", "train", "x"), ("3", good, "De 3", "train", "9"), ("4", "", "?", "train", "9")], "id string, text string, exam string, part string, score string")
    parts = pipelines.prepare(table, "id", "text", "exam", "part", "score")
    assert {r.id: r.training_eligible for r in parts["essays"].collect()} == {"1": False, "3": True}
    assert {r.id: r.reasons for r in parts["rejected"].collect()} == {"2": "invalid_or_missing_score", "4": "text_too_short|unknown_exam"}


def test_document_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('một')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('hai')}</w:body></w:document>")
    (tmp_path / "in" / "p1").mkdir(parents=True)
    (tmp_path / "in" / "p1" / "x.docx").write_bytes(docx.getvalue())
    (tmp_path / "in" / "y.docx").write_bytes(b"broken")
    (tmp_path / "in" / "z.txt").write_bytes(b"\xff ok")
    got = {r.essay_id: r for r in documents.read_documents(spark, str(tmp_path / "in")).collect()}
    assert (got["x"].text, got["x"].prompt_id, got["x"].read_error) == ("một\nhai\na | b", "p1", None)
    assert got["y"].text == "" and "BadZipFile" in got["y"].read_error and got["z"].text == "� ok" and got["z"].prompt_id == ""
    x = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {x}><si><t>id</t></si><si><t>bai lam</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {x}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="inlineStr"><is><t>chữ</t></is></c></row></sheetData></worksheet>')
    row = documents.read_xlsx(spark, str(tmp_path / "t.xlsx")).first()
    assert row.asDict() == {"id": "7", "column_1": "", "bai lam": "chữ"}
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("a.jsonl", '{"v": 9}')
        z.writestr("deep/my_dataset.jsonl", '﻿{"v": 1}\n\n{"v": 2}\n')
    assert sorted(r.v for r in documents.read_zip_jsonl(spark, str(tmp_path / "d.zip"), "v int").collect()) == [1, 2]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("a.jsonl", '{"v": 9}\nnope')
    with pytest.raises(Exception, match="not JSON in line 2"):
        documents.read_zip_jsonl(spark, str(tmp_path / "bad.zip"), "v int").collect()
    up = documents.with_text_columns(spark.createDataFrame([("x", "dài  hơn\nnhiều"), ("y", None), ("z", "cuối")], "k string, v string").coalesce(1))
    assert [(r.essay_id, r.text) for r in up.collect()] == [("HS0001", "dài hơn nhiều"), ("HS0003", "cuối")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"essay_id": "a", "text": "xin chào!!!", "submitted_at": "2024-01-01T00:00:00"}, {"essay_id": "a", "text": "lại", "submitted_at": "2024-01-01T00:05:00"}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = submissions.submissions(spark, str(tmp_path / "in"), "essay_id string, text string, submitted_at timestamp")
    q = submissions.assessed(stream).writeStream.format("memory").queryName("assessed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = spark.table("assessed").collect()
    assert len(got) == 1 and got[0].decision == "reject"


def test_exam_split(spark):
    d = spark.createDataFrame([(i, "a" if i < 100 else "b" if i < 103 else "c" if i < 105 else "d", float(i % 11)) for i in range(106)], "id int, exam string, score double")
    got = sampling.exam_split(d, "id", "exam", "score").collect()
    sizes = Counter((r.exam, r.split) for r in got)
    assert [sizes["a", s] for s in ("train", "validation", "test")] == [70, 15, 15]
    assert [sizes["b", s] for s in ("train", "validation", "test")] == [1, 1, 1] and sizes["c", "test"] == sizes["c", "train"] == 1 and sizes["d", "train"] == 1
    low = Counter(r.split for r in got if r.exam == "a" and r.score <= 4)
    assert low["validation"] >= 3 and low["test"] >= 3
    with pytest.raises(ValueError):
        sampling.exam_split(d, "id", "exam", "score", train=0.9, validation=0.2)


def test_names_and_reports(spark, tmp_path):
    from gradeloom.functions.pii import scrub_name
    from gradeloom.functions.text import missing_keywords
    from gradeloom.plans import reports

    d = spark.createDataFrame([(0, "Bài của NGUYỄN_văn An và nguyen van an", "Nguyễn Văn An"), (1, None, "x"), (2, "y", None)], "id int, text string, name string")
    assert column(d, scrub_name("text", "name")) == ["Bài của <TEN> và <TEN>", None, "y"]
    assert column(d, missing_keywords(F.col("text"), F.array(F.lit("bài|essay"), F.lit("z|w"))))[0] == ["z"]
    found = reports.bundle({"essays": d}, str(tmp_path / "out" / "r.zip"), "T <1>", ("essays", "gold"))
    assert found["missing"] == ["gold"]
    with zipfile.ZipFile(tmp_path / "out" / "r.zip") as z:
        assert "T &lt;1&gt;" in z.read("report.html").decode() and json.loads(z.read("report.json"))["tables"]["essays"]["rows_shown"] == 3
    assert reports.fingerprint(d, ["id", "text"]).first() == reports.fingerprint(d.orderBy(F.desc("id")), ["id", "text"]).first()


def test_feedback(spark):
    from gradeloom.functions.feedback import Criterion, feedback

    d = spark.createDataFrame([(0, "Chúng ta bổ xung xyzq.", 2.0, 3.75, 1.0, 200.0, 40.0, 5.0, "EMPTY|ODD", True), (1, None, 4.0, 10.0, 0.0, 0.0, 0.0, 0.0, None, False)],
                              "id int, text string, a double, total double, n_paragraphs double, n_words double, mean_sentence_len double, connective_variety double, flags string, review boolean")
    c = Criterion("a", "Content", 4.0, {1.0: ("weak", "little"), 3.0: ("fair", "some"), 4.0: ("good", "all")}, {"mid": ["go deeper.", "give examples.", "third"]})
    first, second = column(d, feedback([c], {"EMPTY": "the text is empty"}, F.col("text"), F.col("total"), F.col("flags"), F.col("review"), F.array(F.lit("cây|cối"))))
    assert first.split("\n\n") == [
        "**Total: 3.75/10**",
        "- Content: 2/4 (weak) — little Advice: go deeper. give examples.",
        "**Evidence:**\n- Suspect spellings: xyzq\n- Often confused: bổ xung -> bổ sung\n- Key points missing: cây\n- The text has no paragraphs; give each point its own.\n- Sentences are long on average; shorten them.",
        "**Notes:**\n- the text is empty\n- ODD",
        "> A teacher reviews this essay; the score is provisional.",
    ]
    assert second.split("\n\n")[:2] == ["**Total: 10/10**", "- Content: 4/4 (good) — all"] and second.endswith("asked for.")


def test_text_ridge_is_the_exact_one_and_writes_little(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["tốt", "kém", "bài", "a", "x_1", "số12", "dài-dòng", "𝒳𐐀", "É"]
    rows = [(i, " ".join(rng.choice(words, 30)), float(rng.integers(0, 11))) for i in range(60)] + [(90, None, 3.0), (91, "  ", None), (92, "tốt kém", None)]
    df = spark.createDataFrame(rows, "id int, text string, gold double").repartition(3)
    shapes, real = [], models.written
    monkeypatch.setattr(models, "written", lambda d, **k: shapes.append(dict(d.dtypes)) or real(d, **k))
    got = {r.id: r.total for r in models.fit_text_ridge(df, "id", "text", "gold", alpha=2.0).scores(df, "id", "text", None).collect()}
    # vectors in full, of fitted rows and of all rows, were written before
    assert len(shapes) == 3 and not any(t.startswith(("vector", "array", "udt")) for s in shapes for t in s.values())
    cut_up = {r.id: (r.w, r.c) for r in df.select("id", retrieval.terms(F.coalesce("text", F.lit(""))).alias("w"), models.char_terms(F.coalesce("text", F.lit(""))).alias("c")).collect()}
    fitted = [(i, y) for i, _, y in rows if y is not None]
    parts = []
    for kind in (0, 1):
        df_of = {}
        for i, _ in fitted:
            for t in set(cut_up[i][kind]):
                df_of[t] = df_of.get(t, 0) + 1
        names = sorted(t for t, n in df_of.items() if n >= 2)
        x = np.array([[cut_up[i][kind].count(t) for t in names] for i, *_ in rows], float)
        x = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * (np.log((1 + len(fitted)) / (1 + np.array([df_of[t] for t in names]))) + 1)
        parts.append(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))
    x = np.hstack(parts)
    a, y = np.array([v for v, (*_, g) in zip(x, rows) if g is not None]), np.array([g for _, g in fitted])
    w = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + 2.0 * np.eye(a.shape[1]), (a - a.mean(0)).T @ (y - y.mean()))
    want = np.clip(y.mean() + (x - a.mean(0)) @ w, 0, 10)
    assert got == pytest.approx({i: t for (i, *_), t in zip(rows, want)}, abs=1e-4)
