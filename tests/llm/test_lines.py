"""Line dedup by runs, against a plain version, with batches, stores and odd inputs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import line_runs

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, row string, owner string, pos string, kept string, h1 string"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANK))


def plain(rows):
    """{row number: (n_lines, n_dropped, text)}; None as an id comes last."""
    order, owner = lambda d: (d is None, d or 0), {}
    for r in rows:
        for x in (r[1] or "").split("\n"):
            k = key(x)
            if len(k) >= 10 and (k not in owner or order(r[0]) < order(owner[k])):
                owner[k] = r[0]
    out = {}
    for i, r in enumerate(rows):
        lines = (r[1] or "").split("\n")
        left = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == r[0]]
        out[i] = (len(lines), len(lines) - len(left), "\n".join(left))
    return out


def cases():
    shared = ["A line that MANY share", "  a line that many share\t", "É accents stay apart, LINE", "é accents stay apart, line", "short", "İstanbul and more WORDS", "x" * 10, "y" * 9]
    rows = [(i, "\n".join(shared[(i * j) % 8] if (i + j) % 3 else f"own line {i} number {j} {i * 7 % 11}" for j in range(i % 6 + 1)), f"r{i}", "o", "p", "k", "h") for i in range(60)]
    rows += [(61, None, *"abcde"), (62, "", *"abcde"), (63, "\n\n", *"abcde"), (None, shared[0] + "\nnull id line here", *"abcde"), (None, "null id line here", *"abcde")]
    rows += [rows[5], rows[5], (5, rows[11][1], *"abcde"), (70, "\n".join(["a repeated own line"] * 3), *"abcde"), (71, "a repeated own line\nlast one", *"abcde")]
    rows += [(80, "\n".join(f"long text line {i % 700} of many" for i in range(3000)), *"abcde"), (81, "\n".join(f"Long text line {i} of many" for i in range(900)), *"abcde")]
    return rows


def collected(df):
    return sorted((str(r.row.doc_id), r.row.text or "", r.kept.n_lines, r.kept.n_dropped, r.kept.text or "") for r in df.collect())


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_lines_are_those_of_a_plain_version_whatever_the_batches(spark, batches):
    rows = cases()
    want = plain(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = collected(line_runs.dedup_lines(df, batches=batches, fanout=2))
    assert got == sorted((str(r[0]), r[1] or "", *want[i]) for i, r in enumerate(rows))


def test_texts_keep_their_columns_and_empty_tables_are_empty(spark):
    df = spark.createDataFrame(cases(), SCHEMA)
    got = line_runs.without_repeated_lines(df)
    assert got.columns == df.columns and got.where("doc_id = 61").first().text is None
    assert line_runs.without_repeated_lines(df.where("false")).count() == 0


def test_batches_added_to_an_opened_store(spark, tmp_path):
    rows = [(i, f"first of {i // 2} lines\nsecond {i % 3} line here\nalone {i} in the table") for i in range(30)]
    want = plain(rows)
    folder, got = f"file://{tmp_path}/store", {}
    for n, low in enumerate([0, 6, 12, 12, 18, 24]):  # the batch from 12 on is added twice
        store = line_runs.LineRuns(spark, folder, parts=3, fanout=2)
        docs = spark.createDataFrame([r for r in rows if low <= r[0] < low + 6], "doc_id long, text string")
        lines = line_runs.lines_of(docs)
        moving = store.add(lines)
        for r in line_runs.without_places(docs, line_runs.dropped_places(lines, moving)).collect():
            got[r.row.doc_id] = (r.kept.n_lines, r.kept.n_dropped, r.kept.text)
        store.compact()
        assert all(len(x) < 2 for x in store.levels)
        for name in store.runs():  # another session's catalog does not know them
            spark.sql(f"DROP TABLE {name}")
    assert got == want
    keys = [r for name in line_runs.LineRuns(spark, folder).runs() for r in spark.table(name).where("not seen").select("h1", "h2").collect()]
    assert len(keys) == len(set(keys)) == len({key(x) for r in rows for x in r[1].split("\n")})


def test_runs_are_looked_up_without_being_moved(spark):
    store = line_runs.LineRuns(spark, parts=int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = line_runs.lines_of(spark.createDataFrame(cases(), SCHEMA))
    store.add(lines.where("doc_id < 30"))
    run = store._read(store.runs()[0]).select("h1", "h2", F.lit(1).alias("there"))
    keys = lines.groupBy("h1", "h2").count()
    plan = keys.join(run.hint("merge"), ["h1", "h2"], "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
    store.drop()


def test_hash_of_what_is_kept(spark, tmp_path):
    rows = cases()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = line_runs.op11_line_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = sorted((str(r[0]), n, gone, hashlib.sha256(t.encode()).hexdigest()) for r, (n, gone, t) in zip(rows, plain(rows).values()))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
