"""Growing stores: a store of batches is that of all rows at once; blocks lose none of the best and save work."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeloom.operators import dedup, retrieval, stores


def zipf_texts(n, size, seed):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, 2001) ** 1.05
    return [" ".join(f"word{w}" for w in rng.choice(2000, size, p=p / p.sum())) for _ in range(n)]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "c long, text string")


def rows(df, *columns):
    return sorted((*r[:-1], round(r[-1], 9)) for r in df.select(*columns).collect())


def test_an_index_of_batches_is_that_of_all_chunks(spark, tmp_path):
    texts = [*zipf_texts(60, 30, 1), "", None, "  "]
    whole = retrieval.index(frame(spark, texts), "c", "text")
    store, other = (stores.TermIndex(spark, f"file://{tmp_path}/{x}") for x in "ab")
    assert store.add(frame(spark, texts[:20]), "c", "text") == 1
    first = [rows(d, *d.columns) for d in store.view()]
    assert store.add(frame(spark, texts[20:45], 20), "c", "text") == 2
    other.add(frame(spark, texts[45:], 45), "c", "text")
    assert store.merge(other) == 3 == stores.TermIndex(spark, store.folder).version()
    for got, want in zip(store.view(), whole):
        assert rows(got, *want.columns) == rows(want, *want.columns)
    assert [rows(d, *d.columns) for d in store.view(1)] == first  # older versions stay
    with pytest.raises(ValueError, match="version 4"):
        store.view(4)


def test_a_batch_that_was_cut_short_is_not_seen(spark, tmp_path):
    store = stores.TermIndex(spark, f"file://{tmp_path}/s")
    store.add(frame(spark, ["one two", "two three"]), "c", "text")
    retrieval.counted(frame(spark, ["lost words"], 9), "c", "text").write.parquet(store.path(2, "counts"))
    assert store.version() == 1
    store.add(frame(spark, ["three four"], 2), "c", "text")
    assert {r.term for r in store.view()[1].collect()} == {"one", "two", "three", "four", "one two", "two three", "three four"}


def topics(n=40, each=16, seed=8):
    """Chunks that all use the same words, each topic stressing some of them; and what is asked about topics."""
    rng = np.random.default_rng(seed)
    chunks, asked = [], []
    for _ in range(n):
        stressed = rng.choice(200, 4, replace=False)
        for _ in range(each):
            words = [f"word{w}" for w in rng.choice(200, 60, replace=False)] + [f"word{w}" for w in stressed for _ in range(int(rng.integers(8, 14)))]
            chunks.append(" ".join(rng.permutation(words)))
        asked.append(" ".join(f"word{w}" for w in stressed))
    return chunks, asked


@pytest.mark.parametrize("made", ["zipf", "topics"])
def test_blocks_lose_none_of_the_best_and_save_work(spark, monkeypatch, made):
    monkeypatch.setattr(retrieval, "RANGE_CHUNKS", 8)
    texts, questions = topics() if made == "topics" else (zipf_texts(600, 40, 2), zipf_texts(25, 12, 3))
    chunks, asked = frame(spark, texts), frame(spark, questions).withColumnRenamed("c", "q")
    ix = retrieval.index(chunks, "c", "text")
    want = {(r.q, r.place): r.score for r in retrieval.search(asked, "q", "text", chunks, "c", "text", 3, indexed=ix).collect()}
    monkeypatch.setattr(retrieval, "SMALL", 0)
    got = {(r.q, r.place): r.score for r in retrieval.search(asked, "q", "text", chunks, "c", "text", 3, indexed=ix).collect()}
    assert got == pytest.approx(want, abs=2e-6)
    q = retrieval.weighted(retrieval.counted(asked, "q", "text"), ix[1]).select("term", F.col("id").alias("q"), F.col("w").alias("qw"))
    postings, blocks = retrieval.blocked(ix[0])
    split, likely = retrieval.reach(q, postings, blocks, F.lit(True), F.sum(F.col("qw") * F.col("w")).alias("part"), 3)
    every = q.join(postings, "term").count()
    reaching = split.where("reaches").join(postings, "term").count()
    touched = split.where("reaches").join(likely, "q").join(postings, ["term", "range"]).count()
    print(f"{made}: postings met: all {every}, by reaching terms {reaching}, in the ranges left {touched}")
    assert touched <= reaching <= every and touched < (0.9 if made == "zipf" else 0.05) * every


def test_signatures_of_batches(spark, tmp_path):
    base = zipf_texts(6, 60, 5)
    texts = [base[i % 6] + f" end{i % 4}" * (i % 3) for i in range(36)] + [None, ""]
    all_rows = frame(spark, texts)
    want = {(r.id_a, r.id_b) for r in dedup.banded_pairs(all_rows, "c", "text").collect()}
    store, got = stores.SignatureStore(spark, f"file://{tmp_path}/sig"), set()
    for low, high in ((0, 12), (12, 20), (20, 38)):
        got |= {(r.id_a, r.id_b) for r in store.add(all_rows.where((F.col("c") >= low) & (F.col("c") < high)), "c", "text").collect()}
    assert got == want
    late = stores.SignatureStore(spark, f"file://{tmp_path}/late")  # the smallest keys come last: the same families
    got = set()
    for low, high in ((20, 38), (0, 20)):
        got |= {(r.id_a, r.id_b) for r in late.add(all_rows.where((F.col("c") >= low) & (F.col("c") < high)), "c", "text").collect()}
    find = lambda pairs: {frozenset(g) for g in groups(pairs)}
    assert find(got) == find(want)


def groups(pairs):
    out = []
    for a, b in pairs:
        mine = [g for g in out if a in g or b in g]
        out = [g for g in out if g not in mine] + [{a, b}.union(*mine)]
    return out


def test_place_of_equal_scores(spark):
    chunks = frame(spark, ["same text here"] * 5)
    got = retrieval.search(frame(spark, ["same text"]).withColumnRenamed("c", "q"), "q", "text", chunks, "c", "text", 3)
    assert [r.c for r in got.orderBy("place").collect()] == [0, 1, 2] and got.select(F.max("place").over(Window.partitionBy("q"))).first()[0] == 3


def test_pdf_reports_are_well_formed():
    import re

    from gradeloom.sources.tables import pdf_bytes

    got = pdf_bytes("Báo cáo (thử)", {"bảng một": [["a", "b"], *[[i, "x" * 200] for i in range(70)]], "hai": [[None, "đủ \\ chữ"]]})
    assert got.startswith(b"%PDF-1.4") and got.endswith(b"%%EOF\n") and got.count(b"/Type /Page /Parent") == 4
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", got)]
    assert all(got[p:].startswith(f"{i} 0 obj".encode()) for i, p in enumerate(places, 1)) and int(got.split(b"startxref\n")[1].split(b"\n")[0]) == got.index(b"xref\n")
    text = got.decode("latin-1")
    for m in re.finditer(r"/Length (\d+) >>\nstream\n(.*?)\nendstream", text, re.S):
        assert len(m[2]) == int(m[1])
    assert "(Báo cáo \\(th" in text and "(bang m" in text and "du \\\\ ch" in text
