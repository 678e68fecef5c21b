"""Toxicity by FTRL-proximal logistic regression over hashed n-grams (operator 2).

Features of a text are the distinct hashes of its words, word pairs and pairs with one word between (skip-grams), in
2**BITS places; words are lower-cased runs of letters, digits and non-ASCII bytes. FTRL-proximal keeps a learning rate
for each coordinate and sets a coordinate to zero until its evidence passes L1, so the model that goes to the tasks is a
short list of weights, at most 2**BITS and a few hundred in practice.

The model is fitted on at most MAX_ROWS labelled rows, taken by hash order (the documented bound). Only they are joined
with texts, so texts are not shuffled; scores cover whole texts of all rows.

Defined cases: null labels are not learned from; contradictory labels are rows of their own; null and empty texts get
the score of the bias; a table without labels gives every text the same score, 0.5 at most; repeated rows score alike;
doc_id may be of any type, and rows without one are scored but not learned from; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PUNCTUATION, binary, chunks, mix, prefix_hash, span_hash, table, word_spans

BITS = 20
MAX_ROWS = 20_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 6.0, 1.0, 4
THRESHOLD = 0.7
#: Bytes of text that are hashed at once (or one text): a worker needs some fifty times as much.
AT_ONCE = 1 << 19
#: One in this many rows (by crc32 of doc_id) is held out.
FOLDS, HELD_OUT = 3, 1


def held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % FOLDS) == HELD_OUT


def features(part: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the features of texts; places may repeat within a row."""
    buf, start, end, row = word_spans(part, PUNCTUATION)
    one = span_hash(prefix_hash(buf), start, end)
    rows, grams = [row], [one]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(one) > gap:
            same = row[gap:] == row[:-gap]
            grams.append(mix(one[:-gap] * np.uint64(salt) + one[gap:])[same])
            rows.append(row[gap:][same])
    return np.concatenate(rows), (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)


def fit(examples, bits: int = BITS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2, epochs=EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) from a list of (distinct places, label). The bias has no L1."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb, nb = 0.0, 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    bias = lambda: -zb / ((beta + np.sqrt(nb)) / alpha + l2)
    for _ in range(epochs):
        for places, label in examples:
            zi, ni = z[places], n[places]
            w, wb = weights(zi, ni), bias()
            p = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
            g = p - label
            z[places] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[places] = ni + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * wb
            nb += g * g
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return kept, w[kept], float(bias())


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of docs(doc_id, text) with labels(doc_id, toxic), from at most max_rows rows that are not held out."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("l_id")
    sample = usable.where(~held_out(F.col("l_id"))).orderBy(order, "l_id", "toxic").limit(max_rows)
    # max_rows bounds what is broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))

    def hashed(batches):
        for b in batches:
            labels, ids = b.column(0), b.column(1)
            for first, part in chunks(binary(b, "text"), AT_ONCE, lower=True):
                row, place = features(part)
                pair = np.unique(row << BITS | place)
                cuts = np.searchsorted(pair >> BITS, np.arange(len(part) + 1))
                places = [(pair[a:z] & ((1 << BITS) - 1)).astype("<u4").tobytes() for a, z in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([labels.slice(first, len(part)), ids.slice(first, len(part)), pa.array(places, pa.binary())], names=["toxic", "id", "places"])

    def fitted(batches):
        examples = []
        for b in batches:
            examples += [(np.frombuffer(x.as_py(), "<u4"), y.as_py()) for y, x in zip(b.column(0), b.column(1))]
        kept, w, bias = fit(examples)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1)), pa.array(np.append(w, bias))], names=["place", "w"])

    places = rows.select("toxic", F.xxhash64("doc_id").alias("id"), "text").mapInArrow(hashed, "toxic int, id long, places binary")
    # max_rows bounds what reaches this task
    model = places.repartition(1).sortWithinPartitions("id", "toxic", "places").select("toxic", "places").mapInArrow(fitted, "place long, w double").collect()
    place, w = np.array([r.place for r in model], np.int64), np.array([r.w for r in model])
    return place[place >= 0], w[place >= 0], float(w[place < 0].sum())


def score_texts(texts: pa.Array, model) -> np.ndarray:
    """Scores of a column of texts."""
    place, w, bias = model
    dense = np.zeros(1 << BITS, np.float32)
    dense[place] = w
    out = []
    for _, part in chunks(texts, AT_ONCE, lower=True):
        row, at = features(part)
        hit = dense[at] != 0
        pair = np.unique(row[hit] << BITS | at[hit])
        margin = bias + np.bincount(pair >> BITS, dense[pair & ((1 << BITS) - 1)], minlength=len(part))
        out.append(1 / (1 + np.exp(-np.clip(margin, -35, 35))))
    return np.concatenate(out) if out else np.zeros(0)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text)."""
    model = train(docs, labels, max_rows)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_texts(binary(b, "text"), model))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at least threshold, with the same columns: rows are dropped where they are read."""
    model = train(docs, labels)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(score_texts(binary(b, "text"), model) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
