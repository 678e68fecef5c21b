"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 9).

A fingerprint's 64 bits are three segments of 22, 21 and 21 bits. When two fingerprints differ in at most two bits, one
segment is equal in both and the next one (cyclically) differs in at most two. Read as a word of the perfect (23, 12)
Golay code, a segment and each of its one-bit neighbours decode to codewords, six different ones at most; two segments
at a distance of two or less have a common neighbour (or are neighbours), so they share one of these codewords. The key is the
equal segment with the codeword's 12-bit index: up to 18 keys a fingerprint, which lose no link.

Only distinct fingerprints are keyed: copies stand behind theirs. Within a key, pairs are verified by
numpy in the task that has the key's rows and only the edges of a spanning forest leave it, so no group emits its pairs.
Keys with many fingerprints are re-keyed exactly: two fingerprints differ in two bits or less just if they share a point
of their 65-point balls of radius one, so every ball point links its group to the smallest member, as a plain grouping.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows get equal results each;
an empty table gives an empty result; other columns are ignored; doc_id may be of any type that has an order. Rows
without doc_id name no component: theirs is the smallest doc_id among the fingerprints of their component, or null.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary, components, free_name, one_fact_each, table, written

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Keys with more fingerprints than this go by ball points instead of by pairs within the task.
MANY = 4096


def _simhash(texts: pa.Array, n: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprints. bytes.lower() and bytes.split() change and split ASCII only, as asked."""
    out = np.zeros(len(texts), np.uint64)
    digest, pack = xxhash.xxh64_intdigest, np.uint64(1) << np.arange(64, dtype=np.uint64)
    for row, text in enumerate(texts):
        ws = (text.as_py() or b"").lower().split()
        if not ws:
            continue
        grams = map(b" ".join, zip(*(ws[i:] for i in range(n)))) if len(ws) >= n else [b" ".join(ws)]
        ones, total = np.zeros(64, np.int64), 0
        for block in iter(lambda g=iter(grams): [digest(x, SEED) for x in itertools.islice(g, 1 << 15)], []):
            bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for at in range(0, len(bits), 255):
                ones += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
            total += len(block)
        out[row] = pack[2 * ones > total].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, fp: long, the fingerprint's bits) for every row of docs(doc_id, text); uid names a doc_id with its text."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_simhash(binary(b, "text")).view(np.int64))], names=["doc_id", "uid", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", uid(docs).alias("uid"), "text").mapInArrow(run, f"doc_id {kind}, uid long, fp long")


def uid(docs: DataFrame) -> Column:
    """A doc_id, of any type, with its text as a number."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """decode: the 12-bit index of the codeword next to each 23-bit word; near: up to six indices of a word and its neighbours.

    The code is cyclic with generator x^11+x^9+x^7+x^6+x^5+x+1; a codeword's index is its upper twelve bits.
    """
    generator = 0b101011100011

    def remainder(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for bit in range(22, 10, -1):
            words ^= np.where(words >> bit & 1, np.int32(generator << (bit - 11)), np.int32(0))
        return words

    fix = np.zeros(1 << 11, np.int32)
    for k in range(4):
        for bits in itertools.combinations(range(23), k):
            e = sum(1 << i for i in bits)
            fix[remainder(np.array([e], np.int32))[0]] = e
    decode, block = np.empty(1 << 23, np.int16), 1 << 17  # in blocks: the table itself is all that a worker needs at once
    for at in range(0, len(decode), block):
        words = np.arange(at, at + block, dtype=np.int32)
        decode[at : at + block] = (words ^ fix[remainder(words)]) >> 11
    return decode, fix


_TABLE: list[np.ndarray] = []


def _near(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of 23-bit words and their one-bit neighbours; spare places repeat the first."""
    if not _TABLE:
        _TABLE.append(_golay_tables()[0])
    decode = _TABLE[0]
    flips = np.concatenate([[0], 1 << np.arange(23)])
    found = np.sort(decode[words[:, None] ^ flips], axis=1)
    new = np.concatenate([np.ones((len(words), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
    place = np.minimum(np.cumsum(new, axis=1) - 1, 5)
    out = np.repeat(found[:, :1], 6, axis=1)
    np.put_along_axis(out, place, found, axis=1)
    return out


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of uint64 fingerprints, each key once a row."""
    rows, keys = [], []
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    for i in range(3):
        near = _near(parts[(i + 1) % 3]).astype(np.int64)
        key = (np.int64(i) << 40) | (parts[i][:, None] << 12) | near
        fresh = np.concatenate([np.ones((len(fps), 1), bool), near[:, 1:] != near[:, :1]], axis=1)
        r, c = np.nonzero(fresh)
        rows.append(r)
        keys.append(key[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of pairs with at most MAX_BITS different bits: a breadth-first walk."""
    left, edges, queue = np.arange(len(fps)), [], []
    while len(left):
        if not queue:
            queue.append(left[0])
            left = left[1:]
        i = queue.pop()
        near = _bits(fps[left] ^ fps[i]) <= MAX_BITS
        edges += [(i, j) for j in left[near]]
        queue += [*left[near]]
        left = left[~near]
    return edges


def _linked(batches):
    """Rows (key, fp, node) sorted by key: the forest's edges of each key. A key's rows are few (see MANY)."""
    held: list[np.ndarray] = []

    def edges(key, fp, node):
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        size = ends - starts
        out_a, out_b = [], []
        two = starts[size == 2]
        two = two[_bits(fp[two] ^ fp[two + 1]) <= MAX_BITS]
        out_a.append(node[two])
        out_b.append(node[two + 1])
        for s, e in zip(starts[size > 2], ends[size > 2]):
            f = np.array(_forest(fp[s:e]), int).reshape(-1, 2) + s
            out_a.append(node[f[:, 0]])
            out_b.append(node[f[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    for b in batches:
        now = [np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64), np.asarray(b.column(2))]
        if held:
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        cut = np.searchsorted(now[0], now[0][-1])  # the last key may go on
        if cut:
            yield edges(*(x[:cut] for x in now))
        held = [x[cut:] for x in now]
    if held:
        yield edges(*held)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect just what at most MAX_BITS bits connect, of distinct(fp, node), one row a fingerprint."""

    def keyed(batches):
        for b in batches:
            fp, node = np.asarray(b.column(0)), np.asarray(b.column(1))
            for at in range(0, len(fp), 20_000):
                rows, keys = golay_keys(fp[at : at + 20_000].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at:][rows]), pa.array(node[at:][rows])], names=["key", "fp", "node"])

    keys = distinct.select("fp", "node").where("node is not null").mapInArrow(keyed, "key long, fp long, node long")
    keys = keys.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    keys = written(keys.where("n > 1"))
    few = keys.where(F.col("n") <= MANY).select("key", "fp", "node").repartition("key").sortWithinPartitions("key").mapInArrow(_linked, "a long, b long")
    balls = keys.where(F.col("n") > MANY).select("fp", "node").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(int(np.uint64(1 << i).astype(np.int64))) for i in range(64)))
    balls = balls.select("node", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    low = balls.groupBy("point").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    many = balls.join(low, "point").select(F.col("node").alias("a"), "b").where("a <> b").distinct()
    return few.unionByName(many)


def grouped(fps: DataFrame) -> DataFrame:
    """(fp, n: rows, component_id, kept: uid of the row that stays) of fps(doc_id, uid, fp), one row a fingerprint."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    distinct = written(fps.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")))
    found = components(links(distinct.select("fp", F.col("fp").alias("node")))).withColumnRenamed("node", "fp")
    named = distinct.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    best = named.groupBy("component").agg(F.min("first").alias("best"))
    return written(named.join(best, "component").select("fp", "n", F.col("best.doc_id").alias("component_id"), F.col("best.uid").alias("kept")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text)."""
    fps = written(fingerprints(docs))
    return one_fact_each(fps.select("doc_id", "fp"), grouped(fps).drop("kept"), "fp", "n").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that of its smallest doc_id (rows without doc_id last), with the same columns.

    Rows that share a doc_id but not the text are judged by their texts; equal rows are one. Texts move once.
    """
    kept = grouped(written(fingerprints(docs))).select(F.col("kept").alias(free_name(docs, "uid"))).distinct()
    (key,) = kept.columns
    return docs.withColumn(key, uid(docs)).join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
