"""Exact substring dedup by bucket-pointer refinement (operator 4).

A byte goes if some WINDOW-byte string over it also starts earlier in the corpus. Suffixes need sorting to depth WINDOW
only, and only where a bucket holds more than one string:

1. Initial q-gram buckets. Any WINDOW-byte string holds WINDOW - Q + 1 q-grams; the leftmost one of smallest hash is its
   anchor, the same wherever the string stands. Consecutive strings with one anchor form a run. A run is one row: its
   anchor's bucket, the hash of all its bytes, its place. There is one run in about (WINDOW - Q) / 2 bytes, so the rows
   of the one large shuffle are a fraction of the text; strings with different anchors differ and are never compared.
2. Buckets of one run are done: its strings stand nowhere else. In the others, equal runs are duplicates of the first one.
3. What is left are first runs of buckets that hold several: their strings share an anchor but may differ around it.
   Their bytes go to their bucket, and its strings are refined: a bucket identifier to depth d is the rank of the pair
   of identifiers to depth d/2 at the string and at the later offset d/2, found by sorting these pairs. Identifiers of a
   depth are computed once for all places that need them and reused by the next depth, from 8 bytes up to WINDOW.
   Strings with one final identifier are equal; all but the first are duplicates.

Rows that repeat within a task's chunk are judged there and dealt out at random, so a passage in a third of all documents
sends one row a chunk to its bucket. The strings of buckets of more than MANY runs go each to a bucket of its own bytes,
again once a chunk, so no task refines such a bucket.

Defined cases: null text is empty; texts shorter than WINDOW lose nothing; null doc_id sorts first; rows that repeat a
doc_id with its text get equal results and don't count as each other's duplicates; of several texts of one doc_id that of
the smaller hash is the earlier one; doc_ids may be of any type that has an order; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import binary, mix, prefix_hash, span_hash, table, written

WINDOW, Q = 100, 32
#: Runs of a bucket that a task refines; bytes of runs that are refined at once.
MANY, REFINED = 20_000, 1 << 20
#: Bits for a place within a chunk, and bytes of a chunk.
PLACE = np.uint64((1 << 22) - 1)
CHUNK = 512 << 10
LEAST = -(1 << 63)


def _pieces(ids, texts: pa.Array, limit: int = CHUNK):
    """Lists of (id, offset, bytes) with about limit bytes in all; longer texts in pieces that overlap by WINDOW - 1."""
    held, size = [], 0
    for i, t in zip(ids, texts):
        b = t.as_py() or b""
        for at in range(0, max(len(b) - WINDOW + 1, 0), limit):
            piece = b[at : at + limit + WINDOW - 1]
            if held and size + len(piece) > limit:
                yield held
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield held


def _smallest(key: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of a width."""
    n = len(key) - width + 1
    padded = np.full(-(-len(key) // width) * width, ~np.uint64(0))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _later(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marks rows whose key also has a row with a smaller (doc, at)."""
    order = np.lexsort((at, doc, key))
    k, d, a = key[order], doc[order], at[order]
    head = np.concatenate([[True], k[1:] != k[:-1]])
    first = np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))
    out = np.zeros(len(k), bool)
    out[order] = (d != d[first]) | (a != a[first])
    return out


def _spread(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64))


def _runs(held) -> tuple[np.ndarray, ...]:
    """(bucket, run, doc, first string, strings - 1, whether known to be a duplicate) of pieces."""
    buf = np.frombuffer(b"".join(b for _, _, b in held), np.uint8)
    h, n = prefix_hash(buf), len(buf)
    here = np.arange(n - Q + 1)
    grams = span_hash(h, here, here + Q)
    anchor = _smallest((grams & ~PLACE) | here.astype(np.uint64), WINDOW - Q + 1) & PLACE
    size = np.array([len(b) for _, _, b in held])
    heads = np.cumsum(size) - size
    whole = np.arange(n - WINDOW + 1) + WINDOW <= np.repeat(heads + size, size)[: n - WINDOW + 1]
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
    last = whole.copy()
    last[:-1] &= ~whole[1:] | (anchor[1:] != anchor[:-1])
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    piece = np.searchsorted(heads, lo, "right") - 1
    doc = np.array([i for i, _, _ in held], np.int64)[piece]
    first = lo - heads[piece] + np.array([o for _, o, _ in held])[piece]
    run, bucket = span_hash(h, lo, hi + WINDOW), grams[anchor[lo].astype(np.int64)]
    known = _later(run, doc, first)
    bucket = np.where(known, _spread(doc, first), bucket)
    return bucket, run, doc, first, hi - lo, known


def runs(docs: DataFrame) -> DataFrame:
    """(bucket, run, doc, place) of docs(doc, text): place holds first string, strings - 1 (7 bits), known duplicate (1 bit)."""

    def run(batches):
        for b in batches:
            for held in _pieces(b.column(0).to_pylist(), binary(b, "text")):
                bucket, key, doc, first, more, known = _runs(held)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(key.view(np.int64)), pa.array(doc), pa.array(first << 8 | more << 1 | known)], names=["bucket", "run", "doc", "place"])

    return docs.mapInArrow(run, "bucket long, run long, doc long, place long")


def bucket_ids(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Bucket identifiers, as ranks, to a depth of 8 bytes or more of the strings that start at some places."""
    if depth == 8:
        ids = np.zeros(len(at), np.uint64)
        for i in range(8):
            ids = ids << np.uint64(8) | text[at + i]
    else:
        half = 1 << (depth - 1).bit_length() - 1
        # places are marked, not sorted: a byte and a number of 32 bits for each byte of text
        needed = np.zeros(len(text), bool)
        needed[at] = True
        needed[at + depth - half] = True
        lower, number = bucket_ids(text, np.flatnonzero(needed), half), np.cumsum(needed, dtype=np.uint32)
        number -= np.uint32(1)
        del needed
        ids = lower[number[at]].astype(np.uint64)
        ids <<= np.uint64(32)
        ids |= lower[number[at + depth - half]]
        del lower, number
    order = np.argsort(ids)
    ids = ids[order]
    new = np.zeros(len(ids), np.uint32)
    new[1:] = ids[1:] != ids[:-1]
    del ids
    out = np.empty(len(order), np.uint32)
    out[order] = np.cumsum(new, dtype=np.uint32)
    return out


def _strings(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1 ... for each of several runs of n."""
    return np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _packed(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, place) of duplicate strings: neighbours as one row, up to 128 of them."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])[: len(doc)]
    since = np.arange(len(doc)) - np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0)) if len(doc) else at
    lo = np.flatnonzero(since % 128 == 0)
    n = np.diff(np.append(lo, len(doc)))
    return doc[lo], at[lo] << 8 | (n - 1) << 1 | 1


_RUN = "bucket long, doc long, place long, bytes binary"


def open_runs(texts: DataFrame) -> DataFrame:
    """(bucket, doc, place, bytes) of texts(doc, text, runs: array<struct<bucket, place, many>>); bytes: null for duplicates found on the way."""

    def run(batches):
        names = [x.split()[0] for x in _RUN.split(", ")]
        for b in batches:
            held, strings, size = [], [], 0

            def out():
                bucket, doc, place, data = (list(x) for x in zip(*held)) if held else ([], [], [], [])
                if strings:
                    buf = np.frombuffer(b"".join(x for _, _, x in strings), np.uint8)
                    sizes = np.array([len(x) for _, _, x in strings])
                    n = sizes - WINDOW + 1
                    heads = np.cumsum(sizes) - sizes
                    pos = _strings(heads, n)
                    docs, starts = np.repeat(np.array([d for d, _, _ in strings], np.int64), n), _strings(np.array([a for _, a, _ in strings]), n)
                    key = span_hash(prefix_hash(buf), pos, pos + WINDOW)
                    known = _later(key, docs, starts)
                    for d, p in zip(*_packed(docs[known], starts[known])):
                        bucket.append(int(_spread(np.array([d]), np.array([p])).view(np.int64)[0]))
                        doc.append(d)
                        place.append(p)
                        data.append(None)
                    first = ~known
                    raw = buf.tobytes()
                    bucket += key[first].view(np.int64).tolist()
                    doc += docs[first].tolist()
                    place += (starts[first] << 8).tolist()
                    data += [raw[i : i + WINDOW] for i in pos[first].tolist()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((bucket, doc, place, data), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=names)

            for d, t, runs_ in zip(b.column(0).to_pylist(), binary(b, "text"), b.column(2)):
                text, runs_ = t.as_py(), runs_.values
                for bucket, place, many in zip(*(runs_.field(i).to_pylist() for i in range(3))):
                    lo = place >> 8
                    data = text[lo : lo + (place >> 1 & 127) + WINDOW]
                    if many:
                        strings.append((d, lo, data))
                    else:
                        held.append((bucket, d, place, data))
                    size += len(data) * (20 if many else 1)
                if size > REFINED:
                    yield out()
                    held, strings, size = [], [], 0
            if held or strings:
                yield out()

    return texts.select("doc", "text", "runs").mapInArrow(run, _RUN)


def _refined(batches):
    """Rows as open_runs() gives them, sorted by bucket: (doc, place) of the strings that also start earlier."""

    def judge(rows: pa.Table) -> pa.RecordBatch:
        doc, place, data = (rows.column(i).to_pylist() for i in (1, 2, 3))
        doc, place = np.array(doc, np.int64), np.array(place, np.int64)
        known = np.array([x is None for x in data], bool)
        buf = np.frombuffer(b"".join(x for x in data if x), np.uint8)
        n = (place[~known] >> 1 & 127) + 1
        at = _strings(np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1), n)
        docs, starts = np.repeat(doc[~known], n), _strings(place[~known] >> 8, n)
        later = _later(bucket_ids(buf, at, WINDOW), docs, starts) if len(at) else np.zeros(0, bool)
        found = _packed(docs[later], starts[later])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(found, (doc[known], place[known]))], names=["doc", "place"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) > REFINED:
            rows = pa.Table.from_batches(held)
            bucket = np.asarray(rows.column(0))
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            for at in range(0, cut, 1 << 16):  # equal strings share a bucket, so a cut is moved to where one begins
                lo, hi = (int(np.searchsorted(bucket, bucket[x])) if x < cut else cut for x in (at, at + (1 << 16)))
                if lo < hi:
                    yield judge(rows.slice(lo, hi - lo))
            held = rows.slice(cut).to_batches()
    if held:
        yield judge(pa.Table.from_batches(held))


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc, place) of docs(doc, text): runs of strings that also start earlier; place as in runs()."""
    known = (F.col("place") % 2) == 1
    by = Window.partitionBy("bucket").orderBy("run", "doc", "place")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # strictly after the row before it in the same class; equal places are one document read twice
    same = lambda c: F.lag(c).over(by) == F.col(c)
    judged = runs(docs).select(
        "bucket",
        "doc",
        "place",
        (known | F.coalesce(same("run") & ~(same("doc") & same("place")), F.lit(False))).alias("later"),
        (F.first("run").over(whole) != F.last("run").over(whole)).alias("several"),
        (F.count("*").over(whole) > MANY).alias("many"),
    )
    judged = written(judged.where("later or several"))
    open_ = judged.where("not later").groupBy("doc").agg(F.collect_list(F.struct("bucket", "place", "many")).alias("runs"))
    found = open_runs(docs.join(open_, "doc").select("doc", "text", "runs"))
    found = found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_refined, "doc long, place long")
    return judged.where("later").select("doc", "place").unionByName(found)


def numbered(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (doc_id, doc: long in the order of doc_id, text without nulls); doc names one text.

    Integers stand for themselves; where they aren't, or an id has several texts, rows are numbered by doc_id, then by a
    hash of the text.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    uid = F.xxhash64("text")
    several = d.groupBy("doc_id").agg((F.min(uid) != F.max(uid)).alias("several")).where("several")
    if isinstance(docs.schema["doc_id"].dataType, IntegralType) and several.isEmpty():
        return d.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc"), "text")
    ids = d.select("doc_id", uid.alias("uid")).distinct().repartitionByRange(F.col("doc_id").asc_nulls_first(), "uid").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "uid")
    ids = written(ids.select(F.col("doc_id").alias("i_id"), F.col("uid").alias("i_uid"), F.monotonically_increasing_id().alias("doc")))
    return d.join(ids, F.col("doc_id").eqNullSafe(F.col("i_id")) & (uid == F.col("i_uid"))).select("doc_id", "doc", "text")


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, places) for every row of docs(doc_id, text); places as in runs(), null for none."""
    rows = numbered(docs)
    places = duplicates(rows.select("doc", "text")).groupBy("doc").agg(F.collect_list("place").alias("places"))
    return rows.join(places, "doc", "left").select("doc_id", "text", "places")


def spans_of(text: bytes, packed: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed runs [start, end) of a text, given its places as in runs()."""
    lo, more = packed >> 8, packed >> 1 & 127
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + more + WINDOW, -1)
    gone = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]])
    step = np.diff(gone)
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))


def suffix_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) for every row of docs(doc_id, text).

    spans: the removed runs [start, end) in bytes; kept: the bytes that stay (both null without with_text).
    """

    def run(batches):
        for b in batches:
            cols = [[] for _ in range(7)]
            for d, t, p in zip(b.column(0).to_pylist(), binary(b, "text"), b.column(2)):
                text = t.as_py()
                spans = spans_of(text, np.asarray(p.values)) if p.is_valid else []
                at, kept = 0, []
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                kept = b"".join([*kept, text[at:]])
                row = (d, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in spans] if with_text else None, kept if with_text else None)
                for c, x in zip(cols, row):
                    c.append(x)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = (b.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return removed(docs).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("spans", "kept")
