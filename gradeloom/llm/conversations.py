"""Prefix trie of conversations (operator 13).

A turn is hashed where it is read, so no text moves. Each conversation's turns, in order, become chained digests: that of
d turns is SHA-256 of that of d - 1 turns and the d-th turn's hash, a row a prefix. Grouping the rows by (depth, digest)
gives the nodes. Each node belongs to its smallest member; since members only leave on the way down, a conversation's
nodes are the lower end of its own path: a chain. Each chain is exploded to its ancestors once per ancestor chain, by the
lowest node of it on the path (a conversation has no more of these than turns, while a row for each node and ancestor
would grow with the square of its length), and sums from a chain's end upwards give every node its subtree.

Nodes are (smallest member, depth) from there on: whole numbers that no two nodes share, so that after the look-up of a
prefix's node (frequent ones broadcast, at most 999) no key is hot. Lists of ends are hashed as streams of sorted pieces.
Conversations themselves are read in order by one task each, digest by digest, with nothing kept of them.

Defined cases: rows without a conv_id are left out; turns of one number are ordered by their hashes, repeated rows stay;
null role and text are empty; an empty table has no conversation and no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, one_fact_each, table, written

#: A conversation's head is that of the first conversation of its group of GROUP ids: crc32 of its id modulo HEADS turns.
GROUP, HEADS = 20, 4
ROOT = hashlib.sha256(b"").digest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id: long, pos, turn_hash: 32 bytes, words) of the turns of conversations(conv_id, turn, role, text)."""
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    whole = F.sha2(F.concat(F.length(c("role")).cast("string"), F.lit(":"), c("role"), c("text")), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.unhex(whole).alias("turn_hash"), F.regexp_count(c("text"), F.lit(WORD)).cast("long").alias("words")
    )
    at = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_hash")
    return rows.select("conv_id", F.row_number().over(at).alias("pos"), "turn_hash", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, part, pos, turn_hash, words): each conversation's start (part -1, no hash), borrowed head, own turns."""
    h = lambda c: F.crc32(c.cast("string")) % HEADS
    ids = turns.select("conv_id").distinct()
    group = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(GROUP))
    heads = turns.where((F.pmod(F.col("conv_id"), F.lit(GROUP)) == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "head_id")
    # at most HEADS - 1 turns for each of at most GROUP conversations
    borrowed = ids.withColumn("head_id", group).join(heads, "head_id").where(F.col("pos") <= h(F.col("conv_id")))
    own = turns.where(F.col("pos") > h(F.col("conv_id")))
    columns = lambda df, part: df.select("conv_id", F.lit(part).alias("part"), "pos", "turn_hash", "words")
    starts = ids.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("turn_hash"), F.lit(0).cast("long").alias("words"))
    return starts.unionByName(columns(borrowed, 0)).unionByName(columns(own, 1))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, by conversation and in order; a row is held back until it is known whether it is the last."""
    names = ["conv_id", "depth", "digest", "words", "last"]
    held, digest, depth = None, ROOT, 0
    for b in batches:
        rows = []
        for conv, turn, words in zip(*(b.column(i).to_pylist() for i in range(3))):
            if turn is None:
                digest, depth = ROOT, 0
            else:
                digest, depth = hashlib.sha256(digest + turn).digest(), depth + 1
            if held:
                rows.append((*held, turn is None))
            held = (conv, depth, digest, words)
        if rows:
            yield _batch(rows, names)
    if held:
        yield _batch([(*held, True)], names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"depth": pa.int64(), "digest": pa.binary(), "last": pa.bool_(), "piece": pa.binary(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*rows))], names)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, words, last) of every prefix of every rebuilt conversation, the empty one included."""
    rows = rebuilt(turns).repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return rows.select("conv_id", "turn_hash", "words").mapInArrow(_chain, "conv_id long, depth long, digest binary, words long, last boolean")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one digest, joined: (digest, first, piece)."""
    for b in batches:
        rows: list[list] = []
        for digest, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if rows and rows[-1][0] == digest:
                rows[-1][2].append(str(conv))
            else:
                rows.append([digest, conv, [str(conv)]])
        if rows:
            yield _batch([(d, first, ",".join(ids).encode()) for d, first, ids in rows], ["digest", "first", "piece"])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each digest's pieces, which come in order."""
    now, state, names = None, hashlib.sha256(), ["digest", "ends_sha256"]
    for b in batches:
        rows = []
        for digest, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if digest == now:
                state.update(b",")
            else:
                if now is not None:
                    rows.append((now, state.hexdigest()))
                now, state = digest, hashlib.sha256()
            state.update(piece)
        if rows:
            yield _batch(rows, names)
    if now is not None:
        yield _batch([(now, state.hexdigest())], names)


def hashed_ends(paths: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the nodes at which conversations end: their ids, ascending, joined by commas.

    Ids are sorted over all tasks and joined into pieces there; the task that hashes a node's list reads its pieces.
    """
    ends = paths.where("last").select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    pieces = ends.mapInArrow(_pieces, "digest binary, first long, piece binary")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "piece").mapInArrow(_hash, "digest binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    c = F.col
    paths = written(prefixes(written(ordered_turns(conversations))))
    nodes = written(
        paths.groupBy("depth", "digest").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.count_if("last").alias("n_ends"))
        .withColumns({"saved": (c("n_convs") - 1) * c("words"), "leaf": (c("n_ends") == c("n_convs")).cast("long")})
    )
    chains = nodes.groupBy("owner").agg(F.min("depth").alias("top"), F.sum("saved").alias("saved"), F.max("leaf").alias("leaf"))
    owned = one_fact_each(paths.select("conv_id", "depth", "digest"), nodes.select("digest", "owner", "n_convs"), "digest", "n_convs")
    above = owned.where("owner <> conv_id").groupBy("conv_id", "owner").agg(F.max("depth").alias("depth"))
    chains = chains.withColumnRenamed("owner", "conv_id")
    hung = written(above.join(chains, "conv_id").withColumn("direct", (c("depth") == c("top") - 1).cast("long")))
    under = hung.groupBy("owner", "depth").agg(F.sum("saved").alias("more_saved"), F.sum("leaf").alias("more_leaves"), F.sum("direct").alias("hung"))
    parents = hung.where("direct = 1").select(c("conv_id").alias("owner"), c("owner").alias("top_parent"))
    up = Window.partitionBy("owner").orderBy(c("depth").desc())
    zero = lambda x: F.coalesce(c(x), F.lit(0).cast("long"))
    sums = lambda x: F.sum(x).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = nodes.join(under, ["owner", "depth"], "left").join(parents, "owner", "left")
    found = found.select(
        "owner", "depth", "digest", "n_convs", "top_parent",
        F.lead("depth").over(up).isNull().alias("top"),
        (zero("hung") + F.lag("depth").over(up).isNotNull().cast("long")).alias("n_children"),
        sums(c("leaf") + zero("more_leaves")).alias("n_leaves"),
        sums(c("saved") + zero("more_saved")).alias("saved_tokens"),
    )
    found = found.join(hashed_ends(paths), "digest", "left")
    return found.select(
        c("owner").alias("conv_id"), "depth", F.when(c("top"), c("top_parent")).otherwise(c("owner")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(ROOT.hex())).alias("ends_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


_CRC = (
    "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), "
    "lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
)
ORACLE = rf"""
WITH t0 AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
                   len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, h, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS pos FROM t0),
c AS (SELECT conv_id, {_CRC} % {HEADS} AS heads, conv_id - ((conv_id % {GROUP}) + {GROUP}) % {GROUP} AS base FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 1 AS part, t.pos, t.h, t.words FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.heads
      UNION ALL SELECT c.conv_id, 0, t.pos, t.h, t.words FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.heads),
q AS (SELECT conv_id, coalesce(hs, []) AS hs, coalesce(ws, []) AS ws
      FROM c LEFT JOIN (SELECT conv_id, list(h ORDER BY part, pos) AS hs, list(words ORDER BY part, pos) AS ws FROM r GROUP BY conv_id) USING (conv_id)),
p AS (SELECT conv_id, d, array_to_string(hs[1:d], ',') AS k, array_to_string(hs[1:d - 1], ',') AS up, len(hs) = d AS last, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS words
      FROM q, LATERAL (SELECT unnest(range(0, len(hs) + 1)) AS d)),
n AS (SELECT d, k, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM p GROUP BY d, k),
ch AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY d, up),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (d, k)),
s AS (SELECT a.d, a.k, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum(b.saved) AS saved_tokens
      FROM f a JOIN f b ON b.d >= a.d AND starts_with(b.k, a.k) GROUP BY a.d, a.k)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (d, k) LEFT JOIN f u ON f.d > 0 AND u.d = f.d - 1 AND u.k = f.up
"""
