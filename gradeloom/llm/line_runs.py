r"""Line dedup against levelled sorted runs of line hashes (operator 11), with DataFrame functions only.

A run is a table of the keys (two 64-bit hashes of a line's key) that some batch was the first to bring, each with its
owner, the smallest doc_id of that batch that holds it. Runs are bucketed by key and sorted, so that looking a batch up
is a merge join with each run that moves only the batch. What no run holds becomes a run of level 0; FANOUT runs of a
level are compacted into one of the next, so a batch meets few runs and a key is rewritten once a level. Owners are kept
with the keys, so adding a batch again (after a lost driver, say) drops nothing of it.

Batches come in order of doc_id. Lines whose key belongs to another document go: those keys, one row each, are joined
with the lines once, the frequent ones broadcast (at most 999 keys, each in over a thousandth of the lines), so a line in
a third of all documents isn't dealt to one task. A document's dropped places then meet its text once.

Defined cases: a null or empty text is one empty line; keys shorter than MIN_CHARS never go; rows of one doc_id (and rows
without one, which come last) are one document, each with its own row in the result; an empty table gives an empty
result; further columns, whatever their names, stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import app_folder, one_fact_each, table, written

#: Least code points of a key that may go; batches of a whole table; runs of a level that make one of the next.
MIN_CHARS, BATCHES, FANOUT = 10, 4, 3
#: Ids that place the bounds of batches: the first ones in hash order, so that the bounds need no sort of all ids.
BOUND_IDS = 1000
_BLANK, _UPPER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased (other letters are left: lower() does more than that)."""
    bare = F.btrim(line, F.lit(_BLANK))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_key, pos, h1, h2) of the lines of docs(doc_id, text) that may go; pos counts from 0."""
    rows = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return rows.select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """The runs of one store: a folder that driver and executors share, or one that goes when the driver ends.

    A folder that holds runs already is opened. parts: buckets of each new run.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, parts: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = folder or f"{app_folder(spark)}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        if folder:
            self._open()

    def _files(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _open(self) -> None:
        """Runs are known by their names, line_run_LEVEL_BUCKETS_ID; one without _SUCCESS was never finished."""
        at, files = self._files(self.folder)
        for status in files.listStatus(at) if files.exists(at) else []:
            name = status.getPath().getName()
            done = self._files(f"{self.folder}/{name}/_SUCCESS")
            if not name.startswith("line_run_") or not done[1].exists(done[0]):
                continue
            _, _, level, parts, _ = name.split("_")
            if not self.spark.catalog.tableExists(name):
                columns = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in self.spark.read.parquet(f"{self.folder}/{name}").schema)
                self.spark.sql(
                    f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (seen) CLUSTERED BY (h1, h2) SORTED BY (h1, h2) "
                    f"INTO {parts} BUCKETS LOCATION '{self.folder}/{name}'"
                )
                self.spark.catalog.recoverPartitions(name)
            self._put(int(level), name)

    def _store(self, rows: DataFrame, level: int) -> str:
        """rows(h1, h2, owner, n, moves, seen) as a table in sorted buckets, what is seen apart; the table's name."""
        name = f"line_run_{level}_{self.parts}_{uuid.uuid4().hex}"
        rows.write.partitionBy("seen").bucketBy(self.parts, *_KEY).sortBy(*_KEY).option("path", f"{self.folder}/{name}").saveAsTable(name)
        self._put(level, name)
        return name

    def _read(self, name: str) -> DataFrame:
        return self.spark.table(name).where("not seen")

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path, files = self._files(f"{self.folder}/{name}")
            files.delete(path, True)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch of lines_of(); (h1, h2, owner, n): the keys of which some line of the batch goes."""
        some = F.count("doc_id")
        keys = lines.groupBy(*_KEY).agg(
            F.min("doc_id").alias("first"), F.count("*").alias("n"),
            (~F.min("doc_id").eqNullSafe(F.max("doc_id")) | ((some > 0) & (some < F.count("*")))).alias("several"),
        )
        found, owner, seen = keys, F.col("first"), F.lit(False)
        for i, name in enumerate(self.runs()):
            # a key is in one run at most
            run = self._read(name).select(*_KEY, F.col("owner").alias(f"owner_{i}"), F.lit(True).alias(f"in_{i}"))
            found = found.join(run.hint("merge"), _KEY, "left")
            owner, seen = F.when(F.col(f"in_{i}"), F.col(f"owner_{i}")).otherwise(owner), seen | F.coalesce(f"in_{i}", F.lit(False))
        found = found.select(*_KEY, owner.alias("owner"), "n", (seen | F.col("several")).alias("moves"), seen.alias("seen"))
        return self.spark.table(self._store(found, 0)).where("moves").select(*_KEY, "owner", "n")

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def compact(self) -> None:
        """Merges the runs of each full level into one of the next. What add() gave before must have been used by then."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old = self.levels[level]
                rows = self._read(old[0])
                for name in old[1:]:
                    rows = rows.unionByName(self._read(name))
                self._store(rows.withColumn("moves", F.lit(False)).repartition(self.parts, *_KEY), level + 1)
                self.levels[level] = []
                self._drop(old)
            level += 1

    def drop(self) -> None:
        self._drop(self.runs())
        self.levels = []


def dropped_places(lines: DataFrame, moving: DataFrame) -> DataFrame:
    """(doc_id, text_key, gone: array of pos) of the rows that lose lines; moving: one (h1, h2, owner, n) a key."""
    gone = one_fact_each(lines, moving, _KEY, "n").where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    # equal rows share an entry
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("gone"))


def without_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """docs with two columns put before its own, struct(text, n_lines, n_dropped) and the row: (kept, row)."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("d_id"), F.xxhash64(text).alias("d_key"))
    found = rows.join(places, F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_key") == F.col("text_key")), "left")

    def kept(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.struct(
            F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")).alias("text"),
            F.size(lines).cast("long").alias("n_lines"),
            F.coalesce(F.size("gone").cast("long"), F.lit(0).cast("long")).alias("n_dropped"),
        )

    split = F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1)
    return found.select(F.get(F.transform(F.array(split), kept), F.lit(0)).alias("kept"), "row")


def bounds(docs: DataFrame, batches: int) -> list:
    """At most batches - 1 ids that part docs by doc_id into batches of about equal numbers of ids."""
    some = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(BOUND_IDS)
    ids = sorted(r.doc_id for r in some.collect())
    return sorted({ids[len(ids) * i // batches] for i in range(1, batches)}) if ids else []


def dedup_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS, fanout: int = FANOUT) -> DataFrame:
    """(kept: struct(text, n_lines, n_dropped), row: struct of its columns) of every row of docs(doc_id, text).

    The table goes through a store of its own in batches by doc_id; which batches doesn't change the result.
    """
    store = LineRuns(docs.sparkSession, fanout=fanout)
    lines = written(lines_of(docs, min_chars))
    cuts, moving = bounds(docs, batches), []
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = lines
        if low is not None:
            batch = batch.where((F.col("doc_id") >= low) | F.col("doc_id").isNull() if high is None else F.col("doc_id") >= low)
        if high is not None:
            batch = batch.where(F.col("doc_id") < high)
        moving.append(store.add(batch))
        if len(store.levels[0]) >= fanout and high is not None:
            moving = [_merged(moving)]
            store.compact()
    places = written(dropped_places(lines, _merged(moving)))
    store.drop()
    return without_places(docs, places)


def _merged(moving: list[DataFrame]) -> DataFrame:
    """One row a key of several batches' keys; a key has the same owner in all."""
    rows = moving[0]
    for more in moving[1:]:
        rows = rows.unionByName(more)
    return written(rows.groupBy(*_KEY).agg(F.min("owner").alias("owner"), F.sum("n").alias("n")))


def without_repeated_lines(docs: DataFrame, **how: int) -> DataFrame:
    """docs, in its columns, with lines that an earlier document holds taken out of the texts."""
    return dedup_lines(docs, **how).select(*(F.col("kept.text").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sha = F.sha2(F.coalesce(F.col("kept.text"), F.lit("")), 256)
    return dedup_lines(docs).select(F.col("row.doc_id").alias("doc_id"), F.col("kept.n_lines").alias("n_lines"), F.col("kept.n_dropped").alias("n_dropped"), sha.alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, pos, ls[pos] AS line,
             translate(trim(ls[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_UPPER.lower()}') AS key
      FROM d, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS pos)),
o AS (SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.doc_id, l.pos, l.line, o.owner IS NOT NULL AND o.owner <> l.doc_id AS gone FROM l LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
