"""Stores that grow by batches: term counts behind a retrieval index, and signatures behind near duplicates.

A batch becomes a segment of its own in the store's folder, and nothing that is there is read as text again. Segments are
numbered; the last table of a segment marks it complete, so a batch that was cut short isn't seen, and a version is a
number of segments. What depends on all chunks (document frequencies, idf, vector lengths, smallest members of bands)
follows from sums and minima over the segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dedup, retrieval


class Segments:
    """Numbered segments of named tables in a folder that driver and executors share."""

    tables: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _files(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, number: int, table: str) -> str:
        return f"{self.folder}/segment-{number:06}/{table}"

    def version(self) -> int:
        """How many segments are complete."""
        number = 0
        while True:
            at, files = self._files(self.path(number + 1, self.tables[-1]) + "/_SUCCESS")
            if not files.exists(at):
                return number
            number += 1

    def write(self, **tables: DataFrame) -> int:
        """A new segment; a part of one that was cut short is overwritten."""
        number = self.version() + 1
        for name in self.tables:
            tables[name].write.mode("overwrite").parquet(self.path(number, name))
        return number

    def read(self, table: str, version: int | None = None) -> DataFrame:
        number = self.version() if version is None else version
        if not 0 < number <= self.version():
            raise ValueError(f"no version {number}")
        return self.spark.read.parquet(*(self.path(i, table) for i in range(1, number + 1)))

    def merge(self, other: Segments) -> int:
        """Takes all that another store holds as one segment."""
        return self.write(**{name: other.read(name) for name in self.tables})


class TermIndex(Segments):
    """Counts of terms by chunk, for retrieval.search(). Each chunk must be added once."""

    tables = ("counts", "terms", "size")

    def add(self, chunks: DataFrame, key: str, text: str) -> int:
        """The version with these chunks; blank ones are left out."""
        rows = chunks.where(F.trim(text) != "")
        number = self.version() + 1
        retrieval.counted(rows, key, text).write.mode("overwrite").parquet(self.path(number, "counts"))
        counts = self.spark.read.parquet(self.path(number, "counts"))
        terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
        terms.write.mode("overwrite").parquet(self.path(number, "terms"))
        rows.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(self.path(number, "size"))
        return number

    def view(self, version: int | None = None, most: int = retrieval.MOST_TERMS) -> tuple[DataFrame, DataFrame]:
        """(postings, idf) of all chunks up to a version, as retrieval.index() gives them: idf and lengths are those of all."""
        terms = self.read("terms", version).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        size = self.read("size", version).agg(F.sum("n").alias("n"))
        return retrieval.of_counts(self.read("counts", version), terms, size, most)


class SignatureStore(Segments):
    """Shingle sets and bands of signatures. A new batch meets the stored bands, not the stored texts."""

    tables = ("sets", "bands")

    def add(self, df: DataFrame, key: str, text: str, bands: int = 32, k: int = 5, threshold: float = 0.5) -> DataFrame:
        """(id_a, id_b, jaccard) of texts of the batch with those that lead their bands, stored or new; the batch is added.

        As in dedup.banded_pairs(), members of a band link to its smallest key, which is that of all batches so far.
        """
        sets = df.select(F.col(key).alias("id"), dedup.word_shingles(F.coalesce(F.col(text), F.lit("")), k).alias("s")).where(F.size("s") > 0)
        number, before = self.version() + 1, self.version()
        sets.write.mode("overwrite").parquet(self.path(number, "sets"))
        sets = self.spark.read.parquet(self.path(number, "sets"))
        banded = dedup.banded(sets, bands)
        own = banded.groupBy("band", "h").agg(F.min("id").alias("low"))
        own.write.mode("overwrite").parquet(self.path(number, "bands"))
        lows = self.read("bands", number).groupBy("band", "h").agg(F.min("low").alias("low"))
        pairs = banded.join(lows, ["band", "h"]).where("id <> low").select(F.least("id", "low").alias("id_a"), F.greatest("id", "low").alias("id_b")).distinct()
        # a smaller key of a later batch leads a band from then on: those it takes over are linked with it
        if before:
            led = self.read("bands", before).groupBy("band", "h").agg(F.min("low").alias("old"))
            pairs = pairs.unionByName(led.join(own, ["band", "h"]).where("low < old").select(F.col("low").alias("id_a"), F.col("old").alias("id_b"))).distinct()
        return dedup.alike_sets(pairs, self.read("sets", number), threshold)
