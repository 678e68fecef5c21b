"""Submissions as a stream: repeats within a watermark go, and row-local plans run on each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import quality
from gradeloom.functions.text import clean_text


def submissions(spark: SparkSession, folder: str, schema: str, per_batch: int = 100) -> DataFrame:
    """JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(folder)


def assessed(stream: DataFrame, key: str = "essay_id", text: str = "text", at: str = "submitted_at", late: str = "1 hour") -> DataFrame:
    """Cleaned texts with their verdict, the first submission of each key within the watermark."""
    once = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return quality.assess(once.withColumn(text, clean_text(F.coalesce(F.col(text), F.lit("")))), text)


def hourly(stream: DataFrame, at: str, by: str, late: str = "1 hour") -> DataFrame:
    """(window start, by, n) of events by hour; works on tables too."""
    w = F.window(at, "1 hour")
    return stream.withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), by, "n")
