"""Quality rules by cross-document line frequency (operator 3), with DataFrame functions only.

Base counts stay inside a row: no text is shuffled. For the method, a line's key is the hash of its normalised form
(lower case, runs of white space and digits folded); documents of a host that hold it are counted after each document's
own repeats are dropped, with partial sums before the shuffle. Lines of more documents than the limit are removed from
every document of that host (without_frequent_lines() gives the texts), and a document that loses too large a share of
its words is rejected as depleted.

Defined cases: null text has no words and fails the base rules; a null host is a host of its own; repeated rows count
as documents of their own; a line without words has no key; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, table, words

SYMBOLS = "#*$%&|<>"
N_GRAM, MIN_WORDS, MAX_REPEATED_PERCENT = 8, 20, 30
#: Most documents of a host that may hold a line, at least: MIN_LIMIT, or this share of the host's documents.
MIN_LIMIT, LIMIT_SHARE = 20, 0.01
#: Least share of a document's words that must be left.
MIN_LEFT = 0.5


def repeated_words(ws: Column, n: int = N_GRAM) -> Column:
    """Words in n-word windows that the array ws holds twice or more.

    A window is its 64-bit hash. Only when some hash repeats are the hashes sorted with their places; the places of
    equal neighbours, in order, then cover min(n, distance to the next) words each.
    """

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda e, k: F.get(s, k - 1)["x"].eqNullSafe(e["x"]) | F.get(s, k + 1)["x"].eqNullSafe(e["x"]))
        same = F.transform(F.array(pairs), twice)
        places = F.array_sort(F.transform(F.get(same, F.lit(0)), lambda e: e["i"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-n).cast("int").alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(n), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(places, zero, step, lambda a: a["n"])

    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.xxhash64(F.slice(ws, i, n)))
    counted = F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(ws) >= n, F.get(counted, F.lit(0))).otherwise(F.lit(0).cast("long"))


def base_counts(text: Column) -> dict[str, Column]:
    """The base columns of a text; each is an expression over one array of words, bound once."""

    def of(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.aggregate(ws, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            repeated_words(ws).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return {
        "counts": F.get(F.transform(F.array(words(text)), of), F.lit(0)),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.get(F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")), F.lit(0)),
    }


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, " "), "[0-9]+", "0"))


def line_words(text: Column) -> Column:
    """array<struct<line: long, n: int>> of the lines with words of a text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return F.transform(lines, lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("n")))


def frequent_lines(rows: DataFrame, min_limit: int = MIN_LIMIT, limit_share: float = LIMIT_SHARE) -> DataFrame:
    """(f_host, f_line): keys of the lines of rows(host, text) that more documents of a host hold than the limit."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"))
    once = rows.select("host", F.explode(F.array_distinct(F.transform(line_words(F.col("text")), lambda x: x["line"]))).alias("line"))
    # most lines occur once: sums before the limit drop them, and only lines at least at the smallest limit go on
    frequent = once.groupBy("host", "line").agg(F.count("*").alias("line_docs")).where(F.col("line_docs") > min_limit)
    limit = F.greatest(F.lit(min_limit), F.ceil(F.col("host_docs") * limit_share))
    frequent = frequent.alias("l").join(hosts.alias("h"), F.col("l.host").eqNullSafe(F.col("h.host"))).where(F.col("line_docs") > limit)
    return frequent.select(F.col("l.host").alias("f_host"), F.col("line").alias("f_line"))


def without_frequent_lines(docs: DataFrame, host: str = "source", min_limit: int = MIN_LIMIT, limit_share: float = LIMIT_SHARE) -> DataFrame:
    """docs with the frequent lines of its host taken out of each text, in the same columns; null texts stay null.

    The keys of a document's frequent lines are gathered and joined with it once.
    """
    row = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col(host), F.col("text")).alias("uid"), F.col(host).alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lines = row.select("uid", "host", F.explode(F.array_distinct(F.transform(line_words(F.col("text")), lambda x: x["line"]))).alias("line"))
    frequent = frequent_lines(row, min_limit, limit_share)
    hits = lines.join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")), "left_semi")
    gone = hits.groupBy("uid").agg(F.collect_set("line").alias("gone"))
    keep = lambda x: ~x.rlike(WORD) | ~F.array_contains("gone", F.xxhash64(normalised(x)))
    left = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(F.split("text", "\n", -1), keep), "\n"))
    return row.join(gone, "uid", "left").select(*(left.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def quality_rules(docs: DataFrame, host: str = "source", min_limit: int = MIN_LIMIT, limit_share: float = LIMIT_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """Base counts, n_removed_words (words of removed lines) and the verdicts for every row of docs(doc_id, text, host)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col(host).alias("host"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    frequent = frequent_lines(rows, min_limit, limit_share)
    lines = rows.select("doc_id", "host", "text_key", F.posexplode(line_words(F.col("text"))).alias("pos", "l")).select("doc_id", "host", "text_key", "pos", "l.*")
    hits = lines.join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")), "left_semi")
    # equal rows share one sum, in which each line counts once
    hits = hits.groupBy("doc_id", "host", "text_key", "pos").agg(F.first("n").alias("n"))
    removed = hits.groupBy("doc_id", "host", "text_key").agg(F.sum("n").alias("removed"))
    removed = removed.select(F.col("doc_id").alias("r_id"), F.col("host").alias("r_host"), F.col("text_key").alias("r_key"), "removed")
    base = base_counts(F.col("text"))
    scored = rows.select("doc_id", "host", "text_key", *(c.alias(k) for k, c in base.items())).select("doc_id", "host", "text_key", "counts.*", "n_symbols", "n_dup_lines")
    same = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key")) & F.col("host").eqNullSafe(F.col("r_host"))
    full = scored.join(removed, same, "left").withColumn("n_removed_words", F.coalesce("removed", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEATED_PERCENT) * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    full = full.withColumn("base_failed", failed).withColumn("depleted", (left.cast("double") < F.col("n_words") * F.lit(min_left)) | (left <= 0))
    return full.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("depleted")).alias("kept"), "n_removed_words", "depleted")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '{WORD}') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {N_GRAM - 1}], ' ') AS gram
      FROM w, LATERAL (SELECT unnest(range(1, len(ws) - {N_GRAM - 2})) AS i) WHERE len(ws) >= {N_GRAM}),
p AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
r AS (SELECT doc_id, sum(least({N_GRAM}, coalesce(nxt - i, {N_GRAM}))) AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM p) GROUP BY doc_id),
l AS (SELECT doc_id, host, len(regexp_extract_all(x, '{WORD}')) AS n,
             trim(regexp_replace(regexp_replace(lower(x), '{SPACE}', ' ', 'g'), '[0-9]+', '0', 'g')) AS line
      FROM (SELECT doc_id, host, unnest(ls) AS x FROM w)),
h AS (SELECT host, count(*) AS host_docs FROM d GROUP BY host),
f AS (SELECT l.host, l.line FROM l JOIN h USING (host) GROUP BY l.host, l.line, host_docs
      HAVING count(DISTINCT doc_id) > greatest({MIN_LIMIT}, ceil(host_docs * {LIMIT_SHARE}))),
x AS (SELECT doc_id, sum(n) AS removed FROM l SEMI JOIN f USING (host, line) GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(removed, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
             n_words - n_removed_words < n_words * {MIN_LEFT} OR n_words - n_removed_words <= 0 AS depleted FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT depleted AS kept, n_removed_words, depleted FROM v
"""
