"""Shared pieces of the training-data operators: tables, words, hashes of byte runs, cut lineage, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.session import app_folder, shared_dir, written  # noqa: F401  (the operators take them from here)

#: What separates words everywhere in this subpackage, and what words are (Java, RE2 and Python read both alike).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for the small tables of loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def words(text: Column) -> Column:
    """array<string> of the words of a text without nulls."""
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def one_fact_each(rows: DataFrame, facts: DataFrame, key: str | list[str], count: str) -> DataFrame:
    """rows joined with facts(key, count, ...), one row a key without nulls; count: the key's rows.

    At most HOT keys hold over 1/HOT of all rows each: those facts are broadcast, so a key in a third of all rows isn't
    dealt to one task; the others are joined as usual.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) * HOT > F.lit(total)
    hot = F.broadcast(facts.where(often).drop(count))
    rest = rows.join(hot.select(*[key] if isinstance(key, str) else key), key, "left_anti").join(facts.where(~often).drop(count), key)
    return rows.join(hot, key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b: long), component being its smallest reachable node.

    Alternates large-star and small-star steps: minima are pre-aggregated per task, so a hub costs no single task
    the whole of its edges. A checkpoint cuts each round; rounds grow with the logarithm of the longest path.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "u", "m")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        # done when every node points at one smallest node and no smallest node points on
        many = new.groupBy("u").count().where("count > 1")
        chained = new.join(new.select(F.col("u").alias("v")), "v", "left_semi")
        pairs = new
        if many.isEmpty() and chained.isEmpty():
            break
    top = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(top)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df has not, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


# --- runs of bytes, by numpy -----------------------------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between bare words: all of ASCII but letters and digits.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i <= n, modulo 2**64."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(1 << n.bit_length(), 1 << 20)
        for name, base in (("up", _P), ("down", _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial of buf[:i]; see span_hash()."""
    up, _ = _powers(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each run [start, end): equal for equal bytes at any place."""
    _, down = _powers(len(h))
    return mix((h[end] - h[start]) * down[start])


def chunks(texts: pa.Array, limit: int = 2 << 20, lower: bool = False):
    """(first row, list of bytes) of runs of rows with about limit bytes in all. Null texts are empty."""
    part, size, first = [], 0, 0
    for i, x in enumerate(texts):
        b = x.as_py() or b""
        if lower:
            b = b.lower() if b.isascii() else b.decode("utf-8", "replace").lower().encode()
        if part and size + len(b) > limit:
            yield first, part
            part, size, first = [], 0, i
        part.append(b)
        size += len(b)
    if part:
        yield first, part


def word_spans(part: list[bytes], between: np.ndarray = _SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, word starts, word ends, row of each word) of texts, which a space separates in the buffer."""
    buf = np.frombuffer(b" ".join(part) + b" ", np.uint8)
    inside = np.zeros(len(buf) + 1, np.int8)  # the buffer ends in a space
    inside[1:] = ~between[buf]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    heads = np.concatenate([[0], np.cumsum([len(b) + 1 for b in part])[:-1]])
    return buf, start, end, np.searchsorted(heads, start, "right") - 1


def hashed_words(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words of texts."""
    buf, start, end, row = word_spans(part, PUNCTUATION)
    return span_hash(prefix_hash(buf), start, end), row


def long_words(text: bytes, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of one lower-cased text, read block by block: working memory follows the block."""
    out, at = [], 0
    while at < len(text):
        end = min(at + block, len(text))
        while end < len(text) and not PUNCTUATION[text[end]]:
            end += 1
        buf, start, stop, _ = word_spans([text[at:end]], PUNCTUATION)
        out.append((span_hash(prefix_hash(buf), start, stop), start + at, stop + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def words_of(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words of texts; a text by itself is read block by block."""
    if len(part) > 1:
        return hashed_words(part)
    words = long_words(part[0])[0]
    return words, np.zeros(len(words), np.int64)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of a sequence of word hashes."""
    size = max(len(words) - n + 1, 0)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + size]
    return mix(out)


def binary(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
