"""All features of essays in one wide plan, as the scoring models and rules take them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gradeloom.functions import features, text
from gradeloom.functions.vietnamese import words
from gradeloom.operators.dedup import prompt_copy
from gradeloom.operators.traits import summed
from gradeloom.plans.pipelines import normalized
from gradeloom.session import cut, written

# The features of each criterion.
FEATURE_GROUPS = {
    "noi_dung": ["keyword_coverage", "keyword_hits", "term_density", "n_words", "content_word_ratio", "lexical_entropy", "sim_prompt", "sim_reference"],
    "lap_luan": ["n_paragraphs", "connective_density", "connective_variety", "argument_marker_density", "structure_score", "has_intro", "has_conclusion", "sentence_overlap_mean", "paragraph_overlap_mean"],
    "dien_dat": ["spell_error_rate", "confusion_rate", "informal_rate", "ttr", "mtld", "mean_sentence_len", "std_sentence_len", "pct_long_sentences", "punct_error_rate", "no_capital_sentence_rate", "diacritic_ratio"],
    "hinh_thuc": ["n_words", "has_citation", "dup_ratio", "prompt_copy_ratio", "ai_style_score", "cliche_density", "n_paragraphs"],
}


def extract_all(df: DataFrame, key: str, body: str = "text", keywords: Column | None = None, terms: tuple[str, ...] = ()) -> DataFrame:
    """df with every feature of its texts: surface, words, errors, discourse, keyword coverage. One row a key is needed.

    keywords: an array of groups with variants between bars; null or none counts as no keywords.
    """
    none = F.array().cast("array<string>")
    low = F.lower(F.coalesce(F.col(body), F.lit("")))
    wanted = F.coalesce(keywords, none) if keywords is not None else none
    d = features.discourse(features.errors(features.surface(features.with_markers(df, body), body), body), body).drop("_hits")
    d = d.withColumn("mtld", features.mtld(words(low))).withColumn("_kw", wanted)
    d = d.withColumns({"keyword_hits": text.keyword_hits(low, F.col("_kw")).cast("double"), "keyword_total": F.size("_kw").cast("double")})
    d = d.withColumn("keyword_coverage", text.ratio(F.col("keyword_hits"), F.col("keyword_total"))).drop("_kw")
    lexical = features.lexical(df.select(key, body), key, body, terms).withColumnRenamed(key, "_k")
    return d.join(lexical, F.col(key) == F.col("_k")).drop("_k")


#: An encoder gives df a column of vectors (array of doubles) for a text column.
Encoder = Callable[[DataFrame, str, str], DataFrame]


def semantic(df: DataFrame, key: str, vector: str, prompt_vector: str | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """df with sim_centroid, sim_prompt (0.5 without prompts), sim_reference and sim_reference_mean (0 without anchors).

    anchors(vector): a handful of reference texts, which become one array that is broadcast; more than 1,000 are refused.
    """
    d = features.centroid_similarity(df, vector)
    d = d.withColumn("sim_prompt", text.cosine(F.col(vector), F.col(prompt_vector)) if prompt_vector else F.lit(0.5))
    if anchors is None:
        return d.withColumns({"sim_reference": F.lit(0.0), "sim_reference_mean": F.lit(0.0)})
    if anchors.limit(1001).count() > 1000:
        raise ValueError("1,000 anchors at most")
    d = d.join(F.broadcast(anchors.agg(F.collect_list(vector).alias("_a"))))
    sims = F.transform("_a", lambda a: text.cosine(F.col(vector), a))
    d = d.withColumn("_s", sims)
    mean = F.aggregate("_s", F.lit(0.0), lambda s, x: s + x) / F.size("_s")
    some = F.size("_s") > 0
    return d.withColumns({"sim_reference": F.when(some, F.array_max("_s")).otherwise(0.0), "sim_reference_mean": F.when(some, mean).otherwise(0.0)}).drop("_a", "_s")


def char_grams(c: Column, shortest: int = 2, longest: int = 5) -> Column:
    """Runs of characters within words, a blank at either end of a word."""
    from gradeloom.operators.models import char_terms

    return char_terms(c, shortest, longest)


#: Buckets of terms, width of the sketch that directions are looked for in, places of it that a term adds to.
BUCKETS, WIDTH, PLACES = 1 << 15, 512, 4


def _sketched(ids: pd.Series, idf: np.ndarray, place: np.ndarray, sign: np.ndarray, width: int) -> np.ndarray:
    """(rows, width): sublinear counts times idf of each row's buckets, of length 1, added up by sign at each bucket's places."""
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([np.asarray(x, np.int64) for x in ids]) if sizes.sum() else np.zeros(0, np.int64)
    key, count = np.unique(np.repeat(np.arange(len(ids)), sizes) * len(idf) + flat, return_counts=True)
    row, bucket = key // len(idf), key % len(idf)
    x = (1 + np.log(count)) * idf[bucket]
    norm = np.sqrt(np.bincount(row, x * x, len(ids)))
    x = x / norm[row]
    out = np.zeros(len(ids) * width)
    for j in range(place.shape[1]):
        out += np.bincount(row * width + place[bucket, j], x * sign[bucket, j], len(ids) * width)
    return out.reshape(len(ids), width) / np.sqrt(place.shape[1])


def tfidf_encoder(components: int = 64, buckets: int = BUCKETS, width: int = WIDTH, seed: int = 42) -> Callable[[DataFrame, str], Encoder]:
    """fit(df, text) -> encoder: hashed character runs of 2 to 5, sublinear counts, idf, principal directions, length 1.

    Terms are hashed where the text is read, so no vocabulary is counted. One pass counts the texts of each bucket. A second
    one adds each text's terms up by random signs in a sketch of width numbers, which keeps products of texts to about
    1 / sqrt(width), and sums the products of the sketch's columns over all texts; their first directions are a matrix of
    width times components, which is all that projecting a text needs. Directions are those of the run.
    """
    rng = np.random.default_rng(seed)
    place, sign = rng.integers(0, width, (buckets, PLACES)), rng.choice([-1.0, 1.0], (buckets, PLACES))

    def bucketed(d: DataFrame, c: str) -> DataFrame:
        return d.withColumn("_b", F.transform(char_grams(F.coalesce(F.col(c), F.lit(""))), lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int")))

    def fit(df: DataFrame, body: str) -> Encoder:
        rows = written(bucketed(df, body).select("_b"))
        seen = rows.select(F.explode(F.array_distinct("_b")).alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()  # a row a bucket
        n, count = rows.count(), np.zeros(buckets)
        for r in seen:
            count[r.b] = r.n
        idf = np.log((1 + n) / (1 + count)) + 1

        def products(batches):
            total = np.zeros((width, width))
            for batch in batches:
                y = _sketched(batch.column(0).to_pandas(), idf, place, sign, width)
                total += y.T @ y
            return {0: total.ravel()}

        gram = summed(rows, products).get(0, np.zeros(width * width)).reshape(width, width)
        basis = np.linalg.eigh(gram)[1][:, ::-1][:, :components]

        @F.pandas_udf(ArrayType(DoubleType()))
        def project(ids: pd.Series) -> pd.Series:
            x = _sketched(ids, idf, place, sign, width) @ basis
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            return pd.Series(list(np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)))

        def encode(d: DataFrame, c: str, name: str) -> DataFrame:
            # cut, as a Python function can't be planned on top of the library's own ones
            return cut(bucketed(d, c)).withColumn(name, project("_b")).drop("_b")

        return encode

    return fit


def build_features(df: DataFrame, key: str, keywords: Mapping[str, list[str]] | None = None, encoder: Encoder | None = None, anchors: DataFrame | None = None, clean: bool = True) -> DataFrame:
    """df with all features: texts normalised, keywords by prompt_id or from the column keywords (split at semicolons).

    dup_ratio and teencode_rate are 0 where df doesn't have them. Without an encoder sim_prompt is 0.5, sim_reference 0.
    """
    d = df
    for c in ("text", "prompt_text", "prompt_id"):
        d = d.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit(""))
    if clean:
        d = d.withColumn("text", normalized(F.col("text")))
    none = F.array().cast("array<string>")
    own = F.filter(F.transform(F.split(F.coalesce(F.col("keywords").cast("string"), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "") if "keywords" in df.columns else none
    wanted = own
    if keywords:
        table = F.create_map(*(x for k, v in keywords.items() for x in (F.lit(str(k)), F.array(*map(F.lit, v)) if v else none)))
        mapped = F.coalesce(F.element_at(table, F.col("prompt_id")), none)
        wanted = F.when(F.size(mapped) > 0, mapped).otherwise(own)
    d = extract_all(d, key, "text", wanted)
    d = d.withColumn("prompt_copy_ratio", prompt_copy(F.col("text"), F.col("prompt_text")))
    for c in ("dup_ratio", "teencode_rate"):
        d = d.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0))
    if encoder is None:
        return d.withColumns({"sim_prompt": F.lit(0.5), "sim_reference": F.lit(0.0)})
    d = encoder(encoder(d, "text", "_v"), "prompt_text", "_pv")
    d = semantic(d, key, "_v", "_pv", encoder(anchors, "text", "_v") if anchors is not None else None)
    return d.withColumn("sim_prompt", F.when(F.trim("prompt_text") == "", 0.5).otherwise(F.col("sim_prompt"))).drop("_v", "_pv")
