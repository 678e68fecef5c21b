"""Structured answers: sections of an answer, scores of rubric items, final grades, and the weight of the rubric."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from gradeloom.functions.vietnamese import nfkc

#: Heads of answers ("Câu 2 b)") and of their parts ("b)").
# The patterns of heads and parts.
HEAD = re.compile(r"(?im)^\s*(?:câu|cau)\s*([1-9])\s*(?:[.\-:]?\s*([a-d]))?\s*[).:\-]?\s*")
PART = re.compile(r"(?im)(?:^|\n)\s*([a-d])\s*[).:\-]\s*")


@dataclass(frozen=True)
class Item:
    """A criterion: its key (cau_2b), maximum, expected answers between bars, and keywords of the method."""

    key: str
    max_score: float
    expected: str
    keywords: tuple[str, ...] = field(default=())


def plain(text: str) -> str:
    text = unicodedata.normalize("NFC", text).replace("\0", "").replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(re.sub(r"[ \t]+", " ", x).strip() for x in text.split("\n"))).strip()


def _between(heads: list[re.Match], body: str) -> list[str]:
    ends = [h.start() for h in heads[1:]] + [len(body)]
    return [body[h.end() : e].strip() for h, e in zip(heads, ends)]


def sections_of(text: str | None) -> dict[str, str]:
    """Text by key; the last of equal heads wins, then parts within a whole answer."""
    body = plain(text or "")
    heads = list(HEAD.finditer(body))
    found = {f"cau_{h[1]}{(h[2] or '').lower()}": part for h, part in zip(heads, _between(heads, body))}
    for key in [k for k in found if len(k) == 5]:
        parts = list(PART.finditer(found[key]))
        found |= {key + p[1].lower(): t for p, t in zip(parts, _between(parts, found[key]))}
    return found


@F.pandas_udf(MapType(StringType(), StringType()))
def sections(text: pd.Series) -> pd.Series:
    return text.map(sections_of)


def formula(c: Column) -> Column:
    """Compatibility forms, lower case, plain operators, no blanks."""
    x = F.translate(F.lower(nfkc(c)), "×·÷−", "**/-")
    return F.replace(F.regexp_replace(x, r"(?U)\s+", ""), F.lit("^"), F.lit("**"))


def formula_text(x: str) -> str:
    x = unicodedata.normalize("NFKC", x).lower().translate(str.maketrans("×·÷−", "**/-"))
    return re.sub(r"\s+", "", x).replace("^", "**")


def atoms(expected: str) -> list[str]:
    """Numbers and edges of two characters or more in an expected answer; else all of it."""
    # fixed value: the pattern
    found = [a for a in re.findall(r"\d+(?:[.,]\d+)?|\d+!|[a-z]&[a-z]", formula_text(expected)) if len(a) >= 2]
    return list(dict.fromkeys(found)) or [formula_text(expected)]


def item_scores(df: DataFrame, key: str, text: str, items: list[Item]) -> DataFrame:
    """(key, criterion, score, max_score, match_type, location, confidence, n_sections), one row an essay and item.

    The items of a rubric are few and literal: each essay is split and normalised once, and its items become an array.
    """
    base = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_s", sections("_t"))
    wanted = sorted({i.key for i in items} | {i.key[:5] for i in items})
    base = base.withColumn("_all", formula(F.col("_t")))
    base = base.withColumns({f"_m_{k}": formula(F.element_at("_s", F.lit(k))) for k in wanted})

    def one(item: Item) -> Column:
        own, parent = (F.nullif(F.element_at("_s", F.lit(k)), F.lit("")) for k in (item.key, item.key[:5]))
        at = F.when(own.isNotNull(), item.key).when(parent.isNotNull(), item.key[:5]).otherwise("whole_answer_fallback")
        norm = F.when(own.isNotNull(), F.col(f"_m_{item.key}")).when(parent.isNotNull(), F.col(f"_m_{item.key[:5]}")).otherwise(F.col("_all"))
        want = [a for a in atoms(item.expected) if a]
        hits = sum((F.contains(norm, F.lit(a)).cast("int") for a in want), F.lit(0))
        either = [formula_text(v) for v in re.split(r"\s*\|\s*", item.expected) if len(formula_text(v)) >= 2]
        exact = sum((F.contains(norm, F.lit(v)).cast("int") for v in either), F.lit(0)) > 0
        segment = F.lower(F.coalesce(own, parent, F.col("_t")))
        method = sum((F.contains(segment, F.lit(k.lower())).cast("int") for k in item.keywords), F.lit(0))
        by_method = method >= max(1, -(-len(item.keywords) // 2)) if item.keywords else F.lit(False)
        full = exact | (hits >= max(1, len(want)))
        partial = (hits * 2 >= len(want)) & F.lit(len(want) > 1)
        kind = F.when(full, "exact_answer_atoms").when(partial, "partial_answer_atoms").when(by_method, "method_keywords").otherwise("no_verified_evidence")
        score = F.when(full, item.max_score).when(partial | by_method, item.max_score * 0.5).otherwise(0.0)
        localized = at != "whole_answer_fallback"
        sure = F.when(full & localized, 0.95).when(localized, 0.60).otherwise(0.25)
        return F.struct(F.lit(item.key).alias("criterion"), F.round(score, 4).alias("score"), F.lit(float(item.max_score)).alias("max_score"), kind.alias("match_type"), at.alias("location"), sure.alias("confidence"))

    rows = base.select(key, F.size("_s").alias("n_sections"), F.explode(F.array(*map(one, items))).alias("i"))
    return rows.select(key, "i.*", "n_sections")


def clamped(x: Column, top: float = 10.0) -> Column:
    """x between 0 and top; null stays null, which least() and greatest() would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(top), x)))


def rubric_totals(scored: DataFrame, key: str) -> DataFrame:
    """(key, rubric_total, section_coverage)."""
    local = (F.col("location") != "whole_answer_fallback").cast("double")
    return scored.groupBy(key).agg(F.round(F.sum("score"), 4).alias("rubric_total"), F.round(F.avg(local), 4).alias("section_coverage"))


def final_grades(df: DataFrame, text: str, model: str, weight: float = 0.70, least: float = 0.60, step: float = 0.25) -> DataFrame:
    """df (with rubric_total and section_coverage, null where the exam is unknown) with final_total, mode, flags, needs_review.

    Without a score to go by, final_total is null and the row has the flag NO_SCORE.
    """
    if not 0 <= weight <= 1:
        raise ValueError("the weight of the rubric lies between 0 and 1")
    c = F.col
    empty = F.length(F.trim(F.coalesce(text, F.lit("")))) < 20
    enough = F.coalesce(c("section_coverage"), F.lit(0.0)) >= least
    raw = F.when(enough, weight * c("rubric_total") + (1 - weight) * c(model)).otherwise(c(model))
    final = F.when(empty, 0.0).otherwise(clamped(F.rint(raw / step) * step))
    mode = F.when(empty, "empty_rule").when(enough, "hybrid_rubric_model").otherwise("model_fallback")
    flags = {
        "UNKNOWN_EXAM": c("rubric_total").isNull(),
        "EMPTY_OR_TOO_SHORT": empty,
        "LOW_SECTION_COVERAGE": ~empty & ~enough,
        "NO_SCORE": ~empty & raw.isNull(),
        "MODEL_RUBRIC_DISAGREEMENT": F.coalesce(F.abs(c(model) - c("rubric_total")) >= 2.0, F.lit(False)),
    }
    found = F.array_join(F.array_compact(F.array(*(F.when(v, k) for k, v in flags.items()))), "|")
    return df.withColumns({"final_total": final, "mode": mode, "flags": found, "needs_review": found != ""})


def calibrate_weight(df: DataFrame, gold: str, model: str, rubric: str, coverage: str, least: float = 0.60, step: float = 0.25) -> DataFrame:
    """(weight, mae, n): mean error of each weight 0, 0.1 … 1 over validation rows; the best one is the first by (mae, weight).

    Rows without a score to go by count for no weight, so that all weights are judged on the same rows.
    """
    grid = F.explode(F.array(*(F.lit(i / 10) for i in range(11)))).alias("weight")
    usable = F.col(model).isNotNull() & (F.col(rubric).isNotNull() | ~F.coalesce(F.col(coverage) >= least, F.lit(False)))
    each = df.where(F.col(gold).isNotNull() & usable).select("*", grid)
    raw = F.when(F.coalesce(F.col(coverage) >= least, F.lit(False)), F.col("weight") * F.col(rubric) + (1 - F.col("weight")) * F.col(model)).otherwise(F.col(model))
    final = clamped(F.rint(raw / step) * step)
    return each.groupBy("weight").agg(F.avg(F.abs(F.col(gold) - final)).alias("mae"), F.count("*").alias("n"))


def best_weight(grid: DataFrame) -> DataFrame:
    """(weight, mae): 0 without rows."""
    best = grid.agg(F.min(F.struct("mae", "weight")).alias("b"))
    return best.select(F.coalesce("b.weight", F.lit(0.0)).alias("weight"), F.col("b.mae").alias("mae"))


def post_scores(df: DataFrame, criteria: dict[str, tuple[float, float, list[float]]], scale: float = 10.0, step: float = 0.25) -> DataFrame:
    """df with snapped scores and total. Criteria give weight, maximum and levels; what isn't a number counts as 0."""
    from .agreement import snap

    scores = {k: snap(F.coalesce(F.col(k).try_cast("double"), F.lit(0.0)), levels) for k, (_, _, levels) in criteria.items()}
    d = df.withColumns(scores)
    total = sum((F.col(k) / top * w * scale for k, (w, top, _) in criteria.items()), F.lit(0.0))
    return d.withColumn("total", F.rint(total / step) * step)
