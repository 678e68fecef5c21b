"""Scoring essays by a rubric from end to end: a model for each criterion, other score sources, levels, rules, feedback."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import feedback as words
from gradeloom.operators import models
from gradeloom.operators.agreement import snap
from gradeloom.operators.traits import Trait, fit_traits, report, trait_scores
from gradeloom.plans.features import Encoder, build_features
from gradeloom.plans.rules import apply_rules, weighted_total
from gradeloom.session import cut
from gradeloom.sources.rubrics import Rubric

#: Columns of a feature table that aren't numbers to learn from.
NOT_FEATURES = {"essay_id", "total", "gold_total", "label"}


def level_name(levels: list[tuple[str, float]], score: Column) -> Column:
    """The name of the level next to a score, the first one of two; empty without levels, null for null."""
    if not levels:
        return F.lit("")
    at = F.array(*(F.struct(F.lit(float(s)).alias("s"), F.lit(n).alias("n")) for n, s in levels))
    found = F.array_min(F.transform(at, lambda x, i: F.struct(F.abs(x["s"] - score).alias("d"), i.alias("i"), x["n"].alias("n"))))["n"]
    return F.when(score.isNotNull(), found)


class Backend(Protocol):
    """Another source of scores. predict() gives (key, a column for each criterion it scores, comment, flags: array)."""

    name: str
    available: bool

    def fit(self, essays: DataFrame, gold: DataFrame) -> None: ...

    def predict(self, essays: DataFrame) -> DataFrame: ...

    def close(self) -> None: ...


@dataclass
class FunctionBackend:
    """A function of a text in the tasks as a source of scores, such as a client of a model server.

    call: text -> {criterion: score}; a criterion that is missing or isn't a number has no score.
    """

    name: str
    criteria: list[str]
    call: Callable[[str], Mapping[str, float]]
    key: str = "essay_id"
    available: bool = True

    def fit(self, essays: DataFrame, gold: DataFrame) -> None:
        """Nothing is learned."""

    def predict(self, essays: DataFrame) -> DataFrame:
        names, call = self.criteria, self.call

        @F.pandas_udf(", ".join(f"`{c}` double" for c in names))
        def score(text: pd.Series) -> pd.DataFrame:
            found = [call(t or "") or {} for t in text]
            return pd.DataFrame({c: pd.to_numeric(pd.Series([f.get(c) for f in found]), errors="coerce") for c in names})

        d = essays.select(self.key, score("text").alias("s"))
        return d.select(self.key, "s.*", F.lit("").alias("comment"), F.array().cast("array<string>").alias("flags"))

    def close(self) -> None:
        """Nothing is held."""


@dataclass
class RubricScorer:
    """A bagged model for each criterion that has labels enough, and the total of their scores."""

    rubric: Rubric
    bags: int = 5
    trees: int = 300
    algorithm: str = "trees"
    traits: dict[str, Trait] = field(default_factory=dict)

    def fit(self, rows: DataFrame, key: str, names: list[str]) -> RubricScorer:
        """rows: features with scores named as the criteria or gold_<criterion>. Under 5 labels a criterion has no model."""
        golds = {c.key: next((n for n in (c.key, f"gold_{c.key}") if n in rows.columns), None) for c in self.rubric.criteria}
        criteria = {c.key: c for c in self.rubric.criteria if golds[c.key]}
        if not criteria:
            return self
        # hinted features count twice, as far as there are any
        hinted = {k: [*names, *(h for h in c.feature_hints if h in names)] for k, c in criteria.items()}
        labels = {k: f"_gold_{k}" for k in criteria}
        rows = rows.select(key, *names, *(F.col(golds[k]).alias(v) for k, v in labels.items()))
        found = fit_traits(rows, key, {labels[k]: hinted[k] for k in criteria}, self.bags, self.trees, algorithm=self.algorithm)
        self.traits = {k: found[v] for k, v in labels.items() if v in found}
        for k, trait in self.traits.items():
            if trait.stats["n"] < 20:
                warnings.warn(f"{k} has {trait.stats['n']:.0f} labels only", stacklevel=2)
        return self

    def predict(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, <criterion>, <criterion>__std ...), each between 0 and the criterion's maximum."""
        tops = {c.key: c.max_score for c in self.rubric.criteria}
        out = trait_scores(self.traits, rows, key)
        return out.withColumns({k: F.greatest(F.lit(0.0), F.least(F.lit(float(tops[k])), F.col(k))) for k in self.traits})

    def report(self, top: int = 8) -> str:
        """For each criterion its rows, its error and the features that weigh most."""
        return report(self.traits, top)

    def total(self, scores: Mapping[str, Column]) -> Column:
        """Criteria without a score count for nothing."""
        return weighted_total(scores, {k: w for k, w in self.rubric.weights.items() if k in scores}, self.rubric.scale_max)


@dataclass
class Grader:
    """fit() on labelled essays, then score() others: one plan from texts to totals, levels, flags and feedback."""

    rubric: Rubric
    key: str = "essay_id"
    encoder: Encoder | None = None
    keywords: dict[str, list[str]] = field(default_factory=dict)
    anchors: DataFrame | None = None
    bags: int = 5
    trees: int = 300
    algorithm: str = "trees"
    clean: bool = True
    backends: dict[str, Backend] = field(default_factory=dict)
    scorer: RubricScorer | None = None
    mix: dict[str, dict[str, float]] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)

    def add_backend(self, backend: Backend) -> None:
        if backend.name == "feature":
            raise ValueError("the name feature is taken")
        self.backends[backend.name] = backend

    def features(self, df: DataFrame) -> DataFrame:
        return build_features(df, self.key, self.keywords, self.encoder, self.anchors, self.clean)

    def fit(self, df: DataFrame, gold: DataFrame, val: DataFrame | None = None, val_gold: DataFrame | None = None) -> Grader:
        """Models of the criteria from df and gold; weights of the sources from val, where there are other sources."""
        x = self.features(df)
        numeric = {"double", "float", "int", "bigint"}
        self.names = [c for c, t in x.dtypes if t in numeric and c not in NOT_FEATURES and c not in self._labels(gold) and c not in self._other(df)]
        labels = gold.select(F.col(self.key).alias("_g"), *(F.col(n) for n in self._labels(gold)))
        # read by every criterion's model
        rows = cut(x.select(self.key, *self.names).join(labels, F.col(self.key) == F.col("_g")).drop("_g"))
        self.scorer = RubricScorer(self.rubric, self.bags, self.trees, self.algorithm).fit(rows, self.key, self.names)
        for b in self.backends.values():
            b.fit(df, gold)
        if val is not None and val_gold is not None and self.backends:
            sources, parts = self._sources(cut(self.features(val)), val)
            sources = cut(sources)
            for c in self.rubric.criteria:
                label = next((n for n in (c.key, f"gold_{c.key}") if n in val_gold.columns), None)
                own = [s for s in parts if c.key in parts[s]]
                if label and own:
                    d = sources.join(val_gold.select(F.col(self.key).alias("_g"), F.col(label).alias("_gold")), F.col(self.key) == F.col("_g"))
                    d = d.select("_gold", *(F.col(f"{s}__{c.key}").alias(s) for s in own))
                    self.mix[c.key] = models.fit_mix(d, own, "_gold")
        return self

    def _labels(self, gold: DataFrame) -> list[str]:
        return [n for c in self.rubric.criteria for n in (c.key, f"gold_{c.key}") if n in gold.columns]

    def _other(self, df: DataFrame) -> set[str]:
        """Columns that came with the essays are no features, but for the two that features take over."""
        return {c for c in df.columns if c not in ("dup_ratio", "teencode_rate")}

    def _sources(self, x: DataFrame, essays: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
        """(key, <source>__<criterion>..., <criterion>__std...) and the criteria of each source."""
        parts: dict[str, list[str]] = {}
        out = x.select(self.key)
        if self.scorer and self.scorer.traits:
            parts["feature"] = list(self.scorer.traits)
            out = self.scorer.predict(x, self.key).withColumnsRenamed({k: f"feature__{k}" for k in self.scorer.traits})
        for name, b in self.backends.items():
            if not b.available:
                continue
            found = b.predict(essays)
            parts[name] = [k for k in self.rubric.keys if k in found.columns]
            own = found.select(F.col(self.key).alias("_k"), *(F.col(k).alias(f"{name}__{k}") for k in parts[name]), F.col("comment").alias(f"{name}__comment"), F.col("flags").alias(f"{name}__flags"))
            out = out.join(own, F.col(self.key) == F.col("_k"), "left").drop("_k")
        if not parts:
            raise RuntimeError("no source of scores: fit() the grader or add a backend")
        return out, parts

    def score(self, df: DataFrame, with_feedback: bool = True, messages: dict[str, str] | None = None) -> DataFrame:
        """(key, total, total_before_rules, confidence, needs_human_review, review_reason, flags, applied_rules, <criterion>, <criterion>__level ..., feedback)."""
        r, c = self.rubric, F.col
        x = cut(self.features(df))
        sources, parts = self._sources(x, df)
        d, confidences, gaps, stds = sources, [], [], []
        scored = [k for k in r.criteria if any(k.key in p for p in parts.values())]
        for k in scored:
            own = [s for s in parts if k.key in parts[s]]
            d = d.withColumnsRenamed({f"{s}__{k.key}": s for s in own})
            d = models.mixed(d, self.mix.get(k.key) or {s: models.DEFAULT_WEIGHTS.get(s, 1.0) for s in own}, k.max_score, name=f"{k.key}__raw").drop(*own)
            raw, std = c(f"{k.key}__raw"), c(f"{k.key}__std") if f"{k.key}__std" in d.columns else F.lit(0.0)
            level = snap(raw, k.scores) if k.scores else raw
            half = models.half_gap(k.scores, k.max_score)
            gap = F.least(F.lit(1.0), F.abs(raw - level) / half)
            d = d.withColumns({k.key: level, f"{k.key}__level": level_name([(v.name, v.score) for v in k.levels], level), f"{k.key}__conf": models.confidence(raw, level, F.coalesce(std, F.lit(0.0)), half), f"{k.key}__gap": gap})
            confidences.append(c(f"{k.key}__conf"))
            gaps.append(c(f"{k.key}__gap"))
            stds += [std] if f"{k.key}__std" in d.columns else []
        mean = lambda xs: sum(xs, F.lit(0.0)) / len(xs) if xs else F.lit(0.0)
        before = weighted_total({k.key: c(k.key) for k in scored}, {k.key: (k.max_score, k.weight) for k in scored}, r.scale_max)
        bonus = F.lit(0.05 if len(parts) > 1 and "llm" in parts else 0.0)
        d = d.withColumns({"total": self._stepped(before), "total_before_rules": F.round(before, 4), "confidence": F.round(F.least(F.lit(1.0), mean(confidences) + bonus), 3), "snap_gap": mean(gaps), "max_snap_gap": F.greatest(*gaps) if len(gaps) > 1 else mean(gaps), "pred_std": mean(stds)})
        noted = [c(f"{s}__flags") for s in self.backends if f"{s}__flags" in d.columns]
        comments = [c(f"{s}__comment") for s in self.backends if f"{s}__comment" in d.columns]
        d = d.withColumns({"_flags": F.flatten(F.array(*(F.coalesce(n, F.array().cast("array<string>")) for n in noted))) if noted else F.array().cast("array<string>"), "_comment": F.concat_ws("\n", *(F.nullif(n, F.lit("")) for n in comments)) if comments else F.lit("")})
        keep = [k for k in d.columns if k not in x.columns]
        full = x.drop(*(k.key for k in scored)).join(d.select(F.col(self.key).alias("_k"), *keep, *(k.key for k in scored if k.key in x.columns)), F.col(self.key) == F.col("_k")).drop("_k")
        full = apply_rules(full.drop("flags"), list(r.rules), "total", r.scale_max, {k.key: (k.max_score, k.weight) for k in scored}, {t: v for t, v in r.thresholds.items() if t in ("min_words", "max_words")})
        final = self._stepped(c("final_total"))
        full = full.withColumns({"_final": final, "flags": F.array_join(F.array_sort(F.array_distinct(F.concat(F.filter(F.split("flags", r"\|"), lambda f: f != ""), F.filter("_flags", lambda f: f != "")))), "|")})
        shown = []
        if with_feedback:
            known = [words.Criterion(k.key, k.name, k.max_score, {v.score: (v.name, v.descriptor) for v in k.levels}) for k in scored]
            text = words.feedback(known, messages or {}, c("text"), c("_final"), c("flags"), c("needs_review"), scale=r.scale_max)
            shown = [F.concat_ws("\n\n", text, F.nullif(c("_comment"), F.lit(""))).alias("feedback")]
        return full.select(self.key, c("_final").alias("total"), "total_before_rules", "confidence", c("needs_review").alias("needs_human_review"), "review_reason", "flags", "applied_rules", *(x for k in scored for x in (k.key, f"{k.key}__level")), *shown)

    def _stepped(self, x: Column) -> Column:
        """To the rubric's step, within its scale; null stays null."""
        step = self.rubric.scale_step or 0.25
        return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(self.rubric.scale_max), F.rint(x / step) * step)))

    def close(self) -> None:
        for b in self.backends.values():
            b.close()


def summary(scored: DataFrame) -> DataFrame:
    """(n, mean_total, std_total, n_review, review_rate) of score()."""
    review = F.coalesce(F.col("needs_human_review"), F.lit(False)).cast("double")
    return scored.agg(F.count("*").alias("n"), F.avg("total").alias("mean_total"), F.stddev_samp("total").alias("std_total"), F.sum(review).cast("long").alias("n_review"), F.avg(review).alias("review_rate"))
