"""Rubrics: read from YAML or JSON files, checked, and offered to plans as plain values or small tables."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from gradeloom.operators.structured import Item

#: Where a rubric that is named without a folder is looked for.
FOLDER = Path("rubrics")
#: Limits of a rubric that doesn't state them.
THRESHOLDS = {"min_words": 300.0, "max_words": 1500.0, "review_rate_target": 0.15}
EXAMS = ("De_1", "De_2", "De_3", "De_4", "De_5")
# Where a criterion states its answer, and how a description does.
ANSWERS = ("accepted_answers", "answers", "answer", "expected_answer")
STATED = re.compile(r"Đáp\s*số\s*chuẩn\s*:\s*(.+)", re.I)


@dataclass(frozen=True)
class Level:
    name: str
    score: float
    descriptor: str = ""
    indicators: tuple[str, ...] = ()


@dataclass(frozen=True)
class Criterion:
    key: str
    name: str
    weight: float
    max_score: float
    description: str = ""
    levels: tuple[Level, ...] = ()
    feature_hints: tuple[str, ...] = ()

    @property
    def scores(self) -> list[float]:
        return sorted({x.score for x in self.levels})


@dataclass(frozen=True)
class Rubric:
    rubric_id: str
    name: str
    scale_max: float
    scale_step: float
    criteria: tuple[Criterion, ...]
    rules: tuple[dict, ...] = ()
    meta: dict = field(default_factory=dict)
    #: The file as it was read, for fields of its own.
    raw: dict = field(default_factory=dict, repr=False)

    @property
    def keys(self) -> list[str]:
        return [c.key for c in self.criteria]

    @property
    def weights(self) -> dict[str, tuple[float, float]]:
        """name: (maximum, weight), as the rules take criteria."""
        return {c.key: (c.max_score, c.weight) for c in self.criteria}

    @property
    def thresholds(self) -> dict[str, float]:
        return THRESHOLDS | {k: float(v) for k, v in self.meta.get("thresholds", {}).items()}

    def problems(self) -> list[str]:
        """What doesn't fit together."""
        out = [] if self.criteria else ["no criteria"]
        total = sum(c.weight for c in self.criteria)
        if abs(total - 1) > 1e-6:
            out.append(f"weights sum to {total:.4f}")
        keys = self.keys
        for i, c in enumerate(self.criteria):
            if c.key in keys[:i]:
                out.append(f"{c.key} repeats")
            if not c.levels:
                out.append(f"{c.key} has no levels")
            elif abs(c.scores[-1] - c.max_score) > 1e-6:
                out.append(f"{c.key}: the top level {c.scores[-1]} isn't the maximum {c.max_score}")
        return out

    def items(self) -> list[Item]:
        """The criteria as structured answers are scored by: expected answer, and keywords of the method."""
        return [Item(str(c.get("key")), float(c.get("max_score", 0)), expected_answer(c), tuple(method_keywords(c))) for c in self.raw.get("criteria", [])]

    def answer_key(self) -> str:
        return "\n".join(f"{c.key}: {c.description}" for c in self.criteria)

    def prompt(self) -> str:
        return str(self.raw.get("prompt", self.meta.get("applies_to", self.name)))


def _parsed(path: Path) -> dict[str, Any]:
    text = path.read_text(encoding="utf-8")
    if path.suffix.lower() == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:  # JSON is YAML, too
        try:
            return json.loads(text)
        except ValueError:
            raise RuntimeError(f"{path.name}: a YAML library is needed, or the rubric as JSON") from e
    return yaml.safe_load(text) or {}


def rubric_of(raw: Mapping[str, Any], stem: str = "rubric") -> Rubric:
    """A rubric from the content of its file; warns of what doesn't fit together."""
    level = lambda x: Level(x["name"], float(x["score"]), x.get("descriptor", ""), tuple(x.get("indicators") or ()))
    criteria = tuple(
        Criterion(c["key"], c.get("name", c["key"]), float(c["weight"]), float(c["max_score"]), (c.get("description") or "").strip(), tuple(map(level, c.get("levels") or ())), tuple(c.get("feature_hints") or ()))
        for c in raw.get("criteria", [])
    )
    meta = dict(raw.get("meta") or {}) | {"thresholds": dict(raw.get("thresholds") or {})}
    found = Rubric(raw.get("rubric_id", stem), raw.get("name", stem), float(raw.get("scale_max", 10)), float(raw.get("scale_step", 0.25)), criteria, tuple(raw.get("rules") or ()), meta, dict(raw))
    if found.problems():
        warnings.warn(f"rubric {found.rubric_id}: " + "; ".join(found.problems()), stacklevel=3)
    return found


def load_rubric(path: str | Path, folder: Path = FOLDER) -> Rubric:
    """The rubric of a YAML or JSON file on the driver, or of the file of that name in a folder."""
    p = Path(path)
    if not p.exists():
        p = folder / p.name
    if not p.exists():
        raise FileNotFoundError(f"no rubric {path}")
    return rubric_of(_parsed(p), p.stem)


def exam_of(value: str) -> str:
    """The exam that a name stands for, by its first digit from 1 to 5."""
    digit = re.search("[1-5]", re.sub("[^a-z0-9_]", "", value.lower()))
    return f"De_{digit[0]}" if digit else "UNKNOWN"


def load_rubrics(folder: str | Path, exams: tuple[str, ...] = EXAMS) -> dict[str, Rubric]:
    """exam: rubric, from the YAML files of a folder whose names tell the exam; fails if one is missing."""
    found = {exam_of(p.stem): load_rubric(p) for p in sorted(Path(folder).glob("*.yaml"))}
    missing = [e for e in exams if e not in found]
    if missing:
        raise FileNotFoundError("no rubric for " + ", ".join(missing))
    return {e: r for e, r in found.items() if e != "UNKNOWN"}


def load_catalog(path: str | Path, exams: tuple[str, ...] = EXAMS) -> dict[str, Any]:
    """Exams with prompt and rubric file, from a YAML file that has to name all of them."""
    found = _parsed(Path(path))
    if set(found.get("exams", {})) != set(exams):
        raise ValueError("the catalog must have the exams " + ", ".join(exams))
    return found


def _scoring(criterion: Mapping[str, Any]) -> Mapping[str, Any]:
    found = criterion.get("automated_scoring", criterion.get("scoring", {}))
    return found if isinstance(found, Mapping) else {}


def expected_answer(criterion: Mapping[str, Any]) -> str:
    """The answer that a criterion states, several between bars; else the one in its description, else the description."""
    for place in (criterion, _scoring(criterion)):
        for key in ANSWERS:
            if place.get(key):
                value = place[key]
                return " | ".join(map(str, value)) if isinstance(value, list) else str(value)
    description = str(criterion.get("description", ""))
    stated = STATED.search(description)
    return (stated[1] if stated else description).strip()


def method_keywords(criterion: Mapping[str, Any]) -> list[str]:
    scoring = _scoring(criterion)
    return [str(k).lower() for k in scoring.get("method_keywords", scoring.get("keywords", criterion.get("keywords"))) or []]


def rubric_table(spark: SparkSession, rubrics: Mapping[str, Rubric]) -> DataFrame:
    """(exam_id, criterion, name, max_score, weight, answer), one row a criterion."""
    rows = [(e, c["key"], c.get("name", c["key"]), float(c["max_score"]), float(c["weight"]), expected_answer(c)) for e, r in rubrics.items() for c in r.raw.get("criteria", [])]
    return spark.createDataFrame(rows, "exam_id string, criterion string, name string, max_score double, weight double, answer string")


def exam_table(spark: SparkSession, rubrics: Mapping[str, Rubric]) -> DataFrame:
    """(exam_id, prompt_text, answer_key, rubric_id): what essays of an exam are joined with."""
    return spark.createDataFrame([(e, r.prompt(), r.answer_key(), r.rubric_id) for e, r in rubrics.items()], "exam_id string, prompt_text string, answer_key string, rubric_id string")


def check_rubrics(rubrics: Mapping[str, Rubric], n_criteria: int = 10) -> list[str]:
    """What is wrong with the rubrics of exams: number of criteria, sum of maxima, sum of weights."""
    out = []
    for exam, r in rubrics.items():
        if len(r.criteria) != n_criteria:
            out.append(f"{exam}: {len(r.criteria)} criteria instead of {n_criteria}")
        if abs(sum(c.max_score for c in r.criteria) - r.scale_max) > 1e-8:
            out.append(f"{exam}: the maxima sum to {sum(c.max_score for c in r.criteria)}")
        if abs(sum(c.weight for c in r.criteria) - 1) > 1e-8:
            out.append(f"{exam}: the weights sum to {sum(c.weight for c in r.criteria)}")
    return out


def handbook(rubric: Rubric, intro: str = "Score each criterion by its level; quote the essay where you take points off.") -> str:
    """A Markdown guide for raters: the criteria with their levels, the rules, and what the total is."""
    lines = [f"# {rubric.name}", "", f"- Rubric: `{rubric.rubric_id}`, version {rubric.meta.get('version', 'n/a')}", f"- Total: 0 to {rubric.scale_max:g} in steps of {rubric.scale_step:g}", "", intro, ""]
    for c in rubric.criteria:
        lines += [f"## {c.name} (`{c.key}`): weight {c.weight:.0%}, at most {c.max_score:g}", "", *([c.description, ""] if c.description else []), "| level | score | what it looks like | signs |", "|-|-|-|-|"]
        lines += [f"| {x.name} | {x.score:g} | {x.descriptor} | {'; '.join(x.indicators) or '-'} |" for x in sorted(c.levels, key=lambda x: -x.score)]
        lines.append("")
    if rubric.rules:
        lines += ["## Rules", "", *(f"- `{r.get('id', '?')}` {r.get('description', '')} (`{r.get('when', '')}`: {r.get('action', 'flag')})" for r in rubric.rules), ""]
    return "\n".join(lines)
