"""Feedback on an essay as Markdown, put together from its scores, features and flags; the wording is the caller's."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import confusions, spell_errors
from .text import missing_keywords


@dataclass(frozen=True)
class Criterion:
    """levels: score to (name, description). advice: by band (high from 80 %, mid from 50 %, low), two of each are shown."""

    key: str
    name: str
    max_score: float
    levels: dict[float, tuple[str, str]] = field(default_factory=dict)
    advice: dict[str, list[str]] = field(default_factory=dict)


#: The wording, by place; another language replaces it.
WORDING = {
    "total": "**Total: {}/{}**",
    "advice": "Advice: ",
    "evidence": "**Evidence:**",
    "spelling": "Suspect spellings: ",
    "confused": "Often confused: ",
    "missing": "Key points missing: ",
    "one_paragraph": "The text has no paragraphs; give each point its own.",
    "long_sentences": "Sentences are long on average; shorten them.",
    "few_connectives": "Few connectives; link the paragraphs.",
    "notes": "**Notes:**",
    "review": "> A teacher reviews this essay; the score is provisional.",
    "automatic": "> Scored by the rubric; a review can be asked for.",
}


def number(c: Column) -> Column:
    """Without needless zeros."""
    return F.regexp_replace(F.format_number(c, 4), r"\.?0+$", "")


def band(score: Column, top: float) -> Column:
    return F.when(score / top >= 0.8, "high").when(score / top >= 0.5, "mid").otherwise("low")


def comment(c: Criterion, score: Column) -> Column:
    """One line on a criterion: score, nearest level, advice."""
    parts = [F.concat(F.lit(f"{c.name}: "), number(score), F.lit(f"/{c.max_score:g}"))]
    if c.levels:
        at = F.array(*(F.struct(F.lit(float(s)).alias("s"), F.lit(f"({n}) — {d}").alias("t")) for s, (n, d) in c.levels.items()))
        parts.append(F.array_min(F.transform(at, lambda x, i: F.struct(F.abs(x["s"] - score).alias("d"), i.alias("i"), x["t"].alias("t"))))["t"])
    tips = F.lit(None).cast("string")
    for b, texts in c.advice.items():
        tips = F.when(band(score, c.max_score) == b, WORDING["advice"] + " ".join(texts[:2])).otherwise(tips)
    return F.concat_ws(" ", *parts, tips)


def feedback(criteria: list[Criterion], messages: dict[str, str], text: Column, total: Column, flags: Column, review: Column, keywords: Column | None = None, scale: float = 10.0, wording: dict[str, str] = WORDING) -> Column:
    """Needs columns named as the criteria, and n_paragraphs, n_words, mean_sentence_len and connective_variety.

    flags is a string with bars; unknown flags stand for themselves. Empty parts are left out; null texts count as empty.
    """
    w, t = wording, F.coalesce(text, F.lit(""))
    listed = lambda head, xs, sep: F.when(F.size(xs) > 0, F.concat(F.lit(head), F.array_join(xs, sep)))
    evidence = [
        listed(w["spelling"], spell_errors(t, 8), ", "),
        listed(w["confused"], F.slice(confusions(t), 1, 5), "; "),
        F.when((F.col("n_paragraphs") <= 1) & (F.col("n_words") > 150), w["one_paragraph"]),
        F.when(F.col("mean_sentence_len") > 35, w["long_sentences"]),
        F.when((F.col("connective_variety") < 3) & (F.col("n_words") > 200), w["few_connectives"]),
    ]
    if keywords is not None:
        evidence.insert(2, listed(w["missing"], F.slice(missing_keywords(t, keywords), 1, 8), ", "))
    known = F.create_map(*(F.lit(x) for p in messages.items() for x in p)) if messages else None
    said = lambda f: F.coalesce(F.element_at(known, f), f) if messages else f
    notes = F.transform(F.filter(F.split(F.coalesce(flags, F.lit("")), r"\|"), lambda f: f != ""), lambda f: said(f))
    block = lambda head, xs: F.when(F.size(xs) > 0, F.concat(F.lit(head + "\n- "), F.array_join(xs, "\n- ")))
    head, tail = w["total"].split("{}", 1)
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit(head), number(total), F.lit(tail.format(f"{scale:g}"))),
        F.concat(F.lit("- "), F.concat_ws("\n- ", *(comment(c, F.col(c.key)) for c in criteria))),
        block(w["evidence"], F.array_compact(F.array(*evidence))),
        block(w["notes"], notes),
        F.when(review, w["review"]).otherwise(w["automatic"]),
    )
