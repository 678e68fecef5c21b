"""Simulated essays, labels and ratings of known quality: a fixture for trying a rubric."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .rubrics import Rubric

#: Tasks with their key points; variants stand between bars.
TASKS = {
    "P01": ("Phân tích vai trò của giáo dục đại học.", ["kiến thức", "kĩ năng|kỹ năng", "nghiên cứu", "xã hội", "việc làm"]),
    "P02": ("Trình bày tác động của công nghệ tới việc học.", ["công nghệ", "trực tuyến|từ xa", "tương tác", "dữ liệu", "tự học"]),
}
SENTENCE = "Bài viết cho rằng {} có ý nghĩa quan trọng đối với người học và cộng đồng."
#: Shape of the distribution of quality, its bounds, and essays of a batch.
SHAPE, BOUNDS, BATCH = (4, 3), (0.05, 0.98), 50


def simulated(spark: SparkSession, rubric: Rubric, n: int = 300, seed: int = 42, noise: float = 0.35, raters: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(essays, gold, annotations) of n essays, each with a hidden quality that its text, labels and noisy ratings follow.

    Five essays at the edges come on top, without labels: empty, too short, the task copied, no diacritics, and a copy of
    the fourth one. A driver's fixture: n is small.
    """
    rng = np.random.default_rng(seed)
    names = list(TASKS)
    nearest = lambda levels, x: min(levels, key=lambda v: (abs(v - x), v))
    stepped = lambda x: round(x / rubric.scale_step) * rubric.scale_step
    total = lambda scores: stepped(sum(scores[c.key] / c.max_score * c.weight * rubric.scale_max for c in rubric.criteria))
    essays, gold, ratings = [], [], []
    for i in range(n):
        task = names[i % len(names)]
        prompt, keys = TASKS[task]
        q = float(np.clip(rng.beta(*SHAPE), *BOUNDS))
        said = [keys[k].split("|")[0] for k in rng.permutation(len(keys))[: max(1, round(q * len(keys)))]]
        paragraphs = [SENTENCE.format(k) for k in said for _ in range(1 + int(q * 3))]
        text = ("\n\n" if q > 0.35 else " ").join(paragraphs)
        for good, bad in (("của", "cuar"), ("không", "ko"), ("được", "dc")):
            text = text.replace(good, bad) if rng.random() < 0.5 * (1 - q) else text
        key = f"E{i:05d}"
        essays.append((key, text, task, prompt, "MH101", f"SV{i:05d}", ";".join(keys)))
        scores = {c.key: nearest(c.scores, q * c.max_score) for c in rubric.criteria}
        gold.append((key, *scores.values(), total(scores), q))
        for r in range(raters):
            seen = {c.key: nearest(c.scores, scores[c.key] + rng.normal(0, noise * c.max_score / 4)) for c in rubric.criteria}
            ratings.append((key, f"GK{r + 1}", *seen.values(), total(seen), i // BATCH))
    prompt, keys = TASKS["P01"]
    plain = "toi khong biet lam bai nay nhung toi se co gang viet mot doan van khong dau "
    edges = [("E90001", ""), ("E90002", "Em không biết làm ạ."), ("E90003", prompt * 5), ("E90004", plain * 8)]
    essays += [(k, t, "P01", prompt, "MH101", k, ";".join(keys)) for k, t in edges]
    if n > 3:
        essays.append(("E90005", *essays[3][1:5], "SV90005", essays[3][6]))
    criteria = ", ".join(f"`{c}` double" for c in rubric.keys)
    return (
        spark.createDataFrame(essays, "essay_id string, text string, prompt_id string, prompt_text string, course_id string, student_id string, keywords string"),
        spark.createDataFrame(gold, f"essay_id string, {criteria}, gold_total double, latent_q double"),
        spark.createDataFrame(ratings, f"essay_id string, rater_id string, {criteria}, total double, batch int"),
    )
