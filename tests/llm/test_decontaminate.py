"""Benchmark decontamination on text with natural word frequencies: nothing that brute force finds is lost, and little is aligned."""

import numpy as np
import pytest

from gradeloom.llm import decontaminate as d

rng = np.random.default_rng(2)
P = 1 / np.arange(1, 30_001) ** 1.05
VOCABULARY = np.array(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(len(P))])


def words(n):
    return VOCABULARY[rng.choice(len(P), n, p=P / P.sum())]


def seeded(items, docs, times):
    """Items whose n-grams are counted in docs as if there were so many times as many of them."""
    found = d.Items([(i, " ".join(t).encode()) for i, t in enumerate(items)])
    ws, row = d.hashed_words(docs)
    at, which = found.hits(ws, row)
    pair = np.unique(row[at] * len(found.known) + which)
    n = np.bincount(pair % len(found.known), minlength=len(found.known))
    found.use(n[np.searchsorted(found.known, found.gram)] * times)
    return found


@pytest.mark.parametrize("times", [1, 400])
@pytest.mark.parametrize("rate", [0.1, 0.3])
def test_edited_copies_among_common_words(rate, times):
    items, docs = [words(40) for _ in range(60)], []
    for item in items:
        copy, edited = item.copy(), rng.random(40) < rate
        copy[edited] = words(int(edited.sum()))
        docs.append(" ".join([*words(60), *copy, *words(60)]).encode())
    found = seeded(items, docs, times)  # at 400 times no n-gram is rare
    got = {(row, k) for i in range(0, 60, 20) for row, k in ((i + r, k) for r, k, *_ in found.matches(docs[i : i + 20], 0.5))}
    want = {(i, i) for i in range(60) if d.align(found.words[i], d.hashed_words([docs[i]])[0])[0] >= 40}
    assert want <= got and len(want) > 40


def test_few_stretches_are_aligned(monkeypatch):
    items, docs = [words(40) for _ in range(2000)], [" ".join(words(1000)).encode() for _ in range(30)]
    found, scored = seeded(items, docs, 400), []
    monkeypatch.setattr(d, "best_scores", lambda i, t, f=d.best_scores: scored.append(len(i)) or f(i, t))
    assert not list(found.matches(docs, 0.5))
    hits = found.hits(*d.hashed_words(docs))[0]
    assert len(hits) > 1500 and sum(scored) < 0.05 * len(hits)


def test_scores_of_many_are_those_of_each():
    items = [rng.integers(0, 9, rng.integers(1, 30)).astype(np.uint64) for _ in range(70)]
    texts = [rng.integers(0, 9, rng.integers(0, 60)).astype(np.uint64) for _ in range(70)]
    want = [d.align(i, t)[0] for i, t in zip(items, texts)]
    assert d.best_scores(items, texts).tolist() == want == d.best_scores(items, texts, 50).tolist()
    assert d.best_scores([], []).tolist() == []
