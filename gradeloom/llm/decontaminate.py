"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment (operator 10).

Words are lower-cased runs of letters, digits and non-ASCII bytes. A first pass counts, over all documents, in how many
documents each n-gram of the benchmark occurs. Those in at most RARE_DOCS documents are seeds by themselves; a common one
is a seed together with another n-gram of the item at about the right distance, as an edited or partial copy has: two
common ones meet there by chance far less often than one is met. A second pass finds seeds in each whole text and aligns
the item with the stretch around them, where it is read: texts are never shuffled. Whether a stretch's words can reach
the score is told for all stretches at once, and only those that can are aligned.
The local alignment (match 2, mismatch and gap -1) is scored against a full match of the item. A copy of which no n
words in a row are left has no seed and isn't found, nor one of which a single n-gram is left that is common.

The benchmark goes to the tasks in blocks of at most BLOCK_BYTES of text; a larger benchmark takes more passes, each of
which is written before the next one, so the driver holds one block.

Defined cases: null and empty texts match nothing; items without words match nothing; items of fewer words than an
n-gram are seeds as a whole; repeated rows give results each; ids keep their types and may be null; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import binary, chunks, grams, hashed_words, table, words_of, written

N_GRAM = 3
#: A copy reaches this share of the item's full score, in at least MIN_WORDS matched words (or the item's words, if fewer).
MIN_RATIO, MIN_WORDS = 0.5, 8
#: Or as much as so many words that match, whatever the item's length.
LONG_WORDS = 50
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 8 << 20
#: Documents that an n-gram may occur in to be a seed by itself: so many alignments an n-gram at most, whatever the corpus.
RARE_DOCS = 100
#: Words a copy may be longer than its item, as a share: the stretch around a seed that is aligned.
SLACK = 0.5


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(best local score, first, last + 1 word of text aligned). One numpy step for each word of the item."""
    n = len(text)
    ramp = np.arange(n) * -GAP
    high, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    here = np.arange(n)
    for word in item:
        diagonal = high[:-1] + np.where(text == word, MATCH, MISMATCH)
        up = high[1:] + GAP
        top = np.maximum(diagonal, up)
        origin = np.where(diagonal >= up, np.where(high[:-1] > 0, start[:-1], here), start[1:])
        top = np.maximum(top, 0)
        reach = np.maximum.accumulate(top + ramp)  # gaps along the text
        came = np.maximum.accumulate(np.where(top + ramp == reach, here, 0))
        new, origin = reach - ramp, origin[came]
        high, start = np.concatenate([[0], np.maximum(new, 0)]), np.concatenate([[0], origin])
        at = int(new.argmax()) if n else 0
        if n and new[at] > best[0]:
            best = (int(new[at]), int(origin[at]), at + 1)
    return best


class Items:
    """A block of the benchmark as the tasks use it: word hashes of items, and their n-grams with places."""

    def __init__(self, rows: list[tuple[int, bytes]], n: int = N_GRAM):
        self.n = n
        self.ids = [i for i, _ in rows]
        words, row = hashed_words([t.decode().lower().encode() for _, t in rows])
        cuts = np.searchsorted(row, np.arange(len(rows) + 1))
        self.words = [words[a:z] for a, z in zip(cuts, cuts[1:])]
        found = []
        for k, ws in enumerate(self.words):
            g = grams(ws, min(n, len(ws))) if len(ws) else np.zeros(0, np.uint64)
            found += [(int(x), k, p) for p, x in enumerate(g)]
        self.short = sorted({len(ws) for ws in self.words if 0 < len(ws) < n})
        self.gram = np.array([x for x, _, _ in found], np.uint64)
        self.item = np.array([k for _, k, _ in found], np.int64)
        self.place = np.array([p for _, _, p in found], np.int64)
        self.size = np.array([len(ws) for ws in self.words], np.int64)
        self.extra = (self.size * SLACK).astype(np.int64) + 2
        self.kinds = [np.unique(ws, return_counts=True) for ws in self.words]
        self.use(np.zeros(len(found), np.int64), np.ones(len(found), bool))

    def use(self, count: np.ndarray, keep: np.ndarray | None = None) -> None:
        """Seeds are the n-grams of which count documents are known (or those in keep); up to RARE_DOCS they are rare."""
        at = np.flatnonzero(count > 0 if keep is None else keep)
        self.rare = count <= RARE_DOCS
        self.at = at[np.argsort(self.gram[at], kind="stable")]
        self.sorted = self.gram[self.at]
        self.known = np.unique(self.sorted)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.known >> np.uint64(44)] = True

    def hits(self, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the n-gram's first word, its index in known) of all seeds in a sequence of texts' words."""
        places, which = [], []
        for n in {self.n, *self.short}:
            g = grams(words, n)
            at = np.flatnonzero(self.maybe[g >> np.uint64(44)])
            at = at[row[at] == row[at + n - 1]]
            k = np.searchsorted(self.known, g[at])
            k = np.minimum(k, len(self.known) - 1)
            ok = self.known[k] == g[at]
            places.append(at[ok])
            which.append(k[ok])
        return np.concatenate(places), np.concatenate(which)

    def matches(self, part: list[bytes], min_ratio: float):
        """(row, item, score ratio, first, last + 1 word) of copies in texts: the best alignment for each row and item."""
        words, row = words_of(part)
        if not len(self.known) or not len(words):
            return
        at, which = self.hits(words, row)
        lo, hi = np.searchsorted(self.sorted, self.known[which], "left"), np.searchsorted(self.sorted, self.known[which], "right")
        many = hi - lo
        seed = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at, seed = np.repeat(at, many), self.at[seed]
        item, begin, own = self.item[seed], at - self.place[seed], row[at]
        order = np.lexsort((begin, item, own))
        item, begin, own, seed = item[order], begin[order], own[order], seed[order]
        item, begin, own = self.supported(item, begin, own, seed)
        if not len(item):
            return
        # stretches of one text that touch are aligned together
        size, extra = self.size[item], self.extra[item]
        head = np.ones(len(item), bool)
        head[1:] = (item[1:] != item[:-1]) | (own[1:] != own[:-1]) | (begin[1:] - extra[1:] > begin[:-1] + size[:-1] + extra[:-1])
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(item)) - 1
        heads = np.searchsorted(row, np.arange(len(part) + 1))
        item, own = item[first], own[first]
        size, extra = size[first], extra[first]
        a = np.maximum(begin[first] - extra, heads[own])
        z = np.minimum(begin[last] + size + extra, heads[own + 1])
        least = np.maximum(MATCH * np.minimum(min_ratio * size, LONG_WORDS), np.where(size < 2 * MIN_WORDS, MATCH * np.minimum(MIN_WORDS, size), 0))
        likely = np.flatnonzero(self.may_reach(words, item, a, z, least))
        for k in likely[best_scores([self.words[item[k]] for k in likely], [words[a[k] : z[k]] for k in likely]) >= least[likely]]:
            wanted = self.words[item[k]]
            score, start, end = align(wanted, words[a[k] : z[k]])
            yield int(own[k]), int(item[k]), score / (MATCH * len(wanted)), int(a[k] - heads[own[k]] + start), int(a[k] - heads[own[k]] + end)

    def supported(self, item: np.ndarray, begin: np.ndarray, own: np.ndarray, seed: np.ndarray):
        """(item, begin, own) of the hits that are rare, or have another n-gram of the item within the slack and in its order.

        Hits are in order of begin; each is held against the three before and behind it.
        """
        # an item of one n-gram has no other
        keep, place = self.rare[seed] | (self.size[item] <= self.n), self.place[seed]
        for lag in (1, 2, 3):
            near = (item[lag:] == item[:-lag]) & (own[lag:] == own[:-lag]) & (begin[lag:] - begin[:-lag] <= self.extra[item[lag:]])
            apart, read = place[lag:] - place[:-lag], begin[lag:] + place[lag:] - begin[:-lag] - place[:-lag]
            near &= (apart != 0) & (np.sign(apart) == np.sign(read))
            keep[lag:] |= near
            keep[:-lag] |= near
        return item[keep], begin[keep], own[keep]

    def may_reach(self, words: np.ndarray, item: np.ndarray, a: np.ndarray, z: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether matches for the words that an item and its stretch have in common, with repeats, come to least."""
        out = np.zeros(len(item), bool)
        for k, (i, start, end, needed) in enumerate(zip(item.tolist(), a.tolist(), z.tolist(), (least / MATCH).tolist())):
            kinds, many = self.kinds[i]
            at = kinds.searchsorted(words[start:end])
            at[at == len(kinds)] = 0
            found = np.bincount(at[kinds[at] == words[start:end]], minlength=len(kinds))
            out[k] = np.minimum(found, many).sum() >= needed
        return out


def best_scores(items: list[np.ndarray], texts: list[np.ndarray], cells: int = 1 << 18) -> np.ndarray:
    """The score of align() for each item and its text: pairs of like size go through each step together."""
    out = np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda k: (len(texts[k]), len(items[k])))
    at = 0
    while at < len(order):
        end, longest = at + 1, len(texts[order[at]])
        while end < len(order) and (end + 1 - at) * len(texts[order[end]]) <= cells and len(texts[order[end]]) <= 1.5 * longest + 16:
            end += 1
        some = order[at:end]
        m, n = max(len(items[k]) for k in some), max(len(texts[k]) for k in some)
        # what fills up short items and texts equals nothing
        wanted, words, real = np.zeros((len(some), m), np.uint64), np.zeros((len(some), n), np.uint64), np.zeros((len(some), n), bool)
        for r, k in enumerate(some):
            wanted[r, : len(items[k])], words[r, : len(texts[k])], real[r, : len(texts[k])] = items[k], texts[k], True
        size = np.array([len(items[k]) for k in some])
        ramp = (np.arange(n) * -GAP).astype(np.int32)
        high, best = np.zeros((len(some), n + 1), np.int32), np.zeros(len(some), np.int32)
        for i in range(m):
            same = (words == wanted[:, i : i + 1]) & real & (size > i)[:, None]
            top = np.maximum(high[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), high[:, 1:] + np.int32(GAP))
            top = np.maximum(top, 0) + ramp
            high[:, 1:] = np.maximum.accumulate(top, axis=1) - ramp
            best = np.maximum(best, high.max(axis=1))
        out[some] = best
        at = end
    return out


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES):
    """The benchmark's rows in lists of at most limit bytes of text (or one item), one list at a time."""
    rows, size = [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        b = r.text.encode()
        if rows and size + len(b) > limit:
            yield rows
            rows, size = [], 0
        rows.append((r.item_id, b))
        size += len(b)
    if rows:
        yield rows


def with_seeds(docs: DataFrame, items: Items) -> Items:
    """items with the n-grams that occur in docs as seeds."""

    def counted(batches):
        total = np.zeros(len(items.known), np.int64)
        for b in batches:
            for _, part in chunks(binary(b, "text"), lower=True):
                words, row = words_of(part)
                at, which = items.hits(words, row)
                pair = np.unique(row[at] * len(items.known) + which)
                total += np.bincount(pair % len(items.known), minlength=len(items.known))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    n = np.zeros(len(items.known), np.int64)
    if len(n):
        # one row for each n-gram of the block at most
        for r in docs.select("text").mapInArrow(counted, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
            n[r.k] = r.n
    count = n[np.searchsorted(items.known, items.gram)] if len(n) else np.zeros(0, np.int64)
    items.use(count)
    return items


def leaks(docs: DataFrame, benchmark: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of every copy of an item in a document: the best one for each pair."""
    kinds = [docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType]
    arrow = [to_arrow_type(k) for k in kinds] + [pa.float64(), pa.int64(), pa.int64()]
    names = ["doc_id", "item_id", "score", "first_word", "last_word"]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, [*(k.simpleString() for k in kinds), "double", "long", "long"]))
    out = docs.sparkSession.createDataFrame([], schema)
    for rows in blocks(benchmark):
        items = with_seeds(docs, Items(rows))

        def run(batches, items=items):
            for b in batches:
                ids, found = b.column(0), []
                for first, part in chunks(binary(b, "text"), lower=True):
                    best = {}
                    for row, k, score, start, end in items.matches(part, min_ratio):
                        best[row, k] = max(best.get((row, k), (-1.0,)), (score, -start, end))
                    found += [(ids[first + row].as_py(), items.ids[k], score, -start, end) for (row, k), (score, start, end) in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [[]] * 5, arrow)], names=names)

        # written block by block: the driver holds one block at a time
        out = out.unionByName(written(docs.select("doc_id", "text").mapInArrow(run, schema)))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """docs without the rows that hold a copy of an item, with the same columns: rows are dropped where they are read."""
    for n, rows in enumerate(blocks(benchmark)):
        if n:
            docs = written(docs)
        items = with_seeds(docs, Items(rows))

        def run(batches, items=items):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for first, part in chunks(binary(b, "text"), lower=True):
                    for row, *_ in items.matches(part, min_ratio):
                        keep[first + row] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
