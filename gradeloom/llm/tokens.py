"""Token counts by trie-shared dynamic programming (operator 5).

Texts are cut into pre-tokens by the vocabulary's public pattern. A unigram model scores a segmentation as the sum of
its pieces' scores; the best forward score at a byte depends only on the bytes before it, so pre-tokens that share a
prefix share its scores. A task's distinct pre-tokens, in byte order, are a trie: its nodes are distinct prefixes, each
scored once, level by level with numpy (long pre-tokens one by one, depth first). A pre-token's terminal stores the token count of its best
segmentation (fewest tokens among equal scores), and texts sum the stored counts. Nothing is shuffled, and the store is
emptied when it holds STORE pre-tokens, which changes no result.

Pieces are those of a public byte-level vocabulary, whose every single byte is a piece, so every text can be segmented;
a piece of rank r scores -log(r + 1 + OFFSET). The vocabulary's path is a parameter.

Defined cases: null and empty texts have no token; repeated rows count alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import itertools
import math
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, chunks, mix, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that the vocabulary's texts are cut by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OFFSET = 100
STORE = 1_000_000


def pieces(ranks: bytes) -> dict[bytes, float]:
    """Scores of a file of lines 'base64 rank'."""
    found = {}
    for line in ranks.splitlines():
        if line:
            piece, rank = line.split()
            found[base64.b64decode(piece)] = -math.log(int(rank) + 1 + OFFSET)
    worst = min(found.values())
    for b in range(256):
        found.setdefault(bytes([b]), worst - 1)
    return found


def _poly(b: np.ndarray, power: int) -> np.ndarray:
    return (b.astype(np.uint64) + np.uint64(1)) * np.uint64(pow(0x9E3779B97F4A7C15, power, 1 << 64))


class Trie:
    """Token counts of pre-tokens under piece scores."""

    #: Longer pre-tokens are walked one by one.
    WIDTH = 32

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.lengths = sorted({len(p) for p in scores})
        self.by_length = {}
        for size in (n for n in self.lengths if n <= self.WIDTH):
            found = [p for p in scores if len(p) == size]
            h = mix(sum(_poly(np.array([p[size - 1 - i] for p in found], np.uint8), i) for i in range(size)))
            order = np.argsort(h)
            maybe = np.zeros(1 << 18, bool)
            maybe[h >> np.uint64(46)] = True
            self.by_length[size] = h[order], np.array([scores[p] for p in found])[order], maybe
        self.counts: dict[str, int] = {}

    def add(self, tokens) -> None:
        """Stores the count of each token that isn't stored yet."""
        new = sorted(set(tokens).difference(self.counts))  # code point order is byte order
        coded = [x.encode() for x in new]
        short = [len(b) <= self.WIDTH and b"\0" not in b for b in coded]
        if all(short):
            self.counts.update(zip(new, self._levels(coded).tolist() if new else ()))
            return
        self.add(itertools.compress(new, short))
        self._path([(b, x) for b, x, s in zip(coded, new, short) if not s])

    def _levels(self, tokens: list[bytes]) -> np.ndarray:
        """Counts of sorted distinct tokens: the trie's nodes level by level, all nodes of a level at once.

        A node is a distinct prefix; level[d][j] is the number of token j's prefix of d bytes among the nodes of depth d.
        """
        grid = np.array(tokens, f"S{self.WIDTH}").view(np.uint8).reshape(-1, self.WIDTH)
        size = np.array([len(t) for t in tokens])
        differ = grid[1:] != grid[:-1]
        same = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), self.WIDTH)])
        same[1:] = np.minimum(same[1:], np.minimum(size[1:], size[:-1]))
        level, best, number = [np.zeros(len(tokens), np.int32)], [np.zeros(1)], [np.zeros(1, np.int32)]
        out = np.zeros(len(tokens), np.int32)
        for d in range(1, int(size.max()) + 1):
            new = (same < d) & (size >= d)
            at = np.flatnonzero(new)
            top, fewest = np.full(len(at), -np.inf), np.zeros(len(at), np.int32)
            h = np.zeros(len(at), np.uint64)
            for n in range(1, min(d, self.lengths[-1]) + 1):
                h = h + _poly(grid[at, d - n], n - 1)
                if n not in self.by_length:
                    continue
                known, score, maybe = self.by_length[n]
                key = mix(h)
                hit = np.flatnonzero(maybe[key >> np.uint64(46)])
                k = np.minimum(np.searchsorted(known, key[hit]), len(known) - 1)
                ok = known[k] == key[hit]
                hit, k = hit[ok], k[ok]
                parent = level[d - n][at[hit]]
                s, c = best[d - n][parent] + score[k], number[d - n][parent] + 1
                better = (s > top[hit]) | ((s == top[hit]) & (c < fewest[hit]))
                top[hit[better]], fewest[hit[better]] = s[better], c[better]
            level.append((np.cumsum(new) - 1).astype(np.int32))
            best.append(top)
            number.append(fewest)
            ends = np.flatnonzero(size == d)
            out[ends] = fewest[level[d][ends]]
        return out

    def _path(self, tokens: list[tuple[bytes, str]]) -> None:
        """The same for sorted tokens of any length: depth first, keeping the path from the root."""
        score = self.scores.get
        best, number, before = [0.0], [0], b""
        for t, x in tokens:
            same = len(os.path.commonprefix((before, t)))
            del best[same + 1 :], number[same + 1 :]
            for end in range(same + 1, len(t) + 1):
                top, fewest = -math.inf, 0
                for size in self.lengths:
                    if size > end:
                        break
                    s = score(t[end - size : end])
                    if s is not None:
                        s += best[end - size]
                        n = number[end - size] + 1
                        if s > top or (s == top and n < fewest):
                            top, fewest = s, n
                best.append(top)
                number.append(fewest)
            self.counts[x] = number[len(t)]
            before = t


def cutter():
    """f(text): the pre-tokens of a text.

    Texts of the first 256 characters, by far the most, go through the standard library's faster engine: there the
    pattern's classes are written out, as the pattern's own engine finds them.
    """
    chars = [chr(i) for i in range(256)]
    kind = {k: "".join(c for c in chars if regex.match(p, c)) for k, p in (("p{L}", r"\p{L}"), ("p{N}", r"\p{N}"), ("s", r"\s"), ("S", r"\S"))}
    plain = PATTERN
    for k, members in kind.items():
        inside = re.escape(members)
        plain = plain.replace(f"[^\\s\\p{{L}}\\p{{N}}]", "[^" + re.escape(kind["s"] + kind["p{L}"] + kind["p{N}"]) + "]").replace("\\" + k, f"[{inside}]")
    fast, full = re.compile(plain).findall, regex.compile(PATTERN).findall

    def cut(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return full(text)
        return fast(text)

    return cut


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for every row of docs(doc_id, text); vocabulary: a file that the driver can read."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # one file of a fixed size

    def run(batches):
        trie, find = Trie(pieces(shared.value)), cutter()
        for b in batches:
            n_pre, n_tok = [], []
            for _, part in chunks(binary(b, "text"), 4 << 20):
                # tokens of many texts enter the trie together: longer common prefixes
                found = [find(x.decode("utf-8", "replace")) for x in part]
                trie.add(itertools.chain.from_iterable(found))
                n_pre += map(len, found)
                n_tok += [sum(map(trie.counts.__getitem__, f)) for f in found]
                if len(trie.counts) > STORE:
                    trie.counts.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_pre, pa.int64()), pa.array(n_tok, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
