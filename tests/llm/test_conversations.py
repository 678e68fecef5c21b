"""The prefix trie against a plain one, with long, turnless and odd conversations."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from gradeloom.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, depth string, owner string, digest string, words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            h = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, h), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) if below else 1
        saved[k] = (len(nodes[k]) - 1) * len(WORD.findall(k[-1][1]) if k else []) + sum(saved[x] for x in below)
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def cases():
    rng = np.random.default_rng(2)
    texts = ["hello there", "how are you", "fine", "", None, "tell me more about it", "no", "yes  indeed\nsir"]
    rows = []
    for c in range(130):
        n = int(rng.integers(1, 9))
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", texts[int(rng.integers(0, 3 if t < 3 else 8))]) for t in range(n)]
    rows += [(200, t, "user", "the very same turn") for t in range(300)] + [(201, t, "user", "the very same turn") for t in range(280)] + [(202, t, "user", f"turn {t // 200}") for t in range(260)]
    rows += [(340 + i, t, None, f"copied {t}") for i in range(19) for t in range(4)]  # many ends at few nodes
    rows += [(400, None, "user", "null first"), (400, 0, None, None), (400, 5, "user", "tie b"), (400, 5, "user", "tie a"), (400, 5, "user", "tie a")]
    rows += [(421, 0, "u", "a head only"), (None, 0, "user", "no id"), (None, None, None, None), (-7, 0, "user", "below zero"), (-20, 3, "user", "group of it"), (1000, 2, "user", "far")]
    return [(*r, "a", "b", "c", "d") for r in rows]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("parts", [1, 7])
def test_nodes_are_those_of_a_plain_trie(spark, parts):
    rows = cases()
    assert collected(conversations.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(parts))) == plain(rows)


def test_no_and_single_conversations(spark):
    df = spark.createDataFrame(cases(), SCHEMA)
    assert conversations.prefix_trie(df.where("false")).count() == 0
    assert conversations.prefix_trie(df.where("conv_id is null")).count() == 0
    one = [(5, 0, "user", "x", *"abcd")]
    assert collected(conversations.prefix_trie(spark.createDataFrame(one, SCHEMA))) == plain(one)


def test_pieces_and_streams_cross_batches():
    batch = lambda rows: conversations._batch(rows, ["digest", "conv_id"])
    pieces = [b for b in conversations._pieces([batch([(b"a", 1), (b"a", 2), (b"b", 3)]), batch([(b"b", 10), (b"c", 4)])])]
    got = [r for b in conversations._hash(b.select([0, 2]) for b in pieces) for r in b.to_pylist()]
    assert got == [{"digest": k, "ends_sha256": hashlib.sha256(v).hexdigest()} for k, v in ((b"a", b"1,2"), (b"b", b"3,10"), (b"c", b"4"))]
