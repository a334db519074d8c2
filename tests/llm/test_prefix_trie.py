"""Prefix tries against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import DATA

from spanloom.llm import prefix_trie as pt, queries

SF = f"{DATA}/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(table):
    own = defaultdict(list)
    for conv, turn, role, text in table:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(rows)] for c, rows in own.items()}
    out = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - c % 20, [])[:h] + rows[h:])
    return out


def expected(table):
    convs = rebuilt(table)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        words = len(node[-1][1].encode().split()) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[c] for c in children[node])
    return sorted(
        (
            min(m),
            len(node),
            min(members[node[:-1]]) if node else -1,
            len(m),
            len(children[node]),
            leaves[node],
            saved[node],
            hashlib.sha256(",".join(map(str, sorted(c for c in m if convs[c] == node))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def found(df):
    assert df.columns == pt.RESULT
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def test_query(spark, duck):
    table = duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert found(queries.QUERIES["op13_prefix_trie"](spark, SF)) == expected(table)


def drawn(seed, convs, turns, kinds):
    """Few kinds of turns, so that prefixes are shared at every depth; exact copies, too."""
    rng = random.Random(seed)
    out = []
    for c in range(convs):
        rows = [(rng.choice(["user", "assistant"]), f"said {rng.randrange(kinds)} times.") for _ in range(rng.randrange(1, turns))]
        if rng.random() < 0.5:
            rows = [("system", "be kind"), *rows]
        if rng.random() < 0.2:
            rows = [("user", f"deep {i}") for i in range(rng.choice([25, 40]))]
        out += [(c * rng.choice([1, 1, 3]) + 1000 * (c % 2), i, r, t) for i, (r, t) in enumerate(rows)]
    return out


@pytest.mark.parametrize("shard_turns, broadcast", [(20, 0), (150, pt.BROADCAST_ROWS), (pt.SHARD_TURNS, pt.BROADCAST_ROWS)])
def test_shards_merge(spark, monkeypatch, shard_turns, broadcast):
    """Shards that cut shared prefixes at every depth."""
    monkeypatch.setattr(pt, "SHARD_TURNS", shard_turns)
    monkeypatch.setattr(pt, "BROADCAST_ROWS", broadcast)
    table = drawn(5, 90, 6, 2)
    df = spark.createDataFrame(table, SCHEMA).repartition(3)
    assert found(pt.prefix_nodes(pt.sequences(df))) == expected(table)


def test_awkward_rows(spark):
    table = [
        (None, 1, "user", "no id"),
        (0, None, None, None),
        (0, None, None, None),
        (0, 1, "user", None),
        (3, 1, "", ""),
        (5, 0, "a", "b c"),
        (5, 0, "a", "b c"),
        (-5, 0, "a", "b c"),
        (-20, 0, "user", "first of its group"),
        (41, 0, "user", "w " * 100_000),
        (42, 0, "user", "w " * 100_000),
        (60, 0, "1:", "x"),
        (61, 0, "1", ":x"),
        (62, 0, "u", "1:x"),
        (80, 7, "user", "  one word \t two"),
    ]
    df = spark.createDataFrame(table, SCHEMA).selectExpr("*", "1 AS key", "2 AS path", "3 AS words", "4 AS place", "5 AS n")
    assert found(pt.prefix_nodes(pt.sequences(df))) == expected(table)
    none = pt.prefix_nodes(pt.sequences(df.where("conv_id is null")))
    assert none.columns == pt.RESULT and none.isEmpty()


def test_double_array():
    rng = np.random.default_rng(2)
    for most in (1, 3, 400):
        seqs = sorted({tuple(rng.integers(0, most, rng.integers(0, 9)).tolist()) for _ in range(600)})
        codes = np.array([c for s in seqs for c in s], dtype=np.int64)
        trie = pt.DoubleArray(codes, np.cumsum([len(s) for s in seqs]))
        at = trie.walked().tolist()
        assert len(set(at)) == len(seqs)
        nodes = {s[:d] for s in seqs for d in range(len(s) + 1)}
        assert sum(len(l) for l in trie.levels) == len(nodes) == int((trie.check >= 0).sum())
        for s, slot in zip(seqs, at):
            assert [int(b - trie.base[a]) for a, b in zip(trie.path(slot), trie.path(slot)[1:])] == list(s)
