"""Paragraph sketches against counted paragraphs, edited texts against slices."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from awkward import DOCUMENTS
from compare import DATA

from spanloom.llm import paragraph_sketch as ps, queries

SF = f"{DATA}/sf0.001"


def cut(text):
    """Paragraphs, the plain way: up to LONGEST characters and all ends of sentence after them."""
    out, at = [], 0
    while at < len(text):
        to = at
        while to < len(text) and to - at < ps.LONGEST and text[to] not in ".!?\n。！？":
            to += 1
        while to < len(text) and text[to] in ".!?\n。！？":
            to += 1
        out.append(text[at:to])
        at = to
    return out


def alike(a, b):
    a, b = Counter(cut(a)), Counter(cut(b))
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 1.0


def edited(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def check(rows, texts):
    """``rows`` in the order of ``texts``."""
    assert len(rows) == len(texts)
    for i, (r, text) in enumerate(zip(rows, texts)):
        after = texts[(i + 1) % len(texts)]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited(text, after).encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(alike(text, edited(text, after)), abs=1e-12)
        assert r["near_next"] == pytest.approx(alike(text, after), abs=1e-12)
    by_text = {}
    for r, text in zip(rows, texts):
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert len({r["fingerprint"] for r in rows}) == len({tuple(sorted(cut(t))) for t in texts})


def test_query(spark, duck):
    texts = [t or "" for (t,) in duck.execute("SELECT text FROM documents ORDER BY doc_id").fetchall()]
    df = queries.QUERIES["op11_paragraph_sketch"](spark, SF)
    rows = sorted(df.collect(), key=lambda r: r["doc_id"])
    check(rows, texts)
    assert np.mean([r["near_edited"] for r in rows]) > 0.25 > 10 * np.mean([r["near_next"] for r in rows])


@pytest.mark.parametrize("slice_bytes", [ps.SLICE_BYTES, 100, 20_000])
def test_slices_and_awkward_rows(spark, docs, no_docs, monkeypatch, slice_bytes):
    monkeypatch.setattr(ps, "SLICE_BYTES", slice_bytes)
    hashed = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) h").collect()}
    order = sorted(DOCUMENTS, key=lambda d: (ps.NO_ID if d[0] is None else d[0], hashed[d[1]]))
    rows = ps.fingerprinted(docs.repartition(3)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows) == sorted(
        (d[0] is not None, d[0] or 0) for d in DOCUMENTS
    )
    # rows that repeat an id are told apart by what follows them
    texts = [d[1] or "" for d in order]
    want = {}
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        ended = hashlib.sha256(edited(text, after).encode()).hexdigest()
        want.setdefault((order[i][0], ended, round(alike(text, after), 9)), []).append(i)
    placed = [None] * len(rows)
    for r in rows:
        placed[want[(r["doc_id"], r["edited_sha256"], round(r["near_next"], 9))].pop()] = r
    check(placed, texts)
    assert ps.fingerprinted(no_docs).isEmpty()
    one = ps.fingerprinted(docs.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_recovery_at_every_size():
    rng = np.random.default_rng(3)
    lines = [f"line {i} says {rng.integers(1 << 40)}\n" for i in range(3000)]
    texts = ["".join(lines[:n]) for n in (0, 1, 5, 40, 400, 3000)]
    texts.append("same\n" * 50 + "other\n")
    digests = ps.Digests(texts)
    left, right = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    near, cells = ps.compared(digests, left, digests, right)
    assert near.tolist() == [alike(texts[a], texts[b]) for a, b in zip(left, right)]
    assert cells[left == right].max() == ps.CELLS and cells.max() > 3000


def test_changes_between_versions(spark, docs, no_docs):
    long = [f"line {i} of the first version\n" for i in range(900)]
    old = [(1, "a. b. b. c."), (2, "".join(long)), (3, "gone."), (None, "x.\ny."), (5, ""), (6, None)]
    new = [(1, "a. b. c. d."), (2, "".join(l if i % 3 else f"new {i}\n" for i, l in enumerate(long))), (4, "fresh."), (None, "x.\nz."), (5, None), (6, "")]
    schema = "doc_id long, text string"
    before, after = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    said = {
        (r["doc_id"], r["digest"]): r["paragraph"]
        for r in ps.paragraph_digests(before.unionByName(after)).collect()
    }
    for r in ps.changes(before, after).collect():
        a, b = (Counter(cut(dict(v).get(r["doc_id"]) or "")) for v in (old, new))
        assert (r["n_old"], r["n_new"]) == (sum(a.values()), sum(b.values()))
        assert Counter(said[(r["doc_id"], d)] for d in r["removed"]) == a - b
        assert Counter(said[(r["doc_id"], d)] for d in r["added"]) == b - a
    assert ps.changes(before, after).count() == 7
    assert ps.changes(no_docs, no_docs).isEmpty()
    alike_rows = ps.changes(docs, docs).collect()
    assert len(alike_rows) == len({d[0] for d in DOCUMENTS})
    assert all(r["likeness"] == 1.0 and not r["removed"] and not r["added"] and r["cells"] == ps.CELLS for r in alike_rows)
