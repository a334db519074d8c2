"""Large groups of near copies that their central document doesn't reach."""

from __future__ import annotations

from plain_components import components

from spanloom.llm import jaccard_join

COPIES = 120


def revised_copies():
    """A text and a copy of it, and copies of a revision too far from it, each with changes of its own."""
    source = [f"w{k}" for k in range(1000)]
    revised = [f"r{k}" if k % 25 == 0 else word for k, word in enumerate(source)]
    rows = [(1, " ".join(source)), (2, " ".join(["x" if k == 13 else word for k, word in enumerate(source)]))]
    for i in range(COPIES):
        own = {(37 * i + 167 * k) % 1000 for k in range(6)}
        rows.append((10 + i, " ".join(f"c{i}x{k}" if k in own else word for k, word in enumerate(revised))))
    return rows


def test_pairs_of_a_family_grow_with_its_documents(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    made, whole = [], jaccard_join._cross_pairs

    def counted(*given):
        pairs = whole(*given)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard_join, "_cross_pairs", counted)
    rows = revised_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.joined(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == components(rows)
    assert len({c for _, _, c in got}) == 2
    assert sum(made) <= COPIES
