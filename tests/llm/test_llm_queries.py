"""Registered queries on the smallest tables: DuckDB where SQL exists, else brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import DATA, difference
from plain_components import components

from spanloom.llm import queries

SF = f"{DATA}/sf0.001"


def rows(spark, name, *columns):
    df = queries.QUERIES[name](spark, SF)
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_duckdb(spark, duck, name):
    assert difference(queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name]) is None


def test_url_rules(spark, duck):
    def expected(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = rest
        for mark in "/?#":
            host = host.split(mark)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        best = None
        for name, start, verdict in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")):
            if (host == name or host.endswith("." + name)) and path.startswith(start):
                if best is None or len(name + start) > len(best[0]):
                    best = (name + start, verdict)
        return host, path, best

    got = {r["page_id"]: r for r in queries.QUERIES["op1_url_models"](spark, SF).collect()}
    pages = duck.execute("SELECT page_id, url FROM pages").fetchall()
    assert len(got) == len(pages)
    for page, url in pages:
        host, path, rule = expected(url)
        r = got[page]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0])
        assert r["verdict"] == rule[1] if rule else r["verdict"] in ("allow", "block")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_nearest(spark, duck, sf):
    found = duck.execute(f"SELECT vec_id, embedding FROM '{DATA}/{sf}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids = np.array([v for v, _ in found])
    x = np.array([e for _, e in found], dtype=float)
    norms = np.sqrt((x * x).sum(axis=1))
    got = defaultdict(list)
    for r in queries.QUERIES["op2_adaptive_scan"](spark, f"{DATA}/{sf}").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for at in np.flatnonzero(ids % 50 == 0):
        cosine = (x * x[at]).sum(axis=1) / norms / norms[at]
        cosine[at] = -2
        mine = got[ids[at]]
        assert len(mine) == 5 and [s for _, s in mine] == pytest.approx([cosine[np.searchsorted(ids, v)] for v, _ in mine])
        assert mine == sorted(mine, key=lambda m: (-m[1], m[0]))
        hit += len({v for v, _ in mine} & set(ids[np.lexsort((ids, -cosine))[:5]].tolist()))
    assert hit >= 0.9 * 5 * len(got)


def test_document_counts(spark, texts):
    def expected(text):
        data = (text or "").encode()
        words = data.split()
        plain = [w.decode() for w in words]
        lines = [line for line in data.split(b"\n") if line.split()]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        marked = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        n = len(words)
        failed = n < 20 or 100 * len(marked) > 30 * n
        return n, sum(map(len, plain)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked), failed

    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = {r[0]: r[1:] for r in rows(spark, "op5_quality_rules", "doc_id", *columns)}
    assert {i: g[:6] for i, g in got.items()} == {i: expected(t) for i, t in texts}
    assert not any(g[5] and g[6] for g in got.values())


def test_pieces(spark, texts):
    import sentencepiece

    from spanloom.llm.pieces import model_path

    model = sentencepiece.SentencePieceProcessor(model_file=model_path())
    expected = []
    for i, text in texts:
        ids = model.encode(text or "")
        joined = ",".join(map(str, ids))
        expected.append((i, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert rows(spark, "op6_sentencepiece", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected


def test_components(spark, texts):
    got = rows(spark, "op8_jaccard_components", "doc_id", "n_shingles", "component_id")
    assert got == components(texts)


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    from spanloom.llm.rans import vocabulary_path

    model = Tokenizer.from_file(vocabulary_path())
    start, expected = 0, []
    for i, text in texts:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert rows(spark, "op9_token_rans", "doc_id", "start", "n_tokens", "ids_crc32") == expected


def test_ordinal_query(spark, texts):
    got = rows(spark, "op7_ordinal_quality", "doc_id", "expected_grade", "tail_probability")
    assert [g[0] for g in got] == [i for i, _ in texts]
    assert all(0 <= e <= 2 and 0 <= t <= 1 and t <= e for _, e, t in got)


def test_pipeline(spark, duck, texts):
    """Each stage against what its operator says of the stage's input."""
    import corpus_pipeline
    from spanloom.llm import jaccard_join, ordinal, pieces, quality_rules
    from spanloom.operators.storage import written

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)

    def ids(df):
        return sorted(r[0] for r in df.select("doc_id").collect())

    ruled = written(stages[names[0]](spark, docs, SF), "t")
    judged = quality_rules.judged(docs, quality_rules.train(docs, labels))
    assert ids(ruled) == ids(judged.where("kept")) and ruled.columns == columns
    good = written(stages[names[1]](spark, ruled, SF), "t")
    assert ids(good) == ids(ordinal.scored(ruled, ordinal.train(ruled, labels)).where("kept"))
    single = written(stages[names[2]](spark, good, SF), "t")
    kept = components([tuple(r) for r in good.select("doc_id", "text").collect()])
    assert ids(single) == sorted({c for _, _, c in kept})
    mixed = written(stages[names[3]](spark, single, SF), "t")
    assert mixed.columns == columns and set(ids(mixed)) <= set(ids(single))
    last = written(stages[names[4]](spark, mixed, SF), "t")
    assert ids(last) == ids(mixed)
    assert jaccard_join.PERCENT == 85 and pieces.MODEL == "piece_bpe_32k.model"
