"""Every operator on rows that break things, and on none."""

from __future__ import annotations

import numpy as np
import pytest
from awkward import DOCUMENTS, LONG
from pyspark.sql import functions as F

from spanloom.llm import ann, chat, curriculum, jaccard_join, ordinal, pieces, quality_rules, rans, url_model, warc


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


LABELS = "doc_id long, quality int, toxic int"


def test_mix(docs, no_docs):
    out = curriculum.mixed(docs).collect()
    assert len(out) == len(DOCUMENTS)
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0)
    for source in {r["source"] for r in out}:
        mine = [r for r in out if r["source"] == source]
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"])
    total = sum(r["size"] for r in out)
    targets = {r["source"]: r["target"] for r in out}
    assert sum(targets.values()) == pytest.approx(total)
    again = curriculum.mixed(docs.repartition(3))
    assert sorted_rows(again, "doc_id", "taken") == sorted((((r["doc_id"], r["taken"])) for r in out), key=repr)
    assert curriculum.mixed(no_docs).isEmpty() and curriculum.training_order(no_docs).isEmpty()
    ordered = curriculum.training_order(docs)
    assert ordered.columns == docs.columns
    starts = sum(r["copies"] for r in out)
    assert ordered.count() == starts and ordered.where("_fingerprint <> 15").isEmpty()


def test_schedules_invert():
    for ramp in curriculum.SCHEDULES:
        t = np.linspace(0, 1, 11)
        share = (ramp.first * t + (ramp.last - ramp.first) * t * t / 2) / ramp.integral
        slope = ramp.last - ramp.first
        area = share * ramp.integral
        assert np.allclose(2 * area / (ramp.first + np.sqrt(ramp.first**2 + 2 * slope * area)), t)


PAGES = [
    (1, "http://Ex.ORG/fr/a?b#c", "x" * 1500),
    (2, None, "x" * 1500),
    (2, None, "x" * 1500),
    (3, "no scheme", None),
    (4, "", ""),
    (None, "https://a.net", "x" * 1500),
    (-5, "ftp://example.net/en/\r\nx", "ü" * 700),
    (6, "http://u@h:80?q=http://x", "ü" * 700),
    (7, "a://b://c/d", "y" * 999),
    (8, "a://b://c/d", "y" * 999),
]
PAGE_SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark, docs):
    frame = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    return frame.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("file", "offset", "length", "record", "rule", "score"))])


def test_warc(spark, pages):
    index, path = warc.write_archive(pages)
    out = warc.read_records(index, path)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out.collect()), key=repr)
    expected = [
        (1, "revisit", 2, 1500), (2, "response", None, 1500), (2, "response", None, 1500), (3, "response", None, 0),
        (4, "response", None, 0), (None, "revisit", 2, 1500), (-5, "revisit", 6, 1400), (6, "response", None, 1400),
        (7, "response", None, 999), (8, "response", None, 999),
    ]
    assert got == sorted(expected, key=repr)
    texts = {r["page_id"]: bytes(r["payload"]) for r in out.where("record_type = 'response'").collect()}
    assert texts[6] == ("ü" * 700).encode() and texts[7] == b"y" * 999
    some = warc.read_records(index.where("page_id = 7"), path)
    assert [r["page_id"] for r in some.collect()] == [7]
    index, path = warc.write_archive(pages.limit(0))
    assert warc.read_records(index, path).isEmpty()


def test_warc_files_are_gzip(spark, pages):
    import gzip

    index, path = warc.write_archive(pages)
    whole = b"".join(gzip.decompress(bytes(r["content"])) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect())
    assert whole.count(b"WARC/1.1\r\n") == len(PAGES)


def test_ranges_are_merged(spark):
    rows = [(0, 0, 10), (0, 10, 10), (0, 500, 10), (1, 0, 10)]
    index = spark.createDataFrame(rows, "file long, offset long, length long")
    out = warc.byte_ranges(index, gap=100, read=1000)
    assert sorted_rows(out, "file", "start", "end") == [(0, 0, 20), (0, 500, 510), (1, 0, 10)]
    assert warc.byte_ranges(index, gap=1000, read=400).count() == 3


def test_urls(spark, pages):
    out = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_model.filtered(pages).collect()}
    assert (1, "ex.org", "/fr/a", "org/fr/", "allow") in out
    assert (-5, "example.net", "/en/\r\nx", "example.net/en/", "allow") in out
    assert (6, "u@h:80", "", None, "allow") in out and (7, "b:", "//c/d", None, "allow") in out
    assert (2, "", "", None, "allow") in out and (3, "", "", None, "allow") in out
    assert url_model.filtered(pages.limit(0)).isEmpty()


def test_url_models_learn(spark):
    rows = [(i, f"http://a{i % 7}.example.{'net/en' if i % 2 else 'com/de'}/x{i}") for i in range(400)]
    rows += [(1000 + i, f"http://b.example.info/{'en' if i % 2 else 'de'}/y{i}") for i in range(20)]
    out = url_model.filtered(spark.createDataFrame(rows, "page_id long, url string"))
    score = {r["page_id"]: r["score"] for r in out.collect()}
    assert all(score[1000 + i] > score[1000 + j] for i in range(1, 20, 2) for j in range(0, 20, 2))


def test_smoothing_sums_to_one():
    counts = np.zeros((url_model.SYMBOLS,) * (url_model.ORDER + 1), dtype=np.float32)
    counts[0, 0, 0, 5] = 3
    counts[0, 0, 5, 6] = 1
    assert np.allclose(np.exp(url_model.smoothed(counts)).sum(axis=-1), 1, atol=1e-4)


def test_neighbours_of_odd_vectors(spark, docs):
    rng = np.random.default_rng(1)
    good = [(i, rng.standard_normal(8).tolist(), 1) for i in range(300)]
    same = [(1000 + i, [1.0] * 8, 1) for i in range(700)]
    odd = [(5000, None, 1), (5001, [0.0] * 8, 1), (5002, [float("nan")] + [1.0] * 7, 1), (5003, [None] + [1.0] * 7, 1), (None, [1.0] * 8, 1), (5004, [float("inf")] * 8, 1)]
    vectors = spark.createDataFrame(good + same + odd, "vec_id long, embedding array<float>, rank int")
    out = ann.search(vectors, vectors.where("vec_id % 50 = 0")).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(found) == set(range(0, 300, 50)) | set(range(1000, 1700, 50))
    assert found[1000] == [1001, 1002, 1003, 1004, 1005] and found[1650] == [1000, 1001, 1002, 1003, 1004]
    few = vectors.where("vec_id < 3")
    got = ann.search(few, few)
    assert sorted_rows(got, "query_id", "rank") == [(q, r) for q in range(3) for r in (1, 2)]
    assert ann.search(vectors.limit(0), vectors).isEmpty()


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.standard_normal((48, 900)).astype(np.float32)
        q = rng.standard_normal(48).astype(np.float32)
        whole = np.square(x - q[:, None]).sum(axis=0)
        kept = ann.scan(x, q, 5, float("inf"))
        assert set(np.argsort(whole)[:5]) <= set(kept) and len(kept) < 20


TURNS = [
    (1, 0, "user", None, 0), (1, 1, "assistant", "a\\b</s>[INST]", 0), (1, 1, "assistant", "a\\b</s>[INST]", 0),
    (2, 0, None, "x<|>y\\", 0), (2, None, "assistant", "<", 0), (None, 0, "system", "no id", 0),
    (3, 0, "a<|>b\n", "<<s>[/INST]\\\\", 0), (4, 0, "assistant", "", 0),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string, conv_key int")
    chats = chat.formatted(chat.canonical(rows))
    back = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in chats.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    said = ("assistant", "a\\b</s>[INST]")
    assert back == {
        1: [("user", ""), said, said], 2: [("assistant", "<"), ("", "x<|>y\\")], None: [("system", "no id")],
        3: [("a<|>b\n", "<<s>[/INST]\\\\")], 4: [("assistant", "")],
    }
    masked = {r["conv_id"]: r["m"] for r in chats.select("conv_id", chat.under_mask(F.col("formatted"), F.col("loss")).alias("m")).collect()}
    assert masked == {1: said[1] * 2, 2: "<", None: "", 3: "", 4: ""}
    assert chat.formatted(chat.canonical(rows.limit(0))).isEmpty()


def test_layouts_agree(spark):
    kinds = [
        ("conv_id long, prompt string, completion string", (1, "q", "a")),
        ("conv_id long, prompt string, response string", (1, "q", "a")),
        ("conv_id long, instruction string, output string, extra int", (1, "q", "a", 5)),
        ("conv_id long, instruction string, input string, output string", (1, "q", None, "a")),
        ("conv_id long, messages array<struct<role string, content string>>", (1, [("user", "q"), ("assistant", "a")])),
        ("conv_id long, conversations array<struct<from string, value string>>", (1, [("human", "q"), ("gpt", "a")])),
    ]
    for schema, row in kinds:
        df = spark.createDataFrame([row], schema)
        (out,) = chat.canonical(df).collect()
        assert [tuple(t) for t in out["turns"]] == [("user", "q"), ("assistant", "a")], schema
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical(spark.createDataFrame([(1, 2)], "conv_id long, other int"))


def test_rules(spark, docs, no_docs):
    out = quality_rules.judged(docs, None)
    got = {(r["doc_id"], r["n_words"], r["kept"]) for r in out.collect()}
    assert out.count() == len(DOCUMENTS) and (3, 0, False) in got and (7, 30_000, True) in got
    assert quality_rules.judged(no_docs, None).isEmpty()
    assert quality_rules.accepted(docs, None).columns == docs.columns
    empty = spark.createDataFrame([], LABELS)
    assert quality_rules.train(docs, empty) is None and ordinal.train(docs, empty) is None
    odd = spark.createDataFrame([(0, 1, 0), (0, None, None), (None, 1, 0), (99, 0, 1)], LABELS)
    assert quality_rules.train(docs, odd) is None


def test_few_labels_and_repeated_ids(spark):
    """Ten labelled documents make models; a thousand rows of one id are one row of the sample."""
    good = "The clerk counts every sheet of paper twice before the evening bell rings out over town. "
    bad = "# $ % & | buy now # $ % buy now "
    texts = [(i, (good if i % 2 else bad) * 5 + f" number {i}") for i in range(10)]
    docs = spark.createDataFrame([*texts, *((3, f"{good} copy {i}") for i in range(1000))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)], LABELS)
    sample = quality_rules.labelled_sample(docs, labels, "quality", 50).collect()
    assert sorted(r["doc_id"] for r in sample) == list(range(10))
    assert len(quality_rules.labelled_sample(docs, labels, "quality", 4).collect()) == 4
    assert quality_rules.train(docs, labels) is not None
    model = ordinal.train(docs, labels)
    tails = {r["doc_id"]: r["tail_probability"] for r in ordinal.scored(docs.limit(10), model).collect()}
    assert min(t for i, t in tails.items() if i % 2) > max(t for i, t in tails.items() if not i % 2)


def test_mixed_widths_and_visits(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(91)] + [(200 + i, [1.0, float(i)]) for i in range(4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.search(vectors, vectors.where("vec_id % 50 = 0")).collect()
    assert {r["query_id"] for r in out} == {0, 50}
    x = rng.standard_normal((3000, 24))
    clustered = np.repeat(rng.standard_normal((30, 24)) * 9, 100, axis=0) + rng.standard_normal((3000, 24))
    spread, tight = (ann.visits(ann.fit(m, 50), m, 5) for m in (x, clustered))
    assert tight <= 5 < spread <= 50
    assert ann.visits(ann.fit(x[:1], 8), x[:1], 5) == 1


def test_trees_learn_and_keep_their_direction():
    rng = np.random.default_rng(5)
    x = rng.random((2000, len(quality_rules.FEATURES)))
    y = (x[:, 2] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.standard_normal(2000) < 0.6).astype(float)
    direction = np.array([d for _, d in quality_rules.FEATURES])
    trees = quality_rules.fit_trees(x[:1500], y[:1500], direction)
    assert ((trees.margin(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.9
    for f in np.flatnonzero(direction):
        grid = np.repeat(x[:50], 40, axis=0)
        grid[:, f] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(trees.margin(grid).reshape(50, 40), axis=1)
        assert (steps * direction[f] >= -1e-9).all()


def test_ordinal_learns(spark, docs, no_docs):
    rng = np.random.default_rng(2)
    rows, grades = [], []
    hashing = ordinal.Hashing()
    for i in range(600):
        grade = i % 3
        words = [f"word{rng.integers(300)}" for _ in range(60)] + {0: ["$$$"] * 4, 1: ["nasty", "vile"], 2: []}[grade]
        rows.append(hashing.of_text(" ".join(words)))
        grades.append(grade)
    grades = np.array(grades)
    model = ordinal.calibrated(rows[:450], grades[:450])
    tails = model.tails(rows[450:])
    assert (np.diff(model.cuts) > 0).all()
    kept = tails[:, -1] >= model.least_tail
    assert kept[grades[450:] == 2].mean() > 0.95 and kept[grades[450:] < 2].mean() < 0.2
    out = ordinal.scored(docs, model)
    assert out.count() == len(DOCUMENTS) and out.where("expected_grade is null").isEmpty()
    assert ordinal.scored(no_docs, model).isEmpty()


def test_spans(docs, no_docs):
    path = pieces.model_path()
    out = pieces.encoded(docs, path).collect()
    assert len(out) == len(DOCUMENTS)
    texts = {d: t for d, t, *_ in DOCUMENTS if d != 9}
    for r in out:
        if r["doc_id"] == 9:
            continue
        data = (texts[r["doc_id"]] or "").encode()
        ends, starts = r["ends"], r["starts"]
        assert len(r["ids"]) == len(ends) == len(starts)
        assert not ends or (ends[-1] == len(data) and starts[0] == 0)
        assert all(a <= b for a, b in zip(starts, starts[1:]))
    assert pieces.encoded(no_docs, path).isEmpty() and pieces.digests(no_docs, path).isEmpty()


def test_words_apart_equal_the_library():
    import random

    made = pieces.Pieces(pieces.model_path())
    rng = random.Random(4)
    alphabet = ["a", "b", " ", "  ", "\n", "é", "▁", "<s>", "<0x0A>", "日本", "\U0001f600", "\u00a0", "\t", "the", "ing", "."]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)]
    assert [x.tolist() for x in made.encode(texts)] == made.model.encode(texts)


def test_character_map():
    """A map built by hand: "ab" becomes "x", "a" becomes "yy"."""
    import struct

    units = [0] * 1024
    replacements = b"yy\0x\0"

    def offset_unit(offset, label, leaf):
        return (offset << 10) | label | (leaf << 8)

    def place(at, value):
        units[at] = value

    # root at 0 with offset 256; child for "a" at 256 ^ 97; its value at (own ^ offset)
    place(0, offset_unit(256, 0, 0))
    a = 256 ^ 97
    place(a, offset_unit(512, 97, 1))
    place(a ^ 512, 0 | (1 << 31))
    b = (a ^ 512) ^ 98
    place(b, offset_unit(600, 98, 1))
    place(b ^ 600, 3 | (1 << 31))
    chars = pieces.CharMap(struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + replacements)
    assert chars.longest(b"abc", 0) == (2, b"x")
    assert chars.longest(b"ac", 0) == (1, b"yy")
    assert chars.longest(b"c", 0) is None
    model = pieces.Pieces(pieces.model_path())
    model.chars = chars
    normal = model.normalised("ab a")
    assert normal.data == "▁x▁yy".encode()
    assert normal.start[3:].tolist() == [0, 2, 2, 2, 3, 3] and normal.end[3:].tolist() == [2, 3, 3, 3, 4, 4]


def test_jaccard(docs, no_docs):
    out = jaccard_join.joined(docs)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert out.count() == len(DOCUMENTS)
    assert {c for d, _, c in got if d in (0, 1, 2)} == {0}
    assert (3, 0, 3) in got and (5, 0, 5) in got and (6, 1, 6) in got
    assert {c for d, _, c in got if d is None} == {None} and {c for d, _, c in got if d == 9} == {9}
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted((r[0] for r in kept.select("doc_id").collect()), key=repr)
    assert ids == sorted([0, 3, 4, 5, 6, 7, 8, 9, 9, 10, None], key=repr)
    assert jaccard_join.joined(no_docs).isEmpty() and jaccard_join.representatives(no_docs).isEmpty()


@pytest.mark.parametrize("leaf, block", [(4, 256), (4096, 256), (4096, 3)])
def test_regions_recurse_exactly(spark, monkeypatch, leaf, block):
    """A source with many near copies, chains, and a shared passage; small leaves go through pivots."""
    import random

    from plain_components import components

    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    chain = list(base[:80])
    for i in range(40, 60):
        chain[(i * 7) % 80] = f"c{i}"
        rows.append((i, " ".join(chain)))
    for i in range(60, 90):
        rows.append((i, " ".join(passage + [f"u{i}x{k}" for k in range(rng.randrange(5, 40))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.joined(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == components(rows)


def test_cells_lose_no_link_across_a_boundary(spark):
    """Linked documents on both sides of a boundary share a cell in which one is core."""
    p, q, x, y = range(4)
    far = {(p, x): 387, (q, x): 462, (p, y): 462, (q, y): 387, (p, q): 600, (q, p): 600}
    rows = [(7, n, 1000, 0.1, 0, True, 4, v) for n in (p, q, x, y) for v in (p, q)]
    held = spark.createDataFrame(rows, "region long, node long, n int, apart double, family long, core boolean, size long, pivot long")
    chosen = spark.createDataFrame([(7, [p, q])], "region long, pivots array<long>")
    measured = spark.createDataFrame([(a, b, 1000 - d, 1000) for (a, b), d in far.items()], "a long, b long, both int, either int")
    cells = {}
    for r in jaccard_join._cells(held, chosen, measured, 85, 1).collect():
        cells.setdefault(r["region"], {})[r["node"]] = r["core"]
    assert any({x, y} <= set(c) and (c[x] or c[y]) for c in cells.values())


@pytest.mark.parametrize("leaf", [4, jaccard_join.LEAF])
def test_links_are_true_and_connect(spark, monkeypatch, leaf):
    """Brute force over families of near copies, chains between them and equal texts."""
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    entered = []
    cells = jaccard_join._cells
    monkeypatch.setattr(jaccard_join, "_cells", lambda *a: entered.append(a[4]) or cells(*a))
    rng = np.random.default_rng(4)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(100)]
        for _ in range(30):
            if len(rows) % 10 == 9:
                base[int(rng.integers(100))] = f"m{len(rows)}"
            words = [w if rng.random() > 0.05 else f"n{rng.integers(10**6)}" for w in base]
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), rows[-1][1]))
    sets = [set(t.split()) for _, t in rows]
    near = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    least = list(range(len(sets)))
    for _ in sets:
        least = [min(l for l, t in zip(least, sets) if near(s, t)) for s in sets]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.joined(df, words=1).collect()}
    assert got == dict(enumerate(least))
    assert bool(entered) == (leaf < 30)


def test_first_regions_lose_no_link():
    """Linked sets keep a common pivot whatever the order passes over."""
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = set(rng.choice(10_000, n, replace=False).tolist())
        b = set(a)
        for x in list(a)[: int(rng.integers(0, n // 6 + 1))]:
            b.discard(x)
            b.add(int(rng.integers(10_000, 20_000)))
        if not b or 100 * len(a & b) < 85 * len(a | b):
            continue
        lists = []
        for s in (a, b):
            size = len(s)
            first = sorted(s)[: jaccard_join.missing(size) + 1 + jaccard_join.spare(size)]
            least = -(-85 * size // 100)
            order = sorted(first, key=lambda x: (x * 7919 % 13, x))
            lists.append(set(order[: len(order) - jaccard_join.spare(least)]))
        assert lists[0] & lists[1]


def test_token_files(spark, docs, no_docs):
    folder = rans.write_ids(docs, rans.vocabulary_path(), block=1000, file_ids=5000)
    out = rans.read_ids(spark, folder).orderBy("start").collect()
    assert len(out) == len(DOCUMENTS)
    ids = [r["doc_id"] for r in out]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    model = rans.Encoder(rans.vocabulary_path()).model
    texts = {d: t for d, t, *_ in DOCUMENTS if d != 9}
    start = 0
    for r in out:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        start += r["n_tokens"]
        if r["doc_id"] != 9:
            assert r["ids"] == [*model.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, rans.END_ID]
    assert rans.read_ids(spark, rans.write_ids(no_docs, rans.vocabulary_path())).isEmpty()


def test_encoder_equals_the_library():
    import random

    made = rans.Encoder(rans.vocabulary_path())
    rng = random.Random(6)
    alphabet = ["a", "b", " ", "  ", "\n", "é", "<|endoftext|>", "'s", "日本", "\U0001f600", "\u00a0", "\t", "the", "ing", ".", "12", "!?", "\x1c", "÷", "Q"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)] + [LONG]
    expected = [np.array(x.ids, dtype="<u4").tobytes() for x in made.model.encode_batch(texts, add_special_tokens=False)]
    assert made.encode(texts) == expected and made.encode(texts) == expected


@pytest.mark.parametrize("count", [1, 5, 512, 5000])
def test_blocks_round_trip(count):
    rng = np.random.default_rng(count)
    ids = (rng.zipf(1.3, count) % 700).astype(np.uint32)
    table = rans.frequency_table(np.bincount(ids, minlength=800))
    assert table.sum() == 1 << rans.PRECISION
    coder = rans.Coder(table)
    record = rans.block_record(coder, ids, rans.doc_entry(None, 3) + rans.doc_entry(-4, 9))
    got, docs = rans.read_block(coder, record)
    assert (got == ids).all() and docs == [(None, 3), (-4, 9)]
    spoiled = bytearray(record)
    spoiled[-1] ^= 1
    if count > 600:
        with pytest.raises(ValueError, match="checksum"):
            rans.read_block(coder, bytes(spoiled))


def test_frequency_table_holds_every_symbol():
    counts = np.array([10**12, 1, 0, 1, 5])
    table = rans.frequency_table(counts, 4)
    assert table.sum() == 16 and (table[counts > 0] > 0).all() and table[2] == 0
    assert rans.frequency_table(np.zeros(3, dtype=np.int64)).sum() == 0
