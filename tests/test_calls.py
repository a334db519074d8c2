from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import calls as ops
from spanloom.operators.stacks import CHUNK, call_tree
from spanloom.plans.traces import TraceAnalysis

EVENTS = "run int, tid long, ts long, seq long, ph string, name string"


def random_trace(seed: int, calls: int = 120):
    """Nested calls in two threads of one run, with the tree they came from."""
    rng = random.Random(seed)
    events, expected = [], {}
    for tid in (1, 2):
        clock, stack, seq, left = 0, [], 0, calls if tid == 1 else 9
        while left or stack:
            clock += rng.randrange(1, 5)
            opening = left and (not stack or rng.random() < 0.55)
            if opening:
                parent = stack[-1][0] if stack else None
                stack.append((seq, clock, f"f{rng.randrange(5)}"))
                expected[tid, seq] = [stack[-1][2], parent, len(stack), clock, None]
                events.append((7, tid, clock, seq, "B", stack[-1][2]))
                left -= 1
            else:
                call, _, name = stack.pop()
                expected[tid, call][4] = clock
                events.append((7, tid, clock, seq, "E", name))
            seq += 1
    rng.shuffle(events)
    return events, expected


@pytest.mark.parametrize("cut, chunk", [(3, 1), (20, 16), (None, CHUNK)])
@pytest.mark.parametrize("seed", [1, 5])
def test_tree_is_rebuilt(spark, seed, cut, chunk):
    events, expected = random_trace(seed)
    df = spark.createDataFrame(events, EVENTS)
    stats = call_tree(df, slices=cut, chunk=chunk).cache()
    got = {
        (r["tid"], r["call_id"]): [r["function_name"], r["parent_id"], r["level"], r["start_ts"], r["end_ts"]]
        for r in stats.collect()
    }
    assert got == expected

    # Self times of a thread add up to its root durations.
    sums = {r["tid"]: (r["s"], r["d"]) for r in stats.groupBy("tid").agg(
        F.sum("self_time").alias("s"), F.sum(F.when(F.col("level") == 1, F.col("duration"))).alias("d")
    ).collect()}
    assert all(own == roots for own, roots in sums.values())

    paths = ops.critical_paths(stats, 4).collect()
    chains = []
    for (tid, call), (name, _, _, start, _) in expected.items():
        if any(other[1] == call and t == tid for (t, _), other in expected.items()):
            continue
        chain, at = [], call
        while at is not None:
            chain.insert(0, at)
            at = expected[tid, at][1]
        score = sum(expected[tid, c][4] - expected[tid, c][3] for c in chain[1:])
        chains.append((-score, start, tid, call, chain))
    best = sorted(chains)[:4]
    ranked = {}
    for r in sorted(paths, key=lambda r: (r["rank"], r["pos"])):
        ranked.setdefault(r["rank"], []).append(r["call_id"])
    assert ranked == {i: c[4] for i, c in enumerate(best, 1)}


def test_unmatched_begin_is_dropped_and_counted(spark):
    events = [
        (1, 1, 0, 0, "B", "main"),
        (1, 1, 1, 1, "B", "a"),
        (1, 1, 2, 2, "E", "a"),
        (1, 1, 3, 3, "B", "b"),
        (1, 1, 4, 4, "E", "b"),
    ]
    for chunk in (CHUNK, 2):
        df = spark.createDataFrame(events, EVENTS)
        calls = call_tree(df, chunk=chunk)
        assert sorted(r["function_name"] for r in calls.collect()) == ["a", "b"]
        row = ops.unmatched_events(df, calls).head()
        assert (row["open_begins"], row["stray_ends"]) == (1, 0)


def plain_tree(events):
    """The same by one stack per thread, over whole lists."""
    done, children = [], {}
    for run, tid in sorted({(e[0], e[1]) for e in events}):
        stack, calls = [], {}
        for _, _, ts, seq, ph, name in sorted(e for e in events if e[:2] == (run, tid)):
            if ph == "B":
                stack.append(seq)
                calls[seq] = [name, len(stack), ts, None, stack[-2] if len(stack) > 1 else None]
            elif stack:
                calls[stack.pop()][3] = ts
        took = {c: v[3] - v[2] for c, v in calls.items() if v[3] is not None}
        for call, (name, level, start, end, parent) in calls.items():
            if end is None:
                continue
            inner = [took[c] for c in took if calls[c][4] == call]
            score, at = 0, call
            while calls[at][1] > 1:
                score, at = score + took.get(at, 0), calls[at][4]
            parent = parent if parent in took else None
            own = max(0, took[call] - sum(inner))
            done.append((tid, call, name, level, start, end, parent, own, len(inner), score))
    return sorted(done, key=repr)


TREE = "tid call_id function_name level start_ts end_ts parent_id self_time num_children score".split()


@pytest.mark.parametrize("cut, chunk", [(4, 1), (3, 11), (None, CHUNK)])
def test_torn_traces(spark, cut, chunk):
    """Begins that never end, ends that never began, and a thread split over all slices."""
    rng = random.Random(8)
    events, clock = [], 0
    for seq in range(400):
        clock += rng.randrange(0, 3)
        tid = 1 if rng.random() < 0.8 else None if rng.random() < 0.5 else 2
        events.append((7, tid or 0, clock, seq, rng.choice("BE"), rng.choice("fgh")))
    events += [(8, 5, t, t, "B", "open") for t in range(9)] + [(9, 5, t, t, "E", "stray") for t in range(9)]
    df = spark.createDataFrame(events, EVENTS)
    got = call_tree(df, slices=cut, chunk=chunk).where("run = 7").select(*TREE).collect()
    assert sorted(map(tuple, got), key=repr) == plain_tree([e for e in events if e[0] == 7])
    assert call_tree(df.where("run > 7"), slices=cut, chunk=chunk).isEmpty()


def test_tree_of_text_keys_nulls_and_nothing(spark):
    """Runs named by text, a thread without a number, rows that are no events, extra columns."""
    rows = [
        ("a", None, 1.5, 0, "B", "f", 1), ("a", None, 2.0, 1, "B", None, 1), ("a", None, None, 2, "E", "f", 1),
        ("a", None, 2.5, 3, "X", "f", 1), ("a", None, 3.0, 4, "E", None, 1), ("a", None, 4.0, 5, "E", "f", 1),
    ]
    columns = "run string, tid string, ts double, seq long, ph string, name string, level int"
    df = spark.createDataFrame(rows, columns)
    for chunk in (1, 2, CHUNK):
        got = sorted(map(tuple, call_tree(df, chunk=chunk).select(*TREE).collect()), key=repr)
        assert got == [
            (None, 0, "f", 1, 1.5, 4.0, None, 1.5, 1, 0.0),
            (None, 1, None, 2, 2.0, 3.0, 0, 1.0, 0, 1.0),
        ]
        paths = ops.critical_paths(call_tree(df, chunk=chunk)).collect()
        assert sorted(r["pos"] for r in paths) == [0, 1]
    assert call_tree(df.limit(0)).isEmpty()


# Durations along a recorded path, root first.
PATH = [
    ("main", 7312000),
    ("decompress", 7280000),
    ("free_resources", 182000),
    ("pool_free_writer", 109000),
    ("pool_destroy", 108000),
    ("pool_join", 102000),
    ("pool_free", 104000),
]


def test_recorded_path(spark):
    df = spark.createDataFrame(
        [("p", pos, name, d) for pos, (name, d) in enumerate(PATH)],
        "path string, pos long, function_name string, duration long",
    )
    row = ops.path_durations(df, ["path"]).head()
    assert (row["critical_duration"], row["total_duration"], row["path_length"]) == (7280000, 7312000, 7)
    slow = sorted(ops.path_bottlenecks(df, ["path"]).collect(), key=lambda r: r["bottleneck_rank"])
    assert [r["function_name"] for r in slow][:2] == ["decompress", "free_resources"]
    assert [r["function_name"] for r in slow][-2:] == ["pool_free", "pool_join"]
    assert slow[0]["percentage_of_path"] == pytest.approx(92.3272035510463, rel=1e-14)
    assert slow[-1]["percentage_of_path"] == pytest.approx(1.2935954343690552, rel=1e-14)


def test_self_time_is_never_negative(spark):
    """A rounded child may last longer than its parent."""
    calls = spark.createDataFrame(
        [(1, 1, 0, "join", 1, None, 102), (1, 1, 1, "free", 2, 0, 104)],
        "run int, tid long, call_id long, function_name string, level long, parent_id long, duration long",
    )
    got = {r["function_name"]: (r["self_time"], r["num_children"]) for r in ops.call_stats(calls).collect()}
    assert got == {"join": (0, 1), "free": (104, 0)}


def test_flow_summary(spark):
    events, expected = random_trace(9, 30)
    flow = TraceAnalysis(spark.createDataFrame(events, EVENTS), top_k=3)
    row = flow.summary.head()
    assert (row["num_paths_requested"], row["num_paths_found"]) == (3, 3)
    assert (row["num_threads"], row["total_function_calls"]) == (2, len(expected))
    shares = [r["self_share"] for r in ops.hotspots(flow.stats).collect()]
    assert sum(shares) == pytest.approx(1.0) and len(shares) <= 5
