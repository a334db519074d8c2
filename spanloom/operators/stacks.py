"""Call trees from begin/end events in one ordered pass.

A stretch of a thread is summed up as the ends it leaves unopened and the begins
it leaves open. Such summaries compose, so events are dealt once by range of
thread and time, and each task folds its sorted events in chunks of bounded
size: calls that begin and end inside a chunk leave it finished but for what they
owe to the frames around them, and only the chunk's edges, at most a call stack
per chunk and thread, are composed over chunks. An edge frame's parent is an edge
frame too, so levels, parents, children and chain scores of the edges are settled
among the edges alone, and one join brings them to the calls that hang from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .calls import THREAD, chain_scores
from .storage import written

#: Events a task folds at a time: bounds its memory, whatever a thread's length.
CHUNK = 1 << 17
#: Places of a partition's events start at its number times this.
PLACES = 1 << 40

CALL, BEGIN, END, ENTRY = range(4)


def _runs(table: pa.Table, names: list[str]) -> np.ndarray:
    """Numbers from 0 of the stretches in which the named columns stay equal."""
    change = np.zeros(table.num_rows, dtype=bool)
    for name in names:
        codes = table[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change)


def _before(values: np.ndarray, seg: np.ndarray, width: int) -> np.ndarray:
    """Running minimum of ``values``, all in ``-width..0``, begun anew in each stretch."""
    shift = seg * (width + 1)
    return np.minimum.accumulate(values - shift) + shift


def fold_chunk(events: pa.Table, first: int) -> dict[str, np.ndarray | pa.Array]:
    """Finished calls and edges of sorted events, as columns.

    ``level`` and ``low`` count from the stretch's entry; ``low`` is the least
    count up to the row. ``host`` names an edge, ``up`` the edge a call or open
    begin hangs from: the innermost begin left open, else the end that closes the
    frame entered with, else the stretch's entry.
    """
    n = events.num_rows
    at = np.arange(n)
    seg = _runs(events, THREAD)
    starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    begins = events["begins"].to_numpy()
    ts, seq = events["ts"].to_numpy(), events["seq"].to_numpy()
    step = np.where(begins, 1, -1)
    total = np.cumsum(step)
    count = total - (total[starts] - step[starts])[seg]
    level = np.where(begins, count, count + 1)
    low = _before(np.minimum(count, 0), seg, n)

    # At one level of one thread begins and ends alternate.
    span = int(level.max() - level.min()) + 2
    key = seg * span + (level - level.min()) + 1
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    opened_by = np.full(n, -1)
    opened_by[order[1:][same]] = order[:-1][same]
    ends = np.flatnonzero(~begins & (opened_by >= 0))
    calls = opened_by[ends]
    closed = np.zeros(n, dtype=bool)
    closed[calls] = True
    left_open, unopened = begins & ~closed, ~begins & (opened_by < 0)

    # The parent is the latest begin one level up.
    by_level = order[begins[order]]
    found = np.searchsorted(key[by_level] * n + by_level, (key - 1) * n + at) - 1
    parent = np.where(found >= 0, np.append(by_level, -1)[found], -1)
    parent[(parent >= 0) & (key[parent] != key - 1)] = -1

    # Edges: the open begin before, else the unopened end after, else the entry (n + stretch).
    open_before = np.maximum.accumulate(np.where(left_open, at, -1))
    held = np.where((open_before >= 0) & (seg[open_before] == seg), open_before, -1)
    closes_next = np.minimum.accumulate(np.where(unopened, at, n)[::-1])[::-1]
    entered = np.where(
        (closes_next < n) & (seg[np.minimum(closes_next, n - 1)] == seg), closes_next, n + seg
    )
    up = np.where(held >= 0, held, entered)
    up[left_open] = np.where(parent[left_open] >= 0, parent[left_open], entered[left_open])

    duration = ts[ends] - ts[calls]
    over = parent[calls]
    outermost = (over < 0) | left_open[over]
    chain, below = np.zeros(n, ts.dtype), np.zeros(n, ts.dtype)
    for sums, counted in ((chain, duration), (below, np.where(outermost, 0, duration))):
        sums[calls], sums[ends] = counted, -counted
    chain, below = np.cumsum(chain), np.cumsum(below)
    inner, children = np.zeros(n + len(starts), ts.dtype), np.zeros(n + len(starts), np.int64)
    receiver = np.where(outermost, up[calls], over)
    np.add.at(inner, receiver, duration)
    np.add.at(children, receiver, 1)

    edges = np.flatnonzero(left_open | unopened)
    last = np.r_[starts[1:], n] - 1
    # Calls, edges and entries, one below the other; entries stand at their stretch's first event.
    row = np.concatenate([calls, edges, starts])
    kinds = [CALL, np.where(begins[edges], BEGIN, END), ENTRY]
    own = np.concatenate([calls, edges, n + np.arange(len(starts))])
    is_call, is_entry = np.arange(len(row)) < len(calls), own >= n
    hangs = is_call | (~is_entry & begins[row])
    end = np.concatenate([ends, edges, starts])

    def name_of(host: np.ndarray) -> np.ndarray:
        place = np.where(host < n, host, starts[np.maximum(host - n, 0)])
        return np.where(host < n, first + place, -1 - first - place)

    within = is_call & np.r_[~outermost, np.zeros(len(row) - len(calls), bool)]
    return {
        **{c: events[c].combine_chunks().take(pa.array(row)) for c in [*THREAD, "name"]},
        "kind": np.concatenate([np.broadcast_to(k, len(p)) for k, p in zip(kinds, (calls, edges, starts))]).astype(np.int32),
        "stretch": first + starts[seg[row]],
        "place": first + row,
        "host": pa.array(name_of(own), mask=is_call),
        "up": pa.array(name_of(up[row]), mask=~hangs),
        "level": np.where(is_entry, low[last][seg[row]], level[row]),
        "low": np.where(is_entry, low[last][seg[row]], low[row]),
        "net": np.where(is_entry, count[last][seg[row]], 0),
        "seq": seq[row],
        "ts": ts[row],
        "end_seq": seq[end],
        "end_ts": ts[end],
        "parent_id": pa.array(seq[parent[row]], mask=~within),
        "inner_time": inner[own],
        "children": children[own],
        "chain": chain[row],
        "below": below[row],
    }


def _folded(events: DataFrame, slices: int | None, chunk: int) -> DataFrame:
    keys = [*THREAD, "ts", "seq"]
    given = events.where(F.col("ph").isin("B", "E") & F.col("ts").isNotNull()).select(
        *keys, "name", (F.col("ph") == "B").alias("begins")
    ).withColumn("seq", F.col("seq").cast("long"))
    dealt = (
        given.repartitionByRange(*keys) if slices is None else given.repartitionByRange(slices, *keys)
    ).sortWithinPartitions(*keys)
    time = given.schema["ts"].dataType
    if not isinstance(time, T.DoubleType):
        time = T.LongType()
        dealt = dealt.withColumn("ts", F.col("ts").cast("long"))
    whole = ["stretch", "place", "host", "up", "level", "low", "net", "seq", "end_seq", "parent_id", "children"]
    types = {
        **{c: given.schema[c].dataType for c in [*THREAD, "name"]},
        "kind": T.IntegerType(),
        **dict.fromkeys(whole, T.LongType()),
        **dict.fromkeys(["ts", "end_ts", "inner_time", "chain", "below"], time),
    }

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() * PLACES

        def columns(table: pa.Table) -> pa.RecordBatch:
            folded = fold_chunk(table, place)
            return pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c) for c in (folded[k] for k in types)], list(types)
            )

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < chunk:
                continue
            table = pa.Table.from_batches(held)
            whole_chunks = table.num_rows - table.num_rows % chunk
            for start in range(0, whole_chunks, chunk):
                yield columns(table.slice(start, chunk))
                place += chunk
            held = table.slice(whole_chunks).to_batches()
        if sum(b.num_rows for b in held):
            yield columns(pa.Table.from_batches(held))

    schema = T.StructType([T.StructField(k, v) for k, v in types.items()])
    return written(dealt.mapInArrow(fold, schema), "call-chunks")


def _settled(folded: DataFrame) -> DataFrame:
    """Edges with ``frame``, the place of the begin they belong to, and their level.

    A thread's entry counts are prefix sums over its stretches; ends of no begin
    are passed over, so a level counts from the least count so far.
    """
    earlier = Window.partitionBy(*THREAD).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    entries = (
        folded.where(F.col("kind") == ENTRY)
        .withColumn("entry", F.coalesce(F.sum("net").over(earlier), F.lit(0)))
        .withColumn("floor", F.least(F.lit(0), F.min(F.col("entry") + F.col("low")).over(earlier)))
        .select("stretch", "entry", "floor")
    )
    edges = folded.where(F.col("kind") != CALL).join(entries, "stretch")
    count = F.col("level") + F.col("entry")
    same = Window.partitionBy(*THREAD, "_count").orderBy("place")
    seen = F.when(F.col("kind") != ENTRY, F.struct("kind", "place"))
    before = F.last(seen, ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, -1))
    return (
        edges.withColumn("_count", count)
        .withColumn("_before", before)
        .withColumn(
            "frame",
            F.when(F.col("kind") == BEGIN, F.col("place")).when(
                F.col("_before.kind") == BEGIN, F.col("_before.place")
            ),
        )
        .withColumn("depth", _depth())
        .drop("_count", "_before")
    )


def _depth():
    count = F.col("entry")
    return F.col("level") + count - F.least(F.col("floor"), count + F.col("low"))


def _frames(edges: DataFrame, slices: int | None) -> DataFrame:
    """One row per begin left open by its chunk; ``end_ts`` is null if it never ends."""
    begun = F.when(
        F.col("kind") == BEGIN,
        F.struct(*THREAD, "name", F.col("seq").alias("call_id"), F.col("ts").alias("start_ts"), "depth", "up"),
    )
    ended = F.when(F.col("kind") == END, F.struct(F.col("ts").alias("end_ts"), F.col("seq").alias("end_seq")))
    frames = (
        edges.where(F.col("frame").isNotNull())
        .groupBy("frame")
        .agg(
            F.max(begun).alias("_b"),
            F.max(ended).alias("_e"),
            F.sum("inner_time").alias("inner_time"),
            F.sum("children").alias("children"),
        )
        .select("frame", "_b.*", "_e.*", "inner_time", "children")
        .withColumn("duration", F.col("end_ts") - F.col("start_ts"))
    )
    hosts = edges.select(F.col("host").alias("up"), F.col("frame").alias("over"))
    frames = written(frames.join(hosts, "up", "left").drop("up"), "frames")
    inside = (
        frames.where(F.col("over").isNotNull() & F.col("duration").isNotNull())
        .groupBy(F.col("over").alias("frame"))
        .agg(F.sum("duration").alias("_inner"), F.count(F.lit(1)).alias("_children"))
    )
    parents = frames.select(
        F.col("frame").alias("over"), F.when(F.col("end_ts").isNotNull(), F.col("call_id")).alias("parent_id")
    )
    whole = frames.join(inside, "frame", "left").join(parents, "over", "left")
    zero = F.lit(0).cast(frames.schema["duration"].dataType)
    scored = chain_scores(
        whole.withColumn("level", F.col("depth")).withColumn("duration", F.coalesce("duration", zero)),
        slices=slices,
    )
    return scored.withColumns(
        {
            "inner_time": F.col("inner_time") + F.coalesce("_inner", zero),
            "children": F.col("children") + F.coalesce("_children", F.lit(0)),
        }
    )


def call_tree(events: DataFrame, *, slices: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Completed calls with level, parent, self time, children and chain score.

    Input ``run, tid, ts, seq, ph, name``. ``parent_id`` is the innermost call
    around, null at the root or where that call never ends; a begin without an
    end yields no call but counts as a level; an end without a begin is passed
    over, as are events without a time or of another kind. ``score`` sums the
    durations from below the root down to the call. ``slices`` and ``chunk`` fix
    the cuts, for tests: results are the same for any.
    """
    folded = _folded(events, slices, chunk)
    edges = written(_settled(folded), "call-edges")
    frames = _frames(edges, slices)
    around = frames.select(
        "frame",
        F.when(F.col("end_ts").isNotNull(), F.col("call_id")).alias("_parent"),
        F.col("score").alias("_score"),
    )
    hosts = edges.select(F.col("host").alias("up"), "entry", "floor", "frame").join(around, "frame", "left")
    duration = F.col("end_ts") - F.col("start_ts")
    zero = F.lit(0).cast(folded.schema["ts"].dataType)

    def finished(df: DataFrame, level, parent, score) -> DataFrame:
        return df.select(
            *THREAD,
            "call_id",
            F.col("name").alias("function_name"),
            level.cast("long").alias("level"),
            "start_ts",
            "end_ts",
            "end_seq",
            duration.alias("duration"),
            parent.alias("parent_id"),
            F.greatest(zero, duration - F.col("inner_time")).alias("self_time"),
            F.col("children").alias("num_children"),
            score.alias("score"),
        )

    inside = folded.where(F.col("kind") == CALL).withColumnsRenamed({"seq": "call_id", "ts": "start_ts"}).join(hosts, "up")
    rooted = F.when(F.col("frame").isNull(), F.col("below")).otherwise(F.col("chain") + F.col("_score"))
    return finished(inside, _depth(), F.coalesce("parent_id", "_parent"), rooted).unionByName(
        finished(frames.where(F.col("end_ts").isNotNull()), F.col("level"), F.col("parent_id"), F.col("score"))
    )
