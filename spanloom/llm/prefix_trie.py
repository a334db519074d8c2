"""Conversation prefix trie: double arrays per shard, shared upper nodes merged.

A conversation is a sequence of turns, each 16 bytes that tell role and text; equal
sequences are counted once, before anything is sorted. The sequences are dealt in
order into shards, so a shard holds a stretch of the trie, cut wherever the number
of turns asks for it, however many conversations share a prefix.

A shard numbers its turns densely and packs its sequences into a double array: the
child of a node at ``s`` by turn ``c`` is at ``BASE[s] + c``, and ``CHECK`` there says
``s``. Reading both arrays gives all nodes; sums over subtrees go from the deepest
nodes up. Other shards can hold a node, too, if it is on the path of the shard's first
or last sequence: all else lies between them. Nodes on these two paths leave the
shard with what hangs below them inside it, and are merged by a key of their prefix,
over all shards: counts add up, and sums over subtrees double the distance they
reach to in each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.storage import written, written_counted
from .common import WORD, small_batches

#: A conversation's group and the turns it may take over from the group's first.
GROUP, TAKEN = 20, 4
#: Turns of distinct sequences in a shard, about: some tens of MB of arrays.
SHARD_TURNS = 200_000
#: Merged nodes of at most so many rows are broadcast (16 bytes and a number each, counted).
BROADCAST_ROWS = 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
DIGEST = 16


class DoubleArray:
    """A trie of sequences of dense codes in the arrays ``base`` and ``check``.

    ``check`` is the parent's slot, -1 for a free slot; the root, at slot 0, has
    itself as parent. Sequences come in order, so a node's children are known
    together when its range of sequences is.
    """

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        """``codes`` of all sequences one after another, ``ends`` of each in ``codes``."""
        self.codes, self.ends = codes, ends
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.lengths = ends - self.starts
        size = 2 * len(codes) + (int(codes.max()) if len(codes) else 0) + 2
        self.base = np.zeros(size, dtype=np.int64)
        self.check = np.full(size, -1, dtype=np.int64)
        self.check[0] = 0
        self.free = 1  # no slot below it is free
        self.top = 0  # no slot above it is taken
        self.levels = [np.zeros(1, dtype=np.int64)]  # slots by depth
        self._pack()

    def _base(self, codes: np.ndarray) -> int:
        """A base with room for ``codes``: near the first free slot, else after all that is taken."""
        check = self.check
        while self.free < len(check) and check[self.free] >= 0:
            self.free += 1
        low, high = int(codes[0]), int(codes[-1])
        if self.free + len(codes) + high - low + 1 >= len(check):
            self._grow(high + len(codes))
            check = self.check
        if len(codes) == 1:
            return self.free - low
        base = self.free - low
        for _ in range(64):
            taken = check[base + codes] >= 0
            if not taken.any():
                return base
            base += 1
            if base + high >= len(check):
                self._grow(high)
                check = self.check
        if self.top + 1 - low + high >= len(check):
            self._grow(high + self.top)
        return self.top + 1 - low

    def _grow(self, by: int) -> None:
        more = max(len(self.check) // 2, by + 1)
        self.check = np.concatenate([self.check, np.full(more, -1, dtype=np.int64)])
        self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int64)])

    def _pack(self) -> None:
        """Pack level by level; a sequence knows the slot it has reached."""
        at = np.zeros(len(self.ends), dtype=np.int64)
        depth = 0
        while True:
            going = np.flatnonzero(self.lengths > depth)
            if not len(going):
                break
            code = self.codes[self.starts[going] + depth]
            parent = at[going]
            fresh = np.ones(len(going), dtype=bool)  # sequences are in order
            fresh[1:] = (parent[1:] != parent[:-1]) | (code[1:] != code[:-1])
            heads = np.flatnonzero(fresh)
            parents, children = parent[heads], code[heads]
            first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
            slots = np.zeros(len(heads), dtype=np.int64)
            for low, high in zip(first, np.append(first[1:], len(heads))):
                own = children[low:high]
                base = self._base(own)
                self.base[parents[low]] = base
                slots[low:high] = base + own
                self.check[base + own] = parents[low]
                self.top = max(self.top, base + int(own[-1]))
            at[going] = slots[np.cumsum(fresh) - 1]
            self.levels.append(slots)
            depth += 1

    def walked(self) -> np.ndarray:
        """The slot where each sequence ends, following its codes from the root."""
        at = np.zeros(len(self.ends), dtype=np.int64)
        for depth in range(int(self.lengths.max()) if len(self.lengths) else 0):
            going = np.flatnonzero(self.lengths > depth)
            code = self.codes[self.starts[going] + depth]
            to = self.base[at[going]] + code
            if (self.check[to] != at[going]).any():
                raise ValueError("a sequence leaves the trie")
            at[going] = to
        return at

    def path(self, slot: int) -> list[int]:
        """Slots from the root to ``slot``."""
        out = [slot]
        while out[-1]:
            out.append(int(self.check[out[-1]]))
        return out[::-1]


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, path, words, ends``: each rebuilt conversation as bytes and its turns' word counts.

    Rows are taken by turn, nulls first, ties by role and text; null roles and
    texts are empty; rows without a ``conv_id`` take no part. A conversation takes
    over the first turns of the first conversation of its group of ``GROUP`` ids,
    as many as the checksum of its id says, and goes on with its own after as many.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    placed = rows.withColumn("place", place).select(
        "conv_id", "place", F.md5(said.cast("binary")).alias("digest"), F.regexp_count("text", F.lit(WORD)).alias("words")
    )
    placed = written(placed, "trie-turns")  # 16 bytes and three numbers a row
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN).cast("int")
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP))
    own = placed.select("conv_id", F.struct("place", "digest", "words").alias("t")).where(F.col("t.place") > taken)
    heads = placed.where((F.col("place") < TAKEN) & (first == F.col("conv_id"))).select(
        F.col("conv_id").alias("first"), F.struct("place", "digest", "words").alias("t")
    )
    convs = placed.where("place = 1").select("conv_id", first.alias("first"), taken.alias("taken"))
    over = convs.join(heads, "first").where(F.col("t.place") <= F.col("taken")).select("conv_id", "t")
    # a conversation is one row; its turns are 36 bytes each
    whole = over.unionByName(own).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    none = F.array().cast("array<struct<place:int,digest:string,words:int>>")
    t = F.coalesce("t", none)
    return convs.join(whole, "conv_id", "left").select(
        "conv_id",
        F.unhex(F.array_join(F.transform(t, lambda x: x["digest"]), "")).alias("path"),
        F.transform(t, lambda x: x["words"]).alias("words"),
    )


def _ended(convs: DataFrame) -> DataFrame:
    """``key, ends_sha256``: hash of the ids that end at each sequence, in order, joined by commas."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def batch_of(done):
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())],
                ["key", "ends_sha256"],
            )

        for batch in batches:
            done = []
            for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
            if done:
                yield batch_of(done)
        if key is not None:
            yield batch_of([(key, digest.hexdigest())])

    rows = convs.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return rows.mapInArrow(join, "key binary, ends_sha256 string")


NODE = (
    "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, words long, edge boolean"
)


def _shard(paths: list[bytes], words: list[list[int]], counts: np.ndarray, lows: np.ndarray, ends: list[str]) -> pa.RecordBatch:
    """All nodes of a shard's sorted distinct sequences.

    For nodes on the first and last path (``edge``), ``n_children``, ``n_leaves`` and
    ``saved_tokens`` are those of inner children only; their own parts follow when
    they are merged.
    """
    lengths = np.array([len(p) // DIGEST for p in paths], dtype=np.int64)
    halves = np.frombuffer(b"".join(paths), dtype=">u8").reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    step = np.ones(len(order), dtype=bool)
    step[1:] = (halves[order][1:] != halves[order][:-1]).any(axis=1)
    codes = np.zeros(len(order), dtype=np.int64)
    codes[order] = np.cumsum(step) - 1
    said_words = np.fromiter((w for ws in words for w in ws), dtype=np.int64, count=int(lengths.sum()))
    words_of = np.zeros(int(step.sum()), dtype=np.int64)
    words_of[codes] = said_words

    trie = DoubleArray(codes, np.cumsum(lengths))
    reached = trie.walked()
    size = len(trie.check)
    slots = np.concatenate(trie.levels)
    parents = trie.check[slots]
    convs, low = np.zeros(size, dtype=np.int64), np.full(size, np.iinfo(np.int64).max)
    np.add.at(convs, reached, counts)
    np.minimum.at(low, reached, lows)
    depth, own_words = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for d, level in enumerate(trie.levels):
        depth[level] = d
    own_words[slots[1:]] = words_of[slots[1:] - trie.base[parents[1:]]]
    edge = np.zeros(size, dtype=bool)
    for last in (reached[0], reached[-1]):
        edge[trie.path(int(last))] = True
    children, leaves, saved = (np.zeros(size, dtype=np.int64) for _ in range(3))
    for level in reversed(trie.levels[1:]):
        up = trie.check[level]
        inner = ~edge[level]
        mine = level[inner]
        leaves[mine] += children[mine] == 0
        saved[mine] += (convs[mine] - 1) * own_words[mine]
        np.add.at(convs, up, convs[level])
        np.minimum.at(low, up, low[level])
        np.add.at(children, up[inner], 1)
        np.add.at(leaves, up[inner], leaves[mine])
        np.add.at(saved, up[inner], saved[mine])

    key: dict[int, bytes] = {}
    for at, path in ((reached[0], paths[0]), (reached[-1], paths[-1])):
        for d, slot in enumerate(trie.path(int(at))):
            key[slot] = hashlib.md5(path[: d * DIGEST]).digest()
    ended = dict(zip(reached.tolist(), ends))
    on_edge = edge[parents]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([key.get(s) for s in slots.tolist()], pa.binary()),
            pa.array([key[p] if e and s else None for s, p, e in zip(slots.tolist(), parents.tolist(), on_edge)], pa.binary()),
            pa.array(low[slots]),
            pa.array(depth[slots]),
            pa.array(low[parents], mask=on_edge),
            pa.array(convs[slots]),
            pa.array(children[slots]),
            pa.array(leaves[slots]),
            pa.array(saved[slots]),
            pa.array([ended.get(s) for s in slots.tolist()], pa.string()),
            pa.array(own_words[slots]),
            pa.array(edge[slots]),
        ],
        [c.split()[0] for c in NODE.split(", ")],
    )


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if len(b)]
    if not held:
        return
    shard = pa.Table.from_batches(held)
    columns = [shard.column(c) for c in ("path", "words", "n", "low", "ends_sha256")]
    yield _shard(
        columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_numpy(), columns[3].to_numpy(), columns[4].to_pylist()
    )


def _below(edges: DataFrame, deepest: int) -> DataFrame:
    """``key, n_leaves, saved_tokens`` summed over each merged node and all below it.

    Each round a node adds the sums of the nodes that many levels below it and
    looks twice as far.
    """
    sums = edges.select("key", F.col("parent_key").alias("up"), F.col("own_leaves").alias("l"), F.col("own_saved").alias("s"))
    reach = 1
    while reach <= deepest:
        more = sums.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("l").alias("ml"), F.sum("s").alias("ms"))
        above = sums.select(F.col("key").alias("up"), F.col("up").alias("higher"))
        sums = (
            sums.join(more, "key", "left")
            .join(above, "up", "left")
            .select(
                "key",
                F.col("higher").alias("up"),
                (F.col("l") + F.coalesce("ml", F.lit(0))).alias("l"),
                (F.col("s") + F.coalesce("ms", F.lit(0))).alias("s"),
            )
        )
        sums = written(sums, "trie-sums")
        reach *= 2
    return sums.select("key", F.col("l").alias("n_leaves"), F.col("s").alias("saved_tokens"))


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_nodes(convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of ``convs`` (``conv_id, path, words``), the empty one included.

    ``conv_id`` is the smallest member (it begins with the prefix), ``parent_conv_id``
    that of the prefix one turn shorter, ``n_leaves`` and ``saved_tokens`` cover the
    prefix and all that go on from it, ``ends_sha256`` hashes the ids of the
    conversations that are the prefix. No conversations, no rows.
    """
    spark = convs.sparkSession
    small_batches(spark)
    keyed = written(convs.withColumn("key", F.unhex(F.md5("path"))), "trie-conversations")
    distinct = keyed.groupBy("key").agg(
        F.first("path").alias("path"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low")
    )
    distinct = written(distinct.join(_ended(keyed), "key"), "trie-sequences")
    turns = distinct.agg(F.sum(F.size("words").cast("long") + 1)).first()[0]
    if turns is None:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in RESULT))
    shards = -(-turns // SHARD_TURNS)
    dealt = distinct.repartitionByRange(shards, "path").sortWithinPartitions("path")
    nodes = written(dealt.select("path", "words", "n", "low", "ends_sha256").mapInArrow(_sharded, NODE), "trie-nodes")

    edges = nodes.where("edge").groupBy("key").agg(
        F.first("parent_key").alias("parent_key"),
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner_children"),
        F.sum("n_leaves").alias("inner_leaves"),
        F.sum("saved_tokens").alias("inner_saved"),
        F.max("ends_sha256").alias("ends_sha256"),
        F.first("words").alias("words"),
    )  # at most two paths a shard
    outer = edges.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("outer"))
    edges = edges.join(outer, "key", "left").withColumn("n_children", F.col("inner_children") + F.coalesce("outer", F.lit(0)))
    edges = edges.withColumn("own_leaves", F.col("inner_leaves") + (F.col("n_children") == 0).cast("long"))
    edges = edges.withColumn("own_saved", F.col("inner_saved") + (F.col("n_convs") - 1) * F.col("words"))
    edges, count = written_counted(edges, "trie-edges")
    sums = _below(edges, edges.agg(F.max("depth")).first()[0])
    upper = edges.select("key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "ends_sha256").join(sums, "key")

    lower = nodes.where("not edge").drop("key", "words", "edge")
    names = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_named"))
    every = lower.unionByName(upper.drop("key").withColumn("parent_conv_id", F.lit(None).cast("long")))
    # beyond the bound, adaptive execution splits the rows below a common node
    every = every.join(F.broadcast(names) if count <= BROADCAST_ROWS else names, "parent_key", "left")
    return every.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_named")).withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))
    ).select(*RESULT)
