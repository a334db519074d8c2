"""Approximate nearest neighbours by adaptive dimension scan within inverted lists.

Vectors are scaled to unit length and rotated at random, so any first columns of
a vector estimate its distance. A coarse quantiser deals them to lists; a list is
stored as chunks of column blocks. A query visits its nearest lists. In a chunk
it reads the blocks one after another and drops a candidate as soon as a
hypothesis test on its partial distance says that the whole distance exceeds the
best found; survivors are scored exactly on their original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.storage import written
from .common import shuffle_width, small_batches

#: Vectors the quantiser is fitted on, at most; every vector is indexed.
SAMPLE = 16_384
#: Lists: about the square root of the rows, within these.
LEAST_LISTS, MOST_LISTS = 8, 4096
#: A query visits as many of its nearest lists as hold this share of the neighbours
#: that up to ASKED vectors of the sample have in it. A sample's neighbours lie
#: further away than those among all vectors, so the number errs to the safe side.
COVERED, ASKED = 0.97, 512
#: Rows nearest in the first block that are measured in full to set the bound.
FULLY = 64
#: Vectors of a chunk, queries of a block.
CHUNK = 1024
QUERIES = 128
#: Queries whose best a task holds before it hands them on.
HELD_QUERIES = 50_000
#: Tasks that share a list's chunks when they are packed.
SALTS = 8
#: Columns of a block.
COLUMNS = 16
#: Width of the test in standard errors: larger drops fewer candidates by mistake.
EPSILON = 2.1
#: Slack on rotated distances for rounding, so that equal vectors stay together.
SLACK = 1e-5


def usable(vector: Column) -> Column:
    """Vectors without null, infinite or undefined parts that aren't zero."""
    sound = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vector.isNotNull() & (F.size(vector) > 0) & sound & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest part first, so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine in double precision; the same for equal rows wherever they stand."""
    norms = np.sqrt((x * x).sum(axis=1)) * np.sqrt((query * query).sum())
    plain = (x * query).sum(axis=1) / norms
    if np.isfinite(plain).all() and (norms > 1e-150).all():
        return plain
    return (_units(x) * _units(query[None, :])).sum(axis=1)


@dataclass(frozen=True)
class Quantiser:
    rotation: np.ndarray
    centres: np.ndarray

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors of ``x``, rotated."""
        return (_units(x) @ self.rotation).astype(np.float32)

    def nearest(self, rotated: np.ndarray, count: int) -> np.ndarray:
        """Numbers of the ``count`` nearest centres."""
        dots = rotated @ self.centres.T
        if count >= dots.shape[1]:
            return np.tile(np.arange(dots.shape[1]), (len(rotated), 1))
        return np.argpartition(-dots, count - 1, axis=1)[:, :count]


def fit(x: np.ndarray, lists: int, *, rounds: int = 12, seed: int = 7) -> Quantiser:
    """A random rotation and centres by spherical k-means."""
    rng = np.random.default_rng(seed)
    rotation, r = np.linalg.qr(rng.standard_normal((x.shape[1],) * 2))
    rotation = rotation * np.sign(np.diag(r))
    made = Quantiser(rotation, np.zeros((0, x.shape[1]), dtype=np.float32))
    x = made.placed(x)
    centres = x[rng.permutation(len(x))[: min(lists, len(x))]]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros(centres.shape)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres).astype(np.float32)
    return Quantiser(rotation, centres)


def visits(quantiser: Quantiser, x: np.ndarray, keep: int, *, covered: float = COVERED, asked: int = ASKED) -> int:
    """Lists to visit for ``covered`` of the ``keep`` nearest of some vectors of ``x`` among the others."""
    lists = len(quantiser.centres)
    keep = min(keep, len(x) - 1)
    if not keep:
        return lists
    units = _units(x)
    near = units[:asked] @ units.T
    near[np.arange(len(near)), np.arange(len(near))] = -np.inf
    found = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
    placed = quantiser.placed(x)
    home = (placed @ quantiser.centres.T).argmax(axis=1)
    order = np.argsort(-(placed[:asked] @ quantiser.centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :], axis=1)
    needed = np.take_along_axis(place, home[found], axis=1) + 1
    return int(np.quantile(needed, covered, method="higher"))


def train(vectors: DataFrame, *, keep: int = 5, sample: int = SAMPLE) -> tuple[Quantiser, int, int] | None:
    """Quantiser, width and lists to visit for ``vectors``; none without usable rows.

    Those of the commonest width (the least of several) count. Fitted on at most
    ``sample`` of them, those with the least hash of their id.
    """
    widths = vectors.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("rows"))
    common = widths.orderBy(F.desc("rows"), "width").first()
    if common is None:
        return None
    of_width = vectors.where(F.size("embedding") == common["width"])
    order = [F.xxhash64("vec_id"), "vec_id", F.xxhash64("embedding")]
    taken = of_width.orderBy(*order).limit(sample).select("embedding").toArrow()
    x = _matrix(taken.column("embedding").combine_chunks())
    made = fit(x, int(min(MOST_LISTS, max(LEAST_LISTS, np.sqrt(common["rows"])))))
    return made, common["width"], visits(made, x, keep)


def scan(
    chunk: np.ndarray, query: np.ndarray, keep: int, best: float, epsilon: float = EPSILON
) -> np.ndarray:
    """Rows of a chunk (columns by rows) that survive all tests for one query.

    ``best`` is a distance known to hold ``keep`` candidates, or infinite. Each
    block adds its part of the squared distance; a row with ``d`` of ``D`` columns
    read is dropped when ``partial * D / d`` exceeds the best distance by more
    than ``epsilon / sqrt(d)`` of it. The bound falls to the ``keep``-th of the
    rows that the first block finds nearest, measured in full. Rows as near as
    the ``keep``-th of the survivors are returned.
    """
    width = len(query)
    alive = np.arange(chunk.shape[1])
    partial = np.zeros(len(alive), dtype=np.float32)
    for start in range(0, width, COLUMNS):
        block = chunk[start : start + COLUMNS] if len(alive) == chunk.shape[1] else chunk[start : start + COLUMNS, alive]
        partial = partial + np.square(block - query[start : start + COLUMNS, None]).sum(axis=0)
        read = min(start + COLUMNS, width)
        if start == 0 and len(alive) > keep:
            count = min(FULLY, len(partial))
            near = np.argpartition(partial, count - 1)[:count]
            whole = np.square(chunk[:, near] - query[:, None]).sum(axis=0)
            best = min(best, float(np.partition(whole, keep - 1)[keep - 1]))
        if read < width:
            factor = (1 + epsilon / np.sqrt(read)) ** 2
            left = partial * (width / read) <= best * factor + SLACK
        else:
            last = np.partition(partial, keep - 1)[keep - 1] if len(partial) > keep else np.inf
            left = partial <= min(best, last) + SLACK
        alive, partial = alive[left], partial[left]
    return alive


LISTED = "list int, ids binary, rotated binary, vectors binary"


def _chunks(vectors: DataFrame, quantiser: Quantiser, probed: int, size: int) -> DataFrame:
    """Vectors of each list in chunks; a vector is in ``probed`` lists."""
    shared = vectors.sparkSession.sparkContext.broadcast(quantiser)  # at most MOST_LISTS centres

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        held: dict[int, list] = {}
        counts: dict[int, int] = {}

        def packed(number: int) -> tuple:
            ids, rotated, vectors = (np.concatenate(x) for x in zip(*held.pop(number)))
            counts.pop(number)
            return number, ids.astype("<i8").tobytes(), rotated.T.astype("<f4").tobytes(), vectors.astype("<f8").tobytes()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(columns, ["list", "ids", "rotated", "vectors"])

        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            x = _matrix(batch.column("embedding"))
            rotated = model.placed(x)
            lists = model.nearest(rotated, probed)
            full = []
            for number in np.unique(lists):
                mine = (lists == number).any(axis=1)
                held.setdefault(int(number), []).append((ids[mine], rotated[mine], x[mine]))
                counts[int(number)] = counts.get(int(number), 0) + int(mine.sum())
                if counts[int(number)] >= size:
                    full.append(packed(int(number)))
            if sum(counts.values()) > 64 * size:  # bounded memory, whatever the number of lists
                full += [packed(n) for n in list(held)]
            if full:
                yield out(full)
        for number in list(held):
            yield out([packed(number)])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(deal, LISTED)


def _packed(chunks: DataFrame, width: int, size: int) -> DataFrame:
    """Chunks of ``size`` vectors again, from what many tasks have dealt to a list."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, np.ndarray, bytes]] = []
        current = count = 0

        def out() -> pa.RecordBatch:
            ids, rotated, vectors = zip(*held)
            joined = np.concatenate(rotated, axis=1).astype("<f4").tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int32()), pa.array([b"".join(ids)]), pa.array([joined]), pa.array([b"".join(vectors)])],
                ["list", "ids", "rotated", "vectors"],
            )

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("list", "ids", "rotated", "vectors")))
            for number, ids, rotated, vectors in rows:
                if held and (number != current or count >= size):
                    yield out()
                    held, count = [], 0
                current, count = number, count + len(ids) // 8
                held.append((ids, np.frombuffer(rotated, dtype="<f4").reshape(width, -1), vectors))
        if held:
            yield out()

    salted = chunks.withColumn("_salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)))
    dealt = salted.repartition(shuffle_width(chunks.sparkSession), "list", "_salt")
    return dealt.sortWithinPartitions("list").drop("_salt").mapInArrow(pack, LISTED)


FOUND = "query_id long, vec_id long, score double"


def search(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    keep: int = 5,
    probed: int | None = None,
    sample: int = SAMPLE,
    epsilon: float = EPSILON,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``keep`` nearest found for each query.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding``; other columns
    are ignored. Nearness is the cosine of the original vectors in double
    precision, ties go to the smaller id, and a query's own row is no candidate.
    Null vectors, zero vectors, those with null or non-finite parts, with a null
    id or of another width than the commonest take no part. An empty table gives
    an empty result; rows that repeat an id are candidates of their own, but none
    for queries of that id. ``probed`` lists are visited, by default as many as
    ``visits`` finds.

    Both sides are dealt to lists in chunks of bounded size. A list meets the
    queries that probe it chunk by chunk, so a list of any size spreads over
    tasks; every pair of chunks gives ``keep`` rows per query, and the last
    window sees at most that many from each chunk a query visited. If the lists
    that a query probed hold fewer than ``keep`` candidates, it is searched over
    all chunks.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    vectors = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    queries = queries.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    trained = train(vectors, keep=keep, sample=sample)
    if trained is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    quantiser, width, found_enough = trained
    fits = F.size("embedding") == width
    lists = len(quantiser.centres)
    most = min(lists, found_enough if probed is None else probed)
    chunks = written(_packed(_chunks(vectors.where(fits), quantiser, 1, CHUNK), width, CHUNK), "ann-chunks")
    asked = queries.where(fits)
    found = written(_found(chunks, _chunks(asked, quantiser, most, QUERIES), width, keep, epsilon, ["list"]), "ann-found")
    short = asked.join(
        found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= keep),
        F.col("vec_id") == F.col("query_id"),
        "left_anti",
    )
    short = written(short, "ann-short")
    if not short.isEmpty():
        everywhere = chunks.select("list").distinct()
        one = _chunks(short, Quantiser(quantiser.rotation, quantiser.centres[:1]), 1, QUERIES).drop("list")
        spread = one.withColumn("list", F.explode(F.array(*[F.lit(i) for i in range(lists)]))).join(everywhere, "list")
        again = _found(chunks, spread.select("list", "ids", "rotated", "vectors"), width, keep, float("inf"), ["list"])
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best).cast("int"))
        .where(F.col("rank") <= keep)
        .select("query_id", "rank", "vec_id", "score")
    )


def _found(
    chunks: DataFrame, asked: DataFrame, width: int, keep: int, epsilon: float, on: list[str]
) -> DataFrame:
    """The ``keep`` nearest to each query in each chunk of the lists it visits."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}  # of each query, over all chunks of the task

        def out() -> pa.RecordBatch:
            rows = [(q, i, -score) for q, found in best.items() for score, i in found]
            best.clear()
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(len(batch)):
                one = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                ids = np.frombuffer(one["ids"], dtype="<i8")
                rotated = np.frombuffer(one["rotated"], dtype="<f4").reshape(width, -1)
                vectors = np.frombuffer(one["vectors"], dtype="<f8").reshape(-1, width)
                query_ids = np.frombuffer(one["q_ids"], dtype="<i8")
                query_rotated = np.frombuffer(one["q_rotated"], dtype="<f4").reshape(width, -1).T
                query_vectors = np.frombuffer(one["q_vectors"], dtype="<f8").reshape(-1, width)
                for q, near, exact in zip(query_ids.tolist(), query_rotated, query_vectors):
                    held = best.get(q, [])
                    # the distance of unit vectors follows from the cosine
                    bound = 2 + 2 * held[-1][0] + SLACK if len(held) == keep else float("inf")
                    # one more, as the query's own row may be among them
                    at = scan(rotated, near, keep + 1, bound, epsilon)
                    at = at[ids[at] != q]
                    if len(at):
                        score = cosines(vectors[at], exact)
                        first = np.lexsort((ids[at], -score))[:keep]
                        found = [(-float(score[k]), int(ids[at[k]])) for k in first]
                        best[q] = sorted(held + found)[:keep]
            if len(best) > HELD_QUERIES:
                yield out()
        if best:
            yield out()

    asked = asked.select(
        "list", F.col("ids").alias("q_ids"), F.col("rotated").alias("q_rotated"), F.col("vectors").alias("q_vectors")
    )
    return chunks.join(asked, on).drop("list").mapInArrow(nearest, FOUND)
