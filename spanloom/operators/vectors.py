"""Vector columns: scaling, distances, k-means and cluster quality.

Vectors are ``array<double>`` columns of one length ``dim``. What describes a
cluster (centre, size, spread) is one row per cluster, at most a few dozen;
those rows reach the data as one scalar subquery, so no data row is ever
joined, crossed or paired with another.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .ordered import running_sums
from .storage import written

# Clusters a distance table has columns for.
MOST_CLUSTERS = 64


def mean_vector(column: str, dim: int) -> Column:
    return F.array(*[F.avg(F.get(column, F.lit(i))) for i in range(dim)])


def std_vector(column: str, dim: int) -> Column:
    """Population standard deviation per position."""
    return F.array(*[F.stddev_pop(F.get(column, F.lit(i))) for i in range(dim)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x
    )


def scaling(df: DataFrame, dim: int, column: str = "features") -> DataFrame:
    """One row: mean and population standard deviation per position."""
    return df.agg(mean_vector(column, dim).alias("mean"), std_vector(column, dim).alias("std"))


def _scale(scales: DataFrame) -> Column:
    return scales.select(F.struct("mean", "std")).scalar()


def standardize(
    df: DataFrame, dim: int, column: str = "features", out: str = "z", scales: DataFrame | None = None
) -> DataFrame:
    """z-scores by population deviation; a constant position becomes 0."""
    scaled = df.withColumn("_scale", _scale(scaling(df, dim, column) if scales is None else scales))

    def score(i: int) -> Column:
        x, mean, std = (F.get(c, F.lit(i)) for c in (column, "_scale.mean", "_scale.std"))
        return F.when(std > 0, (x - mean) / std).otherwise(F.lit(0.0))

    z = F.when(F.col(column).isNotNull(), F.array(*[score(i) for i in range(dim)]))
    return scaled.withColumn(out, z).drop("_scale")


def inverse_standardize(df: DataFrame, scales: DataFrame, column: str = "z", out: str = "features") -> DataFrame:
    widened = F.zip_with(
        column, F.col("_scale.std"), lambda z, s: z * F.when(s > 0, s).otherwise(F.lit(1.0))
    )
    restored = F.zip_with(widened, F.col("_scale.mean"), lambda x, m: x + m)
    return df.withColumn("_scale", _scale(scales)).withColumn(out, restored).drop("_scale")


def _folded(rows: DataFrame, *columns: str) -> Column:
    """All rows of a per-cluster table as one sorted array."""
    return rows.agg(F.array_sort(F.collect_list(F.struct(*columns)))).scalar()


def assign_nearest(
    df: DataFrame, centers: DataFrame, column: str = "z", out: str = "archetype"
) -> DataFrame:
    """Nearest of the ``centers(id, center)``; equal distances go to the lower id."""
    folded = df.withColumn("_centers", _folded(centers, "id", "center"))
    nearest = F.array_min(
        F.transform(
            "_centers",
            lambda c: F.struct(
                squared_distance(F.col(column), c["center"]).alias("d"), c["id"].alias("id")
            ),
        )
    )
    return folded.withColumn("_nearest", nearest).select(
        *df.columns,
        F.col("_nearest.id").alias(out),
        F.sqrt(F.col("_nearest.d")).alias("distance_to_center"),
    )


def cluster_means(df: DataFrame, dim: int, column: str = "z", label: str = "archetype") -> DataFrame:
    """Per cluster: size, mean vector and mean squared norm."""
    return df.groupBy(F.col(label).alias("id")).agg(
        F.count(F.lit(1)).alias("n"),
        mean_vector(column, dim).alias("center"),
        F.avg(dot(F.col(column), F.col(column))).alias("mean_norm"),
    )


def _own(folded: str, label: str) -> Column:
    """The entry of a folded per-cluster table that belongs to the row."""
    return F.get(F.filter(folded, lambda c: c["id"] == F.col(label)), F.lit(0))


def silhouette(df: DataFrame, dim: int, column: str = "z", label: str = "archetype") -> DataFrame:
    """Mean silhouette under squared Euclidean distance, in one linear pass.

    The mean squared distance of a point to a cluster follows from the cluster's
    mean vector and mean squared norm, so no pairs of points are formed.
    """
    folded = _folded(cluster_means(df, dim, column, label), "id", "n", "center", "mean_norm")
    point = F.col(column)
    distances = F.transform(
        "_clusters",
        lambda c: F.struct(
            c["id"].alias("id"),
            c["n"].alias("n"),
            F.greatest(
                F.lit(0.0), F.col("_norm") - 2 * dot(point, c["center"]) + c["mean_norm"]
            ).alias("d"),
        ),
    )
    others = F.array_min(
        F.transform(F.filter("_ds", lambda c: c["id"] != F.col(label)), lambda c: c["d"])
    )
    inner = F.col("_own.d") * F.col("_own.n") / (F.col("_own.n") - 1)
    widest = F.greatest("_a", "_b")
    score = (
        df.withColumns({"_norm": dot(point, point), "_clusters": folded})
        .withColumn("_ds", distances)
        .withColumns({"_own": _own("_ds", label), "_b": others})
        .withColumn("_a", F.when(F.col("_own.n") > 1, inner))
        .withColumn(
            "_s",
            F.when(F.col("_a").isNull() | (widest == 0), F.lit(0.0)).otherwise(
                (F.col("_b") - F.col("_a")) / widest
            ),
        )
    )
    return score.agg(F.avg("_s").alias("silhouette_sq"), F.count(F.lit(1)).alias("n"))


def directions(dim: int, count: int, seed: int = 42) -> list[list[float]]:
    """Random unit vectors, in orthogonal frames of ``dim`` at a time."""
    rng = np.random.default_rng(seed)
    frames = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-count // dim))]
    return [[round(float(v), 6) for v in row] for row in np.concatenate(frames)[:count]]


def mean_projection(dim: int) -> float:
    """Mean length of a unit vector's projection on a random direction."""
    return math.exp(math.lgamma(dim / 2) - math.lgamma((dim + 1) / 2)) / math.sqrt(math.pi)


def cluster_distances(
    df: DataFrame,
    dim: int,
    key: list[str],
    column: str = "z",
    label: str = "archetype",
    *,
    count: int = 64,
    seed: int = 42,
    slices: int | None = None,
) -> DataFrame:
    """Per row ``distances(id, n, total)``: summed Euclidean distance to each cluster.

    A distance is its mean projection on random directions, over what a unit
    vector projects to on average. Along one direction the differences to all
    rows of a cluster follow from how many lie below and their sum, so one
    ordered scan of all projections serves all rows and clusters: ``n log n``
    work for every row, no pairs and no sample. ``key`` must be unique. Rows
    without label or vector are left out; more than 64 clusters are an error.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(column).isNotNull())
    sizes = rows.groupBy(F.col(label).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    clusters = [(r["id"], r["n"]) for r in sizes.orderBy("id").limit(MOST_CLUSTERS + 1).collect()]
    if len(clusters) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    if not clusters:
        kind = f"array<struct<id:{dict(rows.dtypes)[label]},n:bigint,total:double>>"
        return rows.select(*key, label, F.array().cast(kind).alias("distances"))
    axes = F.from_json(F.lit(json.dumps(directions(dim, count, seed))), "array<array<double>>")
    projected = rows.select(
        *key,
        F.col(label).alias("_label"),
        F.posexplode(F.transform(axes, lambda axis: dot(axis, F.col(column)))).alias("_axis", "_p"),
    )
    inside = [F.col("_label") == F.lit(c) for c, _ in clusters]
    values = {}
    for j, mine in enumerate(inside):
        values[f"_n{j}"] = F.when(mine, F.lit(1)).otherwise(F.lit(0)).cast("long")
        values[f"_s{j}"] = F.when(mine, F.col("_p")).otherwise(F.lit(0.0))
    upto = running_sums(projected, ["_axis"], ["_p", *key], values, slices=slices)
    sums = projected.groupBy("_axis").agg(
        *[F.sum(values[f"_s{j}"]).alias(f"_all{j}") for j in range(len(clusters))]
    )
    # one row per direction
    joined = upto.join(F.broadcast(sums), "_axis")
    apart = [
        F.col("_p") * (2 * F.col(f"_n{j}") - F.lit(n)) - 2 * F.col(f"_s{j}") + F.col(f"_all{j}")
        for j, (_, n) in enumerate(clusters)
    ]
    scale = F.lit(1 / (count * mean_projection(dim)))
    totals = joined.groupBy(*key, F.col("_label").alias(label)).agg(
        *[(F.sum(a) * scale).alias(f"_t{j}") for j, a in enumerate(apart)]
    )
    entries = [
        F.struct(F.lit(c).alias("id"), F.lit(n).alias("n"), F.col(f"_t{j}").alias("total"))
        for j, (c, n) in enumerate(clusters)
    ]
    return totals.select(*key, label, F.array(*entries).alias("distances"))


def silhouette_euclidean(distances: DataFrame, label: str = "archetype") -> DataFrame:
    """Mean silhouette under Euclidean distance from ``cluster_distances``.

    A row alone in its cluster scores 0, as do all rows of a single cluster.
    """
    own = F.get(F.filter("distances", lambda c: c["id"] == F.col(label)), F.lit(0))
    others = F.transform(
        F.filter("distances", lambda c: c["id"] != F.col(label)), lambda c: c["total"] / c["n"]
    )
    scored = distances.withColumns({"_own": own, "_b": F.array_min(others)}).withColumn(
        "_a", F.when(F.col("_own.n") > 1, F.col("_own.total") / (F.col("_own.n") - 1))
    )
    widest = F.greatest("_a", "_b")
    score = F.when(
        F.col("_a").isNotNull() & F.col("_b").isNotNull() & (widest > 0),
        (F.col("_b") - F.col("_a")) / widest,
    ).otherwise(F.lit(0.0))
    return scored.agg(F.avg(score).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def cluster_spread(df: DataFrame, dim: int, column: str = "z", label: str = "archetype") -> DataFrame:
    """Per cluster: size, mean vector, mean distance and summed square to it."""
    means = cluster_means(df, dim, column, label).select("id", "n", "center")
    square = squared_distance(F.col(column), F.col("_center"))
    spread = (
        df.withColumn("_clusters", _folded(means, "id", "center"))
        .withColumn("_center", _own("_clusters", label).getField("center"))
        .withColumn("_sq", square)
        .groupBy(F.col(label).alias("id"))
        .agg(F.avg(F.sqrt("_sq")).alias("scatter"), F.sum("_sq").alias("within"))
    )
    return means.join(spread, "id")


def calinski_harabasz(df: DataFrame, dim: int, column: str = "z", label: str = "archetype") -> DataFrame:
    """Between-cluster over within-cluster dispersion, each per degree of freedom."""
    overall = df.agg(mean_vector(column, dim)).scalar()
    spread = cluster_spread(df, dim, column, label).withColumn("_overall", overall)
    between = F.col("n") * squared_distance(F.col("center"), F.col("_overall"))
    sums = spread.agg(
        F.sum(between).alias("_b"),
        F.sum("within").alias("_w"),
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
    )
    k, n = F.col("k"), F.col("n")
    ratio = (F.col("_b") / (k - 1)) / (F.col("_w") / (n - k))
    return sums.select(
        F.when((F.col("_w") > 0) & (k > 1), ratio).otherwise(F.lit(1.0)).alias("calinski_harabasz"),
        "k",
        "n",
    )


def davies_bouldin(df: DataFrame, dim: int, column: str = "z", label: str = "archetype") -> DataFrame:
    """Mean over clusters of the worst (scatter + scatter) / centre distance."""
    spread = cluster_spread(df, dim, column, label)
    folded = spread.withColumn("_all", _folded(spread, "id", "center", "scatter"))
    worst = F.array_max(
        F.transform(
            F.filter("_all", lambda c: c["id"] != F.col("id")),
            lambda c: (F.col("scatter") + c["scatter"])
            / F.sqrt(squared_distance(F.col("center"), c["center"])),
        )
    )
    return folded.agg(F.avg(worst).alias("davies_bouldin"), F.count(F.lit(1)).alias("k"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lifted(x: np.ndarray) -> np.ndarray:
    """Rows with a one and their squared norm behind: distances and sums are then one product each."""
    return np.column_stack([x, np.ones(len(x)), np.einsum("ij,ij->i", x, x)])


def _far(lifted: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centre sets of one size: by set, centre and row; not clipped at zero."""
    stack = sets.reshape(-1, sets.shape[-1])
    raised = np.column_stack([-2 * stack, (stack * stack).sum(axis=1), np.ones(len(stack))])
    return (raised @ lifted.T).reshape(*sets.shape[:2], len(lifted))


def _blocks(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Vectors in blocks small enough that their distances stay in a core's cache."""
    for batch in batches:
        for first in range(0, len(batch), rows):
            part = batch.slice(first, rows)
            yield _matrix(part.column(0)), part


#: Rows of a packed block.
PACKED = 512


def _packed(df: DataFrame, column: str) -> DataFrame:
    """``column`` as binaries of up to ``PACKED`` vectors: a pass over them converts no values."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in _blocks(batches, PACKED):
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes()], pa.binary())], [column])

    packed = df.select(column).mapInArrow(pack, f"`{column}` binary")
    # an equal share for every core: a pass takes as long as its longest task
    return written(packed.repartition(2 * df.sparkSession.sparkContext.defaultParallelism), "packed-vectors")


def _pieces(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """Blocks of vectors, from arrays or from ``_packed`` ones."""
    for batch in batches:
        if pa.types.is_binary(batch.schema.field(0).type):
            for block in batch.column(0):
                yield np.frombuffer(block.as_buffer(), dtype=np.float64).reshape(-1, dim)
        else:
            for x, _ in _blocks([batch]):
                yield x


def _uniform(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Numbers between 0 and 1 that follow from 64-bit hashes and a salt."""
    x = hashes.view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54


def _starting_centers(df: DataFrame, column: str, k: int, *, seed: int, starts: int) -> list[np.ndarray]:
    """For each start k rows, each drawn from all rows by its squared distance to those drawn before.

    One pass over the distinct vectors for each draw, all starts together. A
    vector's waiting time is exponential, its rate the number of its rows times
    the squared distance; the first to come is drawn. The times follow from
    hashes of vector, seed, start and draw, so the draw does not depend on how
    rows are dealt out. The first j of k rows are a draw of j.
    """
    vectors = df.groupBy(column).agg(F.count(F.lit(1)).alias("_many"))
    vectors = written(vectors.withColumn("_hash", F.xxhash64(column, F.lit(seed))), "distinct-vectors")
    chosen: list[list[list[float]]] = [[] for _ in range(starts)]
    for draw in range(k):
        before = np.array(chosen)

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least: dict[int, tuple[float, list[float]]] = {}
            for x, block in _blocks(batches):
                many, hashes = block.column(1).to_numpy(), block.column(2).to_numpy()
                apart = _far(_lifted(x), before).min(axis=1) if draw else np.ones((starts, len(x)))
                for i, rate in enumerate(many * apart):
                    wait = np.full(len(x), np.inf)
                    np.divide(-np.log(_uniform(hashes, draw * starts + i + 1)), rate, out=wait, where=rate > 0)
                    j = wait.argmin()
                    if wait[j] < least.get(i, (np.inf,))[0]:
                        least[i] = (wait[j], x[j].tolist())
            kinds = pa.int32(), pa.float64(), pa.list_(pa.float64())
            columns = zip(*[(i, *found) for i, found in least.items()]) if least else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(columns, kinds)], ["start", "wait", "center"]
            )

        times = vectors.mapInArrow(first, "start int, wait double, center array<double>")
        found = times.groupBy("start").agg(F.min(F.struct("wait", "center")).alias("first")).collect()
        drawn = {r["start"]: r["first"]["center"] for r in found}
        for i, own in enumerate(chosen):
            own.append(drawn.get(i, own[-1] if own else None))  # no vector is left: one of them again
    return [np.array(c) for c in chosen]


def _totals(df: DataFrame, column: str, centers: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """Per centre set the sums of its clusters (vector, size, squared norm) and its cost, in one pass over the rows.

    Tasks add up their rows per set and cluster, a second stage adds up the tasks;
    one row per set and cluster comes back. Sets of one size are compared with a block of
    rows at once, by products of matrices. ``column`` may be packed.
    """
    alike: dict[int, list[int]] = {}
    for i, own in enumerate(centers):
        alike.setdefault(len(own), []).append(i)
    stacks = [(k, found, np.array([centers[i] for i in found])) for k, found in alike.items()]
    dim = centers[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.zeros((*own.shape[:2], dim + 3)) for _, _, own in stacks]
        for x in _pieces(batches, dim):
            lifted = _lifted(x)
            for part, (k, found, own) in zip(parts, stacks):
                far = _far(lifted, own)
                least = far.min(axis=1)
                one = np.equal(far, least[:, None], out=np.empty_like(far), casting="unsafe")
                added = (one.reshape(-1, len(x)) @ lifted).reshape(len(found), k, -1)
                # of centres equally near the first counts
                for i in np.flatnonzero(added[:, :, dim].sum(axis=1) != len(x)):
                    one[i] = np.arange(k)[:, None] == far[i].argmin(axis=0)
                    added[i] = one[i] @ lifted
                part[:, :, :-1] += added
                part[:, 0, -1] += np.maximum(least, 0, out=least).sum(axis=1)  # the cost of a set stands with its first cluster
        rows = [
            (i, j, part[at, j].tobytes())
            for part, (k, found, _) in zip(parts, stacks)
            for at, i in enumerate(found)
            for j in range(k)
        ]
        yield packed(rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                out[i, j] = out.get((i, j), 0.0) + np.frombuffer(part.as_buffer())
        yield packed([(*at, total.tobytes()) for at, total in out.items()])

    def packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else ([], [], [])
        kinds = pa.int32(), pa.int32(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], ["set", "cluster", "sums"])

    # a column for each sum would take the driver longer to plan than the sums take
    schema = "set int, cluster int, sums binary"
    added = df.select(column).mapInArrow(sums, schema).repartition("set").mapInArrow(add, schema)
    totals = [np.zeros((len(c), dim + 3)) for c in centers]
    for row in added.collect():
        totals[row["set"]][row["cluster"]] = np.frombuffer(row["sums"])
    return [(total[:, :-1], float(total[0, -1])) for total in totals]


def _step(df: DataFrame, column: str, centers: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """New centres, sizes and cost of every centre set."""
    moved = []
    for own, (sums, cost) in zip(centers, _totals(df, column, centers)):
        sizes = sums[:, -2]
        # an empty cluster stays where it is
        new = np.divide(sums[:, :-2], sizes[:, None], out=own.copy(), where=sizes[:, None] > 0)
        moved.append((new, sizes, cost))
    return moved


def _silhouettes(df: DataFrame, column: str, centers: list[np.ndarray]) -> list[float | None]:
    """``silhouette`` of the rows labelled by each centre set (``assign_nearest``), in two passes for all sets.

    Means and squared norms of the clusters first, then the rows' scores.
    """
    dim = centers[0].shape[1]
    known = []
    for own, (sums, _) in zip(centers, _totals(df, column, centers)):
        sizes, some = sums[:, -2], sums[:, -2] > 0
        mean = np.divide(sums, sizes[:, None], out=np.zeros_like(sums), where=some[:, None])
        raised = np.column_stack([-2 * mean[:, :dim], mean[:, -1], np.ones(len(own))])
        inner = np.divide(sizes, sizes - 1, out=np.zeros(len(own)), where=sizes > 1)
        known.append((own, sizes, some, raised, inner))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added, scored = np.zeros(len(known)), np.zeros(len(known), np.int64)
        for x in _pieces(batches, dim):
            lifted, at = _lifted(x), np.arange(len(x))
            for i, (own, sizes, some, raised, inner) in enumerate(known):
                label = _far(lifted, own[None])[0].argmin(axis=0)
                apart = np.maximum(raised @ lifted.T, 0)
                a = apart[label, at] * inner[label]
                apart[~some] = np.inf
                apart[label, at] = np.inf
                b = apart.min(axis=0)
                widest = np.where(np.isinf(b), a, np.maximum(a, b))
                alone = (sizes[label] <= 1) | (widest == 0)  # scores 0
                told = ~alone & ~np.isinf(b)
                added[i] += ((b[told] - a[told]) / widest[told]).sum()
                scored[i] += told.sum() + alone.sum()
        rows = [pa.array(range(len(known)), pa.int32()), pa.array(added), pa.array(scored)]
        yield pa.RecordBatch.from_arrays(rows, ["set", "added", "scored"])

    told = df.select(column).mapInArrow(scores, "set int, added double, scored long")
    sums = {r["set"]: r for r in told.groupBy("set").agg(F.sum("added").alias("added"), F.sum("scored").alias("scored")).collect()}
    return [sums[i]["added"] / sums[i]["scored"] if sums[i]["scored"] else None for i in range(len(centers))]


def _fitted(
    df: DataFrame, packed: DataFrame, column: str, sizes: list[int], *, seed: int, starts: int, max_iter: int
) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each k the centres and cluster sizes of the cheapest of ``starts`` fits.

    All fits advance together, one pass over the rows for each iteration; those
    that have settled take no part in later passes, which read ``packed``. Starting
    centres are drawn from all rows, for every start anew.
    """
    drawn = _starting_centers(df, column, max(sizes), seed=seed, starts=starts)
    sets = [(k, centers[:k]) for k in sizes for centers in drawn]
    done: list[tuple[int, np.ndarray, np.ndarray, float]] = []
    for iteration in range(max_iter + 1):
        moved = _step(packed, column, [c for _, c in sets])
        ahead = []
        for (k, old), (new, counts, cost) in zip(sets, moved):
            if iteration == max_iter or np.sqrt(((new - old) ** 2).sum(axis=1)).max() <= 1e-4:
                done.append((k, old, counts, cost))
            else:
                ahead.append((k, new))
        sets = ahead
        if not sets:
            break
    best = {k: min((d for d in done if d[0] == k), key=lambda d: d[3]) for k in sizes}
    return {k: (found[1], found[2]) for k, found in best.items()}


def _by_size(centers: np.ndarray, sizes: np.ndarray) -> list[tuple[float, list[float]]]:
    """Sizes and centres, largest first, then by centre."""
    return sorted(zip(sizes.tolist(), centers.tolist()), key=lambda t: (-t[0], t[1]))


def _numbered(df: DataFrame, centers: np.ndarray, sizes: np.ndarray) -> DataFrame:
    """Centres numbered ``_by_size``."""
    rows = [(index, center, int(size)) for index, (size, center) in enumerate(_by_size(centers, sizes))]
    return df.sparkSession.createDataFrame(rows, "id int, center array<double>, size long")


def fit_centers(
    df: DataFrame, k: int, *, column: str = "z", seed: int = 42, starts: int = 20, max_iter: int = 300
) -> DataFrame:
    """k-means centres ``(id, center, size)`` of the cheapest of several starts.

    Ids do not depend on the start. Only centres and their sums reach the driver.
    """
    best = _fitted(df, _packed(df, column), column, [k], seed=seed, starts=starts, max_iter=max_iter)
    return _numbered(df, *best[k])


def choose_k(
    df: DataFrame, dim: int, *, column: str = "z", seed: int = 42, starts: int = 10, largest: int = 15
) -> DataFrame:
    """Silhouette for each k in [2, min(largest, n // 5)); the first best is chosen.

    All candidates are fitted together, and scored together. With too few rows for
    any candidate, k = 2 is chosen without a score.
    """
    spark = df.sparkSession
    rows = df.count()
    candidates = list(range(2, min(largest, rows // 5))) if rows >= 10 else []
    scores = []
    if candidates:
        packed = _packed(df, column)
        fits = _fitted(df, packed, column, candidates, seed=seed, starts=starts, max_iter=300)
        centers = [np.array([center for _, center in _by_size(*fits[k])]) for k in candidates]
        scores = list(zip(candidates, _silhouettes(packed, column, centers)))
    best = max(scores, key=lambda s: (s[1] is not None, s[1] or 0.0))[0] if scores else 2
    table = scores or [(2, None)]
    return spark.createDataFrame(
        [(k, s, k == best) for k, s in table], "k int, silhouette_sq double, chosen boolean"
    )
