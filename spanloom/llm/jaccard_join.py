"""Exact Jaccard join in metric space: pivot regions, triangle windows, recursion.

Jaccard distance is a metric on sets of word shingles. Links are pairs within
0.15 of each other; classes of equal sets stand for their documents.

First level. Every shingle is a pivot, a set of one element. A document is at
distance ``1 - 1/n`` from each of its own shingles and at 1 from all others, so
its region is that of its first shingle in a common order, rarest first. Two
linked documents miss at most ``n - ceil(0.85 n)`` of each other's shingles, so
copying each document to the regions of its first ``n - ceil(0.85 n) + 1``
pivots makes every linked pair meet in a region. (Whole documents as first-level
pivots would not tell texts apart: unrelated texts are all at distance 1.)

Further levels. Each document is compared with the most central document that
shares a region with it; that links most near copies to their source. Regions
whose documents are linked already are done. Large ones are joined through
documents as pivots: exact distances to some pivots assign each document to the
cell of the nearest one and to a shell of width 0.15 around it. A document is
copied to another cell if its distance there exceeds its nearest by at most twice
0.15, and to the next shell: by the triangle inequality linked documents share a
cell. Cells are regions of the next level. In small regions, and in cells that
pivots no longer divide, documents of different components are paired. Those of
large families, compared with one central document, are tied to a block of the
family first, block by block in numpy, so that few are left to pair. Pairs
whose sizes, or whose parities or counts of shingles per hash bucket, lie further
apart than linked sets can are left out, and the others are measured exactly.
Neither distance exceeds the number of shingles that two sets don't share, so no
link is lost.

What leaves the join is a set of verified links that connects every component;
links inside a component that others imply are not looked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.storage import written, written_counted
from .common import Remembered, free_name, small_batches, words_of

WORDS = 4
PERCENT = 85
#: Words whose hashes a task remembers, in each of two generations.
REMEMBERED = 150_000
#: Pivots of a large region.
PIVOTS = 8
#: Regions of so many documents are joined pair by pair.
LEAF = 4096
#: Documents that one task compares with those of a family.
BLOCK = 512
#: Shingles that such documents hold together, on average.
BLOCK_SHINGLES = 1 << 19
#: A cell that keeps more than this share of its region is joined pair by pair too.
STUCK = 0.75
#: Hash buckets whose shingle counts bound a distance from below.
BUCKETS = 128
#: 64-bit words of parities that do so without leaving a join.
PARITY_WORDS = 8
#: Ids of at most so many documents are broadcast (8 bytes each, counted).
BROADCAST_ROWS = 500_000


def missing(n: int, percent: int = PERCENT) -> int:
    """Shingles of ``n`` that a linked document may lack."""
    return n + -(percent * n) // 100


def spare(n: int, percent: int = PERCENT) -> int:
    """Further first pivots that linked documents are sure to share, up to half of those needed."""
    needed = missing(n, percent) + 1
    return max(0, min(-(-needed // 2), n - needed))


class Shingling:
    """64-bit hashes of a text's word shingles.

    Two shingles of a pair of documents share a hash with odds of one in some
    10^13 for texts of 1000 words; nothing else is approximate.
    """

    def __init__(self, words: int = WORDS):
        self.words = words
        self.known = Remembered(REMEMBERED)

    def of_text(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; a text of fewer words is one shingle."""
        import xxhash

        said = [] if text is None else words_of(text.translate(LOWER))
        if not said:
            return np.zeros(0, dtype=np.int64)
        known = self.known
        for word in known.missing(set(said)):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, said), dtype=np.uint64, count=len(said))
        width = min(self.words, len(said))
        out = np.full(len(said) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(said) - width + 1 + i]
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.unique((out ^ (out >> np.uint64(31))).view(np.int64))


@lru_cache(maxsize=2)
def shingling_of(words: int) -> Shingling:
    """One per Python worker: its next tasks know the words of earlier ones."""
    return Shingling(words)


LOWER = {upper: upper + 32 for upper in range(65, 91)}


def class_key(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


SKETCH = "doc_id long, fingerprint long, n int, class binary, first array<long>"


def sketches(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Set size, class and first pivots, in hash order, of each document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingling = shingling_of(words)
        for batch in batches:
            sets = [shingling.of_text(x) for x in batch.column("text").to_pylist()]
            first = [s[: missing(len(s), percent) + 1 + spare(len(s), percent)] for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in first])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("fingerprint"),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([class_key(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*first, np.zeros(0, np.int64)]))),
                ],
                ["doc_id", "fingerprint", "n", "class", "first"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fingerprint"), "text"
    )
    return rows.mapInArrow(sketch, SKETCH)


def _dropped(n: Column, percent: int) -> Column:
    """Common pivots that may be passed over: ``spare`` of the smallest set linked to one of ``n``."""
    least = F.ceil(n * percent / 100)
    needed = least - F.ceil(least * percent / 100) + 1
    return F.greatest(F.lit(0), F.least(F.ceil(needed / 2), least - needed)).cast("int")


def first_regions(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``region, node, apart``: first-level regions of all classes that share enough pivots.

    ``apart`` is the share of a class's first pivots that no other class has; the
    source of many near copies has the least.

    ``classes`` has ``node, n, first``. The pivots at hand are the first in hash
    order, ``spare`` more than needed, so linked sets share that many more. Put
    in order of frequency, the most frequent of them can be passed over: common
    passages make no region.
    """
    pivots = classes.select("node", "n", F.size("first").alias("held"), F.explode("first").alias("pivot"))
    often = pivots.groupBy("pivot").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = pivots.join(often, "pivot")
    kept = shared.groupBy("node", "n", "held").agg(
        F.array_sort(F.collect_list(F.struct("often", "pivot"))).alias("shared")
    )  # at most the first pivots of one set
    left = F.size("shared") - _dropped(F.col("n"), percent)
    apart = (1 - F.size("shared") / F.col("held")).alias("apart")
    kept = kept.where(left > 0).select("node", apart, F.explode(F.slice("shared", 1, left)).alias("s"))
    return kept.select(F.col("s.pivot").alias("region"), "node", "apart")


def bucket_counts(shingles: np.ndarray, buckets: int = BUCKETS) -> bytes:
    """Shingles in each hash bucket, 255 at most."""
    counts = np.bincount(shingles & np.int64(buckets - 1), minlength=buckets)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def parities(shingles: np.ndarray) -> np.ndarray:
    """Of each of 64 PARITY_WORDS hash buckets, whether it holds an odd number of shingles.

    A shingle that one of two sets lacks turns one bit, so parities differ in no
    more bits than sets differ in shingles.
    """
    buckets = (shingles >> np.int64(20)) & np.int64(64 * PARITY_WORDS - 1)
    odd = (np.bincount(buckets, minlength=64 * PARITY_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """``node, shingles, counts, parity`` of the classes in ``wanted`` (``node, class, low``)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingling = shingling_of(words)
        for batch in batches:
            sets = [shingling.of_text(x) for x in batch.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    batch.column("class"),
                    pa.array([class_key(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))),
                    pa.array([bucket_counts(s) for s in sets], pa.binary()),
                    pa.array([parities(s) for s in sets], pa.list_(pa.int64())),
                ],
                ["node", "class", "found", "shingles", "counts", "parity"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("low"), "text").join(wanted, "low")
    made = texts.select("node", "class", "text").mapInArrow(
        measure, "node long, class binary, found binary, shingles array<long>, counts binary, parity array<long>"
    )
    # of rows that repeat an id, those with the class's own text
    return made.where(F.col("class") == F.col("found")).select("node", "shingles", "counts", "parity")


def maybe_linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs ``a, b`` whose bucket counts don't rule a link out.

    Linked sets of ``n`` and ``m`` shingles differ in ``(n + m) (100 - p) / (100 + p)``
    at most, and the counts' distance is no larger than that difference.
    """
    thin = sets.select("node", F.size("shingles").alias("n"), "counts")
    left = thin.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("counts").alias("c_a"))
    right = thin.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("counts").alias("c_b"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(len(batch), -1).astype(np.int64)
                for c in ("c_a", "c_b")
            )
            sizes = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            near = np.abs(a - b).sum(axis=1) * (100 + percent) <= sizes * (100 - percent)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.join(right, "b").join(left, "a").mapInArrow(test, "a long, b long")


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact intersections and unions of ``a, b`` pairs, one row for each."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    return (
        pairs.join(right, "b")
        .join(left, "a")
        .select("a", "b", both.alias("both"), (F.size("_a") + F.size("_b") - both).alias("either"))
    )


def _linked(percent: int) -> Column:
    return F.col("both") * 100 >= F.col("either") * percent


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node each linked node reaches.

    Large-star and small-star rounds: every node's neighbours are tied to its
    smallest neighbour, until the links are stars. Links are few (one per
    document and region at most) and each round is two aggregations, whose
    results are joined back; a round's links are written, so lost executors cost
    one round at most.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = written(edges, "jaccard-edges")
    after = _fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        # large star: larger neighbours of a go to the least of a's neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        # small star: a node and its smaller neighbours go to the least of them
        large = large.where("a <> b").distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            large.join(lows, "a")
            .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        small = written(small, "jaccard-edges")
        edges, before = small, after
        after = _fingerprint(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _fingerprint(edges: DataFrame) -> tuple:
    """Number and hash of distinct edges: one row."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open(members: DataFrame, labels: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Members of regions that hold two components and a core document, with their components."""
    marked = written(_labelled(members, labels), name)
    alive = (
        marked.groupBy("region")
        .agg(
            F.min("component").alias("_low"),
            F.max("component").alias("_high"),
            F.max("core").alias("_core"),
            F.count(F.lit(1)).alias("size"),
        )
        .where("_low <> _high and _core")
        .select("region", "size")
    )
    return written_counted(marked.join(alive, "region"), f"{name}-open")


def _central() -> Column:
    """Order of documents as pivots: those that share most come first."""
    return F.struct("apart", F.xxhash64("node").alias("h"), "node")


def _pivots(regions: DataFrame) -> DataFrame:
    """``region, pivots``: the most central core document of each of PIVOTS hash classes."""
    part = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
    return (
        regions.where("core")
        .groupBy("region", part.alias("_part"))
        .agg(F.min(_central()).alias("p"))
        .groupBy("region")
        .agg(F.collect_list("p.node").alias("pivots"))
    )


def _parity_columns(side: str) -> list[Column]:
    return [F.get("parity", F.lit(i)).alias(f"{side}{i}") for i in range(PARITY_WORDS)]


def _may_link(percent: int) -> Column:
    """Whether the open documents ``a`` and ``b`` of a join may be linked.

    They are of different components and one is core. Linked sets of ``n`` and
    ``m`` shingles have sizes in proportion and differ in ``(n + m) (100 - p) /
    (100 + p)`` shingles at most; parities never differ in more.
    """
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    bits = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(PARITY_WORDS)), F.lit(0))
    near = bits * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return (F.col("c_a") != F.col("c_b")) & (F.col("core_a") | F.col("core_b")) & sizes & near


def _side(rows: DataFrame, side: str, *keys: str) -> DataFrame:
    named = [F.col(c).alias(f"{n}_{side}") for c, n in (("n", "n"), ("component", "c"), ("core", "core"), ("family", "f"))]
    return rows.select(*keys, F.col("node").alias(side), *named, *_parity_columns(side))


def _kin(regions: DataFrame) -> DataFrame:
    """``node, n, component, family, core, parts``: members of families of two components, once each."""
    kin = regions.groupBy("node", "n", "component", "family").agg(F.max("core").alias("core"))
    blocks = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    families = kin.groupBy("family").agg(
        F.ceil(blocks).cast("int").alias("parts"), F.min("component").alias("_low"), F.max("component").alias("_high")
    )
    return kin.join(families.where("_low <> _high").select("family", "parts"), "family")


def _tied(hub: pa.Table, block: pa.Table, percent: int) -> pa.Table:
    """Verified links that connect what a hub and a block of its family have linked.

    Every document of the hub meets every one of the block, nearest counts first;
    pairs that earlier links connect are passed over.
    """
    sides = [hub, block]
    nodes = np.concatenate([t.column("node").to_numpy() for t in sides])
    root = np.concatenate([t.column("component").to_numpy() for t in sides])
    sets = [s for t in sides for c in t.column("shingles").chunks for s in _slices(c)]
    counts = np.frombuffer(b"".join(x for t in sides for x in t.column("counts").to_pylist()), dtype=np.uint8)
    counts = counts.reshape(len(nodes), -1).astype(np.int16)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    links: list[tuple[int, int]] = []
    first = hub.num_rows
    for i in range(first):
        apart = np.abs(counts[first:] - counts[i]).sum(axis=1, dtype=np.int64)
        near = apart * (100 + percent) <= (sizes[first:] + sizes[i]) * (100 - percent)
        found = np.flatnonzero(near & (root[first:] != root[i]))
        for j in first + found[np.argsort(apart[found], kind="stable")]:
            if root[i] == root[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both * 100 >= (sizes[i] + sizes[j] - both) * percent:
                links.append((int(nodes[i]), int(nodes[j])))
                root[root == root[j]] = root[i]
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _slices(lists: pa.ListArray) -> list[np.ndarray]:
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(ends, ends[1:])]


def _hub_links(kin: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` of large families with their hubs, and the hubs' ``node``.

    A family of several blocks has one of them, by hash, as its hub. Each block
    meets the hub in a group of its own, so rows grow with the documents, and no
    more links leave it than it has documents.
    """
    dealt = kin.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    hubs = dealt.where("part = 0")
    copies = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # columns of their own on either side, as both come from one table
    one, two = (
        x.join(sets, "node")
        .select(*[F.col(c).alias(c) for c in ("family", "part", "node", "component", "shingles", "counts")])
        .groupBy("family", "part")
        for x in (copies, dealt)
    )
    ties = one.cogroup(two).applyInArrow(lambda hub, block: _tied(hub, block, percent), "a long, b long")
    return ties, hubs.select("node")


def _cross_pairs(regions: DataFrame, sets: DataFrame, percent: int, met: DataFrame | None = None) -> DataFrame:
    """Pairs of different components that share a region or a family and may be linked.

    A family is the documents that were compared with the same central document.
    Documents of one family meet there, once; only those of different families
    are looked for region by region. Documents in ``met`` have been compared with
    all their families.
    """
    parity = sets.select("node", "parity")
    mixed = (
        regions.groupBy("region")
        .agg(F.min("family").alias("_low"), F.max("family").alias("_high"))
        .where("_low <> _high")
        .select("region")
    )
    rows = regions.join(mixed, "region").join(parity, "node")
    apart = _side(rows, "a", "region").join(_side(rows, "b", "region"), "region").where(
        (F.col("a") < F.col("b")) & (F.col("f_a") != F.col("f_b")) & _may_link(percent)
    )
    kin = _kin(regions)
    if met is not None:
        kin = kin.join(met, "node", "left_anti")
    kin = kin.join(parity, "node")
    one = _side(kin.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))), "a", "family", "part")
    two = _side(kin.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "b", "family", "part")
    one, two = one.withColumn("part", F.col("part").cast("int")), two.withColumn("part", F.col("part").cast("int"))
    close = one.join(two, ["family", "part"]).where((F.col("a") < F.col("b")) & _may_link(percent))
    return apart.select("a", "b").unionByName(close.select("a", "b")).distinct()


def links(
    classes: DataFrame, docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT
) -> tuple[DataFrame, DataFrame]:
    """Verified links that connect all components, and ``node, component`` of linked nodes."""
    members = written(first_regions(classes, percent), "jaccard-regions")
    near = members.groupBy("region").agg(F.min(_central()).alias("pivot"), F.count(F.lit(1)).alias("size"))
    members = written(members.join(near.where("size > 1"), "region"), "jaccard-members")
    # each document with the most central document of all its regions
    star = members.groupBy("node").agg(F.min("pivot").alias("pivot"))
    star, count = written_counted(
        star.select(F.col("pivot.node").alias("a"), F.col("node").alias("b")), "jaccard-star"
    )
    wanted = classes.select("node", "class", "low", "n").join(
        star.select(F.col("b").alias("node")), "node", "left_semi"
    )
    wanted = written(wanted, "jaccard-wanted")
    few = wanted.select("node", "class", "low")
    sets = shingle_sets(docs, F.broadcast(few) if count <= BROADCAST_ROWS else few, words)
    sets = written(sets, "jaccard-sets")
    found = written(
        distances(maybe_linked(star.where("a <> b"), sets, percent), sets).where(_linked(percent)).select("a", "b"),
        "jaccard-links",
    )
    labels = components(found)
    families = star.select(F.col("a").alias("family"), F.col("b").alias("node"))
    regions = members.join(wanted.select("node", "n").join(families, "node"), "node").select(
        "region", "node", "n", "apart", "family", F.lit(True).alias("core"), F.lit(False).alias("stuck")
    )
    level = 0
    while True:
        regions, count = _open(regions, labels, "jaccard-level")
        if not count:
            return found, labels
        level += 1
        small = (F.col("size") <= LEAF) | F.col("stuck")
        kin, many = written_counted(_kin(regions.where(small)).where("parts > 1"), "jaccard-kin")
        met = None
        if many:
            ties, met = _hub_links(kin, sets, percent)
            found = written(found.unionByName(ties).distinct(), "jaccard-links")
            labels = components(found)
            regions, count = _open(regions.drop("component", "size"), labels, "jaccard-level")
            if not count:
                return found, labels
        pairs = _cross_pairs(regions.where(small), sets, percent, met)
        more = distances(maybe_linked(pairs, sets, percent), sets).where(_linked(percent)).select("a", "b")
        large, rest = written_counted(regions.where(~small).drop("stuck"), "jaccard-large")
        if rest:
            chosen = written(_pivots(large), "jaccard-pivots")
            held = large.join(chosen, "region").withColumn("pivot", F.explode("pivots")).drop("pivots")
            far = held.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
            measured = written(distances(far, sets), "jaccard-distances")
            more = more.unionByName(measured.where(_linked(percent)).select("a", "b"))
        found = written(found.unionByName(more).distinct(), "jaccard-links")
        labels = components(found)
        if not rest:
            return found, labels
        regions = _cells(held, chosen, measured, percent, level)


def _cells(held: DataFrame, chosen: DataFrame, measured: DataFrame, percent: int, level: int) -> DataFrame:
    """Voronoi cells and shells of the next level, without the pivots themselves."""
    width = 100 - percent
    pivots = chosen.select("region", F.explode("pivots").alias("node"))
    placed = (
        held.join(pivots, ["region", "node"], "left_anti")
        .join(measured.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "both", "either"), ["pivot", "node"])
        .withColumn("far", (F.col("either") - F.col("both")) / F.col("either"))
    )
    nearest = placed.groupBy("region", "node", "n", "apart", "family", "core", "size").agg(
        F.min(F.struct("far", F.xxhash64("node", "pivot").alias("h"), "pivot")).alias("home"),
        F.collect_list(F.struct("pivot", "both", "either", "far")).alias("all"),
    )  # at most PIVOTS entries
    window = 2 * width / 100 + 1e-9
    cells = nearest.select("region", "node", "n", "apart", "family", "core", "size", "home", F.explode("all").alias("p")).where(
        F.col("p.far") <= F.col("home.far") + window
    )
    shell = F.floor((F.col("p.either") - F.col("p.both")) * 100 / (F.col("p.either") * width) + 1e-9)
    own = F.col("core") & (F.col("p.pivot") == F.col("home.pivot"))
    # linked documents x and y, x at home here, share the larger of their shells: x is core in both of its own
    shells = F.array(
        F.struct(shell.alias("shell"), own.alias("core")), F.struct((shell + 1).alias("shell"), own.alias("core"))
    )
    members = cells.select("region", "node", "n", "apart", "family", "size", F.col("p.pivot").alias("pivot"), F.explode(shells).alias("s")).select(
        F.xxhash64("region", "pivot", "s.shell", F.lit(level)).alias("region"), "node", "n", "apart", "family", "size", F.col("s.core").alias("core")
    )
    members = written(members, "jaccard-cells")
    sizes = members.groupBy("region").agg((F.count(F.lit(1)) > STUCK * F.max("size")).alias("stuck"))
    return members.drop("size").join(sizes, "region")


def joined(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, fingerprint, n_shingles, component_id, component``: one row per document.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Null and
    empty texts, and texts without words, have no shingles and link with nothing;
    a null id links with nothing and its component is null. Equal sets are linked
    through their class; rows that repeat an id are rows of their own (told apart
    by ``fingerprint``, a hash of the text), and ``component_id`` is the smallest
    id of any row they reach. ``component`` numbers components, null for rows
    that can't link.
    """
    small_batches(docs.sparkSession)
    sketched = written(sketches(docs, words, percent), "jaccard-sketches")
    classes = (
        sketched.where("n > 0 and doc_id is not null")
        .groupBy("class")
        .agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("first").alias("first"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = written(classes, "jaccard-classes")  # the node numbers are fixed from here on
    _, labels = links(classes, docs, words=words, percent=percent)
    known = _labelled(classes.select("class", "node", "low"), labels)
    least = known.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = known.join(least, "component").select("class", "component", "component_id")
    able = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return (
        sketched.withColumn("class", F.when(able, F.col("class")))
        .join(of_class, "class", "left")
        .select(
            "doc_id",
            "fingerprint",
            F.col("n").cast("long").alias("n_shingles"),
            F.coalesce("component_id", "doc_id").alias("component_id"),
            "component",
        )
    )


def representatives(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents left when one of each group of linked ones stays, with all columns.

    The smallest id of a group stays, of rows that repeat it the one with the
    least fingerprint. Documents without words or without an id all stay.
    """
    columns = docs.columns
    found = joined(docs, words=words, percent=percent).where(F.col("component").isNotNull())
    stay = found.groupBy("component").agg(F.min(F.struct("doc_id", "fingerprint")).alias("k"))
    mark = free_name(docs, "_fingerprint")
    keys = stay.select(F.col("k.doc_id").alias("doc_id"), F.col("k.fingerprint").alias(mark))
    marked = docs.withColumn(mark, F.xxhash64("text"))
    bare = F.col("doc_id").isNull() | (
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(0)) == 0
    )
    held = marked.where(~bare).join(keys, ["doc_id", mark], "left_semi")
    once = held.dropDuplicates(["doc_id", mark])
    return once.select(*columns).unionByName(docs.where(bare))
