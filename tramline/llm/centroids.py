"""Centroid clustering of integer vectors by kd-tree filtering.

The vectors are cut into sets of at most ``TREE`` rows, each a kd-tree whose nodes hold count, integer sums
and bounding box; the trees are written once.  Each round sends the centroids down every tree, level by
level: of a node's candidates those stay that are not strictly farther than the one nearest to the middle
for every place in the box; a node with one candidate is assigned whole, by count and sums; leaves with
several are resolved vector by vector.  All arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table, tidy

SIZE, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Vectors of a tree and, at most, of a leaf (equal vectors share one whatever their number).
TREE, LEAF = 16_384, 32
#: Components beyond this have no exact 64-bit distances.
LARGEST = 1 << 27
#: Floating-point products and sums of 64 of them are exact for components up to this.
EXACT_FLOAT = 1 << 22

TREES = "ids binary, nulls binary, points binary, left binary, first binary, last binary"


def kept(df: DataFrame, id_col: str, vector_col: str, size: int = SIZE, scale: float = SCALE) -> DataFrame:
    """(vec_id, v): vectors of exactly ``size`` components, none null or non-finite, as floor(scale * x)."""
    v = F.col("v")
    plain = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return plain.filter((F.size(v) == size) & finite).select("vec_id", F.transform(v, lambda x: F.floor(x * float(scale))).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS) -> np.ndarray:
    """The k vectors of the smallest hashes of ``1:<vec_id>``; null ids come last, equal ids by their components."""
    h = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


class Tree:
    """Nodes in level order: ``left`` child (the right one follows; -1 at leaves) and their ``first``..``last`` points."""

    def __init__(self, points: np.ndarray, left: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.points, self.left, self.first, self.last = points, left, first, last
        self.count = last - first
        totals = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, 0)))
        self.sums = totals[last] - totals[first]
        leaves = np.flatnonzero(left < 0)  # they partition the points, in order of ``first``
        leaves = leaves[np.argsort(first[leaves])]
        self.low, self.high = (np.empty((len(left), points.shape[1]), np.int64) for _ in range(2))
        self.low[leaves] = np.minimum.reduceat(points, first[leaves], 0)
        self.high[leaves] = np.maximum.reduceat(points, first[leaves], 0)
        for node in np.flatnonzero(left >= 0)[::-1]:
            child = left[node]
            self.low[node] = np.minimum(self.low[child], self.low[child + 1])
            self.high[node] = np.maximum(self.high[child], self.high[child + 1])

    @staticmethod
    def order(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The order of the points, and left, first and last of the nodes: halves along the widest side."""
        order = np.arange(len(points))
        left, first, last = [-1], [0], [len(points)]
        node = 0
        while node < len(left):
            lo, hi = first[node], last[node]
            own = points[order[lo:hi]]
            width = own.max(0) - own.min(0)
            side = int(width.argmax())
            if hi - lo > leaf and width[side]:
                middle = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own[:, side], middle, kind="introselect")]
                left[node] = len(left)
                left += [-1, -1]
                first += [lo, lo + middle]
                last += [lo + middle, hi]
            node += 1
        return order, *(np.array(x, np.int64) for x in (left, first, last))


def _squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each centroid, exact."""
    small = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT_FLOAT
    kind = np.float64 if small else np.int64
    p, c = points.astype(kind), centroids.astype(kind)
    return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def assign(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster of each point, and counts and sums of the clusters; nearest centroid, ties to the smaller number."""
    k = len(centroids)
    cluster = np.empty(len(tree.points), np.int64)
    counts, sums = np.zeros(k, np.int64), np.zeros((k, tree.points.shape[1]), np.int64)
    nodes, alive = np.array([0]), np.ones((1, k), bool)
    norms = (centroids * centroids).sum(1)
    while len(nodes):
        low, high = tree.low[nodes], tree.high[nodes]
        to_middle = np.where(alive, _squares(low + high, 2 * centroids), np.iinfo(np.int64).max)
        best = to_middle.argmin(1)
        for z in range(k):
            rows = np.flatnonzero(alive[:, z] & (best != z))
            away = centroids[z] - centroids[best[rows]]
            reach = (np.maximum(away, 0) * high[rows] + np.minimum(away, 0) * low[rows]).sum(1)  # at the box's corner nearest to z
            alive[rows, z] = norms[z] - norms[best[rows]] <= 2 * reach
        whole = alive.sum(1) == 1
        for node, z in zip(nodes[whole], best[whole], strict=True):
            cluster[tree.first[node] : tree.last[node]] = z
        np.add.at(counts, best[whole], tree.count[nodes[whole]])
        np.add.at(sums, best[whole], tree.sums[nodes[whole]])
        leaf = ~whole & (tree.left[nodes] < 0)
        if leaf.any():
            n = tree.count[nodes[leaf]]
            at = np.repeat(tree.first[nodes[leaf]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            own = np.where(np.repeat(alive[leaf], n, 0), _squares(tree.points[at], centroids), np.iinfo(np.int64).max).argmin(1)
            cluster[at] = own
            counts += np.bincount(own, minlength=k)
            np.add.at(sums, own, tree.points[at])
        inner = ~whole & (tree.left[nodes] >= 0)
        below = tree.left[nodes[inner]]
        nodes, alive = np.concatenate((below, below + 1)), np.concatenate((alive[inner], alive[inner]))
    return cluster, counts, sums


def plant(vectors: DataFrame, size: int = SIZE, tree: int = TREE) -> DataFrame:
    """The vectors as kd-trees, one row each, written to the shared folder."""

    def grown(ids: list, rows: list) -> pa.RecordBatch:
        points = np.concatenate(rows)
        if points.max() > LARGEST or points.min() < -LARGEST:
            raise ValueError(f"components beyond {LARGEST} after scaling have no exact 64-bit distances")
        order, left, first, last = Tree.order(points)
        ids = pa.chunked_array(ids).combine_chunks().take(pa.array(order))
        columns = [ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), points[order], left, first, last]
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns], TREES.replace(" binary", "").split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, n = [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, tree):
                part = b.slice(at, tree)
                if n + part.num_rows > tree:
                    yield grown(ids, rows)
                    ids, rows, n = [], [], 0
                ids.append(part.column(0))
                rows.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                n += part.num_rows
        if n:
            yield grown(ids, rows)

    return settle(vectors.mapInArrow(tidy(run), TREES), "trees")


def _trees(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, Tree]]:
    for b in batches:
        for row in b.to_pylist():
            of = lambda name, kind=np.int64: np.frombuffer(row[name], kind)  # noqa: B023, E731
            yield pa.array(of("ids"), pa.int64(), mask=of("nulls", bool)), Tree(of("points").reshape(-1, size), of("left"), of("first"), of("last"))


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``vectors`` as ``kept`` gives them.  Fewer than k vectors are as many centroids; none give no rows;
    null ids are clustered too and start no centroid while others are left; repeated rows count each.
    Only the centroids (k rows) and sums of clusters (k * size rows) come to the driver.
    """
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k)
    trees = plant(vectors, size)

    def summed(centroids: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), size), np.int64)
            for _, tree in _trees(batches, size):
                _, n, s = assign(tree, centroids)
                counts += n
                sums += s
            z = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([np.repeat(z, size), np.tile(np.arange(size), len(z)), np.repeat(counts[z], size), sums[z].ravel()], ["cluster", "side", "n", "total"])

        return run

    def final(centroids: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, tree in _trees(batches, size):
                own, _, _ = assign(tree, centroids)
                away = tree.points - centroids[own]
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array((away * away).sum(1))], ["vec_id", "cluster", "distance"])

        return run

    for _ in range(rounds if len(centroids) else 0):
        parts = trees.mapInArrow(tidy(summed(centroids)), "cluster long, side long, n long, total long")
        big = "decimal(38,0)"
        found = parts.groupBy("cluster", "side").agg(F.sum(F.col("n").cast(big)).alias("n"), F.sum(F.col("total").cast(big)).alias("total")).collect()
        centroids = centroids.copy()
        for r in found:
            centroids[r["cluster"], r["side"]] = int(r["total"]) // int(r["n"])
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    placed = settle(trees.mapInArrow(tidy(final(centroids)), "vec_id long, cluster int, distance long"), "clusters")
    own = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    total = sum(r["cluster_inertia"] for r in own)
    text = {z: ",".join(map(str, c)) for z, c in enumerate(centroids.tolist())}
    notes = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], total, text[r["cluster"]]) for r in own], "cluster int, cluster_inertia long, inertia long, centroid string")
    notes = notes.withColumn("centroid_sha256", F.sha2("centroid", 256)).drop("centroid")
    return placed.join(F.broadcast(notes), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of ``embeddings`` after three rounds from 16 centroids.

    Vectors that are null, of another length, or with a null or non-finite component are left out; null
    ids stay; repeated rows count each; an empty table gives no rows.
    """
    return cluster(kept(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


def _round(k: int) -> str:
    return f"""
p{k} AS MATERIALIZED (SELECT q.rid, min(struct_pack(d := d, c := c)) AS near FROM (
    SELECT v.rid, m.c, list_sum(list_transform(list_zip(v.v, m.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM vectors v, m{k} m) q GROUP BY q.rid)"""


def _means(k: int) -> str:
    return f"""
s{k} AS (SELECT p.near.c AS c, g.i, sum(v.v[g.i]) AS s, count(*) AS n FROM p{k} p JOIN vectors v USING (rid), range(1, {SIZE + 1}) g(i) GROUP BY ALL),
f{k} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{k} GROUP BY c),
m{k + 1} AS MATERIALIZED (SELECT m.c, coalesce(f.m, m.m) AS m FROM m{k} m LEFT JOIN f{k} f USING (c))"""


OP12_SQL = f"""
WITH vectors AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, v FROM vectors ORDER BY h, v LIMIT {CLUSTERS})),
{",".join(_round(k) + "," + _means(k) for k in range(ROUNDS))},{_round(ROUNDS)}
SELECT v.vec_id, p.near.c::INTEGER AS cluster, p.near.d AS distance, (sum(p.near.d) OVER (PARTITION BY p.near.c))::BIGINT AS cluster_inertia, (sum(p.near.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(m.m, ',')) AS centroid_sha256
FROM p{ROUNDS} p JOIN vectors v USING (rid) JOIN m{ROUNDS} m ON m.c = p.near.c"""
