"""Centroid clustering with Yinyang bounds, in whole numbers.

Components are scaled and floored, so distances, sums and centroids are exact and do not
depend on how rows are dealt. Every vector carries an upper bound of the distance to its
own centroid and one lower bound for each group of centroids (its own left out). Centroids
are grouped once, at the start. When they have moved, bounds are widened by how far: a
vector whose upper bound lies below all of its lower bounds keeps its centroid (the global
filter; the upper bound is made exact before the vector is given up to the next one), a
group whose lower bound lies above the upper bound is passed over (the group filter), and
the centroids of the groups that are left are compared exactly. Bounds are doubles with
slack, and only a strictly larger bound passes anything over, so ties still go to the
smaller number.

A round reads and writes one table of vectors with their bounds; the one before it is
deleted then. Sums of a cluster are combined in each task before the shuffle, so a crowded
cluster is no hot spot, and what reaches the driver is a row for each centroid.

Kept are vectors of exactly ``dim`` components, none null or non-finite; others give no
row. Components are held within ``MOST`` in size, so that squares fit a long. The first
centroids are the kept vectors with the smallest hashes of their ids, ties by components;
a null id is hashed as the text null. Fewer vectors than centroids give fewer centroids,
repeated rows are vectors of their own, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import drop_path, shared_path

#: The largest size of a scaled component.
MOST = 1 << 26
#: Centroids of a group, on average.
PER_GROUP = 4
#: Rows compared at once.
ROWS = 4096


def whole_vectors(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, v): the kept vectors as arrays of floor(scale * component)."""
    e = F.col(vector).cast("array<double>")
    fine = (F.size(e) == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    held = F.transform(e, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return vectors.where(F.col(vector).isNotNull() & fine).select(F.col(ident).alias("vec_id"), held.alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: str = "1") -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order: at most k rows reach the driver."""
    order: Column = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return np.array([r["v"] for r in rows.select("v", order.alias("h")).orderBy("h", "v").limit(k).collect()], np.int64)


def grouped(centroids: np.ndarray, number: int, steps: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means over the centroids themselves."""
    points = centroids.astype(float)
    heads = points[:number].copy()
    for _ in range(steps):
        group = ((points[:, None] - heads[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(group):
            heads[g] = points[group == g].mean(axis=0)
    return np.unique(group, return_inverse=True)[1]


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centroid."""
    return (rows * rows).sum(axis=1)[:, None] - 2 * (rows @ centroids.T) + (centroids * centroids).sum(axis=1)[None]


def loose(bound: np.ndarray) -> np.ndarray:
    """An upper bound, with room for rounding."""
    return bound * (1 + 1e-9) + 1e-9


class Bounds:
    """What a task knows of a batch of vectors, and how it follows the centroids."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scanned: np.ndarray) -> None:
        self.cluster, self.upper, self.lower, self.scanned = cluster, upper, lower, scanned

    @staticmethod
    def fresh(v: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> Bounds:
        d = squared(v, centroids)
        own = d.argmin(axis=1)
        at = np.arange(len(v))
        upper = np.sqrt(d[at, own].astype(float))
        rest = np.sqrt(d.astype(float))
        rest[at, own] = np.inf
        lower = np.stack([rest[:, group == g].min(axis=1) for g in range(group.max() + 1)], axis=1)
        return Bounds(own, upper, lower, np.full(len(v), len(centroids)))

    def moved(self, v: np.ndarray, old: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> None:
        """Follow the centroids from ``old`` to where they are now."""
        drift = np.sqrt(((centroids - old) ** 2).sum(axis=1).astype(float))
        groups = group.max() + 1
        self.upper = self.upper + drift[self.cluster]
        self.lower = self.lower - np.array([drift[group == g].max() for g in range(groups)])[None]
        # the global filter, with the bound as it is and then exact
        unsure = np.flatnonzero(self.lower.min(axis=1) <= loose(self.upper))
        own = self.cluster[unsure]
        exact = ((v[unsure] - centroids[own]) ** 2).sum(axis=1)
        self.upper[unsure] = np.sqrt(exact.astype(float))
        self.scanned[unsure] += 1
        still = self.lower[unsure].min(axis=1) <= loose(self.upper[unsure])
        unsure, best, number = unsure[still], exact[still], own[still].copy()
        limit = loose(self.upper[unsure])
        open_ = self.lower[unsure] <= limit[:, None]  # the group filter
        distances: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for g in range(groups):
            rows = np.flatnonzero(open_[:, g])
            if not len(rows):
                continue
            members = np.flatnonzero(group == g)
            d = squared(v[unsure[rows]], centroids[members])
            self.scanned[unsure[rows]] += len(members)
            distances.append((g, rows, members, d))
            at = d.argmin(axis=1)
            least, who = d[np.arange(len(rows)), at], members[at]
            better = (least < best[rows]) | ((least == best[rows]) & (who < number[rows]))
            best[rows[better]], number[rows[better]] = least[better], who[better]
        for g, rows, members, d in distances:
            rest = np.sqrt(d.astype(float))
            rest[members[None] == number[rows][:, None]] = np.inf
            self.lower[unsure[rows], g] = rest.min(axis=1)
        # a centroid that is left behind in a group that was passed over now bounds that group
        before = self.cluster[unsure]
        left = np.flatnonzero((before != number) & ~open_[np.arange(len(unsure)), group[before]])
        self.lower[unsure[left], group[before[left]]] = np.minimum(self.lower[unsure[left], group[before[left]]], self.upper[unsure[left]])
        self.cluster[unsure], self.upper[unsure] = number, np.sqrt(best.astype(float))


def assigned(rows: DataFrame, old: np.ndarray | None, centroids: np.ndarray, group: np.ndarray) -> DataFrame:
    """``rows`` with cluster, upper, lower and scanned; from scratch, or from the bounds that they carry."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                b = whole.slice(at, ROWS)
                v = b.column(1).flatten().to_numpy().reshape(-1, dim).astype(np.int64)
                if old is None:
                    s = Bounds.fresh(v, centroids, group)
                else:
                    cluster, upper, scanned = (b.column(i).to_numpy(zero_copy_only=False).copy() for i in (2, 3, 5))
                    s = Bounds(cluster.astype(np.int64), upper, b.column(4).flatten().to_numpy().reshape(len(b), -1).copy(), scanned)
                    s.moved(v, old, centroids, group)
                lower = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * s.lower.shape[1]), pa.array(s.lower.reshape(-1)))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(s.cluster.astype(np.int32)), pa.array(s.upper), lower, pa.array(s.scanned.astype(np.int32))], names=["vec_id", "v", "cluster", "upper", "lower", "scanned"])

    return rows.mapInArrow(run, f"vec_id {kind}, v array<int>, cluster int, upper double, lower array<double>, scanned int")


def means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored mean of each cluster; that of an empty one stays where it is."""
    dim, out = centroids.shape[1], centroids.copy()
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dim)])
    for r in sums.collect():  # a row for each centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return out


def yinyang(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1", ident: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, upper, lower, scanned) after the last assignment, and the centroids that it was made with.

    scanned is the number of distances that were computed for a vector in all rounds.
    """
    spark = vectors.sparkSession

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = shared_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    rows, at = kept(whole_vectors(vectors, ident, vector, dim, scale), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        none = rows.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0.0).alias("upper"), F.array(F.lit(0.0)).alias("lower"), F.lit(0).alias("scanned"))
        return none, centroids
    group, old = grouped(centroids, max(1, len(centroids) // PER_GROUP)), None
    for n in range(rounds + 1):
        rows, new = kept(assigned(rows, old, centroids, group), "assigned")
        drop_path(spark, at)
        at = new
        if n < rounds:
            old, centroids = centroids, means(rows, centroids)
    return rows, centroids


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """Per kept vector: cluster, distance (squared), cluster_inertia, inertia and centroid_sha256."""
    rows, centroids = yinyang(vectors, **options)
    if not len(centroids):
        return rows.select("vec_id", "cluster", *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    spark = vectors.sparkSession
    table = [(i, c.tolist(), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = F.broadcast(spark.createDataFrame(table, "cluster int, c array<long>, centroid_sha256 string"))  # a row for each centroid
    square = F.aggregate(F.zip_with("v", "c", lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda a, x: a + x)
    far = rows.join(named, "cluster").select("vec_id", "cluster", square.alias("distance"), "centroid_sha256")
    sums = rows.join(named, "cluster").groupBy("cluster").agg(F.sum(square).alias("cluster_inertia")).collect()
    total = sum(r["cluster_inertia"] for r in sums)
    inertia = F.broadcast(spark.createDataFrame([(r["cluster"], r["cluster_inertia"], total) for r in sums], "cluster int, cluster_inertia long, inertia long"))
    return far.join(inertia, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
