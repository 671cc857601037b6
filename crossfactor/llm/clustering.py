"""Centroid clustering by weighted deduplication: Lloyd rounds over distinct integer vectors.

Vectors of a fixed number of components are made integers; equal ones are grouped, with their number as weight, before and
after one shuffle, and the distinct ones are written. A round reads them once: each task assigns its vectors to the nearest
centroid in 64-bit integers and sums them by weight, exactly, and adds up to one row a centroid and component; the sums of
all tasks, of a size set by clusters and components alone, make the next centroids on the driver. At the end each
vector gets its group's cluster back by a join on the SHA-256 of its components, rather than on the components.

A vector that makes up a third of all rows is one row after the first aggregation; in the join back its rows meet a single
row, and adaptive execution splits them. Results don't depend on partitions, as all sums are of integers.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out; equal
distances go to the smaller centroid number; a null ``vec_id`` is drawn as ``1:null``; rows with equal ids are ordered by their
vectors in the draw, and each gets its own row; fewer vectors than clusters make as many centroids as there are vectors; empty
clusters keep their centroid; an empty table gives no rows; other columns are ignored, whatever their names. Components beyond
2,097,152 in size raise, as do sums of distances beyond 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfactor.llm.common import tidy, written
from crossfactor.llm.vectors import matrix, quantised, valid

COMPONENTS, CLUSTERS, ROUNDS = 64, 16, 3
#: Bits of the lower part in which weighted components are summed, so that products with counts under 2**36 stay in 64 bits.
HALF = 14

Centroids = list[list[int]]


@dataclass(frozen=True)
class Clustering:
    """``assigned``: vec_id, cluster, distance of each vector; ``inertia`` by cluster."""

    assigned: DataFrame
    centroids: Centroids
    inertia: list[int]

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest centroid of each vector, and its squared distance."""
    best, distance = np.zeros(len(vectors), np.int32), np.full(len(vectors), np.iinfo(np.int64).max)
    for number, centroid in enumerate(centroids):
        apart = vectors - centroid
        own = np.einsum("ij,ij->i", apart, apart)
        closer = own < distance
        best[closer], distance[closer] = number, own[closer]
    return best, distance


def sums(vectors: np.ndarray, weights: np.ndarray) -> list[int]:
    """Weighted sums of the components, exactly: high and low bits apart."""
    high, low = weights @ (vectors >> HALF), weights @ (vectors & ((1 << HALF) - 1))
    return [(int(h) << HALF) + int(x) for h, x in zip(high, low, strict=True)]


def summing(centroids: Centroids, components: int):
    """Of batches of (vector, n), a task's sums: cluster, component (-1: the number of vectors), value."""

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, totals = np.array(centroids, np.int64), {}
        for batch in batches:
            vectors, weights = matrix(batch.column(0), components), batch.column(1).to_numpy()
            best, _ = nearest(vectors, table)
            for cluster in np.unique(best).tolist():
                mine = best == cluster
                found = [int(weights[mine].sum()), *sums(vectors[mine], weights[mine])]
                totals[cluster] = [a + b for a, b in zip(totals.get(cluster, [0] * len(found)), found, strict=True)]
        rows = [(c, i - 1, str(v)) for c, values in totals.items() for i, v in enumerate(values)]
        yield pa.RecordBatch.from_pydict({"cluster": pa.array([r[0] for r in rows], pa.int32()), "component": pa.array([r[1] for r in rows], pa.int32()), "value": pa.array([r[2] for r in rows], pa.string())})

    return run


def assigning(centroids: Centroids, components: int):
    schema = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(centroids, np.int64)
        for batch in batches:
            best, distance = nearest(matrix(batch.column(0), components), table)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(best), pa.array(distance)], schema=schema)

    return run


def moved(distinct: DataFrame, centroids: Centroids, components: int) -> Centroids:
    """The floors of the weighted means of each cluster's vectors; an empty cluster's centroid stays."""
    parts = distinct.select("vector", "n").mapInArrow(summing(centroids, components), "cluster int, component int, value string")
    found: dict[int, dict[int, int]] = {}
    for row in parts.groupBy("cluster", "component").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        found.setdefault(row["cluster"], {})[row["component"]] = int(row["value"])
    return [[found[c][i] // found[c][-1] for i in range(components)] if c in found else own for c, own in enumerate(centroids)]


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, seed: str = "1") -> Clustering:
    """Lloyd's algorithm from the ``clusters`` vectors whose SHA-256 of ``seed:vec_id`` is smallest."""
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    kept = given.where(valid(F.col("embedding")) & (F.size("embedding") == components)).select("vec_id", quantised(F.col("embedding")).alias("vector"))
    rows = written(kept.withColumn("digest", F.unhex(F.sha2(F.array_join("vector", ","), 256))), "vectors", lasting=True)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    centroids = [list(r.vector) for r in rows.select("vector", draw.alias("draw")).orderBy("draw", "vector").limit(clusters).collect()]
    if not centroids:
        return Clustering(rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], [])
    distinct = written(rows.groupBy("digest", "vector").agg(F.count("*").alias("n")).select("vector", "n", "digest"), "distinct")
    for _ in range(rounds):
        centroids = moved(distinct, centroids, components)
    groups = written(distinct.mapInArrow(assigning(centroids, components), "digest binary, n long, cluster int, distance long"), "groups", lasting=True)
    inertia = {r["cluster"]: int(r["inertia"]) for r in groups.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("distance")).alias("inertia")).collect()}
    assigned = rows.select("vec_id", "digest").join(groups.drop("n").hint("merge"), "digest").select("vec_id", "cluster", "distance")
    return Clustering(assigned, centroids, [inertia.get(c, 0) for c in range(len(centroids))])


def label(embeddings: DataFrame) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, and of its cluster and of all the inertia and the centroid's digest."""
    found = cluster(embeddings)
    pick = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1) if values else F.lit(None).cast(kind)
    return found.assigned.select("vec_id", "cluster", "distance", pick(found.inertia, "long").alias("cluster_inertia"), F.lit(sum(found.inertia)).cast("long").alias("inertia"), pick(found.digests(), "string").alias("centroid_sha256"))
