"""Centroid clustering of whole-number vectors, exact, with Hamerly's bounds.

Each vector keeps one upper bound of the distance to its centroid and one lower bound of the distance to the nearest other centroid. When centroids move, the upper
bound grows by the drift of its own centroid and the lower one shrinks by the largest drift of the others. While the first stays below the second, the assignment can't
have changed and nothing is computed; else the own distance is taken anew, and only if the bounds still meet the vector is compared with all centroids in whole
numbers. Bounds are floating-point numbers held apart by SLACK, so that rounding can only cost a comparison, and ties always go through whole numbers.

A round reads the table of the round before and writes the next one (vector, cluster, the cluster before, both bounds) to the shared folder; only sums by cluster (a row a cluster)
reach the driver, after the first round those of vectors that moved alone. A lost executor costs its tasks of a round.

Vectors with another number of components than asked for, and those with a null or non-finite component, are left out. Repeated rows and ids count each time; a null id is hashed
like an empty one, equal hashes are ordered by the vector. Fewer vectors than centroids make fewer centroids; no vectors, no rows. A component must stay below LARGEST, so that squared distances
fit into 64 bits: a larger one is an error. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table, table

SIZE, CENTROIDS, ROUNDS, FACTOR = 64, 16, 3, 64
SLACK = 1e-9
#: Of the absolute value of a component: 64 squares of differences below 2^29 stay under 2^63.
LARGEST = 1 << 28
#: Vectors compared with all centroids at a time.
AT_ONCE = 4096
STATE = "vec_id long, vector array<int>, cluster int, was int, upper double, lower double"


def whole_vectors(df: DataFrame, size: int = SIZE, factor: int = FACTOR, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of usable vectors, as whole numbers floor(factor * x)."""
    usable = (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))
    small = F.forall("vector", lambda x: F.abs(x) < LARGEST)
    out = df.filter(F.coalesce(usable, F.lit(False))).select(F.col(id).cast("long").alias("vec_id"), scaled.alias("vector"))
    return out.select("vec_id", F.when(small, F.col("vector").cast("array<int>")).otherwise(F.raise_error(F.lit("a component is too large for distances of 64 bits"))).alias("vector"))


def seeds(vectors: DataFrame, count: int = CENTROIDS) -> np.ndarray:
    """The vectors of the least hashes of '1:' and the id, in order: count rows at most."""
    told = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.vector for r in vectors.orderBy(told, "vector").limit(count).select("vector").collect()], np.int64)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("vector")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every x to every centroid, in whole numbers."""
    return np.stack([np.square(x - c).sum(axis=1) for c in centroids], 1)


def _scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) by comparing with all centroids; of equal distances the smaller number."""
    cluster, upper, lower = np.zeros(len(x), np.int32), np.zeros(len(x)), np.full(len(x), np.inf)
    for k in range(0, len(x), AT_ONCE):
        d = _squares(x[k : k + AT_ONCE], centroids)
        part = np.arange(len(d))
        cluster[k : k + AT_ONCE] = near = d.argmin(axis=1)
        upper[k : k + AT_ONCE] = np.sqrt(d[part, near])
        if len(centroids) > 1:
            lower[k : k + AT_ONCE] = np.sqrt(np.partition(d, 1, axis=1)[:, 1])
    return cluster, upper * (1 + SLACK), lower * (1 - SLACK)


def _first(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, upper, lower = _scan(_matrix(batch), centroids)
            before = np.full(len(cluster), -1, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), *map(pa.array, (cluster, before, upper, lower))], ["vec_id", "vector", "cluster", "was", "upper", "lower"])

    return run


def _again(centroids: np.ndarray, old: np.ndarray):
    """The next assignment, from bounds against the old centroids."""
    drift = np.sqrt(np.square(centroids - old).sum(axis=1)) * (1 + SLACK)
    others = np.array([np.delete(drift, k).max(initial=0) for k in range(len(drift))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            was = batch.column("cluster").to_numpy().copy()
            upper, lower = (batch.column(k).to_numpy().copy() for k in ("upper", "lower"))
            cluster = was.copy()
            upper = (upper + drift[was]) * (1 + SLACK)
            lower = (lower - others[was]) * (1 - SLACK * np.sign(lower - others[was]))
            doubtful = np.flatnonzero(upper >= lower)
            if len(doubtful):
                x = _matrix(batch)
                upper[doubtful] = np.sqrt(np.square(x[doubtful] - centroids[was[doubtful]]).sum(axis=1)) * (1 + SLACK)
                doubtful = doubtful[upper[doubtful] >= lower[doubtful]]
                cluster[doubtful], upper[doubtful], lower[doubtful] = _scan(x[doubtful], centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), *map(pa.array, (cluster, was, upper, lower))], ["vec_id", "vector", "cluster", "was", "upper", "lower"])

    return run


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, n, sums) of what a batch adds to clusters and takes from those before."""
    for batch in batches:
        x, cluster, was = _matrix(batch), batch.column("cluster").to_numpy(), batch.column("was").to_numpy()
        for side, sign in ((cluster, 1), (was, -1)):
            for k in np.unique(side[side >= 0]).tolist():
                chosen = side == k
                yield pa.RecordBatch.from_pydict({"cluster": pa.array([k], pa.int32()), "n": [sign * int(chosen.sum())], "sums": [(sign * x[chosen].sum(axis=0)).tolist()]})


def _changes(state: DataFrame, size: int) -> list[tuple[int, int, list[int]]]:
    """What the moves of a round change, by cluster: number of vectors and sums of components."""
    parts = state.filter("cluster <> was").select("vector", "cluster", "was").mapInArrow(_moved, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k].cast("decimal(30,0)")).alias(f"s{k}") for k in range(size)))
    return [(r.cluster, r.n, [int(r[f"s{k}"]) for k in range(size)]) for r in total.collect()]


def cluster(vectors: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(state, centroids) after so many rounds and a last assignment; state: vec_id, vector, cluster and bounds."""
    k, size = centroids.shape
    n, sums = [0] * k, [[0] * size for _ in range(k)]
    state = shared_table(vectors.mapInArrow(_first(centroids), STATE), "vectors-0")
    for turn in range(1, rounds + 1):
        for c, more, added in _changes(state, size):
            n[c] += more
            sums[c] = [a + b for a, b in zip(sums[c], added, strict=True)]
        old, centroids = centroids, np.array([[s // n[c] for s in sums[c]] if n[c] else centroids[c].tolist() for c in range(k)], np.int64)
        state = shared_table(state.mapInArrow(_again(centroids, old), STATE), f"vectors-{turn}")
    return state, centroids


def assignments(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of a clustering."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("cluster").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(np.square(_matrix(batch) - centroids[near]).sum(axis=1))], ["vec_id", "cluster", "distance"])

    out = shared_table(state.select("vec_id", "vector", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: r.inertia for r in out.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by = lambda values: reduce(lambda rest, k: F.when(F.col("cluster") == k, F.lit(values[k])).otherwise(rest), sorted(inertia), F.lit(None))
    return out.select("*", by(inertia).cast("long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), by(told).cast("string").alias("centroid_sha256"))


def op13_clusters(spark, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    first = seeds(vectors)
    if not len(first):
        return assignments(vectors.select("*", *(F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("was", "int"), ("upper", "double"), ("lower", "double")))), np.zeros((1, SIZE), np.int64))
    return assignments(*cluster(vectors, first))


def sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL that assigns and moves by plain comparison with all centroids."""
    near = "SELECT r, vec_id, v, n, d FROM (SELECT x.*, c.n, list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::HUGEINT AS d FROM x, {c} c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, n) = 1"
    parts = [
        "x AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64)",
        "c0 AS (SELECT n, v FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS n, v FROM x) WHERE n < 16)",
    ]
    for k in range(1, rounds + 1):
        parts += [
            f"a{k} AS ({near.format(c=f'c{k - 1}')})",
            f"s{k} AS (SELECT n, i, sum(v[i])::HUGEINT AS s, count(*) AS m FROM (SELECT n, v, unnest(range(1, 65)) AS i FROM a{k}) GROUP BY n, i)",
            f"m{k} AS (SELECT n, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS v FROM s{k} GROUP BY n)",
            f"c{k} AS (SELECT n, coalesce(m.v, c.v) AS v FROM c{k - 1} c LEFT JOIN m{k} m USING (n))",
        ]
    parts.append(f"a AS ({near.format(c=f'c{rounds}')})")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.n::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.n))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a JOIN c{rounds} c USING (n)"""
