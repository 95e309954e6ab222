"""Centroid clustering by plain Lloyd iterations on integers (operator 12).

Vectors are scaled to integers, so every distance, sum and mean is exact and a result does not depend on how the input is split.

* ``vectors`` keeps rows with the asked number of components, none null or non-finite.
* ``first_centroids`` takes the k kept vectors with the smallest hash of seed and id.
* A round broadcasts the centroids (k times the components, whatever the input); a task computes the integer squared differences to one
  centroid after another, takes the lowest index among the nearest, and gives its own sums; a groupBy merges the sums of all tasks.
* ``assign`` is narrow: one row per kept vector.

What the driver holds is k centroids with their members and inertia. Every pass reads the table anew, so a lost executor costs its tasks alone; no row is shuffled but
the sums, k times the components per task.

Null embeddings, other lengths, null, NaN or infinite components, and components beyond 2**150 after scaling (no 32-bit float is): the row is
not kept. A null id counts as the empty text in the hash, its row is kept. Repeated rows count as often as they stand; equal hashes (repeated ids) are
ordered by components. Fewer kept vectors than k give fewer centroids; an empty table gives an empty result. A distance or an inertia that no
long holds is null. Columns other than id and embedding are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, save, table
from quarry.shipping import ship

#: Components up to this magnitude keep 64 squared differences within a long; others are computed with Python's integers.
SAFE = 2**27
LONG = 2**63 - 1
#: Sums travel as high and low parts, each a decimal(38,0).
LOW_BITS = 64


def vectors(df: DataFrame, components: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x array<double>) of the rows that can be clustered."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**144)))
    return df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where((F.size("x") == components) & whole)


def integers(rows, scale: int) -> np.ndarray:
    """floor(scale * x) of stacked vectors: int64 where all are small, else Python integers."""
    scaled = np.floor(np.stack(rows) * float(scale))
    if np.abs(scaled).max(initial=0) <= SAFE:
        return scaled.astype(np.int64)
    return np.array([[int(c) for c in row] for row in scaled], dtype=object)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the lowest on ties) and the squared distance, by row."""
    small = x.dtype != object and all(abs(c) <= SAFE for centroid in centroids for c in centroid) and x.shape[1] <= 64
    distances = []
    for centroid in centroids:
        difference = x - np.array(centroid, dtype=np.int64) if small else x.astype(object) - np.array(centroid, dtype=object)
        distances.append((difference * difference).sum(axis=1))
    stacked = np.stack(distances)
    cluster = stacked.argmin(axis=0)
    return cluster, stacked[cluster, np.arange(len(x))]


def first_centroids(kept: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of 'seed:id', in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return [[int(c) for c in integers([row.x], scale)[0]] for row in rows]


def _sums(kept: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """A row per centroid and component of each task: members and the sum's high and low part."""
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        means = shared.value
        counts, totals = [0] * len(means), [[0] * len(means[0]) for _ in means]
        for batch in batches:
            if not len(batch):
                continue
            x = integers(list(batch.x), scale)
            cluster, _ = nearest(x, means)
            for c in np.unique(cluster):
                members = x[cluster == c]
                counts[c] += len(members)
                totals[c] = [t + int(s) for t, s in zip(totals[c], members.sum(axis=0), strict=True)]
        rows = [
            (c, at, counts[c], str(total >> LOW_BITS), str(total & (2**LOW_BITS - 1)))
            for c in range(len(means)) if counts[c] for at, total in enumerate(totals[c])
        ]
        yield pd.DataFrame(rows, columns=["cluster", "place", "members", "high", "low"])

    ship(kept.sparkSession)
    parts = kept.select("x").mapInPandas(run, "cluster int, place int, members long, high string, low string")
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    return parts.groupBy("cluster", "place").agg(F.sum("members").alias("members"), *whole)


def step(kept: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """One round: each centroid becomes the floor of its vectors' mean; an empty one stays."""
    moved = [list(c) for c in centroids]
    for row in _sums(kept, centroids, scale).collect():
        moved[row.cluster][row.place] = ((int(row.high) << LOW_BITS) + int(row.low)) // row.members
    return moved


def assign(kept: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """(id, cluster, distance) of each kept vector."""
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cluster, distance = [], []
            if batch.num_rows:
                found, far = nearest(integers(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1), scale), shared.value)
                cluster, distance = found.tolist(), [d if d <= LONG else None for d in far.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    return map_arrow(kept, run, "id long, cluster int, distance long")


def fit(kept: DataFrame, k: int, rounds: int, seed: int, scale: int) -> list[list[int]]:
    """The centroids after so many rounds; none where no vector is kept."""
    centroids = first_centroids(kept, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        centroids = step(kept, centroids, scale)
    return centroids


def _total(distance: Column) -> Column:
    """The sum of distances, null where a distance is or where no long holds it."""
    sum_ = F.sum(distance.cast("decimal(38,0)"))
    return F.when((F.count(F.lit(1)) == F.count(distance)) & (sum_ <= F.lit(LONG)), sum_).cast("long")


def cluster(df: DataFrame, components: int = 64, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vectors with cluster and distance, clusters with members, inertia and components)."""
    spark = df.sparkSession
    kept = vectors(df, components, id_col, vector_col)
    centroids = fit(kept, k, rounds, seed, scale)
    if not centroids:
        assigned = spark.createDataFrame([], "id long, cluster int, distance long")
    else:
        assigned = save(assign(kept, centroids, scale), "assigned")
    found = {r.cluster: r for r in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), _total(F.col("distance")).alias("inertia")).collect()}
    rows = []
    for i, centroid in enumerate(centroids):
        digest = hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
        members, inertia = (found[i].members, found[i].inertia) if i in found else (0, 0)
        rows.append((i, [str(c) for c in centroid], digest, members, inertia))
    return assigned, spark.createDataFrame(rows, "cluster int, components array<string>, centroid_sha256 string, members long, cluster_inertia long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most k rows of clusters are joined back to the assigned vectors."""
    assigned, clusters = cluster(table(spark, sf_dir, "embeddings"))
    each = [r.cluster_inertia for r in clusters.select("cluster_inertia").collect()]
    inertia = None if None in each or sum(each) > LONG else sum(each)
    joined = assigned.join(F.broadcast(clusters.select("cluster", "cluster_inertia", "centroid_sha256")), "cluster")
    return joined.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "centroid_sha256")


def _oracle(components: int = 64, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64) -> str:
    parts = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS double)) AS bigint)) AS x
  FROM embeddings WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {components})""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster, x
  FROM (SELECT * FROM kept ORDER BY sha256('{seed}:' || vec_id) LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS (SELECT r, vec_id, x, best.d AS distance, best.n AS cluster FROM (
  SELECT r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x,
    min({{'d': CAST(list_sum(list_transform(generate_series(1, {components}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS bigint), 'n': c.cluster}}) AS best
  FROM kept v, c{i} c GROUP BY r))"""
        )
        if i < rounds:
            parts.append(
                f"""m{i} AS (SELECT cluster, list(mean ORDER BY place) AS x FROM (
  SELECT cluster, place, CAST((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS bigint) AS mean
  FROM (SELECT cluster, unnest(x) AS c, generate_subscripts(x, 1) AS place FROM a{i}) GROUP BY cluster, place) GROUP BY cluster),
c{i + 1} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (cluster))"""
            )
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.cluster AS integer) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY a.cluster) AS bigint) AS cluster_inertia, CAST(sum(distance) OVER () AS bigint) AS inertia,
  sha256(array_to_string(list_transform(c.x, lambda e: CAST(e AS varchar)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""
    )


ORACLE_SQL = _oracle()
