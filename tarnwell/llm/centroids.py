"""Centroid clustering (operator 11): Lloyd's rounds with Exponion search.

Every vector keeps an upper bound on the distance to its centroid and a lower bound
on that to the second nearest.  When centroids have moved, the bounds move by as
much; a vector whose upper bound lies strictly below the lower one, or below half
the way to the nearest other centroid, keeps its centroid unseen.  For the others
only the centroids inside a ball around the present centroid are looked at: with
the distance u to it and the way s to its nearest neighbour, the nearest and the
second nearest centroid lie no farther from it than 2 u + s.  The lists of
inter-centroid distances are sorted, so the ball is the front of a list; its radius
is inclusive, so ties are seen and go to the smaller number.

Vectors and centroids are integers and all distances that decide are exact; bounds
are widened by more than they can be rounded.  Vectors stand in blocks of
``BLOCK`` as bytes, their bounds beside them, in a table that each round reads and
writes once.  A task adds up only the vectors that changed their centroid, so what
leaves it is one row of k * (dimensions + 1) sums, and the driver holds the
centroids and their sums: bounded by k, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove, shared_folder, stored
from .common import map_arrow

DIMENSIONS = 64
K = 40
ROUNDS = 5
SCALE = 256
BLOCK = 4096
PAIRS = 1 << 14
#: Squared distances of 64 components up to this size fit into 64 bits.
LARGEST = 1 << 27
_WIDER = 1 + 1e-12

_BLOCKS = "ids array<long>, vectors binary, cluster binary, upper binary, lower binary, distance binary, sums array<long>"


@dataclass(frozen=True)
class Ball:
    """Of each centroid the others by distance (itself first), how far each and any
    other centroid has moved in the last round, and half the way to the nearest."""

    centers: np.ndarray
    order: np.ndarray
    ways: np.ndarray
    nearest: np.ndarray
    moved: np.ndarray
    others_moved: np.ndarray

    @staticmethod
    def of(centers: np.ndarray, before: np.ndarray | None) -> Ball:
        k = len(centers)
        ways = np.sqrt(np.array([((centers - c) ** 2).sum(1) for c in centers], np.float64).reshape(k, k))
        ways[np.arange(k), np.arange(k)] = -1  # itself before copies of it
        order = np.argsort(ways, axis=1, kind="stable")
        ways = np.maximum(np.take_along_axis(ways, order, 1), 0)
        moved = np.zeros(k) if before is None else np.sqrt(((centers - before) ** 2).sum(1).astype(np.float64)) * _WIDER
        most = np.sort(moved)[::-1]
        others = np.where(moved == most[:1], most[1] if k > 1 else 0.0, most[:1])
        return Ball(centers, order, ways, ways[:, 1] if k > 1 else np.full(k, np.inf), moved, others)


def _own(vectors: np.ndarray, centers: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Squared distances to the own centroids."""
    out = np.empty(len(vectors), np.int64)
    for at in range(0, len(vectors), PAIRS):
        d = vectors[at : at + PAIRS] - centers[cluster[at : at + PAIRS]]
        out[at : at + PAIRS] = np.einsum("ij,ij->i", d, d)
    return out


def scan(vectors: np.ndarray, ball: Ball, cluster: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector the nearest of the first ``counts`` centroids in its
    centroid's list, the squared distance to it and that to the next."""
    n = len(vectors)
    best, near, second = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    ends = np.cumsum(counts)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right")))
        m = counts[first:last]
        starts = np.cumsum(m) - m
        row = np.repeat(np.arange(last - first), m)
        number = ball.order[cluster[first:last][row], np.arange(len(row)) - starts[row]]
        d = vectors[first:last][row] - ball.centers[number]
        d = np.einsum("ij,ij->i", d, d)
        least = np.minimum.reduceat(d, starts)
        ties = np.where(d == least[row], number, len(ball.centers))
        chosen = np.minimum.reduceat(ties, starts)
        rest = np.where(number == chosen[row], np.inf, d)
        best[first:last], near[first:last], second[first:last] = chosen, least, np.minimum.reduceat(rest, starts)
        first = last
    return best, near, second


def assign(vectors: np.ndarray, ball: Ball, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroids, the bounds, and how many pairs were looked at."""
    k = len(ball.centers)
    if state is None:
        n = len(vectors)
        best, near, second = scan(vectors, ball, np.zeros(n, np.int64), np.full(n, k))
        return best, np.sqrt(near) * _WIDER, np.sqrt(second) / _WIDER, n * k
    cluster, upper, lower = state[0].astype(np.int64), state[1] + ball.moved[state[0]], state[2] - ball.others_moved[state[0]]
    upper *= _WIDER
    bound = np.maximum(lower - np.abs(lower) * 1e-12, ball.nearest[cluster] / 2 / _WIDER)
    rows = np.flatnonzero(upper >= bound)
    upper[rows] = np.sqrt(_own(vectors[rows], ball.centers, cluster[rows])) * _WIDER
    looked = len(rows)
    rows = rows[upper[rows] >= bound[rows]]
    radius = (2 * upper[rows] + ball.nearest[cluster[rows]]) * _WIDER
    counts = np.empty(len(rows), np.int64)
    for c in np.unique(cluster[rows]):
        mine = cluster[rows] == c
        counts[mine] = np.searchsorted(ball.ways[c], radius[mine], side="right")
    best, near, second = scan(vectors[rows], ball, cluster[rows], counts)
    cluster[rows], upper[rows], lower[rows] = best, np.sqrt(near) * _WIDER, np.sqrt(second) / _WIDER
    return cluster, upper, lower, looked + int(counts.sum())


def _blocks(dimensions: int):
    """Arrow batches of (id, vector) to blocks of the vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            offsets = np.asarray(column.offsets, np.int64)
            values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            whole = np.flatnonzero((np.diff(offsets) == dimensions) & column.is_valid().to_numpy(zero_copy_only=False))
            for at in range(0, len(whole), BLOCK):
                rows = whole[at : at + BLOCK]
                x = values[offsets[rows][:, None] + np.arange(dimensions)]
                finite = np.isfinite(x).all(1)  # a null component is not a number here
                x = np.floor(SCALE * x[finite])
                if x.size and np.abs(x).max() > LARGEST:
                    raise ValueError(f"components beyond {LARGEST // SCALE} have distances that no long holds")
                if len(x):
                    ids = batch.column(0).take(pa.array(rows[finite]))
                    yield _batch(ids, x.astype("<i4").tobytes())

    return run


def _batch(ids: pa.Array | None, vectors: bytes | None, *rest: bytes, sums: np.ndarray | None = None) -> pa.RecordBatch:
    listed = pa.array([None], pa.list_(pa.int64())) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64()))
    binary = [pa.array([b], pa.binary()) for b in (vectors, *rest, *[None] * (4 - len(rest)))]
    added = pa.array([None if sums is None else sums.ravel().tolist()], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([listed, *binary, added], names=["ids", "vectors", "cluster", "upper", "lower", "distance", "sums"])


def _round(ball: Ball, first: bool, last: bool):
    """One assignment of all blocks; the last row of a task holds its changes of the
    sums and counts, in the last round the sums of distances."""
    k, dimensions = ball.centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, 1 if last else dimensions + 1), np.int64)
        for batch in batches:
            for n in range(len(batch)):
                ids, raw = batch.column(0)[n].values, batch.column(1)[n].as_py()
                x = np.frombuffer(raw, "<i4").reshape(-1, dimensions).astype(np.int64)
                state = None if first else tuple(np.frombuffer(batch.column(c)[n].as_buffer(), kind) for c, kind in ((2, "<i4"), (3, "<f8"), (4, "<f8")))
                cluster, upper, lower, _ = assign(x, ball, state)
                if last:
                    distance = _own(x, ball.centers, cluster)
                    np.add.at(sums[:, 0], cluster, distance)
                    yield _batch(ids, None, cluster.astype("<i4").tobytes(), b"", b"", distance.tobytes())
                    continue
                changed = np.arange(len(x)) if first else np.flatnonzero(cluster != state[0])
                for sign, of in ((1, cluster), (-1, None if first else state[0])):
                    if of is not None and len(changed):
                        order = changed[np.argsort(of[changed], kind="stable")]
                        starts = np.flatnonzero(np.diff(of[order], prepend=-1))
                        where = of[order[starts]]
                        sums[where, :dimensions] += sign * np.add.reduceat(x[order], starts, axis=0)
                        sums[where, dimensions] += sign * np.diff(starts, append=len(order))
                yield _batch(ids, raw, cluster.astype("<i4").tobytes(), upper.tobytes(), lower.tobytes())
        yield _batch(None, None, sums=sums)

    return run


def _total(table: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sums of all tasks: one number for each component of each centroid."""
    out = np.zeros(shape, np.int64)
    for place, value in table.filter("sums IS NOT NULL").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).collect():
        out.flat[place] = value
    return out


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, id_col: str = "vec_id", vector_col: str = "embedding", seed: str = "2:") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia,
    inertia and centroid_sha256 (of the components as decimal integers joined by ``,``).

    Kept are vectors of exactly ``dimensions`` finite components, as integers
    floor(256 x); a component beyond 2**19 is refused with an error, as distances
    would not fit a long.  The first centroids are the k vectors with the smallest
    sha256 of ``seed`` and id (equal ids: by components; null ids last); with fewer
    vectors than k there are as many centroids as vectors.  Repeated rows and null ids
    are vectors like others.  Ties go to the smaller number and a centroid without
    vectors stays.  No kept vectors give no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    chosen = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    name = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    whole = F.transform("v", lambda x: F.floor(SCALE * x))
    start = chosen.filter((F.size("v") == dimensions) & ~bad).select(name.alias("name"), whole.alias("v")).orderBy(F.asc_nulls_last("name"), "v").limit(k)
    centers = np.array([r.v for r in start.collect()], np.int64).reshape(-1, dimensions)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centers):
        return spark.createDataFrame([], schema)

    table, before = map_arrow(chosen, _blocks(dimensions), _BLOCKS), None
    sums, folder = np.zeros((len(centers), dimensions + 1), np.int64), None
    for n in range(rounds + 1):
        last = n == rounds
        old, folder = folder, shared_folder(spark, "centroids")
        step = _round(Ball.of(centers, before), n == 0, last)
        table = stored(map_arrow(table, step, _BLOCKS), "round", folder)
        if old:
            remove(spark, old)
        if not last:
            sums += _total(table, sums.shape)
            before = centers
            count = sums[:, dimensions :]
            centers = np.where(count > 0, sums[:, :dimensions] // np.maximum(count, 1), centers)
        blocks = table.filter("ids IS NOT NULL")
        inertia = _total(table, (len(centers), 1))[:, 0] if last else None
        table = blocks
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                cluster = np.frombuffer(batch.column(1)[n].as_buffer(), "<i4")
                columns = [batch.column(0)[n].values, cluster, np.frombuffer(batch.column(2)[n].as_buffer(), "<i8"), inertia[cluster], np.full(len(cluster), inertia.sum()), pa.array(names).take(pa.array(cluster))]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return map_arrow(table.select("ids", "cluster", "distance"), unpack, schema)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings`` in 40 clusters after 5 rounds."""
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int, rounds: int) -> str:
    """The same rounds with all distances, which whole numbers keep exact."""
    parts = [
        "kept AS (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k, v FROM kept QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), v) <= {k})",
    ]
    for n in range(rounds + 1):
        pairs = f"SELECT p.row_id, c.k, list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v) AS d FROM kept p, c{n} c"
        parts.append(f"a{n} AS (SELECT row_id, min({{'d': d, 'k': k}}) AS m FROM ({pairs}) GROUP BY row_id)")
        if n < rounds:
            parts.append(
                f"m{n} AS (SELECT k, list(x ORDER BY i) AS v FROM (SELECT k, i, floor(sum(x) / count(*)) AS x FROM"
                f" (SELECT a.m.k AS k, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS i FROM kept p JOIN a{n} a USING (row_id)) GROUP BY k, i) GROUP BY k),"
                f" c{n + 1} AS (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m ON c.k = m.k)"
            )
    digest = "sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ','))"
    return (
        "WITH " + ", ".join(parts) + f" SELECT p.vec_id, a.m.k::INTEGER AS cluster, a.m.d::BIGINT AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.k))::BIGINT AS cluster_inertia,"
        f" (sum(a.m.d) OVER ())::BIGINT AS inertia, {digest} AS centroid_sha256 FROM kept p JOIN a{rounds} a USING (row_id) JOIN c{rounds} c ON c.k = a.m.k"
    )


OP11_SQL = _sql(K, ROUNDS)
