"""Clusters around centroids by exponion search: a vector meets only centroids in a ball around the one it was nearest to."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm.tables import delete_table, in_arrow, new_path, quoted

#: Components are whole numbers of at most this size, so that squared distances fit in a long.
LARGEST = 1 << 27
#: Up to this size products and sums of whole numbers are exact in double precision.
EXACT = 1 << 22
#: Bounds are widened by this share, far above what rounding can take away.
SLACK = 1e-9
STATE = "ids array<bigint>, vectors binary, cluster binary, upper binary, lower binary, part int, part_count bigint, part_sum array<bigint>"
RESULT = "id bigint, cluster int, distance bigint, part int, part_count bigint, part_sum array<bigint>"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows x and c, as a matrix."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c.astype(np.int64)], axis=1)


def own_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of x and that of c."""
    d = x - c
    return (d * d).sum(1)


@dataclass
class Search:
    """Centroids, how far each moved since the last round, and each one's list of the others, nearest first."""

    centroids: np.ndarray
    moved: np.ndarray

    def __post_init__(self) -> None:
        between = np.sqrt(squared(self.centroids, self.centroids).astype(np.float64))
        np.fill_diagonal(between, -1.0)  # a centroid leads its own list
        self.order = np.argsort(between, axis=1, kind="stable")
        self.sorted = np.take_along_axis(between, self.order, axis=1)
        k = len(between)
        self.nearest = self.sorted[:, 1] if k > 1 else np.full(k, np.inf)
        most = np.argsort(-self.moved)
        # how far any centroid but one's own can have come nearer
        self.others = np.where(np.arange(k) == most[0], self.moved[most[1]] if k > 1 else 0.0, self.moved[most[0]])

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid of each row (of equal ones the smaller number), its distance, and the next one's."""
        return self._best(x, np.arange(len(self.centroids)))

    def _best(self, x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = squared(x, self.centroids[among])
        best = d.argmin(axis=1)
        rows = np.arange(len(x))
        upper = np.sqrt(d[rows, best].astype(np.float64))
        rest = d.astype(np.float64)
        rest[rows, best] = np.inf
        return among[best], upper, np.sqrt(rest.min(axis=1, initial=np.inf))

    def again(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same after the centroids moved, from last round's cluster and bounds.

        Rows whose own centroid is surely nearer than any other keep it unseen. The others meet the centroids within
        2 upper + the distance of the nearest other centroid, where their two nearest ones are; the list is read up to a
        power of two, so that rows of one centroid fall into few groups. What lies on the ball is within it, so ties are seen.
        """
        cluster, upper = cluster.copy(), (upper + self.moved[cluster]) * (1 + SLACK)
        lower = np.maximum(lower - self.others[cluster], 0.0) * (1 - SLACK)
        bar = np.maximum(lower, self.nearest[cluster] / 2 * (1 - SLACK))
        open_ = np.flatnonzero(upper >= bar)
        upper[open_] = np.sqrt(own_squared(x[open_], self.centroids[cluster[open_]]).astype(np.float64))
        open_ = open_[upper[open_] * (1 + SLACK) >= bar[open_]]
        if len(open_) and len(self.centroids) > 1:
            held, radius = cluster[open_], (2 * upper[open_] + self.nearest[cluster[open_]]) * (1 + SLACK)
            reach = np.empty(len(open_), np.int64)
            for c in np.unique(held):
                reach[held == c] = np.searchsorted(self.sorted[c], radius[held == c], side="right")
            width = np.minimum(1 << np.ceil(np.log2(np.maximum(reach, 2))).astype(np.int64), len(self.centroids))
            kind = held * (len(self.centroids) + 1) + width
            by_kind = np.argsort(kind, kind="stable")
            for group in np.split(by_kind, np.flatnonzero(np.diff(kind[by_kind])) + 1):
                at = open_[group]
                among = np.sort(self.order[held[group[0]], : width[group[0]]])
                cluster[at], upper[at], lower[at] = self._best(x[at], among)
        return cluster, upper, lower


def _sums(x: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros((k, x.shape[1]), np.int64)
    order = np.argsort(cluster, kind="stable")
    kinds, first = np.unique(cluster[order], return_index=True)
    if len(kinds):
        total[kinds] = np.add.reduceat(x[order], first, axis=0)
    return total, np.bincount(cluster, minlength=k)


class Parts:
    """What a task's rows add to the sums and counts of the clusters."""

    def __init__(self, k: int, width: int) -> None:
        self.sums, self.counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)

    def add(self, x: np.ndarray, cluster: np.ndarray, sign: int = 1) -> None:
        total, count = _sums(x, cluster, len(self.counts))
        self.sums += sign * total
        self.counts += sign * count

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        some = np.flatnonzero((self.counts != 0) | (self.sums != 0).any(axis=1))
        own = {"part": pa.array(some.astype(np.int32)), "part_count": pa.array(self.counts[some]), "part_sum": pa.array(list(self.sums[some]), pa.list_(pa.int64()))}
        return pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(len(some), f.type)) for f in schema], schema=schema)


BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("cluster", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("part", pa.int32()), ("part_count", pa.int64()), ("part_sum", pa.list_(pa.int64()))])
ROW = pa.schema([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("part", pa.int32()), ("part_count", pa.int64()), ("part_sum", pa.list_(pa.int64()))])


def _packed(ids: pa.Array, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    """A block of vectors with their clusters and bounds as one row."""
    small = x.astype(np.int16) if np.abs(x).max(initial=0) < 1 << 15 else x.astype(np.int32)
    wide, narrow = np.nextafter(upper.astype(np.float32), np.float32(np.inf)), np.nextafter(lower.astype(np.float32), np.float32(0))
    cells = [small, cluster.astype(np.int32), wide, narrow]
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([listed, *(pa.array([c.tobytes()], pa.binary()) for c in cells), *(pa.nulls(1, f.type) for f in list(BLOCK)[5:])], schema=BLOCK)


def _unpacked(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column(0).slice(i, 1).flatten()
            vectors, cluster, upper, lower = (batch.column(j)[i].as_buffer() for j in range(1, 5))
            kind = np.int16 if vectors.size == 2 * dims * len(ids) else np.int32
            x = np.frombuffer(vectors, kind).reshape(len(ids), dims).astype(np.int64)
            yield ids, x, np.frombuffer(cluster, np.int32).astype(np.int64), np.frombuffer(upper, np.float32).astype(np.float64), np.frombuffer(lower, np.float32).astype(np.float64)


def _integers(batch: pa.RecordBatch, dims: int, scale: int) -> np.ndarray:
    return np.floor(scale * batch.column(1).flatten().to_numpy().reshape(batch.num_rows, dims)).astype(np.int64)


def usable(rows: DataFrame, dims: int, scale: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector) of the rows whose vector has `dims` components, none null, none that is no finite number or too large."""
    fits = lambda x: x.isNotNull() & (F.abs(x * scale) <= float(LARGEST))  # noqa: E731  NaN is above every number
    named = rows.select(F.col(quoted(id)).cast("long").alias("id"), F.col(quoted(vector)).cast("array<double>").alias("vector"))
    return named.where((F.size("vector") == dims) & F.forall("vector", fits))


def seeds(rows: DataFrame, k: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The integer vectors of the k rows whose SHA-256 of `seed:id` is smallest; rows without an id start nothing."""
    named = rows.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("digest"), "vector")
    first = named.orderBy("digest", "vector").limit(k).collect()
    return np.floor(scale * np.array([r["vector"] for r in first], np.float64).reshape(len(first), dims)).astype(np.int64)


@dataclass
class Clusters:
    """rows (id, cluster, distance), and by cluster: its centroid, how many rows it has and the sum of their distances."""

    rows: DataFrame
    centroids: np.ndarray
    counts: list[int]
    inertia: list[int]


def _gathered(state: DataFrame, width: int, k: int) -> tuple[list[list[int]], list[int]]:
    """The parts that tasks wrote, added up: at most k * width numbers come to the driver."""
    parts = state.where("part IS NOT NULL").select("part", "part_count", F.posexplode("part_sum").alias("at", "value"))
    sums, counts = [[0] * width for _ in range(k)], [0] * k
    for r in parts.groupBy("part", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("part_count").alias("n")).collect():
        sums[r["part"]][r["at"]], counts[r["part"]] = int(r["value"]), r["n"]
    return sums, counts


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, id: str = "vec_id", vector: str = "embedding") -> Clusters:
    """k-means over the integer vectors floor(scale * x), exact to the last digit: rounds of assigning and averaging, then one more assignment.

    A vector belongs to the nearest centroid, of equal ones to the smaller number; a centroid becomes the floor of its
    vectors' mean, and stays where it has none. With fewer than k vectors there are fewer centroids.

    Vectors are packed in blocks, a block to a row, and stay in their partition: nothing is shuffled but the parts that
    tasks wrote. Each round writes the blocks anew with their clusters and bounds, and deletes what the round before
    wrote. Of centroids only the k themselves, and the changes of their sums, pass through the driver.

    Rows of another length, or with components that are null, not finite or above LARGEST / scale, are left out: their
    squared distances would not fit in a long. Null ids stay and start no cluster; rows with repeated ids stand for themselves.
    An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    spark, held = rows.sparkSession, usable(rows, dims, scale, id, vector)
    centroids = seeds(held, k, dims, scale, seed)
    n = len(centroids)
    if not n:
        return Clusters(spark.createDataFrame([], "id bigint, cluster int, distance bigint"), centroids, [], [])
    sums, counts, before, path = [[0] * dims for _ in range(n)], [0] * n, None, None
    moved = np.zeros(n)
    for _ in range(rounds):
        state = _first(held, centroids, dims, scale) if before is None else _next(before, Search(centroids, moved), dims)
        written = new_path(spark, "clusters")
        state.write.parquet(written)
        if path:
            delete_table(spark, path)
        path, before = written, spark.read.schema(STATE).parquet(written)
        more, added = _gathered(before, dims, n)
        sums, counts = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(sums, more, strict=True)], [a + b for a, b in zip(counts, added, strict=True)]
        means = np.array([[x // counts[c] for x in sums[c]] if counts[c] else centroids[c].tolist() for c in range(n)], np.int64)
        moved = np.sqrt(own_squared(means, centroids).astype(np.float64))
        centroids = means
    last = new_path(spark, "clustered")
    (_last(before, Search(centroids, moved), dims) if before is not None else _last(_first(held, centroids, dims, scale), Search(centroids, moved), dims)).write.parquet(last)
    if path:
        delete_table(spark, path)
    done = spark.read.schema(RESULT).parquet(last)
    inertia, sizes = _gathered(done, 1, n)
    return Clusters(done.where("part IS NULL").select("id", "cluster", "distance"), centroids, sizes, [x[0] for x in inertia])


def _first(rows: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> DataFrame:
    """Blocks of all vectors with the nearest of the first centroids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, parts = Search(centroids, np.zeros(len(centroids))), Parts(len(centroids), dims)
        for batch in (b for b in batches if b.num_rows):
            x = _integers(batch, dims, scale)
            own, upper, lower = search.first(x)
            parts.add(x, own)
            yield _packed(batch.column(0), x, own, upper, lower)
        yield parts.batch(BLOCK)

    return in_arrow(rows, work, STATE)


def _blocks(state: DataFrame) -> DataFrame:
    return state.where("part IS NULL").select("ids", "vectors", "cluster", "upper", "lower")


def _next(state: DataFrame, search: Search, dims: int) -> DataFrame:
    """The blocks with their vectors' new clusters; what moved changes the sums."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(len(search.centroids), dims)
        for ids, x, held, upper, lower in _unpacked(batches, dims):
            own, upper, lower = search.again(x, held, upper, lower)
            went = own != held
            parts.add(x[went], held[went], -1)
            parts.add(x[went], own[went])
            yield _packed(ids, x, own, upper, lower)
        yield parts.batch(BLOCK)

    return in_arrow(_blocks(state), work, STATE)


def _last(state: DataFrame, search: Search, dims: int) -> DataFrame:
    """A row for each vector with its cluster and squared distance, and what each task adds to the clusters' inertia."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(len(search.centroids), 1)
        for ids, x, held, upper, lower in _unpacked(batches, dims):
            own, _, _ = search.again(x, held, upper, lower)
            distance = own_squared(x, search.centroids[own])
            parts.add(distance[:, None], own)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(distance), *(pa.nulls(len(ids), f.type) for f in list(ROW)[3:])], schema=ROW)
        yield parts.batch(ROW)

    return in_arrow(_blocks(state), work, RESULT)


def digest(centroid: np.ndarray) -> str:
    """SHA-256 of the components as decimal whole numbers, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def with_clusters(spark: SparkSession, found: Clusters) -> DataFrame:
    """found.rows with cluster_inertia, inertia and centroid_sha256; the k clusters' values are broadcast."""
    values = [(c, found.inertia[c], sum(found.inertia), digest(found.centroids[c])) for c in range(len(found.centroids))]
    return found.rows.join(F.broadcast(spark.createDataFrame(values, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")), "cluster")
