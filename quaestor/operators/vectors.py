"""Vectors of texts, their nearest neighbours in blocks, and an inverted file of cells around centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text as X
from quaestor.functions.vector import DIMENSION
from quaestor.operators.ranking import best_of, ranked
from quaestor.sources import stored

#: Queries that go to all tasks by broadcast take at most so many bytes; more are dealt with the vectors.
BROADCAST_BYTES = 32 << 20
#: Vectors of a block, and rows of best hits that a task holds before it passes them on.
BLOCK, HELD = 2_048, 500_000
#: An inverted file: vectors that its centroids are fitted on at most, rounds, and cells at most.
SAMPLE, ROUNDS, CELLS = 20_000, 10, 1_024
#: Share of the nearest vectors that a query's cells are to hold, as measured on the sample.
RECALL = 0.97


# vectors of texts


def _bags(words: pa.Array, dimension: int) -> np.ndarray:
    """A row of counts by bucket for each list of words; a word that a batch holds often is hashed once."""
    words = words.fill_null([]) if words.null_count else words
    coded = words.flatten().dictionary_encode()
    of = np.array([int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:8], 16) % dimension for w in coded.dictionary.to_pylist()], np.int64)
    row = np.repeat(np.arange(len(words)), np.diff(np.asarray(words.offsets)))
    hits = row * dimension + of[np.asarray(coded.indices)] if len(row) else row
    return np.bincount(hits, minlength=len(words) * dimension).reshape(len(words), dimension)


def _fields(rows: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)


def bags_of(rows: DataFrame, text: str, keep: list[str], dimension: int = DIMENSION) -> DataFrame:
    """`keep` columns, bucket and n: the places of each text's hashed bag of tokens that are not zero; no shuffle."""
    asked = rows.select(*keep, X.tokens(F.col(text)).alias("_words"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _bags(batch.column("_words"), dimension)
            row, bucket = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in keep), pa.array(bucket.astype(np.int32)), pa.array(counts[row, bucket])], names=[*keep, "bucket", "n"])

    return asked.mapInArrow(work, f"{_fields(rows, keep)}, bucket int, n bigint")


def vectors_of(rows: DataFrame, text: str, keep: list[str], dimension: int = DIMENSION) -> DataFrame:
    """`keep` columns and `embedding`: the unit vector of the text's hashed bag of tokens; null and wordless texts have zeros."""
    asked = rows.select(*keep, X.tokens(F.coalesce(text, F.lit(""))).alias("_words"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _bags(batch.column("_words"), dimension).astype(np.float64)
            size = np.sqrt((counts * counts).sum(1, keepdims=True))
            unit = np.divide(counts, size, out=np.zeros_like(counts), where=size > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * dimension), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], names=[*keep, "embedding"])

    return asked.mapInArrow(work, f"{_fields(rows, keep)}, embedding array<double>")


# nearest neighbours


def _whole(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _blocks(rows: DataFrame, keep: list[str], group: str | None = None, block: int = BLOCK) -> DataFrame:
    """Rows in blocks of one length, and of one group: a row each, with the `keep` columns as lists and the vectors as bytes."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in keep}
    columns = [*keep, "embedding", *([group] if group else [])]
    schema = ", ".join([*(f"`{c}` array<{t}>" for c, t in kinds.items()), "_size int, _vectors binary", *([f"`{group}` int"] if group else [])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            sizes = np.diff(np.asarray(column.offsets)).astype(np.int64)
            groups = np.asarray(batch.column(group)).astype(np.int64) if group else np.zeros(len(sizes), np.int64)
            for size, of in np.unique(np.stack([sizes, groups], 1), axis=0):
                own = np.flatnonzero((sizes == size) & (groups == of))
                for at in np.array_split(own, -(-len(own) // block)):
                    part = batch.take(pa.array(at))
                    one = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), part.column(c)) for c in keep]
                    cells = [pa.array([size], pa.int32()), pa.array([np.asarray(part.column("embedding").flatten(), np.float64).tobytes()], pa.binary()), *([pa.array([of], pa.int32())] if group else [])]
                    yield pa.RecordBatch.from_arrays([*one, *cells], names=[*keep, "_size", "_vectors", *([group] if group else [])])

    return rows.select(*columns).mapInArrow(work, schema)


def _nearest(pairs: DataFrame, keep: list[str], id_type: str, k: int, threshold: float | None) -> DataFrame:
    """For rows that hold a block of queries and a block of vectors: the k best vectors that each task finds for each query."""
    schema = f"query_id {id_type}, score double, " + ", ".join(f"`{c}` bigint" for c in keep)

    def hits(queries: pa.Array, asked: np.ndarray, found: np.ndarray, ids: list[pa.Array]) -> pa.Table:
        score = np.round(found @ asked.T, 12).T
        by_id = np.lexsort([np.asarray(c) for c in reversed(ids)])
        first = by_id[np.argsort(-score[:, by_id], axis=1, kind="stable")[:, :k]]
        q, s = np.repeat(np.arange(len(queries)), first.shape[1]), np.take_along_axis(score, first, axis=1).ravel()
        ok = np.flatnonzero(np.ones(len(s), bool) if threshold is None else s >= threshold)
        at = pa.array(first.ravel()[ok])
        return pa.table([queries.take(pa.array(q[ok])), pa.array(s[ok]), *(c.take(at) for c in ids)], names=["query_id", "score", *keep])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            for i in range(batch.num_rows):
                size = batch.column("_size")[i].as_py()
                asked, found = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(-1, size) for c in ("_asked", "_vectors"))
                held.append(hits(batch.column("query_id").slice(i, 1).flatten(), asked, found, [batch.column(c).slice(i, 1).flatten() for c in keep]))
                rows += held[-1].num_rows
                if rows > HELD:
                    held = [best_of(pa.concat_tables(held), "query_id", k)]
                    rows = held[0].num_rows
                    if rows > HELD // 2:
                        yield from held.pop().combine_chunks().to_batches()
                        rows = 0
        if held:
            yield from best_of(pa.concat_tables(held), "query_id", k).combine_chunks().to_batches()

    return pairs.select("query_id", "_asked", "_size", "_vectors", *keep).mapInArrow(work, schema)


def _asked(queries: DataFrame) -> DataFrame:
    rows = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("query_id").isNotNull() & _whole(F.col("embedding")))


def _held(vectors: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    rows = vectors.select(*(F.col(c).cast("long").alias(c) for c in keep), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in keep)).where(_whole(F.col("embedding")))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, threshold: float | None = None, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The k best vectors (`keep`, embedding) of each query (query_id, embedding) by their product; unit lengths make it the cosine.

    Queries are a stated set: blocks of them meet blocks of vectors of their length, and a task passes on no more than
    its k best per query. Blocks of queries that take less than BROADCAST_BYTES are broadcast; more are dealt, with the
    vectors, over groups of vectors, each of which gets all queries. `keep` names a vector by whole numbers. Scores are
    rounded to 12 digits, so equal vectors tie, and ties go by `keep`. Rows whose vector is null or empty, or has a null or
    non-finite component, have no score, and neither have vectors of another length than the query's.
    """
    asked, held = _asked(queries), _held(vectors, keep)
    packed = _blocks(asked, ["query_id"]).withColumnRenamed("_vectors", "_asked")
    blocks = _blocks(held, list(keep))
    size = asked.agg(F.sum(F.size("embedding") * 8 + 16)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        pairs = blocks.join(F.broadcast(packed), "_size")
    else:
        groups = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = packed.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        pairs = blocks.withColumn("_group", F.pmod(F.xxhash64(*keep), F.lit(groups)).cast("int")).join(dealt, ["_size", "_group"])
    return ranked(_nearest(pairs, list(keep), asked.schema["query_id"].dataType.simpleString(), k, threshold), "query_id", list(keep), k)


# an inverted file


@dataclass
class InvertedFile:
    """Where the cells' blocks are written, the centroids, the columns that name a vector, and how many cells a query asks."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    keep: tuple[str, ...]
    probes: int


def fitted_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centroids by Lloyd's rounds, from rows of the sample chosen at random; of unit length, as products decide. Empty ones stay."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        own = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centroids = np.divide(sums, size, out=centroids.copy(), where=size > 0)
    return centroids


def enough_probes(sample: np.ndarray, centroids: np.ndarray, recall: float = RECALL, k: int = 5, asked: int = 500) -> int:
    """The least number of cells in which that share of the k nearest is found, for the first vectors of the sample among all of it.

    A sample is sparser than the table, so its nearest vectors lie farther off and in more cells.
    """
    queries = sample[:asked]
    near = np.argsort(-(queries @ sample.T), axis=1)[:, :k]
    product = queries @ centroids.T
    cells = (sample @ centroids.T).argmax(1)[near]
    places = (product[:, None, :] > np.take_along_axis(product, cells, axis=1)[:, :, None]).sum(2)
    return int(np.sort(places.ravel())[int(np.ceil(recall * places.size)) - 1]) + 1


def _with_cells(rows: DataFrame, keep: list[str], centroids: np.ndarray, nearest: int) -> DataFrame:
    """rows with `_cell`: one row for each of the `nearest` cells."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)
    schema = f"{_fields(rows, keep)}, embedding array<double>, _cell int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            x = np.asarray(batch.column("embedding").flatten()).reshape(batch.num_rows, -1)
            product = x @ sent.value.T
            n = min(nearest, product.shape[1])
            cells = np.argpartition(-product, n - 1, axis=1)[:, :n] if n < product.shape[1] else np.tile(np.arange(n), (len(x), 1))
            at = pa.array(np.repeat(np.arange(len(x)), n))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in [*keep, "embedding"]), pa.array(cells.ravel().astype(np.int32))], names=[*keep, "embedding", "_cell"])

    return rows.select(*keep, "embedding").mapInArrow(work, schema)


def build_inverted_file(vectors: DataFrame, path: str, cells: int = 0, keep: tuple[str, ...] = ("vec_id",), sample: int = SAMPLE) -> InvertedFile:
    """Writes every vector of the most frequent length into the cell of its nearest centroid, in blocks, a folder for each cell.

    Centroids are fitted on the `sample` vectors with the least hashes of their names, a bound that does not depend on the
    input; 0 cells means the root of their number, CELLS at most. All vectors with whole numbers for names and finite
    components are indexed. Crowded cells are many blocks: no task gathers a cell.
    """
    held = _held(vectors, keep)
    size = held.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    width = size["size"] if size else 0
    held = held.where(F.size("embedding") == width)
    rows = held.select(F.xxhash64(*keep).alias("h"), "embedding").orderBy("h").limit(sample).collect()
    x = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), width)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    centroids = fitted_centroids(x, min(CELLS, cells or int(np.ceil(np.sqrt(max(1, len(x))))))) if len(x) else np.zeros((0, width))
    placed = _with_cells(held, list(keep), centroids, 1)
    # dealt by cell and a hash of the name, so that a crowded cell is many tasks' work and a cell has few files
    spread = F.pmod(F.xxhash64(*keep), F.lit(4))
    _blocks(placed.repartition("_cell", spread).sortWithinPartitions("_cell"), list(keep), "_cell").write.partitionBy("_cell").parquet(path)
    return InvertedFile(vectors.sparkSession, path, centroids, keep, enough_probes(x, centroids) if len(x) else 1)


def stored_inverted_file(spark: SparkSession, table: str, folder: str | None = None) -> InvertedFile:
    """The inverted file of a table (vec_id, embedding) at a path: read where it is written, else built and kept in `folder`.

    Its name holds a signature of the table's files. It is written beside its place and moved there when it is complete.
    """
    rows = spark.read.parquet(table)
    path = f"{folder or stored.shared_dir(spark)}/cells-v1-{stored.signature(rows)}"
    if not stored.exists(spark, path):
        own = stored.new_path(spark, "cells")
        built = build_inverted_file(rows, f"{own}/blocks")
        spark.createDataFrame([(i, c.tolist(), built.probes) for i, c in enumerate(built.centroids)], "cell int, centroid array<double>, probes int").write.parquet(f"{own}/centroids")
        stored.move(spark, own, path)
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    centroids = np.array([r["centroid"] for r in rows], np.float64) if rows else np.zeros((0, 0))
    return InvertedFile(spark, f"{path}/blocks", centroids, ("vec_id",), rows[0]["probes"] if rows else 1)


def index_topk(index: InvertedFile, queries: DataFrame, k: int = 5, probes: int | None = None, threshold: float | None = None) -> DataFrame:
    """The k best vectors among those in the `probes` cells nearest to each query; with as many probes as cells the result is exact.

    Without a number, the index's own is taken, which reached RECALL on its sample.

    Queries are dealt to the cells they ask and meet those cells' blocks; cells that nobody asks are not read. Queries
    of another length than the indexed vectors find nothing.
    """
    asked = _asked(queries).where(F.size("embedding") == index.centroids.shape[1])
    id_type, keep = asked.schema["query_id"].dataType.simpleString(), list(index.keep)
    if not len(index.centroids):
        return index.spark.createDataFrame([], f"query_id {id_type}, score double, " + ", ".join(f"{c} bigint" for c in keep) + ", result_rank int")
    placed = _with_cells(asked, ["query_id"], index.centroids, probes or index.probes)
    dealt = placed.repartition("_cell", F.pmod(F.xxhash64("query_id"), F.lit(8)))
    packed = _blocks(dealt.sortWithinPartitions("_cell"), ["query_id"], "_cell").withColumnRenamed("_vectors", "_asked").drop("_size")
    blocks = index.spark.read.parquet(index.path)
    return ranked(_nearest(blocks.join(packed, "_cell"), keep, id_type, k, threshold), "query_id", keep, k)
