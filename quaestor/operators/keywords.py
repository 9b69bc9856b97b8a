"""Keyword retrieval over a stored inverted index: ranges of chunks, each a row with its postings by token, bounds, exact scores where a bound allows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text as X
from quaestor.operators.chunking import chunks as cut
from quaestor.operators.ranking import ranked
from quaestor.sources import stored

TOP_K, THRESHOLD = 5, 0.05
#: Chunks of a range: at most 255, as places and numbers of chunks are bytes.
RANGE = 64
#: Bytes of a row group of the index, which is what a task holds of it at once.
ROW_GROUP = 8 << 20
#: Part of a stored index's name: to be raised when what is written changes its meaning.
LAYOUT = f"v2-{RANGE}"
#: Ranges of each query that are scored first, to know what the k-th best reaches at least.
SEEDS = 4
#: Queries that are scored together in a range, and tokens of queries that are sent to the workers for one pass.
QUERIES, BROADCAST = 256, 200_000
#: Added to bounds against rounding.
SLACK = 1 + 1e-9
IDS = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


@dataclass
class Metric:
    """How a chunk is scored: the sum over the query's tokens of weight times impact, over the query's number of tokens where it is a `share`.

    weight: of a token, from its document frequency and the number of chunks. impact: of a token in a chunk that holds it tf
    times and has `length` tokens; it grows with tf and falls with length, so the highest tf and least length of a range bound it.
    corpus: whether totals and document frequencies are needed.
    """

    weight: Callable[[np.ndarray, int], np.ndarray]
    impact: Callable[[np.ndarray, np.ndarray, float], np.ndarray]
    share: bool
    corpus: bool


K1, B = 1.2, 0.75
#: Metrics by the name that `similarity_metric` has.
METRICS = {
    # the share of the query's distinct tokens that the chunk holds
    "keyword": Metric(lambda df, n_chunks: np.ones(len(df)), lambda tf, length, mean: np.ones(len(tf)), True, False),
    "bm25": Metric(lambda df, n_chunks: np.log(1 + (n_chunks - df + 0.5) / (df + 0.5)), lambda tf, length, mean: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)), False, True),
}

#: Columns of a range's postings: its tokens in order, parted by blanks; of each token the number of its chunks, the highest tf and the
#: least length there; of each posting, token by token, the chunk's place and tf; of each chunk its length.
POSTINGS = "words string, counts binary, top_tfs binary, least_lengths binary, places binary, tfs binary, lengths binary"


@dataclass
class Index:
    """A written index: a row for each range of chunks, with its number, its chunks' names, n_chunks, total_tokens and POSTINGS."""

    spark: SparkSession
    path: str
    tie: tuple[str, ...]

    @cached_property
    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/ranges")

    @cached_property
    def ranges(self) -> DataFrame:
        return self.lists.select("range", *self.tie, "total_tokens", "n_chunks")

    @cached_property
    def postings(self) -> DataFrame:
        """(token, range, n), a row for each token of a range."""
        each = self.lists.where("words <> ''").select("range", "counts", F.posexplode(F.split("words", " ")).alias("at", "token"))
        return each.select("token", "range", F.conv(F.hex(F.substring("counts", F.col("at") + 1, F.lit(1))), 16, 10).cast("int").alias("n"))


def _cells(values: np.ndarray, ends: np.ndarray, kind: type) -> pa.Array:
    """Numbers end to end as binary values that end at the places `ends`."""
    data = values.astype(kind)
    at = (np.concatenate([[0], ends]) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(data.tobytes())])


def _ranges(batch: pa.RecordBatch, tie: list[str], first: int) -> pa.RecordBatch:
    """A batch's chunks in ranges that are numbered from `first`, a row each."""
    n = batch.num_rows
    order = pc.sort_indices(pa.table({**{f"t{i}": batch.column(c) for i, c in enumerate(tie)}, "range": pa.array(np.arange(n) // RANGE)}), sort_keys=[("range", "ascending"), *((f"t{i}", "ascending") for i in range(len(tie)))], null_placement="at_start")
    listed = batch.column("_words").take(order)
    length = np.diff(np.asarray(listed.offsets)).astype(np.int64)
    coded = listed.flatten().dictionary_encode()
    sorted_words = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(sorted_words), np.int64)
    rank[np.asarray(sorted_words)] = np.arange(len(rank))
    row, size = np.repeat(np.arange(n), length), max(1, len(rank))
    # a posting's key is its range, token and place
    key, tf = np.unique(((row // RANGE) * size + rank[np.asarray(coded.indices)]) * RANGE + row % RANGE, return_counts=True)
    place, term = key % RANGE, key // RANGE
    start = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(key) else np.zeros(0, np.int64)
    own, n_ranges = term[start] // size, -(-n // RANGE)
    by = lambda f, v: f.reduceat(v, start) if len(start) else start
    word_ends, posting_ends = np.searchsorted(own, np.arange(n_ranges), side="right"), np.searchsorted(term // size, np.arange(n_ranges), side="right")
    words = coded.dictionary.take(sorted_words).take(pa.array(term[start] % size))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, word_ends).astype(np.int32)), words), " ")
    begins, ends = np.arange(0, n, RANGE), np.minimum(np.arange(RANGE, n + RANGE, RANGE), n)
    at = pa.array(np.append(0, ends).astype(np.int32))
    held = length[(term // size) * RANGE + place]
    columns = {
        "range": pa.array(np.arange(n_ranges) + first),
        **{c: pa.ListArray.from_arrays(at, batch.column(c).take(order)) for c in tie},
        "total_tokens": pa.array(np.add.reduceat(length, begins)),
        "n_chunks": pa.array(ends - begins),
        "words": joined,
        "counts": _cells(np.diff(np.append(start, len(key))), word_ends, np.uint8),
        "top_tfs": _cells(by(np.maximum, tf), word_ends, np.uint32),
        "least_lengths": _cells(by(np.minimum, held), word_ends, np.uint32),
        "places": _cells(place, posting_ends, np.uint8),
        "tfs": _cells(tf, posting_ends, np.uint32),
        "lengths": _cells(length, ends, np.uint32),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def build_index(chunks: DataFrame, path: str, tie: tuple[str, ...] = ("doc_id", "chunk_index")) -> Index:
    """Writes the index of chunks (`tie` columns, content) to `path`.

    Each task packs its chunks in ranges and writes them: a range is a row with all postings of its chunks, so nothing is
    shuffled, and a token that all chunks hold is in as many rows as there are ranges. Chunks without tokens have no postings.
    """
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in tie}
    fields = ", ".join(["range bigint", *(f"{c} array<{t}>" for c, t in kinds.items()), "total_tokens bigint", "n_chunks bigint", POSTINGS])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_range = TaskContext.get().partitionId() << 32
        for batch in (b for b in batches if b.num_rows):
            made = _ranges(batch, list(tie), next_range)
            next_range += made.num_rows
            yield made

    packed = chunks.select(*tie, X.tokens(F.col("content")).alias("_words")).mapInArrow(work, fields)
    packed.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(f"{path}/ranges")
    return Index(chunks.sparkSession, path, tie)


def stored_index(spark: SparkSession, table: str, strategy: str = "fixed_1200_150", folder: str | None = None) -> Index:
    """The index of a table of documents (doc_id, text) at a path, cut by `strategy`: read where it is written, else built and kept in `folder`.

    Its name holds the strategy, the index's own layout and a signature of the table's files, so a table that changed gets another index. It is written
    beside its place and moved there when it is complete.
    """
    docs = spark.read.parquet(table)
    path = f"{folder or stored.shared_dir(spark)}/index-{strategy}-{LAYOUT}-{stored.signature(docs)}"
    if not stored.exists(spark, path):
        own = stored.new_path(spark, "index")
        build_index(cut(docs.select("doc_id", "text"), strategy), own)
        stored.move(spark, own, path)
    return Index(spark, path, ("doc_id", "chunk_index"))


@dataclass
class Terms:
    """What is asked in one pass, by query and token: the queries' ids, divisors and floors, the distinct tokens, and for each term its query, token and weight."""

    ids: pa.Array
    divisor: np.ndarray
    floor: np.ndarray
    words: pa.Array
    query: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    metric: str
    mean: float = 1.0


def search(index: Index, queries: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD, metric: str = "keyword", query: str = "item_id", query_text: str = "text") -> DataFrame:
    """The k best chunks of each query by a metric's score, at least `threshold`: the query, score, the chunk's names and result_rank.

    First a range's bound: what a chunk that had all of the query's tokens there, as often as any, would reach; this reads
    no postings, only their heads. Then SEEDS ranges of each query, those with the highest bounds, are scored; the k-th best of
    these is the query's floor, and only ranges whose bound reaches a floor are scored. A chunk that belongs to the result lies
    in one of them, so nothing is lost. A range is scored where it is read, and a task passes on k rows for each query, so no postings are shuffled.

    Queries stay a table, whose tokens go to the workers in passes of about BROADCAST. Ties go by
    the chunk's names. Ids are text or whole numbers; queries without an id or without tokens find nothing.
    """
    id_type = queries.schema[query].dataType.simpleString()
    if id_type not in IDS:
        raise ValueError(f"a query's id is text or a whole number, not {id_type}")
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}; there are {', '.join(METRICS)}")
    words = queries.where(F.col(query).isNotNull()).select(F.col(query).alias("_query"), X.token_set(F.col(query_text)).alias("_words"))
    asked = stored.staged(words.select("_query", F.size("_words").alias("_tokens"), F.explode("_words").alias("token")), "asked")
    passes = -(-asked.count() // BROADCAST) or 1
    found = [_passed(index, asked.where(F.pmod(F.xxhash64("_query"), F.lit(passes)) == i), k, threshold, metric, id_type) for i in range(passes)]
    hits = found[0] if passes == 1 else reduce(DataFrame.unionByName, (stored.staged(h, "hits") for h in found))
    return ranked(hits, "_query", list(index.tie), k).select(F.col("_query").alias(query), "score", *index.tie, "result_rank")


def _passed(index: Index, asked: DataFrame, k: int, threshold: float, metric: str, id_type: str) -> DataFrame:
    """The best chunks of the queries of one pass."""
    terms = _terms(asked, metric, threshold, id_type)
    if METRICS[metric].corpus:
        total = index.ranges.agg(F.sum("n_chunks"), F.sum("total_tokens")).first()
        mean = (total[1] or 0) / max(1, total[0] or 0) or 1.0
        terms = replace(terms, mean=mean, weight=METRICS[metric].weight(_frequencies(index, terms), total[0] or 0)[terms.word])
    seeds = stored.staged(ranked(_bounds(index, terms, SEEDS), "query", ["range"], SEEDS, "bound").select("range").distinct(), "seeds")
    first = _scored(index, terms, METRICS[metric], k, id_type, terms.mean, wanted=seeds)
    best = first.groupBy("_query").agg(F.sort_array(F.collect_list("score"), asc=False).alias("best")).where(F.size("best") >= k).select("_query", F.get("best", F.lit(k - 1)).alias("kth")).toArrow()
    floor = terms.floor.copy()
    at = np.asarray(pc.index_in(best["_query"].combine_chunks(), value_set=terms.ids)).astype(np.int64)
    floor[at] = np.maximum(floor[at], best["kth"].to_numpy())
    terms = replace(terms, floor=floor)
    return _scored(index, terms, METRICS[metric], k, id_type, terms.mean, _bounds(index, terms))


def _terms(asked: DataFrame, metric: str, threshold: float, id_type: str) -> Terms:
    """What is asked, ordered by query and token."""
    rows = asked.select("_query", "token", "_tokens").toArrow().combine_chunks()
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("_query", "ascending"), ("token", "ascending")]))
    ids, words = (pc.unique(rows[c]) for c in ("_query", "token"))
    query, word = (np.asarray(pc.index_in(rows[c], value_set=v)).astype(np.int64) for c, v in (("_query", ids), ("token", words)))
    divisor = np.ones(len(ids))
    if METRICS[metric].share:
        divisor[query] = rows["_tokens"].to_numpy()
    return Terms(ids.cast(IDS[id_type]), divisor, np.full(len(ids), threshold, np.float64), words, query, word, np.ones(len(query)), metric)


def _named(batch: pa.RecordBatch, words: pa.Array) -> list[np.ndarray]:
    """For each range of a batch the places, among `words`, of its tokens; -1 for others."""
    column = batch.column("words")
    listed = pc.split_pattern(pc.if_else(pc.equal(column, ""), None, column), pattern=" ")
    at = np.asarray(pc.fill_null(pc.index_in(listed.flatten(), value_set=words), -1)).astype(np.int64)
    return np.split(at, np.cumsum(pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False))[:-1])


def _numbers(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind).astype(np.int64)


def _placed(names: np.ndarray, terms: Terms) -> np.ndarray:
    """For each term its token's place in a range; -1 where the range does not have it."""
    at = np.full(len(terms.words), -1, np.int64)
    held = np.flatnonzero(names >= 0)
    at[names[held]] = held
    return at[terms.word]


def _reached(batch: pa.RecordBatch, i: int, place: np.ndarray, terms: Terms) -> np.ndarray:
    """For each query the bound of what a chunk of a range can score; 0 where the range has none of its tokens."""
    here = np.flatnonzero(place >= 0)
    top, least = (_numbers(batch.column(c)[i], np.uint32)[place[here]] for c in ("top_tfs", "least_lengths"))
    impact = METRICS[terms.metric].impact(top.astype(np.float64), least.astype(np.float64), terms.mean)
    return np.bincount(terms.query[here], terms.weight[here] * impact, len(terms.ids)) / terms.divisor


def _frequencies(index: Index, terms: Terms) -> np.ndarray:
    """The number of chunks that hold each of the tokens asked for."""
    sent = index.spark.sparkContext.broadcast(terms.words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for i, names in enumerate(_named(batch, sent.value)):
                held = names >= 0
                df[names[held]] += _numbers(batch.column("counts")[i], np.uint8)[held]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["word", "df"])

    rows = index.lists.select("words", "counts").mapInArrow(work, "word bigint, df bigint").groupBy("word").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(terms.words), np.int64)
    out[rows["word"].to_numpy()] = rows["df"].to_numpy()
    return out


def _bounds(index: Index, terms: Terms, best: int | None = None) -> DataFrame:
    """The ranges (range) whose bound reaches the floor of some query; with `best` each query's (query, range, bound), of every task the so many highest."""
    sent = index.spark.sparkContext.broadcast(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, kept = sent.value, None
        for batch in (b for b in batches if b.num_rows):
            ranges, held = batch.column("range").to_numpy(), []
            for i, names in enumerate(_named(batch, terms.words)):
                bound = _reached(batch, i, _placed(names, terms), terms)
                some = np.flatnonzero((bound > 0) & (bound * SLACK >= terms.floor))
                held.append((some, np.full(len(some), ranges[i]), bound[some]))
            query, of, bound = (np.concatenate(x) for x in zip(*held, strict=True))
            if best is None:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(of))], names=["range"])
            else:
                rows = pa.table({"query": pa.array(query), "range": pa.array(of), "score": pa.array(bound)})
                kept = _best(rows if kept is None else pa.concat_tables([kept, rows]), "query", ["range"], best)
        if kept is not None:
            yield from kept.rename_columns(["query", "range", "bound"]).combine_chunks().to_batches()

    return index.lists.select("range", "words", "top_tfs", "least_lengths").mapInArrow(work, "range bigint" if best is None else "query bigint, range bigint, bound double")


def _best(rows: pa.Table, query: str, tie: list[str], k: int) -> pa.Table:
    """The k best rows of each query by score, then by `tie`; ordered."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(query, "ascending"), ("score", "descending"), *((c, "ascending") for c in tie)], null_placement="at_start"))
    q = rows[query].to_numpy()
    return rows.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q, side="left") < k))


def _scored(index: Index, terms: Terms, metric: Metric, k: int, id_type: str, mean: float, wanted: DataFrame | None = None) -> DataFrame:
    """(_query, score, the chunk's names): the chunks of the ranges `wanted` that reach a query's floor, of every task the k best of each query.

    A range is scored by the task that reads it. What a task has found so far raises its floors.
    """
    sent, tie = index.spark.sparkContext.broadcast(terms), list(index.tie)
    kinds = {f.name: f.dataType.elementType.simpleString() for f in index.lists.schema if f.name in tie}

    def of_range(batch: pa.RecordBatch, i: int, names: np.ndarray, terms: Terms, floor: np.ndarray) -> tuple[np.ndarray, ...]:
        """The queries, places and scores of the k best chunks of a range for each query that can reach its floor there."""
        place = _placed(names, terms)
        can = _reached(batch, i, place, terms) * SLACK >= floor
        here = np.flatnonzero((place >= 0) & can[terms.query])
        counts, places = (_numbers(batch.column(c)[i], np.uint8) for c in ("counts", "places"))
        start, worth = np.cumsum(counts) - counts, None
        if metric.corpus:
            lengths = _numbers(batch.column("lengths")[i], np.uint32)[places]
            worth = metric.impact(_numbers(batch.column("tfs")[i], np.uint32).astype(np.float64), lengths.astype(np.float64), mean)
        out = []
        for at in range(0, len(terms.ids), QUERIES):
            own = here[np.searchsorted(terms.query[here], at) : np.searchsorted(terms.query[here], at + QUERIES)]
            if not len(own):
                continue
            # every term with every posting of its token
            n = counts[place[own]]
            of = np.repeat(np.arange(len(own)), n)
            posting = np.arange(len(of)) + np.repeat(start[place[own]] - (np.cumsum(n) - n), n)
            weight = terms.weight[own][of] if worth is None else terms.weight[own][of] * worth[posting]
            total = np.bincount((terms.query[own] - at)[of] * RANGE + places[posting], weight, QUERIES * RANGE).reshape(QUERIES, RANGE)[: len(terms.ids) - at]
            upto = slice(at, at + QUERIES)
            score = np.round(total / terms.divisor[upto][:, None], 12)
            score[(total == 0) | (score < floor[upto][:, None])] = -1
            some = np.flatnonzero(score.max(1) >= 0)
            order = np.argsort(-score[some], axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(score[some], order, axis=1)
            g, c = np.nonzero(best >= 0)
            out.append((some[g] + at, order[g, c], best[g, c]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, kept = sent.value, None
        floor = terms.floor.copy()
        for batch in (b for b in batches if b.num_rows):
            begin = np.asarray(batch.column(tie[0]).offsets)[:-1] - batch.column(tie[0]).offsets[0].as_py()
            found = []
            for i, names in enumerate(_named(batch, terms.words)):
                query, place, score = of_range(batch, i, names, terms, floor)
                found.append((query, place + begin[i], score))
            query, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
            rows = pa.table({"_query": pa.array(query), "score": pa.array(score), **{c: batch.column(c).flatten().take(pa.array(at)) for c in tie}})
            kept = _best(rows if kept is None else pa.concat_tables([kept, rows]), "_query", tie, k)
            q = kept["_query"].to_numpy()
            full = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q, side="left") == k - 1)
            floor[q[full]] = np.maximum(floor[q[full]], kept["score"].to_numpy()[full])
        if kept is not None and kept.num_rows:
            named = kept.set_column(0, "_query", terms.ids.take(kept["_query"].combine_chunks()))
            yield from named.combine_chunks().to_batches()

    columns = ["range", *tie, *(c.split()[0] for c in POSTINGS.split(", ") if metric.corpus or c.split()[0] not in ("tfs", "lengths"))]
    rows = index.lists if wanted is None else index.lists.join(F.broadcast(wanted), "range", "left_semi")
    return rows.select(*columns).mapInArrow(work, ", ".join([f"_query {id_type}, score double", *(f"{c} {kinds[c]}" for c in tie)]))


def keyword_topk(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD, query: str = "item_id", query_text: str = "text", tie: tuple[str, ...] = ("doc_id", "chunk_index"), metric: str = "keyword") -> DataFrame:
    """search() over an index of these chunks, built for this call."""
    return search(build_index(chunks, stored.new_path(chunks.sparkSession, "index"), tie), queries, k, threshold, metric, query, query_text)
