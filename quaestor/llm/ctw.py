"""Language-model scores by context-tree weighting over bytes, each byte cut into eight binary decisions.

A node of the tree is a context of d bytes, for each place in the decisions of the next byte. Its Krichevsky-Trofimov
estimate needs only how often either bit followed, so nodes are counted over all training texts at once. The weighted
probability of a node is half its own estimate and half the product of its children's, which says how far each depth
from 0 to DEPTH is to be trusted; a text is scored by the mixture over all depths along its contexts, which is the
ratio of the root's weighted probabilities with and without the bit to come.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.tables import bytes_of, in_arrow, quoted, slices, staged

#: Bytes of context. A context and the byte behind it are one number of DEPTH + 1 bytes.
DEPTH = 5
#: Bytes of context that deal a number to a part of the tree. Nodes of fewer are the top of the tree, which the alphabet
#: bounds at 2 ** 24 numbers, whatever the input; a subtree below it holds at most as many.
TOP = 3
#: (context, byte) numbers that a part of the tree is meant to hold, one for TEXT_BYTES bytes of text; parts grow in number with the input.
ENTRIES, TEXT_BYTES = 1_000_000, 16
#: Texts are counted and scored in slices of so many bytes, or so many different numbers.
SLICE_BYTES, SLICE_NUMBERS = 20 << 20, 4_000_000
#: Ranges of numbers that meet their values one after the other.
RANGES = 16
#: Most frequent words whose counts are sent to the workers; all other words meet their counts in a join.
FREQUENT = 1 << 16
#: Bytes that no UTF-8 text holds: before a text's first byte, and behind its last.
BEFORE, END = 0xFE, 0xFF
#: Parts of the tree at least, and distinct words held before they are passed on.
MERGE, HOLD = 64, 300_000


def spread(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end as (context, byte) numbers, which of them are bytes of a text or its end, and where texts begin."""
    pad = bytes([BEFORE]) * depth
    data = np.frombuffer(pad + (bytes([END]) + pad).join(texts) + bytes([END]), np.uint8)
    n = len(data) - depth
    numbers = np.zeros(n, np.uint64)
    for j in range(depth + 1):
        numbers = numbers << np.uint64(8) | data[j : j + n]
    sizes = np.array([len(t) + 1 + depth for t in texts], np.int64)
    return numbers, data[depth:] != BEFORE, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys once, in order, with their counts added."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def added(keys: np.ndarray, counts: np.ndarray, new: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order with their counts, which are changed in place, after others of the kind were added; nothing is sorted again."""
    at = np.searchsorted(keys, new)
    there = at < len(keys)
    there[there] = keys[at[there]] == new[there]
    counts[at[there]] += n[there]
    return np.insert(keys, at[~there], new[~there]), np.insert(counts, at[~there], n[~there])


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, size * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).reshape(-1).view(kind)


def by_part(numbers: np.ndarray, parts: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings numbers of one part together, by part and then as given, and each one's part."""
    part = numbers >> np.uint64(8)
    part &= np.uint64((1 << 8 * min(TOP, depth)) - 1)
    part *= np.uint64(0x9E3779B97F4A7C15)
    part >>= np.uint64(32)
    part %= np.uint64(parts)
    part = part.astype(np.min_scalar_type(parts))  # 16 bits or fewer are sorted by their digits
    return np.argsort(part, kind="stable"), part


def count_texts(docs: DataFrame, depth: int, parts: int) -> DataFrame:
    """Rows with a word's count in some training texts, with one slice's numbers of one part and how often training texts hold them, or with some of its texts, compressed.

    docs: doc_id, _text, and whether the row is a training row. A slice's numbers are those of all its texts.
    """
    ident = docs.schema["doc_id"].dataType.simpleString()
    names = ["word", "n", "slice", "part", "size", "numbers", "counts", "ids", "lengths", "texts"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), None, pa.list_(pa.int32()), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def rows(height: int, /, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(height, t or pa.list_(id_type))) for c, t in zip(names, kinds, strict=True)], names=names)

        def words_out() -> pa.RecordBatch:
            out = pa.table({"word": pa.array(list(words), pa.binary()), "n": pa.array(list(words.values()), pa.int64())}).sort_by("word")  # in order they compress well
            return rows(len(words), **{c: out[c].combine_chunks() for c in out.column_names})

        def numbers_out() -> pa.RecordBatch:
            order, part = by_part(keys, parts, depth)
            dealt = part[order]
            edges = np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1]]))
            spans = [order[i:j] for i, j in zip(edges, [*edges[1:], len(order)], strict=True)]
            return rows(
                len(spans),
                slice=pa.array([place] * len(spans), pa.int64()),
                part=pa.array(dealt[edges].astype(np.int32)),
                size=pa.array(list(map(len, spans)), pa.int32()),
                numbers=pa.array([packed(np.diff(keys[i], prepend=np.uint64(0))) for i in spans], pa.binary()),
                counts=pa.array([packed(counts[i]) for i in spans], pa.binary()),
            )

        words: Counter = Counter()
        place, held = TaskContext.get().partitionId() << 32, 0
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        for whole in batches:
            id_type = whole.column(0).type
            for batch in slices(whole, "_text", 1 << 20):
                texts, training = bytes_of(batch.column(1)).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                for t, learn in zip(texts, training.tolist(), strict=True):
                    if learn:
                        words.update(t.lower().split())
                numbers, real, starts = spread(texts, depth)
                learned = np.repeat(training, np.diff(np.concatenate([starts, [len(numbers)]])))
                for some, once in ((learned, 1), (~learned, 0)):
                    new, n = np.unique(numbers[real & some], return_counts=True)
                    keys, counts = added(keys, counts, new, (n * once).astype(np.uint32))
                ids, sizes = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column(0)), pa.array([list(map(len, texts))], pa.list_(pa.int32()))
                yield rows(1, slice=pa.array([place], pa.int64()), ids=ids, lengths=sizes, texts=pa.array([pa.compress(b"".join(texts), codec="zstd", asbytes=True)], pa.binary()))
                held += sum(map(len, texts))
                if len(words) > HOLD:
                    yield words_out()
                    words.clear()
                if held > SLICE_BYTES or len(keys) > SLICE_NUMBERS:
                    yield numbers_out()
                    place, held, keys, counts = place + 1, 0, keys[:0], counts[:0]
        if id_type is not None:
            yield words_out()
            if len(keys):  # else the last slice has just been passed on
                yield numbers_out()

    return in_arrow(docs, work, f"word binary, n long, slice long, part int, size int, numbers binary, counts binary, ids array<{ident}>, lengths array<int>, texts binary")


class Subtrees:
    """A part of the tree: the nodes of TOP and more bytes of context over some numbers, each decision a tree of its own."""

    def __init__(self, numbers: np.ndarray, counts: np.ndarray, depth: int):
        self.top, self.depth = min(TOP, depth), depth
        self.numbers, self.counts, self.up = {depth: numbers}, {depth: counts}, {}
        for d in range(depth - 1, self.top - 1, -1):
            short = self.numbers[d + 1] & np.uint64((1 << 8 * (d + 1)) - 1)
            self.numbers[d], self.counts[d] = merged(short, self.counts[d + 1])
            self.up[d + 1] = np.searchsorted(self.numbers[d], short)

    def decision(self, k: int) -> tuple[dict, dict, dict, dict, dict, dict, np.ndarray, np.ndarray]:
        """By depth: each number's node, nodes' first numbers, totals, ones, parents and trust; the top nodes' keys and weighted probabilities."""
        of, first, total, ones, own, up, trust = {}, {}, {}, {}, {}, {}, {}
        for d, g in self.numbers.items():
            new = np.diff(g >> np.uint64(8 - k), prepend=~np.uint64(0)) != 0
            of[d], first[d] = np.cumsum(new) - 1, np.flatnonzero(new)
            total[d] = np.add.reduceat(self.counts[d], first[d])
            ones[d] = np.add.reduceat(self.counts[d] * (g >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64), first[d])
            own[d] = kt_of_counts(total[d] - ones[d], ones[d])
        weighted = own[self.depth]
        trust[self.depth] = np.ones(len(weighted))
        for d in range(self.depth - 1, self.top - 1, -1):
            up[d + 1] = of[d][self.up[d + 1][first[d + 1]]]
            weighted, trust[d] = weigh(own[d], np.bincount(up[d + 1], weighted, len(own[d])))
        g = self.numbers[self.top][first[self.top]]
        node = g >> np.uint64(8) << np.uint64(8) | (g & np.uint64(255)) >> np.uint64(8 - k) | np.uint64(1 << k)
        return of, first, total, ones, up, trust, node & np.uint64((1 << 8 * self.top) - 1), weighted

    def for_top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The nodes above: their key, how often they were met, how often by a one, and the weighted probability of those below."""
        out = []
        for k in range(8):
            _, _, total, ones, _, _, node, weighted = self.decision(k)
            key, at = np.unique(node, return_inverse=True)
            out.append((key, *(np.bincount(at, x, len(key)) for x in (total[self.top], ones[self.top], weighted))))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def log10(self, top: Top) -> np.ndarray:
        """Log10 probability of each number's last byte: each decision is mixed over all depths; a node not met says 1/2."""
        sums = np.zeros(len(self.numbers[self.depth]))
        for k in range(8):
            of, _, total, ones, up, trust, node, _ = self.decision(k)
            mixed, rest = top.of(node)
            for d in range(self.top, self.depth + 1):
                if d > self.top:
                    mixed, rest = mixed[up[d]], rest[up[d]]
                estimate = (ones[d] + 0.5) / (total[d] + 1)
                mixed, rest = mixed + rest * trust[d] * estimate, rest * (1 - trust[d])
            p = np.clip(mixed, 1e-12, 1 - 1e-12)[of[self.depth]]
            sums += np.log10(np.where(self.numbers[self.depth] >> np.uint64(7 - k) & np.uint64(1), p, 1 - p))
        return sums


@dataclass
class Top:
    """What nodes of TOP - 1 bytes hand down: the sum mixed so far, and the share left to those below."""

    nodes: np.ndarray
    mixed: np.ndarray
    rest: np.ndarray

    @classmethod
    def build(cls, nodes: np.ndarray, total: np.ndarray, ones: np.ndarray, below: np.ndarray, depth: int) -> Top:
        """From the lowest nodes of the top, in order, each once."""
        levels, ups = [(nodes, total, ones)], []
        for d in range(depth - 1, -1, -1):
            node, at = np.unique(levels[0][0] & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
            levels.insert(0, (node, *(np.bincount(at, x, len(node)) for x in levels[0][1:])))
            ups.insert(0, at)
        trust: list[np.ndarray] = [np.zeros(0)] * (depth + 1)
        for d in range(depth, -1, -1):
            _, n, hits = levels[d]
            weighted, trust[d] = weigh(kt_of_counts((n - hits).astype(np.int64), hits.astype(np.int64)), below)
            below = np.bincount(ups[d - 1], weighted, len(levels[d - 1][0])) if d else below
        size = len(levels[0][0])
        mixed, rest = np.zeros(size), np.ones(size)
        for d, (_, n, hits) in enumerate(levels):
            if d:
                mixed, rest = mixed[ups[d - 1]], rest[ups[d - 1]]
            mixed, rest = mixed + rest * trust[d] * (hits + 0.5) / (n + 1), rest * (1 - trust[d])
        return cls(nodes, mixed, rest)

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.nodes, nodes)
        return self.mixed[at], self.rest[at]


def number_values(counts: DataFrame, depth: int, parts: int) -> DataFrame:
    """(slice, part, size, scores): for each slice its numbers' log10 probabilities, in their order, packed.

    Each part of the tree is built twice where its numbers meet: for the top, which needs all parts, and with the top at hand.
    """
    spark = counts.sparkSession
    dealt = counts.where("part IS NOT NULL").select("slice", "part", "size", "numbers", "counts").repartition(parts, "part")

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Subtrees, int, list[tuple[int, np.ndarray]]]]:
        held: dict[int, list] = {}
        for batch in batches:
            for place, part, size, numbers, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                held.setdefault(part, []).append((place, size, numbers, n))
        for part in list(held):
            blobs = held.pop(part)
            keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for at in range(0, len(blobs), 16):
                some = blobs[at : at + 16]
                new = [np.cumsum(unpacked(b[2], b[1], np.uint64), dtype=np.uint64) for b in some]
                keys, n = merged(np.concatenate([keys, *new]), np.concatenate([n, *(unpacked(b[3], b[1], np.uint32).astype(np.int64) for b in some)]))
            yield Subtrees(keys, n, depth), part, blobs

    def upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, _, _ in subtrees(batches):
            node, *sums = tree.for_top()
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *map(pa.array, sums)], names=["node", "total", "ones", "below"])

    sums = in_arrow(dealt, upward, "node long, total double, ones double, below double").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("total", "ones", "below")))
    lowest = sums.toArrow().sort_by("node")
    nodes, total, ones, below = (lowest[c].to_numpy() for c in ("node", "total", "ones", "below"))
    sent = spark.sparkContext.broadcast(Top.build(nodes.astype(np.uint64), total, ones, below, min(TOP, depth) - 1))

    def downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, part, blobs in subtrees(batches):
            values = tree.log10(sent.value).astype(np.float32)
            for place, size, numbers, _ in blobs:
                at = np.searchsorted(tree.numbers[depth], np.cumsum(unpacked(numbers, size, np.uint64), dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([part], pa.int32()), pa.array([size], pa.int32()), pa.array([packed(values[at])], pa.binary())], names=["slice", "part", "size", "scores"])

    return in_arrow(dealt, downward, "slice long, part int, size int, scores binary")


def text_scores(groups: list[list[bytes]], scores: list[tuple[int, np.ndarray]], depth: int, parts: int, ranges: int = RANGES) -> list[np.ndarray]:
    """Log10 probabilities of a slice's texts, ends included, from those of its numbers, in order, by part.

    Numbers meet their values range by range: held is a place and a value for each group's numbers, never all of the slice in one array.
    """
    seen = []
    for texts in groups:
        numbers, real, _ = spread(texts, depth)
        own, at = np.unique(numbers[real], return_inverse=True)
        seen.append((own, at.astype(np.int32), np.empty(len(own), np.float32)))
    longest = max((own for own, *_ in seen), key=len)
    pivots = np.unique(longest[:: max(1, len(longest) // ranges)])[1:]
    cuts = [[0, *np.searchsorted(own, pivots).tolist(), len(own)] for own, *_ in seen]
    values, ready = np.concatenate([v for _, v in scores]), np.zeros(parts, np.int64)
    ready[[part for part, _ in scores]] = np.cumsum([0, *(len(v) for _, v in scores)])[:-1]
    for r in range(len(pivots) + 1):
        keys = np.unique(np.concatenate([own[c[r] : c[r + 1]] for (own, *_), c in zip(seen, cuts, strict=True)]))
        order, part = by_part(keys, parts, depth)
        n = np.bincount(part, minlength=parts)
        some = np.empty(len(keys), np.float32)
        some[order] = values[np.arange(len(keys)) + np.repeat(ready - (np.cumsum(n) - n), n)]
        ready += n
        for (own, _, found), c in zip(seen, cuts, strict=True):
            found[c[r] : c[r + 1]] = some[np.searchsorted(keys, own[c[r] : c[r + 1]])]
    out = []
    for texts, (_, at, found) in zip(groups, seen, strict=True):
        out.append(np.add.reduceat(found[at].astype(float), np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]))
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of x > 0 by Stirling's series, after x was raised by 8."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def kt_log_probability(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


#: ln Gamma of n + 1/2 and of n + 1.
HALVES, WHOLES = log_gamma(np.arange(1 << 14) + 0.5), log_gamma(np.arange(1 << 14) + 1.0)


def kt_of_counts(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """kt_log_probability() of whole numbers, from tables where they are small; exactly 0 where nothing was met."""
    total = zeros + ones
    few = total < len(WHOLES)
    z, o, t = (np.where(few, x, 0) for x in (zeros, ones, total))
    out = np.where(t > 0, HALVES[z] + HALVES[o] - np.log(np.pi) - WHOLES[t], 0)
    if not few.all():
        out[~few] = kt_log_probability(zeros[~few].astype(float), ones[~few].astype(float))
    return out


def weigh(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted log probability of nodes, and the share of it that is their own."""
    weighted = np.logaddexp(own, below) + np.log(0.5)
    return weighted, np.exp(np.minimum(own + np.log(0.5) - weighted, 0))


def is_held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds == fold


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, frequent: int = FREQUENT, entries: int = ENTRIES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    score is the context tree's log10 probability of the whole text and its end; base_score that of add-one counts of
    lower-cased words and one end. Both learn from all rows that are not held out; null ids are not. A null text counts
    as empty: one token, its end. Rows with equal ids are scored each for itself. Without training rows every decision
    is even, and every word's base is 1. No context is left out: the tree is dealt by context over parts of about
    `entries` numbers, whose number grows with the input. A slice of texts sends its distinct numbers to them and gets
    their probabilities back, where it meets its texts again. What leaves the executors is bounded: the top of the
    tree, the counts of the `frequent` most frequent words, sums. Other words join their counts, from which no word has
    a large share.
    """
    spark = docs.sparkSession
    ident, body = F.col(quoted(doc_id)), F.col(quoted(text))
    rows = docs.select(ident.alias("doc_id"), body.alias("_text"), (~is_held_out(ident)).alias("training"))
    size, trained = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)), F.count_if("training")).first()
    parts = max(MERGE, -(-size // (TEXT_BYTES * entries)))
    counts = staged(count_texts(rows, depth, parts), "counts", "zstd")
    vocabulary = staged(counts.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")), "vocabulary", "zstd")
    words, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = {bytes(r["word"]): r["c"] for r in vocabulary.orderBy(F.desc("c"), "word").limit(frequent).collect()}
    all_tokens, all_kinds = words + trained, distinct + (trained > 0)
    sent = spark.sparkContext.broadcast({w: float(np.log10(c + 1)) for w, c in top.items()})
    kind = rows.schema["doc_id"].dataType.simpleString()
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ids", f"array<{kind}>"), ("lengths", "array<int>"), ("texts", "binary"))]
    values = number_values(counts, depth, parts).select("slice", "part", "size", "scores", *none)
    texts = counts.where("texts IS NOT NULL").select("slice", *(F.lit(None).cast(t).alias(c) for c, t in (("part", "int"), ("size", "int"), ("scores", "binary"))), "ids", "lengths", "texts")
    met = values.unionByName(texts).repartition(parts, "slice").sortWithinPartitions("slice", F.col("part").asc_nulls_last())

    def scored_slice(scores: list[tuple[int, np.ndarray]], groups: list[tuple[pa.Array, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        found_scores = text_scores([t for _, t in groups], scores, depth, parts)
        for (ids, texts), score in zip(groups, found_scores, strict=True):
            tokens, known, sums, rare, times = [], [], [], [], []
            for t in texts:
                found = Counter(t.lower().split())
                own_rare, own_times, total, n = [], [], 0.0, 0
                for w, k in found.items():
                    value = get(w)
                    if value is None:
                        own_rare.append(w)
                        own_times.append(k)
                    else:
                        total += k * value
                        n += k
                tokens.append(n + sum(own_times) + 1)
                known.append(n)
                sums.append(total)
                rare.append(own_rare)
                times.append(own_times)
            columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(sums), pa.array(score), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_bytes", "n_tokens", "known", "sums", "score", "rare", "times"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scores, groups = None, [], []
        for whole in batches:
            place = whole.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)] if len(place) else []
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if now is not None and now != place[begin]:
                    yield from scored_slice(scores, groups)
                    scores, groups = [], []
                now, run = place[begin], whole.slice(begin, end - begin)
                scores += [(p, unpacked(x, n, np.float32)) for p, n, x in zip(*(run.column(i).drop_null().to_pylist() for i in (1, 2, 3)), strict=True)]
                for i in np.flatnonzero(run.column(6).is_valid().to_numpy(zero_copy_only=False)).tolist():
                    ends = np.cumsum([0, *run.column(5)[i].as_py()]).tolist()
                    data = pa.decompress(run.column(6)[i].as_py(), ends[-1], codec="zstd", asbytes=True)
                    groups.append((run.column(4)[i].values, [data[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]))
        if groups:
            yield from scored_slice(scores, groups)

    scored = in_arrow(met, work, f"doc_id {kind}, n_bytes long, n_tokens long, known long, sums double, score double, rare array<binary>, times array<int>")
    scored = staged(scored.withColumn("row", F.monotonically_increasing_id()), "scored", "zstd")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("k"))
    joined = rare.join(vocabulary, "word").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more"), F.sum("k").alias("more_known"))
    out = scored.drop("rare", "times").join(joined, "row", "left")
    base = F.col("sums") + F.coalesce("more", F.lit(0.0)) + float(np.log10(trained + 1)) - F.col("n_tokens") * float(np.log10(all_tokens + all_kinds + 1))
    n_known = F.col("known") + F.coalesce("more_known", F.lit(0)) + int(trained > 0)
    bits = -F.col("score") / float(np.log10(2)) / F.greatest(F.col("n_bytes"), F.lit(1))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_bytes", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(int(all_tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))
