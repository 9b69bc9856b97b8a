"""Benchmark decontamination by an FM-index for each training shard.

A shard's words become numbers, those that no benchmark phrase holds become gaps. Phrases are found by backward search
through the ranks of a wavelet tree, their places by sampled suffix positions, and their spans are merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.tables import bytes_of, gathered, in_arrow, no_clash, quoted

WINDOW = 10
#: Bytes of text in a shard, and words between sampled suffix positions.
SHARD_BYTES, SAMPLE = 4 << 20, 8
#: Benchmark text, in bytes, that is compiled into one block. A larger benchmark is searched in several blocks.
BLOCK_BYTES = 32 << 20

#: Bytes to lower case, and all that is no word byte (0-9, a-z, from 0x80) to a space.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Bits:
    """A plane of bits in 64-bit words, with the number of ones before each word."""

    def __init__(self, plane: np.ndarray):
        packed = np.packbits(plane, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def at(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class WaveletTree:
    """A sequence of numbers as planes of bits, the highest first, each stably sorted by the bits above it; ranks by counting."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.planes, self.zeros = bits, [], []
        rest = symbols.astype(np.int32)
        for level in range(bits - 1, -1, -1):
            plane = (rest >> level & 1).astype(bool)
            self.planes.append(Bits(plane))
            self.zeros.append(int(len(plane) - plane.sum()))
            rest = np.concatenate([rest[~plane], rest[plane]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] occurs before place at[i]."""
        begin, end = np.zeros_like(at), at
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            low, high = plane.ones(begin), plane.ones(end)
            begin = np.where(one, zeros + low, begin - low)
            end = np.where(one, zeros + high, end - high)
        return end - begin

    def at(self, place: np.ndarray) -> np.ndarray:
        """The symbols at the given places."""
        out = np.zeros_like(place)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            one = plane.at(place)
            out = out << 1 | one
            before = plane.ones(place)
            place = np.where(one == 1, zeros + before, place - before)
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence in order, by doubling the number of symbols that ranks stand for until no two are equal.

    The first ranks stand for as many symbols as fit into 62 bits.
    """
    n, bits = len(symbols), int(symbols.max()).bit_length() + 1
    rank, width = np.zeros(n, np.int64), max(1, 62 // bits)
    for k in range(width):
        rank <<= bits
        rank[: max(0, n - k)] |= symbols[k:] + 1  # 0: behind the end
    while True:
        order = np.argsort(rank)
        rank = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(rank[1:] != rank[:-1])]) + 1
        if width >= n or new.max() == n:
            return order
        rank = new * (n + 2)
        rank[: n - width] += new[width:]
        width *= 2


class FMIndex:
    """Backward search over a sequence of numbers from 1 on. 0 is a gap, which no phrase holds.

    Suffix positions are sampled by text position, so a walk back to a sampled one ends within SAMPLE steps.
    """

    def __init__(self, symbols: np.ndarray, top: int):
        text = np.concatenate([symbols + 1, [0]]).astype(np.int64)  # an end of its own, below gaps and words
        order = suffix_array(text)
        self.tree = WaveletTree(text[order - 1], int(top + 1).bit_length())
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 2))]).astype(np.int64)
        self.size = len(text)
        self.sampled = order % SAMPLE == 0
        self.before = np.concatenate([[0], np.cumsum(self.sampled, dtype=np.int32)])
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The run [low, high) of suffixes that begin with each phrase; phrases are rows, filled up at the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        width = phrases.shape[1] if len(phrases) else 0
        for k in range(width):
            live = np.flatnonzero((k < lengths) & (high > low))
            symbol = phrases[live, width - 1 - k] + 1
            low[live] = self.starts[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.starts[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: each steps back until it meets a sampled one."""
        rows, steps, out = rows.copy(), 0, np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            here = rows[left]
            done = self.sampled[here]
            out[left[done]] = self.samples[self.before[here[done]]] + steps
            left = left[~done]
            symbol = self.tree.at(rows[left])
            rows[left] = self.starts[symbol] + self.tree.rank(symbol, rows[left])
            steps += 1
        return out


@dataclass
class Phrases:
    """A block of the benchmark: its words by number, its distinct windows, and the items that each window belongs to."""

    numbers: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    item_at: np.ndarray
    items: np.ndarray
    names: list[str]

    @classmethod
    def compile(cls, rows: list[tuple[object, bytes]], window: int = WINDOW) -> Phrases:
        numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        names = sorted({str(k) for k, _ in rows if k is not None})
        place = {n: i for i, n in enumerate(names)}
        for key, text in rows:
            ids = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).update([place[str(key)]] if key is not None else [])
        phrases = list(owners)
        filled = np.array([[0] * (window - len(p)) + list(p) for p in phrases], np.int64).reshape(-1, window)
        counts = [len(owners[p]) for p in phrases]
        items = np.array([i for p in phrases for i in sorted(owners[p])], np.int64)
        return cls(numbers, filled, np.array([len(p) for p in phrases], np.int64), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64), items, names)

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence in a sequence of numbers, through the sequence's FM-index.

        Stretches between gaps that are too short for the shortest window are left out of the index beforehand.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.windows):
            return none
        known = ids > 0
        edge = np.diff(np.concatenate([[False], known, [False]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - begin >= self.lengths.min()
        begin, end = begin[long], end[long]
        if not len(begin):
            return none
        sizes = end - begin + 1  # each stretch with a gap behind it
        offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.arange(sizes.sum()) - np.repeat(offset - begin, sizes)
        text = np.where(place < np.repeat(end, sizes), ids[np.minimum(place, len(ids) - 1)], 0)
        index = FMIndex(text, len(self.numbers))
        low, high = index.search(self.windows, self.lengths)
        counts = high - low
        found = np.repeat(np.arange(len(low)), counts)
        rows = np.arange(counts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]) - low, counts)
        return found, place[index.locate(rows)]


def numbers_of(texts: list[bytes], blocks: list[Phrases]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of words of each text, and for each block the texts' words as its numbers, end to end, with a gap behind each text."""
    sizes = np.zeros(len(texts), np.int64)
    found: list[list[np.ndarray]] = [[] for _ in blocks]
    for i, t in enumerate(texts):
        words = words_of(t)
        sizes[i] = len(words)
        for own, block in zip(found, blocks, strict=True):
            own.append(np.fromiter(chain(map(block.numbers.get, words, repeat(0)), (0,)), np.int32, len(words) + 1))
    return sizes, [np.concatenate(own) if own else np.zeros(0, np.int32) for own in found]


def shard_hits(texts: list[bytes], blocks: list[Phrases]) -> tuple[list[int], list[np.ndarray], list[set[str]]]:
    """For each text of a shard: number of words, merged spans of hit words [begin, end), and items with occurring windows."""
    sizes, numbers = numbers_of(texts, blocks)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)
    marks = np.zeros(starts[-1] + 1, np.int32)
    items: list[set[str]] = [set() for _ in texts]
    for block, ids in zip(blocks, numbers, strict=True):
        window, at = block.occurrences(ids)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + block.lengths[window], -1)
        owner = np.searchsorted(starts, at, side="right") - 1
        seen = np.unique(owner * len(block.lengths) + window) if len(window) else np.zeros(0, np.int64)
        owner, window = np.divmod(seen, max(1, len(block.lengths)))
        counts = block.item_at[window + 1] - block.item_at[window]
        rows = np.arange(counts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]) - block.item_at[window], counts)
        pairs = np.unique(np.repeat(owner, counts) * max(1, len(block.names)) + block.items[rows])
        for doc, item in zip(*np.divmod(pairs, max(1, len(block.names))), strict=True):
            items[doc].add(block.names[item])
    hit = np.cumsum(marks[:-1]) > 0
    spans = []
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=False):
        edge = np.diff(np.concatenate([[False], hit[s : s + n], [False]]).astype(np.int8))
        spans.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1))
    return sizes.tolist(), spans, items


def compiled(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[Phrases]:
    """The benchmark in blocks of at most about `block_bytes` of text. It is a stated set of queries, read item by item."""
    blocks, rows, size = [], [], 0
    for r in benchmark.select(F.col(quoted(item_id)).alias("k"), F.encode(F.coalesce(F.col(quoted(text)), F.lit("")), "UTF-8").alias("t")).toLocalIterator():
        rows.append((r["k"], bytes(r["t"])))
        size += len(rows[-1][1])
        if size > block_bytes:
            blocks.append(Phrases.compile(rows, window))
            rows, size = [], 0
    return [*blocks, Phrases.compile(rows, window)]


HITS = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<begin: int, end: int>>, contaminated boolean"


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row's `keep` columns with its hits: n_words, n_hit, n_items, items (sorted as strings), spans, contaminated.

    Words: runs of 0-9, a-z and non-ASCII characters after A-Z went to lower case. A window is `window` consecutive
    words of an item; an item of fewer words, but not none, is one window. Words inside any occurrence are hit; spans
    are those words, merged, counted from 0. Null texts have no words and no hits; items without words have no
    window; a null item_id still hits words but is not listed. Equal ids of different items count as one item. Each
    shard (rows of about 4 MB of text, a longer text alone) gets its own index in the task that reads it: nothing is
    shuffled, and a lost task is read and indexed again. Rows are searched each for itself, so repeated rows and equal
    ids are alike; an empty table gives no rows. A `keep` column may not have the name of a result.
    """
    no_clash(keep, "n_words", "n_hit", "n_items", "items", "spans", "contaminated")
    spark = docs.sparkSession
    sent = [spark.sparkContext.broadcast(b) for b in compiled(benchmark, item_id, item_text, window, block_bytes)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [s.value for s in sent]
        at = len(keep)
        for batch in gathered(batches, "_text", SHARD_BYTES):
            n, spans, items = shard_hits(bytes_of(batch.column(at)).to_pylist(), blocks)
            hit = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
            listed = [sorted(i) for i in items]
            pieces = [[{"begin": a, "end": b} for a, b in s.tolist()] for s in spans]
            columns = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for i in listed], pa.int64()), pa.array(listed, pa.list_(pa.string())), pa.array(pieces, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array([h > 0 for h in hit], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *columns], names=[*keep, "n_words", "n_hit", "n_items", "items", "spans", "contaminated"])

    rows = docs.select(*map(quoted, keep), F.col(quoted(text)).alias("_text"))
    head = ", ".join(f"{quoted(c)} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return in_arrow(rows, work, f"{head}, {HITS}")


WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def without_spans(text: bytes, spans: np.ndarray) -> bytes:
    """A text without its words [begin, end) and what stands between them; of the blanks on both sides one stays."""
    places = [m.span() for m in WORD.finditer(text.translate(WORD_BYTES))]
    out, at = [], 0
    for begin, end in spans.tolist():
        first, last = places[begin][0], places[end - 1][1]
        out.append(text[at:first])
        at = last + (text[first - 1 : first] in (b" ", b"\n") and text[last : last + 1] == b" ")
    return b"".join([*out, text[at:]])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", length: str = "n_chars", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all columns, with hit spans cut out of the texts and `length`, where there is such a column, put right.

    A cut text is searched again until nothing is hit, as words that a cut brings together may form a window anew. A
    document of which no word is left goes; one without hits stays as it is, also one that is null, empty or without
    words. Texts of any length are cut whole, repeated rows alike. Other columns, whatever their names, stay; an empty
    table, or an empty benchmark, changes nothing.
    """
    spark = docs.sparkSession
    sent = [spark.sparkContext.broadcast(b) for b in compiled(benchmark, window=window, block_bytes=block_bytes)]
    at, size = docs.columns.index(text), docs.columns.index(length) if length in docs.columns else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [s.value for s in sent]
        for batch in gathered(batches, text, SHARD_BYTES):
            texts = bytes_of(batch.column(at)).to_pylist()
            cut, gone, left = {}, set(), list(range(len(texts)))
            while left:
                n, spans, _ = shard_hits([texts[i] for i in left], blocks)
                hit = [(i, s, k) for i, s, k in zip(left, spans, n, strict=True) if len(s)]
                for i, s, k in hit:
                    texts[i] = cut[i] = without_spans(texts[i], s)
                    if int((s[:, 1] - s[:, 0]).sum()) == k:
                        gone.add(i)
                left = [i for i, *_ in hit if i not in gone]
            if cut:
                columns = list(batch.columns)
                old = columns[at].to_pylist()
                for i, t in cut.items():
                    old[i] = t.decode("utf-8", "replace")
                columns[at] = pa.array(old, columns[at].type)
                if size is not None:
                    sizes = columns[size].to_pylist()
                    for i in cut:
                        sizes[i] = len(old[i])
                    columns[size] = pa.array(sizes, columns[size].type)
                batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
                batch = batch.filter(pa.array([i not in gone for i in range(batch.num_rows)]))
            yield batch

    return in_arrow(docs, work, docs.schema)
