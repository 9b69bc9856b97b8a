"""Runs of repeated words: Karp-Miller-Rosenberg names, extensions by descending levels, candidates on grids of each period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.vector import let
from quaestor.llm.tables import gathered, in_arrow, no_clash, quoted

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Text that is named at once, in bytes; a longer text is named alone. Names take 4 bytes for each word and level.
BATCH = 4 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _named(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Names of the n places: keys that are equal share one; places without a key, or with one of its own, have a name below 0."""
    names = -1 - np.arange(n, dtype=np.int32)
    _, group, count = np.unique(keys, return_inverse=True, return_counts=True)
    shared = count[group] > 1
    names[at[shared]] = group[shared]
    return names


def name_levels(words: np.ndarray) -> list[np.ndarray]:
    """names[k][i] == names[k][j], i <> j, exactly where the 2 ** k words from i and from j are the same.

    A level's name is that of the pair of names that it doubles, so only places whose halves both occur elsewhere are
    sorted again. The last level is the last at which any words are repeated.
    """
    n, width = len(words), 1
    levels = [_named(words, np.arange(n), n)]
    while 2 * width <= n:
        last = levels[-1]
        at = np.flatnonzero((last[:-width] >= 0) & (last[width:] >= 0))
        names = _named(last[at].astype(np.int64) * n + last[at + width], at, n)
        if not (names >= 0).any():
            break
        levels.append(names)
        width *= 2
    return levels


def extension(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from i equal those from j (i < j); or how many before i equal those before j."""
    n, total = len(levels[0]), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        a, b = (i - total - width, j - total - width) if back else (i + total, j + total)
        inside = (a >= 0) & (b + width <= n)
        same = inside.copy()
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        total += same * width
    return total


def runs_of(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in an array of whole numbers, by start, then period; no period above longest / 4.

    A run of period q and 4 q words or more holds a multiple i of q from which at least 2 q + 1 words are repeated q later, so
    names of that width find it. Of neighbouring multiples with equal names, which lie in one run, the first is extended.
    A stretch also shows at multiples of its period, with the same ends: the least period stays.
    """
    levels = name_levels(words)
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q in range(1, longest // LEAST_PERIODS + 1):
        k = (2 * q + 1).bit_length() - 1
        if k >= len(levels):
            break
        grid = levels[k][::q]
        same = grid[1:] == grid[:-1]
        if same.any():
            same[1:] &= ~same[:-1]
            places.append(np.flatnonzero(same) * q)
            periods.append(np.full(len(places[-1]), q, np.int64))
    i, q = np.concatenate(places), np.concatenate(periods)
    start, end = i - extension(levels, i, i + q, back=True), i + q + extension(levels, i, i + q)
    long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    start, end, q = start[long], end[long], q[long]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    first = np.ones(len(q), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[first], end[first], q[first]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and the n + 1 places where a text's words begin and end; a null text has none."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    flat, ends = lists.values, np.asarray(lists.offsets).astype(np.int64)
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    upto = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), upto[ends]


def _found(texts: pa.Array) -> list[pa.Array]:
    """n_words, runs and collapsed_text of each text."""
    words, at = _words(texts)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    coded = words.dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    # words of different texts never count as equal, so no run goes over a text's end
    ids = doc * kinds + np.asarray(coded.indices).astype(np.int64)
    start, end, q = runs_of(ids, int(n.max(initial=0)))
    gone = np.zeros(len(ids) + 1, np.int32)
    np.add.at(gone, start + q, 1)
    np.add.at(gone, end, -1)
    kept = np.cumsum(gone[:-1]) == 0
    upto = np.concatenate([[0], np.cumsum(kept)])[at]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), words.filter(pa.array(kept))), " ")
    fields = pa.StructArray.from_arrays([pa.array(start - at[doc[start]]), pa.array(end - start), pa.array(q)], names=["start", "length", "period"])
    return [pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.searchsorted(start, at), pa.int32()), fields), collapsed]


def find_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_words, runs (start, length, period; by start, then period) and collapsed_text of every whole text.

    Words are what ASCII white space divides; starts count words from 0. A run is a stretch with smallest period q, of at
    least max(6, 4 q) words, which no neighbouring word extends. Collapsed texts leave out what any run holds behind its
    first q words, and join the rest by one blank.

    Null and empty texts have no words, no runs and an empty collapsed text. Rows are taken one by one, so ids may be null
    or repeated; an empty table gives an empty table. Other columns do not matter; kept ones may not have a result's name.
    No shuffle. A task holds a batch of BATCH bytes of text, or one longer text, with 4 bytes for each word and level:
    a text of a million words takes at most 80 MB of names.
    """
    no_clash(keep, "n_words", "runs", "collapsed_text")
    kept = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(quoted(c)).alias(k) for c, k in zip(keep, kept, strict=True)), F.col(quoted(text)).alias("text"))
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in kept), f"n_words bigint, runs {RUNS}, collapsed_text string"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", BATCH):
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *_found(batch.column("text"))], names=[*kept, "n_words", "runs", "collapsed_text"])

    found = in_arrow(rows, work, schema)
    return found.select(*(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), "n_words", "runs", "collapsed_text")


def longest_run(runs: Column) -> Column:
    """The longest of a row's runs, of equal ones that with the smallest start, then period: start, length and period; null where there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def listed_runs(runs: Column) -> Column:
    """Runs as text: `start,length,period` and a line feed for each."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text, by CRC-32 of its id, becomes periodic from a word on, as op11's contract says; a null id plants none."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        of = lambda s, i: F.get(words, F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int"))
        joined = lambda s: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: of(s, i)), " ")
        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), joined)).otherwise("")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, planted)).otherwise(F.col("text")).alias("text"))
