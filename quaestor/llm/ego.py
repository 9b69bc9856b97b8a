"""Links between near vectors by an epsilon grid order join: sorted by grid cells, then intervals of that order joined recursively."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.components import components
from quaestor.llm.tables import in_arrow, quoted, staged

#: Vectors that are linked at this cosine or above.
COSINE = 0.98
#: The principal dimensions are fitted on at most so many different vectors, those with the least digests; any axes give right links.
SAMPLE = 4096
#: Grid dimensions, vectors of a block, vectors that are multiplied at once, and children of an interval.
LEAD, BLOCK, LEAF, FAN = 8, 2048, 256, 16
#: Added to squared distances against rounding, and the width around the limit in which cosines are worked out without it.
SLACK, DOUBT = 1e-9, 1e-11
DOUBLES = {"array<float>": np.float32, "array<double>": np.float64}


def usable(vector: Column) -> Column:
    """Whether a vector can be linked: it has components, all are finite numbers, and one is not 0."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; their largest component is taken out first, so that no square is too large or too small."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(sample: list[np.ndarray], lead: int = LEAD) -> dict[int, np.ndarray]:
    """For each length of vectors in the sample, the axes along which they differ most, as columns."""
    axes = {}
    for size in {len(v) for v in sample}:
        x = units(np.array([v for v in sample if len(v) == size]))
        _, vectors = np.linalg.eigh(np.cov(x.T).reshape(size, size) if len(x) > 1 else np.eye(size))
        axes[size] = np.ascontiguousarray(vectors[:, ::-1][:, :lead])
    return axes


def _leading(unit: np.ndarray, axes: dict[int, np.ndarray], lead: int) -> np.ndarray:
    """The vectors along their length's axes, or their first components where the sample had none of that length; missing dimensions are 0."""
    size = unit.shape[1]
    along = unit @ axes[size] if size in axes else unit[:, :lead]
    return np.pad(along, ((0, 0), (0, lead - along.shape[1])))


def _matrix(column: pa.Array, size: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size).astype(kind)


def _box_distance(a_low: np.ndarray, a_high: np.ndarray, b_low: np.ndarray, b_high: np.ndarray) -> float:
    """Squared distance of two boxes: no two vectors in them are nearer."""
    gap = np.maximum(0.0, np.maximum(a_low - b_high, b_low - a_high))
    return float(gap @ gap)


class Side:
    """A block of the order: digests, least ids, numbers of copies, unit vectors and their leading dimensions."""

    def __init__(self, row: dict, kind: type, axes: dict[int, np.ndarray], lead: int) -> None:
        self.low = np.frombuffer(row["lows"], np.int64)
        self.copies = np.frombuffer(row["copies"], np.int64).astype(np.float64)
        self.keys = np.frombuffer(row["keys"], np.dtype("V32"))
        self.raw = np.frombuffer(row["vectors"], kind).reshape(len(self.low), -1)
        self.unit = units(self.raw)
        self.lead = _leading(self.unit, axes, lead)

    def box(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        return self.lead[i:j].min(0), self.lead[i:j].max(0)


def _linked(a: Side, i: slice, b: Side, j: slice, cosine: float) -> np.ndarray:
    """Which vectors of two intervals are linked. Products within rounding of the limit are added up exactly."""
    product = a.unit[i] @ b.unit[j].T
    linked = product >= cosine
    for x, y in np.argwhere(np.abs(product - cosine) < DOUBT):
        u, v = (s.raw[at].astype(np.float64).tolist() for s, at in ((a, i.start + x), (b, j.start + y)))
        dot, uu, vv = (math.fsum(p * q for p, q in zip(m, n, strict=True)) for m, n in ((u, v), (u, u), (v, v)))
        if 0 < uu * vv < math.inf:
            linked[x, y] = dot / math.sqrt(uu * vv) >= cosine
    return linked


def _merged(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column a number that rows and columns share exactly if links connect them; unlinked ones have -1."""
    none = linked.shape[1]
    columns = np.arange(none)
    while True:
        rows = np.where(linked, columns, none).min(1)
        new = np.minimum(columns, np.where(linked, rows[:, None], none).min(0))
        if (new == columns).all():
            break
        columns = new
    return np.where(rows == none, -1, rows), np.where(linked.any(0), columns, -1)


class Forest:
    """Which of n vectors are connected."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def joined(a: Side, b: Side, cosine: float) -> tuple[np.ndarray, np.ndarray, Forest]:
    """For each vector of a and of b how many vectors of the other block, copies counted, it is linked with; and what is connected.

    Intervals whose boxes lie farther apart than linked vectors can are left out; others are halved, the longer first,
    until both are short. a and b may be the same block: then each pair of its vectors counts once for either.
    """
    same, limit = a is b, 2 - 2 * cosine + SLACK
    n_a, n_b, forest = np.zeros(len(a.low)), np.zeros(len(b.low)), Forest(len(a.low) + (0 if same else len(b.low)))
    at_b = 0 if same else len(a.low)
    todo = [(0, len(a.low), 0, len(b.low))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if same and i0 > j0 or _box_distance(*a.box(i0, i1), *b.box(j0, j1)) > limit:
            continue
        if max(i1 - i0, j1 - j0) > LEAF:
            if same and i0 == j0:
                mid = (i0 + i1) // 2
                todo += [(i0, mid, i0, mid), (i0, mid, mid, i1), (mid, i1, mid, i1)]
            elif i1 - i0 >= j1 - j0:
                todo += [(i0, (i0 + i1) // 2, j0, j1), ((i0 + i1) // 2, i1, j0, j1)]
            else:
                todo += [(i0, i1, j0, (j0 + j1) // 2), (i0, i1, (j0 + j1) // 2, j1)]
            continue
        linked = _linked(a, slice(i0, i1), b, slice(j0, j1), cosine)
        if same and i0 == j0:
            np.fill_diagonal(linked, False)
        if not linked.any():
            continue
        n_a[i0:i1] += linked @ b.copies[j0:j1]
        if not (same and i0 == j0):
            n_b[j0:j1] += a.copies[i0:i1] @ linked
        first = {}
        for at, numbers in ((i0, _merged(linked)[0]), (at_b + j0, _merged(linked)[1])):
            for x in np.flatnonzero(numbers >= 0).tolist():
                forest.join(at + x, first.setdefault(int(numbers[x]), at + x))
    return (n_a + n_b, n_a + n_b, forest) if same else (n_a, n_b, forest)


def _blocks(order: DataFrame, kind: type, axes: dict[int, np.ndarray], lead: int, block: int) -> DataFrame:
    """The sorted vectors in blocks of one label and length: a row each, with its place in the order and its box."""
    boxes = ", ".join(f"l{d} double, h{d} double" for d in range(lead))
    schema = f"label string, size int, task bigint, place bigint, keys binary, lows binary, copies binary, vectors binary, {boxes}"

    def row(task: int, place: int, label: str, size: int, part: pa.Table) -> pa.RecordBatch:
        x = _matrix(part["vector"].combine_chunks(), size, kind)
        along = _leading(units(x), axes, lead)
        keys = b"".join(part["key"].to_pylist())
        cells = [label, size, task, place, keys, part["low"].to_numpy().tobytes(), part["copies"].to_numpy().tobytes(), x.tobytes()]
        cells += [v for d in range(lead) for v in (along[:, d].min(), along[:, d].max())]
        return pa.RecordBatch.from_pydict({n: [c] for n, c in zip(names, cells, strict=True)}, schema=kinds)

    names = ["label", "size", "task", "place", "keys", "lows", "copies", "vectors", *(f"{e}{d}" for d in range(lead) for e in "lh")]
    kinds = pa.schema([*zip(names[:8], [pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4], strict=True), *((n, pa.float64()) for n in names[8:])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place, held, name = TaskContext.get().partitionId(), 0, [], None
        for batch in batches:
            at = 0
            own = list(zip(batch.column("label").to_pylist(), batch.column("size").to_pylist(), strict=True))
            while at < len(own):
                if held and (own[at] != name or sum(h.num_rows for h in held) >= block):
                    yield row(task, place, *name, pa.Table.from_batches(held))
                    place, held = place + 1, []
                name, room = own[at], block - sum(h.num_rows for h in held)
                end = at + 1
                while end < len(own) and end - at < room and own[end] == name:
                    end += 1
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield row(task, place, *name, pa.Table.from_batches(held))

    return in_arrow(order, work, schema)


def _near_blocks(blocks: DataFrame, lead: int, limit: float) -> DataFrame:
    """(a, b), a <= b: the blocks of one label and length whose boxes are near enough, found from the whole order down.

    An interval of the order has at most FAN intervals within it, with a box each; only pairs of intervals that are near
    enough are taken apart. Nothing but boxes is moved: a row for each block.
    """
    edges = [f"{e}{d}" for d in range(lead) for e in "lh"]
    wide = blocks.agg(F.max("place"), F.max("task")).first()
    per_task = (wide[0] or 0) + 1
    boxes = staged(blocks.select("label", "size", (F.col("task") * per_task + F.col("place")).alias("code"), *edges), "ego-boxes")
    depth = 0
    while FAN**depth < per_task * ((wide[1] or 0) + 1):
        depth += 1
    pairs = None
    for level in range(depth, -1, -1):
        span = FAN**level
        each = [(F.min if e[0] == "l" else F.max)(e).alias(e) for e in edges]
        nodes = boxes.groupBy("label", "size", F.floor(F.col("code") / span).alias("code")).agg(*each) if level else boxes
        if pairs is None:
            pairs = nodes.select("label", "size", F.col("code").alias("a"), F.col("code").alias("b"))
            continue
        side = lambda s: nodes.select("label", "size", F.floor(F.col("code") / FAN).alias(s), F.col("code").alias(f"{s}_in"), *(F.col(e).alias(f"{s}_{e}") for e in edges))  # noqa: B023, E731
        met = pairs.join(side("a"), ["label", "size", "a"]).join(side("b"), ["label", "size", "b"]).where("a_in <= b_in")
        gap = lambda d: F.greatest(F.lit(0.0), F.col(f"a_l{d}") - F.col(f"b_h{d}"), F.col(f"b_l{d}") - F.col(f"a_h{d}"))
        distance = sum((gap(d) * gap(d) for d in range(1, lead)), gap(0) * gap(0))
        pairs = met.where(distance <= limit).select("label", "size", F.col("a_in").alias("a"), F.col("b_in").alias("b"))
    return staged(pairs.select(*((F.floor(F.col(x) / per_task)).alias(f"{x}_task") for x in "ab"), *((F.col(x) % per_task).alias(f"{x}_place") for x in "ab")), "ego-pairs")


def linked_vectors(vectors: DataFrame, cosine: float = COSINE, lead: int = LEAD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """From different vectors (label, vector, key, low, copies) to (key, n), how many others each is linked with, and (a, b), `low`s that are connected.

    Cells of the grid are as wide as linked unit vectors can be apart. The order goes by label, length, cells along the
    leading axes and digest; Spark sorts it in ranges, which a digest can always split, so one crowded cell is no hot task.
    Links are counted where they are found and never leave a task one by one: a pair of blocks gives at most one row for
    each of its vectors, and one for each that it connects.
    """
    spark = vectors.sparkSession
    kind = DOUBLES[vectors.schema["vector"].dataType.simpleString()]
    axes = principal_axes([np.array(r["vector"]) for r in vectors.orderBy("key").select("vector").limit(SAMPLE).toLocalIterator()], lead)
    width = math.sqrt(2 - 2 * cosine + SLACK)
    names, schema = ["label", "size", "cells", "key", "low", "copies", "vector"], f"label string, size int, cells binary, key binary, low bigint, copies bigint, vector {vectors.schema['vector'].dataType.simpleString()}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = np.diff(np.asarray(column.offsets))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                own = batch.take(pa.array(at))
                cells = np.floor(_leading(units(_matrix(own.column("vector"), size, kind)), axes, lead) / width)
                # big-endian numbers above 0 sort as their bytes do
                coded = np.clip(cells + (1 << 15), 0, (1 << 16) - 1).astype(">u2").tobytes()
                cut = pa.array([coded[i : i + 2 * lead] for i in range(0, len(coded), 2 * lead)], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column("label"), pa.array(np.full(len(at), size, np.int32)), cut, *(own.column(n) for n in names[3:])], names=names)

    placed = in_arrow(vectors.select("label", "key", "low", "copies", "vector"), work, schema)
    order = ["label", "size", "cells", "key"]
    blocks = staged(_blocks(placed.repartitionByRange(*order).sortWithinPartitions(*order), kind, axes, lead, block), "ego-blocks")
    pairs = _near_blocks(blocks, lead, 2 - 2 * cosine + SLACK)
    sides = pairs.select(*pairs.columns, F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).where("side = 0 OR a_task <> b_task OR a_place <> b_place")
    sides = sides.select("*", F.when(F.col("side") == 0, F.col("a_task")).otherwise(F.col("b_task")).alias("task"), F.when(F.col("side") == 0, F.col("a_place")).otherwise(F.col("b_place")).alias("place"))
    sent = sides.join(blocks.select("task", "place", "keys", "lows", "copies", "vectors"), ["task", "place"])
    pair = ["a_task", "a_place", "b_task", "b_place"]
    # few pairs a task: what a pair costs shows in its products, not in its bytes
    dealt = sent.repartition(max(1, min(100_000, -(-pairs.count() // 4))), *pair).sortWithinPartitions(*pair, "side")
    found = staged(_compared(dealt.select(*pair, "side", "keys", "lows", "copies", "vectors"), kind, axes, lead, cosine), "ego-links")
    return found.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n")), found.where("a IS NOT NULL").select("a", "b")


def _compared(dealt: DataFrame, kind: type, axes: dict[int, np.ndarray], lead: int, cosine: float) -> DataFrame:
    schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def results(a: Side, b: Side) -> Iterator[pa.RecordBatch]:
        n_a, n_b, forest = joined(a, b, cosine)
        low = a.low if a is b else np.concatenate([a.low, b.low])
        for side, n in ((a, n_a),) if a is b else ((a, n_a), (b, n_b)):
            at = np.flatnonzero(n)
            keys = pa.array([side.keys[i].tobytes() for i in at], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array(n[at].astype(np.int64)), *(pa.nulls(len(at), pa.int64()) for _ in "ab")], schema=schema)
        root = np.array([forest.root(x) for x in range(len(low))], np.int64)
        at = np.flatnonzero(root != np.arange(len(low)))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.int64()), pa.array(low[at]), pa.array(low[root[at]])], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                side = Side(row, kind, axes, lead)
                if row["side"] == 0:
                    waiting = side
                    if (row["a_task"], row["a_place"]) == (row["b_task"], row["b_place"]):
                        yield from results(side, side)
                else:
                    yield from results(waiting, side)

    return in_arrow(dealt, work, "key binary, n bigint, a bigint, b bigint")


def near_vectors(rows: DataFrame, cosine: float = COSINE, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: how many others of its label have at least that cosine, and the least id that links reach.

    Equal vectors of a label are one vector with a number of copies, counted before anything is shuffled; all of their
    links count and none is written out. Vectors of different lengths have no cosine and no link.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label or an id, link with
    nothing; their component is their own id, null where it is null, and a row without an id is not kept. Rows with one id
    are vectors of their own, with links of their own, yet count as one place in components. An empty table gives an
    empty table. Other columns, whatever their names, are not read.
    """
    kind = rows.schema[vector].dataType.simpleString()
    of = F.col(quoted(vector)) if kind in DOUBLES else F.col(quoted(vector)).cast("array<double>")
    named = rows.select(F.col(quoted(id)).cast("long").alias("vec_id"), F.col(quoted(label)).cast("string").alias("label"), of.alias("vector"))
    able = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # + 0 makes -0 and 0 one number; the digest stands for the vector
    written = F.array_join(F.transform("vector", lambda x: (x + F.lit(0).cast("float" if kind == "array<float>" else "double")).cast("string")), ",")
    keyed = named.withColumn("key", F.when(able, F.unhex(F.sha2(F.concat_ws(":", "label", written), 256))))
    vectors = staged(keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")), "ego-vectors")
    counts, links = linked_vectors(vectors, cosine)
    reached = components(links).select(F.col("node").alias("low"), F.col("low").alias("least"))
    known = vectors.select("key", "low", "copies").join(counts, "key", "left").join(reached, "low", "left")
    known = known.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id"))
    joined_ = keyed.select("vec_id", "key").join(known, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined_.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
