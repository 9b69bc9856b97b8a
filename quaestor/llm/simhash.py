"""SimHash near-duplicates: fingerprints are joined with themselves in a binary trie whose node pairs share an error budget."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.components import components
from quaestor.llm.tables import bytes_of, in_arrow, maybe_in, no_clash, numbered, quoted, renamed_back, slices, staged, union_all, with_locator, without

SEED = 42
#: Blocks that a fingerprint is cut into. Two that differ in 2 bits or fewer agree in all but two of them.
BLOCKS = 4
#: Distinct fingerprints under one trie node above which the node's children are joined pair by pair in tasks of their own.
HOT = 50_000
CHILD_BITS = 8


def shingles(text: bytes, words: int) -> list[bytes]:
    """Runs of `words` words, repeats included; a shorter text is one run, a text without words none."""
    w = text.lower().split()
    if len(w) < words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))


def fingerprint(text: bytes, words: int) -> int:
    """Each bit is 1 if it is set in over half of the shingles' XXH64 values."""
    runs = shingles(text, words)
    if not runs:
        return 0
    h = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(runs))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = 3) -> DataFrame:
    """Every row's `keep` columns and `fp`, its fingerprint as a signed long; a null text has no words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch.column(len(keep)))
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fp)], names=[*keep, "fp"])

    rows = docs.select(*map(quoted, keep), quoted(text))
    head = ", ".join(f"{quoted(c)} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return in_arrow(rows, work, f"{head}, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, budget: int, stop: int = 64) -> np.ndarray:
    """Index pairs of values at most `budget` bits apart, from tries of `stop` levels whose nodes at `depth` are [starts, ends).

    values: distinct within a node and in order within it, so every node below is a run as well. All node pairs of
    one level are taken down together: a pair of nodes becomes the pairs of their children, a step to unlike children
    costs one bit, and a pair beyond the budget is dropped. Pairs of single values are settled at once.
    """
    found = []
    many = ends - starts > 1
    a0, a1 = starts[many], ends[many]
    b0, b1, cost = a0.copy(), a1.copy(), np.zeros(len(a0), np.int64)
    for level in range(depth, stop):
        if not len(a0):
            break
        single = (a1 - a0 == 1) & (b1 - b0 == 1) & (a0 != b0)
        if single.any():
            i, j = a0[single], b0[single]
            near = popcount(values[i] ^ values[j]) <= budget
            found.append(np.stack([i[near], j[near]], 1))
            a0, a1, b0, b1, cost = (x[~single] for x in (a0, a1, b0, b1, cost))
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - level)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        sides = [(a0, am, b0, bm, cost, None), (am, a1, bm, b1, cost, None), (a0, am, bm, b1, cost + 1, None), (am, a1, b0, bm, cost + 1, ~same)]
        kept = []
        for x0, x1, y0, y1, c, only in sides:
            ok = (x1 > x0) & (y1 > y0) & (c <= budget) & ((x0 != y0) | (x1 - x0 > 1))
            if only is not None:
                ok &= only
            kept.append([v[ok] for v in (x0, x1, y0, y1, c)])
        a0, a1, b0, b1, cost = (np.concatenate(v) for v in zip(*kept, strict=True))
    last = a0 != b0
    found.append(np.stack([a0[last], b0[last]], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that join two trees; they connect what all pairs connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    kept = []
    for a, b in pairs.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def _blocks_first(fp: Column, first: tuple[int, ...], width: int = 64 // BLOCKS) -> Column:
    """fp, whose bits are its highest BLOCKS * width, with the blocks `first` moved to the front."""
    order = [*first, *(b for b in range(BLOCKS) if b not in first)]
    mask = (1 << width) - 1
    parts = [F.shiftleft(F.shiftrightunsigned(fp, 64 - width * (b + 1)).bitwiseAND(F.lit(mask).cast("long")), 64 - width * (k + 1)) for k, b in enumerate(order)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def links(distinct: DataFrame, budget: int = 2, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of fingerprints at most `budget` bits apart, enough of them to connect all that such pairs connect.

    distinct: one row `fp` for each fingerprint. By the budget, two of its blocks must agree, so for each choice of
    two blocks the trie is built with those in front: its nodes at that depth, of cost 0, are the units that are
    dealt to tasks. A node with more than `hot` values is dealt as the pairs of its children (CHILD_BITS further bits,
    at most `budget` apart) instead, each pair of children a unit of its own.
    """
    if budget != 2:
        raise ValueError("four blocks, two of them in front, are exact for a budget of 2 bits")
    choices = list(combinations(range(BLOCKS), BLOCKS - budget))
    front = 64 // BLOCKS * (BLOCKS - budget)
    turned = F.array(*(F.struct(F.lit(k).alias("turn"), _blocks_first(F.col("fp"), c).alias("value")) for k, c in enumerate(choices)))
    rows = distinct.select("fp", F.explode(turned).alias("t")).select("fp", "t.turn", "t.value").withColumn("node", F.shiftrightunsigned("value", 64 - front))
    crowded = rows.groupBy("turn", "node").count().where(F.col("count") > hot).select("turn", "node", F.lit(True).alias("crowded"))
    rows = rows.join(crowded, ["turn", "node"], "left")
    child = F.shiftrightunsigned("value", 64 - front - CHILD_BITS).bitwiseAND(F.lit((1 << CHILD_BITS) - 1).cast("long")).cast("int")
    near = [m for m in range(1 << CHILD_BITS) if m.bit_count() <= budget]
    pairs = F.transform(F.array(*map(F.lit, near)), lambda m: F.least(child, child.bitwiseXOR(m)) * (1 << CHILD_BITS) + F.greatest(child, child.bitwiseXOR(m)))
    units = rows.withColumn("unit", F.explode(F.when(F.col("crowded"), pairs).otherwise(F.array(F.lit(-1)))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        turn, unit, value, fp = (np.concatenate([b.column(i).to_numpy() for b in held]).astype(np.int64) for i in range(4))
        value, fp = value.view(np.uint64), fp.view(np.uint64)
        group = turn * (1 << 17) + unit + 1
        order = np.lexsort((value, group))
        group, value, fp = group[order], value[order], fp[order]
        node = value >> np.uint64(64 - front)
        edge = np.flatnonzero((group[1:] != group[:-1]) | (node[1:] != node[:-1])) + 1
        bounds = np.concatenate([[0], edge, [len(value)]]).astype(np.int64)
        kept = np.array(forest(trie_pairs(value, bounds[:-1], bounds[1:], front, budget)), np.int64).reshape(-1, 2)
        ends = fp.view(np.int64)[kept]
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    dealt = units.select(F.col("turn").cast("int"), F.col("unit").cast("int"), "value", "fp", "node").repartition("turn", "node", "unit").drop("node")
    return in_arrow(dealt, work, "a long, b long").distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), words: int = 3, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, `keep` columns, fp, component_id (the smallest doc_id reachable by links).

    Links join fingerprints 2 or fewer bits apart, so also rows with equal ones; texts without words, null ones too,
    have fingerprint zero and link like any other. Null ids take part but are never a component's id, unless it has
    no other. Copies are counted once: only distinct fingerprints are joined, and they stay on the executors.
    Texts of any length are taken whole. An empty table gives no rows. `keep` may not name doc_id, fp or component_id.
    """
    no_clash(keep, "doc_id", "fp", "component_id")
    rows = staged(fingerprints(docs.withColumnRenamed(doc_id, "doc_id"), text, ("doc_id", *keep), words), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("low_id")), "distinct-fp")
    found = components(links(distinct.select("fp"), hot=hot))
    members = staged(found.join(distinct.withColumnRenamed("fp", "node"), "node"), "members")
    lowest = staged(members.groupBy("low").agg(F.min("low_id").alias("component_id")), "lowest")
    named = members.join(lowest, "low").select(F.col("node").alias("fp"), "component_id")
    table = staged(distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "low_id").alias("component_id")), "fp-components")
    return rows.join(table, "fp").select("doc_id", *map(quoted, keep), "fp", "component_id")


def hexed(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Texts are similar if the sets of their shingles of WORDS words have a Jaccard similarity of SIMILAR[0] / SIMILAR[1] or more.
WORDS, SIMILAR = 5, (4, 5)
#: Two texts are compared if all least values of a band are equal: that fails in every band for 7 pairs of ten thousand at a
#: similarity of 0.8 and for 1 of a hundred thousand at 0.85, and holds in some band for 17 of a thousand at 0.3.
BANDS, BAND = 24, 6
#: Shingles that texts compared in one task may have together, as 32 MB of hashes; components of more are cut into parts.
CROWD = 1 << 22
MIX = np.random.default_rng(SEED).integers(1 << 64, size=(2, BANDS * BAND, 1), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    """XXH64 values of the text's distinct shingles, in order."""
    runs = set(shingles(text, WORDS))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(runs)))


def bands(values: np.ndarray) -> np.ndarray:
    """A value for each band: a hash of BAND least values of the set, each under an order of its own."""
    least = np.full(BANDS * BAND, ~np.uint64(0))
    for at in range(0, len(values), 1 << 10):
        x = values[at : at + (1 << 10)] ^ MIX[0]
        x *= MIX[1]
        x ^= x >> np.uint64(32)
        x *= MIX[0]
        least = np.minimum(least, x.min(1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), SEED) for b in least.reshape(BANDS, BAND)], np.uint64)


def similar_pairs(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect whatever pairs of similar sets connect.

    Each one reached is compared with all not reached yet, so a tight group of any size is settled by its first.
    """
    sizes = np.array(list(map(len, sets)), np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(flat.max()) + 1, bool)
    edges, left = [], np.arange(len(sets))
    rest = flat
    while len(left):
        queue, fresh = [int(left[0])], np.ones(len(left), bool)
        fresh[0] = False
        while True:
            if not fresh.all():
                rest, left = rest[np.repeat(fresh, sizes[left])], left[fresh]
            if not queue or not len(left):
                break
            a = queue.pop()
            own = flat[begins[a] : begins[a + 1]]
            mark[own] = True
            shared = np.add.reduceat(mark[rest], np.concatenate([[0], np.cumsum(sizes[left])[:-1]]), dtype=np.int64)
            mark[own] = False
            fresh = SIMILAR[1] * shared < SIMILAR[0] * (sizes[left] + sizes[a] - shared)
            found = left[~fresh].tolist()
            edges += [(a, b) for b in found]
            queue += found
    return edges


def asked_pairs(sets: list[np.ndarray], asks: list[int]) -> list[tuple[int, int]]:
    """Edges that connect whatever pairs of similar sets connect of which one is among `asks`."""
    sizes = np.array(list(map(len, sets)), np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(flat.max()) + 1, bool)
    found = np.zeros((0, 2), np.int64)
    for a in asks:
        own = flat[begins[a] : begins[a + 1]]
        mark[own] = True
        shared = np.add.reduceat(mark[flat], begins[:-1], dtype=np.int64)
        mark[own] = False
        near = np.flatnonzero(SIMILAR[1] * shared >= SIMILAR[0] * (sizes + sizes[a] - shared))
        found = np.concatenate([found, np.stack([np.full(len(near), a), near], 1)])
        if len(found) > 1 << 20:
            found = np.array(forest(found), np.int64).reshape(-1, 2)
    return forest(found)


def _compared(units: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) between ids of similar texts. units: (unit, id, at, ask); the texts of a unit meet in one task.

    In a unit without rows of `ask` all are compared, else those rows with all.
    """

    def edges(ids: list[int], asks: list[bool], texts: list[bytes]) -> pa.RecordBatch:
        pairs = []
        if len(ids) > 1:
            sets = [shingle_set(t) for t in texts]
            pairs = asked_pairs(sets, [i for i, ask in enumerate(asks) if ask]) if any(asks) else similar_pairs(sets)
        return pa.RecordBatch.from_arrays([pa.array([ids[e[k]] for e in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, asks, texts = None, [], [], []
        for batch in batches:
            for unit, ident, ask, text in zip(*(batch.column(i).to_pylist() for i in range(3)), bytes_of(batch.column(3)).to_pylist(), strict=True):
                if unit != now:
                    yield edges(ids, asks, texts)
                    now, ids, asks, texts = unit, [], [], []
                ids.append(ident)
                asks.append(ask)
                texts.append(text)
        yield edges(ids, asks, texts)

    met = maybe_in(texts, units.select("at"), "at").where("_maybe").join(units, "at").select("unit", "id", "ask", "text")
    return in_arrow(met.repartition("unit").sortWithinPartitions("unit"), work, "a long, b long")


def similar_links(distinct: DataFrame, texts: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between the ids of similar texts. distinct: (id, at, bands, shingles), each set of shingles once; texts: (at, text) of all.

    Texts with an equal band are linked, and within each component of these links all texts are compared by their sets,
    in one task if the component has no more than `crowd` shingles. A larger one is cut into parts of that size, and
    each part is compared with itself and with the first. What then is in one group with most of the component need not
    meet again; all others, in parts too, are compared with every part. So no task holds more than two parts, or a
    longer text. Only texts that a link touches, and few others, are shuffled.
    """
    by_band = distinct.select("id", F.explode("bands").alias("value"))  # each band has orders of its own, so its values too
    low = staged(by_band.groupBy("value").agg(F.min("id").alias("low"), F.count("*").alias("k")).where("k > 1").drop("k"), "bands")
    shared = maybe_in(by_band, low, "value").where("_maybe").select("id", "value").join(low, "value")
    near = components(shared.select(F.col("id").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("id"), "low")
    near = staged(maybe_in(distinct.select("id", "at", "shingles"), near, "id").where("_maybe").drop("_maybe").join(near, "id"), "candidates")
    parts = F.ceil(F.sum("shingles") / crowd).cast("int")
    crowded = staged(near.groupBy("low").agg(parts.alias("parts")).where("parts > 1"), "crowded")

    def part(count: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(count)).cast("int")

    def of(count: str) -> Column:
        return F.sequence(F.lit(0), F.col(count) - 1)

    first = near.join(crowded, "low", "left").fillna(1, "parts").withColumn("part", F.explode(F.when(part("parts") == 0, of("parts")).otherwise(F.array(part("parts")))))
    edges = _compared(first.select(F.struct("low", "part").alias("unit"), "id", "at", F.lit(False).alias("ask")), texts)
    if crowded.isEmpty():
        return edges
    edges = staged(edges, "edges")
    members = near.join(crowded, "low").join(components(edges).select(F.col("node").alias("id"), F.col("low").alias("found")), "id", "left")
    members = staged(members.withColumn("found", F.coalesce("found", "id")), "members")
    most = members.groupBy("low", "found").agg(F.sum("shingles").alias("size")).groupBy("low").agg(F.max_by("found", F.struct("size", "found")).alias("most"))
    others = members.join(most, "low").where("found <> most").drop("most")
    asking = staged(others.groupBy("low").agg(parts.alias("asking")), "asking")
    all_parts = members.join(asking, "low").withColumn("own", part("parts")).withColumn("by", F.explode(of("asking"))).withColumn("ask", F.lit(False))
    all_asks = others.join(asking, "low").withColumn("by", part("asking")).withColumn("own", F.explode(of("parts"))).withColumn("ask", F.lit(True))
    second = all_parts.unionByName(all_asks).groupBy("low", "by", "own", "id", "at").agg(F.max("ask").alias("ask"))
    return edges.unionByName(_compared(second.select(F.struct("low", "by", "own").alias("unit"), "id", "at", "ask"), texts))


def similar_groups(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", words: int = 3, crowd: int = CROWD, place: str | None = None) -> DataFrame:
    """One row per row of docs: `keep` columns, row (an id of its own) and group, the least row reachable.

    Rows are linked by fingerprints of `words`-word shingles 2 or fewer bits apart, as in near_groups(), and by a Jaccard
    similarity of 0.8 or more over distinct five-word shingles, for near copies that no longer have the same fingerprint.
    Texts without words, null and empty ones among them, are linked by the fingerprint alone: they are one group. Rows
    with repeated or null ids stand for themselves. An empty table gives an empty table. Other columns do not matter;
    kept ones may not have a result's name. `place` names the rows' locator where there is one. Texts are not kept:
    those that have to be compared are read once more from their places.
    """
    no_clash(keep, "fp", "set", "bands", "shingles", "at", "row", "group", "_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(keep)
        for batch in (part for whole in batches for part in slices(whole, "_text", 1 << 20)):
            texts = bytes_of(batch.column(at)).to_pylist()
            fp = np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts)).view(np.int64)
            sets = [shingle_set(t) for t in texts]
            columns = [
                pa.array(fp),
                pa.array([xxhash.xxh3_128_digest(v.tobytes()) if len(v) else None for v in sets], pa.binary()),
                pa.array([bands(v).view(np.int64) if len(v) else None for v in sets], pa.list_(pa.int64())),
                pa.array([len(v) for v in sets], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *columns, batch.column(at + 1)], names=[*keep, "fp", "set", "bands", "shingles", "at"])

    source = docs.select(*map(quoted, keep), F.col(quoted(text)).alias("_text"), *([F.col(quoted(place)).alias("at")] if place else []))
    source = source if place else with_locator(source).withColumnRenamed("_at", "at")
    head = ", ".join(f"{quoted(c)} {source.schema[c].dataType.simpleString()}" for c in keep)
    made = in_arrow(source, work, f"{head}, fp long, set binary, bands array<long>, shingles long, at string")
    rows = staged(made.withColumn("row", F.monotonically_increasing_id()), "shingles")
    by_fp = staged(rows.groupBy("fp").agg(F.min("row").alias("low")), "by-fp")
    by_set = staged(rows.where("set IS NOT NULL").groupBy("set").agg(F.min("row").alias("low")), "by-set")
    copies = staged(rows.join(by_set, "set").where("row <> low").select(F.col("row").alias("a"), F.col("low").alias("b")), "copies")
    distinct = without(rows.where("set IS NOT NULL").select(F.col("row").alias("id"), "at", "bands", "shingles"), copies.select(F.col("a").alias("id")), "id")
    ends = links(by_fp.select("fp"))
    ends = ends.join(by_fp.select(F.col("fp").alias("a"), F.col("low").alias("low_a")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("low").alias("low_b")), "b")
    edges = [
        ends.select(F.col("low_a").alias("a"), F.col("low_b").alias("b")),
        similar_links(distinct, source.select("at", F.col("_text").alias("text")), crowd),
        rows.join(by_fp, "fp").where("row <> low").select(F.col("row").alias("a"), F.col("low").alias("b")),
        copies,
    ]
    found = staged(components(union_all(edges)).select(F.col("node").alias("row"), F.col("low").alias("group")), "groups")
    return rows.select(*map(quoted, keep), "row").join(found, "row", "left").select(*map(quoted, keep), "row", F.coalesce("group", "row").alias("group"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with one row of each group of similar_groups(): the one with the smallest doc_id, of those the first by place."""
    plain, names = numbered(docs)
    located = with_locator(plain)
    groups = staged(similar_groups(located.select(F.col(names[doc_id]).alias("doc_id"), F.col(names[text]).alias("text"), "_at"), ("doc_id", "_at"), place="_at"), "similar")
    stays = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_at"))).alias("first"))
    dropped = groups.join(staged(stays.select("group", F.col("first._at").alias("stays")), "stays"), "group").where("_at <> stays").select("_at")
    return renamed_back(without(located, staged(dropped, "dropped")), names)
