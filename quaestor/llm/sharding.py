"""Sharding over fixed virtual slots: rows hash into slots, a versioned map sends slots to shards and is edited to rebalance."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestor.llm.tables import quoted, staged

SLOTS = 4096
#: Slots that a slot, and then a text, is split into when it alone outweighs a shard.
FAN = 1024
#: Runs over which rows are numbered; each holds one in so many rows of every shard.
RUNS = 4096


#: What tells a text from all others: two hashes, its CRC-32 and its size.
TEXT_KEY = ["first", "second", "text_crc32", "size"]
SPLITS = "number int, vslot int, first long, second long, text_crc32 long, size long, base int"


@dataclass(frozen=True)
class Split:
    """A slot whose rows a second hash deals over FAN further slots from `base` on, or, with a key, a text whose rows their ids deal."""

    base: int
    vslot: int | None = None
    key: tuple[int, ...] | None = None


@dataclass
class SlotMap:
    """Slot to shard, by version, and the slots and texts that were split. A version is never changed; an edit makes the next one.

    The `fixed` slots come from a text's hash for ever. Splits are only added, each with slots of its own behind all
    others, so an older version knows a prefix of the slots.
    """

    shards: int
    versions: list[list[int]] = field(default_factory=list)
    fixed: int = SLOTS
    splits: list[Split] = field(default_factory=list)

    @classmethod
    def even(cls, slots: int, shards: int) -> SlotMap:
        return cls(shards, [[s % shards for s in range(slots)]], slots)

    @property
    def current(self) -> list[int]:
        return self.versions[-1]

    def slot_of(self) -> Column:
        """The slot of a row with `vslot`, its fixed slot, the columns of TEXT_KEY and `doc_id`."""
        place = F.col("vslot")
        fan = lambda base, hashed: F.lit(base) + F.pmod(hashed, F.lit(FAN)).cast("int")
        for s in self.splits:
            if s.key is None:
                place = F.when(F.col("vslot") == s.vslot, fan(s.base, F.col("second"))).otherwise(place)
        for s in self.splits:
            if s.key is not None:
                its = reduce(lambda x, y: x & y, (F.col(c) == v for c, v in zip(TEXT_KEY, s.key, strict=True)))
                place = F.when(its, fan(s.base, F.xxhash64("doc_id", F.lit("fan")))).otherwise(place)
        return place

    def split(self, slots: list[int], texts: list[tuple[int, ...]]) -> SlotMap:
        """The map with these slots and texts split; what is split already stays so. Its last version knows the new slots, dealt evenly."""
        new, top = list(self.splits), len(self.current)
        have = {s.vslot for s in new if s.key is None}, {s.key for s in new}
        for slot, key in [*((s, None) for s in slots if s not in have[0]), *((None, k) for k in texts if k not in have[1])]:
            new.append(Split(top, slot, key))
            top += FAN
        return SlotMap(self.shards, [*self.versions[:-1], [*self.current, *(s % self.shards for s in range(len(self.current), top))]], self.fixed, new)

    def loads(self, sizes: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.current):
            out[shard] += sizes[slot]
        return out

    def rebalanced(self, sizes: list[int]) -> SlotMap:
        """The next version: shards above the mean give up slots, lightest last, and the lightest shards take them.

        Slots are taken off the heavy shards, largest first while they fit into the excess, and all that was taken
        goes, largest first, to the shard that is lightest at that time.
        """
        loads, new = self.loads(sizes), list(self.current)
        mean = sum(sizes) / self.shards
        moved = []
        for slot in sorted((s for s in range(len(new)) if sizes[s]), key=lambda s: (-sizes[s], s)):
            shard = new[slot]
            if loads[shard] > mean:
                loads[shard] -= sizes[slot]
                moved.append(slot)
        heap = [(load, shard) for shard, load in enumerate(loads)]
        heapq.heapify(heap)
        for slot in sorted(moved, key=lambda s: (-sizes[s], s)):
            load, shard = heapq.heappop(heap)
            new[slot] = shard
            heapq.heappush(heap, (load + sizes[slot], shard))
        return replace(self, versions=[*self.versions, new])

    def grown(self, sizes: list[int]) -> SlotMap:
        """The next version, with one more shard, which takes slots from the heaviest shards; no other slot moves."""
        out = replace(self, shards=self.shards + 1, versions=[*self.versions, list(self.current)])
        loads, goal, mine = out.loads(sizes), sum(sizes) / out.shards, self.shards
        for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
            shard = out.current[slot]
            if shard != mine and loads[mine] + sizes[slot] <= goal and loads[shard] - sizes[slot] >= goal * 0.98:
                loads[mine] += sizes[slot]
                loads[shard] -= sizes[slot]
                out.current[slot] = mine
        return out

    def write(self, spark: SparkSession, path: str, known: SlotMap | None = None) -> None:
        """Stores at `path` what the stored map `known` has not: versions and splits are only ever added."""
        done = (len(known.versions), len(known.splits)) if known else (0, 0)
        versions = [(v, s, x, self.shards) for v, m in enumerate(self.versions) if v >= done[0] for s, x in enumerate(m)]
        if versions:
            spark.createDataFrame(versions, "version int, vslot int, shard int, shards int").coalesce(1).write.mode("append").parquet(f"{path}/slots")
        splits = [(i, s.vslot, *(s.key or [None] * 4), s.base) for i, s in enumerate(self.splits) if i >= done[1]]
        if splits or not known:
            spark.createDataFrame([*splits, (-1, self.fixed, *[None] * 4, 0)][: None if not known else len(splits)], SPLITS).coalesce(1).write.mode("append").parquet(f"{path}/splits")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> SlotMap | None:
        """The map stored at `path`, if there is one: versions times slots, a bound that no input changes."""
        try:
            slots, splits = spark.read.parquet(f"{path}/slots"), spark.read.parquet(f"{path}/splits")
        except AnalysisException:
            return None
        versions: dict[int, list[int]] = {}
        shards = 0
        for r in slots.orderBy("version", "vslot").collect():
            versions.setdefault(r["version"], []).append(r["shard"])
            shards = r["shards"]
        head, *rest = splits.orderBy("number").collect()
        return cls(shards, [versions[v] for v in sorted(versions)], head["vslot"], [Split(r["base"], r["vslot"], None if r["first"] is None else tuple(r[c] for c in TEXT_KEY)) for r in rest])


def slot_sizes(rows: DataFrame, slots: int) -> list[int]:
    """Bytes of each slot: at most `slots` sums come to the driver."""
    sizes = [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("size")).collect():
        sizes[r["vslot"]] = r["size"]
    return sizes


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus 1; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text", map_path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Each row's id, size, text_crc32, vslot, shard and slot (its place in its shard, gapless from 0), and the map.

    Law: bytes. A row's virtual slot is the hash of its text, so equal texts share slot and shard. A slot that alone
    outweighs a shard is split by a second hash of the text over FAN further slots; only a text whose own rows outweigh
    a shard, of which there are fewer than shards, is dealt by id over FAN slots, as no map can balance it. The map
    begins even, or as it is stored at `map_path`; one edit, from the bytes of each slot, rebalances it, and is stored
    there as the next version. A stored map keeps its slots, and takes on shards if `shards` is more than it has.
    Null texts count 1 byte and share a slot; null ids are hashed as a value of their own. Repeated rows each get their
    own place; texts of any length are one row. An empty table gives an empty result. Other columns are not read,
    whatever their names.
    Places come from the rows' numbers in RUNS runs dealt by id, plus what the shard holds in earlier runs, so no
    key brings many rows together and no shard is numbered by one task.
    """
    if shards < 1 or slots < shards:
        raise ValueError("at least one shard, and at least a slot for each")
    spark, c = docs.sparkSession, lambda name: F.col(quoted(name))
    known = SlotMap.read(spark, map_path) if map_path else None
    slot_map = known or SlotMap.even(slots, shards)
    if shards < slot_map.shards:
        raise ValueError(f"the stored map has {slot_map.shards} shards")
    body = F.coalesce(c(text), F.lit(""))
    rows = staged(
        docs.select(
            c(doc_id).alias("doc_id"),
            size_of(c(text)).alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
            F.xxhash64(body).alias("first"),
            F.xxhash64(F.lit("fan"), body).alias("second"),
            F.pmod(F.xxhash64(body), F.lit(slot_map.fixed)).cast("int").alias("vslot"),
            F.pmod(F.xxhash64(c(doc_id), F.lit("run")), F.lit(RUNS)).cast("int").alias("run"),
        ),
        "sharding",
    )
    by_fixed = slot_sizes(rows, slot_map.fixed)
    share = sum(by_fixed) / shards
    if heavy := [s for s, n in enumerate(by_fixed) if n > share]:
        hot = rows.where(F.col("vslot").isin(heavy)).groupBy(*TEXT_KEY).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > share).orderBy(*TEXT_KEY).collect()
        slot_map = slot_map.split(heavy, [tuple(r[k] for k in TEXT_KEY) for r in hot])
    rows = rows.withColumn("vslot", slot_map.slot_of())
    sizes = slot_sizes(rows, len(slot_map.current)) if slot_map.splits else by_fixed
    if known and slot_map.splits != known.splits:
        slot_map = replace(slot_map, versions=[*known.versions, slot_map.current])  # a stored version stays as it is
    while slot_map.shards < shards:
        slot_map = slot_map.grown(sizes)
    slot_map = slot_map.rebalanced(sizes)
    if map_path:
        slot_map.write(spark, map_path, known)
        stored = spark.read.parquet(f"{map_path}/slots").where(F.col("version") == len(slot_map.versions) - 1)
        current = stored.select("vslot", "shard")
    else:
        current = spark.createDataFrame(list(enumerate(slot_map.current)), "vslot int, shard int")
    placed = rows.join(F.broadcast(current), "vslot")
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "run").agg(F.count("*").alias("n")).select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("run", "shard").orderBy("doc_id", "text_crc32", "size"))
    numbered = placed.withColumn("number", number).join(F.broadcast(starts), ["shard", "run"])
    return numbered.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("start") + F.col("number") - 1).cast("long").alias("slot")), slot_map
