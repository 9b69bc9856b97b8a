"""URL filter: a sorted array of 64-bit xxHash digests, memory-mapped and probed by binary search."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm.tables import ascii_lower, bytes_of, in_arrow, no_clash, quoted

SCHEMA = "host string, path string, rule string, verdict string"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = ""


def host_and_path(url: bytes) -> tuple[bytes, bytes]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: then up to `?`, `#` or the end."""
    scheme = url.find(b"://")
    if scheme < 0:
        return b"", b""
    rest = url[scheme + 3 :]
    for mark in (b"?", b"#"):
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition(b"/")
    return host.lower(), slash + path


def key_of(host: bytes, path: bytes) -> bytes:
    return host + b"\0" + path


def digest_of(key: bytes) -> int:
    """XXH64 as Spark's xxhash64() has it."""
    return xxhash.xxh64_intdigest(key, 42)


def ordered_rules(spark: SparkSession, rules: Iterable[Rule] | DataFrame) -> DataFrame:
    """(digest, key, block) of each distinct host and path in order of the digests, which Spark sorts; of equal rules a block wins."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.action, r.host, r.path) for r in rules], "action string, host string, path string")
    action = F.when(F.col("action").isin("allow", "block"), F.col("action")).otherwise(F.raise_error(F.concat(F.lit("a rule's action is allow or block, not "), F.coalesce("action", F.lit("null")))))
    key = F.concat(F.encode(ascii_lower(F.coalesce("host", F.lit(""))), "UTF-8"), F.lit(b"\0"), F.encode(F.coalesce("path", F.lit("")), "UTF-8"))
    best = rules.select(key.alias("key"), action.alias("action")).groupBy("key").agg(F.bool_or(F.col("action") == "block").alias("block"))
    return best.select(F.xxhash64("key").alias("digest"), "key", "block").orderBy(F.col("digest") < 0, "digest", "key")


class DigestIndex:
    """Digests in order, and beside them where each rule's full string stands. The three files are memory-mapped."""

    KINDS = {"digests": np.uint64, "places": np.int64, "strings": np.uint8}

    def __init__(self, digests: np.ndarray, places: np.ndarray, strings: np.ndarray, path_lengths: tuple[int, ...]):
        self.digests, self.places, self.strings, self.path_lengths = digests, places, strings, path_lengths

    @classmethod
    def write(cls, rules: DataFrame, folder: Path, stem: str) -> tuple[list[Path], tuple[int, ...]]:
        """Writes ordered_rules() to the files as they stream past, and returns them with the lengths that rules' paths have."""
        paths, lengths, at = [folder / f"{stem}-{part}.bin" for part in cls.KINDS], set(), 0
        with contextlib.ExitStack() as held:
            digests, places, strings = (held.enter_context(p.open("wb")) for p in paths)
            places.write(np.int64(0).tobytes())
            for r in rules.toLocalIterator():
                key = bytes(r["key"])
                stored = (b"b" if r["block"] else b"a") + key
                at += len(stored)
                digests.write(np.int64(r["digest"]).tobytes())
                places.write(np.int64(at).tobytes())
                strings.write(stored)
                lengths.add(len(key) - key.index(b"\0") - 1)
        return paths, tuple(sorted(lengths))

    @classmethod
    def open(cls, paths: Iterable[str], path_lengths: tuple[int, ...]) -> DigestIndex:
        mapped = (np.memmap(p, kind, "r") if os.path.getsize(p) else np.zeros(0, kind) for p, kind in zip(paths, cls.KINDS.values(), strict=True))
        return cls(*mapped, path_lengths)

    def find(self, keys: list[bytes]) -> list[str | None]:
        """The action stored for each key, confirmed on the full string, or None."""
        found: list[str | None] = [None] * len(keys)
        if not len(self.digests) or not keys:
            return found
        probe = np.fromiter(map(digest_of, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, probe)
        hits = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == probe))
        for i in hits.tolist():
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == probe[i]:
                stored = self.strings[self.places[k] : self.places[k + 1]].tobytes()
                if stored[1:] == keys[i]:
                    found[i] = "block" if stored[:1] == b"b" else "allow"
                    break
                k += 1
        return found

    def judge(self, urls: list[bytes], default: str) -> list[tuple[bytes, bytes, bytes | None, str]]:
        """Host, path, winning rule and verdict of each url; the longest rule wins, and of those the longest host."""
        parts, keys, owner = [], [], []
        for i, url in enumerate(urls):
            host, path = host_and_path(url)
            parts.append((host, path))
            suffix = host
            while suffix:
                for n in self.path_lengths:
                    if n > len(path):
                        break
                    keys.append(key_of(suffix, path[:n]))
                    owner.append(i)
                suffix = suffix.partition(b".")[2]
        best: dict[int, tuple[int, int, bytes, str]] = {}
        for i, key, action in zip(owner, keys, self.find(keys), strict=True):
            if action:
                host = key.partition(b"\0")[0]
                entry = (len(key), len(host), key.replace(b"\0", b"", 1), action)
                best[i] = max(best.get(i, entry), entry)
        return [(*parts[i], *(best[i][2:] if i in best else (None, default))) for i in range(len(urls))]


def filter_urls(pages: DataFrame, rules: Iterable[Rule] | DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """Every row's `keep` columns with host, path, rule (null: none fits) and verdict of its url.

    A rule fits its host and all subdomains if the path starts with the rule's; without a rule the verdict is `default`.
    Rules, of any number, are a list or a table (action, host, path). Spark makes them distinct and sorts them by digest; the
    driver only writes them to files as they stream past, 17 bytes and its text for each rule. The files reach the
    executors, which fetch them once and map them, also executors that start later.
    A null url, or one without `://`, has an empty host and path. A url of any length is judged whole. Repeated rows are
    judged alike; no row is dropped; an empty table gives no rows. A `keep` column may not have the name of a result.
    """
    no_clash(keep, "host", "path", "rule", "verdict")
    spark: SparkSession = pages.sparkSession
    folder = Path(tempfile.mkdtemp(prefix="quaestor-urls-"))
    files, lengths = DigestIndex.write(ordered_rules(spark, rules), folder, f"urls-{uuid.uuid4().hex}")
    for file in files:
        spark.sparkContext.addFile(str(file))
    names = [f.name for f in files]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex.open([SparkFiles.get(n) for n in names], lengths)
        for batch in batches:
            rows = index.judge(bytes_of(batch.column(len(keep))).to_pylist(), default)
            host, path, rule, verdict = zip(*rows, strict=True) if rows else ((), (), (), ())
            text = lambda v: pa.array(v, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], text(host), text(path), text(rule), pa.array(verdict, pa.string())], names=[*keep, "host", "path", "rule", "verdict"])

    rows = pages.select(*map(quoted, keep), quoted(url))
    head = ", ".join(f"{quoted(c)} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return in_arrow(rows, work, f"{head}, {SCHEMA}")
