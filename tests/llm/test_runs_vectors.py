"""Runs of words, links between vectors and clusters against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.llm import ego, kmeans, queries, runs
from tests.conftest import SMALL

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# 11: runs


def brute_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) by the definition: every period, every maximal stretch, the least period of a stretch."""
    codes: dict = {}
    x = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(x) // 4 + 1):
        step = np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            if b - a + q >= max(6, 4 * q):
                found.setdefault((a, b + q), q)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> str:
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id: int, words: list[str]) -> list[str]:
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_runs_query_by_brute_force(spark, duck):
    got = {r.doc_id: tuple(r) for r in queries.op11_period_runs(spark, SMALL).collect()}
    texts = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(got) == len(texts)
    for doc_id, text in texts:
        words = planted(doc_id, WORDS.findall(text or ""))
        found = brute_runs(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{a},{n},{q}\n" for a, n, q in found)
        shas = [hashlib.sha256(s.encode()).hexdigest() for s in (listed, collapsed(words, found))]
        assert got[doc_id] == (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *shas)
    assert sum(r[1] for r in got.values()) > 50


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_of_random_words(letters):
    rng = np.random.default_rng(letters)
    for _ in range(150):
        parts = [np.tile(rng.integers(0, letters, rng.integers(1, 12)), rng.integers(1, 9)) for _ in range(rng.integers(1, 6))]
        x = np.concatenate(parts).astype(np.int64)
        start, end, q = runs.runs_of(x, len(x))
        assert list(zip(start.tolist(), (end - start).tolist(), q.tolist(), strict=True)) == brute_runs(x.tolist())


def test_extensions_by_brute_force():
    x = np.random.default_rng(5).integers(0, 2, 300)
    levels = runs.name_levels(x)
    i, j = (np.array(v) for v in zip(*((a, b) for a in range(0, 300, 3) for b in range(a + 1, 300, 7)), strict=True))
    ahead = [next((k for k in range(300 - b) if x[a + k] != x[b + k]), 300 - b) for a, b in zip(i, j, strict=True)]
    behind = [next((k for k in range(a) if x[a - 1 - k] != x[b - 1 - k]), a) for a, b in zip(i, j, strict=True)]
    assert runs.extension(levels, i, j).tolist() == ahead
    assert runs.extension(levels, i, j, back=True).tolist() == behind


def test_runs_of_odd_rows(spark):
    texts = ["a b " * 40_000 + "c", None, "", " \t\n", "x x x x x", "x x x x x x", "É É é É É é É É é É É é", "a\x1cb c " * 6, "same text", "same text"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, text_ long")
    rows = sorted(runs.find_runs(docs, keep=("doc_id", "text_")).collect(), key=lambda r: r.text_)
    for r, text in zip(rows, texts, strict=True):
        words = WORDS.findall(text or "")
        if len(words) < 1000:
            found = brute_runs(words)
            assert [tuple(x) for x in r.runs] == found and r.n_words == len(words) and r.collapsed_text == collapsed(words, found)
    assert [tuple(x) for x in rows[0].runs] == [(0, 80_000, 2)] and rows[0].collapsed_text == "a b c"
    assert runs.find_runs(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="runs"):
        runs.find_runs(docs.withColumn("runs", F.lit(1)), keep=("doc_id", "runs"))


def test_planted_runs_of_odd_texts(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    texts = ["", None, " \t\n", "one", " ".join(f"é{i}" for i in range(300))]
    docs = spark.createDataFrame([*zip(ids, texts, strict=True), (None, "a b"), (None, None)], "doc_id long, text string")
    got = [(r.doc_id, WORDS.findall(r.text or "")) for r in runs.with_planted_runs(docs).collect()]
    assert got == [*((i, planted(i, WORDS.findall(t or ""))) for i, t in zip(ids, texts, strict=True)), (None, ["a", "b"]), (None, [])]


def test_runs_do_not_cross_texts(spark):
    docs = spark.createDataFrame([(i, "z z z z") for i in range(50)], "doc_id long, text string").coalesce(1)
    assert all(r.runs == [] and r.collapsed_text == "z z z z" for r in runs.find_runs(docs).collect())


# 12: links between vectors


def brute_links(rows: list[tuple], cosine: float = 0.98) -> dict[int, tuple[int, int]]:
    """id: links and least id reached, of rows (id, vector, label) with different ids."""
    good = [(i, np.array(v, np.float64), c) for i, v, c in rows if c is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near: dict[int, list[int]] = {i: [] for i, _, _ in rows}
    for n, (i, u, c) in enumerate(good):
        for j, v, d in good[n + 1 :]:
            if c == d and len(u) == len(v) and u @ v / math.sqrt((u @ u) * (v @ v)) >= cosine:
                near[i].append(j)
                near[j].append(i)
    low: dict[int, int] = {}
    for i in sorted(near):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in low:
                low[x] = i
                todo += near[x]
    return {i: (len(near[i]), low[i]) for i in near}


def crowded(seed: int, n: int, size: int, labels: int) -> list[tuple]:
    """Vectors around few centres at all distances, chains of near ones, and copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, size)) * rng.choice([0.0, 0.02, 0.1, 0.2, 0.5], (n, 1))
    turn = np.linspace(0, math.pi, n // 4)
    x[: n // 4] = np.outer(np.cos(turn), centres[0]) + np.outer(np.sin(turn), centres[1])
    ids = rng.permutation(10 * n)[:n]
    return [(int(i), v.tolist(), int(c)) for i, v, c in zip(ids, x.astype(np.float32), rng.integers(0, labels, n), strict=True)]


@pytest.mark.parametrize(("n", "size", "labels", "block"), [(700, 16, 2, 40), (300, 3, 1, 1000)])
def test_links_by_brute_force(spark, monkeypatch, n, size, labels, block):
    rows = crowded(n, n, size, labels)
    monkeypatch.setattr(ego.linked_vectors, "__defaults__", (ego.COSINE, ego.LEAD, block))
    monkeypatch.setattr(ego, "LEAF", 16)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in ego.near_vectors(vectors).collect()}
    want = brute_links(rows)
    assert got == want
    assert max(v[0] for v in want.values()) > 20 and len({v[1] for v in want.values()}) > 20


def test_intervals_are_halved(monkeypatch):
    """Counts and connections of two blocks, and of a block with itself, with intervals down to four vectors; distant ones are left out."""
    monkeypatch.setattr(ego, "LEAF", 4)
    multiplied, original = [], ego._linked
    monkeypatch.setattr(ego, "_linked", lambda a, i, b, j, c: multiplied.append((i.stop - i.start) * (j.stop - j.start)) or original(a, i, b, j, c))
    rng = np.random.default_rng(6)
    x = np.array([v for _, v, _ in crowded(7, 200, 6, 1)], np.float64)
    x = x[np.lexsort(np.floor(ego._leading(ego.units(x), {}, 8) / 0.2).T[::-1])]
    copies = rng.integers(1, 4, 200)
    side = lambda at: ego.Side({"lows": at.tobytes(), "copies": copies[at].tobytes(), "keys": b"0" * 32 * len(at), "vectors": x[at].tobytes()}, np.float64, {}, 8)
    link = ego.units(x) @ ego.units(x).T >= 0.98
    np.fill_diagonal(link, False)
    whole, first, last = side(np.arange(200)), side(np.arange(80)), side(np.arange(80, 200))
    n, _, forest = ego.joined(whole, whole, 0.98)
    assert n.tolist() == (link @ copies).tolist()
    reach = {i: i for i in range(200)}
    for i, j in np.argwhere(link).tolist():
        if reach[i] != reach[j]:
            lo, hi = sorted((reach[i], reach[j]))
            reach = {k: lo if v == hi else v for k, v in reach.items()}
    assert [forest.root(i) for i in range(200)] == [reach[i] for i in range(200)]
    n_a, n_b, forest = ego.joined(first, last, 0.98)
    assert n_a.tolist() == (link[:80, 80:] @ copies[80:]).tolist() and n_b.tolist() == (copies[:80] @ link[:80, 80:]).tolist()
    assert all(forest.root(i) == forest.root(j) for i, j in np.argwhere(link).tolist() if i < 80 <= j)
    assert sum(multiplied) < 0.8 * (200 * 200 / 2 + 80 * 120)


def test_blocks_that_are_far_apart_do_not_meet(spark):
    rows = [(i, np.eye(8)[i % 8].tolist(), 0) for i in range(64)]
    rows = [(i, (np.array(v) + np.random.default_rng(i).normal(size=8) * 0.001).tolist(), c) for i, v, c in rows]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<double>, label string").withColumns({"key": F.unhex(F.sha2(F.col("vec_id").cast("string"), 256)), "low": F.col("vec_id"), "copies": F.lit(1).cast("long")})
    seen = []
    original = ego._near_blocks
    ego._near_blocks = lambda *a: seen.append(original(*a)) or seen[-1]
    try:
        counts, _ = ego.linked_vectors(vectors, block=8)
    finally:
        ego._near_blocks = original
    assert {r.n for r in counts.collect()} == {7}
    assert seen[0].count() < 30  # of 36 pairs at least: blocks of one partition that hold one direction meet few others


def test_links_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, -0.0], 1), (8, [nan, 1.0], 1),
        (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e38, -0.0], 1), (13, [1e-40, 0.0], 1), (None, [1.0, 0.0], 1), (None, None, None), (20, [0.0, 1.0], 1), (20, [0.0, 1.0], 1), (20, [-1.0, 0.0], 1), (21, [-1.0, 0.0], 1),
    ]
    vectors = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, key int")
    got = Counter(tuple(r) for r in ego.near_vectors(vectors).collect())
    four = [(i, 3, 1, i == 1) for i in (1, 2, 12, 13)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == Counter([*four, *alone, (None, 0, None, False), (None, 0, None, False), (20, 1, 20, True), (20, 1, 20, True), (20, 1, 20, True), (21, 1, 20, False)])
    assert ego.near_vectors(vectors.where("false")).count() == 0


def test_many_copies_and_a_crowd(spark):
    """A third of the rows is one vector, a third is a crowd of near ones; no pair of them leaves a task."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=32)
    rows = [(i, (rng.normal(size=32) if i % 3 == 0 else centre if i % 3 == 1 else centre + rng.normal(size=32) * 0.01).tolist(), 7) for i in range(6000)]
    got = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    found = ego.near_vectors(got).groupBy(F.col("vec_id") % 3 == 0).agg(F.min("n_links"), F.max("n_links"), F.count_distinct("component_id")).collect()
    assert {tuple(r) for r in found} == {(True, 0, 0, 2000), (False, 3999, 3999, 1)}


def test_exact_sums_decide_on_the_limit():
    a = np.array([[3.0, 4.0], [5.0, 0.0]])
    side = ego.Side({"lows": np.arange(2).tobytes(), "copies": np.ones(2, np.int64).tobytes(), "keys": b"0" * 64, "vectors": a.tobytes()}, np.float64, {}, 8)
    assert ego._linked(side, slice(0, 1), side, slice(1, 2), 0.6).tolist() == [[True]]
    assert ego._linked(side, slice(0, 1), side, slice(1, 2), np.nextafter(0.6, 1)).tolist() == [[False]]


# 13: clusters


def brute_clusters(rows: list[tuple[int, list[int]]], k: int, rounds: int) -> tuple[dict[int, tuple[int, int]], list[list[int]]]:
    by_hash = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in by_hash[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own: dict[int, list] = {}
        for _, v in rows:
            own.setdefault(nearest(v)[1], []).append(v)
        for j, vs in own.items():
            centres[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return {i: nearest(v)[::-1] for i, v in rows}, centres


@pytest.mark.parametrize(("n", "dims", "spread", "k"), [(900, 2, 6, 25), (400, 5, 3, 40), (250, 3, 100_000, 7), (3, 2, 5, 10)])
def test_clusters_by_brute_force(spark, n, dims, spread, k):
    """Small whole numbers on few dimensions: most distances tie."""
    rng = np.random.default_rng(n)
    rows = [(int(i), rng.integers(-spread, spread + 1, dims).tolist()) for i in rng.permutation(5 * n)[:n]]
    given = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    found = kmeans.cluster(given, k=k, rounds=5, dims=dims, scale=1)
    want, centres = brute_clusters(rows, k, 5)
    assert {r.id: (r.cluster, r.distance) for r in found.rows.collect()} == want
    assert found.centroids.tolist() == centres
    by = Counter(c for c, _ in want.values())
    assert found.counts == [by[c] for c in range(len(centres))]
    assert found.inertia == [sum(d for c, d in want.values() if c == j) for j in range(len(centres))]


def test_search_equals_a_full_search():
    """Bounds kept over many moves of the centroids lead to what a full search finds, ties included, with fewer distances."""
    rng = np.random.default_rng(3)
    seen = 0
    for spread in (4, 50, 1 << 20):
        x = rng.integers(-spread, spread + 1, (2000, 3))
        centroids = rng.integers(-spread, spread + 1, (30, 3))
        search = kmeans.Search(centroids, np.zeros(30))
        cluster, upper, lower = search.first(x)
        for _ in range(8):
            new = centroids + rng.integers(-1 - spread // 20, 2 + spread // 20, centroids.shape) * (rng.random((30, 1)) < 0.4)
            search = kmeans.Search(new, np.sqrt(((new - centroids) ** 2).sum(1)))
            original, counted = search._best, []
            search._best = lambda x, among, f=original, c=counted: c.append(len(x) * len(among)) or f(x, among)
            cluster, upper, lower = search.again(x, cluster, upper, lower)
            full = original(x, np.arange(30))
            assert (cluster == full[0]).all() and (upper >= full[1] * (1 - 1e-12)).all() and (lower <= full[2] * (1 + 1e-12)).all()
            centroids, seen = new, seen + sum(counted)
    assert seen < 0.7 * 3 * 8 * 2000 * 30


def test_large_numbers_stay_exact():
    x = np.array([[1 << 27, -(1 << 27), 5]]), np.array([[-(1 << 27), (1 << 27), 4], [1 << 27, 0, 0]])
    assert kmeans.squared(*x).tolist() == [[2 * (1 << 56) + 1, (1 << 54) + 25]]


def test_clusters_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (2, [9.0, 9.0]), (None, [9.0, 8.0]), (3, [-3e5, 3e5])]
    bad = [(4, None), (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (8, [None, 1.0]), (9, [nan, 1.0]), (10, [inf, 0.0]), (11, [-inf, 0.0]), (12, [1e30, 0.0]), (None, None)]
    rows = spark.createDataFrame([(*r, "x", 1) for r in good + bad], "vec_id long, embedding array<float>, cluster string, distance int")
    found = kmeans.with_clusters(spark, kmeans.cluster(rows, k=40, dims=2)).collect()
    assert Counter(r.id for r in found) == Counter(i for i, _ in good)
    assert {r.cluster for r in found} <= set(range(4)) and {r.inertia for r in found} == {sum(r.distance for r in found)}
    for empty in (rows.where("false"), rows.where("vec_id > 3")):
        none = kmeans.with_clusters(spark, kmeans.cluster(empty, k=40, dims=2))
        assert none.count() == 0 and none.columns == found[0].__fields__


def test_earlier_rounds_are_deleted(spark):
    from quaestor.llm.tables import shared_dir

    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(f"{shared_dir(spark)}/quaestor")
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(100)], "vec_id long, embedding array<double>")
    kmeans.cluster(rows, k=5, dims=2)
    names = [p.getPath().getName() for p in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    assert not [n for n in names if n.startswith("clusters-")] and [n for n in names if n.startswith("clustered-")]
