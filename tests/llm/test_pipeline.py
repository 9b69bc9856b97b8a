"""The pipeline's stages, one by one, against brute force on sf0.001."""

import corpus_pipeline
from quaestor.llm import fmindex, simhash
from tests.conftest import SMALL
from tests.llm.test_ops import brute_hits, brute_simhash


def brute_stays(texts: dict[int, str]) -> set[int]:
    """The least id of each group that fingerprints 2 bits apart, or a similarity of exactly 0.8 and more, connect: every pair is compared."""
    low = {d: c for d, _, c in brute_simhash(list(texts.items()))}
    sets = {d: set(simhash.shingles(t.encode(), 5)) for d, t in texts.items()}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and low[a] != low[b]:
                x, y = sorted((low[a], low[b]))
                low = {d: x if c == y else c for d, c in low.items()}
    return set(low.values())


def test_stages(spark, duck, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    labels = dict(duck.execute("SELECT doc_id, toxic FROM labels").fetchall())
    before = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SMALL).write.parquet(path)
        out = spark.read.parquet(path)
        if name == "sentencepiece":
            assert {r.doc_id for r in out.collect()} == set(before) and out.where("NOT decodes_to_text").count() == 0
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            gone = set(before) - set(after)
            assert sum(labels.get(d, 1) == 0 for d in gone) <= 0.05 * len(before)
        if name == "exact_dedup":
            best = {}
            for d, t in before.items():
                best[t] = max(best.get(t, d), d)
            assert set(after) == set(best.values())
        if name == "near_dedup":
            assert set(after) == brute_stays(before)
        if name == "decontamination":
            assert all(brute_hits(t, items)[1] == 0 for t in after.values())
            for d, t in before.items():
                n, hit, _ = brute_hits(t, items)
                assert (after.get(d) == t) if not hit else (d in after) == (hit < n)
                assert d not in after or len(fmindex.words_of(after[d].encode())) == n - hit
        before, docs = after, out


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 100 and "ids" in out.columns
