"""The ten operators against SQL, brute force, other libraries and exact round trips, on small fixtures and sf0.001."""

from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.llm import chat, ctw, exact, fmindex, pieces, queries, sharding, simhash, tables, tokens, toxicity, urls
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "the same text here", "en", "s", 18),
    (2, "the same text here", None, None, None),
    (2, "the same text here", "en", "s", 18),
    (None, "the same text here", "en", "s", 18),
    (4, None, "en", "s", 0),
    (5, "", "en", "s", 0),
    (6, " \t\n", "en", "s", 3),
    (7, "the same text there", "en", "s", 19),
    (8, "word " * 60_000, "en", "s", 300_000),
    (9, "é門😀 <|endoftext|> \\<| x" + "a" * 5000, "fr", "s", 1),
    (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query_equals_sql(name, same):
    assert same(queries.QUERIES[name], queries.oracles()[name])


def small_docs(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


# 1: sharding


def test_shards(spark, duck):
    rows = queries.op1_sharding(spark, SMALL).collect()
    texts = dict(small_docs(duck))
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        by[r.shard].append(r)
    assert set(by) == set(range(16))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    sums = [sum(r.size for r in part) for part in by.values()]
    assert max(sums) - min(sums) <= max(r.size for r in rows)
    shard_of = defaultdict(set)
    for r in rows:
        shard_of[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())


def test_shards_of_odd_rows_and_hot_slots(spark, odd, empty, tmp_path):
    rows, slot_map = sharding.shard_documents(odd, shards=3, slots=64, map_path=str(tmp_path / "map"))
    out = rows.collect()
    assert len(out) == len(ODD) and sum(r.size for r in out) == sum(len((t or "").encode()) + 1 for _, t, *_ in ODD)
    assert sharding.SlotMap.read(spark, str(tmp_path / "map")) == slot_map and len(slot_map.versions) == 2
    clash = odd.withColumnRenamed("lang", "vslot").withColumnRenamed("source", "run")
    assert sharding.shard_documents(clash, shards=3)[0].count() == len(ODD)
    assert sharding.shard_documents(empty)[0].count() == 0
    hot = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "x" * 50).otherwise(F.concat(F.lit("y"), F.col("id"))).alias("text"))
    loads = Counter()
    for r in sharding.shard_documents(hot, shards=8)[0].collect():
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) < 0.1 * sum(loads.values()) / 8


def test_only_the_hot_text_is_torn(spark):
    """Of a slot that outweighs a shard, groups of copies that fit into a shard stay whole."""
    text = F.when(F.col("id") < 2000, "x" * 50).otherwise(F.concat(F.lit("y"), F.floor(F.col("id") / 5)))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), text.alias("text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    shards_of, loads = defaultdict(set), Counter()
    for r in sharding.shard_documents(docs, shards=8, slots=8)[0].collect():
        shards_of[texts[r.doc_id]].add(r.shard)
        loads[r.shard] += r.size
    assert len(shards_of.pop("x" * 50)) > 1 and len(shards_of) == 400
    assert all(len(s) == 1 for s in shards_of.values()) and max(loads.values()) < 1.1 * sum(loads.values()) / 8


def test_stored_map_is_edited(spark, tmp_path):
    """Each run appends versions to the stored map; its slots, splits and older versions stay, and route the rows of later runs."""
    path, text = str(tmp_path / "map"), F.when(F.col("id") % 3 == 0, "x" * 50).otherwise(F.concat(F.lit("y"), F.floor(F.col("id") / 5)))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), text.alias("text"))
    assert sharding.SlotMap.read(spark, path) is None
    maps = []
    for some, shards in ((docs.where("doc_id < 2000"), 8), (docs, 8), (docs, 9)):
        rows, m = sharding.shard_documents(some, shards=shards, slots=64, map_path=path)
        rows = rows.collect()
        assert {(r.vslot, r.shard) for r in rows} <= set(enumerate(m.current)) and len({r.shard for r in rows}) == shards
        loads = Counter()
        for r in rows:
            loads[r.shard] += r.size
        assert max(loads.values()) < 1.1 * sum(loads.values()) / shards
        assert sharding.SlotMap.read(spark, path) == m
        maps.append(m)
    for a, b in zip(maps, maps[1:], strict=False):
        assert len(b.versions) > len(a.versions) and b.versions[: len(a.versions)] == a.versions and b.splits[: len(a.splits)] == a.splits
    assert maps[0].splits
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, shards=2, map_path=path)


def test_slot_map_grows_into_the_new_shard_only():
    sizes = [random.Random(1).randint(1, 100) for _ in range(512)]
    first = sharding.SlotMap.even(512, 4).rebalanced(sizes)
    more = first.grown(sizes)
    assert all(a == b or b == 4 for a, b in zip(first.current, more.current, strict=True)) and first.versions == more.versions[:2]
    loads = more.loads(sizes)
    assert max(loads) - min(loads) < 0.1 * sum(loads) / 5


# 2: chat


def test_escape_round_trip():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choices(["<", "|", "\\", "n", "\n", "<|im_end|>", "<|im_start|>", "é"], k=rng.randint(0, 10)))
        assert chat.unescape(chat.escape(text)) == text and chat.START not in chat.escape(text) and chat.END not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_fold_events(spark):
    log = [
        (1, 0, "message", "user", "hi", None), (1, 1, "message", "assistant", "", None), (1, 2, "delta", "", "Hel", None), (1, 3, "delta", "", "lo", None),
        (1, 4, "message", "user", "more", None), (1, 5, "regenerate", "", "", 1), (1, 6, "delta", None, "Bye", None), (1, 7, "edit", "", "hi!", 0), (1, 8, "edit", "", "lost", 77),
        (2, 0, "delta", "", "no message yet", None), (None, 0, "message", None, None, None), (None, None, None, "user", "first", None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, event string, role string, text string, target long")
    out = {r.conv_id: r for r in chat.conversations(events).collect()}
    assert chat.parse(out[1].formatted) == [("user", "hi!"), ("assistant", "Bye")] and out[2].n_turns == 0
    assert chat.parse(out[None].formatted) == [("user", "first"), ("", "")]
    assert "".join(out[1].formatted[m.begin : m.end] for m in out[1].mask) == "Bye"
    assert chat.conversations(events.where("false")).count() == 0
    back = {r.conv_id: r for r in chat.read_back(chat.conversations(events)).collect()}
    assert back[1].turns_sha256 == hashlib.sha256(b"user\nhi!\nassistant\nBye\n").hexdigest() and back[1].loss_chars == 3


def test_fold_of_random_logs(spark):
    """Deltas, edits and regenerations of random logs against a plain fold over lists."""
    rng, log, want = random.Random(12), [], {}
    for conv in range(60):
        messages: list[list] = []
        for seq in range(rng.randint(0, 25)):
            event, target, piece = rng.choice(["message", "delta", "delta", "edit", "regenerate", None]), rng.choice([None, None, *range(seq + 1)]), rng.choice(["a", "<|im_end|>", "é\n", "\\", None])
            log.append((f"c{conv}", seq, event, rng.choice(["user", "assistant", None]), piece, target, "clash"))
            role = log[-1][3] or ""
            if event in ("message", None):
                messages.append([seq, role, piece or ""])
                continue
            places = [i for i, m in enumerate(messages) if m[0] == target] if target is not None else [len(messages) - 1] if messages else []
            if places and event == "delta":
                messages[places[-1]][2] += piece or ""
            elif places:
                messages[places[-1]][2] = piece or ""
                if event == "regenerate":
                    messages = messages[: places[-1] + 1]
        if any(e[0] == f"c{conv}" for e in log):
            want[f"c{conv}"] = [(r, t) for _, r, t in messages]
    rng.shuffle(log)
    out = chat.conversations(spark.createDataFrame(log, "conv_id string, seq long, event string, role string, text string, target long, formatted string")).collect()
    assert {r.conv_id: chat.parse(r.formatted) for r in out} == want
    for r in out:
        assert "".join(chat.unescape(r.formatted[m.begin : m.end]) for m in r.mask) == "".join(t for role, t in want[r.conv_id] if role == "assistant")


def test_very_long_conversation(spark):
    turns = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("word "), 20).alias("text"))
    out = chat.read_back(chat.conversations(chat.events_of_turns(turns))).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in out] == [(1, 20_000, 1_000_000)]


# 3: context-tree weighting


class BruteTree:
    """Context-tree weighting by its definition: P(bit) is P_w(training and bit) / P_w(training) at the root of a decision."""

    def __init__(self, texts: list[bytes], depth: int):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        for t in texts:
            for context, byte in self.steps(t):
                for k in range(8):
                    for d in range(depth + 1):
                        self.counts[context[depth - d :], byte >> 8 - k | 1 << k][byte >> 7 - k & 1] += 1
        self.below = defaultdict(set)
        for context, decision in self.counts:
            if context:
                self.below[context[1:], decision].add(context[0])
        self.known: dict = {}

    def steps(self, text: bytes):
        data = bytes([ctw.BEFORE]) * self.depth + text + bytes([ctw.END])
        return [(data[i - self.depth : i], data[i]) for i in range(self.depth, len(data))]

    @staticmethod
    def kt(zeros: int, ones: int) -> float:
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.log(math.pi) - math.lgamma(zeros + ones + 1)

    def weighted(self, context: bytes, decision: int) -> float:
        if (context, decision) not in self.known:
            own = self.kt(*self.counts.get((context, decision), (0, 0)))
            if len(context) < self.depth:
                below = sum(self.weighted(bytes([c]) + context, decision) for c in self.below.get((context, decision), ()))
                own = float(np.logaddexp(own, below)) + math.log(0.5)
            self.known[context, decision] = own
        return self.known[context, decision]

    def with_bit(self, context: bytes, decision: int, bit: int, d: int) -> float:
        """The weighted probability of the node of d bytes with one more bit in this context."""
        node = context[self.depth - d :]
        zeros, ones = self.counts.get((node, decision), (0, 0))
        own = self.kt(zeros + (bit == 0), ones + (bit == 1))
        if d == self.depth:
            return own
        child = context[self.depth - d - 1]
        others = sum(self.weighted(bytes([c]) + node, decision) for c in self.below.get((node, decision), ()) if c != child)
        return float(np.logaddexp(own, others + self.with_bit(context, decision, bit, d + 1))) + math.log(0.5)

    def log10(self, context: bytes, byte: int) -> float:
        out = 0.0
        for k in range(8):
            decision = byte >> 8 - k | 1 << k
            out += self.with_bit(context, decision, byte >> 7 - k & 1, 0) - self.weighted(b"", decision)
        return out / math.log(10)

    def score(self, text: bytes) -> float:
        return sum(self.log10(*s) for s in self.steps(text))


@pytest.mark.parametrize("depth", [2, 5])
def test_ctw_equals_exact_weighting(spark, depth):
    """Random small texts, among them held-out ones with contexts, bytes and decisions that training has not met."""
    rng = random.Random(depth)
    rows = [(i, "".join(rng.choices("ab é門", k=rng.randint(0, 30)))) for i in range(40)] + [(i, "".join(rng.choices("abcq\x00ß", k=8))) for i in range(40, 60)] + [(60, None), (61, "")]
    tree = BruteTree([(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], depth)
    out = {r.doc_id: r for r in ctw.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth, entries=1).collect()}
    assert len(out) == len(rows) and sum(r.held_out for r in out.values()) > 3
    for i, t in rows:
        assert out[i].score == pytest.approx(tree.score((t or "").encode()), rel=1e-6)
    assert sum(10 ** tree.log10(b"\xfe\xfe\xfeab"[-depth:], b) for b in range(256)) == pytest.approx(1)


def test_kt_of_counts_by_definition():
    counts = np.array([[0, 0], [2, 1], [7, 0], [40_000, 3]])
    assert ctw.kt_of_counts(*counts.T) == pytest.approx([BruteTree.kt(*c) for c in counts.tolist()], rel=1e-9, abs=1e-12)
    assert math.exp(BruteTree.kt(2, 1)) == pytest.approx(0.5 * 0.75 * 0.5 / 3)


def test_ctw_query_base_by_brute_force(spark, duck):
    rows = small_docs(duck)
    counts, n = Counter(), 0
    tokens_of = {d: [*t.encode().lower().split(), None] for d, t in rows}
    for d, _ in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update(tokens_of[d])
            n += len(tokens_of[d])
    out = ctw.score_documents(spark.read.parquet(f"{SMALL}/documents.parquet"), frequent=50).collect()
    assert len(out) == len(rows)
    for r in out:
        t = tokens_of[r.doc_id]
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + len(counts) + 1)) for w in t))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(counts[w] > 0 for w in t), n, zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.score < 0


def test_ctw_odd_rows(odd, empty):
    out = ctw.score_documents(odd).collect()
    assert len(out) == len(ODD) and all(r.score <= 0 for r in out) and sorted(r.n_tokens for r in out)[:4] == [1, 1, 1, 1]
    assert ctw.score_documents(empty).count() == 0
    assert ctw.score_documents(odd, entries=50).count() == len(ODD)


def test_ctw_slice_is_scored_in_little_memory():
    """A slice's numbers meet their values range by range: about half of what one array of all numbers took (50 bytes each here)."""
    rng = np.random.default_rng(5)
    groups = [[rng.integers(0, 0xFE, 1 << 14, np.uint8).tobytes() for _ in range(3)] + [b""] for _ in range(24)]
    keys = np.unique(np.concatenate([n[real] for n, real, _ in (ctw.spread(g, 5) for g in groups)]))
    order, part = ctw.by_part(keys, 7, 5)
    values = (keys % np.uint64(1009)).astype(np.float32)[order]
    scores = [(p, values[part[order] == p]) for p in range(7)]
    tracemalloc.start()
    out = ctw.text_scores(groups, scores, 5, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * len(keys)
    for texts, found in zip(groups, out, strict=True):
        for t, score in zip(texts, found, strict=True):
            numbers, real, _ = ctw.spread([t], 5)
            assert score == (numbers[real] % np.uint64(1009)).sum()


def test_ctw_counts_are_added_in_place():
    rng = np.random.default_rng(6)
    keys, counts, all_of = np.zeros(0, np.uint64), np.zeros(0, np.uint32), Counter()
    for most in (0, 5, 400, 90, 400, 2):
        new, n = np.unique(rng.integers(0, 300, most).astype(np.uint64), return_counts=True)
        keys, counts = ctw.added(keys, counts, new, n.astype(np.uint32))
        all_of.update(dict(zip(new.tolist(), n.tolist(), strict=True)))
    assert list(zip(keys.tolist(), counts.tolist(), strict=True)) == sorted(all_of.items())


# 4: decontamination


def brute_hits(text: str, items: list[tuple[int, str]], window: int = 10) -> tuple[int, int, set[str]]:
    words, hit, found = fmindex.words_of(text.encode()), set(), set()
    for key, body in items:
        w = fmindex.words_of(body.encode())
        for i in range(max(1, len(w) - window + 1) if w else 0):
            x = w[i : i + window]
            for j in range(len(words) - len(x) + 1):
                if words[j : j + len(x)] == x:
                    hit.update(range(j, j + len(x)))
                    found.add(str(key))
    return len(words), len(hit), found


def test_fm_index_by_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        items = [(k, " ".join(rng.choices("a b c A é".split(), k=rng.randint(0, 9)))) for k in range(4)]
        texts = [" ".join(rng.choices("a b c é zz".split(), k=rng.randint(0, 40))) for _ in range(6)]
        blocks = [fmindex.Phrases.compile([(k, t.encode()) for k, t in part], 4) for part in (items[:2], items[2:])]
        n, spans, found = fmindex.shard_hits([t.encode() for t in texts], blocks)
        for t, words, s, f in zip(texts, n, spans, found, strict=True):
            assert (words, int((s[:, 1] - s[:, 0]).sum()), f) == brute_hits(t, items, 4)


def test_decontamination_cuts_spans(spark, odd, empty):
    items = spark.createDataFrame([(1, "THE same, text here"), (2, None), (3, ""), (None, "word word")], "item_id long, text string")
    out = fmindex.remove_contamination(odd.unionByName(spark.createDataFrame([(20, "Keep this. The same text here, and that.", "en", "s", 0)], SCHEMA)), items)
    kept = [(r.doc_id, r.text, r.n_chars) for r in out.collect()]
    assert out.columns == odd.columns and (20, "Keep this. , and that.", 22) in kept
    assert sorted(k[0] for k in kept if k[0]) == [4, 5, 6, 7, 9, 20]
    found = {r.doc_id: r for r in fmindex.find_contamination(odd, items).collect()}
    assert found[1].items == ["1"] and found[8].n_hit == 60_000 and found[8].items == [] and found[4].n_words == 0
    assert fmindex.find_contamination(empty, items).count() == 0 and not fmindex.find_contamination(odd, items.where("false")).where("contaminated").count()
    blocks = fmindex.find_contamination(odd, items, block_bytes=1)
    assert {(r.doc_id, r.n_hit) for r in blocks.collect()} == {(r.doc_id, r.n_hit) for r in fmindex.find_contamination(odd, items).collect()}


# 5: SentencePiece


@pytest.fixture(scope="module")
def model_file():
    return queries.tokenizer_path("piece_bpe_32k.model")


def test_pieces_equal_library(model_file, duck):
    import sentencepiece

    codec, library = pieces.Codec(pieces.Definition.read(model_file)), sentencepiece.SentencePieceProcessor(model_file=model_file)
    rng = random.Random(2)
    letters = [*"aethn rsi▁  \n\t<>0x1é😀門ñ", "  ", "the", "    ", "<unk>", "<s>", "<0x41>", "\u0301"]
    texts = ["", " ", *(t for _, t in small_docs(duck)), *("".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(3000))]
    for text in texts:
        ids = codec.encode(text)
        assert ids == library.encode(text) and codec.decode(ids) == library.decode(ids)
        assert codec.decode(ids) == text.replace("▁", " ")


def test_pieces_of_new_words_are_cut_together(model_file, monkeypatch):
    """Words that begin alike are cut in order and share what they have found so far, with a memory of any size."""
    import sentencepiece

    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return super().get(key)

    library, rng = sentencepiece.SentencePieceProcessor(model_file=model_file), random.Random(8)
    codec = pieces.Codec(pieces.Definition.read(model_file))
    codec.fits = Counted()
    begin = "".join(rng.choices("aehinrst", k=40))
    words = [begin + "".join(rng.choices("aehinrst", k=5)) for _ in range(300)]
    odd = ["", " ", "  two  spaces ", "a\nb", "門 <unk>", begin * 3, words[0]]
    for memory in (0, 50, 1000):
        monkeypatch.setattr(pieces, "MEMORY", memory)
        texts = [" ".join(words[:200]), *odd, " ".join(words[100:])]
        assert codec.encode_all(texts) == [library.encode(t) for t in texts] and len(codec.after_space) <= max(memory, 1)
    codec.after_space.clear()
    Counted.asked = 0
    codec.encode_all([" ".join(words)])
    together, Counted.asked = Counted.asked, 0
    for word in set(words):
        codec.cut(pieces.SPACE + word)
    assert together < 0.3 * Counted.asked


def test_pieces_of_a_batch_take_few_passes(model_file, duck):
    """The automaton passes over all new words of a batch together, odd characters among them; a worker's next task has nothing to learn."""
    import sentencepiece

    class Counted:
        passes = 0

        def __init__(self, automaton):
            self.automaton = automaton

        def iter(self, text):
            self.passes += 1
            return self.automaton.iter(text)

    library, rng = sentencepiece.SentencePieceProcessor(model_file=model_file), random.Random(9)
    definition = pieces.Definition.read(model_file)
    codec = pieces.Codec(definition)
    codec.automaton = Counted(codec.automaton)
    texts = [*(t for _, t in small_docs(duck)), "\x00a \x01", "🄰x🄰🄱 y🄰", *(" ".join("".join(rng.choices([*"aethnrsé😀門ñ\n\t", "\x00", "🄰"], k=rng.randint(1, 12))) for _ in range(60)) for _ in range(30))]
    texts = [t.strip(" ") for t in texts if t.strip(" ") and "  " not in t.strip(" ") and max(map(len, t.split(" "))) < 60]
    wanted = [library.encode(t) for t in texts]
    assert codec.encode_all(texts) == wanted and codec.automaton.passes < 5 and len(texts) > 200
    found, pairs = codec.encode_arrays(texts), len(codec.pairs)
    assert [x.tolist() for x in found] == wanted and len(codec.pairs) == pairs > 1000
    same = lambda ids: codec.decode_to(np.concatenate(ids), list(map(len, ids)), [t.encode() for t in texts])
    assert all(same(found))
    assert same([found[1], found[0], *found[2:]]) == [False, False] + [True] * (len(texts) - 2)
    assert pieces.codec_of(definition, codec.whole) is pieces.codec_of(pieces.Definition.read(model_file), frozenset(codec.whole))


def test_unigram_viterbi_by_brute_force():
    rng = random.Random(4)
    names = ["a", "b", "c", "ab", "bc", "abc", "ca", "▁", "▁a", "▁ab", "cab"]
    d = pieces.Definition(("<unk>", *names), (0.0, *(-rng.random() * 5 for _ in names)), (pieces.UNKNOWN, *[pieces.NORMAL] * len(names)), pieces.UNIGRAM, False, True, False, True, "identity")
    codec, scores = pieces.Codec(d), dict(zip(d.pieces, d.scores, strict=True))

    def best(text: str) -> float:
        table = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            for begin in range(end):
                if text[begin:end] in scores:
                    table[end] = max(table[end], table[begin] + scores[text[begin:end]])
        return table[-1]

    for _ in range(500):
        text = "".join(rng.choices("abc ", k=rng.randint(1, 12)))
        ids = codec.encode(text)
        assert codec.decode(ids) == text and sum(d.scores[i] for i in ids) == pytest.approx(best("▁" + text.replace(" ", "▁")))
    assert codec.encode("xyza") == [codec.ids["▁"], 0, codec.ids["a"]]


def test_pieces_of_odd_rows(odd, empty, model_file):
    out = pieces.encode_documents(odd, model_file).collect()
    assert len(out) == len(ODD) and all(r.decodes_to_text for r in out) and min(r.n_pieces for r in out) == 0
    assert pieces.encode_documents(empty, model_file).count() == 0


# 6: toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(1500):
        words, toxic = rng.choices(plain, k=rng.randint(5, 60)), int(rng.random() < 0.2)
        if toxic:
            words.insert(rng.randint(0, 5), rng.choice(["vilename", "vilenames", "otherslur"]))
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    scored = {r.doc_id: r.score for r in toxicity.score_documents(docs, machine).collect()}
    held = [(y, scored[i]) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == (y == 1) for y, s in held) >= 0.97 * len(held)
    assert toxicity.keep_harmless(docs, machine).columns == docs.columns


def test_machine_learns_interactions():
    """Either of two terms makes a row toxic, both or none do not: no sum of weights can tell, an interaction can."""
    a, b = 11, 22
    docs = [toxicity.bag(x) for x in ([a], [b], [a, b], [], [], [])] * 100
    m = toxicity.fit(docs, np.array([1, 1, 0, 0, 0, 0] * 100))
    raw = lambda x: m.raw(np.zeros(len(x), np.int64), np.array([m.terms[t] for t in x], np.int64), np.ones(len(x)), 1)[0]
    assert min(raw([a]), raw([b])) > 0 > max(raw([a, b]), raw([]))
    assert raw([a, b]) - raw([a]) - raw([b]) + m.bias == pytest.approx(float(m.factors[m.terms[a]] @ m.factors[m.terms[b]]))


def test_pair_that_linear_weights_miss(spark):
    """Two words that say nothing alone: of held-out rows, exclusive-or is told by the pair, which selection by weights would not see."""
    rng = random.Random(21)
    rows = []
    for i in range(3000):
        first, second = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(3000)}" for _ in range(20)] + ["insult"] * first + ["people"] * second
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(first != second)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    scored = {r.doc_id: r.score for r in toxicity.score_documents(docs, machine).collect()}
    held = [(y, scored[i]) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == (y == 1) for y, s in held) >= 0.8 * len(held)


def test_scores_by_brute_force():
    """raw() and score() against the definition, pair by pair."""
    rng = np.random.default_rng(3)
    texts = [b"Vile names vile", b"", b"other words here and here"]
    found = sorted({t for text in texts for t in toxicity.counted(text, toxicity.Terms())})[::2]
    m = toxicity.Machine({t: i for i, t in enumerate(found)}, -0.3, rng.normal(size=len(found)), rng.normal(size=(len(found), 4)))
    for text, score in zip(texts, m.score(texts, toxicity.Terms(m.terms)), strict=True):
        n = Counter(m.terms[t] for w in set(fmindex.words_of(text)) for t in toxicity.terms_of(w) if t in m.terms)
        x = {i: round(8 * math.log2(1 + k)) / 8 for i, k in n.items()}
        raw = m.bias + sum(m.weights[i] * v for i, v in x.items()) + sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for i in x for j in x if i < j)
        assert score == pytest.approx(1 / (1 + math.exp(-raw)))


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    for some in (labels, labels.where("false")):
        machine = toxicity.train(odd, some)
        out = toxicity.score_documents(odd, machine).collect()
        assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
        assert toxicity.score_documents(empty, machine).count() == 0


# 7: token counts


def test_token_counts_equal_library(spark, odd, empty, duck):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in small_docs(duck)}
    assert {r.doc_id: r.n_tokens for r in queries.op7_token_counts(spark, SMALL).collect()} == want
    out = tokens.count_tokens(odd, path).collect()
    assert Counter(r.n_tokens for r in out) == Counter(len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in ODD)
    assert [r.n_bytes for r in out if r.doc_id == 4] == [0] and [r.over_limit for r in out if r.doc_id == 8] == [True]
    assert tokens.count_tokens(empty, path).count() == 0
    whole = tokens.whole_tokens(library)
    assert len(whole) > 30_000 and all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(1).sample(sorted(whole), 500))


def test_token_counts_of_any_characters():
    """Random code points, among them ones that are newer than some tables of classes, counted as the library does."""
    from pathlib import Path

    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    counter = tokens.Counter(Path(path).read_text(), tokens.whole_tokens(library))
    rng = random.Random(17)
    points = [p for p in range(0x32400) if not 0xD800 <= p < 0xE000]
    for k in range(30_000):
        text = "".join(chr(rng.choice(points[:0x3000] if k % 2 else points)) for _ in range(rng.randint(1, 6)))
        text = rng.choice(["", "갓", "a", "1 ", "<|endoftext|>"]) + text
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), ascii(text)


def test_settled_characters_have_the_library_s_class():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    split, bad = tokens.regex.compile(tokens.PATTERN), []
    for p in range(0x20, 0x110000):
        c = chr(p)
        if not 0xD800 <= p < 0xE000 and not c.isascii() and tokens.settled(c):
            n = tokens.normalised("a" + c + " " + c + c)
            if len(split.findall(n)) != len(library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str("a" + c + " " + c + c))):
                bad.append(hex(p))
    assert not bad


# 8: SimHash


def brute_simhash(rows: list[tuple[int, str]], words: int = 3) -> set[tuple[int, str, int]]:
    import xxhash

    def fp(text: str) -> int:
        w = text.encode().lower().split()
        runs = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {d: fp(t) for d, t in rows}
    component: dict[int, int] = {}
    for d in sorted(prints):
        line = [] if d in component else [d]
        while line:
            x = line.pop()
            component[x] = d
            line += [y for y in prints if y not in component and (prints[x] ^ prints[y]).bit_count() <= 2]
    return {(d, f"{p:016x}", component[d]) for d, p in prints.items()}


def test_simhash_query_by_brute_force(spark, duck):
    out = {tuple(r) for r in queries.op8_simhash(spark, SMALL).collect()}
    assert out == brute_simhash(small_docs(duck))


def test_trie_join_by_brute_force(spark):
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(20)]
    values = sorted({c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(8)} | set(centres))
    want = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    v = np.array(values, np.uint64)
    got = {(values[i], values[j]) for i, j in np.sort(simhash.trie_pairs(v, np.array([0]), np.array([len(v)]), 0, 2), axis=1).tolist()}
    assert got == want
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in values], "fp long")
    for hot in (simhash.HOT, 0):
        found = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.links(frame, hot=hot).collect()}
        assert found <= want
        parent = {x: x for x in values}

        def root(x: int, parent: dict = parent) -> int:
            return x if parent[x] == x else root(parent[x])

        for a, b in found:
            parent[root(a)] = root(b)
        assert all(root(a) == root(b) for a, b in want)


def test_near_copies(spark, odd, empty):
    out = simhash.near_groups(odd).collect()
    assert len(out) == len(ODD) and {r.component_id for r in out if r.fp == 0} == {4}
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    near = [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in (10, 100, 200)]
    texts = [" ".join(base), *near, *(" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(20)), " ".join(base)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, _at string, c0 string")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, *range(4, 24)]
    assert simhash.drop_near_copies(empty).count() == 0 and simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("crowd", [simhash.CROWD, 450, 150])
def test_similar_groups_by_brute_force(spark, crowd):
    """Texts around a similarity of 0.8 are linked if and only if they reach it, or their fingerprints link them; crowded components too."""
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for changed in (0, *rng.sample(range(1, 12), 3)):
            words = list(base)
            for k in range(changed):
                words[10 + 16 * k] = f"n{rng.randrange(5000)}"
            texts.append(" ".join(words))
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    prints = [simhash.fingerprint(t.encode(), 3) for t in texts]
    root = list(range(len(texts)))
    linked = missed = 0
    for a in range(len(texts)):
        for b in range(a):
            similar = 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
            linked, missed = linked + similar, missed + (not similar and len(sets[a] & sets[b]) > 0)
            if similar or (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert linked > 30 and missed > 30
    out = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), crowd=crowd).collect()
    of = {r.doc_id: r.group for r in out}
    assert len({(root[i], of[i]) for i in of}) == len(set(root)) == len(set(of.values()))


def test_near_copies_keep_and_move_little(spark, monkeypatch):
    """No stored table holds the texts, which are read again from their places."""
    kept, staged = {}, simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, name, *rest: kept.setdefault(name, staged(df, name, *rest)))
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(base), " ".join([*base[:50], "new", *base[51:]]), " ".join(f"w{rng.randrange(5000)}" for _ in range(200)), None]
    docs = tables.staged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test-docs")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == [0, 2, 3]
    assert "binary" not in {t for name in ("shingles", "candidates") for c, t in kept[name].dtypes if c != "set"}
    rows = simhash.similar_groups(docs.withColumn("at_", F.lit("x")).withColumnRenamed("at_", "_at")).collect()
    assert len(rows) == 4 and len({r.group for r in rows}) == 3


# 9: exact dedup


def test_exact_groups(spark, odd, empty):
    out = exact.exact_groups(odd).collect()
    assert len(out) == len(ODD) and len({r._at for r in out}) == len(ODD)
    size = Counter((t or "") for _, t, *_ in ODD)
    digest = {hashlib.sha256(t.encode()).digest(): t for t in size}
    for r in out:
        text = digest[bytes(r.digest)]
        assert r.group_size == size[text] and r.keep_id == max((d for d, t, *_ in ODD if (t or "") == text and d is not None), default=None)
    assert sum(r.kept for r in out) == len(size)
    assert exact.exact_groups(empty).count() == 0
    clash = odd.withColumnRenamed("lang", "_at").withColumnRenamed("source", "_maybe")
    kept = exact.drop_exact_copies(clash)
    assert kept.columns == clash.columns and kept.count() == len(size)


def test_exact_survives_digest_collisions(odd):
    weak = lambda body: F.unhex(F.hex(F.length(body) % 2))
    out = exact.exact_groups(odd, digest=weak).collect()
    size = Counter((t or "") for _, t, *_ in ODD)
    assert sum(r.kept for r in out) == len(size) and len(out) == len(ODD)
    assert Counter(r.group_size for r in out) == Counter(size[t or ""] for _, t, *_ in ODD)


def test_exact_compares_copies_where_they_are(spark, monkeypatch):
    """Bodies of equal digests meet once, without the copies that a task can count itself."""
    kept, staged = {}, exact.staged
    monkeypatch.setattr(exact, "staged", lambda df, name, *rest: kept.setdefault(name, (df, staged(df, name, *rest)))[1])
    docs = tables.staged(spark.createDataFrame([(i, "same" if i % 2 else f"other {i}") for i in range(100)], "doc_id long, text string"), "test-docs")
    assert exact.drop_exact_copies(docs).count() == 51
    plan = kept["unequal"][0]._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan.replace("BroadcastHashJoin", "") and plan.count("HashAggregate") >= 2


def test_state_takes_only_new_files(spark, tmp_path):
    log, state = str(tmp_path / "log"), tables.new_path(spark, "test-state")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, at string, digest binary")
    frame([(1, "a", b"x"), (2, "b", b"y")]).write.parquet(log)
    exact.run_state(spark, log, frame([]).schema, state)
    frame([(3, "c", b"x")]).write.mode("append").parquet(log)
    out = {bytes(r.digest): (r.keep.doc_id, r.group_size) for r in exact.run_state(spark, log, frame([]).schema, state).collect()}
    assert out == {b"x": (3, 2), b"y": (2, 1)}


def test_state_is_a_table_that_stays(spark, tmp_path):
    """The state's stores are not opened again to read it; a call without new files returns the whole table, and earlier ones stay."""
    log, state = str(tmp_path / "log"), tables.new_path(spark, "test-state")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, at string, digest binary")
    got = lambda df: {bytes(r.digest): (r.keep.doc_id, r.keep.at, r.group_size) for r in df.collect()}
    frame([(1, "a", b"x"), (None, "b", b"y"), (None, "c", b"y")]).write.parquet(log)
    first = exact.run_state(spark, log, frame([]).schema, state)
    assert "StateTable" not in first._jdf.queryExecution().toString()
    for n in range(12):  # batches count on beyond one digit
        frame([(n, "d", b"z")]).write.mode("append").parquet(log)
        exact.run_state(spark, log, frame([]).schema, state)
    again = exact.run_state(spark, log, frame([]).schema, state)
    assert got(again) == {b"x": (1, "a", 1), b"y": (None, "c", 2), b"z": (11, "d", 12)}
    assert got(first) == {b"x": (1, "a", 1), b"y": (None, "c", 2)}


# 10: URLs


def test_urls_odd_rows(spark):
    rules = [urls.Rule(*r) for r in queries.URL_RULES] + [urls.Rule("block", "dup.org", "/"), urls.Rule("allow", "dup.org", "/")]
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/en/": ("", "", None, "allow"),
        "http://WWW.Example.COM/en/x?y": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "x://net#/es/": ("net", "", None, "allow"), "x://a.net/es/?://b": ("a.net", "/es/", "net/es/", "block"),
        "http://com": ("com", "", None, "allow"), "http://dup.org/": ("dup.org", "/", "dup.org/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, rules).collect()}
    assert [out[i] for i in range(len(cases))] == list(cases.values())
    assert urls.filter_urls(pages.where("false"), rules).count() == 0 and {r.verdict for r in urls.filter_urls(pages, [], default="block").collect()} == {"block"}


def test_many_rules_from_a_table(spark):
    """A table of rules, repeated ones among them, is sorted by Spark; digests are in unsigned order."""
    rules = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("action"), F.concat(F.lit("H"), F.floor(F.col("id") / 4), F.lit(".org")).alias("host"), F.lit("/").alias("path"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), "id", F.lit(".org/"), F.repeat(F.lit("x"), 2000)).alias("url"))
    out = urls.filter_urls(pages.unionByName(pages), rules).collect()
    assert len(out) == 12_000 and all((r.rule, r.verdict) == ((f"h{r.page_id}.org/", "block") if r.page_id < 5000 else (None, "allow")) for r in out)
    with pytest.raises(Exception, match="allow or block"):
        urls.filter_urls(pages, [urls.Rule("drop", "a.b")])


def test_digest_collisions_are_confirmed(spark, tmp_path):
    files, lengths = urls.DigestIndex.write(urls.ordered_rules(spark, [urls.Rule("block", "a.b"), urls.Rule("allow", "c.d", "/x")]), tmp_path, "t")
    index = urls.DigestIndex.open(map(str, files), lengths)
    assert isinstance(index.digests, np.memmap)
    index.digests = np.array([np.uint64(7)] * 2)
    original = urls.digest_of
    urls.digest_of = lambda _: 7
    try:
        assert index.find([urls.key_of(b"c.d", b"/x"), urls.key_of(b"a.b", b""), b"other"]) == ["allow", "block", None]
    finally:
        urls.digest_of = original
