"""Toxicity by a factorization machine over hashed terms: weights for terms and learned interactions of their pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.fmindex import words_of
from quaestor.llm.tables import bytes_of, in_arrow, no_clash, quoted, slices, staged, tidy

BUCKETS = 1 << 20
#: Bytes of the word beginnings that are terms beside the whole word; inflected forms share them.
STEMS = (3, 4, 5, 6, 7, 8)
#: Labelled rows that the model is fitted on at most: those whose ids hash lowest. Scores cover all rows.
MAX_TRAINING = 12_000
FACTORS = 8
#: Terms, the most frequent of those that at most half of the training rows hold, whose pairs are searched for signals that
#: no sum of weights can show; rows that a pair needs, how many standard errors its residuals must add up to, and pairs taken.
PAIR_TERMS, PAIR_ROWS, PAIR_ERRORS, PAIRS = 1024, 10, 8.0, 256
#: Words whose terms a task remembers.
MEMORY = 60_000


def terms_of(word: bytes) -> set[int]:
    """Hash buckets of a word: the word itself, and its beginnings."""
    digest = xxhash.xxh64_intdigest
    return {digest(b"w" + word) % BUCKETS, *(digest(b"p" + word[:n]) % BUCKETS for n in STEMS if n <= len(word))}


class Terms(dict):
    """Terms by word, remembered up to MEMORY words; with `wanted`, places in the model of those it holds."""

    def __init__(self, wanted: dict[int, int] | None = None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = terms_of(word)
        out = tuple(found) if self.wanted is None else tuple(self.wanted[t] for t in found if t in self.wanted)
        if len(self) < MEMORY and len(word) < 100:
            self[word] = out
        return out


def counted(text: bytes, terms: Terms) -> list[int]:
    """The terms of a text's distinct words, one entry for each word that has the term."""
    return [t for found in filter(None, map(terms.__getitem__, set(words_of(text)))) for t in found]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def amount(counts: np.ndarray) -> np.ndarray:
    """What a term weighs that so many words have: 1 for one word, and one more each time the number doubles or so, in eighths."""
    return np.round(8 * np.log2(1.0 + counts)) / 8


@dataclass
class Machine:
    """score = sigmoid(bias + sum w_i x_i + sum over pairs of <v_i, v_j> x_i x_j), x: amount() of the words with the term."""

    terms: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        linear = np.bincount(rows, values * self.weights[columns], n)
        pairs = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = values * self.factors[columns, f]
            pairs += np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n)
        return self.bias + linear + pairs / 2

    def score(self, texts: list[bytes], terms: Terms) -> np.ndarray:
        rows, columns = [], []
        for i, text in enumerate(texts):
            found = counted(text, terms)
            rows += [i] * len(found)
            columns += found
        if not rows:
            return np.full(len(texts), sigmoid(np.array(self.bias)))
        width = max(1, len(self.weights))
        cells, values = np.unique(np.array(rows) * width + np.array(columns), return_counts=True)
        return sigmoid(self.raw(cells // width, cells % width, amount(values), len(texts)))


#: A row's distinct terms, and the amount() of each in eighths, which a byte holds for any count.
Bag = tuple[np.ndarray, np.ndarray]


def bag(found: list[int]) -> Bag:
    terms, counts = np.unique(np.array(found, np.int32), return_counts=True)
    return terms, (8 * amount(counts)).astype(np.uint8)


def select_terms(docs: list[Bag], labels: np.ndarray, passes: int = 4, l1: float = 8.0, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that a sparse logistic regression (FTRL-proximal, McMahan et al. 2013) keeps, trained in small batches, and what it leaves unexplained of each row."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    order = np.random.default_rng(7).permutation(len(docs))
    weigh = lambda i: np.where(np.abs(z[i]) > l1, -(z[i] - np.sign(z[i]) * l1) / ((1.0 + np.sqrt(n[i])) / rate + 1e-3), 0.0)
    for _ in range(passes):
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            sizes = np.array([len(docs[i][0]) for i in part])
            ids = np.concatenate([docs[i][0] for i in part])
            used, where = np.unique(ids, return_inverse=True)
            w = weigh(used)
            rows = np.repeat(np.arange(len(part)), sizes)
            p = sigmoid(bias + np.bincount(rows, w[where], len(part)))
            g = np.bincount(where, (p - labels[part])[rows], len(used))
            step = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / rate
            z[used] += g - step * w
            n[used] += g * g
    rest = np.array([y - sigmoid(bias + weigh(terms).sum()) for (terms, _), y in zip(docs, labels, strict=True)])
    return np.flatnonzero(np.abs(z) > l1), rest - rest.mean()


def paired_terms(docs: list[Bag], rest: np.ndarray) -> np.ndarray:
    """Buckets of pairs of terms in whose common rows the residuals add up to much: signals of a pair that its terms alone don't carry."""
    met = np.bincount(np.concatenate([t for t, _ in docs]), minlength=BUCKETS)
    common = np.flatnonzero((met >= PAIR_ROWS) & (2 * met <= len(docs)))
    common = common[np.argsort(-met[common], kind="stable")[:PAIR_TERMS]]
    place = np.full(BUCKETS, -1, np.int32)
    place[common] = np.arange(len(common))
    sums, squares, both = (np.zeros((len(common), len(common)), np.float32) for _ in range(3))
    for at in range(0, len(docs), 1000):
        held = np.zeros((len(docs[at : at + 1000]), len(common)), np.float32)
        for i, (terms, _) in enumerate(docs[at : at + 1000]):
            own = place[terms]
            held[i, own[own >= 0]] = 1
        r = rest[at : at + 1000, None].astype(np.float32)
        sums += (held * r).T @ held
        squares += (held * r * r).T @ held
        both += held.T @ held
    alone = both == np.minimum(*np.meshgrid(both.diagonal(), both.diagonal()))  # a term that is never without the other one is no pair
    errors = np.where((both >= PAIR_ROWS) & ~alone, np.abs(sums) / np.sqrt(squares + 1e-6), 0)
    pairs = np.flatnonzero(np.triu(errors, 1) >= PAIR_ERRORS)
    pairs = pairs[np.argsort(-errors.ravel()[pairs], kind="stable")[:PAIRS]]
    return common[np.unique(np.concatenate(np.divmod(pairs, max(1, len(common)))))]


def fit(docs: list[Bag], labels: np.ndarray, factors: int = FACTORS, passes: int = 200, rate: float = 0.03) -> Machine:
    """A machine over the selected terms, fitted by Adam (Kingma and Ba, 2015). Rows of either label count the same in total.

    Terms are those that carry weight alone and those that do in pairs. Without both labels there is nothing to learn: the
    score is then the share of label 1, smoothed.
    """
    labels = labels.astype(float)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    plain = Machine({}, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, factors)))
    if len(set(labels.tolist())) < 2:
        return plain
    kept, rest = select_terms(docs, labels)
    kept = np.union1d(kept, paired_terms(docs, rest))
    if not len(kept):
        return plain
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    width, n = len(kept), len(docs)
    parts = []  # the rows' amounts, 1,000 rows at a time
    for begin in range(0, n, 1000):
        held = np.zeros((len(docs[begin : begin + 1000]), width), np.float32)
        for i, (terms, eighths) in enumerate(docs[begin : begin + 1000]):
            at = place[terms]
            held[i, at[at >= 0]] = eighths[at >= 0] / 8
        parts.append((begin, held))
    m = Machine({int(t): i for i, t in enumerate(kept)}, plain.bias, np.zeros(width), np.random.default_rng(11).normal(0, 0.1, (width, factors)))
    balance = np.where(labels == 1, min(10.0, n / (2 * labels.sum())), n / (2 * (n - labels.sum())))
    balance /= balance.mean()
    state = [np.concatenate([[m.bias], m.weights, m.factors.ravel()])]
    state += [np.zeros_like(state[0]), np.zeros_like(state[0])]
    for step in range(1, passes + 1):
        weights, v = m.weights.astype(np.float32), m.factors.astype(np.float32)
        g_b, g_w, g_v = 0.0, 1e-5 * n * m.weights, 1e-4 * n * m.factors
        for begin, x in parts:
            total, squares = x @ v, x * x
            raw = m.bias + x @ weights + ((total * total).sum(1) - squares @ (v * v).sum(1)) / 2
            error = (balance[begin : begin + 1000] * (sigmoid(raw) - labels[begin : begin + 1000])).astype(np.float32)
            g_b += error.sum()
            g_w += x.T @ error
            g_v += x.T @ (error[:, None] * total) - v * (squares.T @ error)[:, None]
        g = np.concatenate([[g_b], g_w, g_v.ravel()]) / n
        state[1] = 0.9 * state[1] + 0.1 * g
        state[2] = 0.999 * state[2] + 0.001 * g * g
        state[0] = state[0] - rate * (state[1] / (1 - 0.9**step)) / (np.sqrt(state[2] / (1 - 0.999**step)) + 1e-8)
        m.bias, m.weights, m.factors = float(state[0][0]), state[0][1 : width + 1], state[0][width + 1 :].reshape(width, factors)
    return m


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", rows: int = MAX_TRAINING) -> Machine:
    """The machine learned from labelled rows that are not held out: at most `rows`, by the hash of their ids.

    Only ids and labels of those rows go to the executors, only their terms come back, row by row from a written table;
    other columns are not read. Null labels and ids are left out. A label table that names an id several times counts
    the largest label. Texts of any length are taken whole; null and empty ones have no terms. Rows with equal ids all
    count, up to `rows`. Without labels the score is even.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.where(~is_held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in (part for whole in batches for part in slices(whole, "text")):
            bags = [bag(counted(t.as_py(), terms)) for t in bytes_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.tobytes() for t, _ in bags], pa.binary()), pa.array([c.tobytes() for _, c in bags], pa.binary())], names=["doc_id", "label", "terms", "counts"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    found = staged(in_arrow(texts, work, f"doc_id {kind}, label int, terms binary, counts binary"), "bags")
    held = sorted(((xxhash.xxh64_intdigest(str(r["doc_id"])), bytes(r["terms"]), bytes(r["counts"]), r["label"]) for r in found.toLocalIterator()))[:rows]
    machine = fit([(np.frombuffer(t, np.int32), np.frombuffer(c, np.uint8)) for _, t, c, _ in held], np.array([y for *_, y in held], np.int64))
    del held
    tidy()
    return machine


def score_documents(docs: DataFrame, machine: Machine, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row's `keep` columns and `score`, from 0 to 1, of its whole text, whatever its length.

    Null, empty and wordless texts have no terms and get the score of the bias. Rows are scored each for itself, so
    repeated rows and equal ids are alike, and no column but the text is looked at. An empty table gives no rows.
    """
    no_clash(keep, "score")
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        terms = Terms(m.terms)
        for batch in (part for whole in batches for part in slices(whole, "_text")):
            scores = m.score(bytes_of(batch.column(len(keep))).to_pylist(), terms)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, "score"])

    rows = docs.select(*map(quoted, keep), F.col(quoted(text)).alias("_text"))
    head = ", ".join(f"{quoted(c)} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return in_arrow(rows, work, f"{head}, score double")


def keep_harmless(docs: DataFrame, machine: Machine, text: str = "text", limit: float = 0.5) -> DataFrame:
    """docs, all columns whatever their names, without the rows that score `limit` or more; rows as in score_documents()."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        terms = Terms(m.terms)
        for batch in (part for whole in batches for part in slices(whole, text)):
            yield batch.filter(pa.array(m.score(bytes_of(batch.column(at)).to_pylist(), terms) < limit))

    return in_arrow(docs, work, docs.schema)
