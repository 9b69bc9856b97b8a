"""SentencePiece encoding and decoding by an Aho-Corasick automaton over the pieces.

One pass over a text follows the automaton's output links: at each position they name every piece that ends there, and
each piece relaxes the position's entry from the entry where the piece begins.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, groupby, pairwise
from pathlib import Path
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.tables import bytes_of, gathered, in_arrow, no_clash, quoted

SPACE = "▁"
#: Words, and pairs of neighbouring pieces, that a worker remembers.
MEMORY, PAIRS = 100_000, 1 << 20
#: Bytes of texts that are encoded together, and characters of new words that one pass cuts.
TOGETHER, PASS = 1 << 20, 1 << 17
#: Characters from which on a word is not remembered.
LONG = 60
#: Fixed values of the model file's format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of each field of a protocol buffers message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = message[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, message[at : at + size]
            at += size


@dataclass(frozen=True)
class Definition:
    """What a model file defines."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    model: int
    byte_fallback: bool
    prefix: bool
    squeeze: bool
    escape: bool
    normaliser: str

    @classmethod
    def read(cls, path: str) -> Definition:
        pieces, scores, kinds, trainer, rules = [], [], [], {}, {}
        for number, value in fields(Path(path).read_bytes()):
            if number == 1:
                entry = dict(fields(value))
                pieces.append(entry[1].decode())
                scores.append(struct.unpack("<f", entry.get(2, bytes(4)))[0])
                kinds.append(entry.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                rules = dict(fields(value))
        out = cls(tuple(pieces), tuple(scores), tuple(kinds), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1)), rules.get(1, b"").decode())
        if out.normaliser != "identity" or out.model not in (UNIGRAM, BPE) or USER in kinds:
            raise ValueError("models of kind unigram or BPE with identity normalisation and no user-defined pieces are read")
        return out


class Codec:
    """Encodes and decodes with one model.

    Unigram models: of the ways to cut a text into pieces the one with the highest total score, by Viterbi relaxation.
    BPE models: scores rank merges and do not add up, so the highest total would not be the model's encoding. A piece
    then relaxes a position only if the merges of its predecessor's and its own text give exactly these two; a cut
    whose neighbours all fit is the model's encoding, and only one piece per position fits.
    A text is passed over in chunks that begin with its spaces, as no piece holds a space after another character.
    """

    def __init__(self, definition: Definition, whole: frozenset[str] | None = None):
        """whole: the pieces that merges of their own letters make, worked out anew if they are not given."""
        d = self.definition = definition
        usable = [i for i, k in enumerate(d.kinds) if k == NORMAL and d.pieces[i]]
        self.ids = {d.pieces[i]: i for i in usable}
        self.rank = {p: d.scores[i] for p, i in self.ids.items()}.get
        self.bytes = {int(d.pieces[i][3:5], 16): i for i, k in enumerate(d.kinds) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(d.kinds) if k == UNKNOWN), 0)
        self.fallback = d.byte_fallback and len(self.bytes) == 256
        self.chunked = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.whole = whole or frozenset(p for p in self.ids if d.model == UNIGRAM or len(p) == 1 or self.merged(p) == [p])
        for p in self.whole:
            if d.model == UNIGRAM or len(p) > 1:
                self.automaton.add_word(p, self.ids[p])
        self.automaton.make_automaton()
        self.letters = frozenset(p for p in self.ids if len(p) == 1)
        self.after_space = Remembered(self)
        self.texts = [self._spoken(i) for i in range(len(d.pieces))]
        self.sizes = np.array(list(map(len, d.pieces)), np.int32)
        self.length_of = self.sizes.tolist().__getitem__
        self.letter_ids = np.full(0x110000, -1, np.int32)
        for p in self.letters:
            self.letter_ids[ord(p)] = self.ids[p]
        used = set("".join(d.pieces))
        self.border = next(c for c in map(chr, range(0x110000)) if c not in used)
        self.pairs, self.pair_fits = np.array([np.iinfo(np.int64).max]), np.zeros(1, bool)
        said = (t.replace(SPACE, " ") if d.escape else t for t in self.texts)
        self.spoken = pa.array([t.encode("utf-8", "surrogateescape") for t in said], pa.large_binary())

    def _spoken(self, i: int) -> str:
        """What decoding makes of an id; bytes of longer characters wait as lone surrogates until they are joined."""
        d = self.definition
        if d.kinds[i] == BYTE:
            byte = int(d.pieces[i][3:5], 16)
            return chr(byte) if byte < 128 else chr(0xDC00 + byte)
        return " \u2047 " if d.kinds[i] == UNKNOWN else "" if d.kinds[i] == CONTROL else d.pieces[i]

    def merged(self, text: str) -> list[str]:
        """A short text after all merges: each time the neighbours whose joint piece scores highest, the first of equals."""
        parts = list(text)
        rank, none = self.rank, float("-inf")
        joint = [rank(a + b, none) for a, b in pairwise(parts)]
        while joint and (best := max(joint)) > none:
            at = joint.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joint[at]
            if at:
                joint[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(joint):
                joint[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def fit(self, left: int, right: int) -> bool:
        """Whether the merges of two pieces' joint text give these two again."""
        key = left * len(self.definition.pieces) + right
        known = self.fits.get(key)
        if known is None:
            pair = [self.definition.pieces[left], self.definition.pieces[right]]
            known = self.merged("".join(pair)) == pair
            if len(self.fits) < MEMORY * 2:
                self.fits[key] = known
        return known

    def cut(self, chunk: str) -> list[int]:
        """Ids of the pieces of a chunk whose characters are all pieces themselves."""
        n = len(chunk)
        last, sizes = [-1] * (n + 1), [0] * (n + 1)
        if self.definition.model == UNIGRAM:
            scores, best = self.definition.scores, [0.0] * (n + 1)
            for end, i in self.automaton.iter(chunk):
                at, size = end + 1, self.length_of(i)
                total = best[at - size] + scores[i]
                if last[at] < 0 or total > best[at]:
                    best[at], last[at], sizes[at] = total, i, size
        else:
            self.relax(chunk, last, sizes)
        return self.path(n, last, sizes)

    def relax(self, chunk: str, last: list[int], sizes: list[int]) -> None:
        """Fills in a BPE model's entries.

        Single characters are not in its automaton: one stands wherever no longer piece fits, as one piece always does.
        """
        fits, width, ids, settled = self.fits.get, len(self.definition.pieces), self.ids, 0
        for end, i in self.automaton.iter(chunk):
            if end < settled:
                continue
            while settled < end:
                last[settled + 1], sizes[settled + 1] = ids[chunk[settled]], 1
                settled += 1
            size = self.length_of(i)
            begin = end + 1 - size
            if begin and not (self.fit(last[begin], i) if (known := fits(last[begin] * width + i)) is None else known):
                continue
            settled = end + 1
            last[settled], sizes[settled] = i, size
        while settled < len(chunk):
            last[settled + 1], sizes[settled + 1] = ids[chunk[settled]], 1
            settled += 1

    def path(self, at: int, last: list[int], sizes: list[int]) -> list[int]:
        out = []
        while at:
            out.append(last[at])
            at -= sizes[at]
        return out[::-1]

    def fit_all(self, keys: np.ndarray) -> np.ndarray:
        """fit() of many pairs, each as left * number of pieces + right. Up to PAIRS of them are remembered, in order."""
        at = np.searchsorted(self.pairs, keys)
        out, new = self.pair_fits[at], np.flatnonzero(self.pairs[at] != keys)
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            pairs = [[self.definition.pieces[i] for i in divmod(key, len(self.definition.pieces))] for key in fresh.tolist()]
            said = np.array([self.merged("".join(pair)) == pair for pair in pairs], bool)
            out[new] = said[back]
            if len(self.pairs) < PAIRS:
                at = np.searchsorted(self.pairs, fresh)
                self.pairs, self.pair_fits = np.insert(self.pairs, at, fresh), np.insert(self.pair_fits, at, said)
        return out

    def cut_all(self, chunks: list[str]) -> Iterator[bytes]:
        """cut() of each chunk of a BPE model, as 32-bit numbers, in passes over about PASS characters."""
        passes = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks))) // PASS
        for some in np.split(np.arange(len(chunks)), np.flatnonzero(np.diff(passes)) + 1):
            if len(some):
                yield from self.cut_pass(chunks[some[0] : some[-1] + 1])

    def cut_pass(self, chunks: list[str]) -> list[bytes]:
        """cut() of some chunks, at least one.

        The automaton passes once over all chunks, with a border between them that is in no piece. Entries are then
        relaxed for all chunks at once: by position in the chunk, and there the longest of the pieces that end first.
        """
        text, lengths = self.border.join(chunks), np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(lengths + 1) - lengths - 1
        last, sizes, settled = np.full(len(text) + 1, -1, np.int32), np.ones(len(text) + 1, np.int32), np.zeros(len(text) + 1, bool)
        last[1:] = self.letter_ids[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        if len(found):
            ends, ids = found[:, 0] + 1, found[:, 1]
            begins, first = ends - self.sizes[ids], np.repeat(starts, lengths + 1)[ends - 1]
            runs = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
            rank = np.arange(len(ends)) - np.repeat(runs, np.diff(np.append(runs, len(ends))))
            turn = (ends - first) * (int(rank.max()) + 1) + rank
            order = np.argsort(turn.astype(np.min_scalar_type(int(turn.max()))), kind="stable")
            turns = np.flatnonzero(np.diff(turn[order], prepend=-1))
            for some in np.split(order, turns[1:]):
                some = some[~settled[ends[some]]]
                begin, piece = begins[some], ids[some]
                fits = begin == first[some]
                inner = np.flatnonzero(~fits)
                fits[inner] = self.fit_all(last[begin[inner]] * np.int64(len(self.sizes)) + piece[inner])
                piece, at = piece[fits], ends[some[fits]]
                last[at], sizes[at], settled[at] = piece, self.sizes[piece], True
        taken, at, stop = np.zeros(len(text) + 1, bool), starts + lengths, starts
        while len(at):
            taken[at] = True
            at = at - sizes[at]
            at, stop = at[on := at > stop], stop[on]
        packed = last[taken].tobytes()
        edges = (np.append(0, np.cumsum(taken))[np.append(starts, len(text) + 1)] * 4).tolist()
        return [packed[i:j] for i, j in pairwise(edges)]

    def encoded(self, chunk: str) -> list[int]:
        """A chunk's ids. A character that is no piece stands alone: as its bytes, or unknown once for a run of such."""
        if self.letters.issuperset(chunk):
            return self.cut(chunk) if chunk else []
        out: list[int] = []
        for known, run in groupby(chunk, self.letters.__contains__):
            part = "".join(run)
            out += self.cut(part) if known else self.alone(part)
        return out

    def alone(self, run: str) -> list[int]:
        """Ids of a run of characters that are no pieces."""
        return [self.bytes[b] for b in run.encode()] if self.fallback else [self.unknown]

    def normalised(self, text: str) -> str:
        d = self.definition
        if d.squeeze:
            text = " ".join(filter(None, text.split(" ")))
        if d.prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if d.escape else text

    def chunks(self, text: str) -> Iterator[str]:
        if not self.chunked:
            yield text
            return
        words = text.split(SPACE)
        if words[0]:
            yield words[0]
        spaces = 1
        for w in words[1:]:
            if w:
                yield SPACE * spaces + w
                spaces = 1
            else:
                spaces += 1
        if spaces > 1:
            yield SPACE * (spaces - 1)

    def encode(self, text: str) -> list[int]:
        text = self.normalised(text)
        if self.chunked and text.startswith(SPACE):
            words = text[1:].split(SPACE)
            if "" not in words:
                return np.frombuffer(b"".join(map(self.after_space.__getitem__, words)), np.int32).tolist()
        return list(chain.from_iterable(map(self.encoded, self.chunks(text))))

    def learn(self, words: list[str]) -> None:
        """Remembers words' ids: what lies between characters that are no pieces is cut together."""
        plain, odd, known = [], [], self.after_space
        for w in words:
            (plain if self.letters.issuperset(w) else odd).append(w)
        runs = [[(letters, "".join(run)) for letters, run in groupby(SPACE + w, self.letters.__contains__)] for w in odd]
        cut = self.cut_all([SPACE + w for w in plain] + [run for some in runs for letters, run in some if letters])
        known.update(zip(plain, cut, strict=False))
        for w, some in zip(odd, runs, strict=True):
            known[w] = b"".join(next(cut) if letters else np.array(self.alone(run), np.int32).tobytes() for letters, run in some)

    def encode_arrays(self, texts: list[str]) -> list[np.ndarray]:
        """encode() of each text. Words that are new are cut together, and forgotten where the memory is full."""
        known, spaced = self.after_space, [self.normalised(t) for t in texts]
        plain = [self.chunked and t.startswith(SPACE) and SPACE * 2 not in t and t[-1] != SPACE for t in spaced]
        out = [np.zeros(0, np.int32) if p else np.array(self.encode(t), np.int32) for t, p in zip(texts, plain, strict=True)]
        if any(plain):
            own = [t for t, p in zip(spaced, plain, strict=True) if p]
            words = pc.split_pattern(pa.array(["".join(own)[1:]], pa.large_string()), SPACE).values.dictionary_encode()
            once = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), pa.scalar(SPACE, pa.large_string()))
            kinds, place = once[0].as_py().split(SPACE), words.indices.to_numpy()
            if self.definition.model == BPE and SPACE in self.letters:
                self.learn([w for w in kinds if w not in known and len(w) < LONG])
            packed = [known[w] for w in kinds]
            ids, n = np.frombuffer(b"".join(packed), np.int32), np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            begin, many = (np.cumsum(n) - n)[place], n[place]
            upto = np.cumsum(many)
            flat = ids[np.repeat(begin - (upto - many), many) + np.arange(upto[-1])]
            cuts = upto[np.cumsum([t.count(SPACE) for t in own]) - 1]
            for i, part in zip(np.flatnonzero(plain).tolist(), np.split(flat, cuts[:-1]), strict=True):
                out[i] = part
        while len(known) > MEMORY:
            known.popitem()
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self.encode_arrays(texts)]

    def decode_to(self, ids: np.ndarray, counts: list[int], texts: list[bytes]) -> list[bool]:
        """Whether decode() of each text's ids, which stand end to end, gives the text. The bytes that ids stand for are compared first."""
        said = self.spoken.take(pa.array(ids)) if SPACE in self.letters else self.spoken[:0]
        out, at = [], 0
        if len(said):
            ends, data = np.frombuffer(said.buffers()[1], np.int64), (said.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        for n, text in zip(counts, texts, strict=True):
            if n and len(said):
                i, j = int(ends[at]), int(ends[at + n])
                own = data[i + (self.definition.prefix and data[i : i + 1] == b" ") : j]
            out.append(bool(n and len(said) and own == text) or self.decode(ids[at : at + n].tolist()) == text.decode("utf-8", "replace"))
            at += n
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are joined to characters, invalid ones become U+FFFD, control pieces say nothing."""
        d = self.definition
        text = "".join(map(self.texts.__getitem__, ids))
        if not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        text = text.replace(SPACE, " ") if d.escape else text
        return text[1:] if d.prefix and text[:1] == " " else text


class Remembered(dict):
    """Ids of a space and the word behind it, as 32-bit numbers, by word, remembered up to MEMORY words."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.codec.encoded(SPACE + word), np.int32).tobytes()
        if len(self) < MEMORY and len(word) < LONG:
            self[word] = found
        return found


@lru_cache(maxsize=1)
def codec_of(definition: Definition, whole: frozenset[str]) -> Codec:
    """A worker's codec: its next task goes on with the words and pairs that it remembers."""
    return Codec(definition, whole)


def encode_documents(docs: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Every row's `keep` columns with n_chars, n_pieces, ids (where asked for), ids_crc32, and decodes_to_text.

    ids_crc32 is the CRC-32 of the ids as little-endian 32-bit numbers; decodes_to_text says that decoding the ids gave
    the whole text again, code point by code point. A null text counts as empty and has no pieces. A text of any length
    is encoded whole, each row for itself, so repeated rows and equal ids are alike. An empty table gives no rows. A
    `keep` column may not have the name of a result. The model, of fixed size, is read once and sent to the workers.
    """
    no_clash(keep, "n_chars", "n_pieces", "ids", "ids_crc32", "decodes_to_text")
    definition = Definition.read(model_file)
    sent = docs.sparkSession.sparkContext.broadcast((definition, Codec(definition).whole))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(*sent.value)
        for batch in gathered(batches, "_text", TOGETHER):
            texts = bytes_of(batch.column(len(keep))).to_pylist()
            whole = [t.decode("utf-8", "replace") for t in texts]
            found = codec.encode_arrays(whole)
            flat, counts = np.concatenate(found), list(map(len, found))
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(flat))] if ids else []
            sums = [crc32(own.astype("<i4", copy=False)) for own in found]
            same = codec.decode_to(flat, counts, texts)
            columns = [pa.array(list(map(len, whole)), pa.int64()), pa.array(counts, pa.int64()), *lists, pa.array(sums, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, "n_chars", "n_pieces", *(["ids"] if ids else []), "ids_crc32", "decodes_to_text"])

    rows = docs.select(*map(quoted, keep), F.col(quoted(text)).alias("_text"))
    head = ", ".join(f"{quoted(c)} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return in_arrow(rows, work, f"{head}, n_chars long, n_pieces long, " + "ids array<int>, " * ids + "ids_crc32 long, decodes_to_text boolean")
