"""Token counts with a whole-token shortcut: strings proved to be one token are counted directly, the rest is merged."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from quaestor.llm.tables import bytes_of, in_arrow, no_clash, quoted

#: Pre-tokens whose number of tokens a worker remembers.
MEMORY = 300_000
END = "</w>"
#: The file's pattern for pre-tokens; white space is never part of one.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


LETTERS = byte_letters()
BYTES = {c: b for b, c in LETTERS.items()}


#: What a pre-token counts that holds a character too new for its class to be the same in every library.
UNSURE = 1 << 40


def settled(text: str) -> bool:
    """Whether all characters were assigned by Unicode 3.2, since when no table has changed what a letter or number is among them.

    Tables of different libraries disagree on newer ones only; a test holds the classes of all settled ones against the library.
    """
    return text.isascii() or all(unicodedata.ucd_3_2_0.category(c) != "Cn" for c in text)


def as_letters(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(LETTERS)


def normalised(text: str) -> str:
    """NFC, then lower case letter by letter, as the file's normaliser does; white space only divides, so it may stay."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """The strings that the vocabulary holds and that, standing alone as a pre-token, are proved to encode as one token."""
    split = regex.compile(PATTERN)
    found = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        if not entry.endswith(END) or not all(c in BYTES for c in entry[: -len(END)]):
            continue
        try:
            piece = bytes(BYTES[c] for c in entry[: -len(END)]).decode()
        except UnicodeDecodeError:
            continue
        if split.findall(piece) == [piece] and len(tokenizer.model.tokenize(as_letters(piece))) == 1:
            found.append(piece)
    return frozenset(found)


class Counter:
    """Counts a text's tokens as tokenizers does, special strings inside the text included."""

    def __init__(self, definition: str, whole: frozenset[str]):
        self.tokenizer = Tokenizer.from_str(definition)
        self.split = regex.compile(PATTERN)
        specials = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.marks = tuple({s[:1] for s in specials})
        self.sizes = Sizes(self.tokenizer, whole)

    def plain(self, text: str) -> int:
        n = sum(map(self.sizes.__getitem__, self.split.findall(normalised(text))))
        return n if n < UNSURE else self.by_library_split(text)

    def by_library_split(self, text: str) -> int:
        """The same from the file's own normaliser and pre-tokens, for texts with characters that are not settled."""
        own = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return sum(len(self.sizes.model.tokenize(piece)) for piece, _ in own)

    def count(self, text: str) -> int:
        if self.specials is None or not any(m in text for m in self.marks):
            return self.plain(text)
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


class Sizes(dict):
    """Number of tokens by pre-token: 1 for proved whole tokens, merged once for others and remembered up to MEMORY."""

    def __init__(self, tokenizer: Tokenizer, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.model, self.most = tokenizer.model, len(whole) + MEMORY

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize(as_letters(piece))) if settled(piece) else UNSURE
        if len(self) < self.most and len(piece) < 100:
            self[piece] = n
        return n


def count_tokens(docs: DataFrame, tokenizer_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 2048) -> DataFrame:
    """Every row's `keep` columns with n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens).

    No tokens are added at the ends and nothing is cut. A null text counts as empty: 0 bytes, 0 tokens; white space has
    bytes but no tokens. A text of any length is counted whole, each row for itself, so repeated rows and equal ids
    are alike. An empty table gives no rows. A `keep` column may not have the name of a result. The vocabulary, of
    fixed size, is read once and sent to the workers.
    """
    no_clash(keep, "n_bytes", "n_tokens", "over_limit")
    definition = Path(tokenizer_file).read_text()
    sent = docs.sparkSession.sparkContext.broadcast((definition, whole_tokens(Tokenizer.from_str(definition))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*sent.value)
        for batch in batches:
            texts = bytes_of(batch.column(len(keep)))
            n = np.fromiter((counter.count(t.as_py().decode("utf-8", "replace")) for t in texts), np.int64, len(texts))
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], size, pa.array(n), pa.array(n > limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(*map(quoted, keep), quoted(text))
    head = ", ".join(f"{quoted(c)} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return in_arrow(rows, work, f"{head}, n_bytes long, n_tokens long, over_limit boolean")
