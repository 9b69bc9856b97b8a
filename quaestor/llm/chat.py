"""Chat formatting from event logs: logs are dealt by conversation, sorted by sequence, folded into messages and rendered."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.tables import in_arrow, quoted

START, END = "<|im_start|>", "<|im_end|>"
EVENTS = ("message", "delta", "edit", "regenerate")
SCHEMA = "n_turns long, formatted string, mask array<struct<begin: long, end: long>>"


def escape(text: str) -> str:
    """Text in which no control string can occur: a backslash comes before each backslash and inside each `<|`."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    """As escape(), with line feeds written as `\\n`, since one ends the role."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


@dataclass
class Fold:
    """The state of one conversation while its events pass by.

    message: begins a message. delta: adds text to the message named by `target`, or to the last one. edit: puts a new
    text in its place. regenerate: drops that message's text and all later messages, so that deltas can write it anew.
    An event whose target is unknown changes nothing.
    """

    messages: list[list] = field(default_factory=list)  # [key, role, parts]
    places: dict[int | None, list[int]] = field(default_factory=dict)  # of each key's messages, the last one last

    def find(self, target: int | None) -> int | None:
        if target is None:
            return len(self.messages) - 1 if self.messages else None
        held = self.places.get(target)
        return held[-1] if held else None

    def take(self, event: str, seq: int | None, role: str, text: str, target: int | None) -> None:
        if event == "message":
            self.places.setdefault(seq, []).append(len(self.messages))
            self.messages.append([seq, role, [text]])
        elif (i := self.find(target)) is not None:
            if event == "delta":
                self.messages[i][2].append(text)
            elif event == "edit":
                self.messages[i][2] = [text]
            elif event == "regenerate":
                while len(self.messages) > i + 1:
                    self.places[self.messages.pop()[0]].pop()
                self.messages[i][2] = [text]

    def rendered(self, learn: str = "assistant") -> tuple[int, str, list[tuple[int, int]]]:
        """Number of messages, the formatted text, and the spans under the loss mask: texts with the role `learn`."""
        parts, mask, at = [], [], 0
        for _, role, pieces in self.messages:
            head, body = f"{START}{escape_role(role)}\n", escape("".join(pieces))
            if role == learn:
                mask.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, END, "\n"]
            at += len(head) + len(body) + len(END) + 1
        return len(self.messages), "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns that a formatted conversation holds."""
    out = []
    for block in formatted.split(START)[1:]:
        role, _, rest = block.partition("\n")
        out.append((unescape_role(role), unescape(rest.rpartition(END)[0])))
    return out


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A table of whole turns (conv_id, turn, role, text) as an event log with one message event each."""
    return turns.select("conv_id", F.col("turn").cast("long").alias("seq"), F.lit("message").alias("event"), "role", "text", F.lit(None).cast("long").alias("target"))


def conversations(events: DataFrame, conv_id: str = "conv_id", seq: str = "seq", event: str = "event", role: str = "role", text: str = "text", target: str = "target") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted (code points count as places) and the loss mask's spans.

    Events are dealt by conversation, sorted by sequence (then event, role and text, so ties and repeated rows have
    one order) and folded as they stream past; a task holds one conversation at a time, which is one row of the result.
    Null texts and roles are empty, a null event is a message, null sequences come first and a null conv_id is a
    conversation of its own. An empty log gives no rows; conv_id keeps its type, and other columns are not read, whatever
    their names. A conversation is one value of the result, so its events meet in one task and its text has to fit there.
    """
    c = lambda name: F.col(quoted(name))
    blank = lambda name: F.coalesce(c(name).cast("string"), F.lit(""))
    log = events.select(c(conv_id).alias("conv_id"), c(seq).cast("long").alias("seq"), F.coalesce(c(event), F.lit("message")).alias("event"), blank(role).alias("role"), blank(text).alias("text"), c(target).cast("long").alias("target"))
    ordered = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", F.array_position(F.array(*map(F.lit, EVENTS)), F.col("event")), "role", "text", "target")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "formatted", "mask"]
        ident = pa.string()
        kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            spans = [[{"begin": a, "end": b} for a, b in m] for m in columns[3]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], ident), *(pa.array(v, k) for v, k in zip([*columns[1:3], spans], kinds, strict=True))], names=names)

        state, now, begun, out, size = Fold(), None, False, [], 0
        for batch in batches:
            ident = batch.column(0).type
            for conv, *event in zip(*(x.to_pylist() for x in (batch.column(0), batch.column(2), batch.column(1), batch.column(3), batch.column(4), batch.column(5))), strict=True):
                if begun and conv != now:
                    out.append((now, *state.rendered()))
                    size += len(out[-1][2])
                    state = Fold()
                    if size > 4 << 20:
                        yield batch_of(out)
                        out, size = [], 0
                now, begun = conv, True
                state.take(*event)
        if begun:
            out.append((now, *state.rendered()))
        if out:
            yield batch_of(out)

    return in_arrow(ordered, work, f"conv_id {log.schema['conv_id'].dataType.simpleString()}, {SCHEMA}")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest columns, all made from `formatted` and `mask` alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            rows = []
            for conv, text, mask in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = parse(text)
                learnt = "".join(unescape(text[m["begin"] : m["end"]]) for m in mask)
                digest = sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((conv, len(turns), digest, len(learnt), sha256(learnt.encode()).hexdigest(), len(text)))
            kinds = (batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return in_arrow(formatted.select("conv_id", "formatted", "mask"), work, f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def sql_escape(text: str) -> str:
    return rf"replace(replace({text}, '\', '\\'), '<|', '<\|')"
