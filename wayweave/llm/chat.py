"""Chat formatting with a grammar round trip.

Template: every turn is `<s>` role `[INST]` text `[/INST]</s>` and a line feed;
the text of an assistant turn is under the loss mask. A deterministic parser
reads rendered text back. A turn is first rendered as it is; if the parser does
not give back exactly its role and text, the text, then also the role, is
escaped: a backslash goes in behind the first character of each control string
and of each control string that already has backslashes there. The parser takes
one backslash away from those, so the escape is reversible and leaves all
other content alone; a turn that still differed would raise an error.

Turns are rendered one by one, without a shuffle: a conversation's formatted
text is its pieces in order of (turn, role, text), of which reading back holds
one at a time, however long the conversation is.

Null texts and roles are empty; null turns come first; a null conv_id is a
conversation of its own. Repeated rows are turns as often as they occur. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OPEN, MID, SHUT, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"([<\[])(\\*)(s>|/s>|INST\]|/INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\])")
_MARK = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]")


class GrammarError(ValueError):
    """The text is not a sequence of rendered turns."""


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Turns (role, text, start and end of the escaped text) of rendered text."""
    turns, at = [], 0
    while at < len(rendered):
        marks = [m for _, m in zip(range(4), _MARK.finditer(rendered, at), strict=False)]
        if [m.group() for m in marks] != [OPEN, MID, SHUT, END] or marks[0].start() != at or marks[2].end() != marks[3].start():
            raise GrammarError(f"no turn at {at}")
        end = marks[3].end()
        if rendered[end:end + 1] != "\n":
            raise GrammarError(f"no line feed at {end}")
        turns.append((unescape(rendered[marks[0].end():marks[1].start()]), unescape(rendered[marks[1].end():marks[2].start()]),
                      marks[1].end(), marks[2].start()))
        at = end + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's piece of formatted text, and where the text lies in it."""
    for r, t in ((role, text), (role, escape(text)), (escape(role), escape(text))):
        piece = f"{OPEN}{r}{MID}{t}{SHUT}{END}\n"
        try:
            found = parse(piece)
        except GrammarError:
            continue
        if len(found) == 1 and found[0][:2] == (role, text):
            return piece, found[0][2], found[0][3]
    raise GrammarError("a turn can't be rendered reversibly")


def format_turns(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per turn: conv_id, turn, role, source_text, piece, loss_start, loss_end (in the piece; null outside the loss mask)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("source_text").to_pylist()
            made = [render(r, t) for r, t in zip(roles, texts, strict=True)]
            span = [(s, e) if r == trained_role else (None, None) for r, (_, s, e) in zip(roles, made, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "turn", "role", "source_text")), pa.array([m[0] for m in made], pa.string()),
                 pa.array([s for s, _ in span], pa.int64()), pa.array([e for _, e in span], pa.int64())],
                names=["conv_id", "turn", "role", "source_text", "piece", "loss_start", "loss_end"])

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("source_text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, source_text string, piece string, loss_start long, loss_end long")


def read_back(pieces: DataFrame) -> DataFrame:
    """What the formatted texts hold, by conversation: counts and digests of turns and of text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, state = None, None

        def row():
            return now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in batches:
            out = []
            for conv, piece, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end")), strict=True):
                if now != (conv,):
                    if now:
                        out.append(row())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    trained = unescape(piece[start:end])
                    state[2] += len(trained)
                    state[3].update(trained.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names=names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(), types, strict=True)], names=names)

    order = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "source_text").select("conv_id", "piece", "loss_start", "loss_end")
    return order.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts look like control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
