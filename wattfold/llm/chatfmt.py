"""Chat formatting by token-level assembly.

Each turn becomes ``<s> role [INST] text </s>``. Role and text are escaped and encoded separately with an ordinary
byte-level vocabulary; the control marks are spliced in as reserved ids above that vocabulary, so no text can forge
them. Segment starts come from a prefix sum of the segment lengths, the loss mask from a prefix sum of +1 at the start
and -1 at the end of each assistant text.

Defined cases: null texts and roles are empty strings; a null turn comes first; rows of the same turn (repeated rows
included) all stay, ordered by role and then by token ids; a null conv_id is a conversation of its own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The marks of the template, and foreign marks that texts must not be able to write either.
START, BODY, END = "<s>", "[INST]", "</s>"
CONTROL = (START, BODY, END, "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
ESCAPE = "\\"
#: Fixed value: the public split pattern of the byte-level vocabularies.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Longer texts are encoded in pieces, so one run without white space cannot stall a task.
PIECE = 20_000

_marks = re.compile(re.escape(ESCAPE) + "|" + "|".join(map(re.escape, CONTROL)))
_escaped = re.compile(re.escape(ESCAPE) + "(" + re.escape(ESCAPE) + "?)")
_encoders: dict = {}

FORMATTED = "conv_id long, turn long, role string, ids array<int>, loss array<boolean>"
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_tokens long, loss_tokens long"
)


def escape(text: str) -> str:
    """Doubles the escape sign and puts one after the first character of each control string."""
    return _marks.sub(lambda m: m[0][0] + ESCAPE + m[0][1:] if len(m[0]) > 1 else ESCAPE * 2, text)


def unescape(text: str) -> str:
    """The exact inverse of :func:`escape`."""
    return _escaped.sub(lambda m: m[1], text)


def encoder(ranks: bytes):
    """The vocabulary of a rank file; built once per Python worker."""
    if not (found := _encoders.get(len(ranks))):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        found = _encoders[len(ranks)] = tiktoken.Encoding("turns", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
    return found


def vocabulary(spark: SparkSession, path: str | None = None):
    """The rank file, read once by the driver and sent to the executors (under 1 MB)."""
    return spark.sparkContext.broadcast(Path(path or VOCABULARY).read_bytes())


def _encode(coder, text: str) -> list[int]:
    if len(text) <= PIECE:
        return coder.encode_ordinary(text)
    return [i for at in range(0, len(text), PIECE) for i in coder.encode_ordinary(text[at : at + PIECE])]


def assemble(segments: list[list[list[int]]], learn: list[bool]) -> list[tuple[list[int], np.ndarray]]:
    """Token ids and loss mask of each turn from its five segments (start, role, body mark, text, end)."""
    lengths = np.array([[len(s) for s in turn] for turn in segments], dtype=np.int64).reshape(-1, 5)
    ends = np.cumsum(lengths.ravel()).reshape(-1, 5)  # prefix sums over the segments of all turns of the batch
    step = np.zeros(int(ends[-1, -1]) + 1 if len(ends) else 1, dtype=np.int64)
    on = np.array(learn, dtype=bool)
    np.add.at(step, ends[on, 2], 1)
    np.add.at(step, ends[on, 3], -1)
    mask = np.cumsum(step) > 0
    starts = ends[:, 0] - lengths[:, 0] if len(ends) else []
    return [
        ([i for s in turn for i in s], mask[a:b])
        for turn, a, b in zip(segments, starts, ends[:, 4] if len(ends) else [], strict=True)
    ]


def format_turns(conversations: DataFrame, ranks, learn_role: str = "assistant") -> DataFrame:
    """Token ids and loss mask of each turn. Work per row, so a long conversation is spread over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks.value)
        start, body, end = ([coder.n_vocab + CONTROL.index(mark)] for mark in (START, BODY, END))
        for batch in batches:
            conv, turn, role, text = (batch.column(i) for i in range(4))
            roles = [x or "" for x in role.to_pylist()]
            cut = [
                [start, _encode(coder, escape(r)), body, _encode(coder, escape(t or "")), end]
                for r, t in zip(roles, text.to_pylist(), strict=True)
            ]
            made = assemble(cut, [r == learn_role for r in roles])
            yield pa.RecordBatch.from_arrays(
                [conv, turn, role, pa.array([i for i, _ in made], pa.list_(pa.int32())), pa.array([m.tolist() for _, m in made], pa.list_(pa.bool_()))],
                ["conv_id", "turn", "role", "ids", "loss"],
            )

    rows = conversations.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    return rows.mapInArrow(run, FORMATTED)


class Reader:
    """Reads formatted turns of one conversation back, one at a time; holds digests and counts only."""

    def __init__(self, coder, conv):
        self.coder, self.conv = coder, conv
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.tokens = self.learned = 0

    def take(self, ids: list[int], mask: list[bool]) -> None:
        coder = self.coder
        first = coder.n_vocab
        marks = [k for k, i in enumerate(ids) if i >= first]
        if [ids[k] - first for k in marks] != [CONTROL.index(x) for x in (START, BODY, END)] or marks[0] or marks[2] != len(ids) - 1:
            raise ValueError("not a formatted turn")
        read = lambda part: coder.decode_bytes(part).decode()
        role, text = read(ids[1 : marks[1]]), read(ids[marks[1] + 1 : -1])
        self.chars += len(START) + len(role) + len(BODY) + len(text) + len(END)
        self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        learned = [i for i, on in zip(ids, mask, strict=True) if on]
        if learned:
            said = unescape(read(learned))
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.n += 1
        self.tokens += len(ids)
        self.learned += len(learned)

    def row(self) -> tuple:
        return (self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens, self.learned)


def read_back(formatted: DataFrame, ranks) -> DataFrame:
    """One row per conversation, read from the token ids and masks alone.

    A digest needs the turns of a conversation in order, so they pass through one task, one turn in memory at a time;
    the encoding before it is spread over all tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, now, done = encoder(ranks.value), None, []
        fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], fields)

        for batch in batches:
            for conv, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "loss")), strict=True):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.row())
                    now = Reader(coder, conv)
                now.take(ids, mask)
            if len(done) >= 1000:
                yield batch_of(done)
                done = []
        if now:
            yield batch_of([*done, now.row()])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")
    return ordered.select("conv_id", "ids", "loss").mapInArrow(run, DIGEST)
