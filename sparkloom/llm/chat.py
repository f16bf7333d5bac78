"""Chat formatting by token-level assembly.

A turn is  <|start|> role <|sep|> text <|end|>  where the four control strings
are reserved ids beyond the tokenizer's vocabulary.  Role and text are encoded
each by itself, so that no token spans a border and no text can yield a
reserved id; in the formatted string, control strings inside a text are broken
by a backslash, reversibly.  The loss mask is the prefix sum of +1 where a
trained segment begins and -1 where it ends.

Scale: turns are encoded where they lie.  A conversation may be a third of all
rows, so it is never held: rows are dealt by conversation, sorted by turn and
streamed, with the running token offset as the only state.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: This template's control strings, then those of other templates.
START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
CONTROL = (START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
_FOUND = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_BROKEN = re.compile(r"\\(.)", re.S)
#: The largest vocabulary file that is sent to the executors.
LARGEST_FILE = 50_000_000


def escape(text: str) -> str:
    """Backslashes doubled, control strings broken after their first character."""
    return _FOUND.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    """The inverse of escape()."""
    return _BROKEN.sub(r"\1", text)


class Codec:
    """Encodes and decodes segments with ranks read from a .tiktoken file's bytes."""

    _made: dict[tuple[str, str], Codec] = {}

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.of = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.start, self.sep, self.end = (max(table.values()) + k for k in (1, 2, 3))

    @classmethod
    def get(cls, ranks: bytes, pattern: str) -> Codec:
        key = (hashlib.md5(ranks).hexdigest(), pattern)
        if key not in cls._made:
            cls._made[key] = cls(ranks, pattern)
        return cls._made[key]

    def turn(self, role: str, text: str, trained: bool) -> tuple[list[int], np.ndarray]:
        """Ids and mask of a turn."""
        head, body = self.of.encode_ordinary(escape(role)), self.of.encode_ordinary(escape(text))
        ids = [self.start, *head, self.sep, *body, self.end]
        edge = np.zeros(len(ids) + 1, np.int8)
        if trained:
            edge[len(head) + 2] += 1
            edge[len(head) + 2 + len(body)] -= 1
        return ids, np.cumsum(edge)[:-1].astype(bool)

    def text(self, ids) -> str:
        return self.of.decode_bytes(list(ids)).decode()

    def read(self, ids: list[int]) -> tuple[str, str]:
        """Role and text of a turn's ids."""
        if ids[0] != self.start or ids[-1] != self.end or ids.count(self.sep) != 1:
            raise ValueError("not a turn of this template")
        at = ids.index(self.sep)
        return unescape(self.text(ids[1:at])), unescape(self.text(ids[at + 1 : -1]))


def load(spark, path: str, pattern: str) -> Broadcast:
    """The vocabulary file at `path`, of a checked size, for the executors."""
    with open(path, "rb") as f:
        ranks = f.read(LARGEST_FILE + 1)
    if len(ranks) > LARGEST_FILE:
        raise ValueError(f"{path} is larger than {LARGEST_FILE} bytes")
    return spark.sparkContext.broadcast((ranks, pattern))


def encode(turns: DataFrame, codec: Broadcast, train: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, turn, ids, mask, formatted), row by row; null role or text: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec.get(*codec.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                ids, masks, out = [], [], []
                for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    i, m = c.turn(role or "", text or "", role in train)
                    ids.append(i)
                    masks.append(m.tolist())
                    out.append(f"{START}{escape(role or '')}{SEP}{escape(text or '')}{END}")
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_())), pa.array(out, pa.string())], ["conv_id", "turn", "ids", "mask", "formatted"]
                )

    kinds = {x: turns.schema[x].dataType.simpleString() for x in ("conv_id", "turn")}
    return turns.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids array<int>, mask array<boolean>, formatted string")


def format_conversations(turns: DataFrame, codec: Broadcast, train: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Takes conv_id, turn, role, text; returns a row per row: conv_id, turn, ids,
    mask, formatted, and `start`, the offset of the turn's first token in its
    conversation.  A conversation is its rows in order, each partition sorted.

    Turns are ordered by turn (null first), ties and repeated rows by the
    formatted string, all kept.  Null role or text: empty; a null conv_id is a
    conversation of its own.  No rows: no rows.
    """
    dealt = encode(turns, codec, train).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = object(), 0
        for b in batches:
            starts = []
            for conv, n in zip(b.column(0).to_pylist(), b.column(2).value_lengths().to_pylist(), strict=True):
                last, at = (last, at) if conv == last else (conv, 0)
                starts.append(at)
                at += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts, pa.int64())], [*b.schema.names, "start"])

    return dealt.mapInArrow(run, StructType([*dealt.schema.fields, StructField("start", LongType())]))


def digest(formatted: DataFrame, codec: Broadcast) -> DataFrame:
    """Reads formatted conversations back: (conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars).  Streams each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec.get(*codec.value)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kind = None
        state: list = []

        def closed():
            conv, n, turns, chars, loss, size = state
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((conv, kind), (n, pa.int64()), (turns.hexdigest(), pa.string()), (chars, pa.int64()), (loss.hexdigest(), pa.string()), (size, pa.int64()))], names)

        done: list[pa.RecordBatch] = []
        for b in batches:
            kind = b.schema.field(0).type
            for conv, ids, mask, text in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if not state or state[0] != conv:
                    if state:
                        done.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = c.read(ids)
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
                trained = unescape(c.text(x for x, m in zip(ids, mask, strict=True) if m))
                state[3] += len(trained)
                state[4].update(trained.encode())
                state[5] += len(text)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if state:
            yield closed()

    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.select("conv_id", "turn", "ids", "mask", "formatted")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(turns: DataFrame) -> DataFrame:
    """turns and conversation -1, whose texts are control strings of another template."""
    probe = turns.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
