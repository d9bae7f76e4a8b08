"""Chat formatting by columnar byte assembly (1).

Template, a turn each: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. So that no text or role
can forge a mark, one backslash is put between ``<`` and ``|`` wherever both stand together or have only
backslashes between them; taking one away again restores the text. A role's backslashes and newlines
are escaped besides.

The turns are range-partitioned and sorted by (conversation, turn, role, text), so a conversation that
holds a third of all rows lies over many tasks. A task works on Arrow columns: it escapes them, computes
the length of every segment (header, role, text, end), their cumulative offsets and the scatter indices
in numpy, and copies headers and contents into one preallocated buffer, of about ``CHUNK`` bytes or one
longer turn. Each output row is a stretch of one conversation: ``conv_id``, ``chunk`` (its place in the
conversation's order), ``n_turns``, ``formatted`` and ``loss_spans``, the code points [start, end) of the
assistants' texts. Most conversations are one row; long ones are several.

Defined results: null texts and roles are empty; a null conv_id is one conversation; null turns come
first; ties in turn are ordered by role and text (texts by hash, then by themselves), so repeated rows
each make a turn. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gridpulse.llm.textbytes import text_bytes

CHUNK = 1 << 20
START, LINE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
TRAINED = "assistant"
TURN = re.compile(r"<\|im_start\|>(.*)\n((?s:.*?))<\|im_end\|>\n")


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def escape_role(roles: pa.Array) -> pa.Array:
    plain = pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n")
    return escape(plain)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all turns, where each turn starts (one more than turns), and where its text
    starts. Segments are laid out by their lengths; contents are scattered from their columns' buffers."""
    n = len(texts)
    (role_data, role_at), (text_data, text_at) = text_bytes(roles), text_bytes(texts)
    fixed = np.frombuffer(START + LINE + END, np.uint8)
    lengths = np.empty((n, 5), np.int64)  # start mark, role, newline, text, end mark
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(START), len(LINE), len(END)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    at = np.zeros(5 * n + 1, np.int64)
    np.cumsum(lengths.ravel(), out=at[1:])
    out = np.empty(at[-1], np.uint8)
    starts = at[:-1].reshape(n, 5)
    begin = 0
    for column, mark in ((0, START), (2, LINE), (4, END)):
        out[starts[:, column, None] + np.arange(len(mark))] = fixed[begin : begin + len(mark)]
        begin += len(mark)
    for column, data, source in ((1, role_data, role_at), (3, text_data, text_at)):
        size = lengths[:, column]
        into = np.repeat(starts[:, column] - source[:-1], size) + np.arange(source[0], source[-1])
        out[into] = data[source[0] : source[-1]]
    return out, at[::5], starts[:, 3]


def _blocks(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of turns of about ``CHUNK`` bytes."""
    total, i = np.cumsum(size), 0
    while i < len(size):
        before = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, before + CHUNK, "right")))
        yield i, j
        i = j


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _formatter(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            conv, role = batch.column(0), pc.fill_null(batch.column(1), "")
            roles, texts = escape_role(role), escape(pc.fill_null(batch.column(2), ""))
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for i, j in _blocks(size):
                out, at, text_at = assemble(roles[i:j], texts[i:j])
                # Code points before each byte: all bytes but those that continue one.
                points = np.zeros(len(out) + 1, np.int64)
                np.cumsum((out & 0xC0) != 0x80, out=points[1:])
                own = pc.dictionary_encode(conv[i:j], null_encoding="encode").indices.to_numpy()
                new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                bound = np.append(new, j - i)
                data, whole = pa.py_buffer(out), at[bound]
                formatted = pa.LargeStringArray.from_buffers(len(new), pa.py_buffer(whole), data).cast(pa.string())
                trained = pc.equal(role[i:j], TRAINED).to_numpy(zero_copy_only=False)
                turn = np.flatnonzero(trained)
                piece = np.searchsorted(new, turn, "right") - 1
                base = points[at[new]][piece]
                spans = pa.StructArray.from_arrays(
                    [pa.array(points[text_at[turn]] - base), pa.array(points[text_at[turn] + size[i:j][turn]] - base)],
                    names=["start", "end"],
                )
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(piece, np.arange(len(new) + 1)).astype(np.int32)), spans)
                chunk = number + np.arange(len(new))
                number += len(new)
                yield pa.RecordBatch.from_arrays(
                    [conv[i:j].take(pa.array(new)), pa.array(chunk), pa.array(np.diff(bound)), formatted, lists], names
                )

    return run


def format_chats(
    turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
) -> DataFrame:
    """Stretches of formatted conversations, see above."""
    rows = turns.select(
        F.col(conv_column).alias("conv"), F.col(role_column).alias("role"), F.col(text_column).alias("text"),
        F.col(turn_column).alias("turn"), F.xxhash64(F.col(text_column)).alias("hash"),
    )
    # Wholly equal turns are told apart by their place in the scan, so that they need not share a range.
    rows = rows.withColumn("copy", F.monotonically_increasing_id())
    keys = ["conv", "turn", "role", "hash"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *keys, "copy").sortWithinPartitions("conv", "turn", "role", "hash", "text")
    names = [conv_column, "chunk", "n_turns", "formatted", "loss_spans"]
    more = StructType.fromDDL("chunk bigint, n_turns bigint, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")
    schema = StructType([StructField(conv_column, turns.schema[conv_column].dataType), *more.fields])
    return ranged.select("conv", "role", "text").mapInArrow(_formatter(names), schema)


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn."""
    for m in TURN.finditer(formatted):
        yield unescape_role(m[1]), unescape(m[2])


def digests(formatted: DataFrame, conv_column: str = "conv_id") -> DataFrame:
    """Per conversation, from what ``format_chats`` gave: turns, loss and sizes, as counts and hashes.

    A hash over a whole conversation is sequential, so its stretches meet in one task, in order, but only
    one is held at a time."""
    names = [conv_column, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kind = None, None, None

        def row(conv, s) -> pa.RecordBatch:
            values = [conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]]
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            kind = batch.schema.types[0]
            done = []
            for conv, text, spans in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                conv, text = conv.as_py(), text.as_py()
                if state is None or conv != now:
                    if state is not None:
                        done.append(row(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_back(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in spans.as_py():
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if state is not None:
            yield row(now, state)

    more = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    schema = StructType([formatted.schema[conv_column], *StructType.fromDDL(more).fields])
    together = formatted.repartition(F.col(conv_column)).sortWithinPartitions(conv_column, "chunk")
    return together.select(conv_column, "formatted", "loss_spans").mapInArrow(run, schema)
