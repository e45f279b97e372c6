"""Chat formatting by token-level assembly.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  The control strings stand for
reserved ids; role and text are encoded apart and spliced between them, so no
merge crosses a border.  Where content holds what looks like the head of a
control string (``<``, any backslashes, ``|``), one backslash more is put in,
and reading takes one out.  The lengths of the segments, summed up in order,
give the place of each segment, hence the loss mask: it covers the text of
assistant turns and nothing else.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplane.llm.tokens import byte_of, encoder

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
_HEAD, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_SCHEMA = "formatted string, ids binary, loss_spans array<struct<first: int, last: int>>"
_ARROW = [("formatted", pa.string()), ("ids", pa.binary()), ("loss_spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]


def escape(text: str) -> str:
    return _HEAD.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def reserved(path: str) -> tuple[int, int]:
    """The ids of START and END: the first two beyond the vocabulary."""
    n = encoder(path).library.get_vocab_size()
    return n, n + 1


def assemble(path: str, turns: list[tuple[str, str]]) -> tuple[str, bytes, list[tuple[int, int]]]:
    """(formatted text, ids, spans of ids under the loss mask) of the turns."""
    encode = encoder(path).ids
    start, end = (struct.pack("<I", i) for i in reserved(path))
    newline = encode("\n")
    texts, parts, bears_loss = [], [], []
    for role, text in turns:
        head, body = escape_role(role), escape(text)
        texts.append(f"{START}{head}\n{body}{END}\n")
        parts += [start, encode(head + "\n"), encode(body), end, newline]
        bears_loss += [False, False, role == ASSISTANT, False, False]
    ends = list(accumulate(len(p) // 4 for p in parts))
    spans = [(e - len(p) // 4, e) for p, e, loss in zip(parts, ends, bears_loss) if loss]
    return "".join(texts), b"".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted text holds."""
    turns = []
    for turn in formatted.split(START)[1:]:
        head, _, body = turn.partition("\n")
        turns.append((unescape_role(head), unescape(body[: -len(END) - 1])))
    return turns


_bytes_of: dict[str, list[bytes]] = {}


def _token_bytes(path: str) -> list[bytes]:
    """The bytes of each id: a byte-level vocabulary writes a byte as one character."""
    if path not in _bytes_of:
        byte = byte_of()
        library = encoder(path).library
        _bytes_of[path] = [bytes(byte[c] for c in library.id_to_token(i)) for i in range(library.get_vocab_size())]
    return _bytes_of[path]


def read_loss(path: str, ids: bytes, spans: list[tuple[int, int]]) -> str:
    """All text under the loss mask, unescaped."""
    table = _token_bytes(path)
    own = lambda a, b: b"".join(table[i] for i in struct.unpack(f"<{b - a}I", ids[4 * a : 4 * b])).decode()
    return "".join(unescape(own(a, b)) for a, b in spans)


def _format(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = None
    for batch in batches:
        made = []
        for turns in batch.column(1).to_pylist():
            text, ids, spans = assemble(path, [(t["role"], t["text"]) for t in turns])
            made.append({"formatted": text, "ids": ids, "loss_spans": [{"first": a, "last": b} for a, b in spans]})
        schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), *_ARROW])
        columns = pa.Table.from_pylist(made, schema=pa.schema(_ARROW)).combine_chunks()
        yield from pa.Table.from_arrays([pa.chunked_array([batch.column(0)]), *columns.columns], schema=schema).to_batches()


def format_chats(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation: conv_id, formatted, ids, loss_spans.

    Turns go by turn number, null last; rows with equal numbers by role, then
    text, so repeated rows are repeated turns.  A null role or text is an empty
    one.  A null conv_id is a conversation of its own.  A conversation must fit
    into one record; other columns are ignored; an empty table gives no rows.
    """
    turn = F.struct(F.col("turn").isNull().alias("late"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    schema = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, {_SCHEMA}"
    return chats.mapInArrow(lambda batches: _format(tokenizer, batches), schema)


def _digest(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for batch in batches:
        rows: list[tuple] = []
        for row in batch.select(["formatted", "ids", "loss_spans"]).to_pylist():
            turns = read_turns(row["formatted"])
            loss = read_loss(path, row["ids"], [(s["first"], s["last"]) for s in row["loss_spans"]])
            rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(row["formatted"])))
        n, turns_sha, chars, loss_sha, length = map(list, zip(*rows)) if rows else ([],) * 5
        arrays = [pa.array(n, pa.int64()), pa.array(turns_sha, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(length, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """What reading the formatted conversations back gives, as digests."""
    schema = f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(lambda batches: _digest(tokenizer, batches), schema)
