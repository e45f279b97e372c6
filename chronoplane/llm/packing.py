"""Packing documents into training sequences, online and in bounded space.

Each partition keeps at most ``OPEN`` windows open.  A document is encoded and
ended by an end id; its full windows leave at once, and the rest goes into the
open window that it fits best.  Where it fits none, the fullest open window is
topped up with the head of the rest and emitted.  At the end of a partition its
open windows are joined and cut anew, which leaves at most one that isn't full;
those of up to ``MERGED`` partitions are merged the same way in one more step.
Only these last windows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplane.llm.shared import materialize
from chronoplane.llm.tokens import encoder

WINDOW = 1024
OPEN = 32
MERGED = 256
END_ID = 0

_SCHEMA = "sequence_id long, n_tokens int, ids binary, pieces array<struct<doc_id: long, start: long, length: long, offset: long, doc_tokens: long>>, part int"
_ARROW = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("pieces", pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64()), ("doc_tokens", pa.int64())]))), ("part", pa.int32())])


class _Window:
    """Pieces (doc_id, start, ids, doc_tokens) of at most WINDOW ids in all."""

    def __init__(self):
        self.pieces, self.used = [], 0

    def add(self, doc_id, start: int, ids: bytes, total: int) -> None:
        self.pieces.append((doc_id, start, ids, total))
        self.used += len(ids) // 4


class _Sink:
    """Numbers the windows of one task and hands them on in batches."""

    def __init__(self, first_id: int):
        self.next_id, self.rows = first_id, []

    def emit(self, window: _Window, part: int | None = None) -> None:
        pieces, offset = [], 0
        for doc_id, start, ids, total in window.pieces:
            pieces.append({"doc_id": doc_id, "start": start, "length": len(ids) // 4, "offset": offset, "doc_tokens": total})
            offset += len(ids) // 4
        self.rows.append({"sequence_id": self.next_id, "n_tokens": offset, "ids": b"".join(p[2] for p in window.pieces), "pieces": pieces, "part": part})
        self.next_id += 1

    def drain(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_pylist(self.rows, schema=_ARROW)
            self.rows = []


def _join(windows: list[_Window], sink: _Sink) -> _Window | None:
    """Cut the contents of windows anew into full ones; return the last if it isn't full."""
    current = _Window()
    for doc_id, start, ids, total in (p for w in windows for p in w.pieces):
        while ids:
            take = min(len(ids) // 4, WINDOW - current.used)
            current.add(doc_id, start, ids[: 4 * take], total)
            ids, start = ids[4 * take :], start + take
            if current.used == WINDOW:
                sink.emit(current)
                current = _Window()
    return current if current.used else None


def _pack_partition(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).ids
    part = TaskContext.get().partitionId()
    sink, windows = _Sink(part << 32), []
    end = END_ID.to_bytes(4, "little")
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encode(text.as_py() or "") + end
            total = len(ids) // 4
            start = total - total % WINDOW
            for at in range(0, start, WINDOW):
                full = _Window()
                full.add(doc_id, at, ids[4 * at : 4 * (at + WINDOW)], total)
                sink.emit(full)
            rest = ids[4 * start :]
            while rest:
                n = len(rest) // 4
                fits = [w for w in windows if WINDOW - w.used >= n]
                if fits:
                    best = max(fits, key=lambda w: w.used)
                elif len(windows) < OPEN:
                    windows.append(best := _Window())
                else:
                    best = max(windows, key=lambda w: w.used)
                    n = WINDOW - best.used
                best.add(doc_id, start, rest[: 4 * n], total)
                rest, start = rest[4 * n :], start + n
                if best.used == WINDOW:
                    windows.remove(best)
                    sink.emit(best)
            yield from sink.drain(256)
    if last := _join(windows, sink):
        sink.emit(last, part)
    yield from sink.drain()


def _merge(key, table):
    """Merge the last windows of a group of partitions."""
    (group,) = (k.as_py() for k in key)
    windows = []
    for row in sorted(table.to_pylist(), key=lambda r: r["sequence_id"]):
        window = _Window()
        for p in row["pieces"]:
            window.add(p["doc_id"], p["start"], row["ids"][4 * p["offset"] : 4 * (p["offset"] + p["length"])], p["doc_tokens"])
        windows.append(window)
    sink = _Sink((1 << 62) | (group << 32))
    if last := _join(windows, sink):
        sink.emit(last)
    return pa.Table.from_pylist(sink.rows, schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, ids and the pieces in it.

    ``ids`` holds n_tokens unsigned little-endian 32-bit ids; what is missing to
    a full window is padding, which a reader adds.  A null text is an empty one
    and takes its end id.  Every row is packed, repeated or not, in the order in
    which its partition holds it; ids of sequences follow partitions.  doc_id may
    be null.  Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    packed = materialize(rows.mapInArrow(lambda batches: _pack_partition(tokenizer, batches), _SCHEMA), "packed")
    last = packed.where("part IS NOT NULL").withColumn("g", F.floor(F.col("part") / MERGED).cast("long"))
    merged = last.groupBy("g").applyInArrow(_merge, _SCHEMA)
    return packed.where("part IS NULL").unionByName(merged).drop("part")


def pieces(sequences: DataFrame) -> DataFrame:
    """One row per piece of ``pack``'s sequences, with the checksum of its ids."""
    flat = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    own = F.expr("substring(ids, cast(4 * p.offset + 1 as int), cast(4 * p.length as int))")
    return flat.select("p.doc_id", "p.start", "p.length", F.crc32(own).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset")
