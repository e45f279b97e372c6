"""Exact token counts of whole texts, looked up where the texts are.

Two tiers answer for a pre-token.  The first is a broadcast table of the corpus's
frequent pre-tokens with their lengths, at most ``FREQUENT`` of them; the second
the worker's cache of what it has encoded before.  Only a miss of both is encoded,
and no pre-token is shuffled but the counts of the sample.  The table is counted on a sample of
about ``SAMPLE`` documents: each task counts on its own and hands on its own most
frequent ones.  It only saves time; counts don't depend on it.  A sentencepiece
model has no pre-tokens; its library counts whole texts.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplane.llm.tokens import PreTokens, encoder

LIMIT = 1024
#: Entries of the broadcast table, and documents on which they are counted.
FREQUENT = 50_000
SAMPLE = 20_000


class LengthTable:
    """Pre-tokens and their numbers of ids, packed: one text, its cuts, and a byte each.

    A length beyond a byte isn't kept, nor is what a worker's cache would miss anyway.
    """

    def __init__(self, lengths: dict[str, int]):
        short = {p: n for p, n in lengths.items() if n < 256}
        self.text = "".join(short)
        self.cuts = np.cumsum([0, *map(len, short)], dtype=np.uint32)
        self.lengths = np.fromiter(short.values(), np.uint8, len(short))

    def unpacked(self) -> dict[str, int]:
        cuts = self.cuts.tolist()
        return {self.text[a:b]: n for a, b, n in zip(cuts, cuts[1:], self.lengths.tolist())}


def _count_pieces(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces, counts = encoder(path).pieces, Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(pieces(text.as_py() or ""))
    top = counts.most_common(FREQUENT)
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])


def frequent_lengths(docs: DataFrame, path: str) -> LengthTable:
    """The lengths of the most frequent pre-tokens of a sample of the texts."""
    rows = docs.count()
    sample = docs.select("text").sample(min(1.0, SAMPLE / max(1, rows)), 7)
    counted = sample.mapInArrow(lambda batches: _count_pieces(path, batches), "piece string, n long")
    # The sample bounds the number of pre-tokens met again; one task ranks them, so one list reaches the driver.
    top = counted.groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1").repartition(1).orderBy(F.desc("n"), "piece").limit(FREQUENT)
    own = encoder(path)
    return LengthTable({r["piece"]: len(own.by_library(r["piece"])) // 4 for r in top.select("piece").collect()})


class _Tier(dict):
    """The broadcast table; what it lacks goes to the worker's cache."""

    def __init__(self, table: dict[str, int], cache: PreTokens):
        super().__init__(table)
        self._cache = cache

    def __missing__(self, piece: str) -> int:
        return self._cache[piece]


_counters: dict[str, tuple[_Tier, _Tier]] = {}


def _counter(path: str, frequent, key: str) -> tuple[_Tier, _Tier]:
    """Counts by pre-token, and by what stands between two spaces."""
    if key not in _counters:
        table, own = frequent.value.unpacked(), encoder(path)
        known = _Tier(table, PreTokens(own.n_ids))
        # What follows a space up to the next may be one pre-token, or several.
        after = {p[1:]: n for p, n in table.items() if p[0] == " " and p[1:].strip(" ") == p[1:] != ""}
        _counters.clear()
        _counters[key] = known, _Tier(after, PreTokens(lambda x: sum(known[p] for p in own.after(x))))
    return _counters[key]


def _count_json(path: str, frequent, key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, caches = encoder(path), _counter(path, frequent, key)

    def count(text: str | None) -> int:
        values = own.values(text or "", *caches)
        return len(own.by_library(text)) // 4 if values is None else sum(values)

    for batch in batches:
        yield _with_counts(batch, [count(t.as_py()) for t in batch.column(2)])


def _count_model(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    for batch in batches:
        yield _with_counts(batch, [len(model.encode(t.as_py() or "")) for t in batch.column(2)])


def _with_counts(batch: pa.RecordBatch, counts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: n_bytes, n_tokens and whether they exceed ``limit``.

    A null text is an empty one with no tokens.  Repeated rows each get a row,
    doc_id may be null, other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    if tokenizer.endswith(".json"):
        frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer))
        key = uuid.uuid4().hex
        counted = rows.mapInArrow(lambda batches: _count_json(tokenizer, frequent, key, batches), schema)
    else:
        counted = rows.mapInArrow(lambda batches: _count_model(tokenizer, batches), schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
