"""Exact top-k search by inner product, in tiles.

Vectors are packed into blocks of ``BLOCK`` rows.  Query blocks and candidate
blocks meet on a grid of tiles: a query block is copied to each column of the
grid, a candidate block to each row, so a tile's input is bounded whatever the
table's size, and neither side is broadcast.  A tile multiplies its matrices and
keeps each query's best ``k``; the lists of one query block are then merged in a
tree, ``FAN_IN`` at a time.

Components are whole numbers, floor(64 * x).  Products are exact: they run in
single or double precision where no sum can exceed what that holds, else in
64-bit or unbounded integers.  A score beyond 63 bits counts as the largest, or
the least but one, of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplane.llm.shared import materialize

SCALE = 64
BLOCK = 2048
#: Blocks of queries and of candidates that a tile holds.
TILE_QUERIES = 4
TILE_CANDIDATES = 8
FAN_IN = 16

_BLOCK_SCHEMA = "side int, dim int, block long, ids binary, width int, data binary"
#: Bytes of a component, by what the largest in a block needs.
_WIDTHS = {2: np.int16, 4: np.int32, 8: np.float64}
_TOP_SCHEMA = "block long, part long, n int, k int, ids binary, best binary, scores binary"


def _pack_block(side: int):
    def run(key, table):
        dim, block = (x.as_py() for x in key)
        rows = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        with np.errstate(over="ignore"):
            # What overflows a double is as good as the largest: its scores are beyond 63 bits anyway.
            whole = np.nan_to_num(np.floor(SCALE * rows))
        most = np.abs(whole).max(initial=0)
        width = 2 if most < 2**15 else 4 if most < 2**31 else 8
        row = {"side": side, "dim": dim, "block": block, "ids": table["vec_id"].to_numpy().tobytes(), "width": width, "data": whole.astype(_WIDTHS[width]).tobytes()}
        return pa.Table.from_pylist([row], schema=pa.schema([("side", pa.int32()), ("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("width", pa.int32()), ("data", pa.binary())]))

    return run


def _exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T for whole numbers held as doubles, as exact integers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
    return np.clip(whole(a) @ whole(b).T, 1 - 2**63, 2**63 - 1)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, scores, used) of each row's k best by score, then smaller id.

    ``ids`` is sorted.  Rank and position share one 64-bit key where they fit,
    so partial selection is exact under ties.
    """
    n = len(ids)
    allowed = ids[None, :] != own[:, None]
    k = min(k, n)
    if scores.dtype != object and int(np.abs(scores).max(initial=0)) < 2**61 // n:
        key = np.where(allowed, scores * n + (n - 1 - np.arange(n)), np.int64(-(2**63)))
        top = np.argpartition(key, n - k, axis=1)[:, n - k :]
        top = np.take_along_axis(top, np.argsort(~np.take_along_axis(key, top, 1), axis=1, kind="stable"), 1)
    else:
        top = np.array([sorted(range(n), key=lambda j: (not allowed[i, j], -int(scores[i, j]), j))[:k] for i in range(len(own))]).reshape(len(own), k)
    return ids[top], np.take_along_axis(scores, top, 1), np.take_along_axis(allowed, top, 1)


def _pack_top(block: int, part: int, own: np.ndarray, best: np.ndarray, scores: np.ndarray) -> dict:
    """A list per query; places that no candidate fills have a minimal score."""
    return {"block": block, "part": part, "n": len(own), "k": best.shape[1], "ids": own.tobytes(), "best": best.astype(np.int64).tobytes(), "scores": scores.astype(np.int64).tobytes()}


_NONE = np.int64(-(2**63))


def _components(data: bytes, width: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, _WIDTHS[width]).astype(np.float64).reshape(-1, dim)


def _tile(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        queries, candidates = pdf[pdf.side == 1], pdf[pdf.side == 0]
        if len(candidates):
            ids = np.concatenate([np.frombuffer(x, np.int64) for x in candidates.ids])
            data = np.concatenate([_components(x, w, d) for x, w, d in zip(candidates["data"], candidates.width, candidates.dim)])
            order = np.argsort(ids, kind="stable")
            ids, data = ids[order], data[order]
            for q in queries.itertuples():
                own = np.frombuffer(q.ids, np.int64)
                asked = _components(q.data, q.width, q.dim)
                lists = []
                for at in range(0, len(own), 256):
                    best, scores, used = _best(_exact_products(asked[at : at + 256], data), ids, own[at : at + 256], k)
                    lists.append((best, np.where(used, scores, _NONE)))
                out.append(_pack_top(q.block, int(pdf.part.iloc[0]), own, np.concatenate([x for x, _ in lists]), np.concatenate([x for _, x in lists])))
        return pd.DataFrame(out, columns=["block", "part", "n", "k", "ids", "best", "scores"])

    return run


def _merge(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, own = int(pdf.n.iloc[0]), np.frombuffer(pdf.ids.iloc[0], np.int64)
        best = np.concatenate([np.frombuffer(r.best, np.int64).reshape(n, r.k) for r in pdf.itertuples()], axis=1)
        scores = np.concatenate([np.frombuffer(r.scores, np.int64).reshape(n, r.k) for r in pdf.itertuples()], axis=1)
        order = np.argsort(best, axis=1, kind="stable")
        best, scores = np.take_along_axis(best, order, 1), np.take_along_axis(scores, order, 1)
        # Descending without negation: the least score has no opposite.
        top = np.argsort(~scores, axis=1, kind="stable")[:, :k]
        row = _pack_top(int(pdf.block.iloc[0]), int(pdf.part.iloc[0]) // FAN_IN, own, np.take_along_axis(best, top, 1), np.take_along_axis(scores, top, 1))
        return pd.DataFrame([row], columns=["block", "part", "n", "k", "ids", "best", "scores"])

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            own = np.frombuffer(r["ids"], np.int64)
            best, scores = (np.frombuffer(r[c], np.int64).reshape(r["n"], r["k"]) for c in ("best", "scores"))
            query, rank = np.nonzero(scores != _NONE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[query]), pa.array((rank + 1).astype(np.int32)), pa.array(best[query, rank]), pa.array(scores[query, rank])],
                names=["query_id", "rank", "vec_id", "score"],
            )


def top_k(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k best partners of each row whose vec_id is divisible by ``every``.

    One row per query and rank: query_id, rank from 1, vec_id, score.  Ties go to
    the smaller vec_id; a query with fewer partners has fewer rows.  Rows without
    an id, with a null or empty vector, or with a component that is null or not
    finite take no part.  Vectors of different lengths don't meet.  Repeated rows
    are candidates each, but never of a query with their own id; a repeated query
    row gets a list of its own.  Other columns are ignored.  A score must fit 64
    bits.
    """
    usable = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.monotonically_increasing_id().alias("uid"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = usable.where(F.coalesce(finite, F.lit(False)) & (F.size("embedding") > 0)).withColumn("dim", F.size("embedding"))
    asked = usable.where(F.col("vec_id") % every == 0)
    # One row per vector length: the numbers of blocks, on which the grid rests.
    counts = usable.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("wide"), F.ceil(F.count_if(F.col("vec_id") % every == 0) / BLOCK).alias("high"))
    counts = materialize(counts.where("high > 0"), "counts")
    columns = counts.agg(F.max(F.ceil(F.col("wide") / TILE_CANDIDATES))).first()[0]
    if columns is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def blocks(rows: DataFrame, side: int, number: str) -> DataFrame:
        dealt = rows.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", "uid"), F.col(number))).drop("uid")
        packed = dealt.groupBy("dim", "block").applyInArrow(_pack_block(side), _BLOCK_SCHEMA)
        return packed.join(counts.withColumnRenamed("dim", "d"), F.col("dim") == F.col("d"))

    queries = blocks(asked, 1, "high").withColumn("row", F.floor(F.col("block") / TILE_QUERIES)).withColumn("part", F.explode(F.expr(f"sequence(0, ceil(wide / {TILE_CANDIDATES}) - 1)")))
    candidates = blocks(usable, 0, "wide").withColumn("part", F.floor(F.col("block") / TILE_CANDIDATES)).withColumn("row", F.explode(F.expr(f"sequence(0, ceil(high / {TILE_QUERIES}) - 1)")))
    tiles = queries.unionByName(candidates).withColumn("block", F.col("dim") * F.lit(1 << 32) + F.col("block"))
    lists = materialize(tiles.groupBy("dim", "row", "part").applyInPandas(_tile(k), _TOP_SCHEMA), "lists")
    while columns > 1:
        columns = -(-columns // FAN_IN)
        lists = materialize(lists.withColumn("to", F.floor(F.col("part") / FAN_IN)).groupBy("block", "to").applyInPandas(_merge(k), _TOP_SCHEMA), "lists")
    return lists.mapInArrow(_rows, "query_id long, rank int, vec_id long, score long")
