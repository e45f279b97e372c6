"""Approximate nearest neighbours by a hierarchical k-means tree and best-bin-first search.

A tree is fitted on a bounded sample: a node splits its vectors by k-means until a
leaf holds few of the sample.  Every row of the table is then sent down the tree
to one leaf.  A query walks the tree with a priority queue: the most promising
node is opened first, a node's promise being the inner product with its centroid
plus what its spread may add; leaves are visited in the order in which they come
off the queue.  How many leaves a query visits is calibrated: a bounded set of
queries is compared with all rows, and visits are widened until the wanted share
of their true neighbours lies in visited leaves.

Neighbouring leaves share a bin up to a bounded number of rows; a query is sent to
a bin once, with the leaves that it visits there, and compared with their rows
alone.  Rows and queries of a bin meet in tiles of bounded size, however many rows
a leaf holds.  Scores of what a tile selects are recomputed in extended precision,
one pair at a time, so equal vectors have equal scores wherever they are met.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoplane.llm.shared import materialize, passing

K = 20
#: Rows that the tree is fitted on, at most about so many for each length of vectors.
SAMPLE = 20_000
BRANCHES = 16
#: A node with no more rows of the sample than this is a leaf.
LEAF = 16
ROUNDS = 8
#: Queries that visits are calibrated with, and the share of true neighbours wanted.
CALIBRATION = 384
TARGET = 0.94
#: Rows of a bin of several leaves; rows and queries of a tile.
ROWS_PER_BIN = 8192
ROWS_PER_TILE = 16_384
QUERIES_PER_TILE = 512
SEED = 7

_INDEX = "dim int, leaf int, vec_id long, uid long, embedding array<double>"
_FOUND = "qid long, query_id long, vec_id long, score double"


class Tree:
    """Nodes in arrays: ``children[i]`` is empty for a leaf, whose number is ``leaf[i]``."""

    def __init__(self, rows: np.ndarray):
        self.centroids, self.reach, self.children, self.leaf = [], [], [], []
        self.leaves = 0
        self._grow(rows, np.random.default_rng(SEED))
        self.centroids, self.reach = np.array(self.centroids), np.array(self.reach)

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> int:
        at, centre = len(self.children), rows.mean(0)
        self.centroids.append(centre)
        # What the best of len(rows) random directions adds for a query of length one.
        spread = math.sqrt(((rows - centre) ** 2).sum(1).mean())
        self.reach.append(spread * math.sqrt(min(1.0, 2 * math.log(len(rows) + 1) / rows.shape[1])))
        self.children.append([])
        self.leaf.append(-1)
        label = _k_means(rows, rng) if len(rows) > LEAF else np.zeros(len(rows), np.int64)
        parts = np.unique(label)
        if len(parts) < 2:
            self.leaf[at] = self.leaves
            self.leaves += 1
        else:
            self.children[at] = [self._grow(rows[label == p], rng) for p in parts]
        return at

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: at every node the child with the nearest centroid."""
        out, waiting = np.zeros(len(rows), np.int32), [(0, np.arange(len(rows)))]
        while waiting:
            node, at = waiting.pop()
            if not self.children[node]:
                out[at] = self.leaf[node]
                continue
            nearest = _nearest(rows[at], self.centroids[self.children[node]])
            waiting += [(child, at[nearest == i]) for i, child in enumerate(self.children[node]) if (nearest == i).any()]
        return out

    def visits(self, queries: np.ndarray) -> Iterator[Iterator[int]]:
        """For each query its leaves, best bin first."""
        promise = queries @ self.centroids.T + np.linalg.norm(queries, axis=1)[:, None] * self.reach[None, :]
        for row in promise:
            yield self._walk(row)

    def _walk(self, promise: np.ndarray) -> Iterator[int]:
        queue = [(-promise[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-promise[child], child))
            else:
                yield self.leaf[node]


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centres.T - (centres**2).sum(1) / 2, axis=1)


def _k_means(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    centres = rows[rng.choice(len(rows), min(BRANCHES, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        label = _nearest(rows, centres)
        centres = np.array([rows[label == j].mean(0) if (label == j).any() else rows[rng.integers(len(rows))] for j in range(len(centres))])
    return _nearest(rows, centres)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of a vector with rows, each summed on its own in extended precision."""
    return (query.astype(np.longdouble) * rows.astype(np.longdouble)).sum(-1).astype(np.float64)


def best_of(queries: np.ndarray, own: np.ndarray, visits: list[list[int]], rows: np.ndarray, ids: np.ndarray, leaf: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of each query's k best rows in the leaves it visits; rows with its own id don't count."""
    # Of equal rows the smallest ids do; one more of each, for a query's own.
    order = np.lexsort((ids, *rows.T[:3], leaf))
    same = np.zeros(len(ids), bool)
    same[1:] = (rows[order[1:]] == rows[order[:-1]]).all(1) & (ids[order[1:]] != ids[order[:-1]])
    run = np.arange(len(ids)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))
    kept = order[run <= k]
    rows, ids, leaf = rows[kept], ids[kept], leaf[kept]
    leaves, starts = np.unique(leaf, return_index=True)
    spans = dict(zip(leaves.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(leaf)])))
    slack = 1e-12 * np.abs(rows).max(initial=0) * rows.shape[1]
    for start in range(0, len(queries), 128):
        part, asks = queries[start : start + 128], {}
        for i, seen in enumerate(visits[start : start + 128]):
            for x in seen:
                asks.setdefault(x, []).append(i)
        rough = np.full((len(part), len(ids)), -np.inf)
        for x in asks.keys() & spans.keys():
            rough[asks[x], slice(*spans[x])] = part[asks[x]] @ rows[slice(*spans[x])].T
        rough[ids[None, :] == own[start : start + 128, None]] = -np.inf
        least = np.partition(rough, len(ids) - min(k, len(ids)), axis=1)[:, len(ids) - min(k, len(ids))]
        for i, query in enumerate(part):
            near = np.flatnonzero((rough[i] >= least[i] - slack * np.abs(query).max()) & (rough[i] > -np.inf))
            scores = exact_scores(query, rows[near])
            top = np.lexsort((ids[near], -scores))[:k]
            yield start + i, ids[near][top], scores[top]


def bins(sizes: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """Numbers of bins by (dim, leaf): leaves in a row share one up to ROWS_PER_BIN rows."""
    out, number, room, before = {}, -1, 0, None
    for (dim, leaf), n in sorted(sizes.items()):
        if dim != before or n > room:
            number, room, before = number + 1, ROWS_PER_BIN, dim
        out[dim, leaf], room = number, room - n
    return out


def _fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    tree = Tree(_matrix(table["embedding"]))
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})


def _indexed(trees, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row with its leaf; rows of different lengths don't meet."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for dim in table["dim"].unique().to_pylist():
            part = table.filter(pc.equal(table["dim"], dim))
            leaf = pa.array(trees.value[dim].assign(_matrix(part["embedding"])))
            yield from part.append_column("leaf", leaf).select(["dim", "leaf", "vec_id", "uid", "embedding"]).to_batches()


def _true_neighbours(asked, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best k of a batch for each query of the calibration: (qid, uid, leaf, score)."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for dim in table["dim"].unique().to_pylist():
            if dim not in asked.value:
                continue
            part = table.filter(pc.equal(table["dim"], dim))
            qids, own, queries = asked.value[dim]
            ids, uids, leaves = (part[c].to_numpy() for c in ("vec_id", "uid", "leaf"))
            scores = queries @ _matrix(part["embedding"]).T
            scores[ids[None, :] == own[:, None]] = -np.inf
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            held = np.take_along_axis(scores, top, 1)
            at, _ = np.nonzero(held > -np.inf)
            chosen = top[held > -np.inf]
            yield pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(uids[chosen]), pa.array(leaves[chosen]), pa.array(held[held > -np.inf])], names=["qid", "uid", "leaf", "score"])


def widened(ranks: np.ndarray, wanted: float) -> int:
    """The fewest visits at which the wanted share of neighbours is in visited leaves; ``ranks`` from 1."""
    visits = 1
    while (ranks <= visits).mean() < wanted:
        visits += 1
    return visits


def _spot(seed: int) -> Column:
    """A number from 0 to 1 by a row's hash."""
    return F.pmod(F.xxhash64("vec_id", "uid", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def _share(wanted: int, counts: dict[int, int]) -> Column:
    """The share of the rows of each length that gives about ``wanted`` of them at any size of the table."""
    share = F.lit(1.0)
    for dim, n in counts.items():
        share = F.when(F.col("dim") == dim, min(1.0, wanted / max(1, n))).otherwise(share)
    return share


class Index:
    """Every usable row of a table with its leaf, the trees, and the calibrated number of visits."""

    def __init__(self, vectors: DataFrame, every: int = 20, k: int = K, target: float = TARGET, sample: int = SAMPLE, calibration: int = CALIBRATION):
        spark = vectors.sparkSession
        usable = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        known = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
        usable = usable.where(F.coalesce(known, F.lit(False))).withColumn("dim", F.size("embedding")).withColumn("uid", F.monotonically_increasing_id())
        self.every, self.k = every, k
        asks = F.count_if(F.col("vec_id") % every == 0)
        sizes = usable.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), asks.alias("asks")).collect()
        counts = {r["dim"]: r["n"] for r in sizes}
        self.trees = self.visits = None
        if not counts:
            return
        # A share of the rows by their hash, so that the sample's size is about the same at any size of the table.
        spot, share = _spot(0), _share(sample, counts)
        # A tree needs a row at least: one of each length is always in.
        first = usable.groupBy("dim").agg(F.min_by(F.struct("embedding"), spot).alias("one")).select("dim", F.col("one.embedding").alias("embedding"))
        drawn = usable.where(spot < share).select("dim", "embedding").unionByName(first)
        fitted = drawn.groupBy("dim").applyInArrow(_fit, "dim int, tree binary").collect()
        self.trees = spark.sparkContext.broadcast({r["dim"]: pickle.loads(r["tree"]) for r in fitted})
        trees = self.trees
        self.table = materialize(usable.select("dim", "vec_id", "uid", "embedding").mapInArrow(lambda batches: _indexed(trees, batches), _INDEX), "index")
        self.visits = self._calibrated(target, calibration, {r["dim"]: r["asks"] for r in sizes})

    def _asked(self) -> DataFrame:
        return self.table.where(F.col("vec_id") % self.every == 0)

    def _calibrated(self, target: float, size: int, asks: dict[int, int]) -> dict[int, int]:
        """Visits by length of vectors.  About ``size`` queries of each length are compared with all rows."""
        spark = self.table.sparkSession
        few = self._asked().where(_spot(1) < _share(size, asks)).collect()
        asked = {}
        for dim in {r["dim"] for r in few}:
            own = [r for r in few if r["dim"] == dim]
            asked[dim] = np.array([r["uid"] for r in own]), np.array([r["vec_id"] for r in own]), np.array([r["embedding"] for r in own])
        held, k = spark.sparkContext.broadcast(asked), self.k
        near = self.table.mapInArrow(lambda batches: _true_neighbours(held, k, batches), "qid long, uid long, leaf int, score double")
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "uid")
        true = near.withColumn("i", F.row_number().over(best)).where(F.col("i") <= k).groupBy("qid").agg(F.collect_list("leaf").alias("leaves")).collect()
        leaves_of, visits = {r["qid"]: r["leaves"] for r in true}, {}
        for dim, (qids, _, queries) in asked.items():
            ranks = []
            for qid, walk in zip(qids.tolist(), self.trees.value[dim].visits(queries)):
                rank = {leaf: i for i, leaf in enumerate(walk, 1)}
                ranks += [rank[leaf] for leaf in leaves_of.get(qid, [])]
            visits[dim] = widened(np.array(ranks), target) if ranks else 1
        # Where no query of a length was drawn, its queries visit every leaf.
        return {dim: visits.get(dim, tree.leaves) for dim, tree in self.trees.value.items()}

    def search(self) -> DataFrame:
        """The k nearest found of each query: query_id, rank, vec_id, score."""
        spark, k = self.table.sparkSession, self.k
        # At most as many rows as the trees have leaves.
        held = {(r["dim"], r["leaf"]): r["rows"] for r in self.table.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("rows")).collect()}
        bin_of = bins(held)
        places = [(dim, leaf, number, held[dim, leaf]) for (dim, leaf), number in bin_of.items()]
        places = materialize(spark.createDataFrame(places, "dim int, leaf int, bin int, rows long"), "bins")
        known = spark.sparkContext.broadcast((held, bin_of))
        asked = self._asked()
        # Rows with a query's own id don't count, so it must see so many more.
        copies = asked.groupBy("vec_id").agg(F.count(F.lit(1)).alias("copies"))
        asked = asked.join(copies, "vec_id").select("dim", "vec_id", "uid", "embedding", "copies")
        trees, visits = self.trees, self.visits

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, bin_of = known.value
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for dim in table["dim"].unique().to_pylist():
                    part = table.filter(pc.equal(table["dim"], dim))
                    at, numbers, lists = [], [], []
                    for i, (copies, leaves) in enumerate(zip(part["copies"].to_pylist(), trees.value[dim].visits(_matrix(part["embedding"])))):
                        seen, visited, rows = {}, 0, 0
                        for leaf in leaves:
                            visited += 1
                            if (dim, leaf) in held:
                                rows += held[dim, leaf]
                                seen.setdefault(bin_of[dim, leaf], []).append(leaf)
                            if visited >= visits[dim] and rows >= k + copies:
                                break
                        at += [i] * len(seen)
                        numbers += seen.keys()
                        lists += seen.values()
                    for start in range(0, len(at), 4096):
                        some = slice(start, start + 4096)
                        out = part.select(["vec_id", "uid", "embedding"]).take(pa.array(at[some], pa.int64()))
                        out = out.append_column("bin", pa.array(numbers[some], pa.int32())).append_column("leaves", pa.array(lists[some], pa.list_(pa.int32())))
                        yield from out.to_batches()

        met = materialize(asked.mapInArrow(walk, "vec_id long, uid long, embedding array<double>, bin int, leaves array<int>"), "visits")
        asks = met.groupBy("bin").agg(F.count(F.lit(1)).alias("asks"))
        # How many tiles a bin has each way; a row per bin.
        grid = places.groupBy("bin").agg(F.sum("rows").alias("rows")).join(asks, "bin")
        grid = materialize(grid.select("bin", F.ceil(F.col("rows") / ROWS_PER_TILE).cast("int").alias("wide"), F.ceil(F.col("asks") / QUERIES_PER_TILE).cast("int").alias("high")), "grid")
        left = met.join(grid, "bin").withColumn("y", F.pmod(F.xxhash64("uid"), F.col("high")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
        right = self.table.join(places.select("dim", "leaf", "bin"), ["dim", "leaf"]).join(grid, "bin")
        right = right.withColumn("x", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("wide")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("high") - 1)))
        keys = ["bin", "x", "y"]

        def tile(queries: pa.Table, rows: pa.Table) -> pa.Table:
            out = [[], [], [], []]
            if queries.num_rows and rows.num_rows:
                qids, own = queries["uid"].to_numpy(), queries["vec_id"].to_numpy()
                found = best_of(_matrix(queries["embedding"]), own, queries["leaves"].to_pylist(), _matrix(rows["embedding"]), rows["vec_id"].to_numpy(), rows["leaf"].to_numpy(), k)
                for i, ids, scores in found:
                    for at, values in enumerate((np.full(len(ids), qids[i]), np.full(len(ids), own[i]), ids, scores)):
                        out[at].append(values)
            joined = [np.concatenate(c) if c else [] for c in out]
            return pa.table({n: pa.array(c, t) for n, c, t in zip(("qid", "query_id", "vec_id", "score"), joined, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))})

        left = left.select(*keys, "vec_id", "uid", "embedding", "leaves")
        found = left.groupBy(*keys).cogroup(right.select(*keys, "leaf", "vec_id", "uid", "embedding").groupBy(*keys)).applyInArrow(tile, _FOUND)
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = K, target: float = TARGET) -> DataFrame:
    """The k nearest found of each row whose vec_id is divisible by ``every``, by inner product.

    One row per query and rank: query_id, rank from 1, vec_id, score.  Ties go to
    the smaller vec_id; a query with fewer partners gets them all.  Rows without an
    id, with a null, empty or zero vector, or with a component that is null or not
    finite take no part.  Vectors of different lengths don't meet and have trees
    of their own.  Repeated rows are candidates each, but never of a query with
    their own id; a repeated query row gets a list of its own.  Other columns are
    ignored; a table without a usable row gives no rows.
    """
    with passing(vectors.sparkSession) as scope:
        index = Index(vectors, every, k, target)
        if index.trees is None:
            return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        out = materialize(index.search(), "nearest")
        scope.pop()
    return out
