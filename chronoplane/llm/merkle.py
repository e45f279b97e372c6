"""A Merkle manifest of a dataset, built and checked in Pregel-style supersteps.

Every row is a leaf.  Per language the leaves stand in the order of their ids, and
every ``FANOUT`` consecutive nodes have a parent, until one node is left; the
languages' nodes are the leaves of one more tree.  In an upward superstep children
message their parents, and a parent that has heard all its children hashes and
sends on.  In a downward superstep a parent tells each child the digests beside its
path; a leaf folds its own digest with what it is told and compares the root.

Vertices are placed by subtree: a block holds ``FANOUT ** LAYER`` nodes and what is
above them up to one.  Messages within a block are delivered where they are; only
every ``LAYER``-th superstep shuffles, upwards one digest and downwards one path for
a block.  Each layer is written to the shared folder on the way up; a lost
executor costs the layer at hand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from chronoplane.llm.shared import materialize, passing

FANOUT = 8
#: Supersteps within a block, which so holds FANOUT ** LAYER nodes at most.
LAYER = 4
ROWS_PER_PART = 50_000
#: The tree over the languages.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    """A value with its length in bytes before it; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """The digest of a row whose text is ``text``."""
    values = [text if c == "text" else F.col(c) for c in FIELDS]
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def place(key: tuple[int, int]) -> int:
    """A hash of a block; whole numbers hash alike in every process."""
    return hash(key)


def ordered_numbers(df: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """Add ``name``, the place of a row within its tree, and ``n``, the rows of the tree.

    Rows are ranged over parts by all of ``order``, so neither a large tree nor a
    frequent id is in one task; only the parts' counts meet.
    """
    rows = df.count()
    parts = max(1, -(-rows // ROWS_PER_PART))
    ranged = df.repartitionByRange(parts, tree, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    counts = ranged.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    by_tree = Window.partitionBy(tree)
    before = F.sum("_rows").over(by_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(tree, "_part", F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_rows").over(by_tree).alias("n"))
    within = Window.partitionBy(tree, "_part").orderBy(*order)
    own = ranged.withColumn("_i", F.row_number().over(within) - 1)
    return own.join(starts, [tree, "_part"]).withColumn(name, F.col("_start") + F.col("_i")).drop("_start", "_i", "_part")


def supersteps(n: int, layer: int) -> int:
    """Supersteps in a block of a tree that has n nodes at the layer's bottom."""
    steps = 0
    while n > 1 and steps < layer:
        n, steps = -(-n // FANOUT), steps + 1
    return steps


def climb(digests: list[str], steps: int) -> list[list[str]]:
    """A block's levels, lowest first; children send their digests to the parents of the next."""
    levels = [digests]
    for _ in range(steps):
        heard: dict[int, list[str]] = {}
        for i, own in enumerate(levels[-1]):
            heard.setdefault(i // FANOUT, []).append(own)
        levels.append([digest(heard[i]) for i in range(len(heard))])
    return levels


def descend(levels: list[list[str]], path: tuple | None) -> list[tuple | None]:
    """What each node at the bottom hears: ((own place, digests beside), what its parent heard)."""
    told = [path]
    for nodes in reversed(levels[:-1]):
        heard = []
        for i in range(len(nodes)):
            run, at = nodes[i - i % FANOUT : i - i % FANOUT + FANOUT], i % FANOUT
            heard.append(((at, run[:at] + run[at + 1 :]), told[i // FANOUT]))
        told = heard
    return told


def _blocks(rows: RDD, parts: int, size: int) -> RDD:
    """Rows ((tree, index), value) by block: ((tree, block), [(index in the block, value)]), at most ``size`` of them."""
    return rows.map(lambda r: ((r[0][0], r[0][1] // size), (r[0][1] % size, r[1]))).groupByKey(parts, place).mapValues(sorted)


def _ascend(leaves: DataFrame, most: int, parts: int, layer: int) -> list[DataFrame]:
    """Layers (tree, index, n, node) from the leaves to one node a tree; n counts the tree's nodes on the layer."""
    spark, layers, size = leaves.sparkSession, [leaves], FANOUT**layer
    while most > 1:

        def top(block: tuple) -> tuple:
            (tree, index), members = block
            n = members[0][1][0]
            return tree, index, -(-n // size), climb([own for _, (_, own) in members], supersteps(n, layer))[-1][0]

        rows = layers[-1].rdd.map(lambda r: ((r["tree"], r["index"]), (r["n"], r["node"])))
        above = spark.createDataFrame(_blocks(rows, parts, size).map(top), "tree int, index long, n long, node string", verifySchema=False)
        layers.append(materialize(above, f"layer{len(layers)}"))
        most = -(-most // size)
    return layers


def _tell(rows: RDD, told: RDD, parts: int, layer: int, answer: Callable) -> RDD:
    """``answer`` of each row ((tree, index), (n, node, more)) and the path it hears by way of its block."""
    size = FANOUT**layer
    nodes = _blocks(rows.mapValues(lambda v: (0, v)), parts, size)
    # Both sides are placed alike, so nothing but the paths of blocks moves.
    both = nodes.union(told.partitionBy(parts, place)).groupByKey(parts, place)

    def deliver(block: tuple) -> Iterator:
        (tree, index), found = block
        members = next(v for v in found if isinstance(v, list))
        path, note = next(v for v in found if isinstance(v, tuple))
        levels = climb([v[1] for _, (_, v) in members], supersteps(members[0][1][1][0], layer))
        for (i, (_, v)), heard in zip(members, descend(levels, path)):
            yield answer(tree, index * size + i, v, heard, note)

    return both.flatMap(deliver)


def _unrolled(path: tuple | None) -> Iterator[tuple[int, list[str]]]:
    while path is not None:
        step, path = path
        yield step


def fold(own: str, path: tuple | None) -> str:
    """The root that a leaf's digest leads to, with the digests beside its path."""
    for i, beside in _unrolled(path):
        own = digest([*beside[:i], own, *beside[i:]])
    return own


def proof(path: tuple | None) -> str:
    return digest([d for _, beside in _unrolled(path) for d in beside])


def manifest(docs: DataFrame, layer: int = LAYER) -> DataFrame:
    """One row per document: leaf, subroot, root, proof_sha256, folded_root, verified.

    Nulls have an encoding of their own, empty texts another.  Leaves without an
    id come first, equal ids are ordered by their digests, and repeated rows are
    leaves each.  Texts are hashed whole.  A row without an id isn't tampered
    with.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_digest(F.translate("text", UPPER, LOWER)))
    with passing(spark) as scope:
        facts = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf_digest(F.col("text")).alias("leaf"), tampered.alias("tampered"), F.monotonically_increasing_id().alias("uid"))
        facts = materialize(facts, "leaves")
        # A row per language; nulls first, then by the bytes of the name.
        langs = materialize(facts.select("lang").distinct().withColumn("all", F.lit(0)), "langs")
        named = ordered_numbers(langs, "all", ["lang"], "tree").select(F.col("lang").alias("name"), F.col("tree").cast("int").alias("tree"))
        named = materialize(named, "trees")
        numbered = ordered_numbers(facts.join(named, F.col("lang").eqNullSafe(F.col("name"))), "tree", ["doc_id", "leaf", "uid"], "index")
        leaves = materialize(numbered.select("doc_id", "leaf", "tampered", "tree", "index", "n"), "numbered")
        bounds = leaves.agg(F.max("n").alias("n"), F.max("tree").alias("last"), F.count(F.lit(1)).alias("rows")).first()
        if not bounds["rows"]:
            return _empty(docs)
        parts, trees = max(spark.sparkContext.defaultParallelism, -(-bounds["rows"] // ROWS_PER_PART)), bounds["last"] + 1

        layers = _ascend(leaves.select("tree", "index", "n", F.col("leaf").alias("node")), bounds["n"], parts, layer)
        # The node left of each tree is a leaf of the top tree.
        tops = layers[-1].select(F.lit(TOP).alias("tree"), F.col("tree").cast("long").alias("index"), F.lit(trees).cast("long").alias("n"), "node")
        above = _ascend(tops, trees, parts, layer)
        root = above[-1].first()["node"]

        told = spark.sparkContext.parallelize([((TOP, 0), (None, root))], 1)
        nodes = lambda table: table.rdd.map(lambda r: ((r["tree"], r["index"]), (r["n"], r["node"])))
        for table in reversed(above[:-1]):
            told = _tell(nodes(table), told, parts, layer, lambda tree, i, v, path, _: ((tree, i), (path, v[1])))
        # A language's tree hears the path of its node, and keeps its node as the subroot.
        told = told.map(lambda v: ((v[0][1], 0), v[1]))
        for table in reversed(layers[1:-1]):
            told = _tell(nodes(table), told, parts, layer, lambda tree, i, v, path, subroot: ((tree, i), (path, subroot)))
        rows = leaves.rdd.map(lambda r: ((r["tree"], r["index"]), (r["n"], r["leaf"], r["tampered"], r["doc_id"])))

        def verified(tree: int, i: int, v: tuple, path: tuple | None, subroot: str) -> tuple:
            _, leaf, fake, doc_id = v
            folded = fold(fake or leaf, path)
            return doc_id, leaf, subroot, root, proof(path), folded, folded == root

        out = spark.createDataFrame(_tell(rows, told, parts, layer, verified), _empty(docs).schema, verifySchema=False)
        out = materialize(out, "manifest")
        scope.pop()
    return out


def _empty(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = StructType([StructField("doc_id", kind if kind.typeName() != "void" else LongType()), *[StructField(c, StringType()) for c in names]]).add("verified", "boolean")
    return docs.sparkSession.createDataFrame([], schema)
