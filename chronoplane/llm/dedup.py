"""Near-duplicates: BagMinHash signatures, bands, verified multiset overlap.

A text is the multiset of its windows of ``SHINGLE`` words.  Two texts are linked
when their weighted Jaccard similarity, sum of least counts over sum of largest
counts, is ``SIMILARITY`` or more; classes are the connected components.

Signatures.  The weight axis is cut at whole counts and grouped into dyadic
levels [0,1), [1,2), [2,4), ...  Each window has on each level a Poisson process
of points in time; a point also has a position on the level and one of ``PARTS``
signature places.  A text whose count reaches into a level sees the points below
its count.  Each place keeps its earliest point, so two texts agree on a place
with a probability that equals their weighted Jaccard similarity.  Points are
drawn in order of time, and a process ends when it passes the latest of the
text's places, so a text costs little more than its windows.

Bands.  ``BANDS`` bands of ``ROWS`` places deal texts into buckets; with 0.8 a
pair misses all of them three times in a million.  Equal multisets are one node
from the start.  Bands are exploded once, and only buckets that several nodes
share are kept.  A bucket isn't expanded into pairs.  First each node is compared
with the least node of its buckets, once for each pair however many buckets they
share.  What a bucket still holds of different components is then compared in
tiles of bounded blocks by an inverted index: the members of its largest
component need only meet the others, not each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplane.llm.graph import components
from chronoplane.llm.shared import WORD, filesystem, materialize, passing

SHINGLE = 5
#: Similarity as a fraction, so that the comparison is exact.
SIMILARITY = (4, 5)
BANDS, ROWS = 32, 5
PARTS = BANDS * ROWS
#: Windows in one block of a bucket, and texts' windows in one signature batch.
BLOCK = 100_000
BATCH = 200_000

_words = re.compile(WORD).findall
_U = np.uint64
_GAMMA, _PRIME = _U(0x9E3779B97F4A7C15), _U(0x100000001B3)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit generator; its constants are fixed values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 500_000:
            self[word] = value
        return value


_hashes = _WordHashes()


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, window hash, count) of all texts, sorted by text and hash.

    A text with fewer words than a window has one window of all its words.
    """
    lists = [_words(t) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((_hashes[w] for x in lists for w in x), np.uint64, int(sizes.sum()))
    with np.errstate(over="ignore"):
        first = np.repeat(np.cumsum(sizes) - sizes, np.maximum(sizes - SHINGLE + 1, np.minimum(sizes, 1)))
        text = np.repeat(np.arange(len(texts)), np.maximum(sizes - SHINGLE + 1, np.minimum(sizes, 1)))
        start = first + (np.arange(len(first)) - np.searchsorted(text, text))
        length = np.minimum(sizes[text], SHINGLE)
        value = length.astype(np.uint64)
        for j in range(SHINGLE):
            there = j < length
            value = np.where(there, _mix(value * _PRIME + flat[np.minimum(start + j, max(len(flat) - 1, 0))]), value) if len(flat) else value
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text)))


def signatures(n_texts: int, text: np.ndarray, value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The BagMinHash signature of each text, as times; infinite for no windows."""
    levels = np.ceil(np.log2(count)).astype(np.int64) + 1 if len(count) else np.zeros(0, np.int64)
    item = np.repeat(np.arange(len(text)), levels)
    level = np.arange(len(item)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    doc, most = text[item], count[item].astype(np.float64)
    out = np.full(n_texts * PARTS, np.inf)
    latest = np.full(n_texts, np.inf)
    with np.errstate(over="ignore"):
        seed = _mix(value[item] + _GAMMA * (level + 1).astype(np.uint64))
        drawn, time = np.zeros(len(item), np.uint64), np.zeros(len(item))
        live = np.arange(len(item))
        while len(live):
            burst = int(min(64, max(1, 50_000 // len(live))))
            turn = (drawn[live, None] + np.arange(1, burst + 1, dtype=np.uint64)) * _GAMMA
            a, b = _mix(seed[live, None] + turn), _mix(~seed[live, None] + turn)
            gap = -np.log(((a >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            when = time[live, None] + np.cumsum(gap, axis=1) / (width[live, None] * PARTS)
            place = ((b >> _U(44)) % _U(PARTS)).astype(np.int64)
            position = low[live, None] + width[live, None] * ((b & _U((1 << 40) - 1)).astype(np.float64) * 2.0**-40)
            seen = (position < most[live, None]) & (when <= latest[doc[live], None])
            np.minimum.at(out, (doc[live, None] * PARTS + place)[seen], when[seen])
            drawn[live] += _U(burst)
            time[live] = when[:, -1]
            touched = np.unique(doc[live])
            latest[touched] = out.reshape(n_texts, PARTS)[touched].max(axis=1)
            live = live[time[live] <= latest[doc[live]]]
    return out.reshape(n_texts, PARTS)


def _bands(signature: np.ndarray) -> np.ndarray:
    """A bucket for each text and band."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    value = np.broadcast_to(_mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _GAMMA), bits.shape[:2])
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            value = _mix(value * _PRIME + bits[:, :, j])
    return value.view(np.int64)


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with a bounded number of characters in all."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 200
        if size >= 6 * BATCH or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for lo, hi in _portions(texts):
            text, value, count = windows(texts[lo:hi])
            bands = _bands(signatures(hi - lo, text, value, count))
            ends = np.searchsorted(text, np.arange(hi - lo + 1))
            node, n, buckets = [], [], []
            for i in range(hi - lo):
                own = slice(ends[i], ends[i + 1])
                node.append(xxhash.xxh3_128_digest(value[own].tobytes() + count[own].tobytes()))
                n.append(int(count[own].sum()))
                buckets.append(bands[i] if n[-1] else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(texts[lo:hi], pa.string()), pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "text", "node", "n", "bands"],
            )


class _Tiles:
    """Rows of several tiles, each tile's rows together: uid, label, side, text.

    Rows of side 1 meet those of side 2 in their tile, rows of side 0 each other.
    """

    def __init__(self):
        self.rows, self.starts, self.size, self.key = [], [], 0, None

    def add(self, key: tuple, row: tuple) -> None:
        if key != self.key:
            self.key = key
            self.starts.append(len(self.rows))
        self.rows.append(row)
        self.size += len(row[3]) + 200


def _links(tiles: _Tiles) -> list[tuple[int, int]]:
    """Links between the components that meet in a tile, a forest of them per tile.

    The k-th occurrence of a window is a feature of its own, so shared features
    count the multiset overlap; an inverted index of features counts them.
    """
    labels, sides = [r[1] for r in tiles.rows], np.array([r[2] for r in tiles.rows])
    text, value, count = windows([r[3] for r in tiles.rows])
    starts = np.array([*tiles.starts, len(tiles.rows)])
    tile = np.searchsorted(starts, np.arange(len(labels)), "right") - 1
    doc = np.repeat(text, count)
    with np.errstate(over="ignore"):
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        feature = _mix(_mix(np.repeat(value, count) + _GAMMA * nth.astype(np.uint64)) + _GAMMA * tile[doc].astype(np.uint64))
    size, ends = np.bincount(doc, minlength=len(labels)), np.searchsorted(doc, np.arange(len(labels) + 1))
    _, feature = np.unique(feature, return_inverse=True)
    posting, spread = doc[np.argsort(feature, kind="stable")], np.bincount(feature)
    first = np.cumsum(spread) - spread
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    top, bottom = SIMILARITY
    found = []
    for t, (lo, hi) in enumerate(zip(starts[:-1], starts[1:])):
        parent.clear()
        target = sides[lo:hi] != 1
        for i in np.flatnonzero(sides[lo:hi] != 2) + lo:
            own = feature[ends[i] : ends[i + 1]]
            own = own[spread[own] > 1]
            length = spread[own]
            at = np.repeat(first[own] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            shared = np.bincount(posting[at] - lo, minlength=hi - lo)
            near = (bottom * shared >= top * (size[i] + size[lo:hi] - shared)) & target
            if sides[i] == 0:
                near[i - lo :] = False
            for j in np.flatnonzero(near) + lo:
                a, b = root(labels[i]), root(labels[j])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((labels[i], labels[j]))
    return found


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the tiles of a partition, whose rows come sorted by tile."""

    def finish():
        found = _links(tiles)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    tiles = _Tiles()
    for batch in batches:
        a, b, c, uid, label, side, text = batch.columns
        for key, *row, body in zip(zip(a.to_pylist(), b.to_pylist(), c.to_pylist()), uid.to_pylist(), label.to_pylist(), side.to_pylist(), text):
            if key != tiles.key and tiles.size >= 6 * BATCH:
                yield finish()
                tiles = _Tiles()
            tiles.add(key, (*row, body.as_py()))
    if tiles.rows:
        yield finish()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept.

    ``class_id`` is the least doc_id of the class and ``kept`` true for one row of
    it.  Texts without words, null ones too, are equal texts and so one class.
    Words are what stands between white space, as written.  Repeated rows are
    copies of each other.  A null doc_id is never a class's id unless all are
    null.  Other columns are ignored; an empty table gives no rows.
    """
    with passing(docs.sparkSession) as made:
        out = materialize(_report(_signed(docs)).select("doc_id", "class_id", "class_size", "kept"), "report")
        made.pop()
    return out


def _signed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id"), "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = rows.mapInArrow(_sign, f"doc_id {kind}, digest string, text string, node binary, n long, bands array<long>")
    return materialize(signed.withColumn("uid", F.monotonically_increasing_id()), "signed")


def _report(signed: DataFrame) -> DataFrame:
    heads = materialize(signed.groupBy("node").agg(F.min("uid").alias("uid")), "heads")
    nodes = materialize(signed.join(heads.select("uid"), "uid", "left_semi").where("n > 0").select("uid", "node", "n", "bands"), "nodes")
    with passing(signed.sparkSession) as made:
        roots = _components(nodes, signed)
        if roots is not None:
            roots = materialize(roots, "roots")
            made.pop()
    labelled, label = signed.select("doc_id", "uid", "digest", "node"), F.col("node")
    if roots is not None:
        every = roots.unionByName(roots.select(F.col("root").alias("uid"), "root").distinct())
        linked = materialize(nodes.select("uid", "node").join(every, "uid").select("node", F.unhex(F.hex("root")).alias("root")), "linked")
        labelled, label = labelled.join(linked, "node", "left"), F.coalesce("root", "node")
    labelled = labelled.withColumn("label", label)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "uid"))
    classes = labelled.groupBy("label").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size"))
    classes = materialize(classes.select("label", F.col("first.doc_id").alias("class_id"), F.col("first.uid").alias("kept_uid"), "class_size"), "classes")
    return labelled.join(classes, "label").withColumn("kept", F.col("uid") == F.col("kept_uid"))


def _components(nodes: DataFrame, signed: DataFrame) -> DataFrame | None:
    """(uid, root) for the nodes that links join to a lesser one, or None without links."""
    entries = nodes.select("uid", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    shared = materialize(entries.join(buckets, "bucket"), "shared")
    met = nodes.join(shared.select("uid").distinct(), "uid", "left_semi").select("uid", "n")
    met = materialize(met, "met")
    texts = _texts(met, signed)
    found = materialize(_beside_rep(shared, met, texts), "links")
    roots = None if found.isEmpty() else _roots(found)
    found = materialize(_beside_others(shared, met, texts, roots), "links")
    if found.isEmpty():
        return roots
    return _roots(found if roots is None else found.unionByName(roots.select(F.col("uid").alias("u"), F.col("root").alias("v"))))


def _roots(links: DataFrame) -> DataFrame:
    return components(links).withColumnRenamed("node", "uid")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts at given places, whose rows come sorted by file."""

    def read(path: str, wanted: list[int]) -> Iterator[pa.RecordBatch]:
        fs, where = filesystem(path)
        own = pa.array(wanted, pa.int64())
        with fs.open_input_file(where) as file:
            for part in pq.ParquetFile(file).iter_batches(batch_size=256, columns=["uid", "text"]):
                yield part.select(["uid", "text"]).filter(pc.is_in(part.column("uid"), value_set=own))

    path, wanted = None, []
    for batch in batches:
        for uid, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if at != path and wanted:
                yield from read(path, wanted)
                wanted = []
            path = at
            wanted.append(uid)
    if wanted:
        yield from read(path, wanted)


def _texts(met: DataFrame, signed: DataFrame) -> DataFrame:
    """(uid, text) of the nodes that share a bucket.

    ``signed`` holds a file per task, and a uid begins with the task's number, so
    a text is read from its file.  No other text moves.
    """
    task = F.shiftright("uid", 33).alias("task")
    files = signed.select(task, F.col("_metadata.file_path").alias("path")).distinct()
    places = met.select("uid", task).join(materialize(files, "files"), "task").select("uid", "path")
    return materialize(places.repartition("path").sortWithinPartitions("path").mapInArrow(_fetch, "uid long, text string"), "texts")


def _compared(tiles: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) of labels in tiles, given as a, b, c (the tile), uid, label, side."""
    rows = tiles.join(texts.hint("merge"), "uid").select("a", "b", "c", "uid", "label", "side", "text")
    return rows.repartition("a", "b", "c").sortWithinPartitions("a", "b", "c").mapInArrow(_verify, "u long, v long").distinct()


def _beside_rep(shared: DataFrame, met: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between a bucket's least node and the other nodes in it.

    A node that is the least of many others' buckets meets them in blocks.
    """
    pairs = materialize(shared.where("uid <> rep").select("uid", "rep").distinct().join(met.select("uid", "n"), "uid"), "pairs")
    sizes = materialize(pairs.groupBy("rep").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks")), "sizes")
    zero = F.lit(0).cast("long").alias("c")
    members = pairs.join(sizes, "rep").select(F.col("rep").alias("a"), F.pmod(F.xxhash64("uid"), F.col("blocks")).alias("b"), zero, "uid", F.col("uid").alias("label"), F.lit(2).alias("side"))
    reps = sizes.select(F.col("rep").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"), zero, F.col("rep").alias("uid"), F.col("rep").alias("label"), F.lit(1).alias("side"))
    return _compared(members.unionByName(reps), texts)


def _beside_others(shared: DataFrame, met: DataFrame, texts: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Links between the components that still meet in a bucket, its least node left out."""
    rest = shared.where("uid <> rep").select("bucket", "uid").join(met.select("uid", "n"), "uid")
    rest = rest.withColumn("label", F.col("uid")) if roots is None else rest.join(roots, "uid", "left").withColumn("label", F.coalesce("root", "uid")).drop("root")
    rest = materialize(rest, "rest")
    parts = rest.groupBy("bucket", "label").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("uid")).alias("x"))
    buckets = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("s", "label")).alias("top"), F.sum("s").alias("s"), F.sum("k").alias("k"), F.bit_xor("x").alias("x")).where("labels > 1")
    # Bands that gather the same texts need one visit.
    buckets = buckets.groupBy("s", "k", "x").agg(F.min(F.struct("bucket", F.col("top.label").alias("most"), F.col("top.s").alias("m"))).alias("v"))
    blocks = lambda n: F.ceil(n / BLOCK)
    whole = F.col("s") <= BLOCK
    buckets = buckets.select(F.col("v.bucket").alias("bucket"), F.col("v.most").alias("most"), F.when(whole, 0).otherwise(blocks(F.col("v.m"))).alias("p"), F.when(whole, 1).otherwise(blocks(F.col("s") - F.col("v.m"))).alias("q"))
    buckets = materialize(buckets, "buckets")
    own = F.xxhash64("uid")
    inner = (F.col("label") == F.col("most")) & (F.col("p") > 0)
    rows = rest.join(buckets, "bucket").withColumn("block", F.when(inner, F.pmod(own, F.col("p"))).otherwise(F.col("p") + F.pmod(own, F.col("q"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(inner, F.col("p")).otherwise(F.lit(0)).cast("long"), F.col("p") + F.col("q") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") > F.col("other"), 1).otherwise(2)
    tiles = rows.select(F.col("bucket").alias("a"), F.least("block", "other").alias("b"), F.greatest("block", "other").alias("c"), "uid", "label", side.alias("side"))
    return _compared(materialize(tiles, "members"), texts)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, one of each class, with all columns.

    Nulls, empty texts, repeated rows and ties are treated as in
    ``near_duplicates``; columns may have any names; an empty table gives no rows.
    """
    with passing(docs.sparkSession) as made:
        report = _report(_signed(docs))
        copies = report.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
        kept = materialize(copies.where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "rows"), "kept")
        made.pop()
    body = docs.select(F.struct("*").alias("row")).withColumn("digest", F.md5(F.coalesce("row.text", F.lit("")).cast("binary")))
    chosen = body.join(kept, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    if not kept.where("rows > 1").isEmpty():
        chosen = chosen.dropDuplicates(["_id", "_digest"])
    return chosen.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
