"""Phrase mining with hashed buckets (PCY, DHP) and Apriori pruning before exact counts.

The texts are read once per phrase length.  The pass for m words counts phrases of
m words exactly and, on the side, hashes those of m + 1 words into buckets.  A
bucket below the least frequency proves that none of its phrases is frequent, so
the next pass counts a phrase only if its bucket is full and both its parts of m
words are frequent; only such phrases enter the buckets, too.

What is broadcast has a fixed size whatever the corpus holds: bitmaps of
``2 ** bits`` bits, of the full buckets and of the hashes of the frequent words and
phrases.
Bitmaps only prune; counts come from the phrases themselves, so a collision costs
time and nothing else.  A task holds one table of bucket counts, which stop at the
least frequency; tables are added up in two steps, first by task, then by block.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoplane.llm.shared import materialize, passing

LEAST = 10
LONGEST = 3
TOP = 2000
#: Log of the number of buckets; a bitmap takes 2 ** BITS / 8 bytes.
BITS = 25
#: Buckets of a table travel in blocks of so many.
BLOCK = 1 << 16
#: Words that a task handles at once, and distinct words it remembers.
SLICE = 1 << 17
KNOWN = 1 << 18
SALT = 8

_END = b"\xff"
#: Bytes that end a piece become one that no UTF-8 text holds.
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _END * 10)
_PARTIALS = "lang string, phrase binary, n long, part int, block int, data binary"
_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])


def tokens(text: bytes) -> list[bytes]:
    """The words of a text in lower case, with an end mark between pieces and at the end."""
    return text.lower().translate(_TABLE).replace(_END, b" \xff ").split() + [_END]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes."""
    x = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang))


class _Numbers(dict):
    """Numbers of a language's words; a new word gets the task's next, a rare one that of the end mark."""

    def __init__(self, lang: str, vocabulary: _Vocabulary):
        super().__init__({_END: 0})
        self.lang, self.vocabulary = lang, vocabulary

    def __missing__(self, word: bytes) -> int:
        known, h = self.vocabulary, word_hash(self.lang, word)
        if known.common is not None:
            at = h >> known.shift
            if not known.common[at >> 3] >> (at & 7) & 1:
                self[word] = 0
                return 0
        known.langs.append(self.lang)
        known.hashes.append(h)
        known.words.append(word)
        self[word] = number = len(known.words) - 1
        return number


class _Vocabulary:
    """Numbers of the words that a task has met, by language; 0 is the end mark.

    No phrase with a rare word is frequent, so rare words, too, end what is looked at.
    """

    def __init__(self, common: bytes | None, bits: int):
        self.words, self.langs, self.hashes, self._by_lang = [_END], [""], array("Q", [0]), {}
        self.common, self.shift = common, 64 - bits

    def __len__(self) -> int:
        return sum(map(len, self._by_lang.values()))

    def numbers(self, lang: str, found: list[bytes]) -> np.ndarray:
        if lang not in self._by_lang:
            self._by_lang[lang] = _Numbers(lang, self)
        return np.fromiter(map(self._by_lang[lang].__getitem__, found), np.int64, len(found))


class _Counts:
    """Exact counts of phrases as packed word numbers, merged whenever they have doubled."""

    def __init__(self):
        self.keys, self.counts, self.waiting, self.limit = [], [], 0, 4 * SLICE

    def add(self, keys: np.ndarray) -> None:
        found, n = np.unique(keys, return_counts=True)
        self.keys.append(found)
        self.counts.append(n)
        self.waiting += len(found)
        if self.waiting > self.limit:
            found, n = self.merged()
            self.keys, self.counts, self.waiting, self.limit = [found], [n], len(found), 2 * len(found) + 4 * SLICE

    def add_numbers(self, ids: np.ndarray) -> None:
        """Single words, whose numbers are dense: counted in place; the end mark doesn't count."""
        n = np.bincount(ids)
        n[0] = 0
        if not self.keys or len(self.counts[0]) < len(n):
            held = self.counts[0] if self.keys else n[:0]
            self.keys, self.counts = [np.arange(len(n))], [np.concatenate([held, np.zeros(len(n) - len(held), np.int64)])]
        self.counts[0][: len(n)] += n

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) == 1:
            met = self.counts[0] > 0
            return self.keys[0][met], self.counts[0][met]
        if not self.keys:
            return np.array([], np.int64), np.array([], np.int64)
        keys, where = np.unique(np.concatenate(self.keys), return_inverse=True)
        return keys, np.bincount(where, np.concatenate(self.counts)).astype(np.int64)


class _Buckets:
    """How often each bucket was met, up to ``least``."""

    def __init__(self, bits: int, least: int):
        if not 1 <= bits <= 32:
            raise ValueError("from 2 to 2 ** 32 buckets")
        self.least = least
        self.table = np.zeros(1 << bits, np.uint8 if least < 256 else np.uint32)

    def add(self, buckets: np.ndarray) -> None:
        at, n = np.unique(buckets.astype(np.uint32), return_counts=True)
        self.table[at] = np.minimum(self.table[at].astype(np.int64) + n, self.least)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """The blocks that hold a count; most counts are zero or small, so they pack well."""
        for i, block in enumerate(self.table.reshape(-1, min(BLOCK, len(self.table)))):
            if block.any():
                yield i, _packed(block)


def _bits_set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


#: Word numbers take so many bits of a packed phrase of up to three words.
_ROOM = 21


class _Pass:
    """One task's share of the pass for phrases of ``m`` words."""

    def __init__(self, m: int, common: bytes | None, frequent: bytes | None, full: bytes | None, bits: int, least: int, longest: int):
        bitmap = lambda b: None if b is None else np.frombuffer(b, np.uint8)
        self.m, self.common, self.frequent, self.full, self.bits, self.shift = m, common, bitmap(frequent), bitmap(full), bits, np.uint64(64 - bits)
        self.longest = longest
        self.buckets = _Buckets(bits, least) if m < longest else None
        self.waiting, self.words_waiting = {}, 0
        self._start()

    def _start(self) -> None:
        self.vocabulary, self.counts = _Vocabulary(self.common, self.bits), _Counts()
        self.hashes = np.zeros(1, np.uint64)

    def text(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        """Texts of a language wait until there are enough words."""
        found = tokens(text)
        self.waiting.setdefault(lang, []).extend(found)
        self.words_waiting += len(found)
        if self.words_waiting >= SLICE:
            yield from self.catch_up()

    def catch_up(self) -> Iterator[pa.RecordBatch]:
        for lang, found in self.waiting.items():
            for at in range(0, len(found), SLICE):
                if len(self.vocabulary) > KNOWN:
                    yield from self.flush()
                # The words before the slice are met again, for phrases that begin there.
                before = min(at, self.longest - 1)
                self._slice(self.vocabulary.numbers(lang, found[at - before : at + SLICE]), before)
        self.waiting, self.words_waiting = {}, 0

    def _slice(self, ids: np.ndarray, before: int) -> None:
        if len(self.hashes) < len(self.vocabulary.hashes):
            self.hashes = np.array(self.vocabulary.hashes)
        h = self.hashes[ids]
        if self.m == 1:
            self.counts.add_numbers(ids[before:])
            wanted = (ids[:-1] > 0) & (ids[1:] > 0)
            at = np.flatnonzero(wanted[max(0, before - 1) :]) + max(0, before - 1)
            self.buckets.add(mixed(h[at], h[at + 1]) >> self.shift)
            return
        # passes[i]: the phrase of m words from i on may be frequent
        width = len(ids) - self.m + 1
        if width <= 0:
            return
        passes = ids[:width] > 0
        for k in range(1, self.m):
            passes &= ids[k : k + width] > 0
        at = np.flatnonzero(passes)
        first, second = h[at], h[at + 1]
        for k in range(1, self.m - 1):
            first, second = mixed(first, h[at + k]), mixed(second, h[at + k + 1])
        whole = mixed(h[at], h[at + 1])
        for k in range(2, self.m):
            whole = mixed(whole, h[at + k])
        fine = _bits_set(self.frequent, first >> self.shift) & _bits_set(self.frequent, second >> self.shift) & _bits_set(self.full, whole >> self.shift)
        passes[at] = fine
        kept = at[fine]
        own = kept[kept >= before - (self.m - 1)] if before else kept
        key = ids[own]
        for k in range(1, self.m):
            key = (key << _ROOM) | ids[own + k]
        self.counts.add(key)
        if self.buckets is not None:
            longer = kept[:-1][np.diff(kept) == 1]
            if before:
                longer = longer[longer >= before - self.m]
            prefix = mixed(h[longer], h[longer + 1])
            for k in range(2, self.m + 1):
                prefix = mixed(prefix, h[longer + k])
            self.buckets.add(prefix >> self.shift)

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Rows (lang, phrase, n), after which the words met are forgotten."""
        keys, counts = self.counts.merged()
        words, langs = pa.array(self.vocabulary.words, pa.binary()), pa.array(self.vocabulary.langs, pa.string())
        for start in range(0, len(keys), 100_000):
            part = keys[start : start + 100_000]
            columns = [pa.array((part >> (_ROOM * k)) & ((1 << _ROOM) - 1)) for k in reversed(range(self.m))]
            phrases = words.take(columns[0])
            if self.m > 1:
                phrases = pc.binary_join_element_wise(phrases, *[words.take(c) for c in columns[1:]], pa.scalar(b" ", pa.binary()))
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [langs.take(columns[0]), phrases, pa.array(counts[start : start + n]), *[pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary())]],
                schema=_ARROW,
            )
        self._start()

    def tables(self) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for block, data in self.buckets.blocks() if self.buckets is not None else ():
            yield pa.RecordBatch.from_pylist([{"part": part, "block": block, "data": data}], schema=_ARROW)


def _counting(m: int, common, frequent, full, bits: int, least: int, longest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [None if b is None else b.value for b in (common, frequent, full)]
        task = _Pass(m, *bitmaps, bits, least, longest)
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                yield from task.text(lang.as_py(), text.as_py())
        yield from task.catch_up()
        yield from task.flush()
        yield from task.tables()

    return run


_BLOCKS = "part int, block int, data binary"


def _block(part: int, block: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([data], pa.binary())], names=["part", "block", "data"])


def _packed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.tobytes(), codec="lz4_raw", asbytes=True)


def _unpacked(data: pa.Buffer, kind: type, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * np.dtype(kind).itemsize, codec="lz4_raw"), kind)


def _adding(least: int, size: int, as_bits: bool) -> Callable:
    """Adds up blocks of bucket counts; at last a bit says whether a bucket is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, part = {}, TaskContext.get().partitionId()
        for batch in batches:
            for block, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                counts = _unpacked(data.as_buffer(), np.uint8 if least < 256 else np.uint32, size)
                known = sums.get(block)
                sums[block] = counts if known is None else np.minimum(known.astype(np.int64) + counts, least).astype(counts.dtype)
        for block, counts in sums.items():
            yield _block(part, block, np.packbits(counts >= least, bitorder="little").tobytes() if as_bits else _packed(counts))

    return run


def _uniting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of bitmaps, united."""
    sums, part = {}, TaskContext.get().partitionId()
    for batch in batches:
        for block, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            bits = np.frombuffer(data, np.uint8)
            sums[block] = sums[block] | bits if block in sums else bits
    for block, bits in sums.items():
        yield _block(part, block, bits.tobytes())


def _marking(bits: int) -> Callable:
    """A bitmap of where phrases hash to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, width, part = np.zeros((1 << bits) // 8, np.uint8), min(BLOCK, 1 << bits) // 8, TaskContext.get().partitionId()
        for batch in batches:
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = [np.array([word_hash(lang, w)], np.uint64) for w in phrase.split(b" ")]
                whole = h[0]
                for x in h[1:]:
                    whole = mixed(whole, x)
                at = int(whole[0]) >> (64 - bits)
                bitmap[at >> 3] |= 1 << (at & 7)
        for i, block in enumerate(bitmap.reshape(-1, width)):
            if block.any():
                yield _block(part, i, block.tobytes())

    return run


def _broadcast(blocks: DataFrame, bits: int):
    """A bitmap from its blocks; its size is fixed by ``bits``."""
    bitmap, width = bytearray((1 << bits) // 8), min(BLOCK, 1 << bits) // 8
    for row in blocks.select("block", "data").collect():
        bitmap[row["block"] * width : (row["block"] + 1) * width] = row["data"]
    return blocks.sparkSession.sparkContext.broadcast(bytes(bitmap))


def _in_two_steps(rows: DataFrame, first: Callable, last: Callable) -> DataFrame:
    """Blocks merged by the task that made them, so that no step reads many tables, then by their numbers."""
    parts = rows.agg(F.count_distinct("part")).first()[0]
    if parts > 16:
        rows = rows.repartition(math.isqrt(parts), "part").mapInArrow(first, _BLOCKS)
    return rows.repartition(min(16, max(1, parts)), "block").mapInArrow(last, _BLOCKS)


def frequent_phrases(docs: DataFrame, scope: list[str], least: int = LEAST, longest: int = LONGEST, bits: int = BITS) -> tuple[list[DataFrame], DataFrame]:
    """Written tables (lang, phrase, a) of the frequent phrases of 1, 2, ... words, and (lang, n): all its words.

    Languages without a word have no rows.  The tables' paths go to ``scope``; what a
    pass writes for itself is removed after it.
    """
    if not 2 <= longest <= 63 // _ROOM:
        raise ValueError(f"phrases may have 2 to {63 // _ROOM} words")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    tables, totals, common, frequent, full = [], None, None, None, None
    for m in range(1, longest + 1):
        with passing(spark) as spent:
            met = materialize(texts.mapInArrow(_counting(m, common, frequent, full, bits, least, longest), _PARTIALS), f"phrases{m}")
            counted = met.where("phrase IS NOT NULL")
            if m == 1:
                totals = materialize(counted.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
                scope.append(spent.pop())
            table = materialize(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least), f"frequent{m}")
            scope.append(spent.pop())
            tables.append(table.withColumn("phrase", F.col("phrase").cast("string")))
            if m < longest:
                counts = met.where("block IS NOT NULL").select("part", "block", "data")
                full = _broadcast(_in_two_steps(counts, _adding(least, min(BLOCK, 1 << bits), False), _adding(least, min(BLOCK, 1 << bits), True)), bits)
                marks = materialize(table.select("lang", "phrase").mapInArrow(_marking(bits), _BLOCKS), "marks")
                frequent = _broadcast(_in_two_steps(marks, _uniting, _uniting), bits)
                common = common or frequent
    return tables, totals


def _slices(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Phrases (lang, phrase, a, words) with the l, r and score of their lowest cut."""
    n = F.size("words")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), n - 1))).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)).cast("int"))
    cuts = cuts.withColumn("left", _slices(F.col("words"), F.lit(1), F.col("k"))).withColumn("right", _slices(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")))
    # A very common word begins many phrases: each part is held once per salt.  The planner knows the
    # size of the files only, which says little about that of the rows, so it must not broadcast them.
    held = counts.select("lang", "phrase", "a", F.explode(F.array(*map(F.lit, range(SALT)))).alias("salt")).hint("merge")
    for part, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(held.select("lang", "salt", F.col("phrase").alias(part), F.col("a").alias(name)), ["lang", "salt", part])
    exact = F.expr("(CAST(1000000 AS DECIMAL(7, 0)) * (CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)))) DIV (CAST(l AS DECIMAL(15, 0)) * CAST(r AS DECIMAL(15, 0)))")
    lowest = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").cast("long").alias("score"))


def _apart(scored: DataFrame, phrases: DataFrame) -> DataFrame:
    """The scored phrases that don't lie inside a longer one of at least half their frequency."""
    # The most frequent longer phrase decides whether what lies inside it goes.
    inner = phrases.where(F.size("words") > 2).withColumn("m", F.explode(F.expr("sequence(2, size(words) - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, size(words) - m + 1)")))
    inner = inner.groupBy("lang", _slices(F.col("words"), F.col("at"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    return scored.join(inner.hint("merge"), ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 50 * a").drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A null language is ``und``, a null text an empty one; neither crashes nor
    counts otherwise.  Repeated rows and copies count each.  Texts of any length
    are counted whole, in slices.  Ties are broken by the counts, then by the
    phrase.  Other columns are ignored; an empty table gives no rows.  Counts may
    have up to 15 digits, with which scores are exact.
    """
    spark = docs.sparkSession
    with passing(spark) as scope:
        tables, totals = frequent_phrases(docs, scope, least, longest, bits)
        counts = tables[0]
        for table in tables[1:]:
            counts = counts.unionByName(table)
        phrases = tables[1]
        for table in tables[2:]:
            phrases = phrases.unionByName(table)
        phrases = phrases.withColumn("words", F.split("phrase", " "))
        kept = _apart(_scored(phrases, counts), phrases)
        # A language may hold most phrases: each part of it ranks its own first.
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(16))).orderBy(*order)
        best = kept.withColumn("own", F.row_number().over(part)).where(F.col("own") <= top).drop("own")
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
        out = materialize(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
        scope.pop()
    return out
