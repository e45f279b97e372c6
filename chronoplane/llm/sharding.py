"""Sharding by balanced label propagation over documents with equal texts.

Documents with equal texts are linked.  Every document starts with a label, the
shard that its own hash names.  In each round the documents of a group look at their
neighbours' labels: the group asks for the shard that most of them name among those
with room for it, or else for one by hash in proportion to the room.  A shard grants
what it is asked for, larger groups first, up to its quota: running sums over buckets
of asks, of which only the buckets' totals meet.  Granted groups settle.  In the
others, documents whose shard has no room left take the label that their group asked
for, and the next round starts from these labels; each settles a group at least, and
the rounds end when no group fits anywhere.  Groups larger than ``1 / LARGE`` of a
shard's quota go before the others, so that these leave them room.

A group larger than a shard's quota takes whole shards first.  What fits nowhere
in the end, fewer groups than there are shards, fills what room is left: only these
groups are split.  Documents without links fill up the shards, so the ``rows`` law
holds exactly: the shards' counts differ by at most one.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoplane.llm.shared import materialize, numbered

SHARDS = 16
#: A group is large from this share of a shard's quota on; there are at most LARGE * shards of them.
LARGE = 64


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _with_room(room: list[int], n: str) -> Column:
    """The shards with room for n rows, as an array."""
    every = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(r).cast("long").alias("r")) for s, r in enumerate(room)])
    return F.transform(F.filter(every, lambda x: x["r"] >= F.col(n)), lambda x: x["s"])


def _by_shard(values: list[int], shard: str) -> Column:
    """The shard's value."""
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col(shard))


def _granted(asks: DataFrame, room: list[int], groups: int) -> DataFrame:
    """The asks (g, n, to) that fit, larger ones first, by running sums of n per shard.

    Asks of one shard are dealt into buckets by the power of two of their size and a
    hash, so no task takes a shard's asks whole; only the buckets' totals meet.
    """
    dealt = max(1, -(-groups // 20_000))
    bucket = (63 - F.floor(F.log2("n"))) * dealt + F.pmod(F.xxhash64("g"), F.lit(dealt))
    asks = asks.withColumn("bucket", bucket.cast("long"))
    totals = asks.groupBy("to", "bucket").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("to").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("to").alias("_to"), F.col("bucket").alias("_b"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    upto = Window.partitionBy("to", "bucket").orderBy(F.desc("n"), "g").rowsBetween(Window.unboundedPreceding, 0)
    summed = asks.withColumn("upto", F.sum("n").over(upto)).join(starts, (F.col("to") == F.col("_to")) & (F.col("bucket") == F.col("_b")))
    return summed.where(F.col("start") + F.col("upto") <= _by_shard(room, "to")).select("g", "n", F.col("to").alias("shard"))


def _propagate(groups: DataFrame, labels: DataFrame, room: list[int]) -> list[DataFrame]:
    """Tables (g, shard) of the groups (g, n) that settle whole; takes from ``room``.

    ``labels`` has (g, label, mass): how many documents of a group bear a label.
    """
    settled, turn = [], 0
    while True:
        fits = groups.withColumn("fits", _with_room(room, "n")).where(F.size("fits") > 0)
        borne = fits.select("g", "fits").join(labels, "g")
        most = borne.where(F.array_contains("fits", F.col("label"))).groupBy("g").agg(F.max(F.struct("mass", F.xxhash64("g", "label").alias("h"), "label")).alias("m"))
        # Room is named in proportion, so that few are refused.
        total = sum(room)
        spot, ends, to = F.pmod(F.xxhash64("g", F.lit(turn)), F.lit(max(1, total))), 0, F.lit(None).cast("int")
        for s, r in enumerate(room):
            to = F.coalesce(to, F.when((spot < ends + r) & (F.col("n") <= r), s))
            ends += r
        any_fit = F.element_at("fits", (F.pmod(F.xxhash64("g", F.lit(-1 - turn)), F.size("fits")) + 1).cast("int"))
        asks = materialize(fits.join(most, "g", "left").select("g", "n", F.coalesce("m.label", to, any_fit).alias("to")), "asks")
        open_ = asks.count()
        if not open_:
            return settled
        moved = materialize(_granted(asks, room, open_), "moved")
        # One row per shard.
        for r in moved.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            room[r["shard"]] -= r["n"]
        settled.append(moved.select("g", "shard"))
        refused = asks.join(moved.select("g"), "g", "left_anti")
        # Documents of refused groups leave shards without room for their group and follow its ask.
        follow = F.when(F.col("n") <= _by_shard(room, "label"), F.col("label")).otherwise(F.col("to"))
        labels = materialize(labels.join(refused, "g").select("g", follow.alias("label"), "mass").groupBy("g", "label").agg(F.sum("mass").alias("mass")), "labels")
        groups = materialize(groups.join(moved.select("g"), "g", "left_anti"), "open")
        turn += 1


def _spread(totals: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(g, first, last, shard): the rows of groups (g, n) that no shard takes whole, most room first."""
    out = []
    for g, n in sorted(totals, key=lambda t: (-t[1], t[0])):
        first = 0
        while first < n:
            s = max(range(len(room)), key=lambda i: (room[i], -i))
            if not room[s]:
                break
            take = min(room[s], n - first)
            out.append((g, first, first + take, s))
            room[s] -= take
            first += take
    return out


def place_groups(groups: DataFrame, labels: DataFrame, room: list[int]) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """(g, shard) of whole groups, and the spread of those that must be split."""
    quota = max(room, default=0)
    # At most as many as there are shards hold more than a shard's quota.
    giants = [(r["g"], r["n"]) for r in groups.where(F.col("n") > quota).collect()]
    spread = _spread(giants, room)
    large = F.col("n") * LARGE > quota
    rest = groups.where(F.col("n") <= quota)
    placed = _propagate(rest.where(large), labels, room) + _propagate(rest.where(~large), labels, room)
    whole = groups.sparkSession.createDataFrame([], "g long, shard int")
    for moved in placed:
        whole = whole.unionByName(moved)
    whole = materialize(whole, "whole")
    # A large one needs more room than any shard had left; of the others fewer than shards remain,
    # since each needs more room than any shard has, and all together no more than there is.
    left = [(r["g"], r["n"]) for r in rest.join(whole, "g", "left_anti").collect()]
    return whole, spread + _spread(left, room)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: its shard from 0 and its slot, gapless from 0 in the shard.

    Also size (bytes of the text plus 1), text_crc32, law (``rows``) and
    grown_shard (null under this law).  A null text has no bytes; null texts are
    equal texts of their own kind.  Repeated rows are documents each, linked by
    their text.  doc_id may be null.  Ties are broken by hashes of the values.
    Other columns are ignored; an empty table gives no rows.  A group of copies
    is split only if it is larger than a shard or fits into no shard's rest.
    """
    kind = F.when(F.col("text").isNull(), F.lit("-")).otherwise(F.sha2("text", 256))
    facts = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(kind).alias("g"),
        F.monotonically_increasing_id().alias("uid"),
    )
    facts = materialize(facts, "facts")
    rows = facts.count()
    groups = materialize(facts.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    start = F.pmod(F.xxhash64("g", "uid"), F.lit(shards)).cast("int").alias("label")
    labels = materialize(facts.select("g", start).groupBy("g", "label").agg(F.count(F.lit(1)).alias("mass")).join(groups.select("g"), "g", "left_semi"), "labels")
    room = quotas(rows, shards)
    whole, spread = place_groups(groups, labels, room)
    known = materialize(facts.join(whole, "g", "left"), "known")
    placed, filler = known.where("shard IS NOT NULL"), known.where("shard IS NULL")
    if spread:
        split = facts.sparkSession.createDataFrame(spread, "g long, first long, last long, to int")
        several = materialize(filler.join(F.broadcast(split.select("g").distinct()), "g", "left_semi"), "several")
        ranked = numbered(several, "g", ["uid"], "i")
        fits = ranked.join(F.broadcast(split), "g").where("i >= first AND i < last").withColumn("shard", F.col("to")).select(*placed.columns)
        placed = placed.unionByName(fits)
        filler = filler.join(F.broadcast(split.select("g").distinct()), "g", "left_anti")
    filler = numbered(materialize(filler.withColumn("all", F.lit(0)), "filler"), "all", ["uid"], "rank")
    # At most ``shards`` numbers: where each shard's share of the filler ends.
    spans = defaultdict(lambda: (0, 0))
    end = 0
    for s in range(shards):
        spans[s] = end, end + room[s]
        end += room[s]
    slot = F.lit(None).cast("int")
    for s in range(shards):
        slot = F.coalesce(slot, F.when(F.col("rank") < spans[s][1], F.lit(s)))
    done = placed.unionByName(filler.withColumn("shard", slot).select(*placed.columns))
    done = materialize(done.select("doc_id", "size", "text_crc32", "uid", "shard"), "placed")
    out = numbered(done, "shard", ["uid"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
