"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the expected number of its copies.  Among all rates
up to ``MAX_COPIES`` that give every source its target of words, entropy
balancing takes those nearest to 1 in Kullback-Leibler divergence.  The convex
dual has one multiplier per source, and its solution tilts rates exponentially
by size: ``rate = min(MAX_COPIES, exp(multiplier * size / scale))``.  Newton
steps find all multipliers at once, each a distributed sum over a table of
(source, size, number of documents); a bracket catches steps that leave it.

Rates become whole copies: the fractions are compared with a hash of the
document's id and size and, among repeated ones, its place, and per source a threshold on the difference is chosen up to which the words taken don't
exceed the target.  The threshold is found by radix selection, 12 bits at a
time, so no source is ever sorted in one task.  ``PICKS`` single documents of
the size that is still missing then close the gap.  Sums are decimals, so reruns
agree.  Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoplane.llm.shared import WORD, materialize, numbered, packed

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
#: Newton stops when every source is this near to its target, relatively, or its
#: bracket holds no number between its ends.
TOLERANCE = 1e-7
#: Bits of the rounding key and of one radix step.
KEY_BITS = 48
STEP_BITS = 12
#: Documents added one by one after the threshold.
PICKS = 3


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """A source as a text that is never null and sorts as asked: null comes last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(k, source_size, target) from (k, source_size), one row per source.

    Shares follow the weights until a source would exceed MAX_COPIES times its
    size; what is over goes to the others by weight.  In the order of
    size / weight the sources that stop come first, so one pass decides.  It
    orders all sources in one task: a short row each, however many documents.
    """
    by_name = Window.orderBy("k")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long")
    top = MAX_COPIES * F.col("source_size")
    filling = Window.orderBy(F.col("source_size") / F.col("w"), "k")
    earlier, later, every = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing), filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = sizes.withColumn("w", weight).withColumn("total", F.sum("source_size").over(every))
    out = out.withColumn("rest", F.col("total") - F.coalesce(F.sum(top).over(earlier), F.lit(0)))
    out = out.withColumn("stops", top * F.sum("w").over(later) <= F.col("w") * F.col("rest"))
    free = lambda x: F.coalesce(F.sum(F.when(~F.col("stops"), x)).over(every), F.lit(0))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), top)).over(every), F.lit(0))
    return out.select("k", "source_size", F.when(F.col("stops"), top.cast("double")).otherwise((F.col("w") * left).cast("double") / free(F.col("w"))).alias("target"))


def _rate(size: str = "size") -> Column:
    tilt = F.exp(F.col("lam") * F.col(size) / F.col("scale"))
    return F.when(F.col("target") >= MAX_COPIES * F.col("source_size"), F.lit(float(MAX_COPIES))).otherwise(F.least(F.lit(float(MAX_COPIES)), tilt))


def solve(histogram: DataFrame, targets: DataFrame) -> DataFrame:
    """(k, source_size, target, scale, lam): the multiplier of each source."""
    n_words = F.col("n") * F.col("size")
    scale = histogram.groupBy("k").agg((F.sum((n_words * F.col("size")).cast("decimal(38,0)")).cast("double") / F.sum(n_words)).alias("scale"))
    state = targets.where("source_size > 0").join(scale, "k")
    log = F.log(F.col("target") / F.col("source_size"))
    state = state.select(
        "k", "source_size", "target", "scale",
        F.lit(0.0).alias("lam"),
        F.when(log < 0, F.col("scale") * log).otherwise(F.lit(0.0)).alias("lo"),
        F.when(log < 0, F.lit(0.0)).otherwise(F.col("scale") * F.log(F.lit(float(MAX_COPIES)))).alias("hi"),
        F.lit(None).cast("double").alias("last"),
        F.lit(False).alias("done"),
    )
    state = materialize(state, "dual")
    while True:
        words = n_words * _rate()
        slope = F.when(_rate() < MAX_COPIES, words * F.col("size") / F.col("scale")).otherwise(F.lit(0.0))
        exact = lambda c: F.sum(c.cast("decimal(38,10)")).cast("double")
        sums = histogram.join(state.where("not done"), "k").groupBy("k").agg(exact(words).alias("f"), exact(slope).alias("g"))
        off = F.col("f") - F.col("target")
        lo, hi = F.when(off > 0, F.col("lo")).otherwise(F.col("lam")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - off / F.nullif(F.col("g"), F.lit(0.0))
        middle = (lo + hi) / 2
        inside = newton.isNotNull() & (newton > lo) & (newton < hi) & ~F.coalesce(F.abs(off) > 0.5 * F.col("last"), F.lit(False))
        near = (F.abs(off) <= TOLERANCE * F.col("target")) | (F.col("target") >= MAX_COPIES * F.col("source_size")) | (middle <= lo) | (middle >= hi)
        state = state.join(sums, "k", "left").select(
            "k", "source_size", "target", "scale",
            F.when(F.col("done") | near, F.col("lam")).when(inside, newton).otherwise(middle).alias("lam"),
            F.when(F.col("done"), F.col("lo")).otherwise(lo).alias("lo"),
            F.when(F.col("done"), F.col("hi")).otherwise(hi).alias("hi"),
            F.abs(off).alias("last"),
            (F.col("done") | near).alias("done"),
        )
        state = materialize(state, "dual")
        if state.where("not done").isEmpty():
            break
    return state.select("k", "source_size", "target", "scale", "lam")


def _rounding(df: DataFrame) -> DataFrame:
    """Add whole (copies at least), key (order in which a copy is added, or null) and mark."""
    out = df.withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate()))
    out = out.withColumn("whole", F.floor("rate").cast("long"))
    out = out.withColumn("mark", F.xxhash64("doc_id", "size", "place"))
    luck = F.shiftrightunsigned("mark", 11) / F.lit(float(1 << 53))
    order = (1.0 - (F.col("rate") - F.col("whole") - luck)) * F.lit(float(1 << (KEY_BITS - 1)))
    return out.withColumn("key", F.when(F.col("rate") > F.col("whole"), F.least(F.floor(order).cast("long"), F.lit((1 << KEY_BITS) - 1))))


def _thresholds(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(k, limit, picked): a copy is added where key <= limit or the mark is picked."""
    base = rows.groupBy("k").agg(F.sum(F.col("whole") * F.col("size")).alias("have"))
    #: prefix: the radix digits found so far; need: words still wanted within it.
    found = model.join(base, "k").select("k", F.lit(0).cast("long").alias("prefix"), (F.col("target") - F.col("have")).alias("need"))
    found = materialize(found, "radix")
    keyed = rows.where("key IS NOT NULL").select("k", "size", "key")
    for used in range(STEP_BITS, KEY_BITS + 1, STEP_BITS):
        digit = F.shiftright("key", KEY_BITS - used)
        inside = keyed.join(found, "k").where(F.shiftright(digit, STEP_BITS) == F.col("prefix")) if used > STEP_BITS else keyed.join(found, "k")
        cells = inside.withColumn("d", digit).groupBy("k", "need", "d").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("k").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
        ranked = cells.withColumn("upto", F.sum("words").over(upto)).withColumn("before", F.col("upto") - F.col("words"))
        # The cell in which the need is met; the last one where all fall short.
        last = F.max("d").over(Window.partitionBy("k"))
        meets = ranked.withColumn("last", last).where((F.col("before") <= F.col("need")) & ((F.col("upto") > F.col("need")) | (F.col("d") == F.col("last"))))
        cell = meets.groupBy("k").agg(F.min(F.struct("d", "before", "upto", "need")).alias("c"))
        found = cell.select("k", F.col("c.d").alias("prefix"), (F.col("c.need") - F.col("c.before")).alias("need"), (F.col("c.upto") - F.col("c.before")).alias("words"))
        found = materialize(found, "radix")
    # The last cell is left to the picks.
    state = found.select("k", (F.col("prefix") - 1).alias("limit"), F.col("need"), F.array().cast("array<long>").alias("picked"))
    for _ in range(PICKS):
        state = materialize(state, "picks")
        spare = rows.join(state, "k").where((F.col("size") > 0) & (F.col("size") < 2 * F.col("need")) & (_copies() < MAX_COPIES))
        best = spare.groupBy("k").agg(F.min(F.struct(F.abs(F.col("size") - F.col("need")).alias("off"), "mark", "size")).alias("c"))
        state = state.join(best, "k", "left").select(
            "k", "limit", (F.col("need") - F.coalesce("c.size", F.lit(0))).alias("need"),
            F.concat("picked", F.when(F.col("c").isNotNull(), F.array("c.mark")).otherwise(F.array().cast("array<long>"))).alias("picked"),
        )
    return state.select("k", "limit", "picked")


SAME = ("k", "doc_id", "size")


def _placed(rows: DataFrame, repeated: DataFrame, *first: str) -> DataFrame:
    """Add place: the number of a row, from 0, among those with equal k, doc_id and size.

    ``repeated`` lists what several rows share; hardly any do, and only those are
    numbered, in the order of the columns ``first``.
    """
    if repeated.isEmpty():
        return rows.withColumn("place", F.lit(0).cast("long"))
    others = repeated.select(*[F.col(c).alias(f"_{c}") for c in SAME])
    match = (F.col("k") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("size") == F.col("_size"))
    alone = rows.join(others, match, "left_anti").withColumn("place", F.lit(0).cast("long"))
    several = rows.join(others, match, "left_semi").withColumn("same", F.struct(*SAME)).withColumn("uid", F.monotonically_increasing_id())
    return alone.unionByName(numbered(materialize(several, "several"), "same", [*first, "uid"], "place").select(*alone.columns))


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes of the documents, what several rows share, model per source) for the mix."""
    sizes = materialize(docs.select("doc_id", source_key(F.col("source")).alias("k"), size_of(F.col("text")).alias("size")), "sizes")
    repeated = materialize(sizes.groupBy(*SAME).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*SAME), "repeated")
    sizes = _placed(sizes, repeated)
    if not repeated.isEmpty():
        sizes = materialize(sizes, "sizes")
    histogram = materialize(sizes.where("size > 0").groupBy("k", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    totals = sizes.groupBy("k").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(totals), "targets")
    model = solve(histogram, targets)
    model = materialize(targets.join(model.select("k", "scale", "lam"), "k", "left").na.fill({"scale": 1.0, "lam": 0.0}), "model")
    limits = _thresholds(_rounding(sizes.join(model, "k")), model)
    return sizes, repeated, materialize(model.join(limits, "k", "left").na.fill({"limit": -1}).withColumn("picked", F.coalesce("picked", F.array().cast("array<long>"))), "mix")


def _copies() -> Column:
    """Copies of a row that has whole, key and mark, by its source's limit and picks."""
    one = lambda c: F.when(c, 1).otherwise(0)
    return F.col("whole") + one(F.col("key") <= F.col("limit")) + F.size(F.filter("picked", lambda m: m == F.col("mark")))


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, words taken.

    A null or empty text has size 0 and takes nothing.  A null source is the
    last source.  Repeated rows, null ids too, each count and are each taken or
    left on their own.  Ties are broken by a hash.  Other columns are ignored; an
    empty table gives no rows.
    """
    sizes, _, model = plan(docs)
    mixed = _rounding(sizes.join(model, "k")).withColumn("copies", _copies())
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents, each as many times as the mix takes it, with all columns.

    The small model meets the documents where they are; of the texts only those
    of repeated rows are shuffled.  A document without words, a null text too,
    stays once.  Null sources and ids, repeated rows and ties are treated as in
    ``mix_report``; columns may have any names; an empty table gives no rows.
    """
    _, repeated, model = plan(docs)
    body = packed(docs, "doc_id").withColumn("k", source_key(F.col("row.source"))).withColumn("size", size_of(F.col("row.text")))
    body = _placed(body.withColumn("order", F.xxhash64("row")), repeated, "order")
    copies = _rounding(body.join(model, "k")).withColumn("copies", _copies()).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
