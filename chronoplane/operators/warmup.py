"""When a chain of stages becomes known: observation needs propagated along a graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Stage:
    """A column made from others.

    It is known from the ``needs``-th observation on that has all its ``parents``,
    ``after`` rows later: a window that holds the current row has 0, one that ends
    before it has 1.
    """

    name: str
    parents: tuple[str, ...]
    needs: int = 1
    after: int = 0


def ordered(stages: list[Stage], inputs: list[str]) -> list[Stage]:
    """The stages so that each follows its parents; an unknown parent or a cycle is an error."""
    known, waiting, out = set(inputs), list(stages), []
    while waiting:
        ready = [s for s in waiting if set(s.parents) <= known]
        if not ready:
            raise ValueError("stages without their parents: " + ", ".join(sorted(s.name for s in waiting)))
        out += ready
        known.update(s.name for s in ready)
        waiting = [s for s in waiting if s.name not in known]
    return out


def dependency_map(df: DataFrame, key: str, order: str, inputs: list[str], stages: list[Stage], check: bool = True) -> DataFrame:
    """(key, stage, parents, needs, ready_row, ready, binding, observed) for each key and stage.

    ``ready`` is the day from which the stage can be known, by the first known days
    of the inputs and the needs along the graph; ``binding`` is the parent, or the
    input behind a chain of stages, that is known last.  ``observed`` is the day on
    which the stage's column is first known, if ``df`` has one and ``check`` is set;
    gaps in the inputs make it later than ``ready``.  Rows are numbered once per
    key; all the rest is one row per key.
    """
    by = Window.partitionBy(key).orderBy(order)
    numbered = df.withColumn("_i", F.row_number().over(by))
    plan = ordered(stages, inputs)
    present = [s.name for s in plan if check and s.name in df.columns]
    firsts = [F.min(F.when(F.col(c).isNotNull(), F.col("_i"))).alias(f"r_{c}") for c in inputs]
    seen = [F.min(F.when(F.col(c).isNotNull(), F.col(order))).alias(f"o_{c}") for c in present]
    one = numbered.groupBy(key).agg(*firsts, *seen, F.max("_i").alias("_n"))
    for c in inputs:
        one = one.withColumn(f"b_{c}", F.lit(c))
    for s in plan:
        # Where a parent is never known, neither is the stage.
        every = reduce(lambda a, b: a & b, [F.col(f"r_{p}").isNotNull() for p in s.parents])
        last = F.when(every, F.array_max(F.array(*[F.struct(F.col(f"r_{p}").alias("r"), F.lit(-i).alias("i"), F.lit(p).alias("p"), F.col(f"b_{p}").alias("b")) for i, p in enumerate(s.parents)])))
        one = one.withColumn("_l", last).withColumns({f"r_{s.name}": F.col("_l.r") + (s.needs - 1 + s.after), f"b_{s.name}": F.col("_l.b"), f"p_{s.name}": F.col("_l.p")})
    long = F.explode(
        F.array(*[
            F.struct(F.lit(s.name).alias("stage"), F.lit(",".join(s.parents)).alias("parents"), F.lit(s.needs).alias("needs"), F.col(f"r_{s.name}").alias("ready_row"), F.col(f"p_{s.name}").alias("binding_parent"), F.col(f"b_{s.name}").alias("binding_input"),
                     (F.col(f"o_{s.name}") if s.name in present else F.lit(None).cast(df.schema[order].dataType)).alias("observed"))
            for s in plan
        ])
    )
    flat = one.select(key, long.alias("s")).select(key, "s.*")
    days = numbered.select(F.col(key).alias("_k"), F.col("_i"), F.col(order).alias("ready"))
    met = flat.join(days, F.col(key).eqNullSafe(F.col("_k")) & (F.col("ready_row") == F.col("_i")), "left")
    return met.select(key, "stage", "parents", "needs", "ready_row", "ready", "binding_parent", "binding_input", "observed")


def explained(days: DataFrame, key: str, stage: str) -> DataFrame:
    """The chain of binding parents behind one stage of each key, last stage first, down to the input."""
    steps = days.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("stage", F.struct("binding_parent", "ready")))).alias("m"))
    # A graph of stages is short: its length bounds the walk.
    walk = F.aggregate(
        F.map_keys("m"),
        F.array(F.struct(F.lit(stage).alias("stage"), F.element_at("m", F.lit(stage))["ready"].alias("ready"))),
        lambda acc, _: F.when(
            F.element_at("m", F.element_at(acc, -1)["stage"])["binding_parent"].isNotNull(),
            F.concat(acc, F.array(F.struct(F.element_at("m", F.element_at(acc, -1)["stage"])["binding_parent"].alias("stage"), F.element_at("m", F.element_at("m", F.element_at(acc, -1)["stage"])["binding_parent"])["ready"].alias("ready")))),
        ).otherwise(acc),
    )
    return steps.select(key, F.array_join(F.transform(walk, lambda s: s["stage"]), " <- ").alias("chain"))
