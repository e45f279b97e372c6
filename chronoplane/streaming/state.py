"""Recursions whose state outlives a run: seeded from a batch, continued by a stream, trimmed by age.

State is kept by Spark in named, typed parts (``transformWithStateInPandas`` over the
RocksDB store): the recursion's machine and, if wanted, the last rows of a key.  A
first stream starts from a table of states, which a batch fold or an earlier run
wrote, so history needn't be replayed.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The session setting that typed state needs, and its value.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(column: pd.Series) -> list:
    return [None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for v in column.tolist()]


def _frame(carried: pd.DataFrame, rows: list[tuple], added: T.StructType) -> pd.DataFrame:
    out = carried.reset_index(drop=True)
    for i, f in enumerate(added.fields):
        out[f.name] = pd.Series([r[i] for r in rows], dtype="float64" if isinstance(f.dataType, T.DoubleType) else "object")
    return out


def fold_states(df: DataFrame, key: str, order: str, make: Callable, inputs: list[str], keep_rows: int = 0) -> DataFrame:
    """The state of a recursion at the end of each key's rows: (key, at, machine, tail).

    ``tail`` holds the inputs of the last ``keep_rows`` rows, oldest first.  The table is
    what a stream is seeded with, and can be written as Parquet and read back.
    """
    tail = T.ArrayType(T.StructType([T.StructField("at", df.schema[order].dataType), *[df.schema[c] for c in inputs]]))
    schema = T.StructType([df.schema[key], T.StructField("at", df.schema[order].dataType), T.StructField("machine", T.BinaryType()), T.StructField("tail", tail)])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        machine = make()
        columns = [_plain(pdf[c]) for c in inputs]
        for values in zip(*columns):
            machine.step(*values)
        last = [dict(zip(["at", *inputs], row)) for row in list(zip(pdf[order].tolist(), *columns))[len(pdf) - min(keep_rows, len(pdf)) :]]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "at": [pdf[order].iloc[-1]], "machine": [pickle.dumps(machine)], "tail": [last]})

    return df.select(*dict.fromkeys([key, order, *inputs])).groupBy(key).applyInPandas(finish, schema)


class _Continued(StatefulProcessor):
    """One key's recursion: rows after the last one fed continue it; others are dropped and counted."""

    def __init__(self, key: str, order: str, make: Callable, inputs: list[str], added: T.StructType, kinds: tuple[T.DataType, ...], keep_rows: int, ttl_ms: int | None):
        self.key, self.order, self.make, self.inputs, self.added = key, order, make, inputs, added
        self.kinds, self.keep_rows, self.ttl_ms = kinds, keep_rows, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        at, *values = self.kinds
        self.machine = handle.getValueState("machine", T.StructType([T.StructField("at", at), T.StructField("machine", T.BinaryType())]))
        row = T.StructType([T.StructField("at", at), *[T.StructField(c, k) for c, k in zip(self.inputs, values)]])
        self.tail = handle.getListState("tail", row, self.ttl_ms) if self.keep_rows else None

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        seed = initialState.iloc[-1]
        at = seed["at"].to_pydatetime() if isinstance(seed["at"], pd.Timestamp) else seed["at"]
        self.machine.update((at, bytes(seed["machine"])))
        if self.tail is not None and len(seed["tail"]):
            rows = [r.asDict() if isinstance(r, Row) else r for r in seed["tail"]][-self.keep_rows :]
            self.tail.put([tuple(r[c] for c in ("at", *self.inputs)) for r in rows])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, machine = None, None
        if self.machine.exists():
            at, blob = self.machine.get()
            machine = pickle.loads(blob)
        else:
            machine = self.make()
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        if at is not None:
            # What was fed already, or is older, can't be fed again.
            pdf = pdf[pdf[self.order] > at]
        if pdf.empty:
            return
        columns = [_plain(pdf[c]) for c in self.inputs]
        made = [machine.step(*values) for values in zip(*columns)]
        last = pdf[self.order].iloc[-1]
        self.machine.update((last.to_pydatetime() if isinstance(last, pd.Timestamp) else last, pickle.dumps(machine)))
        held = pd.Series([None] * len(pdf))
        if self.tail is not None:
            known = [tuple(r) for r in self.tail.get()]
            times = [t.to_pydatetime() if isinstance(t, pd.Timestamp) else t for t in pdf[self.order].tolist()]
            known = (known + list(zip(times, *columns)))[-self.keep_rows :]
            self.tail.put(known)
            held = pd.Series([len(known)] * len(pdf))
        out = _frame(pdf[[self.key, self.order]], made, self.added)
        out["rows_held"] = held.astype("float64").tolist() if self.tail is None else held.tolist()
        yield out

    def close(self) -> None:
        pass


def continued_fold(stream: DataFrame, key: str, order: str, make: Callable, inputs: list[str], outputs: str, seed: DataFrame | None = None, keep_rows: int = 0, ttl_ms: int | None = None) -> DataFrame:
    """``run_fold`` over a stream that goes on from ``seed``, a table of ``fold_states``.

    Rows no later than a key's last one are not fed again, so a replayed file changes
    nothing.  The last ``keep_rows`` rows of a key are kept beside its machine and
    forgotten ``ttl_ms`` after they were written; rows_held says how many there are.
    The session must use the RocksDB store (``STORE``).
    """
    if stream.sparkSession.conf.get(STORE, "") != ROCKS:
        raise ValueError(f"set {STORE} to {ROCKS}")
    added = T._parse_datatype_string(outputs)
    schema = T.StructType([stream.schema[key], stream.schema[order], *added.fields, T.StructField("rows_held", T.LongType())])
    kinds = (stream.schema[order].dataType, *[stream.schema[c].dataType for c in inputs])
    processor = _Continued(key, order, make, inputs, added, kinds, keep_rows, ttl_ms)
    rows = stream.select(*dict.fromkeys([key, order, *inputs])).groupBy(key)
    mode = "ProcessingTime" if ttl_ms is not None else "None"
    return rows.transformWithStateInPandas(processor, schema, "Append", mode, initialState=None if seed is None else seed.groupBy(key))


class _Deadlines(StatefulProcessor):
    """One key's weeks: when each one's first row came, and a timer for its deadline."""

    def __init__(self, key: str, period: str, at: str, grace_ms: int, step_ms: int):
        self.key, self.period, self.at, self.grace_ms, self.step_ms = key, period, at, grace_ms, step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "period timestamp", "at timestamp")
        self.waiting = handle.getValueState("waiting", "period timestamp")

    def _deadline(self, period: pd.Timestamp) -> int:
        return int(period.timestamp() * 1000) + self.grace_ms

    def _expect(self, period: pd.Timestamp) -> None:
        self.waiting.update((period.to_pydatetime(),))
        self.handle.registerTimer(self._deadline(period))

    def _rows(self, key: tuple, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(found), "period": [p for p, _, _ in found], "status": [s for _, s, _ in found], "first_at": pd.Series([a for _, _, a in found], dtype="datetime64[us]")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        firsts = pd.concat(list(rows)).groupby(self.period)[self.at].min().sort_index()
        found = []
        for period, at in firsts.items():
            slot = (period.to_pydatetime(),)
            if self.seen.containsKey(slot):
                continue
            self.seen.updateValue(slot, (at.to_pydatetime(),))
            late = int(at.timestamp() * 1000) > self._deadline(period)
            found.append((period, "late" if late else "on_time", at))
        if not self.waiting.exists() and len(firsts):
            self._expect(firsts.index[0] + pd.Timedelta(milliseconds=self.step_ms))
        if found:
            yield self._rows(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = []
        period = pd.Timestamp(self.waiting.get()[0])
        # Every deadline that the watermark has passed, one after the other.
        while self._deadline(period) <= timerValues.getCurrentWatermarkInMs():
            slot = (period.to_pydatetime(),)
            if not self.seen.containsKey(slot):
                found.append((period, "missing", None))
            period += pd.Timedelta(milliseconds=self.step_ms)
        self._expect(period)
        if found:
            yield self._rows(key, found)

    def close(self) -> None:
        pass


def deadlines(stream: DataFrame, key: str, period: str, at: str, grace: str, step: str = "7 days", watermark: str = "0 seconds") -> DataFrame:
    """(key, period, status, first_at): every period of a key as it is delivered or fails to be.

    ``period`` is a period's end, ``at`` the event time of a delivery.  A first delivery
    no later than ``grace`` after the period's end is ``on_time``, a later one ``late``.
    A period whose deadline the watermark passes without any is ``missing``; if it is
    delivered after all, a ``late`` row follows.  Periods are expected every ``step``
    after a key's first one.  Further deliveries of a period say nothing.
    """
    ms = lambda x: int(pd.Timedelta(x).total_seconds() * 1000)
    rows = stream.select(key, F.col(period).cast("timestamp").alias(period), at).withWatermark(at, watermark)
    kind = stream.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, period timestamp, status string, first_at timestamp"
    return rows.groupBy(key).transformWithStateInPandas(_Deadlines(key, period, at, ms(grace), ms(step)), schema, "Append", "EventTime")


def publish_once(stream: DataFrame, path: str, checkpoint: str, run_of: str = "run_id"):
    """A ``foreachBatch`` writer that delivers each run once, whatever is replayed.

    Data goes to ``path``/data, partitioned by run; a run is published by a row of its
    name in ``path``/runs, written after its data.  A batch that fails between the two
    leaves data that no ledger row names; the replay overwrites just those partitions.
    Runs in the ledger are skipped, be it the same batch again, the same run from
    another stream, or a stream that starts without its checkpoint.
    """
    def deliver(batch: DataFrame, batch_id: int) -> None:
        deliver_batch(batch, batch_id, path, run_of)

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)


def published_runs(spark, path: str) -> DataFrame:
    """The ledger (run, batch_id, rows), empty before the first delivery."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/runs")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "run string, batch_id long, rows long")
    return spark.read.schema("run string, batch_id long, rows long").parquet(f"{path}/runs")


def deliver_batch(batch: DataFrame, batch_id: int, path: str, run_of: str = "run_id") -> None:
    """Write the runs of a batch that the ledger lacks, then name them in it."""
    spark = batch.sparkSession
    done = published_runs(spark, path).select(F.col("run").alias("_run"))
    fresh = batch.join(done, F.col(run_of).cast("string") == F.col("_run"), "left_anti").where(F.col(run_of).isNotNull())
    named = fresh.withColumn("_run_key", F.concat(F.lit("run-"), F.col(run_of).cast("string")))
    names = named.groupBy(F.col(run_of).cast("string").alias("run")).agg(F.count(F.lit(1)).alias("rows"))
    held = names.select("run", F.lit(batch_id).cast("long").alias("batch_id"), "rows")
    if held.isEmpty():
        return
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_run_key").parquet(f"{path}/data")
    held.coalesce(1).write.mode("append").parquet(f"{path}/runs")


def published(spark, path: str) -> DataFrame:
    """The rows of the runs in the ledger; data without a ledger row isn't seen."""
    runs = published_runs(spark, path).select(F.concat(F.lit("run-"), "run").alias("_run_key")).distinct()
    return spark.read.parquet(f"{path}/data").join(runs, "_run_key", "left_semi").drop("_run_key")
