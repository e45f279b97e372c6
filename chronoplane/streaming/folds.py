"""The recursions of the engine under Structured Streaming.

State is the pickled recursion object per key, kept in the state store, so batch
and stream run the same ``step``.  Rows of one micro-batch are put in order
before they are fed.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_fold(df: DataFrame, key: str, order: str, make: Callable, inputs: list[str], outputs: str) -> DataFrame:
    """The streaming twin of ``run_fold``: new rows continue each key's recursion."""
    added = T._parse_datatype_string(outputs)
    schema = T.StructType([df.schema[key], df.schema[order], *added.fields])

    def advance(name: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(state.get[0]) if state.exists else make()
        pdf = pd.concat(list(pdfs)).sort_values(order, kind="stable").reset_index(drop=True)
        columns = [[None if isinstance(v, float) and v != v else v for v in pdf[c].tolist()] for c in inputs]
        rows = [machine.step(*values) for values in zip(*columns)]
        state.update((pickle.dumps(machine),))
        out = pdf[[key, order]].copy()
        for i, f in enumerate(added.fields):
            out[f.name] = pd.Series([r[i] for r in rows], dtype="float64" if isinstance(f.dataType, T.DoubleType) else "object")
        yield out

    rows = df.select(*dict.fromkeys([key, order, *inputs]))
    return rows.groupBy(key).applyInPandasWithState(advance, schema, "machine binary", "append", GroupStateTimeout.NoTimeout)
