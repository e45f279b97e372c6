"""Sequential recursions per key.

A recursion is an object with ``step(*inputs) -> tuple`` of outputs.  The batch
driver feeds it a key's rows in order; the streaming driver feeds the same object
from saved state.  Parallelism comes from keys.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def known(x) -> bool:
    return x is not None and x == x and abs(x) != float("inf")


def _plain(column: pd.Series) -> list:
    """Values as Python objects, missing ones as None."""
    return [None if isinstance(v, float) and v != v else v for v in column.tolist()]


def run_fold(df: DataFrame, key: str, order: str, make: Callable, inputs: list[str], outputs: str, keep: list[str] | None = None) -> DataFrame:
    """Add the outputs of a recursion, run over each key's rows by ``order``.

    ``outputs`` is a DDL string; ``keep`` names further columns to carry.
    """
    carried = [key, order, *(keep or [])]
    names = list(dict.fromkeys([*carried, *inputs]))
    added = T._parse_datatype_string(outputs)
    schema = T.StructType([df.schema[c] for c in carried] + list(added.fields))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        machine = make()
        columns = [_plain(pdf[c]) for c in inputs]
        rows = [machine.step(*values) for values in zip(*columns)]
        out = pdf[carried].reset_index(drop=True)
        for i, f in enumerate(added.fields):
            values = [r[i] for r in rows]
            out[f.name] = pd.Series(values, dtype="object" if not isinstance(f.dataType, T.DoubleType) else "float64")
        return out

    done = df.select(*names).groupBy(key).applyInPandas(fold, schema)
    doubles = {f.name: F.nanvl(f.name, F.lit(None).cast("double")) for f in added.fields if isinstance(f.dataType, T.DoubleType)}
    return done.withColumns(doubles) if doubles else done
