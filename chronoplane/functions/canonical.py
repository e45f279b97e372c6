"""Canonical JSON: sorted keys, numbers as quoted plain decimals, ASCII, no white space; exact at any precision."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Fixed value: the name of this canonical form in proofs.
METHOD = "json_ast_decimal/v1"


def plain_decimal(x: Decimal) -> str:
    """A number without exponent, trailing zeros or negative zero."""
    text = format(x, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def _parsed(payload: str):
    return json.loads(payload, parse_float=Decimal, parse_int=Decimal)


def _plain(v):
    """Numbers become their plain text, so no reader rounds them."""
    if isinstance(v, dict):
        return {k: _plain(v[k]) for k in sorted(v)}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return plain_decimal(v) if isinstance(v, Decimal) else v


def canonical(payload: str) -> str:
    """The canonical text of a JSON document; what doesn't parse is an error."""
    try:
        return json.dumps(_plain(_parsed(payload)), ensure_ascii=True, separators=(",", ":"))
    except ValueError as bad:
        raise ValueError(f"no JSON document: {bad}") from bad


def field_set(payload: str) -> list[str]:
    """All names of fields at any depth, sorted."""
    found, todo = set(), [_parsed(payload)]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            found.update(v)
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return sorted(found)


def holdings_totals(payload: str) -> tuple[int | None, str | None]:
    """Rows of a document's ``holdings`` list and the exact sum of their weights; null without one."""
    v = _parsed(payload)
    rows = v.get("holdings") if isinstance(v, dict) else None
    if not isinstance(rows, list):
        return None, None
    weights = (r["weight"] for r in rows if isinstance(r, dict) and "weight" in r)
    return len(rows), plain_decimal(sum((w if isinstance(w, Decimal) else Decimal(str(w)) for w in weights), Decimal(0)))


def with_canonical(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``name``, its digest, field set, row count and weight sum.

    Decimals of any length have no type in the engine, so each document is
    rewritten in Python, in Arrow batches.  A null document stays null.
    """
    shape = "text string, fields array<string>, n long, total string"

    @F.pandas_udf(shape)
    def convert(s: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None, None) if x is None else (canonical(x), field_set(x), *holdings_totals(x)) for x in s]
        return pd.DataFrame(rows, columns=["text", "fields", "n", "total"]).astype({"n": "Int64"})

    out = df.withColumn("_c", convert(column))
    return out.withColumns({name: F.col("_c.text"), f"{name}_sha256": F.sha2("_c.text", 256), f"{name}_fields": F.col("_c.fields"), f"{name}_rows": F.col("_c.n"), f"{name}_weight_sum": F.col("_c.total")}).drop("_c")


def unwrapped(payload: Column) -> Column:
    """The document inside a snapshot wrapper (a JSON object with a base64 body), or the payload."""
    body = F.get_json_object(payload, "$.body_base64")
    return F.coalesce(F.decode(F.try_to_binary(body, F.lit("base64")), "UTF-8"), payload)
