"""Scalar functions: cleaning, JSON fields, digests, allow-lists, host checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What must not leave a report: paths, keys and addresses.
SENSITIVE = r"(/home/|/Users/|[A-Za-z]:\\|api[_-]?key|secret|token=|[\w.]+@[\w.]+\.\w+)"


def truncated(text: Column, limit: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - len(suffix))), F.lit(suffix))).otherwise(text)


def plain_text(text: Column) -> Column:
    """Text without simple TeX markup."""
    out = F.regexp_replace(text, r"\\[A-Za-z]+\{([^}]*)\}", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[$\\{}]", ""), r"\s+", " "))


def digest(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *columns), 256)


def is_sensitive(text: Column) -> Column:
    return F.coalesce(text.rlike(SENSITIVE), F.lit(False))


def host_allowed(url: Column, hosts: list[str]) -> Column:
    """Whether the url's host is one of the hosts or below one."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith("." + h)
    return out


def compact_timestamp(text: Column) -> Column:
    """A 14-digit timestamp, null where it isn't one."""
    return F.when(text.rlike(r"^\d{14}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))


def safe_number(x: Column) -> Column:
    """Not-a-number and infinities become null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def fixed(x: Column, digits: int) -> Column:
    """The number with so many decimals, up to 8, as C's printf writes it.

    The binary value itself is rounded, exact ties to even; Java's formatter rounds
    the shortest decimal that stands for it, which may lie on the other side of a half.
    """
    size = F.abs(x)
    whole = F.floor(size)
    # 62 binary digits of the fraction: all of them, unless the number is below 2 ** -9.
    part = ((size - whole) * float(1 << 62)).cast("long").cast("decimal(19,0)") * F.lit(10**digits).cast("decimal(9,0)")
    unit = F.lit(1 << 62).cast("decimal(19,0)")
    low = F.call_function("div", part, unit)
    twice = (part - low.cast("decimal(9,0)") * unit) * F.lit(2).cast("decimal(1,0)")
    units = low + ((twice > unit) | ((twice == unit) & (low % 2 == 1))).cast("long")
    full = F.lit(10**digits)
    text = F.concat(F.when(x < 0, "-").otherwise(""), (whole + F.when(units == full, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((units % full).cast("string"), digits, "0"))
    return F.when(size < float(1 << 53), text).when(x.isNotNull(), F.printf(F.lit(f"%.{digits}f"), x))
