"""A data source over folders of store files: columns found by their roles, files pruned by the week in their names."""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Names that the two roles go by, first match wins; fixed values, others by option.
DAY_NAMES = "date,day,week_end,observation_date,trade_date,yyyymmdd,index"
VALUE_NAMES = "value,raw_close,close,weight,h_t"
_WEEK = re.compile(r"(\d{4})-?(\d{2})-?(\d{2})(?=\D*$)")


def week_of(name: str) -> dt.date | None:
    """The day that a file name ends with, as 2024-01-05 or 20240105."""
    found = _WEEK.search(name.rsplit("/", 1)[-1])
    try:
        return dt.date(*map(int, found.groups())) if found else None
    except ValueError:
        return None


def parsed_day(text: str) -> dt.date | None:
    """A day written as 20240105 or as an ISO date or time; else None."""
    text = text.strip()
    try:
        return dt.datetime.strptime(text, "%Y%m%d").date() if re.fullmatch(r"\d{8}", text) else dt.datetime.fromisoformat(text).date()
    except ValueError:
        return None


def parsed_number(text: str) -> float | None:
    try:
        value = float(text)
    except ValueError:
        return None
    return value if abs(value) != float("inf") and value == value else None


def roles(header: list[str], day_names: list[str], value_names: list[str]) -> tuple[int, int]:
    """The places of the day and the value: by name, else the first column and the first other one."""
    names = [h.strip().lower() for h in header]
    find = lambda wanted, taken: next((names.index(w) for w in wanted if w in names and names.index(w) != taken), None)
    day = find(day_names, None)
    day = 0 if day is None else day
    value = find(value_names, day)
    if value is None:
        value = next((i for i in range(len(names)) if i != day), None)
    if value is None:
        raise ValueError(f"no column for the value in {header}")
    return day, value


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + re.sub("^file:", "", path))


@dataclass
class StoreFile(InputPartition):
    path: str
    week: dt.date | None


class StoreReader(DataSourceReader):
    """One partition per file of the wanted weeks."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.prefix = options["path"], options.get("prefix", "")
        names = lambda key, usual: [n.strip().lower() for n in options.get(key, usual).split(",")]
        self.day_names, self.value_names = names("day_names", DAY_NAMES), names("value_names", VALUE_NAMES)
        bound = lambda key: dt.date.fromisoformat(options[key]) if options.get(key) else None
        self.first, self.last = bound("from_week"), bound("to_week")

    def _wanted(self, week: dt.date | None) -> bool:
        """Whether a file is opened; one without a week in its name only if no weeks are asked for."""
        if self.first is None and self.last is None:
            return True
        return week is not None and (self.first is None or self.first <= week) and (self.last is None or week <= self.last)

    def partitions(self) -> list[StoreFile]:
        fs, root = filesystem(self.folder)
        names = [i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.is_file and i.base_name.endswith(".csv") and i.base_name.startswith(self.prefix)]
        return [f for f in (StoreFile(name, week_of(name)) for name in sorted(names)) if self._wanted(f.week)]

    def read(self, partition: StoreFile) -> Iterator[tuple]:
        fs, _ = filesystem(self.folder)
        with fs.open_input_stream(partition.path) as raw, io.TextIOWrapper(raw, "utf-8-sig", newline="") as text:
            rows = csv.reader(text)
            header = next(rows, None)
            if header is None:
                return
            day, value = roles(header, self.day_names, self.value_names)
            for row in rows:
                if len(row) > max(day, value):
                    at, number = parsed_day(row[day]), parsed_number(row[value])
                    if at is not None and number is not None:
                        yield at, number, partition.week, partition.path.rsplit("/", 1)[-1]


class StoreFiles(DataSource):
    """``spark.read.format("store_files").option("prefix", ...).load(folder)``: day, value, week, file.

    The options ``from_week`` and ``to_week`` (both included) prune files by their
    names before any is opened.  Weeks are options, not pushed filters: what is pushed
    into a Python source stays in it for every other use of the same DataFrame.
    Day and value are found by ``day_names`` and ``value_names``, lists of accepted
    column names.  Rows whose day or value doesn't parse are dropped, as are empty files.
    """

    @classmethod
    def name(cls) -> str:
        return "store_files"

    def schema(self) -> str:
        return "day date, value double, week date, file string"

    def reader(self, schema) -> StoreReader:
        return StoreReader(self.options)


def read_store(spark: SparkSession, folder: str, prefix: str = "", from_week: dt.date | None = None, to_week: dt.date | None = None, **names: str) -> DataFrame:
    """The store files of some weeks as one table."""
    spark.dataSource.register(StoreFiles)
    reader = spark.read.format("store_files").option("prefix", prefix)
    for key, value in {"from_week": from_week and from_week.isoformat(), "to_week": to_week and to_week.isoformat(), **names}.items():
        reader = reader.option(key, value) if value else reader
    return reader.load(folder)
