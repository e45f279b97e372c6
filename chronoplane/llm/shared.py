"""Shared pieces of the corpus operators: scratch tables and distributed numbering.

Iterative operators cut their lineage by writing small tables into the folder
that the cluster names in ``spark.checkpoint.dir``.  A written table survives a
lost executor, and its file size lets Spark choose a broadcast on a known bound
(``spark.sql.autoBroadcastJoinThreshold``) and a shuffled join beyond it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What separates words: space and the ASCII control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = "file://" + tempfile.mkdtemp(prefix="corpus-")
    return _local_roots[app]


#: The scopes open in this thread; queries in other threads have their own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Remove the scratch tables written inside at the end; what is taken from the list stays."""
    token = _scopes.set((*_scopes.get(), made := []))
    try:
        yield made
    finally:
        _scopes.reset(token)
        for path in made:
            _delete(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    if _scopes.get():
        _scopes.get()[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a scratch table and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path on it.

    Local and mounted paths (``dbfs:/`` by its mount), ``hdfs``, ``viewfs``, ``gs`` and ``s3``, by
    whatever name Hadoop has for the last.
    """
    uri = re.sub("^dbfs:/+", "/dbfs/", re.sub("^s3[an]:", "s3:", uri))
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + re.sub("^file:", "", uri))


def column(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *names: str) -> DataFrame:
    """``df`` as one struct column ``row`` beside the columns in ``names``.

    Nothing that an operator adds can clash with a column of the input then.
    """
    row = F.struct(*[column(c) for c in df.columns]).alias("row")
    return df.select(row, *[column(c).alias(c) for c in names])


def numbered(df: DataFrame, key: str, order: list[str], name: str, rows_per_bucket: int = 20_000) -> DataFrame:
    """Add ``name``: a gapless number from 0 within each value of ``key``.

    A key may hold most of the rows, so its rows are dealt into buckets by a
    hash of ``order``.  Only the counts of the buckets meet: each bucket adds
    the sum of those before it to its own row numbers.  ``df`` is read twice
    and should be a written table.
    """
    rows = max(1, df.count())
    buckets = max(8, -(-rows // rows_per_bucket))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = dealt.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sizes.select(key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "starts")
    within = Window.partitionBy(key, "_b").orderBy(*order)
    own = dealt.withColumn("_i", F.row_number().over(within) - 1)
    joined = own.join(starts.withColumnsRenamed({key: "_key", "_b": "_bucket"}), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_bucket")))
    return joined.withColumn(name, F.col("_start") + F.col("_i")).drop("_b", "_i", "_start", "_key", "_bucket")
