"""Scratch tables in the folder that driver and executors share.

Iterative plans are cut by writing a Parquet table to ``spark.checkpoint.dir`` and reading it
back.  A written table is computed once, is columnar and compressed, and survives the loss of
any executor.
"""

from __future__ import annotations

import operator
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes (as rows in memory) up to which a table counts as small enough to broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 96 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; where none is set, the warehouse, and only on a single machine a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        base = "file://" + tempfile.mkdtemp(prefix="tidewise-")
        spark.sparkContext.setCheckpointDir(base)
    return (base or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


class Scratch:
    """A folder of written tables that belong to one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame, name: str = "t", by: str | None = None, **options: str) -> DataFrame:
        """Write ``df`` and return the table read back (same columns); ``by``: in a folder for each value of that column."""
        self._n += 1
        path = f"{self.path}/{self._n}-{name}"
        writer = df.write.options(compression="zstd", **options)
        (writer.partitionBy(by) if by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
        out._scratch_path = path
        return out

    def drop(self, table: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        path = getattr(table, "_scratch_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _width(kind: T.DataType, c: Column) -> Column:
    """About how many bytes a value takes unpacked."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 12
    if isinstance(kind, T.StructType):
        return reduce(operator.add, [_width(f.dataType, c[f.name]) for f in kind], F.lit(8))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(24).cast("long"), lambda n, x: n + _width(kind.elementType, x)), F.lit(8))
    return F.lit(8)


def small(table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int | None = None) -> bool:
    """Whether a table has at most ``max_rows`` rows and ``max_bytes`` bytes; reads no more rows than it must."""
    widths = table.select(_width(table.schema, F.struct(*[F.col(f"`{c}`") for c in table.columns])).alias("w")).limit(max_rows + 1)
    rows, size = widths.agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    return rows <= max_rows and size <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def hinted(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if it is small (looked at once, for use in a loop)."""
    return F.broadcast(table) if small(table, max_rows) else table


def sized(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """As ``hinted``, and marked for a shuffle if it is not small.

    Spark goes by the bytes of files, and millions of rows of numbers can be packed in a few MB; these would be broadcast
    through the driver, where they take a hundred bytes a row.
    """
    return F.broadcast(table) if small(table, max_rows) else table.hint("merge")


def join_checked(df: DataFrame, other: DataFrame, on, how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a broadcast if ``other`` is small in rows and bytes, else by shuffle.

    ``other`` should be a written table (it is measured first).  In the shuffled form adaptive
    execution splits skewed partitions of ``df``.
    """
    return df.join(hinted(other, max_rows), on, how)
