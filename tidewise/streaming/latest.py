"""Rain snapshots as a stream: the newest value of each cell stays published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewise.functions.rain import clean_intensity
from tidewise.sources.grids import decode, delete, file_name, snapshot_time, versions, write_version

_FILES = "path string, modificationTime timestamp, length long, content binary"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Rasters (path, content) as they land."""
    return spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(root)


def read_stream(spark: SparkSession, root: str, box: tuple[int, int, int, int] | None = None, watermark: str = "2 days") -> DataFrame:
    """Cells (snap, r, c, v) of rasters as they land; repeats within the watermark are dropped."""
    cells = decode(read_files(spark, root), box).filter("is_valid").select(snapshot_time(file_name(F.col("path"))).alias("snap"), "r", "c", clean_intensity(F.col("v")).alias("v"))
    return cells.withWatermark("snap", watermark).dropDuplicatesWithinWatermark(["snap", "r", "c"])


def read_cell_stream(spark: SparkSession, root: str) -> DataFrame:
    """Cells (snap, r, c, v) of decoded snapshots that land as Parquet."""
    cells = spark.readStream.schema("snap timestamp, r int, c int, v double").parquet(root)
    return cells.select("snap", "r", "c", clean_intensity(F.col("v")).alias("v"))


def newest(cells: DataFrame) -> DataFrame:
    """(snap, r, c, v) -> the value of the latest snapshot of each cell."""
    return cells.groupBy("r", "c").agg(F.max(F.struct("snap", "v")).alias("b")).select("b.snap", "r", "c", "b.v")


def upsert(table_path: str, keep: int = 3):
    """A foreachBatch function that merges a batch into a table of cells; older snapshots that come late change nothing.

    Each batch writes a new version of the table in a folder of its own and the readers take the newest, so a batch that is
    repeated after a failure only rewrites its own version.  A version is at most one raster, however long the stream, and only
    the newest ``keep`` are kept.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        old = read_latest(batch.sparkSession, table_path, before=batch_id)
        both = batch.select("snap", "r", "c", "v") if old is None else old.unionByName(batch.select("snap", "r", "c", "v"))
        write_version(newest(both), table_path, batch_id, max(keep, 2))

    return run


def read_latest(spark: SparkSession, table_path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of the published cells, or none."""
    ids = [i for i in versions(spark, table_path) if before is None or i < before]
    return spark.read.parquet(f"{table_path}/version={max(ids)}") if ids else None


def ingest(files: DataFrame, out: str, checkpoint: str, box: tuple[int, int, int, int] | None = None, keep: int = 3, available_now: bool = True) -> StreamingQuery:
    """A stream of rasters (path, content) -> ``out/cells``, the newest value of each cell in versions, and ``out/quarantine``.

    Each batch is decoded once, into a table of its own that both sinks read.  Files that are no whole raster, or whose name carries no
    time, are listed (path, batch) in the quarantine.  Both sinks write folders named by the batch, so that a repeated batch changes
    nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, decoded = batch.sparkSession, f"{out}/decoded/batch={batch_id}"
        decode(batch, box).withColumn("snap", snapshot_time(file_name(F.col("path")))).write.mode("overwrite").parquet(decoded)
        got = spark.read.parquet(decoded)
        good = F.col("is_valid") & F.col("snap").isNotNull()
        got.filter(~good).select("path").distinct().write.mode("overwrite").parquet(f"{out}/quarantine/batch={batch_id}")
        upsert(f"{out}/cells", keep)(got.filter(good).select("snap", "r", "c", clean_intensity(F.col("v")).alias("v")), batch_id)
        delete(spark, decoded)

    writer = files.select("path", "content").writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_quarantine(spark: SparkSession, out: str) -> DataFrame:
    """(path, batch) of the files that were set aside."""
    return spark.read.schema("path string, batch long").parquet(f"{out}/quarantine")


def run(spark: SparkSession, root: str, table_path: str, checkpoint: str, box: tuple[int, int, int, int] | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the job on rasters; with available_now it ends when all files are read."""
    return publish(read_stream(spark, root, box), table_path, checkpoint, available_now)


def publish(cells: DataFrame, table_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the newest value of each cell of a stream in a table."""
    writer = cells.writeStream.foreachBatch(upsert(table_path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
