"""Sharding by extendible hashing.

A document's key is a hash; the directory is indexed by leading bits of the key.  A bucket at depth
d holds the documents that share d leading bits; only a bucket over the byte limit splits on the next
bit, until every shard fits.  Bytes are counted once by fine cells (prefixes of ``cell_bits`` bits), and the splits
are decided on the cell table; only cells that are themselves over the limit are split further, on
their rows.  The second half of a key comes from the row's place in the written input, so that repeated
rows can be told apart too.

Defined results: a null or empty text has 0 bytes; a null id hashes as the empty string; a document that
alone is over the limit is the only one of its shard (``oversize``), with other documents of no bytes at most;
an empty table gives an empty table; an input that fits is one shard, named "s".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.plans.scratch import Scratch, join_checked

#: Bits of the first half of a key (from the id) and of the second (from the place in the input).
KEY_BITS = 60
MAX_BYTES = 8 * 1024 * 1024


def shard_key(ident: Column) -> Column:
    """60 leading bits of the MD5 of an id."""
    return F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(key: str, bits: int, width: int = KEY_BITS) -> Column:
    return F.shiftright(F.col(key), width - bits)


def split_cells(cells: DataFrame, cell_bits: int, max_bytes: int) -> DataFrame:
    """(cell, bytes, docs) -> (cell, depth, shard_bytes, shard_docs); depth is null where even the cell is over the limit.

    The bytes of all ancestors of the cells are summed; as they fall with depth, the least depth at which
    they fit is where splitting ends.
    """
    up = cells.select("cell", "bytes", "docs", F.explode(F.sequence(F.lit(0), F.lit(cell_bits))).alias("depth"))
    up = up.withColumn("prefix", F.expr(f"shiftright(cell, {cell_bits} - depth)"))
    fits = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    fits = fits.filter((F.col("shard_bytes") <= max_bytes) | (F.col("shard_docs") == 1))
    # A shard is where a bucket fits and its parent does not.
    parents = fits.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    shards = fits.join(parents, ["depth", "prefix"], "left_anti")
    found = up.select("cell", "depth", "prefix").join(shards, ["depth", "prefix"]).select("cell", "depth", "shard_bytes", "shard_docs")
    return cells.select("cell").join(found, "cell", "left")


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, shard_id, depth, shard_bytes, shard_docs, oversize, and row (its place)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    rows = scratch.write(docs.select(F.col(id_col).alias("doc_id"), size.alias("n_bytes"), shard_key(F.col(id_col)).alias("key"), F.monotonically_increasing_id().alias("row")), "rows")
    return _assign(rows, scratch, max_bytes)


def _assign(rows: DataFrame, scratch: Scratch, max_bytes: int) -> DataFrame:
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    cell_bits = min(KEY_BITS, max(8, (total // max(1, max_bytes)).bit_length() + 6))
    rows = rows.withColumn("cell", _prefix("key", cell_bits))
    cells = scratch.write(rows.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")), "cells")
    directory = scratch.write(split_cells(cells, cell_bits, max_bytes), "directory")
    placed = join_checked(rows, directory, "cell")
    done = [placed.filter("depth is not null").withColumn("code", F.expr(f"shiftright(cell, {cell_bits} - depth)")).withColumn("bits", _bits("code", "depth"))]

    # Cells over the limit: split on the rest of the key, then on the second half, a byte of bits a round.
    rest, depth = placed.filter("depth is null").drop("depth", "shard_bytes", "shard_docs"), cell_bits
    if not directory.filter("depth is null").isEmpty():
        wide = F.xxhash64("key", "row")
        rest = scratch.write(rest.select("doc_id", "n_bytes", "row", F.concat(_fixed_bits("key", KEY_BITS), _fixed_bits(wide, 64)).alias("all_bits")), "rest")
        while depth < KEY_BITS + 64:
            step = min(8, KEY_BITS + 64 - depth)
            by = rest.select("row", "n_bytes", "all_bits", F.substring("all_bits", 1, depth).alias("stem"), F.substring("all_bits", 1, depth + step).alias("leaf"))
            leaves = by.groupBy("stem", "leaf").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
            up = leaves.select("leaf", "bytes", "docs", F.explode(F.sequence(F.lit(depth + 1), F.lit(depth + step))).alias("depth")).withColumn("bits", F.expr("substring(leaf, 1, depth)"))
            sums = up.groupBy("bits").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.first("depth").alias("depth"))
            fits = sums.filter((F.col("shard_bytes") <= max_bytes) | (F.col("shard_docs") == 1))
            least = up.select("leaf", "bits").join(fits, "bits").groupBy("leaf").agg(F.min(F.struct("depth", "bits", "shard_bytes", "shard_docs")).alias("s"))
            leaf_table = scratch.write(leaves.select("leaf").join(least, "leaf", "left").select("leaf", "s.*"), "leaves")
            joined = join_checked(rest.withColumn("leaf", F.substring("all_bits", 1, depth + step)), leaf_table, "leaf")
            done.append(joined.filter("depth is not null"))
            if leaf_table.filter("depth is null").isEmpty():
                break
            rest, depth = scratch.write(joined.filter("depth is null").select("doc_id", "n_bytes", "row", "all_bits"), "rest"), depth + step
    cols = ["doc_id", "row", "n_bytes", F.concat(F.lit("s"), "bits").alias("shard_id"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > max_bytes).alias("oversize")]
    return reduce(DataFrame.unionByName, [d.select(*cols) for d in done])


def _bits(code: str, depth: str) -> Column:
    return F.expr(f"if({depth} = 0, '', lpad(bin({code}), cast({depth} as int), '0'))")


def _fixed_bits(c: Column | str, width: int) -> Column:
    return F.lpad(F.bin(F.col(c) if isinstance(c, str) else c), width, "0")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The columns of ``docs`` with shard_id, shard_depth, shard_bytes and shard_docs (replacing columns of these names)."""
    scratch = Scratch(docs.sparkSession, "shard")
    docs = docs.drop("shard_id", "shard_depth", "shard_bytes", "shard_docs")
    # The rows are written once: their places must not change between the count and the join. The columns go by place, whatever their names.
    cols = [f"c{i}" for i in range(len(docs.columns))]
    at = lambda c: F.col(cols[docs.columns.index(c)])
    placed = scratch.write(docs.toDF(*cols).withColumn("row", F.monotonically_increasing_id()), "input")
    size = F.coalesce(F.octet_length(at(text_col)), F.lit(0)).cast("long")
    rows = placed.select(at(id_col).alias("doc_id"), size.alias("n_bytes"), shard_key(at(id_col)).alias("key"), "row")
    where = _assign(scratch.write(rows, "rows"), scratch, max_bytes)
    shards = where.select("row", "shard_id", F.col("depth").alias("shard_depth"), "shard_bytes", "shard_docs")
    return placed.join(shards, "row").drop("row").toDF(*docs.columns, "shard_id", "shard_depth", "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, path: str, **kw) -> None:
    """Write each shard as its own folder of Parquet files."""
    shard(docs, **kw).repartition("shard_id").write.mode("overwrite").partitionBy("shard_id").parquet(path)
