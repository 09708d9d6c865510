"""Exact deduplication with a log-structured merge index (DataFrame functions only).

Rows are numbered and dealt to memtables.  A memtable holds one entry a digest (rows, and the best of them: most code
points, then smallest id, then row number).  Before it is flushed, its digests are looked up in the older runs: a run's
filter is a table of bitmaps by hash range, and only digests whose bit is set are searched for in the run itself.  A
memtable is flushed as a *run*, sorted by digest and written with Parquet Bloom filters.  Runs of equal tier are compacted
in pairs; an entry keeps the row count and the best row.

A digest that a memtable has twice, or that an older run has, is a hit.  Rows without a hit stay as they are and meet no index.
Every hit is verified on the bytes themselves; rows whose digest agrees but whose bytes differ are grouped again by digest and
bytes.

Defined results: a null text counts as empty; empty texts equal one another; a null id sorts after
all ids; repeated rows are rows of their own, of which one stays; an empty table gives an empty table; other columns
of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.plans.scratch import Scratch, join_checked

WHITESPACE = " \t\n\x0b\f\r"
#: Memtables at least, and rows a memtable has at most.
MEMTABLES, MEMTABLE_ROWS = 4, 1 << 30
#: Bits a digest has in a run's filter: one of 16 is set, so 6 % of absent digests pass.
FILTER_BITS = 16
_RANGE = 1 << 15


def normalised(text: Column) -> Column:
    """Text without ASCII whitespace."""
    return F.translate(F.coalesce(text, F.lit("")), WHITESPACE, "")


def _digest(norm: Column, bits: int) -> Column:
    return F.unhex(F.substring(F.sha2(norm, 256), 1, bits // 4))


def _rank(n: str, ident: str, row: str) -> Column:
    """Orders rows of a group: the smallest stays."""
    return F.struct((-F.col(n)).alias("neg"), F.col(ident).isNull().alias("none"), F.col(ident).alias("id"), F.col(row).alias("row"))


def _bit(bits: int) -> Column:
    """Place of a digest in a filter of ``bits`` bits, from 1 as bitmap functions count."""
    return F.pmod(F.xxhash64("key"), F.lit(bits)) + 1


class Run:
    """A sorted run of (key, n, best) and its filter (range, bitmap)."""

    def __init__(self, table: DataFrame, filter_: DataFrame, bits: int):
        self.table, self.filter, self.bits = table, filter_, bits

    def passed(self, keys: DataFrame) -> DataFrame:
        """Those of distinct ``keys`` that the filter does not rule out."""
        place = keys.withColumns({"range": F.bitmap_bucket_number(_bit(self.bits)), "at": F.bitmap_bit_position(_bit(self.bits))})
        byte = F.conv(F.hex(F.substring("bitmap", (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        # Bits within a byte count from the lowest.
        found = join_checked(place, self.filter, "range").filter(byte.bitwiseAND(F.pow(F.lit(2), F.col("at") % 8).cast("int")) != 0)
        return found.select("key")

    def hits(self, keys: DataFrame) -> DataFrame:
        """Those of distinct ``keys`` that the run has."""
        return self.table.select("key").join(self.passed(keys), "key", "left_semi")


class DigestIndex:
    """Runs of (key, n, best), compacted geometrically: at most one run a tier remains."""

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.tiers: dict[int, Run] = {}
        self.found: list[DataFrame] = []

    def _flush(self, entries: DataFrame, tier: int) -> Run:
        table = self.scratch.write(
            entries.sortWithinPartitions("key"),
            f"run{tier}",
            **{"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": "262144"},
        )
        bits = max(_RANGE, FILTER_BITS * table.count())
        marks = table.groupBy(F.bitmap_bucket_number(_bit(bits)).alias("range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_bit(bits))).alias("bitmap"))
        return Run(table, self.scratch.write(marks, "filter"), bits)

    def add(self, rows: DataFrame) -> None:
        """Look up a memtable of (key, n, best) rows in the runs, flush it, and merge runs of equal tier."""
        run, tier = self._flush(self._merge(rows), 0), 0
        self.found.append(self.scratch.write(run.table.filter("n > 1").select("key"), "twice"))
        for older in self.tiers.values():
            self.found.append(self.scratch.write(older.hits(run.table.select("key")), "known"))
        while (other := self.tiers.pop(tier, None)) is not None:
            merged = self._flush(self._merge(run.table.unionByName(other.table)), tier + 1)
            for r in (run, other):
                self.scratch.drop(r.table)
                self.scratch.drop(r.filter)
            run, tier = merged, tier + 1
        self.tiers[tier] = run

    @staticmethod
    def _merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("best").alias("best"))

    def hits(self) -> DataFrame:
        """Entries (key, n, best) of all digests that more than one row has."""
        keys = self.scratch.write(reduce(DataFrame.unionByName, self.found).distinct(), "hit-keys")
        parts = [join_checked(r.table, keys, "key", "left_semi") for r in self.tiers.values()]
        return self.scratch.write(parts[0] if len(parts) == 1 else self._merge(reduce(DataFrame.unionByName, parts)), "hits")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtables: int | None = None, digest_bits: int = 256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = base.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("len"), normalised(F.col("text")).alias("norm"))
    rows = keyed.select("doc_id", "len", F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.write(rows.withColumn("key", F.unhex(F.substring("text_sha256", 1, digest_bits // 4))), "rows")

    index, count = DigestIndex(scratch), memtables or max(MEMTABLES, -(-rows.count() // MEMTABLE_ROWS))
    for i in range(count):
        part = rows.filter(F.pmod(F.xxhash64("row"), F.lit(count)) == i)
        index.add(part.select("key", F.lit(1).cast("long").alias("n"), _rank("len", "doc_id", "row").alias("best")))
    hits = index.hits()

    # Byte verification: each row of a hit against the bytes of the row that stays.
    wanted = hits.select("key", F.col("best.id").alias("best_id"), (-F.col("best.neg")).alias("best_len"))
    members = scratch.write(join_checked(keyed.withColumn("key", _digest(F.col("norm"), digest_bits)), wanted, "key"), "members")
    own = (F.col("len") == F.col("best_len")) & F.col("doc_id").eqNullSafe(F.col("best_id"))
    keepers = scratch.write(members.filter(own).groupBy("key").agg(F.min("norm").alias("keeper_norm")), "keepers")
    # Both sides are tables and the join's rows are written as they are, so that adaptive execution can split a digest with very many rows.
    differing = scratch.write(members.select("key", "norm").join(keepers, "key").filter("norm <> keeper_norm").select("key"), "differing")

    result = lambda t, sha: t.select("doc_id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), sha)
    alone = F.struct(F.col("len").alias("neg"), F.col("len").isNull().alias("none"), F.col("doc_id").alias("id"), "row")
    met = join_checked(rows, hits, "key", "left").withColumns({"n": F.coalesce("n", F.lit(1).cast("long")), "best": F.coalesce("best", alone)})
    if differing.isEmpty():
        return result(met, F.col("text_sha256"))
    differing = scratch.write(differing.distinct(), "differing")
    odd = scratch.write(join_checked(keyed.withColumn("key", _digest(F.col("norm"), digest_bits)), differing, "key", "left_semi").withColumn("row", F.monotonically_increasing_id()), "odd")
    groups = odd.groupBy("key", "norm").agg(F.count(F.lit(1)).alias("n"), F.min(_rank("len", "doc_id", "row")).alias("best"))
    return result(join_checked(met, differing, "key", "left_anti"), F.col("text_sha256")).unionByName(result(odd.join(groups, ["key", "norm"]), F.sha2("norm", 256).alias("text_sha256")))
