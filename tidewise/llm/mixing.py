"""Mixing sources to target weights along a time-varying curriculum.

1. Sizes are summed by source.  Weights share the words of all sources; a source gives at most
   ``max_repeats`` times its size, and what exceeds that is shared again by weight until no source is
   above (water filling, solved in closed form over the source table).
2. Each source has a weight schedule, a polyline over training time 0..1.  Its integral, scaled to
   the source's target, is the source's cumulative token demand.
3. A source's documents stand in the order of a hash, pass after pass.  A pass of a document takes
   the words from c to c + size of that stream; if they end within the target the pass is taken
   (plus the pass that the target cuts, if its greater part fits), and inverting the demand at the
   middle of these words gives its training position.
4. Documents are range-sorted by position.

The running sum within a source is made from buckets of documents (hash prefixes sized by the
source's row count), so a source with a third of all rows is spread over many tasks.

Defined results: null or wordless texts have size 0 and take 0; the null source is a source of its
own, last in order; if all sizes are 0, all targets are 0; repeated rows are documents of their
own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewise.plans.scratch import Scratch, join_checked

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights by place in the order of sources, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Relative weight at training time 0, 0.5 and 1 by place in the order of sources, repeating.
SCHEDULES = ((1.0, 1.0, 1.0), (2.0, 1.0, 0.5), (0.5, 1.0, 2.0))
BUCKET_ROWS = 64
#: Sources up to which their table is broadcast.
MAX_BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """(source, source_size, n_docs) -> the same with place, weight and target.

    Sources fill up in the order of max_repeats * size / weight; the first whose share of what is left does
    not exceed its limit, and all after it, share the rest by weight.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", w)
    t = t.withColumn("limit", (F.lit(max_repeats) * F.col("source_size")).cast("double"))
    fill = W.orderBy(F.col("limit") / F.col("weight"), "place")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    rest = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    t = t.withColumn("left", F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    t = t.withColumn("rate", F.col("left") / F.sum("weight").over(rest))
    t = t.withColumn("open", F.col("rate") * F.col("weight") < F.col("limit"))
    first_rate = F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), "place", "rate"))).over(W.partitionBy())["rate"]
    t = t.withColumn("level", first_rate)
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("weight")))
    return t.select("source", "source_size", "n_docs", "place", "weight", target.alias("target"))


def inverse_demand(share: Column, place: Column, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> Column:
    """Training time at which a source has given ``share`` of its target.

    Within a piece of the schedule the weight is a line a + b*x, its integral a parabola, and the
    inverse the root of a quadratic equation (in the form that also holds for b = 0).
    """

    def one(points: tuple[float, ...]) -> Column:
        k = len(points) - 1
        areas = [(p + q) / 2 / k for p, q in zip(points, points[1:], strict=False)]
        total, done, out = sum(areas), 0.0, F.lit(1.0)
        pieces = []
        for i, area in enumerate(areas):
            a, b = points[i], (points[i + 1] - points[i]) * k
            need = share * F.lit(total) - F.lit(done)
            x = F.lit(2.0) * need / (F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + F.lit(2.0 * b) * need, F.lit(0.0))))
            pieces.append((done + area, F.lit(i / k) + x))
            done += area
        for upto, t in reversed(pieces):
            out = F.when(share * F.lit(total) <= F.lit(upto), t).otherwise(out)
        return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))

    out = one(schedules[-1])
    for i, points in reversed(list(enumerate(schedules[:-1]))):
        out = F.when(F.pmod(place, F.lit(len(schedules))) == i, one(points)).otherwise(out)
    return out


def running_size(sized: DataFrame, sources: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``before``: the words that stand before a document in its source's order."""
    t = join_checked(sized, sources.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), max_rows=MAX_BROADCAST_SOURCES).drop("__s")
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / bucket_rows)).cast("long")
    t = t.withColumn("bucket", F.floor(F.col("h") / F.lit(float(2**60)) * n_buckets).cast("long"))
    sums = t.groupBy("place", "bucket").agg(F.sum("size").alias("bucket_size"))
    # Buckets are summed in two steps, so no task holds all buckets of a large source.
    sums = sums.withColumn("upper", F.floor(F.col("bucket") / 256))
    uppers = sums.groupBy("place", "upper").agg(F.sum("bucket_size").alias("upper_size"))
    over = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    uppers = uppers.withColumn("upper_before", F.coalesce(F.sum("upper_size").over(over("place").orderBy("upper")), F.lit(0)))
    starts = sums.withColumn("in_upper", F.coalesce(F.sum("bucket_size").over(over("place", "upper").orderBy("bucket")), F.lit(0)))
    starts = starts.join(uppers.select("place", "upper", "upper_before"), ["place", "upper"]).select("place", "bucket", (F.col("in_upper") + F.col("upper_before")).alias("start"))
    t = t.join(starts, ["place", "bucket"])
    own = W.partitionBy("place", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    return t.withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(own), F.lit(0))).drop("start", "bucket")


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3, keep: tuple[str, ...] = (), ordered: bool = True) -> DataFrame:
    """One row per document, range-sorted by first position unless not ``ordered`` (documents not taken last).

    doc_id, source, size, source_size, target, takes, taken, positions (one a pass), and ``keep``.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    sized = scratch.write(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), h.alias("h"), *keep), "sized")
    sources = scratch.write(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), max_repeats=max_repeats), "sources")
    t = running_size(sized, sources)
    # A pass is taken if the middle of its words lies within the target: passes end within half a document of it.
    mid = lambda k: F.col("before") + F.lit(k) * F.col("source_size") + F.col("size") / 2
    positions = F.array(*[F.when((F.col("size") > 0) & (mid(k) <= F.col("target")), inverse_demand(mid(k) / F.col("target"), F.col("place"))) for k in range(max_repeats)])
    t = t.withColumn("positions", F.array_compact(positions)).withColumn("takes", F.size("positions").cast("long"))
    out = t.select("doc_id", "source", "size", "source_size", "target", "takes", (F.col("takes") * F.col("size")).alias("taken"), "positions", "h", *keep)
    return (out.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "h") if ordered else out).drop("h")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3) -> DataFrame:
    """The documents in training order, each as often as it is taken; the columns of ``docs``.

    Positions are worked out on narrow rows; the texts move twice, to their positions and into order.
    """
    cols = [f"c{i}" for i in range(len(docs.columns))]
    name = dict(zip(docs.columns, cols, strict=True))
    placed = Scratch(docs.sparkSession, "mix").write(docs.toDF(*cols).withColumn("row", F.monotonically_increasing_id()), "input")
    plan = curriculum(placed.select(name[id_col], name[text_col], name[source_col], "row"), name[id_col], name[text_col], name[source_col], max_repeats, ("row",), False)
    rows = placed.join(plan.select("row", F.explode("positions").alias("position")), "row").orderBy("position", "row")
    return rows.select(*[F.col(c).alias(n) for n, c in name.items()])
