"""Byte ranges of GeoJSON feature collections, so that one large file is many tasks.

Where a range begins inside a text, or how deep it lies, is not known when it is read.  So ranges are read twice: first each one says
how it changes depth and state for each state it may begin in; these few numbers a range are summed in the order of the file, and then
each range finds the objects that begin in it at the depth of features, and reads the last one to its end, past the range if need be.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewise.plans.scratch import Scratch

RANGE_BYTES = 8 << 20
#: Depth at which the objects of the array of features begin: the collection, then the array.
FEATURE_DEPTH = 2
_QUOTE, _BACKSLASH, _SPACE = ord('"'), ord("\\"), np.frombuffer(b" \t\r\n", np.uint8)


def open_file(path: str):
    """A seekable file of any file system that pyarrow knows, by its address."""
    from pyarrow import fs

    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _marks(raw: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """The bytes, which of them are quotes that begin or end a text, and whether the byte after them is escaped."""
    data = np.frombuffer(raw, np.uint8)
    at = np.arange(len(data), dtype=np.int32)
    slash = data == _BACKSLASH
    # Length of the run of backslashes before each byte; a run that began before the range counts by its parity.
    last = np.maximum.accumulate(np.where(slash, -1, at))
    before = np.concatenate([[-1], last[:-1]]) if len(data) else last
    run = at - 1 - before + np.where((before < 0) & escaped, 1, 0)
    after = (len(data) - 1 - (last[-1] if len(data) else -1)) + (1 if escaped and (not len(data) or last[-1] < 0) else 0)
    return data, (data == _QUOTE) & (run % 2 == 0), bool(after % 2)


def structure(raw: bytes, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """For bytes that begin in a state: the bytes outside texts, the change of depth up to and with each, and the state after them."""
    data, quotes, escaped_after = _marks(raw, escaped)
    odd = np.cumsum(quotes, dtype=np.int32) % 2 == 1
    free = ~(odd ^ inside) & ~quotes
    step = np.zeros(len(data), np.int32)
    step[free & ((data == ord("{")) | (data == ord("[")))] = 1
    step[free & ((data == ord("}")) | (data == ord("]")))] = -1
    return data, np.cumsum(step, dtype=np.int32), bool(inside ^ (odd[-1] if len(odd) else False)), escaped_after


#: States in which a range may begin: outside a text, in one, in one after a backslash.
STATES = ((False, False), (True, False), (True, True))


def _begins(f, start: int, data: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Places of the objects that are items of an array: those after a comma or an opening bracket, white space aside."""
    at = np.flatnonzero((data == ord("{")) & (up == 1))
    shown = np.flatnonzero(~np.isin(data, _SPACE))
    before = np.searchsorted(shown, at) - 1
    parent = data[shown[np.maximum(before, 0)]] if len(at) else data[:0]
    if len(at) and before[0] < 0:  # what the first object of a range follows lies before it
        parent[0] = _byte_before(f, start)
    return at[(parent == ord(",")) | (parent == ord("["))]


def _byte_before(f, start: int) -> int:
    while start > 0:
        at = max(0, start - 4096)
        f.seek(at)
        left = f.read(start - at).rstrip(bytes(_SPACE.tolist()))
        if left:
            return left[-1]
        start = at
    return 0


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each range and state: the change of depth, the state after it, and how many items begin at which depth, from its start."""
    for pdf in batches:
        for path, start, end in zip(pdf["path"], pdf["start"], pdf["end"], strict=True):
            change, then, depths, counts = [], [], [], []
            with open_file(path) as f:
                f.seek(start)
                raw = f.read(end - start)
                for inside, escaped in STATES:
                    data, depth, inside_after, escaped_after = structure(raw, inside, escaped)
                    at, n = np.unique(depth[_begins(f, start, data, np.diff(depth, prepend=0))], return_counts=True)
                    change.append(int(depth[-1]))
                    then.append(STATES.index((inside_after, inside_after and escaped_after)))
                    depths.append(at.tolist())
                    counts.append(n.tolist())
            yield pd.DataFrame({"path": [path], "start": [start], "end": [end], "change": [change], "then": [then], "depths": [depths], "counts": [counts]})


def _followed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ranges of a file with the depth and state in which each begins, and the number of features before it."""
    pdf, depth, state, before, out = pdf.sort_values("start"), 0, 0, 0, []
    for r in pdf.itertuples():
        out.append((r.path, r.start, r.end, depth, state, before))
        before += sum(int(n) for d, n in zip(r.depths[state], r.counts[state], strict=True) if d + depth == FEATURE_DEPTH + 1)
        depth, state = depth + int(r.change[state]), int(r.then[state])
    return pd.DataFrame(out, columns=["path", "start", "end", "depth", "state", "before"]).assign(total=before)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The features that begin in each range, the last one read to its end."""
    for pdf in batches:
        for path, start, end, depth0, state, first in zip(pdf["path"], pdf["start"], pdf["end"], pdf["depth"], pdf["state"], pdf["first"], strict=True):
            with open_file(path) as f:
                f.seek(start)
                raw = f.read(end - start)
                data, depth, inside, escaped = structure(raw, *STATES[state])
                depth = depth + depth0
                up = np.diff(depth, prepend=depth0)
                begins = _begins(f, start, data, up)
                begins = begins[depth[begins] == FEATURE_DEPTH + 1]
                ends = np.flatnonzero((up == -1) & (depth == FEATURE_DEPTH)) + 1
                ends = ends[np.searchsorted(ends, begins)[np.searchsorted(ends, begins) < len(ends)]]
                texts = [raw[b:e] for b, e in zip(begins, ends, strict=False)]
                if len(ends) < len(begins):
                    pieces, level = [raw[begins[-1] :]], int(depth[-1])
                    f.seek(end)
                    while more := f.read(1 << 20):
                        _, deeper, inside, escaped = structure(more, inside, escaped)
                        stop = np.flatnonzero(deeper + level == FEATURE_DEPTH)
                        if len(stop):
                            pieces.append(more[: stop[0] + 1])
                            break
                        pieces.append(more)
                        level += int(deeper[-1])
                    texts.append(b"".join(pieces))
            for at in range(0, len(texts), 1000):
                part = [t.decode("utf-8", "replace") for t in texts[at : at + 1000]]
                yield pd.DataFrame({"ord": np.arange(first + at, first + at + len(part)), "value": part})


def feature_texts(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(ord, value): the items at the depth of features as JSON, numbered in the order of the files' names and of each file.

    Files are listed by Spark and read by range with pyarrow, so both must know the file system.  What follows an unclosed item
    belongs to that item.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").cast("long").alias("length"))
    ranges = files.filter("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"), "length")
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("end"))
    # Small ranges share a task.
    n, size = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()
    tasks = max(1, min(10_000, n, max(spark.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))))
    seen = ranges.repartition(tasks, "path", "start").mapInPandas(_summaries, "path string, start long, end long, change array<long>, then array<int>, depths array<array<long>>, counts array<array<long>>")
    # A few numbers a range: the ranges of a file are one group, the files one window.
    known = Scratch(spark, "collection").write(seen.groupBy("path").applyInPandas(_followed, "path string, start long, end long, depth long, state int, before long, total long"), "ranges")
    sizes = known.groupBy("path").agg(F.first("total").alias("n"))
    earlier = sizes.select("path", F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    placed = known.join(earlier, "path").withColumn("first", F.col("before") + F.col("earlier"))
    return placed.repartition(tasks, "path", "start").mapInPandas(_features, "ord long, value string")
