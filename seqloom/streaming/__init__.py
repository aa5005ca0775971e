"""Structured Streaming forms of the operators whose state is bounded.

Record-wise operators (filter, transform, clean, validate, quality, windows, translate, locate, grep)
work on streaming DataFrames as they are. Those here keep state, bounded by a watermark on a time
column of the caller's. What needs the whole input (head, sort, systematic samples, parts, global
numbers) raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import bases
from seqloom.functions.coords import pair_id
from seqloom.operators.sets import dedup_keys
from seqloom.schema import SeqError, require


def rmdup(stream: DataFrame, time: str, delay: str = "10 minutes", by: str | Column = "sequence", case_sensitive: bool = True) -> DataFrame:
    """The first record of each key within the watermark's delay."""
    require(stream.isStreaming, "not a stream")
    keys = dedup_keys(by, case_sensitive)
    named = stream.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    names = [f"_k{i}" for i in range(len(keys))]
    return named.withWatermark(time, delay).dropDuplicatesWithinWatermark(names).drop(*names)


def pairs(left: DataFrame, right: DataFrame, time: str, delay: str = "10 minutes", within: str = "10 minutes") -> DataFrame:
    """Reads of one name whose times lie within an interval of each other: a stream-stream join whose
    state both watermarks bound."""
    a = left.withWatermark(time, delay).withColumn("_pid", pair_id("id")).alias("a")
    b = right.withWatermark(time, delay).withColumn("_pid", pair_id("id")).alias("b")
    near = F.expr(f"b.{time} BETWEEN a.{time} - INTERVAL {within} AND a.{time} + INTERVAL {within}")
    j = a.join(b, (F.col("a._pid") == F.col("b._pid")) & near)
    side = lambda n, d: F.struct(*[F.col(f"{n}.{c}") for c in d.columns if c != "_pid"])
    return j.select(F.col("a._pid").alias("id"), side("a", left).alias("r1"), side("b", right).alias("r2"))


def stats(stream: DataFrame, time: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts, lengths and GC fraction by time window."""
    n = F.length("sequence")
    gc, at = F.sum(bases.count_of("sequence", "GC")), F.sum(bases.count_of("sequence", "ATU"))
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, window))
        .agg(F.count(F.lit(1)).alias("num_sequences"), F.sum(n).alias("total_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), (gc / F.nullif(gc + at, F.lit(0))).alias("gc_content"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "num_sequences", "total_length", "min_length", "max_length", "gc_content")
    )


def length_histogram(stream: DataFrame) -> DataFrame:
    """(length, n), complete mode: what N50 and quartiles are computed from."""
    return stream.groupBy(F.length("sequence").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def rename(stream: DataFrame, separator: str = "_", start: int = 2) -> DataFrame:
    """The second and later records of an id get a number; the state is one count for each id. Within a
    micro-batch, records count in order of _ord."""

    def number(key, batches, state):
        import pandas as pd

        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("_ord")
        numbers = range(seen + 1, seen + len(rows) + 1)
        rows["id"] = [key[0] if n == 1 else f"{key[0]}{separator}{n - 2 + start}" for n in numbers]
        state.update((seen + len(rows),))
        yield rows

    columns = stream.columns
    schema = stream.select(*columns).schema
    return stream.groupBy("id").applyInPandasWithState(number, schema, "n long", "append", "NoTimeout")


def unsupported(name: str) -> None:
    raise SeqError(f"{name} needs the whole input and has no streaming form")


def head(stream: DataFrame, n: int) -> DataFrame:
    unsupported("head")


def sort(stream: DataFrame, **options) -> DataFrame:
    unsupported("sort")


def sample_systematic(stream: DataFrame, n: int) -> DataFrame:
    unsupported("systematic sampling")


def split_by_parts(stream: DataFrame, n: int) -> DataFrame:
    unsupported("splitting by parts")
