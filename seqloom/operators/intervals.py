"""Genomic intervals: merging, sorting, statistics, overlap, queries of features."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.schema import SeqError, require


#: Bases of a bin: what one task orders at once is what begins in one.
BIN = 1 << 20


def merge_overlapping(df: DataFrame) -> DataFrame:
    """Unions of intervals that overlap or touch, by chromosome; other columns are those of the first.
    Gaps and islands: an island begins where no interval before reaches. Order is needed inside bins only;
    how far earlier bins reach and how many islands begin there are sums over the small table of bins, so
    a chromosome is the work of many tasks. No chromosome is one of its own; intervals without start come
    after all others and begin an island only where no end is known before, those without end reach nowhere."""
    # a struct, as structs of nulls are equal in joins
    binned = df.withColumn("_cell", F.struct("chromosome", F.floor(F.col("start") / BIN).alias("bin")))
    earlier = W.partitionBy("_cell.chromosome").orderBy(F.asc_nulls_last("_cell.bin")).rowsBetween(W.unboundedPreceding, -1)
    reach = binned.groupBy("_cell").agg(F.max("end").alias("_end")).select("_cell", F.max("_end").over(earlier).alias("_reach"))
    order = W.partitionBy("_cell").orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    before = F.greatest(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.col("_reach"))
    begins = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    marked = binned.join(reach, "_cell").withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    islands = marked.groupBy("_cell").agg(F.max("_island").alias("_n")).select("_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = marked.join(islands, "_cell").withColumn("_island", F.col("_before") + F.col("_island"))
    others = [c for c in df.columns if c not in ("chromosome", "start", "end", "length", "midpoint")]
    firsts = [F.min_by(c, F.struct(F.isnull("start"), "start", F.isnull("end"), "end")).alias(c) for c in others]
    out = numbered.groupBy("chromosome", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *firsts).drop("_island")
    if "length" in df.columns:
        out = out.withColumn("length", F.col("end") - F.col("start"))
    if "midpoint" in df.columns:
        out = out.withColumn("midpoint", F.floor((F.col("start") + F.col("end")) / 2))
    return out.select(*df.columns)


def sort_intervals(df: DataFrame, collation: str | None = None) -> DataFrame:
    c = F.collate("chromosome", collation) if collation else F.col("chromosome")
    return df.orderBy(c, "start", "end")


def interval_stats(df: DataFrame) -> DataFrame:
    """One row: count, total_length, average_length, min_length, max_length."""
    n = F.col("end") - F.col("start")
    zero = F.lit(0)
    return df.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(n), zero).alias("total_length"), F.coalesce(F.avg(n), F.lit(0.0)).alias("average_length"), F.coalesce(F.min(n), zero).alias("min_length"), F.coalesce(F.max(n), zero).alias("max_length"))


def parse_region(region: str) -> tuple[str, int, int]:
    m = re.fullmatch(r"(.+):(\d+)-(\d+)", region)
    if not m or int(m[2]) > int(m[3]):
        raise SeqError(f"region {region!r} is not name:start-end")
    return m[1], int(m[2]), int(m[3])


class FeatureQuery:
    """Conditions on GTF features, one after the other."""

    def __init__(self, df: DataFrame):
        self.df = df

    def filter_by_chromosome(self, name: str) -> FeatureQuery:
        return FeatureQuery(self.df.filter(F.col("seqname") == name))

    def filter_by_feature(self, *types: str) -> FeatureQuery:
        return FeatureQuery(self.df.filter(F.col("feature").isin(*types)))

    def filter_by_gene_type(self, *types: str) -> FeatureQuery:
        require("normalized" in self.df.columns, "gene types take normalised attributes")
        return FeatureQuery(self.df.filter(F.col("normalized")["gene_type"].isin(*types)))

    def filter_by_region(self, region: str) -> FeatureQuery:
        """Features that lie inside."""
        name, a, b = parse_region(region)
        return FeatureQuery(self.df.filter((F.col("seqname") == name) & (F.col("start") >= a) & (F.col("end") <= b)))

    def collect(self) -> list:
        return self.df.collect()

    def count(self) -> int:
        return self.df.count()

    def first(self):
        return self.df.orderBy("_ord").first() if "_ord" in self.df.columns else self.df.first()


def filter_features_by_type(df: DataFrame, types: list[str]) -> DataFrame:
    return df.filter(F.col("feature").isin(*types))


def overlaps(a: DataFrame, b: DataFrame, bin_size: int = 1 << 14) -> DataFrame:
    """Pairs of half-open intervals of a and b that overlap, columns of b with prefix b_: an equi-join on
    chromosome and bin, each pair kept in the bin where the overlap begins."""

    def binned(d: DataFrame, start: str, end: str) -> DataFrame:
        last = F.greatest(F.col(end) - 1, F.col(start))
        return d.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(last / bin_size))))

    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    x, y = binned(a, "start", "end"), binned(right, "b_start", "b_end").withColumnRenamed("_bin", "_b_bin")
    j = x.join(y, (F.col("chromosome") == F.col("b_chromosome")) & (F.col("_bin") == F.col("_b_bin")))
    hit = (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    return j.filter(hit & (F.col("_bin") == F.floor(F.greatest("start", "b_start") / bin_size))).drop("_bin", "_b_bin")
