"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every source has a target in words. All documents of a source expect target / size of the source
copies each; the prefix sum of these expectations plus one random offset per source is cut at whole
numbers, and a document is emitted once for every whole number that its interval crosses. So every
document of a source is taken target / size times on average. Documents are laid out by size before the
prefix sum: the sample holds each size range in proportion, and the words taken differ from the target
by no more than the words of the source's largest document.

Plan: one pass over the texts counts words; all that follows is narrow rows. Prefix sums are two-level
(rank inside a (source, size bucket, salt) cell, plus the cell's offset), so a source that holds most
of the rows is ranked by many tasks. The salts grow with the row count; the table of cells stays small
and the table of sources has a row for each source.

Defined results. Null text: size 0. Null source: a source of its own, last in order. A source of size
0: target 0, and its documents take nothing. Null ids: told apart by a checksum of the text (`tie`).
Repeated rows: ranked like others (identical rows are interchangeable). Empty table: empty result. `mix` passes extra columns through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import WORD, cut, fresh

#: Rows that one cell of the ranking holds on average, at most, when a third of all rows are alike.
CELL_ROWS = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tie(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells documents without id apart; null for all others."""
    return F.when(F.col(doc_id).isNull(), F.md5(F.coalesce(F.col(text), F.lit(""))))


def size_bucket(size: str) -> Column:
    """Powers of two cut in eight: whole-number arithmetic, equal in every engine."""
    return F.expr(f"length(bin({size})) * 16 + shiftright({size}, greatest(length(bin({size})) - 4, 0))")


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From (source, source_size): target by source. Weights repeat over the sources by code point,
    null last; what a source cannot take beyond `most` times its size is shared again by weight. That
    is one water level: with sources ordered by cap / weight, those before some place are at their cap
    and the rest share what is left. One task sorts this table; it has a row for each source."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    ordered = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    t = t.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(everything)).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
    )
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_left")
    t = t.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    t = t.withColumn("level", F.first("level", ignorenulls=True).over(everything))
    return t.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def fraction(*parts: Column) -> Column:
    """A reproducible number from 0 to 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x01")) for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(base: DataFrame, seed: int = 1, **shares) -> DataFrame:
    """base: (doc_id, source, size, tie), best already cut. Adds source_size, target, copies."""
    count = base.count()
    salts = max(8, -(-count // CELL_ROWS))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, **shares).withColumn("start", fraction(F.lit(seed), F.col("source")))
    cells = ["source", "bucket", "salt"]
    named = F.coalesce(F.col("doc_id").cast("string"), F.col("tie"))
    d = base.withColumn("bucket", size_bucket("size")).withColumn("salt", F.floor(fraction(F.lit(seed), named, F.col("size")) * salts).cast("int"))
    inside = F.row_number().over(W.partitionBy(*cells).orderBy("doc_id", "tie", "size"))
    counted = d.groupBy(*cells).count()
    # one small row for each cell; by source, so the largest partition holds buckets x salts of one source
    offset = F.coalesce(F.sum("count").over(W.partitionBy("source").orderBy("bucket", "salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select(*cells, offset.alias("offset"))
    starts = starts.join(plan, starts["source"].eqNullSafe(plan["source"])).select(starts["source"], "bucket", "salt", "offset", "source_size", "target", "start")
    ranked = d.withColumn("inside", inside).alias("d").join(
        starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket")) & (F.col("d.salt") == F.col("s.salt"))
    )
    rank = (F.col("offset") + F.col("inside")).cast("double")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(rank * each + F.col("start")) - F.floor((rank - 1) * each + F.col("start"))
    own = [F.col(f"d.{c}") for c in base.columns]
    return ranked.select(*own, "source_size", "target", F.when(F.col("d.size") > 0, crossed).otherwise(0).cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = 1, **shares) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs. Rows alike in
    doc_id, source and text are one document here that is taken as often as they are together."""
    a, b, n, one = (fresh(docs, x) for x in ("_mix_a", "_mix_b", "_mix_n", "_mix_copy"))
    keys = [F.xxhash64("doc_id", "source", "text").alias(a), F.coalesce("doc_id", F.lit(-1)).alias(b)]
    base = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), tie().alias("tie"), *keys))
    taken = copies(base, seed, **shares).groupBy(a, b).agg(F.sum("copies").cast("int").alias(n)).filter(F.col(n) > 0)
    once = docs.select("*", *keys).dropDuplicates([a, b])
    return once.join(taken.hint("merge"), [a, b]).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def op10(spark, sf_dir):
    from seqloom.llm.common import table

    base = cut(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"), tie().alias("tie")))
    out = copies(base)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
