"""Order: ranks, sorting, limits and samples. `_ord` is the stream order throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import bases, quality
from seqloom.schema import ORD, require

#: Rows with neighbouring _ord that one task ranks at once.
CELL = 1 << 16


def with_rank(df: DataFrame, name: str, order: str = ORD) -> DataFrame:
    """Adds the 1-based place of each row by a unique long column, without a task that sees all rows:
    ranks inside cells of neighbouring values plus the counts of the cells before. Only the table of
    cells, a row for 65,536 values, is summed by one task."""
    cells = df.withColumn("_cell", F.floor(F.col(order) / CELL))
    inside = F.row_number().over(W.partitionBy("_cell").orderBy(order))
    counts = df.groupBy(F.floor(F.col(order) / CELL).alias("_cell")).count()
    before = F.coalesce(F.sum("count").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_cell", before.alias("_before"))
    return cells.withColumn("_inside", inside).join(starts, "_cell").withColumn(name, F.col("_before") + F.col("_inside")).drop("_cell", "_before", "_inside")


def with_number(df: DataFrame, keys: list[str], name: str, order: str = ORD) -> DataFrame:
    """Adds the 1-based place of each row among those of its key, by a unique long column. A task ranks
    the rows of a key in one cell of neighbouring values; what lies in the cells before is looked up for
    keys of several cells only, so a key with most of the rows is the work of many tasks."""
    at = [*keys, "_cell"]
    cells = df.withColumn("_cell", F.floor(F.col(order) / CELL))
    counts = cells.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(*[F.col(k).alias(f"_at{i}") for i, k in enumerate(at)], before.alias("_before")).filter("_before > 0")
    ranked = cells.withColumn("_inside", F.row_number().over(W.partitionBy(*at).orderBy(order)))
    same = [ranked[k].eqNullSafe(starts[f"_at{i}"]) for i, k in enumerate(at)]
    joined = ranked.join(starts, same, "left")
    return joined.select(*df.columns, (F.col("_inside") + F.coalesce("_before", F.lit(0))).alias(name))


def enumerate_records(df: DataFrame, name: str = "index") -> DataFrame:
    """Adds the 0-based place of each record in the stream."""
    return with_rank(df, name).withColumn(name, F.col(name) - 1)


def head(df: DataFrame, n: int) -> DataFrame:
    require(n >= 0, "head takes n >= 0")
    return df.orderBy(ORD).limit(n)


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    out = df.orderBy(ORD).offset(offset) if offset else df
    return out if limit is None else out.orderBy(ORD).limit(limit)


def sort_key(by: str | Column, encoding: str = "phred33") -> Column:
    if isinstance(by, Column):
        return by
    known = {
        "length": F.length("sequence"),
        "gc": bases.gc_fraction("sequence"),
        "id": F.col("id"),
        "quality": F.coalesce(quality.average("quality", encoding), F.lit(0.0)) if by == "quality" else F.lit(0),
        "sequence": F.translate(F.col("sequence"), "acgt", "ACGT"),
    }
    require(by in known, f"cannot sort by {by!r}")
    return known[by]


def sort_records(df: DataFrame, by: str | Column = "length", order: str | None = None, unique: bool = False, encoding: str = "phred33", collation: str | None = None) -> DataFrame:
    """By length, gc and quality in descending order unless told, otherwise ascending; ties keep stream
    order. Ids sort by code point, or by a collation such as UNICODE. By sequence: FASTQ only, the
    sequence in upper case for acgt, then the quality."""
    order = order or ("desc" if by in ("length", "gc", "quality") else "asc")
    require(order in ("asc", "desc"), "order is asc or desc")
    key = sort_key(by, encoding)
    if collation and by == "id":
        key = F.collate(key, collation)
    if isinstance(by, str) and by == "sequence":
        require(not unique, "sorting by sequence cannot drop duplicates")
        df = df.withColumn("sequence", F.translate("sequence", "acgt", "ACGT"))
        keys = [F.col("sequence"), F.col("quality")]
        return df.orderBy(*[k.desc() if order == "desc" else k.asc() for k in keys], ORD)
    if unique:
        from seqloom.operators.sets import first_of

        df = first_of(df, [F.col("id"), F.col("sequence")])
    return df.orderBy(key.desc_nulls_last() if order == "desc" else key.asc_nulls_last(), ORD)


def first_n(df: DataFrame, n: int, key: Column, descending: bool = False) -> DataFrame:
    """The first n by key, then _ord. The key is a column before the sort, so that sort and limit meet
    in the plan and each task keeps a bounded heap instead of sorting all its rows."""
    named = df.withColumn("_first_key", key)
    order = F.col("_first_key").desc_nulls_last() if descending else F.col("_first_key").asc_nulls_last()
    return named.orderBy(order, ORD).limit(n).drop("_first_key")


def top_n(df: DataFrame, n: int, by: str | Column = "length", order: str = "desc") -> DataFrame:
    """The first n in that order."""
    require(order in ("asc", "desc"), "order is asc or desc")
    return first_n(df, n, sort_key(by), order == "desc")


def uniform(seed: int = 42, *columns: str) -> Column:
    """A reproducible number from 0 to 1 for each row by its columns, so that paired inputs with equal
    _ord draw alike: the first 32 bits of the MD5 of seed and columns."""
    said = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in (columns or (ORD,))])
    return F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sample(df: DataFrame, n: int | None = None, fraction: float | None = None, seed: int = 42, strategy: str = "reservoir") -> DataFrame:
    """n rows (reservoir or random: the n smallest of uniform draws; systematic: every k-th) or a
    fraction of the rows."""
    require((n is None) != (fraction is None), "sample takes n or fraction")
    if fraction is not None:
        require(0 <= fraction <= 1, "fraction is from 0 to 1")
        return df.filter(uniform(seed) < fraction)
    require(n >= 0, "n is not negative")
    require(strategy in ("reservoir", "random", "systematic"), f"unknown strategy {strategy!r}")
    if strategy == "systematic":
        total = df.count()
        every = max(1, total // n) if n else 1
        return with_rank(df, "_rank").filter(((F.col("_rank") - 1) % every == 0) & (F.col("_rank") <= n * every)).drop("_rank")
    return first_n(df, n, uniform(seed))


def sample_stratified(df: DataFrame, stratum: Column, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum; each task keeps its own n first, so a hot stratum is cut before the shuffle."""
    part = df.withColumn("_s", stratum).withColumn("_u", uniform(seed)).withColumn("_salt", F.pmod(F.xxhash64(ORD), F.lit(64)))
    first = part.withColumn("_r", F.row_number().over(W.partitionBy("_s", "_salt").orderBy("_u", ORD))).filter(F.col("_r") <= n)
    return first.withColumn("_r", F.row_number().over(W.partitionBy("_s").orderBy("_u", ORD))).filter(F.col("_r") <= n).drop("_s", "_u", "_r", "_salt")


def sample_weighted(df: DataFrame, n: int, weight: Column, seed: int = 42) -> DataFrame:
    """n rows without replacement by weight: the largest u ** (1 / weight)."""
    return first_n(df.filter(weight > 0), n, F.log(F.greatest(uniform(seed), F.lit(1e-300))) / weight, descending=True)


def sample_bernoulli(df: DataFrame, p: float, seed: int = 42) -> DataFrame:
    return sample(df, fraction=p, seed=seed)
