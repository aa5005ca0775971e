"""Duplicates, unions and set algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import quality as q
from seqloom.operators.ranking import with_number
from seqloom.schema import ORD, SeqError, require


def first_of(df: DataFrame, keys: list[Column], order: list[Column] | None = None, ord_of_key: bool = False) -> DataFrame:
    """One row for each key, the smallest by `order` and then _ord. An aggregate that keeps the smallest
    row in each task first, so a key with most of the rows is no burden. With ord_of_key, the winner
    takes the _ord of its key's first row."""
    names = [f"_k{i}" for i in range(len(keys))]
    lead = [c.alias(f"_o{i}") for i, c in enumerate(order or [])]
    row = F.struct(*lead, F.col(ORD).alias("_o"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    first = df.groupBy(*[k.alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.min(row).alias("_row"), F.min(ORD).alias("_first"))
    columns = [F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(df.columns)]
    if ord_of_key:
        columns = [F.col("_first").alias(ORD) if c == ORD else x for c, x in zip(df.columns, columns, strict=True)]
    return first.select(*columns)


def dedup_keys(by: str | Column, case_sensitive: bool = True) -> list[Column]:
    if isinstance(by, Column):
        return [by]
    seq = F.col("sequence") if case_sensitive else F.lower("sequence")
    keys = {"sequence": [seq], "id": [F.col("id")], "both": [F.col("id"), seq], "exact": [F.col("id"), seq, F.coalesce("description", F.lit(""))] if by == "exact" else []}
    require(by in keys, f"cannot compare by {by!r}")
    return keys[by]


def unique(df: DataFrame, by: str | Column = "sequence", case_sensitive: bool = True, conflict: str = "first", encoding: str = "phred33") -> DataFrame:
    """One record for each key: the first, last, longest or the one of highest quality, the earlier on
    ties. Winners other than the first stand at the place of their key's first record."""
    keys = dedup_keys(by, case_sensitive)
    if conflict == "first":
        return first_of(df, keys)
    order = {"last": [-F.col(ORD)], "longest": [-F.length("sequence")], "highest-quality": [-F.coalesce(q.average("quality", encoding), F.lit(-1e9))] if "quality" in df.columns else []}
    require(conflict in order, f"unknown conflict resolution {conflict!r}")
    return first_of(df, keys, order[conflict], ord_of_key=True)


def rmdup(df: DataFrame, by: str | Column = "sequence", case_sensitive: bool = True) -> DataFrame:
    """Keeps the first record of each key; exact, so nothing that is no duplicate is dropped."""
    return first_of(df, dedup_keys(by, case_sensitive))


def find_duplicates(df: DataFrame, by: str | Column = "sequence", case_sensitive: bool = True) -> DataFrame:
    """Keys with more than one record: the key, how often, first _ord."""
    keys = dedup_keys(by, case_sensitive)
    return df.groupBy(F.concat_ws(":", *keys).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(ORD).alias("first_ord")).filter("n > 1")


def dedup_stats(df: DataFrame, by: str | Column = "sequence", case_sensitive: bool = True) -> DataFrame:
    """One row: total, unique, duplicates and their share."""
    keys = dedup_keys(by, case_sensitive)
    per = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))
    total, distinct = F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    return per.agg(total.alias("total"), distinct.alias("unique"), (total - distinct).alias("duplicates"), F.coalesce((total - distinct) / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("duplicate_rate"))


def rename(df: DataFrame, by_name: bool = False, separator: str = "_", start: int = 2, rename_first: bool = False) -> DataFrame:
    """The second and later records of an id get `id<separator><number>` counting from start; with
    rename_first all do. by_name tells records apart by id and description."""
    key = {"_id": F.col("id")} | ({"_said": F.coalesce("description", F.lit(""))} if by_name else {})
    numbered = with_number(df.withColumns(key), list(key), "_n")
    n = F.col("_n")
    number = n - 1 + start if rename_first else n - 2 + start
    changed = F.concat("id", F.lit(separator), number.cast("string"))
    return numbered.withColumn("id", changed if rename_first else F.when(n > 1, changed).otherwise(F.col("id"))).drop("_n", *key)


def concat(sources: list[DataFrame], conflict: str = "error", suffix: str = "_src", validate_formats: bool = True) -> DataFrame:
    """The records of all sources in order, with ids made unique: error (raises), ignore (drops later
    ones), rename (`id_1`, ...) or suffix (`id_src<source>`, then `_1`, ...). Numbers that meet an id
    which exists anyway are taken by a further number, for such ids only."""
    require(len(sources) > 0, "concat takes at least one source")
    require(conflict in ("error", "ignore", "rename", "suffix"), f"unknown conflict resolution {conflict!r}")
    if validate_formats and len(sources) > 1 and all("format" in s.columns for s in sources):
        formats = reduce(DataFrame.unionByName, [s.select("format").distinct() for s in sources]).distinct().limit(2).count()
        require(formats < 2, "sources have different formats")
    tagged = [s.withColumn("_src", F.lit(i)) for i, s in enumerate(sources)]
    all_rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    if conflict == "error":
        again = all_rows.groupBy("id").count().filter("count > 1").limit(1).collect()
        if again:
            raise SeqError(f"duplicate sequence id {again[0]['id']!r}")
        out = all_rows
    elif conflict == "ignore":
        out = first_of(all_rows, [F.col("id")], [F.col("_src")])
    else:
        placed = all_rows.withColumns({"_place": F.col("_src").cast("long") * F.lit(1 << 48) + F.col(ORD), "_id": F.col("id")})
        numbered = with_number(placed, ["_id"], "_n", "_place")
        lead = suffix if suffix.startswith("_") else f"_{suffix}"
        if conflict == "rename":
            new = F.concat("id", F.lit("_"), (F.col("_n") - 1).cast("string"))
        else:
            stem = F.concat("id", F.lit(lead), F.col("_src").cast("string"))
            numbered = with_number(numbered.withColumn("_first", F.col("_n") == 1), ["_id", "_src", "_first"], "_again", "_place")
            again = F.col("_again") - 1
            new = F.when(again == 0, stem).otherwise(F.concat(stem, F.lit("_"), again.cast("string")))
        out = numbered.withColumn("id", F.when(F.col("_n") > 1, new).otherwise(F.col("id"))).drop("_n", "_id", "_place", "_first", "_again")
    return out.withColumn(ORD, F.col("_src").cast("long") * F.lit(1 << 48) + F.col(ORD)).drop("_src")


# Sets of records are keyed by their sequence.
def sequence_set(df: DataFrame) -> DataFrame:
    return first_of(df, [F.col("sequence")])


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records of a, and those of b whose sequence is not in a."""
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return first_of(both, [F.col("sequence")], [F.col("_side")]).drop("_side")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return sequence_set(a).join(b.select("sequence").distinct(), "sequence", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return sequence_set(a).join(b.select("sequence").distinct(), "sequence", "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return difference(a, b).unionByName(difference(b, a), allowMissingColumns=True)


def filter_by_set(df: DataFrame, members: DataFrame, exclude: bool = False, by: str = "sequence") -> DataFrame:
    require(by in ("sequence", "id"), "by is sequence or id")
    return df.join(members.select(by).distinct(), by, "left_anti" if exclude else "left_semi")


def set_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes, jaccard, containment of a in b, overlap, and the relations."""
    sides = a.select("sequence", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("sequence", F.lit(0).alias("x"), F.lit(1).alias("y")))
    per = sides.groupBy("sequence").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    n_a, n_b, n_both, n_all = F.coalesce(F.sum("x"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)), F.count(F.lit(1))
    s = per.agg(n_a.alias("size_a"), n_b.alias("size_b"), n_both.alias("n_both"), n_all.alias("n_all"))

    def share(of: Column) -> Column:
        return F.when(of > 0, F.col("n_both") / of).otherwise(F.lit(0.0))

    return s.select(
        "size_a",
        "size_b",
        share(F.col("n_all")).alias("jaccard"),
        share(F.col("size_a")).alias("containment"),
        share(F.least("size_a", "size_b")).alias("overlap"),
        (F.col("n_both") == F.col("n_all")).alias("equals"),
        (F.col("n_both") == F.col("size_a")).alias("is_subset"),
        (F.col("n_both") == F.col("size_b")).alias("is_superset"),
        (F.col("n_both") == 0).alias("is_disjoint"),
    )
