"""Splitting a stream into numbered parts, and writing these."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.ranking import with_rank
from seqloom.schema import ORD, require

MODES = ("by-size", "by-parts", "by-length", "by-id", "by-region")


def split(df: DataFrame, mode: str, sequences_per_file: int = 1000, num_parts: int = 2, bases_per_file: int = 1_000_000, id_regex: str | None = None, region: str | None = None, prefix: str | None = None, extension: str = ".fasta", output_dir: str = "./split") -> DataFrame:
    """The records with part_id, output_file and sequence_count (number within the part).

    by-size: so many records each; by-parts: consecutive parts of equal size; by-length: a new part
    before a record that would take the part over bases_per_file; by-id: by the first group of the
    regular expression, else its match, else `ungrouped`; by-region: alignments over the region."""
    require(mode in MODES, f"unknown mode {mode!r}")
    name = prefix or ("group" if mode == "by-id" else "part")
    if mode == "by-id":
        require(id_regex is not None, "by-id takes id_regex")
        group = 1 if re.compile(id_regex).groups else 0
        m, whole = F.regexp_extract("id", id_regex, group), F.regexp_extract("id", id_regex, 0)
        out = df.withColumn("part_id", F.when(m != "", m).when(whole != "", whole).otherwise("ungrouped"))
        out = out.withColumn("sequence_count", F.row_number().over(W.partitionBy("part_id").orderBy(ORD)))
    elif mode == "by-region":
        from seqloom.operators.records import filter_records

        require(region is not None, "by-region takes a region")
        out = with_rank(filter_records(df, region=region), "sequence_count").withColumn("part_id", F.lit(re.sub(r"\W", "_", region)))
    elif mode == "by-length":
        out = _by_length(df, bases_per_file)
    else:
        require(sequences_per_file >= 1 and num_parts >= 1, "sizes are positive")
        size = sequences_per_file if mode == "by-size" else max(1, -(-df.count() // num_parts))
        out = with_rank(df, "_rank").withColumn("part_id", (F.floor((F.col("_rank") - 1) / size) + 1).cast("string")).withColumn("sequence_count", ((F.col("_rank") - 1) % size + 1).cast("int")).drop("_rank")
    return out.withColumn("output_file", F.concat(F.lit(f"{output_dir}/{name}_"), F.col("part_id"), F.lit(extension)))


def _by_length(df: DataFrame, limit: int) -> DataFrame:
    """Greedy parts depend on all records before, so one task walks the lengths, 16 bytes a record in
    stream order, from part to part by search in their running sum, and gives the first record of each;
    records find their part by an as-of window over cells."""
    require(limit >= 1, "bases_per_file is positive")

    def walk(batches):
        import numpy as np
        import pandas as pd

        filled, part = None, 0
        for batch in batches:
            n = batch["n"].to_numpy(np.int64)
            upto = np.concatenate([[0], np.cumsum(n)])
            firsts, at = [], 0
            while at < len(n):
                if filled is None or (filled > 0 and filled + n[at] > limit):
                    part, filled = part + 1, 0
                    firsts.append((at, part))
                # as many records as fit; one at least, which may be longer than a part or end an empty one
                room = max(at + 1, int(np.searchsorted(upto, upto[at] + limit - filled, side="right")) - 1)
                filled += int(upto[room] - upto[at])
                at = room
            yield pd.DataFrame({ORD: batch[ORD].to_numpy()[[a for a, _ in firsts]], "_part": [p for _, p in firsts]})

    lengths = df.select(ORD, F.length("sequence").cast("long").alias("n")).orderBy(ORD).coalesce(1)
    firsts = lengths.mapInPandas(walk, f"{ORD} long, _part long")
    marked = df.join(firsts, ORD, "left").withColumn("_cell", F.floor(F.col(ORD) / 65536))
    own = F.max("_part").over(W.partitionBy("_cell").orderBy(ORD).rowsBetween(W.unboundedPreceding, 0))
    cells = marked.groupBy("_cell").agg(F.max("_part").alias("_top"))
    before = cells.select("_cell", F.max("_top").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    filled = marked.withColumn("_own", own).join(before, "_cell")
    out = filled.withColumn("part_id", F.coalesce("_own", "_before").cast("string"))
    return out.withColumn("sequence_count", F.row_number().over(W.partitionBy("part_id").orderBy(ORD))).drop("_part", "_cell", "_own", "_before")


def summary(parts: DataFrame) -> DataFrame:
    """(part_id, output_file, sequences, bases)."""
    return parts.groupBy("part_id", "output_file").agg(F.count(F.lit(1)).alias("sequences"), F.sum(F.length("sequence")).alias("bases"))


def write(parts: DataFrame, path: str, as_fastq: bool = False) -> None:
    """One folder for each part, text in stream order."""
    from seqloom.sources.sinks import fasta_text, fastq_text

    text = fastq_text() if as_fastq else fasta_text()
    parts.select(ORD, "part_id", text.alias("value")).repartition("part_id").sortWithinPartitions("part_id", ORD).select("part_id", "value").write.partitionBy("part_id").mode("overwrite").text(path)
