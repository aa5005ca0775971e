"""Coordinates: regions, BED and GTF fields, pair names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.bind import let
from seqloom.schema import SeqError, require

#: Largest coordinate that the formats take.
LIMIT = 2_500_000_000


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_region(region: str) -> tuple[int, int]:
    """'a:b' as two whole numbers, negative ones count from the end."""
    m = re.fullmatch(r"\s*(-?\d+)\s*:\s*(-?\d+)\s*", region)
    if not m:
        raise SeqError(f"region {region!r} is not start:end")
    return int(m[1]), int(m[2])


def start_position(start: int, length: Column, one_based: bool = True) -> Column:
    """0-based start, clamped at 0."""
    at = length + start if start < 0 else F.lit(start - 1 if one_based else start)
    return F.greatest(at, F.lit(0))


def end_position(end: int, length: Column) -> Column:
    """Exclusive end, clamped to the sequence; -1 is its end."""
    at = length if end == -1 else length + end if end < 0 else F.lit(end)
    return F.least(F.greatest(at, F.lit(0)), length)


def valid_coordinates(start: Column, end: Column, zero_based: bool = True) -> Column:
    low = 0 if zero_based else 1
    return (start >= low) & (end >= start) & (end <= LIMIT)


def valid_strand(strand: str | Column) -> Column:
    return _c(strand).isin("+", "-", ".")


def parse_rgb(rgb: str | Column) -> Column:
    """'r,g,b' as struct, null if it is not three numbers from 0 to 255; '0' is black."""
    parts = F.transform(F.split(_c(rgb), ","), lambda x: F.trim(x).try_cast("int"))
    ok = (F.size(parts) == 3) & F.forall(parts, lambda x: x.isNotNull() & x.between(0, 255))
    black = F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    return F.when(_c(rgb) == "0", black).when(ok, F.struct(F.get(parts, F.lit(0)).alias("r"), F.get(parts, F.lit(1)).alias("g"), F.get(parts, F.lit(2)).alias("b")))


def bed_variant(fields: Column) -> Column:
    """BED3 to BED12 by the number of fields, null where no variant has as many."""
    return F.when(fields.isin(3, 4, 5, 6, 9, 12), F.concat(F.lit("BED"), fields.cast("string")))


def pair_id(name: str | Column) -> Column:
    """A read's name without the mark of its side."""
    return F.regexp_replace(_c(name), r"[/._][12]$|[/._][Rr][12]$", "")


def pair_side(name: str | Column) -> Column:
    """1 or 2 from the mark of a read's name, null without one."""
    return F.when(F.rlike(_c(name), F.lit(r"[/._][Rr]?1$")), 1).when(F.rlike(_c(name), F.lit(r"[/._][Rr]?2$")), 2)


def gtf_score(score: str | Column) -> Column:
    return F.when(_c(score) == ".", None).otherwise(_c(score).try_cast("double"))


def gtf_frame(frame: str | Column) -> Column:
    return F.when(_c(frame).isin("0", "1", "2"), _c(frame).cast("int"))


def gtf_attributes(text: str | Column) -> Column:
    """map<key, array<value>> of 'key value;' pairs; repeated keys collect their values in order."""
    pairs = F.regexp_extract_all(_c(text), F.lit(r'([^\s;"]+\s+(?:"[^"]*"|[^;"]*))'), F.lit(1))
    split = F.transform(
        pairs,
        lambda p: F.struct(F.regexp_extract(p, r"^(\S+)", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(p, r"^\S+\s+(.*)$", 1)), '^"|"$', "").alias("v")),
    )

    def of(found: Column) -> Column:
        keys = F.array_distinct(F.transform(found, lambda x: x["k"]))
        return let(keys, lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda k: F.transform(F.filter(found, lambda x: x["k"] == k), lambda x: x["v"]))))

    return let(split, of)


def gtf_database(attributes: Column) -> Column:
    """gencode, ensembl, refseq or unknown, from the names of attributes."""

    def has(*names: str) -> Column:
        return F.arrays_overlap(F.map_keys(attributes), F.array(*map(F.lit, names)))

    return F.when(has("gene_type", "level", "havana_gene"), "GENCODE").when(has("gene_biotype", "gene_version", "gene_source"), "Ensembl").when(has("locus_tag", "product", "Dbxref"), "RefSeq").otherwise("unknown")


def gtf_normalized(attributes: Column) -> Column:
    """One set of names over the databases: gene_type, transcript_type, version, tags, source_database."""

    def one(*names: str) -> Column:
        return F.coalesce(*[F.get(F.try_element_at(attributes, F.lit(n)), F.lit(0)) for n in names])

    return F.struct(
        one("gene_type", "gene_biotype").alias("gene_type"),
        one("transcript_type", "transcript_biotype").alias("transcript_type"),
        F.coalesce(one("gene_version"), F.nullif(F.regexp_extract(one("gene_id"), r"\.(\d+)$", 1), F.lit(""))).alias("version"),
        F.coalesce(F.try_element_at(attributes, F.lit("tag")), F.array().cast("array<string>")).alias("tags"),
        gtf_database(attributes).alias("source_database"),
    )


def check_region_options(**given) -> None:
    require(sum(v is not None for v in given.values()) == 1, f"exactly one of {', '.join(given)}")
