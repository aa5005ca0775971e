"""SeqFrame: a chain of operators over one lazily planned DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession

from seqloom.operators import pairing, ranking, records, regions, search, sets, splitting, stats, tabular
from seqloom.schema import ORD, conform
from seqloom.sources import readers, sinks


class SeqFrame:
    """Records in stream order. Every method returns a new frame; nothing runs before a terminal one."""

    def __init__(self, df: DataFrame):
        self.df = df

    # sources
    @staticmethod
    def of(df: DataFrame) -> SeqFrame:
        return SeqFrame(conform(df))

    @staticmethod
    def from_rows(spark: SparkSession, rows: list[dict]) -> SeqFrame:
        return SeqFrame(readers.from_rows(spark, rows))

    @staticmethod
    def read(spark: SparkSession, path: str, fmt: str, **options) -> SeqFrame:
        by_name = {"fasta": readers.read_fasta, "fastq": readers.read_fastq, "sam": readers.read_sam, "bam": readers.read_bam, "json": readers.read_json, "jsonl": readers.read_jsonl, "dsv": readers.read_dsv, "parquet": readers.from_parquet}
        return SeqFrame(by_name[fmt](spark, path, **options))

    @staticmethod
    def concat_all(frames: list[SeqFrame], **options) -> SeqFrame:
        return SeqFrame(sets.concat([f.df for f in frames], **options))

    # records
    def filter(self, condition: Column | None = None, **options) -> SeqFrame:
        return SeqFrame(records.filter_records(self.df, custom=condition, **options))

    def filter_by_set(self, members: SeqFrame, exclude: bool = False, by: str = "sequence") -> SeqFrame:
        return SeqFrame(sets.filter_by_set(self.df, members.df, exclude, by))

    def transform(self, **options) -> SeqFrame:
        return SeqFrame(records.transform(self.df, **options))

    def clean(self, **options) -> SeqFrame:
        return SeqFrame(records.clean(self.df, **options))

    def quality(self, **options) -> SeqFrame:
        return SeqFrame(records.quality_filter(self.df, **options))

    def convert(self, target: str, source: str | None = None) -> SeqFrame:
        return SeqFrame(records.convert_quality(self.df, target, source))

    def to_fastq(self, **options) -> SeqFrame:
        return SeqFrame(records.to_fastq(self.df, **options))

    def to_fasta(self, **options) -> SeqFrame:
        return SeqFrame(records.to_fasta(self.df, **options))

    def validate(self, **options) -> SeqFrame:
        return SeqFrame(records.validate(self.df, **options))

    def grep(self, pattern: str, target: str = "sequence", **options) -> SeqFrame:
        return SeqFrame(search.grep(self.df, pattern, target, **options))

    def rename(self, **options) -> SeqFrame:
        return SeqFrame(sets.rename(self.df, **options))

    def replace(self, pattern: str, replacement: str, **options) -> SeqFrame:
        return SeqFrame(records.replace(self.df, pattern, replacement, **options))

    def enumerate(self) -> SeqFrame:
        return SeqFrame(ranking.enumerate_records(self.df))

    def map(self, fn: Callable[[dict], dict], schema=None) -> SeqFrame:
        return SeqFrame(records.map_records(self.df, fn, schema))

    def flat_map(self, fn: Callable, schema=None) -> SeqFrame:
        return SeqFrame(records.flat_map(self.df, fn, schema))

    def tap(self, fn: Callable[[dict], None]) -> SeqFrame:
        return SeqFrame(records.tap(self.df, fn))

    def with_columns(self, columns: dict[str, Column]) -> SeqFrame:
        return SeqFrame(self.df.withColumns(columns))

    # parts of sequences
    def windows(self, size: int, **options) -> SeqFrame:
        return SeqFrame(regions.windows(self.df, size, **options))

    sliding = windows
    kmers = windows

    def subseq(self, region: str | None = None, **options) -> SeqFrame:
        return SeqFrame(regions.subseq(self.df, region, **options))

    def subseq_by_features(self, features: DataFrame, **options) -> SeqFrame:
        return SeqFrame(regions.subseq_by_features(self.df, features, **options))

    def faidx(self, wanted: list[str], **options) -> SeqFrame:
        return SeqFrame(regions.faidx(self.df, wanted, **options))

    def amplicon(self, forward: str, reverse: str | None = None, max_mismatches: int = 0, **options) -> SeqFrame:
        return SeqFrame(search.amplicon(self.df, forward, reverse, max_mismatches, **options))

    def translate(self, code: int = 1, **options) -> SeqFrame:
        return SeqFrame(regions.translate(self.df, code, **options))

    def translate_mito(self) -> SeqFrame:
        return self.translate(2)

    def translate_all_frames(self, code: int = 1) -> SeqFrame:
        return self.translate(code, all_frames=True, include_frame_in_id=True)

    def translate_orf(self, min_length: int = 30, code: int = 1) -> SeqFrame:
        return self.translate(code, all_frames=True, include_frame_in_id=True, orfs_only=True, min_orf_length=min_length, convert_start_codons=True)

    def locate(self, pattern: str, allow_mismatches: int = 0, **options) -> DataFrame:
        return search.locate(self.df, pattern, allow_mismatches=allow_mismatches, **options)

    def find_orfs(self, code: int = 1, min_length: int = 20) -> DataFrame:
        return regions.find_orfs(self.df, code, min_length)

    # order, samples, duplicates, sets
    def head(self, n: int) -> SeqFrame:
        return SeqFrame(ranking.head(self.df, n))

    take = head

    def sort(self, by: str | Column = "length", order: str | None = None, **options) -> SeqFrame:
        return SeqFrame(ranking.sort_records(self.df, by, order, **options))

    def sort_by_length(self, order: str = "asc") -> SeqFrame:
        return self.sort("length", order)

    def sort_by_id(self, order: str = "asc") -> SeqFrame:
        return self.sort("id", order)

    def sort_by_gc(self, order: str = "asc") -> SeqFrame:
        return self.sort("gc", order)

    def top(self, n: int, by: str | Column = "length") -> SeqFrame:
        return SeqFrame(ranking.top_n(self.df, n, by))

    def sample(self, n: int | None = None, **options) -> SeqFrame:
        return SeqFrame(ranking.sample(self.df, n, **options))

    def unique(self, by: str | Column = "sequence", **options) -> SeqFrame:
        return SeqFrame(sets.unique(self.df, by, **options))

    def rmdup(self, by: str | Column = "sequence", **options) -> SeqFrame:
        return SeqFrame(sets.rmdup(self.df, by, **options))

    def concat(self, *others: SeqFrame, **options) -> SeqFrame:
        return SeqFrame(sets.concat([self.df, *[o.df for o in others]], **options))

    def collect_set(self) -> SeqFrame:
        return SeqFrame(sets.sequence_set(self.df))

    def union(self, other: SeqFrame) -> SeqFrame:
        return SeqFrame(sets.union(self.df, other.df))

    def intersection(self, other: SeqFrame) -> SeqFrame:
        return SeqFrame(sets.intersection(self.df, other.df))

    def difference(self, other: SeqFrame) -> SeqFrame:
        return SeqFrame(sets.difference(self.df, other.df))

    def symmetric_difference(self, other: SeqFrame) -> SeqFrame:
        return SeqFrame(sets.symmetric_difference(self.df, other.df))

    def set_metrics(self, other: SeqFrame) -> DataFrame:
        return sets.set_metrics(self.df, other.df)

    # pairs
    def pairs(self, other: SeqFrame | None = None, **options) -> PairFrame:
        return PairFrame(pairing.pairs(self.df, other.df if other else None, **options))

    def interleave_pairs(self, other: SeqFrame | None = None, **options) -> SeqFrame:
        return SeqFrame(pairing.interleave_pairs(self.df, other.df if other else None, **options))

    def interleave(self, other: SeqFrame, **options) -> SeqFrame:
        return SeqFrame(pairing.interleave(self.df, other.df, **options))

    def zip_with(self, other: SeqFrame, columns=None) -> DataFrame:
        return pairing.zip_with(self.df, other.df, columns)

    def merge_pairs(self, other: SeqFrame | None = None, **options) -> SeqFrame:
        return SeqFrame(pairing.merge_pairs(self.df, other.df if other else None, **options))

    # results
    def stats(self, **options) -> DataFrame:
        return stats.stats(self.df, **options)

    def to_tabular(self, columns: list[str] | None = None, **options) -> DataFrame:
        return tabular.to_tabular(self.df, columns, **options)

    def split(self, mode: str, **options) -> DataFrame:
        return splitting.split(self.df, mode, **options)

    def count(self) -> int:
        return self.df.count()

    def collect(self) -> list:
        return self.df.orderBy(ORD).collect()

    def __iter__(self) -> Iterator:
        return self.df.orderBy(ORD).toLocalIterator()

    def for_each(self, fn: Callable[[dict], None]) -> None:
        records.for_each(self.df, fn)

    def fold(self, fn: Callable, initial):
        return records.fold(self.df, fn, initial)

    def reduce(self, fn: Callable):
        return records.reduce_records(self.df, fn)

    def write(self, path: str, fmt: str, **options) -> None:
        by_name = {"fasta": sinks.write_fasta, "fastq": sinks.write_fastq, "sam": sinks.write_sam, "dsv": sinks.write_dsv, "json": sinks.write_json, "jsonl": sinks.write_jsonl, "parquet": sinks.write_parquet}
        by_name[fmt](self.df, path, **options)


class PairFrame:
    """Pairs of reads."""

    def __init__(self, df: DataFrame):
        self.df = df

    def interleave(self) -> SeqFrame:
        return SeqFrame(pairing.flatten_pairs(self.df))

    def merge(self, **options) -> SeqFrame:
        return SeqFrame(pairing.merge_pairs(pairing.flatten_pairs(self.df), **options))

    def count(self) -> int:
        return self.df.count()

    def collect(self) -> list:
        return self.df.orderBy(ORD).collect()
