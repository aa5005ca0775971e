"""Writers. Text goes out in stream order; `single` makes one part file, which one task writes."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.tabular import as_text, to_tabular
from seqloom.schema import ORD, require


def _header() -> Column:
    return F.concat_ws(" ", "id", F.nullif(F.trim(F.coalesce("description", F.lit(""))), F.lit("")))


def fasta_text(width: int = 80) -> Column:
    """A record as FASTA, its sequence wrapped."""
    require(width >= 0, "width is not negative")
    seq = F.regexp_replace(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"), "\n$", "") if width else F.col("sequence")
    return F.concat(F.lit(">"), _header(), F.lit("\n"), seq)


def fastq_text(default_quality: str = "I") -> Column:
    """A record as FASTQ; one without quality gets a constant one."""
    require(len(default_quality) == 1, "the default quality is one character")
    q = F.coalesce("quality", F.repeat(F.lit(default_quality), F.length("sequence")))
    return F.concat(F.lit("@"), _header(), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), q)


def _write_text(df: DataFrame, text: Column, path: str, compression: str | None, single: bool) -> None:
    out = df.select(ORD, text.alias("value")).orderBy(ORD)
    out = (out.coalesce(1).sortWithinPartitions(ORD) if single else out).select("value")
    writer = out.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


def write_fasta(df: DataFrame, path: str, width: int = 80, compression: str | None = None, single: bool = False) -> None:
    _write_text(df, fasta_text(width), path, compression, single)


def write_fastq(df: DataFrame, path: str, default_quality: str = "I", compression: str | None = None, single: bool = False) -> None:
    _write_text(df, fastq_text(default_quality), path, compression, single)


def write_sam(df: DataFrame, path: str, single: bool = False) -> None:
    star = lambda c: F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "*").otherwise(F.col(c))
    line = F.concat_ws(
        "\t", "id", F.coalesce("flag", F.lit(4)).cast("string"), F.coalesce("reference_sequence", F.lit("*")), F.coalesce("position", F.lit(0)).cast("string"), F.coalesce("mapping_quality", F.lit(255)).cast("string"),
        F.coalesce("cigar", F.lit("*")), F.lit("*"), F.lit("0"), F.lit("0"), star("sequence"), star("quality"),
    )
    _write_text(df, line, path, None, single)


def bed_line() -> Column:
    """An interval as BED, up to its first missing column."""
    c = lambda n: F.col(n).cast("string")
    join = lambda *x: F.concat_ws("\t", *x)
    three = [F.col("chromosome"), c("start"), c("end")]
    six = [*three, F.col("name"), c("score"), F.col("strand")]
    nine = [*six, c("thick_start"), c("thick_end"), F.coalesce("item_rgb", F.lit("0"))]
    ints = lambda n: F.array_join(F.transform(F.coalesce(n, F.array().cast("array<int>")), lambda x: x.cast("string")), ",")
    return (
        F.when(F.col("name").isNull(), join(*three))
        .when(F.col("score").isNull(), join(*three, "name"))
        .when(F.col("strand").isNull(), join(*three, "name", c("score")))
        .when(F.col("thick_start").isNull() | F.col("thick_end").isNull(), join(*six))
        .when(F.col("block_count").isNull(), join(*nine))
        .otherwise(join(*nine, c("block_count"), ints("block_sizes"), ints("block_starts")))
    )


def write_bed(df: DataFrame, path: str, single: bool = False) -> None:
    _write_text(df, bed_line(), path, None, single)


def gtf_line() -> Column:
    """A feature as GTF; values are quoted only where they hold white space, a semicolon or a quote."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    value = lambda v: F.when(F.rlike(v, F.lit(r'[\s;"]')), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)
    pairs = F.flatten(F.transform(F.map_entries("attributes"), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit(" "), value(v)))))
    said = F.concat(F.array_join(pairs, "; "), F.when(F.size(pairs) > 0, ";").otherwise(""))
    score = F.when(F.col("score") == F.floor("score"), F.floor("score").cast("string")).otherwise(F.col("score").cast("string"))
    return F.concat_ws("\t", "seqname", "source", "feature", F.col("start").cast("string"), F.col("end").cast("string"), F.coalesce(score, F.lit(".")), "strand", dot("frame"), said)


def write_gtf(df: DataFrame, path: str, single: bool = False) -> None:
    _write_text(df, gtf_line(), path, None, single)


def write_dsv(df: DataFrame, path: str, delimiter: str = ",", columns: list[str] | None = None, header: bool = True, precision: int = 2, null_value: str = "", excel_safe: bool = False, quote_all: bool = False, compression: str | None = None, single: bool = False) -> None:
    """The table of the columns as delimited text."""
    table = as_text(to_tabular(df, columns), precision, null_value, excel_safe).orderBy(ORD)
    table = (table.coalesce(1).sortWithinPartitions(ORD) if single else table).drop(ORD)
    options = {"sep": delimiter, "header": str(header).lower(), "quoteAll": str(quote_all).lower(), "emptyValue": "", "escape": '"'}
    if compression:
        options["compression"] = compression
    table.write.mode("overwrite").options(**options).csv(path)


def format_row(values: list, delimiter: str = ",", quote_all: bool = False, line_ending: str = "\n") -> str:
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, quoting=csv.QUOTE_ALL if quote_all else csv.QUOTE_MINIMAL, lineterminator=line_ending).writerow(values)
    return out.getvalue()


def write_jsonl(df: DataFrame, path: str, columns: list[str] | None = None, compression: str | None = None, single: bool = False) -> None:
    table = to_tabular(df, columns).orderBy(ORD)
    table = (table.coalesce(1).sortWithinPartitions(ORD) if single else table).drop(ORD)
    writer = table.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).json(path)


def write_json(df: DataFrame, path: str, columns: list[str] | None = None, include_metadata: bool = False, pretty: bool = False) -> None:
    """One JSON array, or an object with sequences and metadata. The format is one document, so one task
    writes it, row by row; JSON lines scale."""
    table = to_tabular(df, columns)
    names = [c for c in table.columns if c != ORD]
    ends = table.agg(F.count(F.lit(1)).alias("n"), F.min(ORD).alias("first"), F.max(ORD).alias("last")).first()
    lead, tail = ('{"sequences": [', f'], "metadata": {json.dumps({"count": ends["n"], "columns": names})}}}') if include_metadata else ("[", "]")
    if not ends["n"]:
        rows = df.sparkSession.createDataFrame([(lead + tail,)], "value string").coalesce(1)
    else:
        row = F.to_json(F.struct(*names), {"ignoreNullFields": "false", "pretty": str(pretty).lower()})
        text = F.concat(F.when(F.col(ORD) == ends["first"], lead).otherwise(""), row, F.when(F.col(ORD) == ends["last"], tail).otherwise(","))
        rows = table.select(ORD, text.alias("value")).coalesce(1).sortWithinPartitions(ORD).select("value")
    rows.write.mode("overwrite").option("lineSep", "\n").text(path)


def collection_metadata(df: DataFrame) -> dict:
    return {"count": df.count(), "columns": [c for c in df.columns if c != ORD]}


COMPRESSIONS = {"snappy": "snappy", "gzip": "gzip", "zstd": "zstd", "lz4": "lz4", "brotli": "brotli", "uncompressed": "uncompressed"}


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", columns: list[str] | None = None) -> None:
    """All columns unless some are named; ids stay strings."""
    require(compression in COMPRESSIONS, f"unknown compression {compression!r}")
    (df.select(*columns) if columns else df).write.mode("overwrite").option("compression", compression).parquet(path)


def write_fai(index: DataFrame, path: str) -> None:
    line = F.concat_ws("\t", "name", *[F.col(c).cast("string") for c in ("length", "offset", "linebases", "linewidth")])
    _write_text(index, line, path, None, True)


def write_text(df: DataFrame, column: str, path: str, compression: str | None = None, single: bool = False) -> None:
    _write_text(df, F.col(column), path, compression, single)
