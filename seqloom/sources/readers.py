"""Readers. Each returns records with `_ord`, the order of the input: files by name, then by place.

Text formats with one record a line are read by Spark's text source and split into columns. FASTA is
read with records as lines (a separator of two characters), FASTQ of four lines a record by numbering
lines over splits, a JSON document in pieces between opening braces. FASTQ whose records take any number
of lines, and BAM, are streams that only their start makes readable: their pieces are read in splits, and
one task a file walks them in order. No file is held whole, but for FASTQ compressed in a way that Spark's
text source does not know.
"""

from __future__ import annotations

import gzip
import io
import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import coords, quality
from seqloom.schema import ORD, ParseError, SeqError, conform, require

FILE_SPAN = 1 << 40


def _files(df: DataFrame) -> DataFrame:
    """Adds `_file`, the number of the row's file in order of names. One small row for each file."""
    names = df.select("_path").distinct()
    numbered = names.withColumn("_file", F.row_number().over(W.orderBy("_path")) - 1)
    return df.join(numbered, "_path")


def _in_order(df: DataFrame, *columns: str) -> DataFrame:
    """columns of a freshly read df, with `_ord`, `_file` and `_block` (where the row's split begins).

    `_ord` is the file's number among the sorted names, then the split's first byte plus the row's number
    in its task. Spark fills a task with splits up to the size of the largest, so that number is smaller
    than the distance to the next split of the file (a row takes a byte at least)."""
    names = sorted(set(df.inputFiles()))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.select(*columns, F.input_file_name().alias("_name"), F.input_file_block_start().alias("_block"), place.alias("_place"))
    if len(names) < 2:
        numbered = rows.withColumn("_file", F.lit(0).cast("long"))
    else:
        table = df.sparkSession.createDataFrame(list(enumerate(names)), "_file long, _name string")
        numbered = rows.join(table, "_name")
    return numbered.select(*columns, (F.col("_file") * FILE_SPAN + F.col("_block") + F.col("_place")).alias(ORD), "_file", "_block")


def _lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Lines with `_ord`, `_file` and `_block`."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return _in_order(reader.text(path), "value")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Header up to the first white space is the id, the rest the description; lines of the sequence are
    joined; a header without sequence gives an empty one."""
    rows = _lines(spark, path, "\n>")
    text = F.regexp_replace(F.regexp_replace("value", "^﻿?>", ""), "\r", "")
    rows = rows.select(ORD, text.alias("t")).filter(F.trim("t") != "")
    header = F.substring_index("t", "\n", 1)
    body = F.substr("t", F.length(header) + 2)
    seq = F.regexp_replace(body, r"\s+", "")
    name = F.regexp_extract(header, r"^(\S*)", 1)
    return conform(
        rows.select(
            ORD,
            F.lit("fasta").alias("format"),
            F.when(name == "", F.raise_error(F.lit("FASTA header without id"))).otherwise(name).alias("id"),
            F.nullif(F.trim(F.regexp_extract(header, r"^\S*\s+(.*)$", 1)), F.lit("")).alias("description"),
            seq.alias("sequence"),
        )
    )


def parse_fasta(spark: SparkSession, text: str) -> DataFrame:
    rows = []
    for i, block in enumerate(re.split(r"(?m)^>", text)[1:]):
        header, _, body = block.partition("\n")
        name, _, said = header.strip().partition(" ")
        if not name:
            raise ParseError("FASTA header without id")
        rows.append((i, "fasta", name, said.strip() or None, re.sub(r"\s+", "", body)))
    return conform(spark.createDataFrame(rows, f"{ORD} long, format string, id string, description string, sequence string"))


def _opened(content: bytes) -> io.BufferedIOBase:
    if content[:2] == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=io.BytesIO(content))
    if content[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content))
    return io.BytesIO(content)


def fastq_records(lines: Iterator[str], strict: bool = True) -> Iterator[tuple]:
    """(line, id, description, sequence, quality). Sequence and quality may take several lines; quality
    ends when it is as long as the sequence."""
    number = 0
    it = iter(lines)
    for line in it:
        number += 1
        line = line.rstrip("\r\n")
        if not line:
            continue
        if not line.startswith("@"):
            raise ParseError(f"line {number}: a FASTQ header begins with @")
        at, head = number, line[1:]
        seq: list[str] = []
        for line in it:
            number += 1
            line = line.rstrip("\r\n")
            if line.startswith("+"):
                break
            seq.append(line.strip())
        else:
            raise ParseError(f"line {number}: no separator line")
        s, q = "".join(seq), ""
        while len(q) < len(s):
            line = next(it, None)
            if line is None:
                break
            number += 1
            q += line.rstrip("\r\n")
        if not s:
            next(it, None)
            number += 1
        if strict and len(q) != len(s):
            raise ParseError(f"line {number}: quality has {len(q)} and sequence {len(s)} characters")
        name, _, said = head.partition(" ") if " " in head else head.partition("\t")
        yield at, name, said.strip() or None, s, q


def _detect(q: str) -> str:
    low, high = (min(map(ord, q)), max(map(ord, q))) if q else (33, 33)
    if low >= 70 and high <= 93 and high - low <= 5:
        return "phred33"
    if low > 93:
        return "phred64"
    if 59 <= low < 64:
        return "solexa"
    return "phred64" if low >= 64 and high <= 104 else "phred33"


def _first_bytes(spark: SparkSession, path: str) -> bytes:
    """The first four bytes of a file in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(b for b in (stream.read() for _ in range(4)) if b >= 0)
    finally:
        stream.close()


def _four_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first lines look like records of four lines."""
    lines = [r["value"].rstrip("\r") for r in spark.read.text(path).limit(400).collect()]
    whole = lines[: len(lines) // 4 * 4] if len(lines) == 400 else lines
    return len(whole) % 4 == 0 and all(h.startswith("@") and p.startswith("+") and s and len(s) == len(q) for h, s, p, q in zip(*[iter(whole)] * 4, strict=True))


def read_fastq(spark: SparkSession, path: str, quality_encoding: str = "auto", strict: bool = True, four_lines: bool | None = None) -> DataFrame:
    """FASTQ, plain, gzip or zstd. auto takes each file's encoding from its first record. Records of four
    lines (told from the first lines if not said) are read in splits; with any number of lines, one task
    a file walks its lines."""
    require(quality_encoding == "auto" or quality_encoding in quality.ENCODINGS, f"unknown quality encoding {quality_encoding!r}")
    names = ["_file", ORD, "id", "description", "sequence", "quality", "quality_encoding", "line_number"]
    kind = f"_file long, {ORD} long, id string, description string, sequence string, quality string, quality_encoding string, line_number long"

    def records(lines: Iterator[str], number: int) -> Iterator[pd.DataFrame]:
        held, encoding = [], None if quality_encoding == "auto" else quality_encoding
        for i, (at, name, said, s, q) in enumerate(fastq_records(lines, strict)):
            encoding = encoding or _detect(q)
            held.append((number, number * FILE_SPAN + i, name, said, s, q, encoding, at))
            if len(held) == 4096:
                yield pd.DataFrame(held, columns=names)
                held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    files = sorted(set(spark.read.text(path).inputFiles()))
    head = _first_bytes(spark, files[0]) if files else b""
    if head[:4] == b"\x28\xb5\x2f\xfd" or (head[:2] == b"\x1f\x8b" and not files[0].endswith(".gz")):
        whole = _files(spark.read.format("binaryFile").load(path).select(F.col("path").alias("_path"), "content"))

        def parse_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for content, number in zip(batch["content"], batch["_file"], strict=True):
                    yield from records(io.TextIOWrapper(_opened(content), "utf-8"), number)

        rows = whole.select("content", "_file").mapInPandas(parse_whole, kind)
    elif (_four_lines(spark, path) and strict) if four_lines is None else four_lines:
        return read_fastq_lines(spark, path, quality_encoding)
    else:

        def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lines = (x for batch in batches for x in zip(batch["_file"].tolist(), batch["value"].tolist(), strict=True))
            for number, own in itertools.groupby(lines, key=lambda x: x[0]):
                yield from records((x[1] for x in own), number)

        rows = _lines(spark, path).select("_file", ORD, "value").repartition(max(1, len(files)), "_file").sortWithinPartitions(ORD).select("_file", "value").mapInPandas(parse, kind)
    return conform(rows.drop("_file").withColumn("format", F.lit("fastq")))


def read_fastq_lines(spark: SparkSession, path: str, quality_encoding: str = "phred33") -> DataFrame:
    """FASTQ of four lines a record, split among tasks: lines are numbered by file over its splits and
    grouped by four. The table of splits has a row for each split and is broadcast."""
    lines = _lines(spark, path)
    splits = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min(ORD).alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    table = splits.select("_file", "_block", "_first", before.alias("_before"))
    # within a split, `_ord` counts lines
    n = F.col("_before") + F.col(ORD) - F.col("_first")
    rec = lines.join(F.broadcast(table), ["_file", "_block"]).select("_file", F.floor(n / 4).alias("_i"), (n % 4).alias("k"), F.regexp_replace("value", "\r$", "").alias("v"))
    part = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    rows = rec.groupBy("_file", "_i").agg(part(0).alias("h"), part(1).alias("sequence"), part(2).alias("plus"), part(3).alias("quality"))
    fail = lambda said: F.raise_error(F.concat(F.lit(f"{said} (records of more lines take four_lines=False): line "), (F.col("_i") * 4 + 1).cast("string")))
    header = (
        F.when(~F.startswith("h", F.lit("@")), fail("no FASTQ header"))
        .when(~F.coalesce(F.startswith("plus", F.lit("+")), F.lit(False)), fail("no separator line"))
        .when(F.length("sequence") != F.coalesce(F.length("quality"), F.lit(-1)), fail("quality and sequence differ in length"))
        .otherwise(F.substr("h", F.lit(2)))
    )
    if quality_encoding == "auto":
        firsts = rows.filter("_i = 0").select("_file", quality.detect_encoding("quality").alias("quality_encoding"))
        rows = rows.join(F.broadcast(firsts), "_file")  # a row for each file, whose names are on the driver
    else:
        rows = rows.withColumn("quality_encoding", F.lit(quality_encoding))
    return conform(
        rows.select((F.col("_file") * FILE_SPAN + F.col("_i")).alias(ORD), F.lit("fastq").alias("format"), F.regexp_extract(header, r"^(\S*)", 1).alias("id"), F.nullif(F.trim(F.regexp_extract(F.substr("h", F.lit(2)), r"^\S*\s+(.*)$", 1)), F.lit("")).alias("description"), "sequence", "quality", "quality_encoding", (F.col("_i") * 4 + 1).alias("line_number"))
    )


def parse_fastq(spark: SparkSession, text: str, quality_encoding: str = "phred33") -> DataFrame:
    """In-memory FASTQ; blank lines are dropped."""
    rows = [(i, "fastq", name, said, s, q, quality_encoding, at) for i, (at, name, said, s, q) in enumerate(fastq_records(iter(x for x in text.splitlines() if x.strip())))]
    return conform(spark.createDataFrame(rows, f"{ORD} long, format string, id string, description string, sequence string, quality string, quality_encoding string, line_number long"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments; header lines are skipped. Unmapped positions are 0; a `*` sequence is empty; a
    missing quality is `*` for each base."""
    lines = _lines(spark, path).filter(~F.startswith("value", F.lit("@")) & (F.trim("value") != ""))
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    ok = F.when(F.size(f) >= 11, f).otherwise(F.raise_error(F.concat(F.lit("not an alignment: "), F.substr("value", F.lit(1), F.lit(80)))))
    rows = lines.select(ORD, ok.alias("f"))
    s = F.when(F.col("f")[9] == "*", "").otherwise(F.col("f")[9])
    q = F.when(F.col("f")[10] == "*", F.repeat(F.lit("*"), F.length(s))).otherwise(F.col("f")[10])
    return conform(
        rows.select(
            ORD, F.lit("sam").alias("format"), F.col("f")[0].alias("id"), s.alias("sequence"), q.alias("quality"), F.lit("phred33").alias("quality_encoding"),
            F.col("f")[1].cast("int").alias("flag"), F.col("f")[2].alias("reference_sequence"), F.col("f")[3].cast("long").alias("position"), F.col("f")[4].cast("int").alias("mapping_quality"), F.col("f")[5].alias("cigar"),
        )
    )


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).filter(F.startswith("value", F.lit("@"))).select(ORD, "value")


def reference_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of the @SQ lines."""
    h = sam_header(spark, path).filter(F.startswith("value", F.lit("@SQ")))
    return h.select(ORD, F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))


NIBBLES = "=ACMGRSVTWYHKDBN"
CIGAR = "MIDNSHP=X"


def bam_records(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """(id, flag, reference, position, mapq, cigar, sequence, quality) of a decompressed BAM stream."""

    def take(n: int) -> bytes:
        data = stream.read(n)
        if len(data) != n:
            raise ParseError("truncated BAM")
        return data

    if take(4) != b"BAM\x01":
        raise ParseError("not a BAM file")
    take(struct.unpack("<i", take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", take(4))[0]):
        names.append(take(struct.unpack("<i", take(4))[0])[:-1].decode())
        take(4)
    while True:
        head = stream.read(4)
        if not head:
            return
        block = take(struct.unpack("<i", head)[0])
        ref, pos, n_name, mapq, _, n_cigar, flag, n_seq = struct.unpack_from("<iiBBHHHi", block)
        at = 32
        name = block[at : at + n_name - 1].decode()
        at += n_name
        ops = struct.unpack_from(f"<{n_cigar}I", block, at)
        at += 4 * n_cigar
        packed = block[at : at + (n_seq + 1) // 2]
        at += (n_seq + 1) // 2
        seq = "".join(NIBBLES[b >> 4] + NIBBLES[b & 15] for b in packed)[:n_seq]
        raw = block[at : at + n_seq]
        q = "*" * n_seq if not raw or raw == b"\xff" * n_seq else bytes(x + 33 for x in raw).decode("latin-1")
        yield name, flag, names[ref] if ref >= 0 else "*", pos + 1 if pos >= 0 else 0, mapq, "".join(f"{o >> 4}{CIGAR[o & 15]}" for o in ops) or "*", seq, q


#: What a block of a BAM file begins with. Blocks are read as lines that this separates.
BLOCK_START = b"\x1f\x8b\x08\x04"


class _Pieces(io.RawIOBase):
    """A file as a stream, from its pieces between separators."""

    def __init__(self, pieces: Iterator[bytes], separator: bytes):
        self.pieces, self.separator, self.held, self.first = pieces, separator, b"", True

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.held:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.held = bytes(piece) if self.first else self.separator + bytes(piece)
            self.first = False
        n = min(len(into), len(self.held))
        into[:n], self.held = self.held[:n], self.held[n:]
        return n


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """BAM by its published layout; its blocks are gzip members. Blocks are read in splits; records may
    cross blocks, so one task a file walks them, holding a block at a time."""
    source = spark.read.options(encoding="ISO-8859-1", lineSep=BLOCK_START.decode("latin-1")).text(path)
    n_files = max(1, len(set(source.inputFiles())))
    blocks = _in_order(source.select(F.col("value").cast("binary").alias("value")), "value")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [ORD, "id", "flag", "reference_sequence", "position", "mapping_quality", "cigar", "sequence", "quality"]
        pieces = (x for batch in batches for x in zip(batch["_file"].tolist(), batch["value"].tolist(), strict=True))
        for number, own in itertools.groupby(pieces, key=lambda x: x[0]):
            stream = io.BufferedReader(_Pieces((x[1] for x in own), BLOCK_START), 1 << 20)
            held = []
            for i, r in enumerate(bam_records(gzip.GzipFile(fileobj=stream))):
                held.append((number * FILE_SPAN + i, *r))
                if len(held) == 4096:
                    yield pd.DataFrame(held, columns=names)
                    held = []
            if held:
                yield pd.DataFrame(held, columns=names)

    kind = f"{ORD} long, id string, flag int, reference_sequence string, position long, mapping_quality int, cigar string, sequence string, quality string"
    rows = blocks.repartition(n_files, "_file").sortWithinPartitions(ORD).select("_file", "value").mapInPandas(parse, kind)
    return conform(rows.withColumns({"format": F.lit("bam"), "quality_encoding": F.lit("phred33")}))


def read_bed(spark: SparkSession, path: str, allow_zero_length: bool = True) -> DataFrame:
    """BED3 to BED12. Comments, `track` and `browser` lines are skipped; coordinates, scores, thick parts
    and blocks are checked."""
    lines = _lines(spark, path)
    v = F.trim("value")
    skip = (v == "") | F.startswith(v, F.lit("#")) | F.rlike(v, F.lit(r"^(track|browser)\b"))
    rows = lines.filter(~skip).select(ORD, F.split(v, r"\s+").alias("f"))
    n = F.size("f")
    fail = lambda said: F.raise_error(F.concat(F.lit(f"{said}: "), F.array_join("f", " ")))
    f = lambda i: F.get(F.col("f"), F.lit(i))
    ints = lambda i: F.transform(F.filter(F.split(f(i), ","), lambda x: x != ""), lambda x: x.cast("int"))
    bed = rows.select(
        ORD, "f", f(0).alias("chromosome"), f(1).try_cast("long").alias("start"), f(2).try_cast("long").alias("end"), f(3).alias("name"), f(4).try_cast("int").alias("score"), f(5).alias("strand"),
        f(6).try_cast("long").alias("thick_start"), f(7).try_cast("long").alias("thick_end"), f(8).alias("item_rgb"), f(9).try_cast("int").alias("block_count"), ints(10).alias("block_sizes"), ints(11).alias("block_starts"), n.alias("fields"),
    )
    length = F.col("end") - F.col("start")
    bad = (
        F.when(coords.bed_variant(F.col("fields")).isNull(), fail("no BED line"))
        .when(F.col("start").isNull() | F.col("end").isNull() | ~coords.valid_coordinates(F.col("start"), F.col("end")), fail("bad coordinates"))
        .when((length == 0) & F.lit(not allow_zero_length), fail("empty interval"))
        .when((F.col("fields") >= 5) & ~F.coalesce(F.col("score").between(0, 1000), F.lit(False)), fail("bad score"))
        .when((F.col("fields") >= 6) & ~coords.valid_strand("strand"), fail("bad strand"))
        .when((F.col("fields") >= 9) & ~F.coalesce((F.col("thick_start") >= F.col("start")) & (F.col("thick_end") <= F.col("end")) & (F.col("thick_start") <= F.col("thick_end")), F.lit(False)), fail("thick part outside"))
        .when((F.col("fields") == 12) & ~_good_blocks(length), fail("bad blocks"))
    )
    stats = F.struct(coords.bed_variant(F.col("fields")).alias("bed_type"), length.alias("length"), F.col("thick_start").isNotNull().alias("has_thick_region"), F.col("block_count").isNotNull().alias("has_blocks"))
    out = bed.withColumn("chromosome", F.coalesce(bad.cast("string"), F.col("chromosome")))
    return out.withColumns({"length": length, "midpoint": F.floor((F.col("start") + F.col("end")) / 2), "stats": stats}).drop("f", "fields")


def _good_blocks(length):
    n, sizes, starts = F.col("block_count"), F.col("block_sizes"), F.col("block_starts")
    apart = F.forall(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: (i >= n - 1) | (F.get(starts, i) + F.get(sizes, i) <= F.get(starts, i + 1)))
    return F.coalesce((n >= 1) & (F.size(sizes) == n) & (F.size(starts) == n) & (F.get(starts, F.lit(0)) == 0) & (F.get(starts, n - 1) + F.get(sizes, n - 1) == length) & apart, F.lit(False))


def count_intervals(spark: SparkSession, path: str) -> int:
    v = F.trim("value")
    return spark.read.text(path).filter(~((v == "") | F.startswith(v, F.lit("#")) | F.rlike(v, F.lit(r"^(track|browser)\b")))).count()


def read_gtf(
    spark: SparkSession, path: str, include_features: list[str] | None = None, exclude_features: list[str] | None = None, required_attributes: list[str] | None = None, normalize: bool = False
) -> DataFrame:
    """Features of nine tab-separated fields; `.` scores and frames are null; attributes are a map of
    arrays. Types are chosen before attributes are parsed."""
    lines = _lines(spark, path).filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = lines.select(ORD, F.when(F.size(f) == 9, f).otherwise(F.raise_error(F.concat(F.lit("not nine fields: "), F.substr("value", F.lit(1), F.lit(80))))).alias("f"))
    if include_features:
        rows = rows.filter(F.col("f")[2].isin(include_features))
    if exclude_features:
        rows = rows.filter(~F.col("f")[2].isin(exclude_features))
    g = rows.select(
        ORD, F.col("f")[0].alias("seqname"), F.col("f")[1].alias("source"), F.col("f")[2].alias("feature"), F.col("f")[3].try_cast("long").alias("start"), F.col("f")[4].try_cast("long").alias("end"),
        coords.gtf_score(F.col("f")[5]).alias("score"), F.col("f")[6].alias("strand"), coords.gtf_frame(F.col("f")[7]).alias("frame"), coords.gtf_attributes(F.col("f")[8]).alias("attributes"),
    )
    ok = F.coalesce(coords.valid_coordinates(F.col("start"), F.col("end"), zero_based=False) & coords.valid_strand("strand"), F.lit(False))
    g = g.withColumn("seqname", F.when(ok, F.col("seqname")).otherwise(F.raise_error(F.concat(F.lit("bad feature on "), F.col("seqname"))))).withColumn("length", F.col("end") - F.col("start") + 1)
    for a in required_attributes or []:
        g = g.filter(F.map_contains_key("attributes", a))
    return g.withColumn("normalized", coords.gtf_normalized(F.col("attributes"))) if normalize else g


def count_features(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).count()


_JSON_ROW = "id string, sequence string, quality string, description string, qualityEncoding string, format string, lineNumber long"


def _from_json_rows(rows: DataFrame, fmt: str | None, encoding: str) -> DataFrame:
    fastq = F.lit(fmt == "fastq") if fmt else F.col("quality").isNotNull()
    missing = F.col("id").isNull() | F.col("sequence").isNull()
    return conform(
        rows.select(
            ORD, F.when(fastq, "fastq").otherwise("fasta").alias("format"), F.when(missing, F.raise_error(F.lit("a row lacks id or sequence"))).otherwise(F.col("id")).alias("id"), "description", "sequence",
            F.when(fastq, F.col("quality")).alias("quality"), F.when(fastq, F.coalesce("qualityEncoding", F.lit(encoding))).alias("quality_encoding"), F.col("lineNumber").alias("line_number"),
        )
    )


_JSON_SPACE = " \t\r\n"
_JSON_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+("?)|[\[\]{}]', re.S)
_JSON_STRING_END = re.compile(r'(?:[^"\\]++|\\.)*+("?)', re.S)
_JSON_NO_ROWS = re.compile(r'(?<!\\)"sequences"[ \t\r\n]*+:[ \t\r\n]*+(?!\[|null)')


def _json_brackets(text: str, inside: bool) -> tuple[list[tuple[int, str, bool]], bool]:
    """Brackets outside strings: place, bracket, whether it is the value of "sequences"; and whether text ends
    inside a string. inside: text begins in one."""
    at, last, found = 0, None, []
    if inside:
        m = _JSON_STRING_END.match(text)
        if not m[1]:
            return found, True
        at = m.end()
    for m in _JSON_TOKEN.finditer(text, at):
        if m[0][0] != '"':
            named = m[0] == "[" and last is not None and text[last.end() : m.start()].strip(_JSON_SPACE) == ":" and json.loads(last[0]) == "sequences"
            found.append((m.start(), m[0], named))
        elif not m[1]:
            return found, True
        else:
            last = m
    return found, False


def _json_plain(piece: str) -> bool:
    """Whether a piece that begins outside strings is a flat object and what separates it from the next one."""
    return "[" not in piece and "]" not in piece and "\\" not in piece and piece.count("}") == 1 and piece.count('"') % 2 == 0 and piece.rfind('"') < piece.find("}")


def _json_level(stack: list) -> int:
    """How many brackets are open around a row; 0 where no rows can be."""
    if stack and stack[0][0] == "[":
        return 1
    return 2 if len(stack) > 1 and stack[1][1] else 0


def _json_close(stack: list, bracket: str) -> None:
    if stack.pop()[0] + bracket not in ("[]", "{}"):
        raise ParseError("brackets of a JSON document do not match")


def _json_splits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(file, split, its pieces, each as its place and its text with the bracket before it)."""
    rows = (x for b in batches for x in zip(b["_name"].tolist(), b["_block"].tolist(), b["value"].tolist(), strict=True))
    for (name, block), own in itertools.groupby(rows, key=lambda x: x[:2]):
        yield name, block, ((i, x[2] if block + i == 0 else "{" + x[2]) for i, x in enumerate(own))


def _json_rows(pieces: Iterator[tuple[int, str]], block: int, start: int, inside: bool, stack: list, begun: bool) -> Iterator[tuple]:
    """(`_ord`, block, whole, text) of the rows of a split, or of the parts of those that lie in several. start: what is
    added to places; inside, stack, begun: what is open where the split begins, and whether the document has begun."""

    def between(text: str, want: str) -> None:
        if text.strip(_JSON_SPACE) != want:
            raise ParseError(f"a JSON document has {text.strip(_JSON_SPACE)[:40]!r} where rows are expected")

    def beside(text: str) -> None:
        if len(stack) == 1 and not level and _JSON_NO_ROWS.search(text):
            raise ParseError("sequences of a JSON document are no array")

    level = _json_level(stack)
    row, own, parts = stack[level][2] if level and len(stack) > level else None, False, []
    for i, text in pieces:
        if level and len(stack) == level and not inside and _json_plain(text):
            end = text.index("}") + 1
            between(text[end:], ",")
            yield start + i, block, True, text[:end]
            continue
        found, ends_inside = _json_brackets(text, inside)
        # at: what comes before belongs to a row or has been looked at; want: what stands between here and the next row
        at, want, seen = 0, ",", 0
        for place, c, named in found:
            beside(text[seen : place + 1])
            seen = place + 1
            if c in "[{":
                if not stack:
                    between(text[at:place] + c * begun, "")
                    begun = True
                elif len(stack) == level:
                    between(c, "{")
                    row, own, at = start + i, True, place
                stack.append((c, named, start + i))
                if len(stack) == 1 or len(stack) == 2 and not level:
                    level = _json_level(stack)
                    if level == len(stack):
                        at, want = place + 1, ""
                continue
            if not stack:
                raise ParseError("brackets of a JSON document do not match")
            if len(stack) == level:
                between(text[at:place], "")
            _json_close(stack, c)
            if row is not None and len(stack) == level:
                yield row, block, own, "".join(parts) + text[at : place + 1]
                row, parts, at, want = None, [], place + 1, ","
            elif len(stack) < level:
                level, at = 0, place + 1
            if not stack:
                at = place + 1
        beside(text[seen:])
        inside = ends_inside
        if row is not None:
            parts.append(text[at:])
        elif not stack:
            between(text[at:], "")
        elif len(stack) == level:
            between(text[at:], want)
    if row is not None:
        yield row, block, False, "".join(parts)


def read_json(spark: SparkSession, path: str, fmt: str | None = None, encoding: str = "phred33") -> DataFrame:
    """A JSON array of rows, or an object with `sequences`; a document a file, on any number of lines.

    Documents are read in splits, as pieces between opening braces. Whether a piece begins in a string, and in which
    brackets, depends on all before it: quotes are counted by split, then each split tells which brackets it leaves open
    and which it closes, and from a line for each split the driver says where each begins. Then rows are cut out and
    parsed by themselves. What stands beside the rows is read for its brackets only."""
    lines = spark.read.option("lineSep", "{").text(path)
    pieces = lines.select("value", F.input_file_name().alias("_name"), F.input_file_block_start().alias("_block"))
    number = {name: i for i, name in enumerate(sorted(set(lines.inputFiles())))}
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = pieces.groupBy("_name", "_block").agg(F.sum(F.length(plain) - F.length(F.translate(plain, '"', ""))).alias("n")).collect()
    inside, odd = {}, dict.fromkeys(number, False)
    for name, block, n in sorted(quotes):
        inside[name, block] = odd[name]
        odd[name] ^= n % 2 == 1
    if any(odd.values()):
        raise ParseError("a JSON document ends within a string")

    def brackets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, block, own in _json_splits(batches):
            now, closed, opened, start = inside[name, block], "", [], number[name] * FILE_SPAN + block
            for i, text in own:
                if not now and text[:1] == "{" and _json_plain(text):
                    continue
                found, now = _json_brackets(text, now)
                for _, c, named in found:
                    if c in "[{":
                        opened.append((c, named, start + i))
                    elif opened:
                        _json_close(opened, c)
                    else:
                        closed += c
            yield pd.DataFrame({"name": [name], "block": [block], "closed": [closed], "opened": [json.dumps(opened)]})

    starts, stacks, begun = {}, {name: [] for name in number}, set()
    for name, block, closed, opened in sorted(pieces.mapInPandas(brackets, "name string, block long, closed string, opened string").collect()):
        stack = stacks[name]
        starts[name, block] = inside[name, block], list(stack), name in begun
        for c in closed:
            if not stack:
                raise ParseError("brackets of a JSON document do not match")
            _json_close(stack, c)
        stack += json.loads(opened)
        if stack or closed:
            begun.add(name)
    if any(stacks.values()):
        raise ParseError("a JSON document ends within brackets")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (x for name, block, own in _json_splits(batches) for x in _json_rows(own, block, number[name] * FILE_SPAN + block, starts[name, block][0], list(starts[name, block][1]), starts[name, block][2]))
        while held := list(itertools.islice(rows, 4096)):
            yield pd.DataFrame(held, columns=[ORD, "_block", "_whole", "text"])

    rows = pieces.mapInPandas(cut, f"{ORD} long, _block long, _whole boolean, text string")
    if any((n := _json_level(stack)) and len(stack) > n for _, stack, _ in starts.values()):  # rows in several splits
        parts = rows.filter("NOT _whole").groupBy(ORD).agg(F.array_sort(F.collect_list(F.struct("_block", "text"))).alias("p"))
        rows = rows.filter("_whole").select(ORD, "text").union(parts.select(ORD, F.array_join("p.text", "").alias("text")))
    return _from_json_rows(rows.select(ORD, F.from_json("text", _JSON_ROW, {"mode": "FAILFAST"}).alias("r")).select(ORD, "r.*"), fmt, encoding)


def read_jsonl(spark: SparkSession, path: str, fmt: str | None = None, encoding: str = "phred33") -> DataFrame:
    read = spark.read.schema(_JSON_ROW).json(path)
    rows = _in_order(read, *read.columns).drop("_file", "_block")
    return _from_json_rows(rows, fmt, encoding)


DEFAULT_HEADERS = ("id", "sequence", "quality", "description")


def read_dsv(
    spark: SparkSession, path: str, delimiter: str | None = None, header: bool | None = None, quote: str = '"', comment: str | None = "#", columns: list[str] | None = None, ragged: str = "pad", with_stats: bool = False
) -> DataFrame:
    """Delimited text as records, other columns kept. Delimiter and header are detected if not given.
    ragged: pad, error or ignore (drops) rows with too few or too many fields."""
    from seqloom.functions.bases import dsv_gc, dsv_gc_skew
    from seqloom.operators.tabular import from_tabular
    from seqloom.sources.detect import detect_delimiter, detect_headers

    require(ragged in ("pad", "error", "ignore", "truncate"), f"unknown policy {ragged!r}")
    sample = [r["value"] for r in spark.read.text(path).limit(100).collect()]
    lines = [x for x in sample if x.strip() and not (comment and x.startswith(comment))]
    delimiter = delimiter or detect_delimiter("\n".join(lines)) or ","
    header = detect_headers(lines[:20], delimiter) if header is None else header
    first = [x.strip().strip(quote).lstrip("﻿") for x in lines[0].split(delimiter)] if lines else list(DEFAULT_HEADERS)
    names = columns or (first if header else list(DEFAULT_HEADERS)[: len(first)] + [f"column{i}" for i in range(len(DEFAULT_HEADERS), len(first))])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    mode = {"error": "FAILFAST", "ignore": "DROPMALFORMED"}.get(ragged, "PERMISSIVE")
    reader = spark.read.schema(schema).options(sep=delimiter, quote=quote, escape=quote, header=str(header).lower(), mode=mode, multiLine="false", enforceSchema="true")
    if comment:
        reader = reader.option("comment", comment)
    read = reader.csv(path)
    table = _in_order(read, *[f"`{c}`" for c in read.columns]).drop("_file", "_block")
    out = from_tabular(table)
    if with_stats:
        out = out.withColumns({"gc": dsv_gc("sequence"), "gc_skew": dsv_gc_skew("sequence")})
    return out


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows as they are; columns reach the scan."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit is not None else df


def from_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records from rows; id and sequence must be strings."""
    from seqloom.operators.tabular import from_tabular

    df = read_parquet(spark, path, columns)
    kinds = dict(df.dtypes)
    if kinds.get("id") != "string" or kinds.get("sequence") != "string":
        raise SeqError("id and sequence must be strings")
    return from_tabular(df)


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Records from dicts, in order."""
    names = [f.name for f in conform_schema() if any(f.name in r for r in rows)]
    kinds = {f.name: f.dataType for f in conform_schema()}
    schema = T.StructType([T.StructField(ORD, T.LongType())] + [T.StructField(n, kinds[n]) for n in names if n not in (ORD, "length")])
    return conform(spark.createDataFrame([(i, *[r.get(n) for n in names if n not in (ORD, "length")]) for i, r in enumerate(rows)], schema))


def conform_schema() -> list[T.StructField]:
    from seqloom.schema import SEQ_SCHEMA

    return SEQ_SCHEMA.fields


def is_bgzf(content: bytes) -> bool:
    return content[:4] == b"\x1f\x8b\x08\x04" and b"BC\x02\x00" in content[:18]


def decompress(content: bytes) -> bytes:
    return _opened(content).read() if content else b""


def gunzip_blocks(content: bytes) -> bytes:
    """All members of a multi-member gzip file."""
    out = []
    while content:
        d = zlib.decompressobj(31)
        out.append(d.decompress(content))
        content = d.unused_data
    return b"".join(out)
