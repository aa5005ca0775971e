"""Queries of sources and sinks: each writes derived records with a sink, reads them back with a reader
and returns what came back; their SQL says what was written."""

from __future__ import annotations

import re
import struct
import zlib

import pandas as pd
from pyspark.sql import functions as F

from seqloom.operators import pairing, ranking, regions, splitting, tabular
from seqloom.plans import queries as q
from seqloom.plans.frame import SeqFrame
from seqloom.plans.queries import _long, query
from seqloom.schema import ORD
from seqloom.sources import detect, readers, sinks
from seqloom.sources.scratch import folder

PLACE = 'row_number() OVER (ORDER BY o) - 1 AS "index"'


def _numbered(df, *columns):
    """columns and the place of each record in the order that the reader gave."""
    return ranking.enumerate_records(df).select(*columns, "index")


@query("fasta_round_trip", f"WITH {q.READS} SELECT id, description, s AS sequence, {PLACE} FROM reads")
def fasta_round_trip(spark, sf_dir):
    path = folder(spark, "fasta")
    sinks.write_fasta(q.reads(spark, sf_dir), path, width=25)
    return _numbered(readers.read_fasta(spark, path), "id", "description", "sequence")


FASTQ_SQL = f"WITH {q.READS} SELECT id, description, s AS sequence, q AS quality, 'phred33' AS quality_encoding, {PLACE} FROM reads"
FASTQ = ("id", "description", "sequence", "quality", "quality_encoding")


@query("fastq_gzip_round_trip", FASTQ_SQL)
def fastq_gzip_round_trip(spark, sf_dir):
    path = folder(spark, "fastq")
    sinks.write_fastq(q.reads(spark, sf_dir), path, compression="gzip")
    return _numbered(readers.read_fastq(spark, path, "phred33"), *FASTQ)


@query("fastq_lines_round_trip", FASTQ_SQL)
def fastq_lines_round_trip(spark, sf_dir):
    path = folder(spark, "fastq")
    sinks.write_fastq(q.reads(spark, sf_dir), path)
    return _numbered(readers.read_fastq_lines(spark, path), *FASTQ)


@query("fastq_walked_round_trip", FASTQ_SQL)
def fastq_walked_round_trip(spark, sf_dir):
    path = folder(spark, "fastq")
    sinks.write_fastq(q.reads(spark, sf_dir), path)
    return _numbered(readers.read_fastq(spark, path, "phred33", four_lines=False), *FASTQ)


@query("paired_fastq", f"WITH {q.READS} SELECT id, s AS r1, reverse(s) AS r2 FROM reads")
def paired_fastq(spark, sf_dir):
    first, second = folder(spark, "r1"), folder(spark, "r2")
    r = q.reads(spark, sf_dir)
    sinks.write_fastq(r.withColumn("id", F.concat("id", F.lit("/1"))), first)
    sinks.write_fastq(r.withColumns({"id": F.concat("id", F.lit("/2")), "sequence": F.reverse("sequence")}), second)
    both = pairing.paired_records(readers.read_fastq(spark, first, "phred33"), readers.read_fastq(spark, second, "phred33"), check_ids="throw")
    return both.select("id", F.col("r1.sequence").alias("r1"), F.col("r2.sequence").alias("r2"))


@query("sam_round_trip", f"WITH {q.ALIGNMENTS} SELECT id, CAST(flag AS BIGINT) AS flag, ref AS reference_sequence, CAST(pos AS BIGINT) AS position, '3S' || CAST(n - 3 AS VARCHAR) || 'M' AS cigar, s AS sequence, repeat('*', length(s)) AS quality FROM alignments")
def sam_round_trip(spark, sf_dir):
    path = folder(spark, "sam")
    sinks.write_sam(q.alignments(spark, sf_dir), path)
    return readers.read_sam(spark, path).select("id", F.col("flag").cast("long").alias("flag"), "reference_sequence", "position", "cigar", "sequence", "quality")


def _bam(batches):
    """Alignments as the bytes of a BAM file, in blocks of 20,000 bytes that records may cross."""
    names = [f"chr{i}" for i in range(5)]
    data = b"BAM\x01" + struct.pack("<ii", 0, len(names)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1 << 28) for n in names)
    rows = []
    for batch in batches:
        for r in batch.itertuples(index=False):
            ops = [(int(n), o) for n, o in re.findall(r"(\d+)(\D)", r.cigar)]
            bases = [readers.NIBBLES.index(c) for c in r.sequence] + [0] * (len(r.sequence) % 2)
            body = struct.pack("<iiBBHHHiiii", names.index(r.reference_sequence), r.position - 1, len(r.id) + 1, r.mapping_quality, 0, len(ops), r.flag, len(r.sequence), -1, -1, 0)
            body += r.id.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | readers.CIGAR.index(o)) for n, o in ops) + bytes(a << 4 | b for a, b in zip(bases[::2], bases[1::2], strict=True)) + b"\xff" * len(r.sequence)
            rows.append(struct.pack("<i", len(body)) + body)
    data += b"".join(rows)
    out = b""
    for part in [data[k : k + 20_000] for k in range(0, len(data), 20_000)] + [b""]:  # an empty block ends the file
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        raw = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(part), len(part))
    yield pd.DataFrame({"v": [out]})


@query("bam_reading", f"WITH {q.ALIGNMENTS} SELECT id, CAST(flag AS BIGINT) AS flag, ref AS reference_sequence, CAST(pos AS BIGINT) AS position, CAST(mapq AS BIGINT) AS mapping_quality, '3S' || CAST(n - 3 AS VARCHAR) || 'M' AS cigar, s AS sequence, repeat('*', length(s)) AS quality FROM alignments WHERE n > 3")
def bam_reading(spark, sf_dir):
    """Files of blocks, one for each partition; what separates the rows of a text file is padding here."""
    path = folder(spark, "bam")
    a = q.alignments(spark, sf_dir).filter("length > 3").select("id", "flag", "reference_sequence", "position", "mapping_quality", "cigar", "sequence")
    a.mapInPandas(_bam, "v binary").select(F.col("v").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    b = readers.read_bam(spark, path)
    return b.select("id", _long("flag").alias("flag"), "reference_sequence", "position", _long("mapping_quality").alias("mapping_quality"), "cigar", "sequence", "quality")


@query("sam_references", "SELECT n_name AS name, CAST(n_nationkey * 1000 + 7 AS BIGINT) AS length FROM nation")
def sam_references(spark, sf_dir):
    path = folder(spark, "sam")
    n = q._table(spark, sf_dir, "nation")
    line = F.concat(F.lit("@SQ\tSN:"), "n_name", F.lit("\tLN:"), (F.col("n_nationkey") * 1000 + 7).cast("string"))
    sinks.write_text(n.select(F.col("n_nationkey").alias(ORD), line.alias("line")), "line", path)
    return readers.reference_sequences(spark, path).select("name", "length")


@query("bed_round_trip", f"""WITH {q.BEDS} SELECT chromosome, CAST(st AS BIGINT) AS start, CAST(en AS BIGINT) AS "end", 'f' || CAST(o AS VARCHAR) AS name, CAST(o % 1001 AS BIGINT) AS score, CASE WHEN o % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(en - st AS BIGINT) AS length, 'BED6' AS bed_type FROM beds""")
def bed_round_trip(spark, sf_dir):
    path = folder(spark, "bed")
    b = q.beds(spark, sf_dir)
    empty = {c: F.lit(None).cast(t) for c, t in (("thick_start", "long"), ("thick_end", "long"), ("item_rgb", "string"), ("block_count", "int"), ("block_sizes", "array<int>"), ("block_starts", "array<int>"))}
    b = b.withColumns({"name": F.concat(F.lit("f"), F.col(ORD).cast("string")), "score": F.col(ORD) % 1001, "strand": F.when(F.col(ORD) % 2 == 0, "+").otherwise("-"), **empty})
    sinks.write_bed(b, path)
    return readers.read_bed(spark, path).select("chromosome", "start", "end", "name", F.col("score").cast("long").alias("score"), "strand", "length", F.col("stats.bed_type").alias("bed_type"))


@query("gtf_round_trip", """SELECT 's' || CAST(l_suppkey % 7 AS VARCHAR) AS seqname, CASE WHEN l_linenumber % 2 = 0 THEN 'gene' ELSE 'exon' END AS feature, CAST(l_partkey AS BIGINT) AS start, CAST(l_partkey + 10 AS BIGINT) AS "end", CAST(l_linenumber AS DOUBLE) AS score, '+' AS strand,
 'g ' || CAST(l_orderkey AS VARCHAR) AS gene_id, 'lincRNA' AS gene_type, 'x,y;z' AS tags, 'GENCODE' AS source_database, CAST(11 AS BIGINT) AS length FROM lineitem WHERE l_partkey > 0""")
def gtf_round_trip(spark, sf_dir):
    path = folder(spark, "gtf")
    li = q._table(spark, sf_dir, "lineitem").filter("l_partkey > 0")
    one = lambda c: F.array(c)
    attributes = F.create_map(F.lit("gene_id"), one(F.concat(F.lit("g "), F.col("l_orderkey").cast("string"))), F.lit("gene_type"), one(F.lit("lincRNA")), F.lit("tag"), F.array(F.lit("x"), F.lit("y;z")), F.lit("level"), one(F.lit("2")))
    g = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(ORD), F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("seqname"), F.lit("test").alias("source"), F.when(F.col("l_linenumber") % 2 == 0, "gene").otherwise("exon").alias("feature"),
        F.col("l_partkey").alias("start"), (F.col("l_partkey") + 10).alias("end"), F.col("l_linenumber").cast("double").alias("score"), F.lit("+").alias("strand"), F.lit(None).cast("int").alias("frame"), attributes.alias("attributes"),
    )
    sinks.write_gtf(g, path)
    b = readers.read_gtf(spark, path, required_attributes=["gene_id"], normalize=True)
    return b.select("seqname", "feature", "start", "end", "score", "strand", F.col("attributes")["gene_id"][0].alias("gene_id"), F.col("normalized.gene_type").alias("gene_type"), F.array_join("normalized.tags", ",").alias("tags"), F.col("normalized.source_database").alias("source_database"), F.col("length").cast("long").alias("length"))


ROWS_SQL = f"WITH {q.READS} SELECT id, s AS sequence, q AS quality, 'fastq' AS format FROM reads"


@query("json_round_trip", ROWS_SQL)
def json_round_trip(spark, sf_dir):
    path = folder(spark, "json")
    sinks.write_json(q.reads(spark, sf_dir), path, ["id", "sequence", "quality"], include_metadata=True)
    return readers.read_json(spark, path).select("id", "sequence", "quality", "format")


@query("jsonl_round_trip", ROWS_SQL)
def jsonl_round_trip(spark, sf_dir):
    path = folder(spark, "jsonl")
    sinks.write_jsonl(q.reads(spark, sf_dir), path, ["id", "sequence", "quality"], compression="gzip")
    return readers.read_jsonl(spark, path).select("id", "sequence", "quality", "format")


@query("dsv_round_trip", f"WITH {q.READS} SELECT id, s AS sequence, CAST(length(s) AS BIGINT) AS length, round(100.0 * {q._n('GC')} / greatest(1, {q._n('ACGTU')}), 6) AS gc, {PLACE} FROM reads")
def dsv_round_trip(spark, sf_dir):
    """Delimiter and header are found by the reader; GC is what the parser computes."""
    path = folder(spark, "dsv")
    sinks.write_dsv(q.reads(spark, sf_dir), path, ";", ["id", "sequence", "length"])
    r = readers.read_dsv(spark, path, with_stats=True)
    return _numbered(r, "id", "sequence", F.col("length").cast("long").alias("length"), F.round("gc", 6).alias("gc"))


@query("tab2fx", "SELECT CAST(p_partkey AS VARCHAR) AS id, upper(substr(p_name, 1, 5)) AS sequence, CAST(least(5, length(p_name)) AS BIGINT) AS length, 'fasta' AS format FROM part")
def tab2fx(spark, sf_dir):
    p = q._table(spark, sf_dir, "part")
    t = p.select(F.col("p_partkey").alias(ORD), F.col("p_partkey").alias("id"), F.upper(F.substr("p_name", F.lit(1), F.lit(5))).alias("sequence"))
    return tabular.from_tabular(t).select("id", "sequence", F.col("length").cast("long").alias("length"), "format")


@query("parquet_round_trip", f"WITH {q.READS} SELECT id, s AS sequence, q AS quality, CAST(length(s) AS BIGINT) AS length FROM reads")
def parquet_round_trip(spark, sf_dir):
    path = folder(spark, "parquet")
    sinks.write_parquet(q.reads(spark, sf_dir), path, "zstd", [ORD, "id", "sequence", "quality"])
    return readers.from_parquet(spark, path, [ORD, "id", "sequence", "quality"]).select("id", "sequence", "quality", F.col("length").cast("long").alias("length"))


@query("parquet_columns", f"WITH {q.READS} SELECT id FROM reads")
def parquet_columns(spark, sf_dir):
    path = folder(spark, "parquet")
    sinks.write_parquet(q.reads(spark, sf_dir), path)
    return readers.read_parquet(spark, path, ["id"])


@query("from_rows", """SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'a', 'ACG', NULL, CAST(3 AS BIGINT), 'fasta'), (1, 'b', '', 'x y', 0, 'fasta')) t(ord, id, sequence, description, length, format)""")
def from_rows(spark, sf_dir):
    r = readers.from_rows(spark, [{"id": "a", "sequence": "ACG"}, {"id": "b", "sequence": "", "description": "x y"}])
    return r.select(F.col(ORD).alias("ord"), "id", "sequence", "description", F.col("length").cast("long").alias("length"), "format")


@query("parsed_texts", """SELECT * FROM (VALUES ('fasta', 'a', 'ACGT', NULL), ('fasta', 'b', '', NULL), ('fastq', 'r', 'AC', 'II')) t(format, id, sequence, quality)""")
def parsed_texts(spark, sf_dir):
    """In-memory texts of either format."""
    both = [detect.parse_any(spark, t).select("format", "id", "sequence", "quality") for t in (">a x\nAC\nGT\n>b\n", "@r\nAC\n+\nII\n")]
    return both[0].unionByName(both[1])


@query("detected_formats", """SELECT * FROM (VALUES ('fasta', CAST(0.95 AS DOUBLE), 'unknown', false, false), ('fastq', 0.95, 'unknown', false, false), ('bed', 0.8, 'unknown', false, true), ('sam', 0.7, 'unknown', false, false), ('unknown', 0.0, 'array', false, false), ('unknown', 0.0, 'wrapped', false, false), ('unknown', 0.0, 'lines', false, false), ('unknown', 0.0, 'unknown', true, false)) t(format, confidence, json, gtf, bed)""")
def detected_formats(spark, sf_dir):
    texts = [">a\nAC", "@a\nAC\n+\nII", "chr1\t5\t9", "@SQ\tSN:a\tLN:9", '[{"id":"a"}]', '{"sequences":[]}', '{"id":"a"}\n{"id":"b"}', 'chr1\tx\tgene\t1\t9\t.\t+\t.\tgene_id "a";']
    rows = [(*detect.detect_format(t), detect.detect_json(t), detect.detect_gtf(t), detect.detect_bed(t)) for t in texts]
    return spark.createDataFrame(rows, "format string, confidence double, json string, gtf boolean, bed boolean")


@query("sniffed_tables", """SELECT * FROM (VALUES (',', true, CAST(2 AS BIGINT), true, 'p,q,'), (chr(9), false, CAST(3 AS BIGINT), true, 'p,q,'), ('|', true, CAST(2 AS BIGINT), false, 'p,q,')) t(delimiter, has_header, columns, valid, padded)""")
def sniffed_tables(spark, sf_dir):
    texts = ["id,sequence\na,ACGT\nb,AC\n", "a\tAC\t1\nb\tGT\t2\n", "id|seq\na|A\nb|C|x\n"]
    rows = []
    for t in texts:
        s = detect.sniff(t)
        rows.append((s["delimiter"], s["has_header"], s["columns"], detect.validate_dsv(t)["valid"], ",".join(detect.handle_ragged(["p", "q"], 3, "pad"))))
    return spark.createDataFrame(rows, "delimiter string, has_header boolean, columns long, valid boolean, padded string")


@query("dsv_scalars", """SELECT * FROM (VALUES (CAST(3 AS BIGINT), 'id,a b', 'x', 'a' || chr(10) || 'b' || chr(10) || 'c', '"a,b",c' || chr(10))) t(columns, headers, bare, lines, formatted)""")
def dsv_scalars(spark, sf_dir):
    row = (detect.count_columns('a,"b,c",d', ","), ",".join(detect.extract_headers("id, a b ")), detect.remove_bom("﻿x"), detect.normalize_line_endings("a\r\nb\rc"), sinks.format_row(["a,b", "c"]))
    return spark.createDataFrame([row], "columns long, headers string, bare string, lines string, formatted string")


@query("compression_kinds", "SELECT * FROM (VALUES ('x.fa.gz', 'gzip'), ('x.zst', 'zstd'), ('x.bgz', 'gzip'), ('x.fa', 'none'), ('magic', 'gzip')) t(path, kind)")
def compression_kinds(spark, sf_dir):
    rows = [(p, detect.compression_of(p)) for p in ("x.fa.gz", "x.zst", "x.bgz", "x.fa")] + [("magic", detect.compression_of(head=b"\x1f\x8b"))]
    return spark.createDataFrame(rows, "path string, kind string")


@query("file_access", "SELECT 'ACGT' || chr(10) AS whole, 'CG' AS part, true AS found, CAST(5 AS BIGINT) AS size, false AS missing")
def file_access(spark, sf_dir):
    path = folder(spark, "text")
    sinks.write_text(spark.createDataFrame([(0, "ACGT")], f"{ORD} long, v string"), "v", path, single=True)
    (name,) = spark.read.text(path).inputFiles()
    at = detect.file_metadata(spark, name)
    row = (detect.read_bytes(spark, name).decode(), detect.read_bytes(spark, name, 1, 2).decode(), at["exists"], at["size"], detect.file_metadata(spark, f"{name}.gone")["exists"])
    return spark.createDataFrame([row], "whole string, part string, found boolean, size long, missing boolean")


@query("split_written", f"WITH {q.READS}, n AS (SELECT id, s, row_number() OVER (ORDER BY o) - 1 AS r FROM reads) SELECT id, s AS sequence, CAST(r // 300 + 1 AS BIGINT) AS part_id FROM n")
def split_written(spark, sf_dir):
    """Parts of 300 records, a folder each, read back as FASTA."""
    path = folder(spark, "parts")
    splitting.write(splitting.split(q.reads(spark, sf_dir), "by-size", sequences_per_file=300).drop("description").withColumn("description", F.lit(None).cast("string")), path)
    lines = spark.read.option("lineSep", "\n>").text(path)
    record = F.split(F.regexp_replace("value", "^>|\\n$", ""), "\n", 2)
    return lines.select(record[0].alias("id"), F.replace(record[1], F.lit("\n"), F.lit("")).alias("sequence"), F.col("part_id").cast("long").alias("part_id"))


FAI_SQL = q.ORACLE["fai_index"]


@query("fai_of_file", FAI_SQL)
def fai_of_file(spark, sf_dir):
    """The index of a FASTA file, from its bytes; written as a table and read back."""
    path, table = folder(spark, "fasta"), folder(spark, "fai")
    sinks.write_fasta(q.reads(spark, sf_dir), path, width=50, single=True)
    sinks.write_fai(regions.fai_of_file(spark, path), table)
    f = F.split("value", "\t")
    return spark.read.text(table).select(f[0].alias("name"), *[f[i].cast("long").alias(c) for i, c in enumerate(("length", "offset", "linebases", "linewidth"), 1)])


@query("text_round_trip", f"WITH {q.READS} SELECT upper(s) || ' ' || id AS line FROM reads")
def text_round_trip(spark, sf_dir):
    path = folder(spark, "text")
    sinks.write_text(q.reads(spark, sf_dir).select(ORD, F.concat(F.upper("sequence"), F.lit(" "), "id").alias("v")), "v", path, "gzip")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("collected", f"WITH {q.READS} SELECT id, s AS sequence, (SELECT count(*) FROM reads) AS records FROM reads ORDER BY o LIMIT 12")
def collected(spark, sf_dir):
    """Records on the driver, by the fluent form, and their number."""
    frame = SeqFrame(q.reads(spark, sf_dir))
    n = frame.count()
    return spark.createDataFrame([(r["id"], r["sequence"], n) for r in frame.head(12).collect()], "id string, sequence string, records long")


@query("json_metadata", f"WITH {q.READS} SELECT count(*) AS n, 'id,sequence,length' AS columns FROM reads")
def json_metadata(spark, sf_dir):
    m = sinks.collection_metadata(tabular.to_tabular(q.reads(spark, sf_dir), ["id", "sequence", "length"]))
    return spark.createDataFrame([(m["count"], ",".join(m["columns"]))], "n long, columns string")
