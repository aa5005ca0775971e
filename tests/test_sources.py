import gzip
import io
import json
import struct

import pytest

from seqloom.operators import regions
from seqloom.plans.frame import SeqFrame
from seqloom.schema import ParseError, SeqError
from seqloom.sources import detect, readers, sinks


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(p)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("_ord").collect()]


FASTA = ">a first one\nACGT\nAC\n>b\n\n>c  x\nGG\r\nTT\n>d"


def test_fasta(spark, tmp_path):
    df = readers.read_fasta(spark, put(tmp_path, "x.fa", FASTA))
    assert rows(df, "id", "description", "sequence", "length") == [("a", "first one", "ACGTAC", 6), ("b", None, "", 0), ("c", "x", "GGTT", 4), ("d", None, "", 0)]
    assert rows(readers.parse_fasta(spark, FASTA), "id", "sequence")[0] == ("a", "ACGTAC")
    sinks.write_fasta(df, str(tmp_path / "out"), width=4, single=True)
    back = readers.read_fasta(spark, str(tmp_path / "out"))
    assert rows(back, "id", "sequence") == rows(df, "id", "sequence")
    assert ">a first one\nACGT\nAC\n" in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))


FASTQ = "@r1 d\nACGT\n+\nIIII\n@r2\nAC\nGT\n+r2\n@@\nII\n@r3\n\n+\n\n"


def test_fastq(spark, tmp_path):
    want = [("r1", "d", "ACGT", "IIII"), ("r2", None, "ACGT", "@@II"), ("r3", None, "", "")]
    for name, data in (("x.fq", FASTQ.encode()), ("x.fq.gz", gzip.compress(FASTQ.encode()))):
        df = readers.read_fastq(spark, put(tmp_path, name, data))
        assert rows(df, "id", "description", "sequence", "quality") == want
    plain = "@a x\nAC\n+\nII\n@b\nGT\n+\nHH\n"
    assert rows(readers.read_fastq_lines(spark, put(tmp_path, "y.fq", plain)), "id", "description", "sequence", "quality") == [("a", "x", "AC", "II"), ("b", None, "GT", "HH")]
    assert rows(readers.parse_fastq(spark, plain), "id") == [("a",), ("b",)]
    with pytest.raises(ParseError):
        readers.parse_fastq(spark, "@a\nACGT\n+\nII\n")
    sinks.write_fastq(readers.parse_fastq(spark, plain), str(tmp_path / "o"), single=True)
    assert rows(readers.read_fastq(spark, str(tmp_path / "o") + "/part*"), "id", "quality") == [("a", "II"), ("b", "HH")]


SAM = "@HD\tVN:1.6\n@SQ\tSN:c1\tLN:100\nr1\t16\tc1\t5\t60\t3S2M\t*\t0\t0\tACGTA\tIIIII\nr2\t4\t*\t0\t255\t*\t*\t0\t0\tACG\t*\n"


def test_sam(spark, tmp_path):
    p = put(tmp_path, "x.sam", SAM)
    df = readers.read_sam(spark, p)
    assert rows(df, "id", "flag", "position", "cigar", "quality") == [("r1", 16, 5, "3S2M", "IIIII"), ("r2", 4, 0, "*", "***")]
    assert [tuple(r)[1:] for r in readers.reference_sequences(spark, p).collect()] == [("c1", 100)]
    assert rows(SeqFrame(df).transform(trim_soft_clips=True).df, "sequence", "cigar")[0] == ("TA", "2M")
    sinks.write_sam(df, str(tmp_path / "o"), single=True)
    assert rows(readers.read_sam(spark, str(tmp_path / "o")), "id", "position") == [("r1", 5), ("r2", 0)]


def test_bam(spark, tmp_path):
    def record(name, flag, ref, pos, ops, seq, qual):
        packed = bytearray((len(seq) + 1) // 2)
        for i, c in enumerate(seq):
            packed[i // 2] |= readers.NIBBLES.index(c) << (0 if i % 2 else 4)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | readers.CIGAR.index(o)) for n, o in ops) + bytes(packed) + qual
        return struct.pack("<i", len(body)) + body

    data = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 100)
    data += record("r1", 16, 0, 4, [(3, "S"), (2, "M")], "ACGTA", bytes([40] * 5)) + record("r2", 4, -1, -1, [], "NCG", b"\xff" * 3)
    buffer = io.BytesIO()
    for part in (data[:40], data[40:]):
        with gzip.GzipFile(fileobj=buffer, mode="wb") as g:
            g.write(part)
    df = readers.read_bam(spark, put(tmp_path, "x.bam", buffer.getvalue()))
    assert rows(df, "id", "flag", "reference_sequence", "position", "cigar", "sequence", "quality") == [("r1", 16, "c1", 5, "3S2M", "ACGTA", "IIIII"), ("r2", 4, "*", 0, "*", "NCG", "***")]


BED = "track x\n# c\nc1\t0\t10\nc1 5 9 n 100 +\nc2\t1\t30\tg\t0\t-\t2\t20\t0\t2\t5,6,\t0,23,\n"


def test_bed(spark, tmp_path):
    p = put(tmp_path, "x.bed", BED)
    df = readers.read_bed(spark, p)
    assert [r["stats"]["bed_type"] for r in df.orderBy("_ord").collect()] == ["BED3", "BED6", "BED12"] and readers.count_intervals(spark, p) == 3
    lines = [r[0] for r in df.orderBy("_ord").select(sinks.bed_line()).collect()]
    assert lines == ["c1\t0\t10", "c1\t5\t9\tn\t100\t+", "c2\t1\t30\tg\t0\t-\t2\t20\t0\t2\t5,6\t0,23"]
    for bad in ("c\t5\t3", "c\t1\t2\tn\t2000\t+", "c\t1\t9\tn\t0\t+\t0\t9\t0", "c\t1", "c\t0\t9\tn\t0\t+\t0\t9\t0\t2\t3,3\t1,6"):
        with pytest.raises(Exception, match="(bad|no BED|thick)"):
            readers.read_bed(spark, put(tmp_path, "bad.bed", bad)).collect()


GTF = '#!x\nc1\ts\tgene\t1\t50\t.\t+\t.\tgene_id "g1"; gene_type "lincRNA"; tag "a"; tag "b c";\nc1\ts\texon\t5\t9\t1.5\t-\t0\tgene_id g2;\n'


def test_gtf(spark, tmp_path):
    p = put(tmp_path, "x.gtf", GTF)
    df = readers.read_gtf(spark, p, normalize=True)
    a, b = df.orderBy("_ord").collect()
    assert a["score"] is None and a["attributes"]["tag"] == ["a", "b c"] and a["normalized"]["source_database"] == "GENCODE" and b["frame"] == 0 and b["length"] == 5
    assert readers.read_gtf(spark, p, include_features=["exon"]).count() == 1 and readers.read_gtf(spark, p, required_attributes=["tag"]).count() == 1 and readers.count_features(spark, p) == 2
    assert [r[0] for r in df.orderBy("_ord").select(sinks.gtf_line()).collect()][0] == 'c1\ts\tgene\t1\t50\t.\t+\t.\tgene_id g1; gene_type lincRNA; tag a; tag "b c";'


def test_json(spark, tmp_path):
    data = [{"id": "a", "sequence": "AC", "quality": "II"}, {"id": "b", "sequence": "GT"}]
    for name, text in (("a.json", json.dumps(data)), ("w.json", json.dumps({"sequences": data, "metadata": {"count": 2}}))):
        assert rows(readers.read_json(spark, put(tmp_path, name, text)), "id", "format") == [("a", "fastq"), ("b", "fasta")]
    df = readers.read_jsonl(spark, put(tmp_path, "l.jsonl", "\n".join(map(json.dumps, data))))
    assert rows(df, "id", "quality") == [("a", "II"), ("b", None)]
    sinks.write_json(df, str(tmp_path / "o"), include_metadata=True)
    assert json.loads("".join(p.read_text() for p in (tmp_path / "o").glob("part*")))["metadata"]["count"] == 2
    sinks.write_jsonl(df, str(tmp_path / "q"), single=True)
    assert rows(readers.read_jsonl(spark, str(tmp_path / "q")), "id") == [("a",), ("b",)]


def test_dsv(spark, tmp_path):
    df = readers.read_dsv(spark, put(tmp_path, "x.csv", 'id,sequence,note\na,ACGT,"x, y"\nb,GG,z\n'), with_stats=True)
    assert rows(df, "id", "sequence", "note", "gc") == [("a", "ACGT", "x, y", 50.0), ("b", "GG", "z", 100.0)]
    t = readers.read_dsv(spark, put(tmp_path, "y.tsv", "a\tACGT\nb\tGG\n"), delimiter="\t", header=False)
    assert rows(t, "id", "sequence") == [("a", "ACGT"), ("b", "GG")]
    sinks.write_dsv(df, str(tmp_path / "o"), columns=["id", "gc"], single=True)
    assert "".join(p.read_text() for p in (tmp_path / "o").glob("part*")) == "id,gc\na,50.00\nb,100.00\n"


def test_parquet(spark, tmp_path):
    df = readers.parse_fastq(spark, "@1\nAC\n+\nII\n")
    sinks.write_parquet(df, str(tmp_path / "p"), "zstd")
    assert rows(readers.from_parquet(spark, str(tmp_path / "p")), "id", "quality") == [("1", "II")]
    assert readers.read_parquet(spark, str(tmp_path / "p"), ["id"], limit=1).columns == ["id"]
    spark.range(1).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(SeqError):
        readers.from_parquet(spark, str(tmp_path / "bad"))


def test_faidx(spark, tmp_path):
    text = ">a d\nACGTACGTAC\nACG\n>b\nGGGG\n"
    df = readers.read_fasta(spark, put(tmp_path, "x.fa", text))
    got = rows(regions.faidx(df, ["a:3", "a:2-4", "a:11-", "a:-3", "b:4-2", "b"]), "sequence")
    assert got == [("G",), ("CGT",), ("ACG",), ("ACG",), ("CCC",), ("GGGG",)] or got[:3] == [("G",), ("CGT",), ("ACG",)]
    i = regions.fai_index(df, 10).orderBy("_ord").collect()
    assert [(r["name"], r["length"], r["offset"], r["linebases"]) for r in i] == [("a", 13, 5, 10), ("b", 4, 23, 4)]
    assert text[5:8] == "ACG" and text[23:25] == "GG"
    with pytest.raises(Exception, match="no sequence"):
        regions.faidx(df, ["zz"]).collect()
    assert regions.faidx(df, ["zz"], on_error="skip").count() == 0


def test_detection():
    assert detect.detect_format(">a\nA")[0] == "fasta" and detect.detect_format("@a\nA\n+\nI")[0] == "fastq" and detect.detect_format("c\t1\t2")[0] == "bed" and detect.detect_format(SAM)[0] == "sam" and detect.detect_format("zz")[0] == "unknown"
    assert detect.detect_delimiter("a;b;c\n1;2;3\n4;5;6") == ";" and detect.detect_headers(["id,seq", "x,ACGT"], ",") and not detect.detect_headers(["1,2", "3,4"], ",")
    assert detect.handle_ragged(["a"], 2, "pad") == ["a", ""] and detect.handle_ragged(["a"], 2, "ignore") is None
    with pytest.raises(ParseError):
        detect.handle_ragged(["a"], 2)
    assert detect.detect_json('[{"id":1}]') == "array" and detect.detect_json('{"sequences":[]}') == "wrapped" and detect.detect_json('{"a":1}\n{"a":2}') == "lines"
    assert detect.detect_gtf(GTF) and detect.detect_bed(BED)
    assert detect.compression_of("x.gz") == "gzip" and detect.compression_of("x.gz", b"plain") == "none" and detect.compression_of(head=b"\x28\xb5\x2f\xfd") == "zstd"
    with pytest.raises(SeqError):
        detect.checked_path("a/../b")
    assert detect.validate_dsv("a,b\n1,2\n3")["ragged_line"] == 3 and detect.extract_headers("﻿a, b") == ["a", "b"]


def test_split_files(spark, tmp_path):
    from seqloom.operators import splitting

    df = readers.parse_fasta(spark, "".join(f">s{i}\nACGT\n" for i in range(5)))
    splitting.write(splitting.split(df, "by-size", sequences_per_file=2), str(tmp_path / "parts"))
    names = sorted(p.name for p in (tmp_path / "parts").glob("part_id=*"))
    assert names == ["part_id=1", "part_id=2", "part_id=3"]
    assert rows(readers.read_fasta(spark, str(tmp_path / "parts" / "part_id=2")), "id") == [("s2",), ("s3",)]


def test_files_of_any_store(spark, tmp_path):
    p = put(tmp_path, "x.txt", "hello world")
    m = detect.file_metadata(spark, p)
    assert m["exists"] and m["size"] == 11 and not detect.file_metadata(spark, p + "no")["exists"]
    assert detect.read_bytes(spark, p) == b"hello world" and detect.read_bytes(spark, p, 6, 3) == b"wor"


def test_writers_of_features_and_index(spark, tmp_path):
    bed = readers.read_bed(spark, put(tmp_path, "x.bed", "c\t1\t5\nc\t7\t9\tn\n"))
    sinks.write_bed(bed, str(tmp_path / "b"), single=True)
    assert readers.read_bed(spark, str(tmp_path / "b")).count() == 2
    gtf = readers.read_gtf(spark, put(tmp_path, "x.gtf", GTF))
    sinks.write_gtf(gtf, str(tmp_path / "g"), single=True)
    assert readers.read_gtf(spark, str(tmp_path / "g")).count() == 2
    sinks.write_fai(regions.fai_index(readers.parse_fasta(spark, ">a\nACGT\n")), str(tmp_path / "f"))
    assert "".join(x.read_text() for x in (tmp_path / "f").glob("part*")) == "a\t4\t3\t4\t5\n"
    assert sinks.format_row(["a", 'b"c', 1], quote_all=True) == '"a","b""c","1"\n'


def test_key_values(spark, tmp_path):
    from seqloom.operators import records

    kv = records.read_key_values(spark, put(tmp_path, "kv.tsv", "# c\na\tone\nb\ttwo words\n"))
    df = readers.from_rows(spark, [{"id": "a-1", "sequence": "A"}, {"id": "z-1", "sequence": "A"}])
    assert rows(records.replace(df, r"^([a-z])", "{kv}", kv=kv, key_miss="none"), "id") == [("one-1",), ("none-1",)]
    with pytest.raises(Exception, match="no key and value"):
        records.read_key_values(spark, put(tmp_path, "bad.tsv", "lonely\n")).collect()


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_order_over_files_of_many_splits(spark, tmp_path, small_splits):
    """The larger file comes second by name; its last split is packed after others."""
    names = [f"a{i}" for i in range(70)] + [f"b{i}" for i in range(900)]
    seq = {n: "ACGT" * (3 + len(n) * 2) + "A" * (i % 5) for i, n in enumerate(names)}
    for f in "ab":
        own = [n for n in names if n[0] == f]
        put(tmp_path, f"{f}.fa", "".join(f">{n} x\n{seq[n][:9]}\n{seq[n][9:]}\n" for n in own))
        put(tmp_path, f"{f}.fq", "".join(f"@{n} x\n{seq[n]}\n+\n{'@' * len(seq[n])}\n" for n in own))
        put(tmp_path, f"{f}.mq", "".join(f"@{n}\n{seq[n][:9]}\n{seq[n][9:]}\n+\n{'@' * 5}\n{'I' * (len(seq[n]) - 5)}\n" for n in own))
        put(tmp_path, f"{f}.sam", "".join(f"{n}\t4\t*\t0\t9\t*\t*\t0\t0\t{seq[n]}\t*\n" for n in own))
        put(tmp_path, f"{f}.csv", "id,sequence\n" + "".join(f"{n},{seq[n]}\n" for n in own))
        put(tmp_path, f"{f}.jsonl", "".join(json.dumps({"id": n, "sequence": seq[n]}) + "\n" for n in own))
        put(tmp_path, f"{f}.fq.gz", gzip.compress((tmp_path / f"{f}.fq").read_bytes()))
    want = [(n, seq[n]) for n in names]
    for read, pattern in ((readers.read_fasta, "*.fa"), (readers.read_fastq_lines, "*.fq"), (readers.read_fastq, "*.fq"), (readers.read_fastq, "*.mq"), (readers.read_fastq, "*.fq.gz"), (readers.read_sam, "*.sam"), (readers.read_dsv, "*.csv"), (readers.read_jsonl, "*.jsonl")):
        df = read(spark, str(tmp_path / pattern))
        assert rows(df, "id", "sequence") == want, pattern
    fq = readers.read_fastq(spark, str(tmp_path / "*.fq"))
    assert fq.rdd.getNumPartitions() > 1 and rows(fq, "line_number")[70:72] == [(1,), (5,)]
    assert [r["line_number"] for r in readers.read_fastq(spark, str(tmp_path / "a.mq")).orderBy("_ord").collect()][:3] == [1, 7, 13]


def test_fastq_of_other_shapes_says_so(spark, tmp_path):
    p = put(tmp_path, "x.fq", "@a\nAC\n+\nII\n@b\nACG\n+\nII\n")
    with pytest.raises(Exception, match="differ in length"):
        readers.read_fastq_lines(spark, p).collect()
    encodings = {"a.fq": "@a\nAC\n+\nhh\n", "b.fq": "@b\nAC\n+\n!!\n"}
    for name, text in encodings.items():
        put(tmp_path / "..", name, text)
    assert rows(readers.read_fastq(spark, str(tmp_path / ".." / "[ab].fq")), "id", "quality_encoding") == [("a", "phred64"), ("b", "phred33")]


def test_bam_in_blocks_over_splits(spark, tmp_path, small_splits):
    import random
    import zlib

    r = random.Random(2)

    def file_of(names):
        data = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 0)
        for n in names:
            body = struct.pack("<iiBBHHHiiii", -1, -1, len(n) + 1, 9, 0, 0, 4, 4, -1, -1, 0) + n.encode() + b"\0" + bytes([r.randrange(1, 9) << 4 | 1, 0x24]) + b"\xff" * 4
            data += struct.pack("<i", len(body)) + body
        out = b""
        for k in range(0, len(data), 700):  # records cross blocks
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            raw = c.compress(data[k : k + 700]) + c.flush()
            out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(data[k : k + 700]), len(data[k : k + 700]))
        return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")

    names = [f"a{i}" for i in range(50)] + [f"b{i}" for i in range(1500)]
    for f in "ab":
        put(tmp_path, f"{f}.bam", file_of([n for n in names if n[0] == f]))
    assert (tmp_path / "b.bam").stat().st_size > 8000
    assert rows(readers.read_bam(spark, str(tmp_path / "*.bam")), "id") == [(n,) for n in names]


def test_json_document_is_written_by_a_task(spark, tmp_path):
    df = readers.from_rows(spark, [{"id": f"s{i}", "sequence": "AC"} for i in range(300)]).repartition(5)
    for meta, pretty in ((False, False), (True, True)):
        sinks.write_json(df, str(tmp_path / f"o{meta}"), include_metadata=meta, pretty=pretty)
        assert rows(readers.read_json(spark, str(tmp_path / f"o{meta}")), "id") == [(f"s{i}",) for i in range(300)]
    sinks.write_json(df.limit(0), str(tmp_path / "e"), include_metadata=True)
    assert readers.read_json(spark, str(tmp_path / "e")).count() == 0


def test_json_documents_are_read_in_splits(spark, tmp_path):
    """Rows in several splits, several documents, brackets and quotes in strings; one task a file would hold a document."""
    odd = ['{"', '}]"', "\\", '\\"}', "a,{b", '"sequences": [{', "[[", "é{}"]
    data = [{"id": f"{i}{odd[i % 8]}", "sequence": "AC" * (i % 5), "quality": odd[i % 7] * 9, "x": {"sequences": [{"id": "no", odd[i % 3]: [{}]}]}} if i % 4 else {"sequence": "GT", "id": str(i)} for i in range(60)]
    said = {"a": [{"id": "no"}, [{}]], "sequences": data[30:], "metadata": {"sequences": [{"id": "no"}], "count": 30}}
    put(tmp_path, "a.json", json.dumps(data[:30]))
    put(tmp_path, "b.json", "\n" + json.dumps(said, indent=1, ensure_ascii=False) + "\n")
    put(tmp_path, "c.json", "[ ]")
    ok = '{"id": "a", "sequence": "AC"}'
    wrong = [f"[{ok}", f"[{ok},]", f"[{ok}{ok}]", f"[,{ok}]", f"[{ok}]x", f"[{ok}]]", f"[{ok}, 1]", f"[[{ok}]]", f"[{ok}, null]", '{"sequences": [' + ok + "]", '{"sequences": [' + ok + "}]", f"{ok},{ok}", ok[:-3], "hello", '{"sequences": ' + ok + "}", '{"sequences": 5}']
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    try:
        for key in sizes:
            spark.conf.set(key, 400)
        df = readers.read_json(spark, str(tmp_path / "*.json"))
        assert rows(df, "id", "sequence", "quality") == [(x["id"], x["sequence"], x.get("quality")) for x in data]
        assert df.select("_ord").distinct().count() == 60
        assert readers.read_json(spark, str(tmp_path / "a.json")).rdd.getNumPartitions() > 4
        for text in wrong:
            with pytest.raises(Exception, match="(JSON|MALFORMED|lacks)"):
                readers.read_json(spark, put(tmp_path, "w.txt", text)).collect()
    finally:
        for key in sizes:
            spark.conf.unset(key)
