"""Guessing formats, delimiters, headers and compression from the first bytes, on the driver."""

from __future__ import annotations

import csv
import json
import os
import re
from statistics import fmean, pvariance

# Fixed names that head columns of sequence tables.
HEADER_NAMES = frozenset("id name seq sequence qual quality chr chrom chromosome pos position ref alt gene expression".split())
#: Delimiters tried.
DELIMITERS = ",\t|;"


def detect_format(text: str) -> tuple[str, float]:
    """(format, confidence) of fasta, fastq, bed, sam or unknown."""
    t = text.strip()
    lines = t.splitlines()
    if t.startswith(">"):
        return "fasta", 0.95
    if t.startswith("@") and len(lines) >= 4 and lines[2].startswith("+"):
        return "fastq", 0.95
    data = [x.split() for x in lines if x.strip() and not x.strip().startswith(("#", "track", "browser"))]
    if data and len(data[0]) >= 3 and re.match(r"\d", data[0][1]) and re.match(r"\d", data[0][2]):
        a, b = (int(re.match(r"\d+", x)[0]) for x in data[0][1:3])
        if b > a:
            return "bed", 0.8
    if "\t" in t and ("@SQ" in t or "@HD" in t or any(x.count("\t") >= 10 for x in lines)):
        return "sam", 0.7
    return "unknown", 0.0


def parse_any(spark, text: str):
    """Records of in-memory FASTA or FASTQ; other formats raise."""
    from seqloom.schema import ParseError
    from seqloom.sources.readers import parse_fasta, parse_fastq

    kind, _ = detect_format(text)
    if kind == "fasta":
        return parse_fasta(spark, text)
    if kind == "fastq":
        return parse_fastq(spark, text)
    raise ParseError(f"cannot parse format {kind}")


def _fields(line: str, delimiter: str) -> list[str]:
    return next(csv.reader([line], delimiter=delimiter), [])


def detect_delimiter(text: str, candidates: str = DELIMITERS) -> str | None:
    """The delimiter that splits lines into many fields and always as many."""
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    best, top = None, 0.0
    for d in candidates:
        counts = [n for n in (len(_fields(x, d)) - 1 for x in lines) if n > 0]
        if not counts:
            continue
        steady = sum(a == counts[0] for a in counts[1:])
        score = steady * fmean(counts) / (1 + pvariance(counts))
        if score > top:
            best, top = d, score
    return best


def _number(x: str) -> bool:
    try:
        float(x)
    except ValueError:
        return not x.strip()
    return True


def detect_headers(lines: list[str], delimiter: str) -> bool:
    """Whether the first line names the columns."""
    if len(lines) < 2:
        return False
    first, second = _fields(lines[0], delimiter), _fields(lines[1], delimiter)
    if len(first) == 1 and len(second) == 1:
        return first[0].lower() in HEADER_NAMES
    if not all(x.lower() in HEADER_NAMES or not _number(x) for x in first):
        return False
    known = sum(x.lower() in HEADER_NAMES for x in first)
    return known > 0 or sum(map(_number, second)) > sum(map(_number, first))


def extract_headers(line: str, delimiter: str = ",") -> list[str]:
    return [x.strip() for x in _fields(remove_bom(line), delimiter)]


def sniff(text: str) -> dict:
    """delimiter, header and columns of delimited text."""
    d = detect_delimiter(text) or ","
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    return {"delimiter": d, "has_header": detect_headers(lines, d), "columns": len(_fields(lines[0], d)) if lines else 0}


def count_columns(line: str, delimiter: str) -> int:
    return len(_fields(line, delimiter))


def remove_bom(text: str) -> str:
    return text.removeprefix("﻿")


def normalize_line_endings(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def handle_ragged(row: list[str], width: int, policy: str = "error") -> list[str] | None:
    """A row as wide as asked: error, pad, truncate, or ignore (None)."""
    if len(row) == width:
        return row
    if policy == "pad":
        return row + [""] * (width - len(row)) if len(row) < width else row
    if policy == "truncate":
        return row[:width]
    if policy == "ignore":
        return None
    from seqloom.schema import ParseError

    raise ParseError(f"{len(row)} fields instead of {width}")


def validate_dsv(text: str, delimiter: str | None = None) -> dict:
    """valid, rows, columns and the first ragged line."""
    d = delimiter or detect_delimiter(text) or ","
    widths = [len(_fields(x, d)) for x in text.splitlines() if x.strip()]
    bad = next((i + 1 for i, n in enumerate(widths) if n != widths[0]), None)
    return {"valid": bad is None, "rows": len(widths), "columns": widths[0] if widths else 0, "ragged_line": bad}


def detect_json(text: str) -> str:
    """array, wrapped, lines or unknown."""
    t = text.strip()
    if t.startswith("["):
        return "array"
    try:
        whole = json.loads(t)
    except ValueError:
        lines = t.splitlines()
        try:
            return "lines" if lines and all(isinstance(json.loads(x), dict) for x in lines[:10] if x.strip()) else "unknown"
        except ValueError:
            return "unknown"
    return "wrapped" if isinstance(whole, dict) and "sequences" in whole else "lines" if isinstance(whole, dict) else "unknown"


def detect_gtf(text: str) -> bool:
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")][:10]
    return bool(lines) and all(len(f := x.split("\t")) == 9 and f[3].isdigit() and f[4].isdigit() and f[6] in "+-." for x in lines)


def detect_bed(text: str) -> bool:
    return detect_format(text)[0] == "bed"


def compression_of(path: str | None = None, head: bytes = b"") -> str:
    """gzip, zstd or none: the first bytes decide, then the extension."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd"
    if head or not path:
        return "none"
    return {".gz": "gzip", ".gzip": "gzip", ".bgz": "gzip", ".zst": "zstd", ".zstd": "zstd"}.get(os.path.splitext(path)[1].lower(), "none")


def checked_path(path: str) -> str:
    """Refuses paths that climb or hold NUL."""
    from seqloom.schema import require

    require(bool(path) and "\0" not in path and ".." not in path.split("/"), f"path {path!r} is not allowed")
    return path


def file_metadata(spark, path: str) -> dict:
    """exists, size and modification time of a file in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(checked_path(path))
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return {"exists": False}
    s = fs.getFileStatus(p)
    return {"exists": True, "size": s.getLen(), "modified_ms": s.getModificationTime()}


def read_bytes(spark, path: str, start: int = 0, length: int | None = None) -> bytes:
    """A range of bytes of one file."""
    if start == 0 and length is None:
        return bytes(spark.read.format("binaryFile").load(checked_path(path)).select("content").first()[0])
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(checked_path(path))
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        stream.seek(start)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, length)))
    finally:
        stream.close()
