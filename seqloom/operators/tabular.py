"""Records as tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import bases, hashing, quality
from seqloom.operators.ranking import with_rank
from seqloom.schema import ORD, require

DEFAULT_COLUMNS = ("id", "sequence", "length")
WHOLE = ("length", "index", "line_number", "min_qual", "max_qual")
# Fixed patterns: what spreadsheets turn into dates, numbers or formulas.
SPREADSHEET = (
    r"^(?i:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|SEPT|OCT|NOV|DEC)\d+$",
    r"^(?i:JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER)\d+$",
    r"^0+[0-9A-Za-z]",
    r"^\d{16,}$",
    r"^[=+\-@]",
)


def spreadsheet_safe(field: str | Column, patterns: tuple[str, ...] = SPREADSHEET) -> Column:
    """The field in quotes if a spreadsheet would change it."""
    c = F.col(field) if isinstance(field, str) else field
    risky = F.lit(False)
    for p in patterns:
        risky = risky | F.rlike(c, F.lit(p))
    return F.when(risky, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)


def column(name: str, case_sensitive: bool = False, encoding: str = "phred33", have: tuple[str, ...] = ()) -> Column:
    """The expression of a table column by name."""
    has_quality = "quality" in have
    if name.startswith("base_content_"):
        return bases.base_content("sequence", name[13:], case_sensitive)
    if name.startswith("base_count_"):
        return bases.base_count("sequence", name[11:], case_sensitive).cast("long")
    none = F.lit(None)
    known = {
        "id": lambda: F.col("id"),
        "sequence": lambda: F.col("sequence"),
        "length": lambda: F.length("sequence"),
        "description": lambda: F.nullif("description", F.lit("")) if "description" in have else none.cast("string"),
        "quality": lambda: F.nullif("quality", F.lit("")) if has_quality else none.cast("string"),
        "gc": lambda: bases.gc_content("sequence"),
        "at": lambda: bases.at_content("sequence"),
        "gc_skew": lambda: bases.gc_skew("sequence"),
        "at_skew": lambda: bases.at_skew("sequence"),
        "entropy": lambda: bases.shannon_entropy("sequence"),
        "complexity": lambda: bases.complexity("sequence"),
        "alphabet": lambda: bases.kernel_alphabet("sequence"),
        "seq_hash": lambda: hashing.md5("sequence", case_sensitive),
        "avg_qual": lambda: F.when(F.col("quality").isNotNull(), quality.average("quality", encoding)) if has_quality else none.cast("double"),
        "min_qual": lambda: F.when(F.col("quality").isNotNull(), quality.minimum("quality", encoding)) if has_quality else none.cast("int"),
        "max_qual": lambda: F.when(F.col("quality").isNotNull(), quality.maximum("quality", encoding)) if has_quality else none.cast("int"),
        "index": lambda: F.col("_rank") - 1,
        "line_number": lambda: F.when(F.col("line_number") > 0, F.col("line_number")) if "line_number" in have else none.cast("long"),
    }
    require(name in known, f"unknown column {name!r}")
    return known[name]()


def to_tabular(df: DataFrame, columns: list[str] | None = None, custom: dict[str, Column] | None = None, case_sensitive: bool = False, encoding: str = "phred33") -> DataFrame:
    """The table of these columns, typed, with _ord. Only what is asked for is computed."""
    names = list(columns or DEFAULT_COLUMNS)
    if "index" in names:
        df = with_rank(df, "_rank")
    made = [column(n, case_sensitive, encoding, tuple(df.columns)).alias(n) for n in names]
    return df.select(ORD, *made, *[c.alias(n) for n, c in (custom or {}).items()])


def as_text(table: DataFrame, precision: int = 2, null_value: str = "", excel_safe: bool = False) -> DataFrame:
    """All columns as strings for text output: whole numbers plain, others with fixed decimals."""
    out = []
    for name, kind in table.dtypes:
        if name == ORD:
            out.append(F.col(ORD))
            continue
        c = F.col(name)
        if kind in ("double", "float") and name not in WHOLE and not name.startswith("base_count_"):
            c = F.format_string(f"%.{precision}f", c.cast("double"))
        c = F.when(F.col(name).isNull(), F.lit(null_value)).otherwise(c.cast("string"))
        out.append((spreadsheet_safe(c) if excel_safe else c).alias(name))
    return table.select(*out)


def from_tabular(table: DataFrame, fmt: str | None = None, encoding: str = "phred33") -> DataFrame:
    """Records from rows with id and sequence; FASTQ where there is a quality unless fmt says otherwise."""
    from seqloom.schema import conform

    require("id" in table.columns and "sequence" in table.columns, "rows take id and sequence")
    missing = F.col("id").isNull() | F.col("sequence").isNull()
    rows = table.withColumn("id", F.when(missing, F.raise_error(F.lit("a row lacks id or sequence"))).otherwise(F.col("id").cast("string")))
    out = conform(rows)
    if fmt == "fasta":
        return out.withColumns({"format": F.lit("fasta"), "quality": F.lit(None).cast("string")})
    if "quality" in table.columns:
        out = out.withColumn("quality_encoding", F.when(F.col("quality").isNotNull(), F.coalesce("quality_encoding", F.lit(encoding))))
    return out if fmt is None else out.withColumn("format", F.lit(fmt))
