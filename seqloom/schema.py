"""The record schema that every source returns and every operator takes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stable stream order. Order-sensitive operators take it as their sort key.
ORD = "_ord"

SEQ_SCHEMA = T.StructType(
    [
        T.StructField(ORD, T.LongType(), False),
        T.StructField("format", T.StringType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("sequence", T.StringType(), False),
        T.StructField("length", T.IntegerType(), False),
        T.StructField("quality", T.StringType()),
        T.StructField("quality_encoding", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("reference_sequence", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("mapping_quality", T.IntegerType()),
        T.StructField("cigar", T.StringType()),
    ]
)


class SeqError(ValueError):
    """Wrong options or input."""


class ParseError(SeqError):
    """Input that is not in its format."""


class PairSyncError(SeqError):
    """Paired inputs that do not belong together."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise SeqError(message)


def conform(df: DataFrame) -> DataFrame:
    """df with all columns of SEQ_SCHEMA (missing ones null, length from the sequence, format from
    quality) and its own further columns after them."""
    have = set(df.columns)
    made = {"length": F.length("sequence"), "format": F.when(F.col("quality").isNotNull(), "fastq").otherwise("fasta") if "quality" in have else F.lit("fasta")}
    columns = []
    for f in SEQ_SCHEMA:
        if f.name in have and f.name != "length":
            c = F.col(f.name)
        else:
            c = made.get(f.name, F.monotonically_increasing_id() if f.name == ORD else F.lit(None))
        columns.append(c.cast(f.dataType).alias(f.name))
    return df.select(*columns, *[c for c in df.columns if c not in SEQ_SCHEMA.fieldNames()])


def with_sequence(df: DataFrame, sequence, quality=None) -> DataFrame:
    """Replaces the sequence (and quality) and keeps length in step."""
    changes = {"sequence": sequence}
    if quality is not None:
        changes["quality"] = quality
    return df.withColumns(changes).withColumn("length", F.length("sequence"))
