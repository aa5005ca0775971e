"""Statistics of a stream, from sums and a histogram of lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import bases, quality


def length_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(F.length("sequence").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def nx_and_quartiles(df: DataFrame, xs: tuple[int, ...] = (50, 90)) -> DataFrame:
    """One row: n<x> for each x, q1_length, q2_length, q3_length. The histogram has a row for each
    different length, so the windows over it are small however many records there are."""
    return cumulated(length_histogram(df)).agg(*nx_columns(xs))


def cumulated(h: DataFrame) -> DataFrame:
    """A histogram (length, n, ...) with running sums."""
    up, down = W.orderBy("length"), W.orderBy(F.col("length").desc())
    everything = up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return h.select(
        "*",
        F.sum("n").over(up).alias("upto"),
        F.sum("n").over(everything).alias("total"),
        F.sum(F.col("length") * F.col("n")).over(down).alias("covered"),
        F.sum(F.col("length") * F.col("n")).over(everything).alias("bases"),
    )


def nx_columns(xs: tuple[int, ...] = (50, 90)) -> list[Column]:
    nx = [F.max(F.when(F.col("covered") >= F.col("bases") * x / 100.0, F.col("length"))).alias(f"n{x}") for x in xs]
    return nx + [F.min(F.when(F.col("upto") > F.floor(F.col("total") * q), F.col("length"))).alias(f"q{i}_length") for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))]


def calculate_nx(df: DataFrame, x: int) -> int | None:
    return nx_and_quartiles(df, (x,)).first()[f"n{x}"]


def stats(df: DataFrame, detailed: bool = False, include_quality: bool = True, include_composition: bool = False, gap_chars: str = ".-*", encoding: str = "phred33", file_name: str | None = None) -> DataFrame:
    """One row: format, type, num_sequences, total_length, min_, max_ and avg_length, gc_content (a
    fraction), gap_count, ambiguous_count; detailed adds n50, n90 and quartiles of lengths; qualities add
    their mean, range, Q20 and Q30 percentages and mean error rate."""
    n, zero, no = F.length("sequence"), F.lit(0), F.lit(False)
    has = F.col("quality").isNotNull() if "quality" in df.columns else no
    measured = {
        "_gc": (F.sum, bases.count_of("sequence", "GC")),
        "_at": (F.sum, bases.count_of("sequence", "ATU")),
        "_gap": (F.sum, bases.count_of("sequence", gap_chars)),
        "_ambiguous": (F.sum, bases.count_of("sequence", "NRYSWKMBDHV")),
        "_protein": (F.bool_or, F.rlike("sequence", F.lit("[EFILPQefilpq]"))),
        "_rna": (F.bool_or, F.rlike("sequence", F.lit("[Uu]"))),
        "_fastq": (F.bool_or, has),
        "_fasta": (F.bool_or, ~has),
    }
    with_quality = include_quality and "quality" in df.columns
    if with_quality:
        df = df.withColumn("_m", quality.measures("quality", encoding))
        some, m = F.length("quality") > 0, F.col("_m")
        measured |= {"_q": (F.sum, F.when(has, m["total"])), "_qn": (F.sum, F.length("quality")), "min_quality": (F.min, F.when(some, m["min"])), "max_quality": (F.max, F.when(some, m["max"]))}
        measured |= {"_q20": (F.sum, F.when(has, m["q20"])), "_q30": (F.sum, F.when(has, m["q30"])), "_err": (F.sum, F.when(has, m["err"]))}
    # one pass: all measures by length, and everything else from that small table
    by_length = df.groupBy(n.cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"), *[how(c).alias(name) for name, (how, c) in measured.items()])
    table = cumulated(by_length) if detailed else by_length
    bases_of = F.sum(F.col("length") * F.col("n"))
    sums = [F.coalesce(F.sum("n"), zero).cast("long").alias("num_sequences"), F.coalesce(bases_of, zero).cast("long").alias("total_length")]
    sums += [F.coalesce(F.min("length"), zero).cast("long").alias("min_length"), F.coalesce(F.max("length"), zero).cast("long").alias("max_length"), F.coalesce(bases_of / F.sum("n"), F.lit(0.0)).alias("avg_length")]
    sums += [how(name).alias(name) for name, (how, _) in measured.items()]
    one = table.agg(*sums, *(nx_columns() if detailed else []))
    one = one.withColumns({**{c: F.coalesce(c, no) for c in ("_protein", "_rna", "_fastq", "_fasta")}, "gap_count": F.coalesce("_gap", zero).cast("long"), "ambiguous_count": F.coalesce("_ambiguous", zero).cast("long")})
    kind = F.when(F.col("_protein"), "Protein").when(F.col("_rna"), "RNA").when(F.coalesce(F.col("_gc") + F.col("_at"), zero) > 0, "DNA").otherwise("Unknown")
    form = F.when(F.col("_fasta") & F.col("_fastq"), "Mixed").when(F.col("_fastq"), "FASTQ").when(F.col("_fasta"), "FASTA").otherwise("Unknown")
    columns = [form.alias("format"), kind.alias("type"), "num_sequences", "total_length", "min_length", "max_length", "avg_length"]
    columns += [(F.col("_gc") / F.nullif(F.col("_gc") + F.col("_at"), zero)).alias("gc_content"), "gap_count", "ambiguous_count"]
    if with_quality:
        qn = F.nullif("_qn", zero)
        columns += [
            (F.col("_q") / qn).alias("avg_quality"),
            "min_quality",
            "max_quality",
            (100.0 * F.col("_q20") / qn).alias("q20_percentage"),
            (100.0 * F.col("_q30") / qn).alias("q30_percentage"),
            (F.col("_err") / qn).alias("mean_error_rate"),
            F.when(F.col("_qn").isNotNull(), F.lit(encoding)).alias("quality_encoding"),
        ]
    if detailed:
        columns += ["n50", "n90", "q1_length", "q2_length", "q3_length"]
    out = one.select(*([F.lit(file_name).alias("file")] if file_name else []), *columns)
    if include_composition:
        letters = df.select(F.explode(F.filter(F.split(F.upper("sequence"), ""), lambda x: x != "")).alias("base")).groupBy("base").count()
        table = letters.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("base", "count")))).alias("base_composition"))  # one entry for each letter
        out = out.withColumn("_one", F.lit(1)).join(table.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return out


def format_stats_table(row: DataFrame) -> str:
    """The statistics as a tab-separated table with a header line."""
    rows = row.collect()
    names = row.columns
    return "\n".join(["\t".join(names), *["\t".join("" if r[c] is None else f"{r[c]:.2f}" if isinstance(r[c], float) else str(r[c]) for c in names) for r in rows]]) + "\n"
