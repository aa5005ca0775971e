"""Registered queries and the SQL that says the same.

The tables hold no sequences, so reads, alignments and intervals are derived from them by rules that
Spark and SQL share: letters are hexadecimal digests put through a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import bases, codons, coords, hashing, patterns, quality
from seqloom.operators import intervals, pairing, ranking, records, regions, search, sets, splitting, stats, tabular
from seqloom.schema import ORD, conform

HEX = "0123456789abcdef"
LETTERS = "ACGTACGTACGTACGN"
SCORES = "#+5:;<=>?@ABDFHI"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key: the tables are files of few row groups, and what is derived from a row costs
    far more than the row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _digest(key: Column, table: str, *salts: str) -> Column:
    return F.translate(F.concat(*[F.md5(F.concat(key.cast("string"), F.lit(s))) for s in salts]), HEX, table)


def _key(n: str) -> Column:
    """What sequences are made from: as many values as half of the rows."""
    return F.expr(f"{n} div 70 * 35 + {n} % 35")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 30 to 64 bases with qualities; of 70 neighbours, two each have one sequence."""
    n = F.col("event_id")
    length = (30 + n % 35).cast("int")
    e = spread(_table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    return conform(
        e.select(
            n.alias(ORD), F.concat(F.lit("read_"), n.cast("string")).alias("id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("description"),
            F.substr(_digest(_key("event_id"), LETTERS, "a", "b"), F.lit(1), length).alias("sequence"), F.substr(_digest(n, SCORES, "q", "r"), F.lit(1), length).alias("quality"), F.lit("phred33").alias("quality_encoding"),
        )
    )


READS = f"""reads AS (SELECT event_id AS o, 'read_' || CAST(event_id AS VARCHAR) AS id, 'user ' || CAST(user_id AS VARCHAR) AS description,
 substr(translate(md5(CAST(event_id // 70 * 35 + event_id % 35 AS VARCHAR) || 'a') || md5(CAST(event_id // 70 * 35 + event_id % 35 AS VARCHAR) || 'b'), '{HEX}', '{LETTERS}'), 1, CAST(30 + event_id % 35 AS INTEGER)) AS s,
 substr(translate(md5(CAST(event_id AS VARCHAR) || 'q') || md5(CAST(event_id AS VARCHAR) || 'r'), '{HEX}', '{SCORES}'), 1, CAST(30 + event_id % 35 AS INTEGER)) AS q FROM events)"""


def order_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other reads with some ids and some sequences in common with reads()."""
    n = F.col("o_orderkey")
    key = _key("o_orderkey")
    o = spread(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    length = (30 + key % 35).cast("int")
    return conform(o.select(n.alias(ORD), F.concat(F.lit("read_"), n.cast("string")).alias("id"), F.substr(_digest(key, LETTERS, "a", "b"), F.lit(1), length).alias("sequence"), F.repeat(F.lit("I"), length).alias("quality"), F.lit("phred33").alias("quality_encoding")))


OTHERS = f"""others AS (SELECT o_orderkey AS o, 'read_' || CAST(o_orderkey AS VARCHAR) AS id,
 substr(translate(md5(CAST(o_orderkey // 70 * 35 + o_orderkey % 35 AS VARCHAR) || 'a') || md5(CAST(o_orderkey // 70 * 35 + o_orderkey % 35 AS VARCHAR) || 'b'), '{HEX}', '{LETTERS}'), 1, CAST(30 + o_orderkey % 35 AS INTEGER)) AS s FROM orders)"""


def plain(df: DataFrame) -> DataFrame:
    """Reads with T for N."""
    return df.withColumn("sequence", F.translate("sequence", "N", "T"))


PLAIN = READS + ", plain AS (SELECT o, id, description, q, translate(s, 'N', 'T') AS s FROM reads)"


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_orderkey")
    o = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return conform(
        li.select(
            o.alias(ORD), F.lit("sam").alias("format"), F.concat(F.lit("aln_"), o.cast("string")).alias("id"), F.substr(_digest(o, LETTERS, "a", "b"), F.lit(1), F.col("l_quantity").cast("int")).alias("sequence"),
            (F.col("l_linenumber") * 16 + F.col("l_orderkey") % 16).cast("int").alias("flag"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")).alias("reference_sequence"), F.col("l_partkey").alias("position"), (F.col("l_orderkey") % 61).cast("int").alias("mapping_quality"),
            F.concat(F.lit("3S"), (F.col("l_quantity").cast("int") - 3).cast("string"), F.lit("M")).alias("cigar"),
        )
    )


ALIGNMENTS = f"""alignments AS (SELECT o, 'aln_' || CAST(o AS VARCHAR) AS id, substr(translate(md5(CAST(o AS VARCHAR) || 'a') || md5(CAST(o AS VARCHAR) || 'b'), '{HEX}', '{LETTERS}'), 1, n) AS s, flag, ref, pos, mapq, n
 FROM (SELECT l_orderkey * 10 + l_linenumber AS o, l_linenumber * 16 + l_orderkey % 16 AS flag, 'chr' || CAST(l_suppkey % 5 AS VARCHAR) AS ref, l_partkey AS pos, l_orderkey % 61 AS mapq, CAST(l_quantity AS INTEGER) AS n FROM lineitem))"""


def beds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(ORD), F.concat(F.lit("c"), (F.col("l_suppkey") % 50).cast("string")).alias("chromosome"), (F.col("l_partkey") * 40).alias("start"), (F.col("l_partkey") * 40 + F.rint("l_quantity").cast("long")).alias("end")
    )


BEDS = "beds AS (SELECT l_orderkey * 10 + l_linenumber AS o, 'c' || CAST(l_suppkey % 50 AS VARCHAR) AS chromosome, l_partkey * 40 AS st, l_partkey * 40 + CAST(l_quantity AS BIGINT) AS en FROM lineitem)"


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(_table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return conform(p.select(F.col("p_partkey").alias(ORD), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("id"), _digest(F.col("p_partkey"), LETTERS.replace("N", "T"), "a", "b", "c", "d").alias("sequence")))


CONTIGS = f"""contigs AS (SELECT p_partkey AS o, 'part_' || CAST(p_partkey AS VARCHAR) AS id, translate(md5(CAST(p_partkey AS VARCHAR) || 'a') || md5(CAST(p_partkey AS VARCHAR) || 'b') || md5(CAST(p_partkey AS VARCHAR) || 'c') || md5(CAST(p_partkey AS VARCHAR) || 'd'), '{HEX}', '{LETTERS.replace("N", "T")}') AS s FROM part)"""


def _mates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """First mates from orders, second ones from their first line items, where these were returned or accepted."""
    o = spread(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    a = o.select(F.col("o_orderkey").alias(ORD), F.concat(F.lit("p"), F.col("o_orderkey").cast("string"), F.lit("/1")).alias("id"), _digest(F.col("o_orderkey"), LETTERS.replace("N", "A"), "a", "b").alias("sequence"))
    li = _table(spark, sf_dir, "lineitem").filter("l_linenumber = 1 AND l_returnflag <> 'N'").select("l_orderkey").distinct()
    b = li.select(F.col("l_orderkey").alias(ORD), F.concat(F.lit("p"), F.col("l_orderkey").cast("string"), F.lit("/2")).alias("id"), _digest(F.col("l_orderkey"), LETTERS.replace("N", "A"), "b", "c").alias("sequence"))
    with_q = lambda d: conform(d.withColumns({"quality": F.repeat(F.lit("I"), F.length("sequence")), "quality_encoding": F.lit("phred33")}))
    return with_q(a), with_q(b)


MATES = "m1 AS (SELECT o_orderkey AS k FROM orders), m2 AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'N')"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _n(letters: str, s: str = "s") -> str:
    return f"(length({s}) - length(translate(upper({s}), '{letters}', '')))"


def _weighted(full: str, half: str, half_set: str) -> str:
    return f"CASE WHEN {_n('ACGTUSWRYKMNBDHV')} > 0 THEN 100.0 * ({_n(full)} + 0.5 * {_n(half)} + 0.5 * {_n(half_set)}) / {_n('ACGTUSWRYKMNBDHV')} ELSE 0.0 END"


GC, AT = _weighted("GCS", "RYKM", "NBDHV"), _weighted("ATUW", "RYKM", "NBDHV")
SUM_Q = "list_sum(list_transform(range(1, length(q) + 1), lambda i: ascii(substr(q, i, 1)) - 33))"
AVG_Q = f"(CAST({SUM_Q} AS DOUBLE) / length(q))"
RC = f"reverse(translate(s, '{bases.COMPLEMENT_FROM}', '{bases.COMPLEMENT_TO}'))"


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


STATS_SQL = f"""SELECT count(*) AS num_sequences, CAST(coalesce(sum(length(s)), 0) AS BIGINT) AS total_length, CAST(coalesce(min(length(s)), 0) AS BIGINT) AS min_length, CAST(coalesce(max(length(s)), 0) AS BIGINT) AS max_length,
 round(coalesce(avg(length(s)), 0.0), 6) AS avg_length, round(CAST(sum({_n("GC")}) AS DOUBLE) / sum({_n("GCATU")}), 6) AS gc_content,
 round(CAST(sum({SUM_Q}) AS DOUBLE) / sum(length(q)), 6) AS avg_quality,
 round(100.0 * CAST(sum(list_sum(list_transform(range(1, length(q) + 1), lambda i: CASE WHEN ascii(substr(q, i, 1)) - 33 >= 20 THEN 1 ELSE 0 END))) AS DOUBLE) / sum(length(q)), 6) AS q20_percentage,
 round(100.0 * CAST(sum(list_sum(list_transform(range(1, length(q) + 1), lambda i: CASE WHEN ascii(substr(q, i, 1)) - 33 >= 30 THEN 1 ELSE 0 END))) AS DOUBLE) / sum(length(q)), 6) AS q30_percentage FROM t"""
NX_SQL = """lens AS (SELECT length(s) AS n, sum(length(s)) OVER (ORDER BY length(s) DESC, o) AS c, sum(length(s)) OVER () AS total, row_number() OVER (ORDER BY length(s), o) - 1 AS r, count(*) OVER () AS cnt FROM t),
 nx AS (SELECT CAST(max(CASE WHEN c >= total * 0.5 THEN n END) AS BIGINT) AS n50, CAST(max(CASE WHEN c >= total * 0.9 THEN n END) AS BIGINT) AS n90, CAST(max(CASE WHEN r = floor(cnt * 0.25) THEN n END) AS BIGINT) AS q1_length,
 CAST(max(CASE WHEN r = floor(cnt * 0.5) THEN n END) AS BIGINT) AS q2_length, CAST(max(CASE WHEN r = floor(cnt * 0.75) THEN n END) AS BIGINT) AS q3_length FROM lens)"""
STATS_COLUMNS = ["num_sequences", "total_length", "min_length", "max_length", "avg_length", "gc_content", "avg_quality", "q20_percentage", "q30_percentage"]


@query(
    "qc_pipeline",
    f"WITH {READS}, t AS (SELECT * FROM reads WHERE {AVG_Q} >= 24 AND length(s) >= 35 AND {GC} >= 30 AND {GC} <= 70), {NX_SQL}, st AS ({STATS_SQL}) SELECT * FROM st, nx",
)
def qc_pipeline(spark, sf_dir):
    r = records.quality_filter(reads(spark, sf_dir), min_score=24)
    r = records.filter_records(r, min_length=35, min_gc=30, max_gc=70)
    s = stats.stats(r, detailed=True)
    return s.select(*[_r(c) if c in ("avg_length", "gc_content", "avg_quality", "q20_percentage", "q30_percentage") else F.col(c) for c in STATS_COLUMNS], *[_long(c).alias(c) for c in ("n50", "n90", "q1_length", "q2_length", "q3_length")]).toDF(*STATS_COLUMNS, "n50", "n90", "q1_length", "q2_length", "q3_length")


ENTROPY = " + ".join(f"CASE WHEN {_n(x)} > 0 THEN -(CAST({_n(x)} AS DOUBLE) / length(s)) * log2(CAST({_n(x)} AS DOUBLE) / length(s)) ELSE 0.0 END" for x in "ACGTN")


@query(
    "base_metrics",
    f"""WITH {READS} SELECT id, round({GC}, 6) AS gc, round({AT}, 6) AS at, round(CASE WHEN {_n("GC")} > 0 THEN 100.0 * ({_n("G")} - {_n("C")}) / {_n("GC")} ELSE 0.0 END, 6) AS gc_skew,
 round(CASE WHEN {_n("ATU")} > 0 THEN 100.0 * ({_n("A")} - {_n("TU")}) / {_n("ATU")} ELSE 0.0 END, 6) AS at_skew, round({ENTROPY}, 6) AS entropy,
 round(100.0 * len(list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i, 2)))) / (length(s) - 1), 6) AS complexity,
 array_to_string(list_sort(list_distinct(list_transform(range(1, length(s) + 1), lambda i: substr(s, i, 1)))), '') AS alphabet, md5(upper(s)) AS seq_hash, round(100.0 * {_n("GN")} / length(s), 6) AS gn_content FROM reads""",
)
def base_metrics(spark, sf_dir):
    t = tabular.to_tabular(reads(spark, sf_dir), ["id", "gc", "at", "gc_skew", "at_skew", "entropy", "complexity", "alphabet", "seq_hash", "base_content_GN"])
    return t.select("id", *[_r(c).alias(c) for c in ("gc", "at", "gc_skew", "at_skew", "entropy", "complexity")], "alphabet", "seq_hash", _r("base_content_GN").alias("gn_content"))


@query("classify_counts", f"""WITH {READS} SELECT {", ".join(f"CAST(sum({_n(v)}) AS BIGINT) AS {k}" for k, v in bases.CLASSES.items() if k != "gap")}, CAST(sum(length(s)) AS BIGINT) AS total FROM reads""")
def classify_counts(spark, sf_dir):
    c = reads(spark, sf_dir).select(bases.classify("sequence").alias("c"), F.length("sequence").alias("n"))
    return c.agg(*[F.sum(f"c.{k}").alias(k) for k in bases.CLASSES if k != "gap"], F.sum("n").alias("total"))


@query("base_composition", f"WITH {READS}, x AS (SELECT unnest(list_transform(range(1, length(s) + 1), lambda i: substr(s, i, 1))) AS base FROM reads) SELECT base, count(*) AS n FROM x GROUP BY base")
def base_composition(spark, sf_dir):
    m = reads(spark, sf_dir).select(F.explode(bases.base_composition("sequence")).alias("base", "k"))
    return m.groupBy("base").agg(F.sum("k").cast("long").alias("n"))


@query("transform_reverse_complement", f"WITH {READS} SELECT id, {RC} AS rc, translate(reverse(s), 'T', 'U') AS rna, lower(s) AS low FROM reads")
def transform_reverse_complement(spark, sf_dir):
    r = reads(spark, sf_dir)
    a = records.transform(r, reverse_complement=True).select("id", F.col("sequence").alias("rc"))
    b = records.transform(r, reverse=True, to_rna=True).select("id", F.col("sequence").alias("rna"))
    c = records.transform(r, lower_case=True).select("id", F.col("sequence").alias("low"))
    return a.join(b, "id").join(c, "id")


@query(
    "clean",
    f"WITH {READS}, g AS (SELECT id, translate(s, 'C', '-') AS s FROM reads) SELECT id, regexp_replace(replace(s, '-', ''), '[^ACGTUacgtu]', 'X', 'g') AS sequence, CAST(length(replace(s, '-', '')) AS BIGINT) AS length FROM g WHERE length(replace(s, '-', '')) > 0",
)
def clean(spark, sf_dir):
    g = reads(spark, sf_dir).withColumn("sequence", F.translate("sequence", "C", "-"))
    return records.clean(g, remove_gaps=True, replace_ambiguous=True, replace_char="X", remove_empty=True).select("id", "sequence", _long("length").alias("length"))


@query("validate_reject", f"WITH {READS} SELECT id, s AS sequence FROM reads WHERE regexp_full_match(s, '[ACGT]*')")
def validate_reject(spark, sf_dir):
    return records.validate(reads(spark, sf_dir), allow_ambiguous=False).select("id", "sequence")


@query("validate_fix", f"WITH {READS} SELECT id, translate(s, 'N', 'A') AS sequence FROM reads")
def validate_fix(spark, sf_dir):
    return records.validate(reads(spark, sf_dir), allow_ambiguous=False, action="fix", fix_char="A").select("id", "sequence")


@query(
    "quality_stats",
    f"""WITH {READS} SELECT id, round({AVG_Q}, 6) AS avg_qual, CAST(list_min(list_transform(range(1, length(q) + 1), lambda i: ascii(substr(q, i, 1)) - 33)) AS BIGINT) AS min_qual,
 CAST(list_max(list_transform(range(1, length(q) + 1), lambda i: ascii(substr(q, i, 1)) - 33)) AS BIGINT) AS max_qual,
 round(list_sum(list_transform(range(1, length(q) + 1), lambda i: pow(10.0, -(ascii(substr(q, i, 1)) - 33) / 10.0))) / length(q), 6) AS mean_error FROM reads""",
)
def quality_stats(spark, sf_dir):
    return reads(spark, sf_dir).select("id", _r(quality.average("quality")).alias("avg_qual"), _long(quality.minimum("quality")).alias("min_qual"), _long(quality.maximum("quality")).alias("max_qual"), _r(quality.error_sum("quality") / F.length("quality")).alias("mean_error"))


@query("convert_quality", f"WITH {READS} SELECT id, array_to_string(list_transform(range(1, length(q) + 1), lambda i: chr(ascii(substr(q, i, 1)) + 31)), '') AS quality, 'phred64' AS quality_encoding FROM reads")
def convert_quality(spark, sf_dir):
    return records.convert_quality(reads(spark, sf_dir), "phred64").select("id", "quality", "quality_encoding")


@query("bin_quality", f"WITH {READS} SELECT id, array_to_string(list_transform(range(1, length(q) + 1), lambda i: CASE WHEN ascii(substr(q, i, 1)) - 33 < 15 THEN chr(40) WHEN ascii(substr(q, i, 1)) - 33 < 30 THEN chr(55) ELSE chr(73) END), '') AS quality FROM reads")
def bin_quality(spark, sf_dir):
    return records.quality_filter(reads(spark, sf_dir), bins=3, preset="illumina").select("id", "quality")


@query("bin_distribution", f"WITH {READS}, x AS (SELECT unnest(list_transform(range(1, length(q) + 1), lambda i: ascii(substr(q, i, 1)) - 33)) AS v FROM reads) SELECT CAST(CASE WHEN v < 15 THEN 0 WHEN v < 30 THEN 1 ELSE 2 END AS BIGINT) AS bin, count(*) AS n FROM x GROUP BY 1")
def bin_distribution(spark, sf_dir):
    return records.bin_distribution(reads(spark, sf_dir), [15, 30]).select(_long("bin").alias("bin"), "n")


@query(
    "quality_trim",
    f"""WITH {READS}, w AS (SELECT id, s, q, list_filter(range(0, length(q) - 3), lambda i: ascii(substr(q, i + 1, 1)) + ascii(substr(q, i + 2, 1)) + ascii(substr(q, i + 3, 1)) + ascii(substr(q, i + 4, 1)) - 132 >= 108) AS g FROM reads)
 SELECT id, substr(s, CAST(g[1] AS INTEGER) + 1, CAST(g[len(g)] + 4 - g[1] AS INTEGER)) AS sequence, substr(q, CAST(g[1] AS INTEGER) + 1, CAST(g[len(g)] + 4 - g[1] AS INTEGER)) AS quality FROM w WHERE len(g) > 0""",
)
def quality_trim(spark, sf_dir):
    return records.quality_filter(reads(spark, sf_dir), trim=True, trim_threshold=27).select("id", "sequence", "quality")


@query("filter_records", f"WITH {READS} SELECT id, s AS sequence FROM reads WHERE length(s) BETWEEN 40 AND 60 AND {GC} >= 40 AND {GC} <= 60 AND (contains(s, 'ACG') OR contains(id, 'ACG')) AND regexp_matches(s, '[^ACGTU]') AND id NOT IN ('read_1', 'read_2')")
def filter_records(spark, sf_dir):
    return records.filter_records(reads(spark, sf_dir), min_length=40, max_length=60, min_gc=40, max_gc=60, pattern="ACG", has_ambiguous=True, exclude_ids=["read_1", "read_2"]).select("id", "sequence")


@query("filter_alignments", f"WITH {ALIGNMENTS} SELECT id, CAST(pos AS BIGINT) AS position FROM alignments WHERE mapq >= 20 AND (flag & 4) = 0 AND (flag & 16) = 16 AND ref = 'chr2' AND pos > 0 AND pos <= 1500 AND pos + length(s) - 1 >= 100")
def filter_alignments(spark, sf_dir):
    return records.filter_records(alignments(spark, sf_dir), min_mapq=20, exclude_flags=4, include_flags=16, region="chr2:100-1500").select("id", "position")


@query("alignment_summary", f"WITH {ALIGNMENTS} SELECT ref AS reference_sequence, count(*) AS n, count(*) FILTER ((flag & 16) = 16) AS reverse_strand, round(avg(mapq), 6) AS avg_mapq, CAST(sum(length(s)) AS BIGINT) AS bases FROM alignments GROUP BY ref")
def alignment_summary(spark, sf_dir):
    a = alignments(spark, sf_dir)
    return a.groupBy("reference_sequence").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("flag").bitwiseAND(F.lit(16)) == 16).alias("reverse_strand"), _r(F.avg("mapping_quality")).alias("avg_mapq"), F.sum(F.length("sequence")).alias("bases"))


@query("soft_clips", f"WITH {ALIGNMENTS} SELECT id, CASE WHEN n > 3 THEN substr(s, 4) ELSE s END AS sequence, CASE WHEN n > 3 THEN CAST(n - 3 AS VARCHAR) || 'M' ELSE '3S' || CAST(n - 3 AS VARCHAR) || 'M' END AS cigar FROM alignments")
def soft_clips(spark, sf_dir):
    return records.transform(alignments(spark, sf_dir), trim_soft_clips=True).select("id", "sequence", "cigar")


@query("grep_exact", f"WITH {READS} SELECT id FROM reads WHERE NOT contains(s, 'GAT')")
def grep_exact(spark, sf_dir):
    return search.grep(reads(spark, sf_dir), "GAT", invert=True).select("id")


@query("grep_word", f"WITH {READS} SELECT id, description FROM reads WHERE regexp_matches(description, '\\bUSER\\b', 'i')")
def grep_word(spark, sf_dir):
    return search.grep(reads(spark, sf_dir), "USER", "description", ignore_case=True, whole_word=True).select("id", "description")


@query("grep_both_strands", f"WITH {READS} SELECT id FROM reads WHERE regexp_matches(s, '[GN][AN][TN][TN][AN][CN][AN]') OR regexp_matches(s, '[TN][GN][TN][AN][AN][TN][CN]')")
def grep_both_strands(spark, sf_dir):
    return search.grep(reads(spark, sf_dir), "GATTACA", search_both_strands=True).select("id")


@query("grep_edits", f"WITH {READS} SELECT id FROM reads WHERE len(list_filter(range(1, length(s) + 1), lambda i: list_min(list_transform(range(9, 14), lambda l: levenshtein(substr(s, CAST(i AS INTEGER), CAST(l AS INTEGER)), 'GATTACAGATT'))) <= 2)) > 0")
def grep_edits(spark, sf_dir):
    return search.grep(reads(spark, sf_dir), "GATTACAGATT", allow_mismatches=2).select("id")


@query("locate_exact", f"WITH {READS}, p AS (SELECT id, s, unnest(list_filter(range(0, length(s) - 2), lambda i: substr(s, i + 1, 3) = 'ACA')) AS st FROM reads) SELECT id AS sequence_id, CAST(st AS BIGINT) AS start, CAST(st + 3 AS BIGINT) AS \"end\", substr(s, CAST(st AS INTEGER) + 1, 3) AS matched_sequence, '+' AS strand, 1.0::DOUBLE AS score FROM p")
def locate_exact(spark, sf_dir):
    h = search.locate(reads(spark, sf_dir), "ACA", allow_overlaps=True)
    return h.select("sequence_id", _long("start").alias("start"), _long("end").alias("end"), "matched_sequence", "strand", "score")


@query(
    "locate_mismatches",
    f"""WITH {READS}, p AS (SELECT id, s, unnest(range(0, length(s) - 5)) AS st FROM reads), m AS (SELECT id, st, list_sum(list_transform(range(1, 7), lambda i: CASE WHEN substr(s, CAST(st + i AS INTEGER), 1) = substr('GATTAC', i, 1) THEN 0 ELSE 1 END)) AS x FROM p)
 SELECT id AS sequence_id, CAST(st AS BIGINT) AS start, CAST(x AS BIGINT) AS mismatches, round(1 - x / 6.0, 6) AS score FROM m WHERE x <= 1""",
)
def locate_mismatches(spark, sf_dir):
    h = search.locate(reads(spark, sf_dir), "GATTAC", allow_mismatches=1, allow_overlaps=True, bed=True)
    return h.select("sequence_id", _long("start").alias("start"), _long("mismatches").alias("mismatches"), _r("score").alias("score"))


def _wrong(pattern: str, at: str) -> str:
    """Letters in which the pattern differs from s at a 0-based place."""
    return f"list_sum(list_transform(range(1, {len(pattern) + 1}), lambda i: CASE WHEN substr(s, CAST({at} + i AS INTEGER), 1) = substr('{pattern}', i, 1) THEN 0 ELSE 1 END))"


@query(
    "locate_both_strands",
    f"""WITH RECURSIVE {READS}, p AS (SELECT id, s, unnest(range(0, length(s) - 5)) AS st FROM reads), b AS (SELECT id, s, st, {_wrong("GATTAC", "st")} AS x, '+' AS strand FROM p UNION ALL SELECT id, s, st, {_wrong("GTAATC", "st")}, '-' FROM p),
 h AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY st, x, strand) AS k FROM b WHERE x <= 1), nx AS (SELECT a.id, a.k, min(c.k) AS n FROM h a JOIN h c ON a.id = c.id AND c.st >= a.st + 6 GROUP BY a.id, a.k),
 w AS (SELECT id, k FROM h WHERE k = 1 UNION ALL SELECT w.id, nx.n FROM w JOIN nx ON w.id = nx.id AND w.k = nx.k)
 SELECT h.id AS sequence_id, CAST(st AS BIGINT) AS start, CAST(st + 6 AS BIGINT) AS "end", strand, substr(s, CAST(st + 1 AS INTEGER), 6) AS matched_sequence, CAST(x AS BIGINT) AS mismatches,
 substr(s, CAST(greatest(st - 10, 0) + 1 AS INTEGER), CAST(least(st, 10) AS INTEGER)) AS upstream, substr(s, CAST(st + 7 AS INTEGER), 10) AS downstream FROM w JOIN h ON w.id = h.id AND w.k = h.k""",
)
def locate_both_strands(spark, sf_dir):
    h = search.locate(reads(spark, sf_dir), "GATTAC", allow_mismatches=1, search_both_strands=True)
    return h.select("sequence_id", _long("start").alias("start"), _long("end").alias("end"), "strand", "matched_sequence", _long("mismatches").alias("mismatches"), "context.upstream", "context.downstream")


@query("amplicon_exact")
def amplicon_exact(spark, sf_dir):
    c = contigs(spark, sf_dir)
    lead = F.concat(F.lit("ACGTACGTAC"), F.col("sequence"), F.lit("GGATCCTTGA"))
    return search.amplicon(c.withColumn("sequence", lead), "ACGTACGTAC", "TCAAGGATCC", flanking=False).select("id", "sequence", "length")


ORACLE["amplicon_exact"] = f"WITH {CONTIGS}, c AS (SELECT o, id, 'ACGTACGTAC' || s || 'GGATCCTTGA' AS s FROM contigs), f AS (SELECT id, s, unnest(list_filter(range(0, length(s) - 9), lambda i: substr(s, i + 1, 10) = 'ACGTACGTAC')) AS a FROM c), r AS (SELECT f.*, unnest(list_filter(range(0, length(s) - 9), lambda i: substr(s, i + 1, 10) = 'GGATCCTTGA')) AS b FROM f), k AS (SELECT id, s, a, b, row_number() OVER (PARTITION BY id ORDER BY b - a DESC, a) AS k FROM r WHERE a < b AND b - a - 10 BETWEEN 1 AND 10000) SELECT id || '_amplicon_' || CAST(k AS VARCHAR) AS id, substr(s, CAST(a AS INTEGER) + 11, CAST(b - a - 10 AS INTEGER)) AS sequence, CAST(b - a - 10 AS INTEGER) AS length FROM k"


@query("windows_linear", f"WITH {READS}, w AS (SELECT id, s, unnest(range(0, length(s) - 19, 10)) AS st FROM reads) SELECT id || '_window:' || CAST(st + 1 AS VARCHAR) || '-' || CAST(st + 20 AS VARCHAR) AS id, substr(s, CAST(st AS INTEGER) + 1, 20) AS sequence, CAST(st + 1 AS BIGINT) AS start_position, CAST(st + 20 AS BIGINT) AS end_position FROM w")
def windows_linear(spark, sf_dir):
    return regions.windows(reads(spark, sf_dir), 20, 10).select("id", "sequence", "start_position", "end_position")


@query("windows_circular", f"WITH {READS}, w AS (SELECT id, s, unnest(range(0, length(s), 10)) AS st FROM reads) SELECT id AS original_id, substr(s || s, CAST(st AS INTEGER) + 1, 20) AS sequence, CAST(st AS BIGINT) AS start_position, CAST(st + 20 AS BIGINT) AS end_position, st + 20 > length(s) AS is_wrapped FROM w")
def windows_circular(spark, sf_dir):
    return regions.windows(reads(spark, sf_dir), 20, 10, circular=True, zero_based=True).select("original_id", "sequence", "start_position", "end_position", "is_wrapped")


@query("windows_greedy", f"WITH {READS}, w AS (SELECT id, s, unnest(range(0, length(s), 15)) AS st FROM reads) SELECT id AS original_id, substr(s, CAST(st AS INTEGER) + 1, 20) AS sequence, CAST(least(st + 20, length(s)) AS BIGINT) AS end_position FROM w")
def windows_greedy(spark, sf_dir):
    return regions.windows(reads(spark, sf_dir), 20, 15, greedy=True).select("original_id", "sequence", "end_position")


@query("count_kmers", f"WITH {READS}, w AS (SELECT unnest(list_transform(range(1, length(s) - 3), lambda i: substr(s, i, 5))) AS sequence FROM reads) SELECT sequence, count(*) AS n FROM w GROUP BY sequence")
def count_kmers(spark, sf_dir):
    return regions.count_kmers(reads(spark, sf_dir), 5)


@query("subseq_region", f"WITH {READS} SELECT id || ':' || CAST(4 AS VARCHAR) || ':' || CAST(length(s) - 4 AS VARCHAR) AS id, substr(s, 4, length(s) - 7) AS sequence, substr(q, 4, length(s) - 7) AS quality FROM reads")
def subseq_region(spark, sf_dir):
    return regions.subseq(reads(spark, sf_dir), "6:-6", upstream=2, downstream=2, include_coordinates=True).select("id", "sequence", "quality")


@query("subseq_flanks", f"WITH {READS} SELECT id, substr(s, 6, 5) || substr(s, 21, 5) AS sequence FROM reads")
def subseq_flanks(spark, sf_dir):
    return regions.subseq(reads(spark, sf_dir), start=11, end=20, upstream=5, downstream=5, only_flank=True).select("id", "sequence")


@query("subseq_regions", f"WITH {READS} SELECT id, substr(s, 1, 5) || substr(s, length(s) - 4, 5) AS sequence FROM reads")
def subseq_regions(spark, sf_dir):
    return regions.subseq(reads(spark, sf_dir), regions=["1:5", "-5:-1"], concatenate=True).select("id", "sequence")


@query(
    "subseq_features",
    f"WITH {CONTIGS}, f AS (SELECT 'part_' || CAST(l_partkey AS VARCHAR) AS c, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS b FROM lineitem) SELECT id || ':' || CAST(a AS VARCHAR) || ':' || CAST(least(b, length(s)) AS VARCHAR) AS id, substr(s, CAST(a AS INTEGER) + 1, CAST(least(b, length(s)) - a AS INTEGER)) AS sequence FROM contigs JOIN f ON id = c WHERE least(b, length(s)) > a",
)
def subseq_features(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    f = li.select(F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("chromosome"), (F.col("l_linenumber") * 10).cast("long").alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("long").alias("end"))
    return regions.subseq_by_features(contigs(spark, sf_dir), f, include_coordinates=True).select("id", "sequence")


CODON = f"substr('{codons.STANDARD}', 1 + 16 * (instr('TCAG', substr(x, 3 * i - 2, 1)) - 1) + 4 * (instr('TCAG', substr(x, 3 * i - 1, 1)) - 1) + instr('TCAG', substr(x, 3 * i, 1)) - 1, 1)"


def _protein(x: str) -> str:
    return f"array_to_string(list_transform(range(1, length({x}) // 3 + 1), lambda i: {CODON.replace('substr(x,', f'substr({x},')}), '')"


@query("translate_frame", f"WITH {PLAIN} SELECT id, {_protein('s')} AS sequence FROM plain")
def translate_frame(spark, sf_dir):
    return regions.translate(plain(reads(spark, sf_dir))).select("id", "sequence")


@query("translate_frames", f"WITH {PLAIN}, f AS (SELECT id, s AS x, '+1' AS f FROM plain UNION ALL SELECT id, substr(s, 3), '+3' FROM plain UNION ALL SELECT id, substr({RC}, 2), '-2' FROM plain) SELECT id || '_frame_' || f AS id, {_protein('x')} AS sequence FROM f")
def translate_frames(spark, sf_dir):
    return regions.translate(plain(reads(spark, sf_dir)), frames=[1, 3, -2], include_frame_in_id=True).select("id", "sequence")


@query(
    "translate_orfs",
    f"""WITH {PLAIN}, f AS (SELECT id || '_frame_+' || CAST(k AS VARCHAR) AS id, substr(s, CAST(k AS INTEGER)) AS x FROM plain, (SELECT unnest(range(1, 4)) AS k) UNION ALL SELECT id || '_frame_-' || CAST(k AS VARCHAR), substr({RC}, CAST(k AS INTEGER)) FROM plain, (SELECT unnest(range(1, 4)) AS k)),
 p AS (SELECT id, {_protein('x')} AS p, CAST(list_filter(range(1, length(x) // 3 + 1), lambda i: substr(x, 3 * i - 2, 3) IN ('TTG', 'CTG', 'ATG'))[1] AS INTEGER) AS fst FROM f),
 t AS (SELECT id, substr(p, fst, 1) AS lead, substr(p, fst + 1) AS tail FROM p WHERE fst IS NOT NULL),
 o AS (SELECT id, lead || CASE WHEN contains(tail, '*') THEN substr(tail, 1, instr(tail, '*')) ELSE tail END AS sequence FROM t) SELECT id, sequence FROM o WHERE length(sequence) >= 5""",
)
def translate_orfs(spark, sf_dir):
    return regions.translate(plain(reads(spark, sf_dir)), orfs_only=True, all_frames=True, min_orf_length=5, include_frame_in_id=True).select("id", "sequence")


BEFORE = "substr(p, 1, CAST(k - 1 AS INTEGER))"
STOP_BEFORE = f"CASE WHEN contains({BEFORE}, '*') THEN k - instr(reverse({BEFORE}), '*') ELSE 0 END"


@query(
    "find_orfs",
    f"""WITH {CONTIGS}, d AS (SELECT o, id, s, '+' AS strand FROM contigs UNION ALL SELECT o, id, {RC}, '-' FROM contigs), f AS (SELECT o, id, strand, length(s) AS n, f, substr(s, CAST(f AS INTEGER) + 1) AS x FROM d, (SELECT unnest(range(0, 3)) AS f)),
 t AS (SELECT *, {_protein("x")} AS p, array_to_string(list_transform(range(1, length(x) // 3 + 1), lambda i: CASE WHEN substr(x, 3 * i - 2, 3) IN ('TTG', 'CTG', 'ATG') THEN 's' ELSE '.' END), '') AS st FROM f),
 k AS (SELECT *, unnest(list_filter(range(1, length(st) + 1), lambda i: substr(st, i, 1) = 's')) AS k FROM t),
 g AS (SELECT *, instr(substr(p, CAST(k + 1 AS INTEGER)), '*') AS stop, {STOP_BEFORE} AS prev FROM k)
 SELECT o AS _ord, id, CAST(f + (k - 1) * 3 AS INTEGER) AS start, CAST(CASE WHEN stop = 0 THEN n - 1 ELSE f + (k + stop - 1) * 3 + 1 END AS INTEGER) AS "end", CAST(CASE WHEN strand = '+' THEN f + 1 ELSE -f - 1 END AS INTEGER) AS frame, strand,
 CAST(CASE WHEN stop = 0 THEN length(p) - k + 1 ELSE stop END AS INTEGER) AS length, CASE WHEN stop = 0 THEN substr(p, CAST(k AS INTEGER)) ELSE substr(p, CAST(k AS INTEGER), CAST(stop AS INTEGER)) END AS protein
 FROM g WHERE NOT contains(substr(st, CAST(prev + 1 AS INTEGER), CAST(k - prev - 1 AS INTEGER)), 's') AND CASE WHEN stop = 0 THEN length(p) - k + 1 ELSE stop END >= 10""",
)
def find_orfs(spark, sf_dir):
    return regions.find_orfs(contigs(spark, sf_dir), min_length=10)


@query("sequence_types", f"WITH {READS} SELECT id, CASE WHEN event THEN 'rna' ELSE 'dna' END AS type, md5(upper(s)) AS md5, sha1(s) AS sha1, sha256(s) AS sha256, s = {RC} AS palindromic FROM (SELECT *, false AS event FROM reads)")
def sequence_types(spark, sf_dir):
    r = reads(spark, sf_dir)
    return r.select("id", bases.sequence_type("sequence").alias("type"), hashing.md5("sequence").alias("md5"), hashing.sha1("sequence").alias("sha1"), hashing.sha256("sequence").alias("sha256"), bases.is_palindromic("sequence").alias("palindromic"))


@query("find_positions", f"WITH {READS} SELECT id, array_to_string(list_transform(list_filter(range(0, length(s) - 1), lambda i: substr(s, i + 1, 2) = 'AA'), lambda i: CAST(i AS VARCHAR)), ',') AS places FROM reads")
def find_positions(spark, sf_dir):
    return reads(spark, sf_dir).select("id", F.array_join(F.transform(patterns.find_exact("sequence", "AA"), lambda x: x.cast("string")), ",").alias("places"))


GROUPED = READS + ", g AS (SELECT o, 'u' || CAST(o % 97 AS VARCHAR) AS id, description, s, q FROM reads)"


def _grouped(spark, sf_dir):
    return reads(spark, sf_dir).withColumn("id", F.concat(F.lit("u"), (F.col(ORD) % 97).cast("string")))


@query("rename", f"WITH {GROUPED}, n AS (SELECT o, id, row_number() OVER (PARTITION BY id ORDER BY o) AS n FROM g) SELECT o AS ord, CASE WHEN n > 1 THEN id || '_' || CAST(n AS VARCHAR) ELSE id END AS id FROM n")
def rename(spark, sf_dir):
    return sets.rename(_grouped(spark, sf_dir)).select(F.col(ORD).alias("ord"), "id")


@query("replace_number", f"WITH {READS}, f AS (SELECT o, id, lpad(CAST(row_number() OVER (ORDER BY o) AS VARCHAR), CAST(greatest(4, length(CAST(row_number() OVER (ORDER BY o) AS VARCHAR))) AS INTEGER), '0') AS nr FROM reads WHERE contains(id, '7')) SELECT CASE WHEN f.o IS NULL THEN reads.id ELSE 'r' || regexp_extract(reads.id, '_([0-9])', 1) || '-' || nr || regexp_replace(reads.id, '^read_[0-9]', '') END AS id, reads.o AS ord FROM reads LEFT JOIN f ON reads.o = f.o")
def replace_number(spark, sf_dir):
    return records.replace(reads(spark, sf_dir), "read_([0-9])", "r$1-{nr}", nr_width=4, filter_patterns=["7"]).select("id", F.col(ORD).alias("ord"))


@query(
    "replace_key_value",
    "SELECT c_custkey AS ord, CASE WHEN r_name IS NULL THEN 'nation' || CAST(c_nationkey AS VARCHAR) ELSE r_name END || '.' || CAST(c_custkey AS VARCHAR) AS id FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_name < 'M' LEFT JOIN region ON n_regionkey = r_regionkey",
)
def replace_key_value(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    seqs = conform(c.select(F.col("c_custkey").alias(ORD), F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("."), F.col("c_custkey").cast("string")).alias("id"), F.lit("ACGT").alias("sequence")))
    kv = _table(spark, sf_dir, "nation").filter("n_name < 'M'").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("key"), F.col("r_name").alias("value"))
    return records.replace(seqs, r"(nation[0-9]+)", "{kv}", kv=kv, keep_key=True).select(F.col(ORD).alias("ord"), "id")


@query("unique_first", f"WITH {READS} SELECT min(o) AS ord, s AS sequence FROM reads GROUP BY s")
def unique_first(spark, sf_dir):
    return sets.unique(reads(spark, sf_dir)).select(F.col(ORD).alias("ord"), "sequence")


@query("unique_quality", f"WITH {READS}, n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY {AVG_Q} DESC, o) AS n, min(o) OVER (PARTITION BY s) AS f FROM reads) SELECT f AS ord, id FROM n WHERE n = 1")
def unique_quality(spark, sf_dir):
    return sets.unique(reads(spark, sf_dir), conflict="highest-quality").select(F.col(ORD).alias("ord"), "id")


@query("unique_longest", f"WITH {GROUPED}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(s) DESC, o) AS n FROM g) SELECT id, s AS sequence FROM n WHERE n = 1")
def unique_longest(spark, sf_dir):
    return sets.unique(_grouped(spark, sf_dir), by="id", conflict="longest").select("id", "sequence")


@query("rmdup_both", f"WITH {GROUPED} SELECT min(o) AS ord, id, s AS sequence FROM g GROUP BY id, s")
def rmdup_both(spark, sf_dir):
    return sets.rmdup(_grouped(spark, sf_dir), by="both").select(F.col(ORD).alias("ord"), "id", "sequence")


@query("find_duplicates", f'WITH {READS} SELECT s AS "key", count(*) AS n, min(o) AS first_ord FROM reads GROUP BY s HAVING count(*) > 1')
def find_duplicates(spark, sf_dir):
    return sets.find_duplicates(reads(spark, sf_dir))


@query("dedup_stats", f'WITH {READS}, u AS (SELECT s, count(*) AS n FROM reads GROUP BY s) SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS "unique", CAST(sum(n) - count(*) AS BIGINT) AS duplicates, round(CAST(sum(n) - count(*) AS DOUBLE) / sum(n), 6) AS duplicate_rate FROM u')
def dedup_stats(spark, sf_dir):
    return sets.dedup_stats(reads(spark, sf_dir)).select("total", "unique", "duplicates", _r("duplicate_rate").alias("duplicate_rate"))


def _both(spark, sf_dir):
    return reads(spark, sf_dir), order_reads(spark, sf_dir)


BOTH = READS + ", " + OTHERS + ", a AS (SELECT min(o) AS o, s FROM reads GROUP BY s), b AS (SELECT min(o) AS o, s FROM others GROUP BY s)"


@query("set_union", f"WITH {BOTH} SELECT o AS ord, s AS sequence FROM a UNION ALL SELECT o, s FROM b WHERE s NOT IN (SELECT s FROM a)")
def set_union(spark, sf_dir):
    return sets.union(*_both(spark, sf_dir)).select(F.col(ORD).alias("ord"), "sequence")


@query("set_intersection", f"WITH {BOTH} SELECT o AS ord, s AS sequence FROM a WHERE s IN (SELECT s FROM b)")
def set_intersection(spark, sf_dir):
    return sets.intersection(*_both(spark, sf_dir)).select(F.col(ORD).alias("ord"), "sequence")


@query("set_symmetric_difference", f"WITH {BOTH} SELECT o AS ord, s AS sequence FROM a WHERE s NOT IN (SELECT s FROM b) UNION ALL SELECT o, s FROM b WHERE s NOT IN (SELECT s FROM a)")
def set_symmetric_difference(spark, sf_dir):
    return sets.symmetric_difference(*_both(spark, sf_dir)).select(F.col(ORD).alias("ord"), "sequence")


@query("set_metrics", f"WITH {BOTH}, n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM a WHERE s IN (SELECT s FROM b)) AS c) SELECT CAST(na AS BIGINT) AS size_a, CAST(nb AS BIGINT) AS size_b, round(CAST(c AS DOUBLE) / (na + nb - c), 6) AS jaccard, round(CAST(c AS DOUBLE) / na, 6) AS containment, round(CAST(c AS DOUBLE) / least(na, nb), 6) AS overlap, c = 0 AS is_disjoint FROM n")
def set_metrics(spark, sf_dir):
    m = sets.set_metrics(*_both(spark, sf_dir))
    return m.select(_long("size_a").alias("size_a"), _long("size_b").alias("size_b"), _r("jaccard").alias("jaccard"), _r("containment").alias("containment"), _r("overlap").alias("overlap"), "is_disjoint")


@query("filter_by_set", f"WITH {READS}, {OTHERS} SELECT id FROM reads WHERE s NOT IN (SELECT s FROM others)")
def filter_by_set(spark, sf_dir):
    return sets.filter_by_set(*_both(spark, sf_dir), exclude=True).select("id")


@query("concat_suffix", f"WITH {READS}, {OTHERS} SELECT id, s AS sequence FROM reads UNION ALL SELECT CASE WHEN id IN (SELECT id FROM reads) THEN id || '_src1' ELSE id END, s FROM others")
def concat_suffix(spark, sf_dir):
    return sets.concat([*_both(spark, sf_dir)], conflict="suffix").select("id", "sequence")


@query("top_gc", f"WITH {READS} SELECT id, round(CAST({_n('GC')} AS DOUBLE) / length(s), 6) AS gc, row_number() OVER (ORDER BY CAST({_n('GC')} AS DOUBLE) / length(s) DESC, o) AS place FROM reads QUALIFY place <= 50")
def top_gc(spark, sf_dir):
    from pyspark.sql import Window as W

    scored = reads(spark, sf_dir).select("id", ORD, bases.gc_fraction("sequence").alias("g"))
    t = ranking.top_n(scored, 50, F.col("g"))
    return t.select("id", _r("g").alias("gc"), _long(F.row_number().over(W.orderBy(F.col("g").desc(), ORD))).alias("place"))


@query("sort_sequence", f"WITH {READS} SELECT id, s AS sequence FROM reads ORDER BY s, q, o")
def sort_sequence(spark, sf_dir):
    return ranking.sort_records(reads(spark, sf_dir), "sequence").select("id", "sequence")


@query("head", f"WITH {READS} SELECT id FROM reads ORDER BY o LIMIT 25")
def head(spark, sf_dir):
    return ranking.head(reads(spark, sf_dir), 25).select("id")


@query("enumerate", f'WITH {READS} SELECT id, row_number() OVER (ORDER BY o) - 1 AS "index" FROM reads')
def enumerate_records(spark, sf_dir):
    return ranking.enumerate_records(reads(spark, sf_dir)).select("id", "index")


@query("sample_systematic", f"WITH {READS}, n AS (SELECT id, row_number() OVER (ORDER BY o) - 1 AS r, greatest(1, count(*) OVER () // 90) AS k FROM reads) SELECT id FROM n WHERE r % k = 0 AND r < 90 * k")
def sample_systematic(spark, sf_dir):
    return ranking.sample(reads(spark, sf_dir), 90, strategy="systematic").select("id")


def _draw(seed: int) -> str:
    """ranking.uniform of _ord in SQL."""
    return f"(list_sum(list_transform(range(1, 9), lambda i: (instr('{HEX}', substr(md5('{seed}:' || CAST(o AS VARCHAR)), i, 1)) - 1) * pow(16, 8 - i))) / 4294967296.0)"


@query("sample_fraction", f"WITH {READS} SELECT id FROM reads WHERE {_draw(7)} < 0.25")
def sample_fraction(spark, sf_dir):
    return ranking.sample(reads(spark, sf_dir), fraction=0.25, seed=7).select("id")


@query("sample_reservoir", f"WITH {READS} SELECT id FROM reads ORDER BY {_draw(42)}, o LIMIT 100")
def sample_reservoir(spark, sf_dir):
    return ranking.sample(reads(spark, sf_dir), 100).select("id")


@query("sample_stratified", f"WITH {READS} SELECT id, CAST(length(s) AS INTEGER) AS length FROM reads QUALIFY row_number() OVER (PARTITION BY length(s) ORDER BY {_draw(42)}, o) <= 5")
def sample_stratified(spark, sf_dir):
    return ranking.sample_stratified(reads(spark, sf_dir), F.length("sequence"), 5).select("id", "length")


@query("pairs_inner", f"WITH {MATES} SELECT 'p' || CAST(m1.k AS VARCHAR) AS id, 'p' || CAST(m1.k AS VARCHAR) || '/1' AS r1, 'p' || CAST(m1.k AS VARCHAR) || '/2' AS r2 FROM m1 JOIN m2 ON m1.k = m2.k")
def pairs_inner(spark, sf_dir):
    a, b = _mates(spark, sf_dir)
    return pairing.pairs(a, b).select("id", F.col("r1.id").alias("r1"), F.col("r2.id").alias("r2"))


@query("interleave_pairs", f"WITH {MATES} SELECT 'p' || CAST(k AS VARCHAR) || '/1' AS id FROM m1 UNION ALL SELECT 'p' || CAST(k AS VARCHAR) || '/2' FROM m2 WHERE k IN (SELECT k FROM m1) UNION ALL SELECT 'p' || CAST(k AS VARCHAR) || '/2' FROM m2 WHERE k NOT IN (SELECT k FROM m1)")
def interleave_pairs(spark, sf_dir):
    a, b = _mates(spark, sf_dir)
    return pairing.interleave_pairs(a, b, on_unpaired="warn").select("id")


_MATE = f"translate(md5(CAST(k AS VARCHAR) || 'a') || md5(CAST(k AS VARCHAR) || 'b') || md5(CAST(k AS VARCHAR) || 'c'), '{HEX}', '{LETTERS.replace('N', 'A')}')"


@query("merge_pairs", f"WITH {MATES} SELECT 'p' || CAST(k AS VARCHAR) AS id, {_MATE} AS sequence, CAST(96 AS INTEGER) AS length FROM m2")
def merge_pairs(spark, sf_dir):
    a, b = _mates(spark, sf_dir)
    b = records.transform(b, reverse_complement=True)
    return pairing.merge_pairs(a, b).select("id", "sequence", "length")


@query("zip_with", f"WITH {READS}, {OTHERS}, x AS (SELECT id, row_number() OVER (ORDER BY o) AS n FROM reads), y AS (SELECT id, row_number() OVER (ORDER BY o) AS n FROM others) SELECT x.id AS a, y.id AS b FROM x JOIN y ON x.n = y.n")
def zip_with(spark, sf_dir):
    return pairing.zip_with(*_both(spark, sf_dir), lambda a, b: [F.col(a)["id"].alias("a"), F.col(b)["id"].alias("b")]).select("a", "b")


@query("interleave", f"WITH {READS}, {OTHERS}, x AS (SELECT id, (row_number() OVER (ORDER BY o) - 1) * 2 AS n FROM reads), y AS (SELECT id, (row_number() OVER (ORDER BY o) - 1) * 2 + 1 AS n FROM others) SELECT id, n AS ord FROM x UNION ALL SELECT id, n FROM y")
def interleave(spark, sf_dir):
    return pairing.interleave(*_both(spark, sf_dir), mode="lossless").select("id", F.col(ORD).alias("ord"))


@query("merge_intervals", f"WITH {BEDS}, m AS (SELECT *, max(en) OVER (PARTITION BY chromosome ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM beds), i AS (SELECT *, sum(CASE WHEN p IS NULL OR st > p THEN 1 ELSE 0 END) OVER (PARTITION BY chromosome ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT chromosome, CAST(min(st) AS BIGINT) AS start, CAST(max(en) AS BIGINT) AS \"end\" FROM i GROUP BY chromosome, k")
def merge_intervals(spark, sf_dir):
    return intervals.merge_overlapping(beds(spark, sf_dir).drop(ORD))


@query("interval_stats", f'WITH {BEDS} SELECT count(*) AS "count", CAST(sum(en - st) AS BIGINT) AS total_length, round(avg(en - st), 6) AS average_length, CAST(min(en - st) AS BIGINT) AS min_length, CAST(max(en - st) AS BIGINT) AS max_length FROM beds')
def interval_stats(spark, sf_dir):
    return intervals.interval_stats(beds(spark, sf_dir)).withColumn("average_length", _r("average_length"))


@query("interval_overlaps", f"WITH {BEDS}, y AS (SELECT p_partkey AS o, 'c' || CAST(p_partkey % 50 AS VARCHAR) AS chromosome, p_partkey * 40 + 20 AS st, p_partkey * 40 + 20 + p_size AS en FROM part) SELECT x.o AS a, y.o AS b FROM beds x JOIN y ON x.chromosome = y.chromosome AND x.st < y.en AND y.st < x.en")
def interval_overlaps(spark, sf_dir):
    k = F.col("p_partkey")
    parts = _table(spark, sf_dir, "part").select(k.alias(ORD), F.concat(F.lit("c"), (k % 50).cast("string")).alias("chromosome"), (k * 40 + 20).alias("start"), (k * 40 + 20 + F.col("p_size")).alias("end"))
    return intervals.overlaps(beds(spark, sf_dir), parts).select(F.col(ORD).alias("a"), F.col(f"b_{ORD}").alias("b"))


@query("gtf_features", "SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ord, 'GENCODE' AS source_database, CASE WHEN l_linenumber = 1 THEN 'protein_coding' ELSE 'lincRNA' END AS gene_type, 'g' || CAST(l_partkey AS VARCHAR) AS gene_id, CAST(2 AS BIGINT) AS n_tags FROM lineitem WHERE l_suppkey % 2 = 0 AND l_partkey >= 10 AND l_partkey + 100 <= 1500")
def gtf_features(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    text = F.concat(F.lit('gene_id "g'), F.col("l_partkey").cast("string"), F.lit('"; gene_type "'), F.when(F.col("l_linenumber") == 1, "protein_coding").otherwise("lincRNA"), F.lit('"; tag "basic"; tag "CCDS"; level 2;'))
    g = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(ORD), F.concat(F.lit("s"), (F.col("l_suppkey") % 2).cast("string")).alias("seqname"), F.lit("gene").alias("feature"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 100).alias("end"), coords.gtf_attributes(text).alias("attributes"))
    g = g.withColumn("normalized", coords.gtf_normalized(F.col("attributes")))
    q = intervals.FeatureQuery(g).filter_by_feature("gene").filter_by_region("s0:10-1500").df
    return q.select(F.col(ORD).alias("ord"), F.col("normalized.source_database").alias("source_database"), F.col("normalized.gene_type").alias("gene_type"), F.col("attributes")["gene_id"][0].alias("gene_id"), _long(F.size("normalized.tags")).alias("n_tags"))


@query("spreadsheet_safe", """SELECT p_partkey AS ord, CASE WHEN regexp_matches(f, '^0+[0-9A-Za-z]') OR regexp_matches(f, '^(?i:MAR|SEP)[0-9]+$') OR regexp_matches(f, '^[=+-]') THEN '"' || f || '"' ELSE f END AS field FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'MAR' WHEN 1 THEN '00' WHEN 2 THEN '=' ELSE 'x' END || CAST(p_size AS VARCHAR) AS f FROM part)""")
def spreadsheet_safe(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    lead = F.when(F.col("p_partkey") % 4 == 0, "MAR").when(F.col("p_partkey") % 4 == 1, "00").when(F.col("p_partkey") % 4 == 2, "=").otherwise("x")
    return p.select(F.col("p_partkey").alias("ord"), tabular.spreadsheet_safe(F.concat(lead, F.col("p_size").cast("string"))).alias("field"))


@query("tabular_text", f"WITH {READS} SELECT id, printf('%.2f', floor({GC} * 100 + 0.5) / 100) AS gc, CAST(length(s) AS VARCHAR) AS length, CAST({_n('A')} AS VARCHAR) AS base_count_A FROM reads")
def tabular_text(spark, sf_dir):
    return tabular.as_text(tabular.to_tabular(reads(spark, sf_dir), ["id", "gc", "length", "base_count_A"])).drop(ORD)


@query("split_by_size", f"WITH {READS}, n AS (SELECT id, row_number() OVER (ORDER BY o) - 1 AS r FROM reads) SELECT id, CAST(r // 300 + 1 AS VARCHAR) AS part_id, CAST(r % 300 + 1 AS BIGINT) AS sequence_count FROM n")
def split_by_size(spark, sf_dir):
    return splitting.split(reads(spark, sf_dir), "by-size", sequences_per_file=300).select("id", "part_id", _long("sequence_count").alias("sequence_count"))


@query("split_by_id", f"WITH {READS}, n AS (SELECT o, id, CASE WHEN regexp_matches(id, 'read_[1-3]') THEN regexp_extract(id, 'read_([1-3])', 1) ELSE 'ungrouped' END AS part_id FROM reads) SELECT id, part_id, row_number() OVER (PARTITION BY part_id ORDER BY o) AS sequence_count FROM n")
def split_by_id(spark, sf_dir):
    return splitting.split(reads(spark, sf_dir), "by-id", id_regex="read_([1-3])").select("id", "part_id", _long("sequence_count").alias("sequence_count"))


@query(
    "split_by_length",
    f"""WITH RECURSIVE {READS}, c AS (SELECT id, row_number() OVER (ORDER BY o) AS r, length(s) AS n, sum(length(s)) OVER (ORDER BY o) AS upto FROM reads), a AS (SELECT r, upto - n + 5000 AS full FROM c),
 nx AS MATERIALIZED (SELECT a.r, min(c.r) AS n FROM a JOIN c ON c.upto > a.full AND c.upto <= a.full + 64 GROUP BY a.r), w AS (SELECT CAST(1 AS BIGINT) AS r UNION ALL SELECT nx.n FROM w JOIN nx ON w.r = nx.r),
 m AS (SELECT c.*, sum(CASE WHEN w.r IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY c.r) AS part FROM c LEFT JOIN w ON c.r = w.r)
 SELECT id, CAST(part AS VARCHAR) AS part_id, row_number() OVER (PARTITION BY part ORDER BY r) AS sequence_count FROM m""",
)
def split_by_length(spark, sf_dir):
    return splitting.split(reads(spark, sf_dir), "by-length", bases_per_file=5000).select("id", "part_id", _long("sequence_count").alias("sequence_count"))


@query("faidx_regions", f"WITH {CONTIGS} SELECT 'part_3:5-20' AS id, substr(s, 5, 16) AS sequence FROM contigs WHERE id = 'part_3' UNION ALL SELECT 'part_7:100', substr(s, 100, 1) FROM contigs WHERE id = 'part_7' UNION ALL SELECT 'part_9:20-5', {RC.replace('translate(s,', 'translate(substr(s, 5, 16),')} FROM contigs WHERE id = 'part_9' UNION ALL SELECT 'part_4', s FROM contigs WHERE id = 'part_4'")
def faidx_regions(spark, sf_dir):
    return regions.faidx(contigs(spark, sf_dir), ["part_3:5-20", "part_7:100", "part_9:20-5", "part_4"]).select("id", "sequence")


@query("fai_index", f"WITH {READS}, z AS (SELECT o, id, length(s) AS n, length(id) + 1 + length(description) + 2 AS h FROM reads) SELECT id AS name, CAST(n AS BIGINT) AS length, CAST(coalesce(sum(h + n + (n + 49) // 50) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + h AS BIGINT) AS \"offset\", CAST(least(n, 50) AS BIGINT) AS linebases, CAST(least(n, 50) + 1 AS BIGINT) AS linewidth FROM z")
def fai_index(spark, sf_dir):
    return regions.fai_index(reads(spark, sf_dir), 50).drop(ORD)


@query("to_fastq", f"WITH {READS} SELECT id, repeat('5', length(s)) AS quality, 'fastq' AS format FROM reads")
def to_fastq(spark, sf_dir):
    return records.to_fastq(records.to_fasta(reads(spark, sf_dir)), score=20).select("id", "quality", "format")


@query("text_grep", "SELECT doc_id AS ord, regexp_replace(coalesce(source, ''), '^src', 'S') AS id FROM documents WHERE contains(text, 'License')")
def text_grep(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias(ORD), F.coalesce("source", F.lit("")).alias("id"), F.col("text").alias("description"), F.lit("A").alias("sequence"))
    return records.replace(conform(search.grep(d, "License", "description")), "^src", "S").select(F.col(ORD).alias("ord"), "id")
