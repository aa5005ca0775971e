"""Parts of sequences: windows, k-mers, subsequences, translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import bases, codons, patterns
from seqloom.functions.bind import let
from seqloom.functions.coords import end_position, parse_region, start_position
from seqloom.schema import ORD, require

#: Windows that are cut from one stretch of a long sequence: a window then costs its own length and not
#: its distance from the sequence's start.
STRETCH = 4096


def windows(df: DataFrame, size: int, step: int = 1, greedy: bool = False, circular: bool = False, suffix: str = "_window", zero_based: bool = False) -> DataFrame:
    """One row for each window of `size` bases every `step`: whole ones, and past the end wrapped
    (circular) or short (greedy) ones. Ids get `<suffix>:<start>-<end>`."""
    require(0 < size < 1_000_000, "size is from 1 to 999,999")
    require(step >= 1, "step is positive")
    require(not circular or step <= size, "circular windows take a step up to their size")
    require(len(suffix) < 100, "the suffix is shorter than 100")
    n = F.col("_n")
    last = n - 1 if circular or greedy else n - size  # last start
    count = F.when(last >= 0, F.floor(last / step) + 1).otherwise(0).cast("long")
    keep = [c for c in df.columns if c not in ("sequence", "length", "quality")]
    base = df.select(*keep, "sequence", F.length("sequence").alias("_n")).withColumn("_count", count).filter("_count > 0")
    width = (STRETCH - 1) * step + size

    def piece(x, first):
        begin, whole = first * step, x["n"]
        own = patterns.taken(x["held"], begin, F.least(whole, begin + width))
        return F.concat(own, patterns.taken(x["held"], F.lit(0), F.least(F.greatest(F.lit(0), F.least(F.lit(size), begin + width - whole)), whole))) if circular else own

    firsts = F.sequence(F.lit(0).cast("long"), F.col("_count") - 1, F.lit(STRETCH).cast("long"))
    bound = F.struct(patterns.blocks("sequence").alias("held"), firsts.alias("firsts"), n.alias("n"))
    pieces = let(bound, lambda x: F.transform(x["firsts"], lambda first: F.struct(first.alias("first"), piece(x, first).alias("piece"))))
    cut = base.select(*keep, "_n", "_count", F.explode(pieces).alias("_p")).select(*keep, "_n", "_count", F.col("_p.first").alias("_first"), F.col("_p.piece").alias("_piece"))
    one = cut.select(*keep, "_n", "_piece", "_first", F.explode(F.sequence(F.col("_first"), F.least(F.col("_first") + STRETCH, F.col("_count")) - 1)).alias("window_index"))
    start = F.col("window_index") * step
    end = start + size
    stop = end if circular else F.least(end, n)
    shown_start = start if zero_based else start + 1
    shown_end = stop if zero_based else F.least(stop, n)
    text = F.substr("_piece", (start - F.col("_first") * step + 1).cast("int"), F.lit(size))
    made = {
        "original_id": F.col("id"),
        "sequence": text,
        "length": F.length(text),
        "kmer_size": F.lit(size),
        "step_size": F.lit(step),
        "start_position": shown_start,
        "end_position": shown_end,
        "coordinate_system": F.lit("0-based" if zero_based else "1-based"),
        "suffix": F.lit(suffix),
        "is_wrapped": end > n if circular else F.lit(False),
        "window_index": F.col("window_index").cast("int"),
    }
    new_id = F.concat("id", F.lit(f"{suffix}:"), shown_start.cast("string"), F.lit("-"), shown_end.cast("string"))
    return one.select(*[new_id.alias("id") if c == "id" else F.col(c) for c in keep if c not in made or c == "id"], *[v.alias(k) for k, v in made.items()])


def kmers(df: DataFrame, k: int, **options) -> DataFrame:
    return windows(df, k, **options)


def count_kmers(df: DataFrame, k: int, step: int = 1) -> DataFrame:
    """(sequence, n): how often each k-mer occurs; counted by task before the shuffle."""
    return windows(df, k, step).groupBy("sequence").agg(F.count(F.lit(1)).alias("n"))


def subseq(
    df: DataFrame, region: str | None = None, regions: list[str] | None = None, start: int | None = None, end: int | None = None, upstream: int | None = None, downstream: int | None = None,
    only_flank: bool = False, one_based: bool = True, strand: str = "+", circular: bool = False, include_coordinates: bool = False, coordinate_separator: str = ":", concatenate: bool = False,
    id_pattern: str | None = None, id_list: list[str] | None = None,
) -> DataFrame:
    """Regions of the records: `a:b` (negative numbers count from the end, -1 is the end), several of
    them, or start and end. Flanks are clamped, or wrap when circular; only_flank gives the flanks alone;
    strand - gives the reverse complement; empty results go. With id_pattern or id_list, other records
    go, and those alone are only a filter. concatenate joins all regions of a record."""
    if id_pattern is not None:
        df = df.filter(F.rlike("id", F.lit(id_pattern)))
    if id_list is not None:
        df = df.filter(F.col("id").isin(list(id_list)))
    ways = [region is not None, regions is not None, start is not None or end is not None]
    if not any(ways):
        require(id_pattern is not None or id_list is not None, "subseq takes a region, regions, start and end, or ids")
        return df
    require(sum(ways) == 1, "one way to name regions")
    require(strand in ("+", "-"), "strand is + or -")
    require(not only_flank or upstream is not None or downstream is not None, "only_flank takes upstream or downstream")
    wanted = [parse_region(region)] if region else [parse_region(r) for r in regions] if regions else [(start if start is not None else (1 if one_based else 0), end if end is not None else -1)]
    n = F.length("sequence")
    spans = F.array(*[F.struct(start_position(a, n, one_based).alias("a"), end_position(b, n).alias("b"), F.lit(i).alias("i")) for i, (a, b) in enumerate(wanted)])
    rows = df.withColumn("_n", n).select("*", F.explode(spans).alias("_r"))
    a, b, size = F.col("_r")["a"], F.col("_r")["b"], F.col("_n")
    up, down = upstream or 0, downstream or 0
    if circular:
        a2 = F.when(a - up < 0, size + a - up).otherwise(a - up)
        b2 = F.when(b + down > size, (b + down) % size).otherwise(b + down)
    else:
        a2, b2 = F.greatest(a - up, F.lit(0)), F.least(b + down, size)

    def part(c: str, x: Column, y: Column) -> Column:
        plain = F.substr(c, x + 1, F.greatest(y - x, F.lit(0)))
        if not circular:
            return plain
        return F.when(x >= y, F.concat(F.substr(c, x + 1), F.substr(c, F.lit(1), y))).otherwise(plain)

    def taken(c: str) -> Column:
        if only_flank:
            return F.concat(F.substr(c, F.greatest(a - up, F.lit(0)) + 1, F.least(a, F.lit(up))), F.substr(c, b + 1, F.lit(down)))
        return part(c, a2, b2)

    s = taken("sequence")
    flipped = strand == "-" and not only_flank
    new = {"sequence": bases.reverse_complement(s) if flipped else s}
    if "quality" in df.columns:
        new["quality"] = F.reverse(taken("quality")) if flipped else taken("quality")
    if include_coordinates:
        sep = F.lit(coordinate_separator)
        new["id"] = F.concat("id", sep, (a2 + 1 if one_based else a2).cast("string"), sep, b2.cast("string"))
    out = rows.withColumns(new).filter(F.length("sequence") > 0)
    if concatenate:
        joined = {c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_r")["i"].alias("i"), F.col(c).alias("c")))), lambda x: x["c"]), "") for c in ("sequence", "quality") if c in df.columns}
        firsts = [F.first(c).alias(c) for c in df.columns if c not in (ORD, "sequence", "quality", "length", "id")]
        per = out.withColumn("_id", F.col("id")).groupBy(ORD).agg(F.min("id").alias("id"), *firsts, *[v.alias(k) for k, v in joined.items()])
        return per.withColumn("length", F.length("sequence")).select(*df.columns)
    return out.withColumn("length", F.length("sequence")).select(*df.columns)


def subseq_by_features(df: DataFrame, features: DataFrame, one_based: bool = False, by_strand: bool = False, feature_type: str | None = None, include_coordinates: bool = False, separator: str = ":") -> DataFrame:
    """The records' parts under intervals: features has chromosome, start, end and maybe strand and
    feature. BED intervals are 0-based; GTF ones 1-based. One equi-join on the name; Catalyst broadcasts
    features when they are small, and otherwise shuffles both sides."""
    f = features if feature_type is None else features.filter(F.col("feature") == feature_type)
    strand = F.col("strand") if "strand" in features.columns else F.lit("+")
    f = f.select(F.col("chromosome").alias("_chrom"), (F.col("start") - (1 if one_based else 0)).alias("_a"), F.col("end").alias("_b"), strand.alias("_strand"))
    rows = df.join(f, df["id"] == f["_chrom"])
    n = F.length("sequence")
    a, b = F.greatest(F.col("_a"), F.lit(0)).cast("int"), F.least(F.col("_b"), n).cast("int")
    s = F.substr("sequence", a + 1, F.greatest(b - a, F.lit(0)))
    turn = by_strand & (F.col("_strand") == "-") if by_strand else F.lit(False)
    new = {"sequence": F.when(turn, bases.reverse_complement(s)).otherwise(s)}
    if "quality" in df.columns:
        part = F.substr("quality", a + 1, F.greatest(b - a, F.lit(0)))
        new["quality"] = F.when(turn, F.reverse(part)).otherwise(part)
    if include_coordinates:
        new["id"] = F.concat("id", F.lit(separator), (a + 1 if one_based else a).cast("string"), F.lit(separator), b.cast("string"))
    return rows.withColumns(new).filter(F.length("sequence") > 0).withColumn("length", F.length("sequence")).select(*df.columns)


def translate(
    df: DataFrame, code: int = 1, frames: list[int] | None = None, all_frames: bool = False, convert_start_codons: bool = False, remove_stop_codons: bool = False, stop_codon_char: str = "*",
    unknown_codon_char: str = "X", min_orf_length: int | None = None, include_frame_in_id: bool = False, trim_at_first_stop: bool = False, allow_alternative_starts: bool = False, orfs_only: bool = False,
) -> DataFrame:
    """Proteins, one record for each record and frame; with orfs_only the first reading frame of each.
    Records without a protein of min_orf_length go."""
    frames = [1, 2, 3, -1, -2, -3] if all_frames else frames or [1]
    require(all(f in (1, 2, 3, -1, -2, -3) for f in frames), "frames are 1 to 3 and -1 to -3")

    def protein(f: int) -> Column:
        if orfs_only:
            return codons.first_orf("sequence", code, f, min_orf_length or 1, convert_start_codons, allow_alternative_starts, remove_stop_codons, stop_codon_char)
        return codons.translate("sequence", code, f, convert_start_codons, allow_alternative_starts, remove_stop_codons, trim_at_first_stop, stop_codon_char, unknown_codon_char)

    made = F.array(*[F.struct(F.lit(f).alias("frame"), protein(f).alias("p")) for f in frames])
    rows = df.select("*", F.explode(made).alias("_t"))
    ok = F.col("_t")["p"].isNotNull() & (F.length(F.col("_t")["p"]) >= (min_orf_length or (1 if orfs_only else 0)))
    name = F.concat("id", F.lit("_frame_"), F.format_string("%+d", F.col("_t")["frame"])) if include_frame_in_id else F.col("id")
    out = rows.filter(ok).withColumns({"id": name, "sequence": F.col("_t")["p"], "frame": F.col("_t")["frame"]})
    if include_frame_in_id and "description" in df.columns:
        out = out.withColumn("description", F.concat_ws(" ", F.nullif("description", F.lit("")), F.format_string("frame=%+d", F.col("frame"))))
    if "quality" in df.columns:
        out = out.withColumns({"quality": F.lit(None).cast("string"), "format": F.lit("fasta")} if "format" in df.columns else {"quality": F.lit(None).cast("string")})
    return out.withColumn("length", F.length("sequence")).drop("_t")


def find_orfs(df: DataFrame, code: int = 1, min_length: int = 20) -> DataFrame:
    """One row for each reading frame on both strands."""
    return df.select(ORD, "id", F.explode(codons.find_orfs("sequence", code, min_length)).alias("o")).select(ORD, "id", "o.*")


def faidx(df: DataFrame, regions: list[str], on_error: str = "throw") -> DataFrame:
    """Regions `name`, `name:pos`, `name:a-b`, `name:a-`, `name:-b`, 1-based and inclusive; negative
    starts count from the end; a start over the end gives the reverse complement. The regions are a small
    literal table, so the join is by broadcast of what the caller wrote."""
    import re

    parsed = []
    for i, r in enumerate(regions):
        m = re.fullmatch(r"(.+?)(?::(-?\d+)?(?:(-)(\d+)?)?)?", r)
        require(m is not None, f"region {r!r} is not name:start-end")
        a = int(m[2]) if m[2] else None
        b = int(m[4]) if m[4] else (None if m[3] or a is None else a)
        parsed.append((i, r, m[1], a, b))
    spark = df.sparkSession
    wanted = spark.createDataFrame(parsed, "_i int, _region string, _name string, _a long, _b long")
    j = F.broadcast(wanted).join(df, wanted["_name"] == df["id"], "left") if on_error == "throw" else df.join(F.broadcast(wanted), wanted["_name"] == df["id"])
    n = F.length("sequence")
    a = F.when(F.col("_a").isNull(), F.lit(1)).when(F.col("_a") < 0, n + F.col("_a") + 1).otherwise(F.col("_a"))
    b = F.when(F.col("_b").isNull(), n).when(F.col("_b") < 0, n + F.col("_b") + 1).otherwise(F.col("_b"))
    low, high = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), n)
    s = F.substr("sequence", low.cast("int"), F.greatest(high - low + 1, F.lit(0)).cast("int"))
    s = F.when(a > b, bases.reverse_complement(s)).otherwise(s)
    if on_error == "throw":
        s = F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("no sequence named "), F.col("_name")))).otherwise(s)
    return j.select(F.col("_i").cast("long").alias(ORD), F.col("_region").alias("id"), s.alias("sequence"), F.length(s).alias("length"))


def faidx_by_pattern(df: DataFrame, pattern: str) -> DataFrame:
    """Whole sequences whose name matches."""
    return df.filter(F.rlike("id", F.lit(pattern)))


def fai_index(df: DataFrame, line_width: int = 80) -> DataFrame:
    """(name, length, offset, linebases, linewidth) of a FASTA file that is written with these lines, in
    stream order. Offsets are prefix sums of record sizes, two-level like ranks."""
    n = F.length("sequence").cast("long")
    head = F.octet_length("id") + 1 + F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.octet_length("description") + 1).otherwise(0) + 1
    lines = F.ceil(n / line_width)
    sized = df.select(ORD, F.col("id").alias("name"), n.alias("length"), head.cast("long").alias("_head"), (head + n + lines).cast("long").alias("_size"), F.floor(F.col(ORD) / 65536).alias("_cell"))
    inside = F.coalesce(F.sum("_size").over(W.partitionBy("_cell").orderBy(ORD).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = sized.groupBy("_cell").agg(F.sum("_size").alias("_s"))
    starts = cells.select("_cell", F.coalesce(F.sum("_s").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = sized.withColumn("_in", inside).join(starts, "_cell")
    width = F.least(F.col("length"), F.lit(line_width))
    return out.select(ORD, "name", "length", (F.col("_before") + F.col("_in") + F.col("_head")).alias("offset"), width.alias("linebases"), (width + 1).alias("linewidth"))




def fai_of_file(spark, path: str) -> DataFrame:
    """(_ord, name, length, offset, linebases, linewidth) of FASTA files that exist, from their bytes: all
    lines of a record but the last must be of one width. Records are read as lines; their places are sums
    of sizes, first inside a split, then over the splits of a file, whose table is small."""
    from seqloom.sources.readers import _lines

    separator = "\n>"
    rows = _lines(spark, path, separator)
    size = (F.octet_length("value") + len(separator)).cast("long")
    in_split = W.partitionBy("_file", "_block").orderBy(ORD)
    told = rows.select("_file", "_block", ORD, "value", size.alias("_size"), F.coalesce(F.sum(size).over(in_split.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_in"))
    splits = rows.groupBy("_file", "_block").agg(F.sum(size).alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = told.join(F.broadcast(splits.select("_file", "_block", before.alias("_before"))), ["_file", "_block"])  # a row for each split
    head = F.substring_index("value", "\n", 1)
    # sums of sizes lead behind the sign of a record; a file's first one still holds it
    start = F.col("_before") + F.col("_in") + F.octet_length(head) + 1
    lines = F.filter(F.split(F.substr("value", F.length(head) + 2), "\n", -1), lambda x: x != "")
    bare = lambda x: F.regexp_replace(x, "\r$", "")
    name = F.regexp_extract(F.regexp_replace(head, "^>", ""), r"^(\S*)", 1)
    x = placed.select(ORD, name.alias("name"), start.alias("offset"), lines.alias("l"))
    bases_of = F.coalesce(F.length(bare(F.get("l", F.lit(0)))), F.lit(0))
    width = F.coalesce(F.length(F.get("l", F.lit(0))), F.lit(0)) + 1
    n = F.size("l")
    uneven = F.exists(F.slice("l", 1, F.greatest(n - 1, F.lit(0))), lambda y: F.length(bare(y)) != bases_of) | F.coalesce(F.length(bare(F.element_at("l", -1))) > bases_of, F.lit(False))
    total = F.aggregate("l", F.lit(0).cast("long"), lambda a, y: a + F.length(bare(y)))
    said = F.when((n > 0) & uneven, F.raise_error(F.concat(F.lit("lines of different widths in "), F.col("name")))).otherwise(F.col("name"))
    return x.filter(F.col("name") != "").select(ORD, said.alias("name"), total.alias("length"), F.col("offset").cast("long"), bases_of.cast("long").alias("linebases"), width.cast("long").alias("linewidth"))
