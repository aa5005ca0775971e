"""Record-wise operators: filters, transformations, cleaning, qualities, names."""

from __future__ import annotations

import os
import pickle
import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import bases, quality
from seqloom.functions.bind import let
from seqloom.functions.patterns import escape_regex
from seqloom.operators.ranking import with_rank
from seqloom.schema import ORD, require, with_sequence

#: Lists of ids longer than this are joined instead of written into the plan.
IN_LIST = 1000


def filter_records(
    df: DataFrame,
    min_length: int | None = None,
    max_length: int | None = None,
    min_gc: float | None = None,
    max_gc: float | None = None,
    pattern: str | None = None,
    ids: Iterable[str] | DataFrame | None = None,
    exclude_ids: Iterable[str] | DataFrame | None = None,
    has_ambiguous: bool | None = None,
    min_mapq: int | None = None,
    max_mapq: int | None = None,
    exclude_flags: int | None = None,
    include_flags: int | None = None,
    reference_sequence: str | None = None,
    region: str | None = None,
    custom: Column | None = None,
) -> DataFrame:
    """Records that meet all conditions; bounds are inclusive. A pattern may match the id or the
    sequence; anything but A, C, G, T and U counts as ambiguous. Conditions on alignments hold for
    alignment records only, others pass them."""
    require(min_length is None or max_length is None or min_length <= max_length, "min_length is over max_length")
    require(min_gc is None or max_gc is None or min_gc <= max_gc, "min_gc is over max_gc")
    length = F.length("sequence")
    tests: list[Column] = []
    if min_length is not None:
        tests.append(length >= min_length)
    if max_length is not None:
        tests.append(length <= max_length)
    for given, keep in ((ids, True), (exclude_ids, False)):
        if given is None:
            continue
        if not isinstance(given, DataFrame):
            given = list(given)
            if len(given) <= IN_LIST:
                tests.append(F.col("id").isin(given) if keep else ~F.col("id").isin(given))
                continue
            given = df.sparkSession.createDataFrame([(x,) for x in given], "id string")
        df = df.join(given.select("id").distinct(), "id", "left_semi" if keep else "left_anti").select(*df.columns)
    aligned = F.col("flag").isNotNull() if "flag" in df.columns else F.lit(False)
    on_alignments: list[Column] = []
    if min_mapq is not None:
        on_alignments.append(F.col("mapping_quality") >= min_mapq)
    if max_mapq is not None:
        on_alignments.append(F.col("mapping_quality") <= max_mapq)
    if exclude_flags is not None:
        on_alignments.append(F.col("flag").bitwiseAND(F.lit(exclude_flags)) == 0)
    if include_flags is not None:
        on_alignments.append(F.col("flag").bitwiseAND(F.lit(include_flags)) == include_flags)
    if reference_sequence is not None:
        on_alignments.append(F.col("reference_sequence") == reference_sequence)
    if region is not None:
        m = re.fullmatch(r"(.+):(\d+)-(\d+)", region)
        require(m is not None and int(m[2]) <= int(m[3]), f"region {region!r} is not name:start-end")
        last = F.col("position") + length - 1
        on_alignments.append((F.col("reference_sequence") == m[1]) & (F.col("position") > 0) & (F.col("position") <= int(m[3])) & (last >= int(m[2])))
    if on_alignments and "flag" in df.columns:
        tests += [~aligned | F.coalesce(t, F.lit(False)) for t in on_alignments]
    if pattern is not None:
        tests.append(F.rlike("id", F.lit(pattern)) | F.rlike("sequence", F.lit(pattern)))
    if min_gc is not None:
        tests.append(bases.gc_content("sequence") >= min_gc)
    if max_gc is not None:
        tests.append(bases.gc_content("sequence") <= max_gc)
    if has_ambiguous is not None:
        odd = F.rlike("sequence", F.lit("[^ACGTUacgtu]"))
        tests.append(odd if has_ambiguous else ~odd)
    if custom is not None:
        tests.append(custom)
    for t in tests:
        df = df.filter(t)
    return df


def transform(
    df: DataFrame, reverse: bool = False, complement: bool = False, reverse_complement: bool = False, to_rna: bool = False, to_dna: bool = False, upper_case: bool = False, lower_case: bool = False,
    custom: Callable[[Column], Column] | None = None, trim_soft_clips: bool = False, reverse_quality: bool = False,
) -> DataFrame:
    """In this order: soft clips; reverse complement, or complement and reverse; RNA or DNA letters;
    case; custom. Qualities keep their order unless reverse_quality."""
    require(not (to_rna and to_dna), "to_rna and to_dna exclude each other")
    require(not (upper_case and lower_case), "upper_case and lower_case exclude each other")
    if trim_soft_clips:
        df = remove_soft_clips(df)
    s = F.col("sequence")
    rna = F.contains(F.upper(F.col("sequence")), F.lit("U"))
    if reverse_complement:
        s = F.reverse(F.when(rna, bases.complement(s, rna=True)).otherwise(bases.complement(s)))
    else:
        if complement:
            s = F.when(rna, bases.complement(s, rna=True)).otherwise(bases.complement(s))
        if reverse:
            s = F.reverse(s)
    if to_rna:
        s = bases.to_rna(s)
    if to_dna:
        s = bases.to_dna(s)
    if upper_case:
        s = F.upper(s)
    if lower_case:
        s = F.lower(s)
    if custom:
        s = custom(s)
    flip = reverse_quality and (reverse or reverse_complement) and "quality" in df.columns
    return with_sequence(df, s, F.reverse("quality") if flip else None)


def remove_soft_clips(df: DataFrame) -> DataFrame:
    """Alignments without the bases that their cigar clips at either end; unchanged if none would stay."""
    lead = F.coalesce(F.regexp_extract("cigar", r"^(\d+)S", 1).try_cast("int"), F.lit(0))
    tail = F.coalesce(F.regexp_extract("cigar", r"\d+[MIDNHP=X](\d+)S$", 1).try_cast("int"), F.lit(0))
    stay = F.length("sequence") - lead - tail
    does = F.col("cigar").isNotNull() & (lead + tail > 0) & (stay > 0)
    rest = F.regexp_replace(F.regexp_replace("cigar", r"^\d+S", ""), r"\d+S$", "")
    part = lambda c: F.when(does, F.substr(c, lead + 1, stay)).otherwise(F.col(c))
    return df.withColumns({"sequence": part("sequence"), "quality": part("quality"), "cigar": F.when(does, F.when(rest == "", "*").otherwise(rest)).otherwise(F.col("cigar"))}).withColumn("length", F.length("sequence"))


def clean(df: DataFrame, remove_gaps: bool = False, gap_chars: str = ".-*", replace_ambiguous: bool = False, replace_char: str = "N", trim_whitespace: bool = False, remove_empty: bool = False) -> DataFrame:
    """White space, then gaps, then ambiguous letters, then empty records. Qualities are left as they are."""
    require(len(replace_char) == 1, "replace_char is one character")
    s = F.col("sequence")
    if trim_whitespace:
        s = F.regexp_replace(s, r"^\s+|\s+$", "")
        if "description" in df.columns:
            df = df.withColumn("description", F.regexp_replace("description", r"^\s+|\s+$", ""))
    if remove_gaps:
        s = bases.remove_gaps(s, gap_chars)
    if replace_ambiguous:
        s = bases.replace_ambiguous(s, replace_char)
    out = with_sequence(df, s)
    return out.filter(F.length("sequence") > 0) if remove_empty else out


def validate(df: DataFrame, sequence_type: str = "dna", allow_ambiguous: bool = True, allow_gaps: bool = False, action: str = "reject", fix_char: str = "N", observation=None) -> DataFrame:
    """reject drops records with other letters, fix replaces those, warn keeps them and counts them in
    the observation if one is given. Gaps are stripped first unless allow_gaps."""
    require(action in ("reject", "fix", "warn"), f"unknown action {action!r}")
    require(sequence_type in ("dna", "rna", "protein"), f"unknown sequence type {sequence_type!r}")
    mode = "protein" if sequence_type == "protein" else f"{'normal' if allow_ambiguous else 'strict'}_{sequence_type}"
    out = df if allow_gaps else with_sequence(df, bases.remove_gaps("sequence"))
    if action == "fix":
        return with_sequence(out, bases.replace_invalid("sequence", mode, fix_char))
    if action == "warn":
        return out.observe(observation, F.count_if(~bases.is_valid("sequence", mode)).alias("invalid")) if observation is not None else out
    return out.filter(bases.is_valid("sequence", mode))


def convert_quality(df: DataFrame, target: str, source: str | None = None) -> DataFrame:
    """Qualities in another encoding; the source is the option, else the record's own, else detected."""
    require(target in quality.ENCODINGS, f"unknown quality encoding {target!r}")
    own = F.lit(source) if source else F.coalesce("quality_encoding", quality.detect_encoding("quality"))
    if source:
        changed = quality.convert("quality", source, target)
    else:
        changed = F.col("quality")
        for e in quality.ENCODINGS:
            if e != target:
                changed = F.when(own == e, quality.convert("quality", e, target)).otherwise(changed)
    has = F.col("quality").isNotNull()
    return df.withColumns({"quality": F.when(has, changed), "quality_encoding": F.when(has, F.lit(target)).otherwise(F.col("quality_encoding"))})


def to_fastq(df: DataFrame, char: str | None = None, score: int | None = None, encoding: str = "phred33") -> DataFrame:
    """Records with one constant quality."""
    require(char is None or score is None, "a quality character or a score, not both")
    c = quality.score_to_char(score, encoding) if score is not None else char or "I"
    require(len(c) == 1, "the quality is one character")
    return df.withColumns({"format": F.lit("fastq"), "quality": F.repeat(F.lit(c), F.length("sequence")), "quality_encoding": F.lit(encoding)})


def to_fasta(df: DataFrame, include_quality_stats: bool = False, encoding: str = "phred33") -> DataFrame:
    """Records without qualities; their statistics may go to the description."""
    if include_quality_stats:
        said = F.format_string("avg_qual=%.2f min_qual=%d max_qual=%d", quality.average("quality", encoding), quality.minimum("quality", encoding), quality.maximum("quality", encoding))
        df = df.withColumn("description", F.when(F.col("quality").isNull(), F.col("description")).otherwise(F.concat_ws(" ", F.nullif("description", F.lit("")), said)))
    return df.withColumns({"format": F.lit("fasta"), "quality": F.lit(None).cast("string"), "quality_encoding": F.lit(None).cast("string")})


def quality_filter(
    df: DataFrame, min_score: float | None = None, max_score: float | None = None, trim: bool = False, trim_threshold: float = 20, trim_window: int = 4, trim_from_start: bool = True, trim_from_end: bool = True,
    bins: int | None = None, preset: str | None = None, boundaries: list[float] | None = None, encoding: str = "phred33",
) -> DataFrame:
    """Trims by window means (a read without a good window goes), then filters by mean score, then bins.
    Records without qualities pass."""
    has = F.col("quality").isNotNull()
    if trim:
        cut = df.withColumn("_t", F.when(has, quality.trim_range("quality", trim_threshold, trim_window, trim_from_start, trim_from_end, encoding)))
        part = lambda c: F.when(has, F.substr(c, F.col("_t")["start"] + 1, F.col("_t")["end"] - F.col("_t")["start"])).otherwise(F.col(c))
        df = cut.filter(~has | (F.col("_t")["end"] > F.col("_t")["start"])).withColumns({"sequence": part("sequence"), "quality": part("quality")}).withColumn("length", F.length("sequence")).drop("_t")
    if min_score is not None or max_score is not None:
        mean = quality.average("quality", encoding)
        ok = F.lit(True)
        if min_score is not None:
            ok = ok & (mean >= min_score)
        if max_score is not None:
            ok = ok & (mean <= max_score)
        df = df.filter(~has | ok)
    if bins is not None or boundaries is not None:
        df = df.withColumn("quality", F.when(has, quality.binned("quality", quality.boundaries_of(bins, preset, boundaries), encoding)))
    return df


def bin_distribution(df: DataFrame, boundaries: list[float], encoding: str = "phred33") -> DataFrame:
    """(bin, n): how many bases fall into each bin."""
    score = F.explode(quality.scores("quality", encoding)).alias("score")
    index = F.lit(len(boundaries))
    for i in range(len(boundaries) - 1, -1, -1):
        index = F.when(F.col("score") < boundaries[i], i).otherwise(index)
    return df.select(score).groupBy("score").count().groupBy(index.alias("bin")).agg(F.sum("count").alias("n"))


_PLACEHOLDER = re.compile(r"\$(\d+)|\{(kv|nr|fn|fbn|fbne)\}")


def replace(
    df: DataFrame, pattern: str, replacement: str, by_seq: bool = False, ignore_case: bool = False, nr_width: int = 1, file_name: str | None = None,
    kv: dict[str, str] | DataFrame | None = None, key_capture: int = 1, keep_key: bool = False, keep_untouched: bool = False, key_miss: str | None = None,
    filter_patterns: list[str] | None = None, filter_by: str = "id", filter_regex: bool = False, filter_ignore_case: bool = False, filter_invert: bool = False,
) -> DataFrame:
    """Replaces the first match of a regular expression in the id, or in the sequence of records without
    quality. The replacement may hold $1 and so on, {kv} (the value for a captured key, from a dict or a
    DataFrame of key and value), {nr} (number among the records that the filter lets through) and {fn},
    {fbn}, {fbne} (file name, its base name, without extension). Keys without value: the match stays
    (keep_untouched), else the key (keep_key), else key_miss, else nothing. Records that the filter does
    not let through are unchanged and not numbered."""
    target = "sequence" if by_seq else "id"
    if by_seq and "quality" in df.columns:
        df = df.withColumn("sequence", F.when(F.col("quality").isNull(), F.col("sequence")).otherwise(F.raise_error(F.lit("sequences are replaced in FASTA records only"))))
    flags = "(?i)" if ignore_case else ""
    groups = re.compile(pattern).groups
    columns = df.columns
    passes = F.lit(True)
    if filter_patterns:
        where = {"id": F.col("id"), "name": F.concat_ws(" ", "id", F.coalesce("description", F.lit(""))), "sequence": F.col("sequence")}[filter_by]
        some = F.lit(False)
        for p in filter_patterns:
            some = some | F.rlike(where, F.lit(("(?i)" if filter_ignore_case else "") + (p if filter_regex else escape_regex(p))))
        passes = ~some if filter_invert else some
    if "{nr}" in replacement:
        numbered = with_rank(df.filter(passes), "_nr")
        df = numbered.unionByName(df.filter(~passes).withColumn("_nr", F.lit(None).cast("long"))) if filter_patterns else numbered

    def group(n: int) -> Column:
        return F.regexp_extract(target, f"{flags}{pattern}", n) if n <= groups else F.lit("")

    untouched = F.lit(False)
    if "{kv}" in replacement:
        require(kv is not None and 1 <= key_capture <= groups, "{kv} takes a key-value table and a capture group")
        key = group(key_capture)
        if isinstance(kv, DataFrame):
            pairs = kv.select(F.col("key").alias("_key"), F.col("value").alias("_value")).dropDuplicates(["_key"])
            df = df.withColumn("_k", key).join(pairs, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")
            value: Column = F.col("_value")
        else:
            value = F.try_element_at(F.create_map(*[F.lit(x) for p in kv.items() for x in p]), key) if kv else F.lit(None).cast("string")
        if keep_untouched:
            untouched = value.isNull()
        value = F.coalesce(value, key if keep_key else F.lit(key_miss or ""))
    base = os.path.basename(file_name) if file_name and file_name != "-" else "stdin"
    names = {"fn": file_name if file_name and file_name != "-" else "stdin", "fbn": base, "fbne": os.path.splitext(base)[0]}
    parts: list[Column] = []
    at = 0
    for m in _PLACEHOLDER.finditer(replacement):
        parts.append(F.lit(replacement[at : m.start()]))
        at = m.end()
        if m[1]:
            parts.append(group(int(m[1])))
        elif m[2] == "kv":
            parts.append(value)
        elif m[2] == "nr":
            parts.append(F.lpad(F.col("_nr").cast("string"), F.greatest(F.lit(nr_width), F.length(F.col("_nr").cast("string"))), F.lit("0")))
        else:
            parts.append(F.lit(names[m[2]]))
    new = F.concat(*parts, F.lit(replacement[at:]))
    # the text before the first match, and what the match holds
    before = F.get(F.split(F.col(target), f"{flags}{pattern}", 2), F.lit(0))
    match = F.regexp_extract(target, f"{flags}({pattern})", 1)
    hit = F.rlike(target, F.lit(f"{flags}{pattern}"))
    changed = let(F.struct(before.alias("b"), match.alias("m")), lambda x: F.concat(x["b"], new, F.substr(F.col(target), F.length(x["b"]) + F.length(x["m"]) + 1)))
    df = df.withColumn(target, F.when(passes & hit & ~untouched, changed).otherwise(F.col(target)))
    return df.withColumn("length", F.length("sequence")).select(*columns)


def read_key_values(spark, path: str) -> DataFrame:
    """(key, value) of a tab-delimited file; lines that start with # are comments."""
    lines = spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    parts = F.split("value", "\t", 2)
    value = F.when(F.size(parts) == 2, parts[1]).otherwise(F.raise_error(F.concat(F.lit("no key and value in: "), F.col("value"))))
    return lines.select(parts[0].alias("key"), value.alias("value"))


def map_records(df: DataFrame, fn: Callable[[dict], dict], schema: T.StructType | str | None = None) -> DataFrame:
    """fn over each record, in batches."""
    schema = schema or df.schema
    names = T._parse_datatype_string(schema).fieldNames() if isinstance(schema, str) else schema.fieldNames()

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([fn(r) for r in batch.to_dict("records")], columns=names)

    return df.mapInPandas(run, schema)


def flat_map(df: DataFrame, fn: Callable[[dict], Iterable[dict]], schema: T.StructType | str | None = None) -> DataFrame:
    """All records that fn returns for each record."""
    schema = schema or df.schema
    names = T._parse_datatype_string(schema).fieldNames() if isinstance(schema, str) else schema.fieldNames()

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([x for r in batch.to_dict("records") for x in fn(r)], columns=names)

    return df.mapInPandas(run, schema)


def fold(df: DataFrame, fn: Callable, initial):
    """Left fold in stream order; rows pass through the driver one partition at a time."""
    total = initial
    for row in df.orderBy(ORD).toLocalIterator():
        total = fn(total, row.asDict())
    return total


def fold_parts(df: DataFrame, step: Callable, merge: Callable, initial):
    """A fold in parallel, for steps that do not hang on order: every task folds its records from
    `initial`, and merge(a, b) joins the results, one for each partition. `fold` is for small inputs and
    steps that need stream order."""

    def run(batches):
        import pandas as pd

        total = initial
        for batch in batches:
            for r in batch.to_dict("records"):
                total = step(total, r)
        yield pd.DataFrame({"v": [pickle.dumps(total)]})

    parts = (pickle.loads(bytes(r["v"])) for r in df.mapInPandas(run, "v binary").toLocalIterator())
    return reduce(merge, parts, initial)


def reduce_records(df: DataFrame, fn: Callable):
    """Left fold that starts with the first record; None for no records."""
    rows = (r.asDict() for r in df.orderBy(ORD).toLocalIterator())
    total = next(rows, None)
    for row in rows:
        total = fn(total, row)
    return total


def for_each(df: DataFrame, fn: Callable[[dict], None]) -> None:
    df.foreach(lambda row: fn(row.asDict()))


def tap(df: DataFrame, fn: Callable[[dict], None]) -> DataFrame:
    """fn sees each record as it passes, on the executors."""

    def run(batches):
        for batch in batches:
            for r in batch.to_dict("records"):
                fn(r)
            yield batch

    return df.mapInPandas(run, df.schema)


def check(df: DataFrame) -> DataFrame:
    """Fails on records whose quality and sequence differ in length."""
    bad = F.col("quality").isNotNull() & (F.length("quality") != F.length("sequence"))
    return df.withColumn("sequence", F.when(bad, F.raise_error(F.concat(F.lit("quality and sequence differ in length: "), F.col("id")))).otherwise(F.col("sequence")))


