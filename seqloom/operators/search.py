"""Searching records: grep, locate, amplicons."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import bases, patterns
from seqloom.functions.bind import let
from seqloom.functions.coords import end_position, start_position
from seqloom.schema import require

LONGEST_AMPLICON = 10_000


def _flip(pattern: str) -> str:
    table = str.maketrans(bases.COMPLEMENT_FROM + bases.COMPLEMENT_FROM.lower(), bases.COMPLEMENT_TO + bases.COMPLEMENT_TO.lower())
    return pattern.translate(table)[::-1]


def grep(
    df: DataFrame, pattern: str, target: str = "sequence", regex: bool = False, ignore_case: bool = False, invert: bool = False, whole_word: bool = False, allow_mismatches: int = 0, search_both_strands: bool = False
) -> DataFrame:
    """Records whose sequence, id or description holds the pattern. On sequences, mismatches are edits
    (substitutions, insertions, deletions), and a search on both strands reads IUPAC codes. Empty
    targets never match, so invert keeps them."""
    require(target in ("sequence", "id", "description"), f"unknown target {target!r}")
    require(len(pattern) > 0 and allow_mismatches >= 0, "grep takes a pattern and mismatches >= 0")
    t = F.col(target)
    flags = "(?i)" if ignore_case else ""
    if regex:
        hit = F.rlike(t, F.lit(flags + pattern))
    elif target == "sequence" and (allow_mismatches or search_both_strands):
        if allow_mismatches == 0:
            hit = F.rlike(t, F.lit(patterns.iupac_regex(pattern))) | F.rlike(t, F.lit(patterns.iupac_regex(_flip(pattern))))
        else:
            both = [pattern, _flip(pattern)] if search_both_strands else [pattern]
            hit = patterns.has_within_edits(t, both, allow_mismatches, search_both_strands, ignore_case)
    elif whole_word and target != "sequence":
        hit = F.rlike(t, F.lit(rf"{flags}\b{patterns.escape_regex(pattern)}\b"))
    elif ignore_case:
        hit = F.contains(F.lower(t), F.lit(pattern.lower()))
    else:
        hit = F.contains(t, F.lit(pattern))
    found = F.coalesce(hit, F.lit(False)) & (F.coalesce(F.length(t), F.lit(0)) > 0)
    return df.filter(~found if invert else found)


HIT = "array<struct<start:int,mismatches:int,strand:string,end:int>>"


def _greedy(hits: pa.Array) -> pa.Array:
    """Of sorted hits those that begin where the hit kept before has ended."""
    flat, offsets = hits.flatten(), hits.offsets.to_numpy()
    offsets = offsets - offsets[0]
    starts, ends = flat.field("start").to_pylist(), flat.field("end").to_pylist()
    kept, counts = [], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        last = -1
        for i in range(a, b):
            if starts[i] >= last:
                kept.append(i)
                last = ends[i]
        counts.append(len(kept))
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), flat.take(pa.array(kept, pa.int64())))


def _without_overlaps(hits: Column) -> Column:
    """From left to right, the better of those that begin together; what overlaps a hit kept before goes.
    An expression that gathers them one by one would copy its list each time."""
    fields = ("start", "mismatches", "strand", "end")
    return F.arrow_udf(_greedy, HIT)(F.sort_array(F.transform(hits, lambda h: F.struct(*[h[c].alias(c) for c in fields]))))


def locate(
    df: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = False, allow_mismatches: int = 0, search_both_strands: bool = False, allow_overlaps: bool = False,
    min_length: int = 1, max_matches: int | None = None, bed: bool = False,
) -> DataFrame:
    """One row for each place of the pattern, 0-based and half-open: sequence_id, start, end, length,
    strand, matched_sequence, mismatches (substitutions), score, pattern, and 10 bases of context unless
    bed. The minus strand is searched by the pattern's reverse complement, places are on the plus
    strand. max_matches limits the whole result in stream order."""
    require(len(pattern) > 0, "empty pattern")
    require(not (regex and allow_mismatches), "regular expressions take no mismatches")
    seq = F.col("sequence")

    one_literal = not (allow_mismatches or ignore_case or search_both_strands)

    def hits(p: str, strand: str) -> Column:
        if regex or (one_literal and not allow_overlaps):  # these do not overlap
            said = p if regex else patterns.escape_regex(p)
            raw = F.transform(patterns.regex_hits(seq, ("(?i)" if ignore_case else "") + said), lambda h: F.struct(h["start"], h["end"], F.lit(0).alias("mismatches")))
        elif allow_mismatches == 0 and not ignore_case:
            raw = F.transform(patterns.find_exact(seq, p), lambda s: F.struct(s.alias("start"), (s + len(p)).alias("end"), F.lit(0).alias("mismatches")))
        else:
            raw = patterns.hamming_hits(seq, p, allow_mismatches, ignore_case=ignore_case)
        return F.transform(raw, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["mismatches"].alias("mismatches"), F.lit(strand).alias("strand")))

    both = hits(pattern, "+")
    if search_both_strands and not regex:
        both = F.concat(both, hits(_flip(pattern), "-"))
    long_enough = F.filter(both, lambda h: h["end"] - h["start"] >= min_length)
    kept = long_enough if allow_overlaps or regex or one_literal else _without_overlaps(long_enough)

    def shown(h: Column, held: Column, n: Column) -> Column:
        start, end = h["start"], h["end"]
        wrong = h["mismatches"]
        score = F.lit(1.0) if regex else F.greatest(F.lit(0.0), 1 - wrong / float(len(pattern)))
        columns = [start.alias("start"), end.alias("end"), (end - start).alias("length"), h["strand"].alias("strand"), patterns.taken(held, start, end).alias("matched_sequence"), wrong.alias("mismatches"), score.alias("score")]
        if not bed:
            around = F.struct(patterns.taken(held, F.greatest(start - 10, F.lit(0)), start).alias("upstream"), patterns.taken(held, end, F.least(end + 10, n)).alias("downstream"))
            columns.append(around.alias("context"))
        return F.struct(*columns)

    # the texts are taken before the hits become rows, so that no row carries its whole sequence
    bound = F.struct(patterns.blocks(seq).alias("held"), kept.alias("hits"), F.length(seq).alias("n"))
    told = let(bound, lambda x: F.transform(x["hits"], lambda h: shown(h, x["held"], x["n"])))
    rows = df.select("_ord", F.col("id").alias("sequence_id"), F.explode(told).alias("h"))
    names = ["start", "end", "length", "strand", "matched_sequence", "mismatches", "score"]
    out = rows.select("_ord", "sequence_id", *[F.col("h")[c].alias(c) for c in names], F.lit(pattern).alias("pattern"), *([] if bed else [F.col("h")["context"].alias("context")]))
    return out if max_matches is None else out.orderBy("_ord", "start", "mismatches", "strand").limit(max_matches)


def amplicon(
    df: DataFrame, forward: str, reverse: str | None = None, max_mismatches: int = 0, region: str | None = None, flanking: bool = False, canonical: bool | None = None,
    search_window: tuple[int | None, int | None] | None = None, output_mismatches: bool = False,
) -> DataFrame:
    """The stretches between primer pairs, one record for each pair: by mismatches, then (canonical)
    how many primers were turned, then the longest first; ids get `_amplicon_<k>`. The reverse primer is
    searched by its reverse complement; in canonical search, which holds where there is no reverse primer
    or both are equal, both primers in both directions. flanking keeps the primers; search_window limits
    the search to so many first and last bases."""
    for p in (forward, reverse):
        require(p is None or (10 <= len(p) <= 50 and all(c in bases.IUPAC for c in p.upper())), "primers are 10 to 50 IUPAC letters")
    other = reverse or forward
    if canonical is None:
        canonical = reverse is None or reverse == forward
    first, last = search_window or (None, None)
    n = F.length("sequence")

    def side(jobs: list[tuple[str, int]], window: int | None, at_end: bool) -> Column:
        shift = F.greatest(n - window, F.lit(0)) if window and at_end else F.lit(0)
        text = F.substr("sequence", shift + 1, F.lit(window)) if window else F.col("sequence")
        found = []
        for p, turned in jobs:
            if max_mismatches == 0:
                raw = F.transform(patterns.find_ambiguous(text, p), lambda s: F.struct(s.alias("start"), F.lit(0).alias("mismatches")))
            else:
                raw = F.transform(patterns.hamming_hits(text, p, max_mismatches, iupac=True), lambda h: F.struct(h["start"].alias("start"), h["mismatches"].alias("mismatches")))
            found.append((raw, turned, len(p), shift))
        parts = [_shifted(raw, turned, m, sh) for raw, turned, m, sh in found]
        return F.concat(*parts)

    def _shifted(raw: Column, turned: int, m: int, shift: Column) -> Column:
        return F.transform(raw, lambda h: F.struct((h["start"] + shift).alias("at"), F.lit(m).alias("m"), h["mismatches"].alias("wrong"), F.lit(turned).alias("turned")))

    if canonical:
        left, right = side([(forward, 0), (_flip(forward), 1)], first, False), side([(other, 0), (_flip(other), 1)], last, True)
    else:
        left, right = side([(forward, 0)], first, False), side([(_flip(other), 0)], last, True)
    hit = df.withColumns({"_f": left, "_r": right})
    pairs = F.flatten(
        F.transform(
            "_f",
            lambda f: F.transform(
                F.filter("_r", lambda r: (f["at"] < r["at"]) & (r["at"] - f["at"] - f["m"]).between(1, LONGEST_AMPLICON)),
                lambda r: F.struct(
                    (f["wrong"] + r["wrong"]).alias("wrong"), (f["turned"] + r["turned"]).alias("turned"), (-(r["at"] - f["at"] - f["m"])).alias("shortness"), f["at"].alias("f_at"), f["m"].alias("f_m"), r["at"].alias("r_at"), r["m"].alias("r_m")
                ),
            ),
        )
    )
    rows = hit.withColumn("_p", F.array_sort(pairs)).drop("_f", "_r").select("*", F.posexplode("_p").alias("_k", "_a")).drop("_p")
    a = F.col("_a")
    start, end = (a["f_at"], a["r_at"] + a["r_m"]) if flanking else (a["f_at"] + a["f_m"], a["r_at"])
    if region is not None:
        import re

        number = re.match(r"\s*(-?\d+)", region)
        require(number is not None, f"region {region!r} does not begin with a number")
        shift = int(number[1])
        start = F.greatest(F.lit(0), start + start_position(shift, n))
        end = F.least(n, end + end_position(shift, n))
    said = F.format_string("Amplicon %s %d-%d (%dbp)", F.lit("flanking" if flanking else "inner"), a["f_at"] + a["f_m"], a["r_at"], -a["shortness"])
    if output_mismatches:
        said = F.concat(said, F.format_string(" [%d mismatches]", a["wrong"]))
    changed = {"id": F.concat("id", F.lit("_amplicon_"), (F.col("_k") + 1).cast("string")), "sequence": F.substr("sequence", start + 1, F.greatest(end - start, F.lit(0))), "description": said}
    if "quality" in df.columns:
        changed["quality"] = F.substr("quality", start + 1, F.greatest(end - start, F.lit(0)))
    return rows.withColumns(changed).withColumn("length", F.length("sequence")).select(*df.columns)


def best_hit(hits: Column) -> Column:
    """The hit with fewest mismatches, the first of those."""
    return let(F.array_sort(F.transform(hits, lambda h: F.struct(h["mismatches"].alias("mismatches"), h["start"].alias("start"), h["end"].alias("end")))), lambda x: F.get(x, F.lit(0)))
