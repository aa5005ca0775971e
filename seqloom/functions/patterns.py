"""Searching patterns in sequences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.bases import IUPAC
from seqloom.functions.bind import let
from seqloom.functions.kernels import codes, letters, padded
from seqloom.schema import require

HITS = "array<struct<start:int,end:int,mismatches:int>>"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def escape_regex(text: str) -> str:
    """text as a pattern that matches itself, in Java's and Python's syntax."""
    return re.sub(r"([\\^$.|?*+()\[\]{}\-#&~])", r"\\\1", text)


def iupac_regex(pattern: str) -> str:
    """An IUPAC pattern as character classes by overlap: a sequence letter matches if it stands for a
    base that the pattern letter stands for."""
    out = []
    for p in pattern.upper():
        allowed = set(IUPAC.get(p, p))
        said = sorted(k for k, v in IUPAC.items() if allowed & set(v)) or [escape_regex(p)]
        out.append("[" + "".join(said) + "".join(said).lower() + "]")
    return "".join(out)


def running(values: Column, combine: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """array<int>: combine over each value and all before it, for an array<int> that is bound to a name;
    start changes nothing. Each step combines the array with itself shifted by twice as many places, so
    the work is n log n, where growing an array by one value at a time would take n * n."""
    shifts = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(values))
    return F.aggregate(shifts, values, lambda a, d: F.zip_with(a, F.concat(F.array_repeat(F.lit(start), d), F.slice(a, 1, F.size(a) - d)), combine))


def prefix_sums(values: Column) -> Column:
    """array<int>: the running totals of an array<int> that is bound to a name."""
    return running(values, lambda x, y: x + y)


#: Characters of a block of a long text.
BLOCK = 1024


def blocks(text: str | Column) -> Column:
    """array<string>: a text in blocks of BLOCK characters. Spark finds a place in a text by walking from
    its start; in blocks, many places of a long text cost one walk."""
    t = _c(text)
    return F.when(F.length(t) <= BLOCK, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def taken(held: Column, start: Column, end: Column) -> Column:
    """The characters from start to end (0-based, half-open) of a text in blocks."""

    def of(a: Column, b: Column) -> Column:
        first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        part = lambda i: F.substr(F.get(held, i), F.greatest(a - i * BLOCK, F.lit(0)) + 1, F.least(b - i * BLOCK, F.lit(BLOCK)) - F.greatest(a - i * BLOCK, F.lit(0)))
        return F.when(a >= b, "").when(first == last, part(first)).otherwise(F.array_join(F.transform(F.sequence(first, last), part), ""))

    return let(start.cast("int"), lambda a: let(end.cast("int"), lambda b: of(a, b)))


def positions(seq: str | Column, regex: str) -> Column:
    """array<int>: all places, overlapping ones too, where the regex matches; 0-based. Splitting at a
    lookahead gives the pieces between places; their lengths give the places."""
    s = _c(seq)
    pieces = F.split(s, f"(?={regex})", -1)
    lengths = F.transform(pieces, lambda x: F.length(x))
    inner = let(let(lengths, lambda n: F.slice(n, 1, F.greatest(F.size(n) - 1, F.lit(0)))), prefix_sums)
    return F.when(F.rlike(s, F.lit(f"^(?:{regex})")), F.concat(F.array(F.lit(0)), inner)).otherwise(inner)


def find_exact(seq: str | Column, pattern: str) -> Column:
    """array<int>: places of a literal pattern, overlapping ones too."""
    require(len(pattern) > 0, "empty pattern")
    return positions(seq, escape_regex(pattern))


def find_ambiguous(seq: str | Column, pattern: str) -> Column:
    """array<int>: places of an IUPAC pattern."""
    require(len(pattern) > 0, "empty pattern")
    return positions(seq, iupac_regex(pattern))


def regex_hits(text: str | Column, regex: str) -> Column:
    """array<struct<start, end, value>>: matches from left to right without overlap. The texts between
    matches and the matches themselves give the places. The regex must match at least one character."""
    s = _c(text)

    def of(matches: Column) -> Column:
        between = F.slice(F.split(s, regex, -1), 1, F.size(matches))
        ends = let(F.zip_with(between, matches, lambda b, m: F.length(b) + F.length(m)), prefix_sums)
        return F.zip_with(matches, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))

    return let(F.regexp_extract_all(s, F.lit(f"({regex})"), F.lit(1)), of)


def _masks(pattern: str, iupac: bool, ignore_case: bool) -> np.ndarray:
    """table[i, byte]: whether the byte matches the pattern's i-th letter."""
    table = np.zeros((len(pattern), 256), bool)
    for i, p in enumerate(pattern):
        if iupac and p.upper() in IUPAC:
            allowed = set(IUPAC[p.upper()])
            for k, v in IUPAC.items():
                if allowed & set(v):
                    table[i, [ord(k), ord(k.lower())]] = True
        else:
            table[i, ord(p) & 255] = True
            if ignore_case or iupac:
                table[i, [ord(p.upper()) & 255, ord(p.lower()) & 255]] = True
    return table


def hamming_hits(seq: str | Column, pattern: str, k: int = 0, iupac: bool = False, ignore_case: bool = False) -> Column:
    """HITS: all places with at most k substitutions, overlapping ones too, by start. One pass over all
    letters of a batch for each letter of the pattern."""
    require(len(pattern) > 0 and k >= 0, "hamming search takes a pattern and k >= 0")
    table, m = _masks(pattern, iupac, ignore_case), len(pattern)

    @F.arrow_udf(HITS)
    def of(texts: pa.Array) -> pa.Array:
        x, starts, lengths = letters(texts)
        wrong = np.zeros(max(0, len(x) - m + 1), np.uint16 if m < 1 << 16 else np.int32)
        for i in range(m):
            wrong += ~table[i][x[i : len(x) - m + 1 + i]]
        row = np.repeat(np.arange(len(lengths)), lengths)
        at = np.flatnonzero(wrong <= k)
        at = at[at + m <= (starts + lengths)[row[at]]]  # a place may not run into the next row
        start = (at - starts[row[at]]).astype(np.int32)
        hits = pa.StructArray.from_arrays([pa.array(start), pa.array(start + np.int32(m)), pa.array(wrong[at].astype(np.int32))], names=["start", "end", "mismatches"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=len(lengths)))]).astype(np.int32)), hits)

    return of(_c(seq))


def fuzzy_positions(seq: str | Column, pattern: str, k: int) -> Column:
    return F.transform(hamming_hits(seq, pattern, k), lambda h: h["start"])


def edit_ends(text: bytes, pattern: str, k: int, masks: dict[int, int]) -> Iterator[int]:
    """Ends of substrings within edit distance k of the pattern, by the bit-parallel method of Myers."""
    m = len(pattern)
    top, full = 1 << (m - 1), (1 << m) - 1
    pv, mv, score = full, 0, m
    for i, ch in enumerate(text):
        eq = masks.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score <= k:
            yield i + 1


def _bit_masks(pattern: str, iupac: bool, ignore_case: bool) -> dict[int, int]:
    table = _masks(pattern, iupac, ignore_case)
    out: dict[int, int] = {}
    for i, byte in zip(*np.nonzero(table), strict=True):
        out[int(byte)] = out.get(int(byte), 0) | 1 << int(i)
    return out


#: Letters of a long sequence that are searched as one row.
STRETCH = 2048


def _any_within_edits(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pattern: str, k: int, masks: dict[int, int]) -> np.ndarray:
    """For each row of letters whether it holds the pattern within k edits: the method of edit_ends over
    all rows at once, a letter of each at a time. Long rows are cut into stretches that overlap by the
    longest match, so that any match lies in one."""
    m = len(pattern)
    step = STRETCH - (m + k)
    pieces = np.maximum(1, -(-(lengths - (m + k)) // step))
    row = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[row] + nth * step
    size = np.minimum((starts + lengths)[row] - begin, STRETCH)
    order = np.argsort(-size, kind="stable")
    row, begin, size = row[order], begin[order], size[order]
    eq_of = np.zeros(256, np.uint64)
    for byte, mask in masks.items():
        eq_of[byte] = mask
    one, full, top = np.uint64(1), np.uint64((1 << m) - 1), np.uint64(m - 1)
    pv, mv = np.full(len(row), full), np.zeros(len(row), np.uint64)
    score, best = np.full(len(row), m, np.int32), np.full(len(row), m, np.int32)
    for i in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -i, side="left"))  # rows with more than i letters
        p, q = pv[:n], mv[:n]
        eq = eq_of[x[begin[:n] + i]]
        xv = eq | q
        xh = (((eq & p) + p) ^ p) | eq
        ph, mh = q | (~(xh | p) & full), p & xh
        score[:n] += (ph >> top & one).astype(np.int32) - (mh >> top & one).astype(np.int32)
        np.minimum(best[:n], score[:n], out=best[:n])
        ph, mh = ph << one & full, mh << one & full
        pv[:n], mv[:n] = mh | (~(xv | ph) & full), ph & xv
    out = np.zeros(len(lengths), bool)
    out[row[best <= k]] = True
    return out & (lengths >= m)


def has_within_edits(seq: str | Column, patterns: list[str], k: int, iupac: bool = False, ignore_case: bool = False) -> Column:
    """Whether a substring lies within edit distance k of one of the patterns. A sequence shorter than a
    pattern does not match it."""
    compiled = [(p, _bit_masks(p, iupac, ignore_case)) for p in patterns]

    @F.arrow_udf("boolean")
    def of(texts: pa.Array) -> pa.Array:
        x, starts, lengths = letters(texts)
        out = np.zeros(len(lengths), bool)
        for p, masks in compiled:
            if len(p) < 64:
                out |= _any_within_edits(x, starts, lengths, p, k, masks)
            else:  # masks of Python's long integers
                held = x.tobytes()
                out |= np.array([len(p) <= n and next(edit_ends(held[a : a + n], p, k, masks), None) is not None for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)], bool)
        return pa.array(out)

    return of(_c(seq))


#: Rows whose tables of common endings are kept at once.
TABLES = 256


def longest_common_substring(a: str | Column, b: str | Column) -> Column:
    """The longest, the first in a of those. A letter of a at a time, for many rows at once: how long a
    common substring ends at each letter of b."""

    @F.pandas_udf("string")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        xs, ys = ([t or "" for t in side] for side in (left, right))
        for k in range(0, len(xs), TABLES):
            some = xs[k : k + TABLES]
            x, _ = padded(some, 0)
            y, _ = padded(ys[k : k + TABLES], 1)  # no letter has these codes, and they differ
            table = np.zeros((len(some), y.shape[1] + 1), np.int32)
            best, end = np.zeros(len(some), np.int32), np.zeros(len(some), np.int64)
            for i in range(x.shape[1]):
                table[:, 1:] = np.where(y == x[:, i, None], table[:, :-1] + 1, 0)
                longest = table.max(1)
                better = longest > best
                best[better], end[better] = longest[better], i + 1
            out += [t[e - n : e] for t, e, n in zip(some, end.tolist(), best.tolist(), strict=True)]
        return pd.Series(out)

    return of(_c(a), _c(b))


def palindromes(seq: str | Column, min_length: int = 4, max_length: int | None = None) -> Column:
    """array<struct<start, end>> of substrings that read the same backwards, by start, then length. All
    centres of a batch grow together, as long as their ends agree."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def of(texts: pa.Array) -> pa.Array:
        x, starts, lengths = codes(texts)
        row = np.repeat(np.arange(len(lengths)), lengths)
        found = []
        for step in (0, 1):  # around a letter, and between two
            a = np.arange(len(x))
            b, r = a + step, row
            while len(a):
                inside = (a >= starts[r]) & (b < (starts + lengths)[r])
                if max_length:
                    inside &= b - a < max_length
                a, b, r = a[inside], b[inside], r[inside]
                same = x[a] == x[b]
                a, b, r = a[same], b[same], r[same]
                long = b - a + 1 >= min_length
                found.append(np.stack([r[long], a[long] - starts[r[long]], b[long] + 1 - starts[r[long]]]))
                a, b = a - 1, b + 1
        r, begin, end = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
        order = np.lexsort((end, begin, r))
        places = pa.StructArray.from_arrays([pa.array(begin[order].astype(np.int32)), pa.array(end[order].astype(np.int32))], names=["start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(lengths)))]).astype(np.int32)), places)

    return of(_c(seq))


def tandem_repeats(seq: str | Column, min_unit: int = 1, max_unit: int = 6, min_repeats: int = 2) -> Column:
    """array<struct<start, end, unit, repeats>>: from left to right, at each place the shortest unit
    that repeats; the scan goes on after the repeat."""
    units = "|".join(f"(.{{{u}}})\\{u - min_unit + 1}{{{min_repeats - 1},}}" for u in range(min_unit, max_unit + 1))

    @F.pandas_udf("array<struct<start:int,end:int,unit:string,repeats:int>>")
    def of(texts: pd.Series) -> pd.Series:
        scan = re.compile(units, re.S).finditer
        return pd.Series([[{"start": m.start(), "end": m.end(), "unit": m[m.lastindex], "repeats": (m.end() - m.start()) // len(m[m.lastindex])} for m in scan(t or "")] for t in texts])

    return of(_c(seq))
