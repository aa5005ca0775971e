"""Paired reads: matching, interleaving, zipping, merging."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.bases import COMPLEMENT_FROM, COMPLEMENT_TO
from seqloom.functions.coords import pair_id, pair_side
from seqloom.operators.ranking import with_number, with_rank
from seqloom.schema import ORD, PairSyncError, require

UNPAIRED = ("skip", "warn", "error")


def _sides(df: DataFrame, other: DataFrame | None, key: Column | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with `_pid` and `_n`, the number of the read among those of its name."""

    def named(d: DataFrame) -> DataFrame:
        d = d.withColumn("_pid", key if key is not None else pair_id("id"))
        return with_number(d, ["_pid"], "_n")

    if other is not None:
        return named(df), named(other)
    # one stream: the side from the name's mark, otherwise by arrival, first and second in turn
    all_reads = df.withColumn("_pid", key if key is not None else pair_id("id"))
    arrived = with_number(all_reads, ["_pid"], "_arrival")
    sided = arrived.withColumn("_side", F.coalesce(pair_side("id"), (F.col("_arrival") - 1) % 2 + 1)).drop("_arrival")
    numbered = with_number(sided, ["_pid", "_side"], "_n")
    return numbered.filter("_side = 1").drop("_side"), numbered.filter("_side = 2").drop("_side")


def pairs(df: DataFrame, other: DataFrame | None = None, extract_pair_id: Callable[[Column], Column] | None = None, on_unpaired: str = "skip") -> DataFrame:
    """(_ord, id, r1, r2): reads of one name, the n-th of one side with the n-th of the other. Reads
    without partner go, or fail."""
    require(on_unpaired in UNPAIRED, f"unknown policy {on_unpaired!r}")
    key = extract_pair_id(F.col("id")) if extract_pair_id else None
    a, b = _sides(df, other, key)

    def packed(d: DataFrame, name: str) -> DataFrame:
        return d.select("_pid", "_n", F.struct(*[c for c in d.columns if c not in ("_pid", "_n")]).alias(name))

    how = "full_outer" if on_unpaired == "error" else "inner"
    joined = packed(a, "r1").join(packed(b, "r2"), ["_pid", "_n"], how)
    if on_unpaired == "error":
        alone = F.col("r1").isNull() | F.col("r2").isNull()
        joined = joined.withColumn("_pid", F.when(alone, F.raise_error(F.concat(F.lit("read without partner: "), F.col("_pid")))).otherwise(F.col("_pid")))
    return joined.select(F.greatest(F.col("r1")[ORD], F.col("r2")[ORD]).alias(ORD), F.col("_pid").alias("id"), "r1", "r2")


def interleave_pairs(df: DataFrame, other: DataFrame | None = None, extract_pair_id: Callable[[Column], Column] | None = None, on_unpaired: str = "skip") -> DataFrame:
    """The reads of the pairs, first and second in turn; warn keeps reads without partner."""
    require(on_unpaired in UNPAIRED, f"unknown policy {on_unpaired!r}")
    if on_unpaired != "warn":
        got = pairs(df, other, extract_pair_id, on_unpaired)
    else:
        key = extract_pair_id(F.col("id")) if extract_pair_id else None
        a, b = _sides(df, other, key)
        packed = lambda d, n: d.select("_pid", "_n", F.struct(*[c for c in d.columns if c not in ("_pid", "_n")]).alias(n))
        j = packed(a, "r1").join(packed(b, "r2"), ["_pid", "_n"], "full_outer")
        got = j.select(F.coalesce(F.greatest(F.col("r1")[ORD], F.col("r2")[ORD])).alias(ORD), F.col("_pid").alias("id"), "r1", "r2")
    return flatten_pairs(got)


def flatten_pairs(got: DataFrame) -> DataFrame:
    both = F.filter(F.array(F.struct(F.lit(0).alias("side"), F.col("r1").alias("r")), F.struct(F.lit(1).alias("side"), F.col("r2").alias("r"))), lambda x: x["r"].isNotNull())
    rows = got.select(F.col(ORD).alias("_pair"), F.explode(both).alias("x")).select("_pair", "x.side", "x.r.*")
    order = (F.col("_pair") * 2 + F.col("side")).alias(ORD)
    return rows.select(order, *[c for c in rows.columns if c not in ("_pair", "side", ORD)])


def zip_with(a: DataFrame, b: DataFrame, columns: Callable[[str, str], list[Column]] | None = None) -> DataFrame:
    """The n-th records of both, as structs a and b, up to the shorter side; columns("a", "b") may make
    the result's columns from them."""
    left = with_rank(a, "_rank").select("_rank", F.struct(*a.columns).alias("a"))
    right = with_rank(b, "_rank").select("_rank", F.struct(*b.columns).alias("b"))
    both = left.join(right, "_rank").select((F.col("_rank") - 1).alias(ORD), "a", "b")
    return both if columns is None else both.select(ORD, *columns("a", "b"))


def interleave(a: DataFrame, b: DataFrame, mode: str = "strict", validate_ids: bool = False, comparator: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """a1, b1, a2, b2, ...: strict fails where the sides differ in number, lossless appends the rest.
    validate_ids fails where the ids of a pair differ."""
    require(mode in ("strict", "lossless"), f"unknown mode {mode!r}")
    left, right = with_rank(a, "_rank"), with_rank(b, "_rank")
    if mode == "strict":
        n_a, n_b = a.count(), b.count()
        if n_a != n_b:
            raise PairSyncError(f"{n_a} and {n_b} records")
    if validate_ids:
        same = comparator or (lambda x, y: x == y)
        pair = left.select("_rank", F.col("id").alias("x")).join(right.select("_rank", F.col("id").alias("y")), "_rank")
        bad = pair.filter(~same(F.col("x"), F.col("y"))).limit(1).collect()
        if bad:
            raise PairSyncError(f"ids differ: {bad[0]['x']} and {bad[0]['y']}")
    rows = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return rows.withColumn(ORD, (F.col("_rank") - 1) * 2 + F.col("_side")).drop("_rank", "_side")


def paired_records(r1: DataFrame, r2: DataFrame, check_ids: str | None = None) -> DataFrame:
    """Two files in lock step: (_ord, id, r1, r2); fails where one is longer. check_ids: throw, warn or
    skip for pairs whose names differ."""
    require(check_ids in (None, "throw", "warn", "skip"), f"unknown policy {check_ids!r}")
    left = with_rank(r1, "_rank").select("_rank", F.struct(*r1.columns).alias("r1"))
    right = with_rank(r2, "_rank").select("_rank", F.struct(*r2.columns).alias("r2"))
    both = left.join(right, "_rank", "full_outer")
    alone = F.col("r1").isNull() | F.col("r2").isNull()
    name = F.when(alone, F.raise_error(F.lit("the files differ in length"))).otherwise(pair_id(F.col("r1")["id"]))
    differ = name != pair_id(F.col("r2")["id"])
    if check_ids == "throw":
        name = F.when(differ, F.raise_error(F.concat(F.lit("names differ: "), F.col("r1")["id"]))).otherwise(name)
    out = both.select((F.col("_rank") - 1).alias(ORD), name.alias("id"), "r1", "r2")
    return out.filter(pair_id(F.col("r1")["id"]) == pair_id(F.col("r2")["id"])) if check_ids == "skip" else out


#: Pairs whose overlaps are searched at once.
ROWS = 1000


def _padded(rows: list[bytes], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one width, and their lengths."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.full((len(rows), max(1, int(lengths.max(initial=0)))), pad, np.uint8)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
    return out, lengths


def best_overlaps(first: list[bytes], second: list[bytes], diff_max: int, min_overlap: int, diff_percent: float, min_comparisons: int) -> list[int | None]:
    """For each pair the place in the first read where the second (already turned) begins, negative if it
    begins before: the first, from the longest overlap on, with few enough differences among comparable
    bases. All pairs of a group are tried at one shift after the other."""
    out: list[int | None] = []
    for k in range(0, len(first), ROWS):
        (a, la), (b, lb) = _padded(first[k : k + ROWS], 0), _padded(second[k : k + ROWS], 1)
        found, open_ = np.zeros(len(la), np.int64), np.ones(len(la), bool)
        for shift in [*range(0, int(la.max(initial=0)) - min_overlap + 1), *range(-1, -(int(lb.max(initial=0)) - min_overlap) - 1, -1)]:
            x0, y0 = max(0, shift), max(0, -shift)
            n = np.minimum(la - x0, lb - y0)
            rows = np.flatnonzero(open_ & (n >= max(1, min_overlap)))
            if not len(rows):
                continue
            n = n[rows]
            w = int(n.max())
            x, y = a[rows, x0 : x0 + w], b[rows, y0 : y0 + w]
            known = (x != 78) & (y != 78) & (np.arange(w) < n[:, None])
            wrong = ((x != y) & known).sum(1)
            good = rows[(known.sum(1) >= min_comparisons) & (wrong <= np.minimum(diff_max, diff_percent * n))]
            found[good], open_[good] = shift, False
        out += [None if o else s for o, s in zip(open_.tolist(), found.tolist(), strict=True)]
    return out


def turned(seq: str) -> bytes:
    return seq.upper().translate(_TURN)[::-1].encode("latin-1")


_TURN = str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO)


def merge_one(first: bytes, q1: str, second: bytes, q2: str, shift: int, max_quality: int, validate: float | None, correct: bool) -> tuple[str, str] | None:
    """Consensus of two reads (the second turned) that overlap at shift, or None. Where they agree the
    qualities add up to max_quality; where they differ the better base stays with the difference of
    qualities."""
    a, b = np.frombuffer(first, np.uint8), np.frombuffer(second, np.uint8)
    qa, qb = np.frombuffer(q1.encode("latin-1"), np.uint8).astype(int) - 33, np.frombuffer(q2[::-1].encode("latin-1"), np.uint8).astype(int) - 33
    lo = max(0, shift)
    n = min(len(a) - lo, len(b) - (lo - shift))
    x, y, qx, qy = a[lo : lo + n], b[lo - shift : lo - shift + n], qa[lo : lo + n], qb[lo - shift : lo - shift + n]
    same = x == y
    if validate is not None and same.mean() < validate:
        return None
    first = (qx >= qy) | ((y == 78) & (x != 78))
    if correct:
        base = np.where(same | first, x, y)
        score = np.where(same, np.minimum(qx + qy, max_quality), np.maximum(np.abs(qx - qy), 2))
    else:
        base, score = x, np.minimum(qx, max_quality)
    head, head_q = a[:lo], qa[:lo]
    end_b = lo - shift + n
    tail, tail_q = b[end_b:], qb[end_b:]
    if shift < 0:  # b begins before a: what sticks out on either side is adapter
        head, head_q, tail, tail_q = a[:0], qa[:0], b[:0], qb[:0]
    whole = np.concatenate([head, base, tail]).astype(np.uint8)
    quality = (np.concatenate([np.minimum(head_q, max_quality), score, np.minimum(tail_q, max_quality)]) + 33).astype(np.uint8)
    return whole.tobytes().decode("latin-1"), quality.tobytes().decode("latin-1")


#: Least share of equal bases in an overlap.
VALIDATION = {"loose": 0.6, "normal": 0.75, "strict": 0.9}


def merge_pairs(
    df: DataFrame, other: DataFrame | None = None, overlap_diff_max: int = 5, min_overlap: int = 10, diff_percent_max: float = 0.2, min_comparisons: int = 10, max_output_quality: int = 40,
    validation: str = "normal", validate_overlap: bool = True, correct_overlap: bool = True, on_no_overlap: str = "keep", extract_pair_id: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One read for each pair whose ends overlap; other pairs are kept as two reads, skipped, or fail."""
    require(on_no_overlap in ("keep", "skip", "error"), f"unknown policy {on_no_overlap!r}")
    require(validation in VALIDATION, f"unknown validation {validation!r}")
    both = pairs(df, other, extract_pair_id)
    least = VALIDATION[validation] if validate_overlap else None

    @F.pandas_udf("sequence string, quality string")
    def merged(s1: pd.Series, q1: pd.Series, s2: pd.Series, q2: pd.Series) -> pd.DataFrame:
        first, second = [s.upper().encode("latin-1") for s in s1], [turned(s) for s in s2]
        shifts = best_overlaps(first, second, overlap_diff_max, min_overlap, diff_percent_max, min_comparisons)
        got = [
            (None if shift is None else merge_one(a, qa, b, qb, shift, max_output_quality, least, correct_overlap)) or (None, None)
            for a, qa, b, qb, shift in zip(first, q1, second, q2, shifts, strict=True)
        ]
        return pd.DataFrame(got, columns=["sequence", "quality"])

    tried = both.withColumn("_m", merged(F.col("r1")["sequence"], F.col("r1")["quality"], F.col("r2")["sequence"], F.col("r2")["quality"]))
    ok = F.col("_m")["sequence"].isNotNull()
    one = F.col("r1")
    for c, v in {"id": F.col("id"), "sequence": F.col("_m")["sequence"], "quality": F.col("_m")["quality"], "length": F.length(F.col("_m")["sequence"])}.items():
        one = one.withField(c, v)
    if on_no_overlap == "error":
        one = F.when(ok, one).otherwise(F.raise_error(F.concat(F.lit("no overlap: "), F.col("id"))))
        return flatten_pairs(tried.select(ORD, "id", one.alias("r1"), F.lit(None).alias("r2")))
    none = F.lit(None)
    second = F.when(~ok, F.col("r2")) if on_no_overlap == "keep" else none
    first = F.when(ok, one).otherwise(F.col("r1")) if on_no_overlap == "keep" else F.when(ok, one)
    got = tried.select(ORD, "id", first.alias("r1"), second.alias("r2"))
    if on_no_overlap == "skip":
        rows = got.filter(F.col("r1").isNotNull()).select((F.col(ORD) * 2).alias("_o"), "r1.*")
        return rows.select(F.col("_o").alias(ORD), *[c for c in rows.columns if c not in ("_o", ORD)])
    return flatten_pairs(got)
