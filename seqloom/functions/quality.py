"""Functions of a quality column: one character for each base, its code minus an offset the score."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions import kernels
from seqloom.functions.bind import let
from seqloom.schema import SeqError, require

# Offset, lowest and highest score of each encoding.
ENCODINGS = {"phred33": (33, 0, 93), "phred64": (64, 0, 62), "solexa": (64, -5, 62)}
# Bin boundaries by platform and number of bins.
PRESETS = {
    "illumina": {2: [20], 3: [15, 30], 5: [10, 20, 30, 35]},
    "pacbio": {2: [13], 3: [10, 20], 5: [7, 13, 20, 30]},
    "nanopore": {2: [10], 3: [7, 12], 5: [5, 9, 12, 18]},
}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def offset_of(encoding: str) -> int:
    require(encoding in ENCODINGS, f"unknown quality encoding {encoding!r}")
    return ENCODINGS[encoding][0]


def char_to_score(char: str, encoding: str = "phred33") -> int:
    score = ord(char) - offset_of(encoding)
    require(ENCODINGS[encoding][1] <= score <= ENCODINGS[encoding][2], f"{char!r} is no {encoding} character")
    return score


def score_to_char(score: int, encoding: str = "phred33") -> str:
    require(ENCODINGS[encoding][1] <= score <= ENCODINGS[encoding][2], f"{score} is no {encoding} score")
    return chr(score + offset_of(encoding))


def is_valid_score(score: float, encoding: str = "phred33") -> bool:
    return score == int(score) and ENCODINGS[encoding][1] <= score <= ENCODINGS[encoding][2]


def scores(quality: str | Column, encoding: str = "phred33") -> Column:
    """array<int>."""
    return F.transform(F.filter(F.split(_c(quality), ""), lambda x: x != ""), lambda x: F.ascii(x) - offset_of(encoding))


def from_scores(array: Column, encoding: str = "phred33") -> Column:
    return F.array_join(F.transform(array, lambda x: F.char(x + offset_of(encoding))), "")


def _alphabet(encoding: str) -> str:
    o, low, high = ENCODINGS[encoding]
    return "".join(chr(s + o) for s in range(low, high + 1))


def _round_half_up(x: float) -> int:
    return math.floor(x + 0.5)


def convert_score(score: int, source: str, target: str) -> int:
    """One score in another encoding; solexa scores are odds, so they go through probabilities."""
    if source == "solexa" and target != "solexa":
        t = 10 ** (-score / 10)
        score = _round_half_up(-10 * math.log10(t / (1 + t)))
    elif target == "solexa" and source != "solexa":
        p = 10 ** (-score / 10)
        score = -5 if p >= 0.999 else _round_half_up(-10 * math.log10(p / (1 - p)))
    _, low, high = ENCODINGS[target]
    return min(high, max(low, score))


def convert(quality: str | Column, source: str, target: str) -> Column:
    """One translate() with the table of all characters."""
    require(source in ENCODINGS and target in ENCODINGS, f"unknown quality encoding in {source} to {target}")
    if source == target:
        return _c(quality)
    chars = _alphabet(source)
    to = "".join(score_to_char(convert_score(char_to_score(x, source), source, target), target) for x in chars)
    return F.translate(_c(quality), chars, to)


def _measure(quality: str | Column, encoding: str, kind: str, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Column:
    """A number for each row from the scores of a whole batch. Lambdas over an array of characters say the
    same and take ten to twenty times as long. Null stays null."""
    offset = offset_of(encoding)

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        codes, lengths = kernels.flat(texts)
        out = pd.Series(of(codes.astype(np.int64) - offset, lengths))
        return out.where(texts.notna(), None)

    return run(_c(quality))


def total(quality: str | Column, encoding: str = "phred33") -> Column:
    return _measure(quality, encoding, "long", lambda v, n: kernels.by_row(np.add, v, n, 0))


def average(quality: str | Column, encoding: str = "phred33") -> Column:
    """Mean score, 0 if empty."""
    return _measure(quality, encoding, "double", lambda v, n: kernels.by_row(np.add, v, n, 0) / np.maximum(n, 1))


def minimum(quality: str | Column, encoding: str = "phred33") -> Column:
    """Smallest score, 0 if empty."""
    return _measure(quality, encoding, "int", lambda v, n: kernels.by_row(np.minimum, v, n, 0))


def maximum(quality: str | Column, encoding: str = "phred33") -> Column:
    return _measure(quality, encoding, "int", lambda v, n: kernels.by_row(np.maximum, v, n, 0))


def error_probability(score: Column) -> Column:
    return F.pow(F.lit(10.0), -score / 10.0)


def score_of_probability(p: Column) -> Column:
    return -10.0 * F.log10(p)


def error_sum(quality: str | Column, encoding: str = "phred33") -> Column:
    return _measure(quality, encoding, "double", lambda v, n: kernels.by_row(np.add, 10.0 ** (-v / 10.0), n, 0.0))


def count_at_least(quality: str | Column, score: int, encoding: str = "phred33") -> Column:
    return _measure(quality, encoding, "int", lambda v, n: kernels.by_row(np.add, (v >= score).astype(np.int64), n, 0))


def measures(quality: str | Column, encoding: str = "phred33") -> Column:
    """struct of total, min, max, q20, q30 (scores of so much at least) and err (sum of error
    probabilities): one pass over a batch for all of them. 0 if empty or null."""
    offset = offset_of(encoding)

    @F.pandas_udf("total long, min int, max int, q20 int, q30 int, err double")
    def run(texts: pd.Series) -> pd.DataFrame:
        codes, lengths = kernels.flat(texts)
        v = codes.astype(np.int64) - offset
        sums = lambda x: kernels.by_row(np.add, x, lengths, 0)
        out = {"total": sums(v), "min": kernels.by_row(np.minimum, v, lengths, 0), "max": kernels.by_row(np.maximum, v, lengths, 0), "q20": sums((v >= 20).astype(np.int64)), "q30": sums((v >= 30).astype(np.int64)), "err": kernels.by_row(np.add, 10.0 ** (-v / 10.0), lengths, 0.0)}
        return pd.DataFrame(out)

    return run(_c(quality))


def quality_stats(quality: str | Column, encoding: str = "phred33") -> Column:
    """struct of min, max, mean, median, q1, q3, std_dev (population) and count."""

    def of(s: Column) -> Column:
        n = F.size(s)
        mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / n
        variance = let(mean, lambda m: F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n)

        def at(q: float) -> Column:
            return F.get(s, F.floor(n * q).cast("int"))

        median = F.when(n % 2 == 1, at(0.5).cast("double")).otherwise((F.get(s, (n / 2).cast("int") - 1) + F.get(s, (n / 2).cast("int"))) / 2.0)
        return F.when(
            n > 0,
            F.struct(F.get(s, F.lit(0)).alias("min"), F.get(s, n - 1).alias("max"), mean.alias("mean"), median.alias("median"), at(0.25).alias("q1"), at(0.75).alias("q3"), F.sqrt(variance).alias("std_dev"), n.alias("count")),
        )

    return let(F.array_sort(scores(quality, encoding)), of)


def _codes(quality: Column) -> Column:
    return scores(quality, "phred33")


def detect_encoding(quality: str | Column) -> Column:
    """phred33, phred64 or solexa from the range of characters; null where none fits."""

    def of(c: Column) -> Column:
        low, high = F.array_min(c) + 33, F.array_max(c) + 33
        return (
            F.when(F.size(c) == 0, "phred33")
            .when((low >= 70) & (high <= 93) & (high - low <= 5), "phred33")
            .when(low > 93, "phred64")
            .when((low >= 59) & (low < 64), "solexa")
            .when((low >= 64) & (high <= 104), "phred64")
            .when((low >= 33) & (high <= 126), "phred33")
        )

    return let(_codes(_c(quality)), of)


def detect_encoding_with_confidence(quality: str | Column) -> Column:
    """struct<encoding, confidence>."""

    def of(c: Column) -> Column:
        low, high = F.array_min(c) + 33, F.array_max(c) + 33

        def say(encoding: str, confidence: float) -> Column:
            return F.struct(F.lit(encoding).alias("encoding"), F.lit(confidence).alias("confidence"))

        return (
            F.when(F.size(c) == 0, say("phred33", 0.5))
            .when((low >= 33) & (high <= 73), say("phred33", 0.95))
            .when((low >= 70) & (high <= 93) & (high - low <= 5), say("phred33", 0.9))
            .when((low > 73) & (high <= 104), say("phred64", 0.85))
            .when((low >= 64) & (high <= 93), say("phred33", 0.6))
            .when((low >= 59) & (low < 64), say("solexa", 0.75))
            .otherwise(say("phred33", 0.5))
        )

    return let(_codes(_c(quality)), of)


def boundaries_of(bins: int | None = None, preset: str | None = None, boundaries: Sequence[float] | None = None) -> list[float]:
    if boundaries is None:
        require(preset in PRESETS and bins in (2, 3, 5), "binning takes boundaries, or a preset with 2, 3 or 5 bins")
        return list(PRESETS[preset][bins])
    b = list(boundaries)
    require(len(b) > 0 and all(x < y for x, y in zip(b, b[1:])) and all(0 <= x <= 93 for x in b), "boundaries must rise, from 0 to 93")
    require(bins is None or len(b) == bins - 1, "one boundary less than bins")
    return b


def representatives(boundaries: Sequence[float]) -> list[int]:
    """The score that stands for each bin: half the first boundary, the middles, the last plus ten."""
    b = list(boundaries)
    return [int(b[0] // 2), *[int((x + y) // 2) for x, y in zip(b, b[1:])], int(b[-1] + 10)]


def bin_index(score: float, boundaries: Sequence[float]) -> int:
    return next((i for i, b in enumerate(boundaries) if score < b), len(boundaries))


def binned(quality: str | Column, boundaries: Sequence[float], encoding: str = "phred33") -> Column:
    """Each character becomes its bin's representative, by one translate()."""
    chars, values = _alphabet(encoding), representatives(boundaries)
    high = ENCODINGS[encoding][2]
    to = "".join(score_to_char(min(high, values[bin_index(char_to_score(x, encoding), boundaries)]), encoding) for x in chars)
    return F.translate(_c(quality), chars, to)


def compression_ratio(quality: str | Column) -> Column:
    """Different characters per run of equal ones: a rough measure of what binning gains."""
    s = _c(quality)
    runs = F.regexp_count(s, F.lit(r"(.)\1*"))
    return F.when(F.length(s) > 0, F.length(s) / runs).otherwise(F.lit(1.0))


def trim_range(quality: str | Column, threshold: float = 20, window: int = 4, from_start: bool = True, from_end: bool = True, encoding: str = "phred33") -> Column:
    """struct<start, end> of what stays: from the first window whose mean is at least the threshold to
    the end of the last one. No such window: (0, 0). A window longer than the read leaves it whole.

    A running sum over each read; a scan, so an Arrow function."""
    if window < 1:
        raise SeqError("window must be positive")
    offset, least = offset_of(encoding), threshold * window

    def of(v: np.ndarray) -> tuple[int, int]:
        if not len(v) or len(v) < window or not (from_start or from_end):
            return 0, len(v)
        sums = np.cumsum(np.concatenate([[0], v]))
        good = np.flatnonzero(sums[window:] - sums[:-window] >= least)
        if not len(good):
            return 0, 0
        return int(good[0]) if from_start else 0, int(good[-1]) + window if from_end else len(v)

    @F.pandas_udf("start int, end int")
    def run(texts: pd.Series) -> pd.DataFrame:
        codes, lengths = kernels.flat(texts)
        scores_of = codes.astype(np.int64) - offset
        stops = np.cumsum(lengths)
        return pd.DataFrame([of(scores_of[b - n : b]) for b, n in zip(stops.tolist(), lengths.tolist(), strict=True)], columns=["start", "end"])

    return run(_c(quality))
