"""Hashes of sequences; case is folded unless told otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _folded(seq: str | Column, case_sensitive: bool) -> Column:
    c = F.col(seq) if isinstance(seq, str) else seq
    return c if case_sensitive else F.upper(c)


def md5(seq: str | Column, case_sensitive: bool = False) -> Column:
    return F.md5(_folded(seq, case_sensitive))


def sha1(seq: str | Column, case_sensitive: bool = False) -> Column:
    return F.sha1(_folded(seq, case_sensitive))


def sha256(seq: str | Column, case_sensitive: bool = False) -> Column:
    return F.sha2(_folded(seq, case_sensitive), 256)


def string_hash(seq: str | Column, case_sensitive: bool = False) -> Column:
    """The 32-bit rolling hash h = 31 h + code from 5381, without its sign."""
    s = _folded(seq, case_sensitive)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            h = 5381
            for ch in t or "":
                h = (h * 31 + ord(ch)) & 0xFFFFFFFF
            out.append(min(h, (1 << 32) - h))
        return pd.Series(out)

    return of(s)


def murmur3(seq: str | Column, case_sensitive: bool = False, seed: int = 0) -> Column:
    """MurmurHash3 with one round for each character, as unsigned number."""
    s = _folded(seq, case_sensitive)
    keep = 0xFFFFFFFF

    def rotated(x: int, by: int) -> int:
        return (x << by | x >> (32 - by)) & keep

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            h, t = seed, t or ""
            for ch in t:
                k = rotated(ord(ch) * 0xCC9E2D51 & keep, 15) * 0x1B873593 & keep
                h = (rotated(h ^ k, 13) * 5 + 0xE6546B64) & keep
            h ^= len(t)
            h = (h ^ h >> 16) * 0x85EBCA6B & keep
            h = (h ^ h >> 13) * 0xC2B2AE35 & keep
            out.append(h ^ h >> 16)
        return pd.Series(out)

    return of(s)


def hash_of(seq: str | Column, algorithm: str = "md5", case_sensitive: bool = False) -> Column:
    return {"md5": md5, "sha1": sha1, "sha256": sha256, "string": string_hash, "murmur3": murmur3}[algorithm](seq, case_sensitive)
