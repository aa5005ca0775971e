"""Bloom filters of strings, built by tasks and merged: an approximate member test of fixed size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.schema import require


def hashes(items) -> np.ndarray:
    """64-bit hashes of strings, the same as the JVM's; numbers are hashes already."""
    if isinstance(items, np.ndarray):
        return items.astype(np.int64).view(np.uint64)
    return np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in items], np.uint64)


class BloomFilter:
    """m = -n ln p / ln(2)^2 bits, k = m / n ln 2 places for each item."""

    def __init__(self, expected: int, false_positive_rate: float = 0.01):
        require(expected > 0 and 0 < false_positive_rate < 1, "a Bloom filter takes items > 0 and a rate between 0 and 1")
        self.expected, self.rate = expected, false_positive_rate
        self.n_bits = math.ceil(-expected * math.log(false_positive_rate) / math.log(2) ** 2)
        self.n_hashes = math.ceil(self.n_bits / expected * math.log(2))
        self.bits = np.zeros(-(-self.n_bits // 8), np.uint8)
        self.count = 0

    def _places(self, items) -> np.ndarray:
        """(item, hash): the places of items, or of their 64-bit hashes."""
        a = hashes(items)
        b = (a ^ a >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        return (a[:, None] + np.arange(self.n_hashes, dtype=np.uint64) * b[:, None]) % np.uint64(self.n_bits)

    def add(self, item: str) -> None:
        self.add_many([item])

    def add_many(self, items) -> None:
        p = self._places(items).ravel()
        np.bitwise_or.at(self.bits, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        self.count += len(items)

    def contains(self, item: str) -> bool:
        return bool(self.contains_many([item])[0])

    def contains_many(self, items) -> np.ndarray:
        p = self._places(items)
        return (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).all(1)

    def _like(self, other: BloomFilter, bits: np.ndarray) -> BloomFilter:
        require(self.n_bits == other.n_bits and self.n_hashes == other.n_hashes, "filters of different size")
        out = BloomFilter(self.expected, self.rate)
        out.bits, out.count = bits, self.count + other.count
        return out

    def union(self, other: BloomFilter) -> BloomFilter:
        return self._like(other, self.bits | other.bits)

    def intersection(self, other: BloomFilter) -> BloomFilter:
        return self._like(other, self.bits & other.bits)

    def false_positive_rate(self) -> float:
        return float((np.unpackbits(self.bits).sum() / self.n_bits) ** self.n_hashes)


class CountingBloomFilter(BloomFilter):
    """With counters, so items can be removed."""

    def __init__(self, expected: int, false_positive_rate: float = 0.01):
        super().__init__(expected, false_positive_rate)
        self.counters = np.zeros(self.n_bits, np.uint32)

    def add_many(self, items) -> None:
        np.add.at(self.counters, self._places(items).ravel(), 1)
        self.count += len(items)

    def remove(self, item: str) -> bool:
        if not self.contains(item):
            return False
        np.subtract.at(self.counters, self._places([item]).ravel(), 1)
        self.count -= 1
        return True

    def contains_many(self, items) -> np.ndarray:
        return (self.counters[self._places(items)] > 0).all(1)


class ScalableBloomFilter:
    """A row of filters, each twice as large and half as permissive as the one before."""

    def __init__(self, initial: int = 1000, false_positive_rate: float = 0.01):
        self.rate, self.filters = false_positive_rate, [BloomFilter(initial, false_positive_rate / 2)]

    def add(self, item: str) -> None:
        last = self.filters[-1]
        if last.count >= last.expected:
            last = BloomFilter(last.expected * 2, last.rate / 2)
            self.filters.append(last)
        last.add(item)

    def contains(self, item: str) -> bool:
        return any(f.contains(item) for f in self.filters)


def build(df: DataFrame, item: str, expected: int, false_positive_rate: float = 0.01) -> BloomFilter:
    """The filter of a column: each task fills one of the fixed size, and pairs of them are merged."""

    def fill(batches):
        f = BloomFilter(expected, false_positive_rate)
        for batch in batches:
            f.add_many(batch["h"].to_numpy(np.int64))
        yield pd.DataFrame({"bits": [f.bits.tobytes()], "n": [f.count]})

    hashed = df.filter(F.col(item).isNotNull()).select(F.xxhash64(F.col(item).cast("string")).alias("h"))
    parts = hashed.mapInPandas(fill, "bits binary, n long")
    bits, n = parts.rdd.map(lambda r: (bytes(r["bits"]), r["n"])).treeReduce(lambda a, b: ((np.frombuffer(a[0], np.uint8) | np.frombuffer(b[0], np.uint8)).tobytes(), a[1] + b[1]))
    out = BloomFilter(expected, false_positive_rate)
    out.bits, out.count = np.frombuffer(bits, np.uint8).copy(), n
    return out


def might_contain(f: BloomFilter, item: str | Column) -> Column:
    """Member test as a column, over whole batches of hashes that the JVM takes; the filter travels with
    the function, so it should be small. A null is no member."""
    c = (F.col(item) if isinstance(item, str) else item).cast("string")

    @F.pandas_udf("boolean")
    def of(hashed: pd.Series) -> pd.Series:
        return pd.Series(f.contains_many(hashed.to_numpy(np.int64)))

    return of(F.xxhash64(c)) & c.isNotNull()
