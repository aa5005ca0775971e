"""Nearest neighbours by inner product, by collision-counting hashing.

Vectors are scaled by the largest norm and get one more component that makes all norms 1, so the
largest inner product is the smallest distance. Each of M random lines gives every vector one number;
the numbers of a block are held in one sorted array for each line. A query looks in a window around its
own number on every line; virtual rehashing widens all windows step by step. A vector that is inside
the window on at least THRESHOLD lines is verified by its exact inner product. A query ends when a
vector as near as its k-th best would have passed the threshold with high probability at this width,
so recall does not hang on how the data are spread; with the last width every vector passes.

Plan. Vectors are packed into blocks by hash, queries into larger blocks by hash; each pair of blocks is
one self-contained row for one task (a stated query set against all rows, in blocks), so tasks are
bounded by bytes whatever the dimension, even and free to be retried. A block's sorted arrays serve all
queries of the pair: building them costs less than a hundredth of the search, and less than moving them
would. Each pair gives its k best for each query; those are ranked. Crowds of equal vectors meet in the
first window, and ties go to the smaller id.

Why blocks and no join on buckets: a line has to catch the k-th neighbour with a chance of CATCH. On the
given tables that neighbour has a cosine of 0.4, and a window that catches it holds 62 of 100 unrelated
vectors. A table of (line, bucket, id) joined with the queries' windows would emit 0.62 * M rows for each
query and vector, thirty times their pairs. Sorted arrays count these collisions in a worker's memory.

Defined results. Vectors null, zero, with null or non-finite components, or without id take no part.
Shorter vectors count as padded by zeros. Rows repeated in id and vector are one row; different vectors
of one id are queries of their own, and a query never finds its own id. Fewer candidates than k: all. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import bucket_of, cut, table

M = 48
THRESHOLD = 30
#: Chance that one line has the k-th neighbour in its window when the search ends: then it is past the
#: threshold with a chance of about 0.97.
CATCH = 0.74
#: Numbers in a block of vectors, and in one of queries: 16 and 4 MB.
BLOCK, QUERY_BLOCK = 1 << 21, 1 << 19
#: Widths tried until there are k candidates.
WIDTHS = np.array([0.05 * 1.7**i for i in range(8)])


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


class Block:
    """Sorted arrays of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, seed: int):
        self.ids, self.vectors, self.largest = ids, vectors, largest
        x = vectors / largest
        rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
        self.lines = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((M, vectors.shape[1] + 1))
        projected = x @ self.lines[:, :-1].T + rest[:, None] * self.lines[:, -1]
        self.order = np.ascontiguousarray(projected.argsort(0).T)
        self.rough = (vectors / largest).astype(np.float32)
        self.sorted = np.ascontiguousarray(np.take_along_axis(projected.T, self.order, 1))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and products of the k best for each query, in order of the queries."""
        n, catch = len(self.ids), NormalDist().inv_cdf(0.5 + CATCH / 2)
        norms = np.linalg.norm(queries, axis=1)
        at = (queries / norms[:, None]) @ self.lines[:, :-1].T  # query, line
        low = np.stack([np.searchsorted(self.sorted[j], at[:, j, None] - WIDTHS) for j in range(M)], 1)
        high = np.stack([np.searchsorted(self.sorted[j], at[:, j, None] + WIDTHS, side="right") for j in range(M)], 1)
        for q in range(len(queries)):
            counts, done = np.zeros(n, np.int64), np.zeros(n, bool)
            # products in single precision are off by this at most
            rough, slack = queries[q].astype(np.float32), queries.shape[1] * 2.0**-22 * norms[q]
            found_i, found_s = np.empty(0, np.int64), np.empty(0, np.float32)
            step, width, lo, hi = 0, WIDTHS[0], low[q, :, 0], high[q, :, 0]
            fresh = [self.order[j, a:b] for j, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True))]
            while True:
                counts += np.bincount(np.concatenate(fresh), minlength=n)
                new = np.flatnonzero((counts >= THRESHOLD) & ~done)
                if len(new):
                    done[new] = True
                    scores = self.rough[new] @ rough  # single precision sorts out, double decides
                    own = self.ids[new] != query_ids[q]
                    found_i, found_s = np.concatenate([found_i, new[own]]), np.concatenate([found_s, scores[own]])
                goal = np.inf  # the width at which the k-th best so far would have been caught
                if len(found_s) >= k:
                    kth = np.partition(found_s, -k)[-k]
                    near = found_s >= kth - slack
                    found_i, found_s = found_i[near], found_s[near]
                    goal = catch * np.sqrt(max(0.0, 2 - 2 * float(kth) / norms[q]))
                if width >= goal or width == np.inf:
                    break
                # virtual rehashing: the next width, or at once the one that is enough
                step += 1
                if goal < np.inf or step == len(WIDTHS):
                    width = goal if goal < np.inf else np.inf
                    lo2 = np.array([np.searchsorted(self.sorted[j], at[q, j] - width) for j in range(M)])
                    hi2 = np.array([np.searchsorted(self.sorted[j], at[q, j] + width, side="right") for j in range(M)])
                else:
                    width, lo2, hi2 = WIDTHS[step], low[q, :, step], high[q, :, step]
                fresh = []
                for j, (a, b, c, d) in enumerate(zip(lo2.tolist(), lo.tolist(), hi.tolist(), hi2.tolist(), strict=True)):
                    fresh.append(self.order[j, a:b])
                    fresh.append(self.order[j, c:d])
                lo, hi = lo2, hi2
            exact = (self.vectors[found_i] * queries[q]).sum(1)  # the same sum for equal vectors
            best = np.lexsort((self.ids[found_i], -exact))[:k]
            yield self.ids[found_i[best]], exact[best]


def _packed(rows: DataFrame, block: Column, d: int) -> DataFrame:
    """block, ids (8 bytes each) and vectors (d numbers of 8 bytes each) of all rows of a block."""

    def pack(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(some), d))
        for i, v in enumerate(some["v"]):
            x[i, : len(v)] = v
        return pd.DataFrame({"block": [key[0]], "ids": [some["vec_id"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()]})

    return rows.select(block.alias("block"), "vec_id", "v").groupBy("block").applyInPandas(pack, "block long, ids binary, x binary")


def search(vectors: DataFrame, is_query: Column, k: int = 20, seed: int = 11, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row with is_query its k nearest other rows."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = cut(rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).dropDuplicates(["vec_id", "v"]))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest"), F.max(F.size("v")).alias("d"), F.count_if("q").alias("queries")).first()
    n, largest, d, queries = s["n"], s["largest"] or 1.0, s["d"] or 1, s["queries"]
    blocks, query_blocks = max(1, -(-n * d // BLOCK)), max(1, -(-queries * d // QUERY_BLOCK))
    data = _packed(rows, bucket_of([F.col("vec_id")], blocks), d).select("ids", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("c"))
    asked = _packed(rows.filter("q"), bucket_of([F.col("vec_id"), F.lit(1)], query_blocks), d).select(F.col("block").alias("c"), F.col("ids").alias("query_ids"), F.col("x").alias("queries"))
    pairs = data.join(asked, "c").select("ids", "x", "query_ids", "queries").repartition(max(1, blocks * query_blocks))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, x, query_ids, asked_x in zip(*(batch[c] for c in ("ids", "x", "query_ids", "queries")), strict=True):
                block = Block(np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(-1, d), largest, seed)
                names, y = np.frombuffer(query_ids, np.int64), np.frombuffer(asked_x).reshape(-1, d)
                for i in range(0, len(names), 256):
                    got = list(block.search(names[i : i + 256], y[i : i + 256], k))
                    found = [len(g[0]) for g in got]
                    which = np.repeat([zlib.crc32(v.tobytes()) for v in y[i : i + 256]], found)
                    yield pd.DataFrame({"query_id": np.repeat(names[i : i + 256], found), "which": which, "vec_id": np.concatenate([g[0] for g in got]), "score": np.concatenate([g[1] for g in got])})

    near = pairs.mapInPandas(each, "query_id long, which long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "which").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
