"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 4 or less have a point between them at distance 2 or less from both. So
every distinct fingerprint emits all points within distance 2 of itself (2,081 for 64 bits), equal
points meet, and fingerprints that meet are checked and linked.

Plan. Exact copies collapse to one fingerprint before anything is emitted. Points are dealt to
partitions by a parity key: every bit position has a short code, and a point's key is the XOR of the
codes of its set bits. Flipping two bits changes the key by two codes only, so a fingerprint travels
once to each key that some of its points have (at most 137, where emitting points would take 2,081
rows), and each partition expands just the points with its own key. Since every bit moves the key,
a crowd of near copies spreads over all keys. The number of keys grows with the number of
fingerprints, so a partition keeps its size. All fingerprints at one point are within distance 4 of
one another, so a chain through them suffices: no pairs of a group are emitted. Each task reduces its
chains to a spanning forest; components then come from alternating large-star and small-star joins,
each round checkpointed.

Defined results. Null or empty text: fingerprint zero, linked like any other. Null doc_id: never the
smallest; a component of null ids alone has a null component_id. Repeated rows: each returned. Extra
columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import cut, fresh

#: Points that one key's partition expands at once: 16 bytes each while they are sorted.
POINTS = 1_000_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: -shingle]]).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, 65536):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + 65536], stops[k : k + 65536], strict=True)], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = 4) -> Column:
    """The fingerprint as a long; bit 63 is its sign."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


@cache
def _codes(bits: int) -> np.ndarray:
    """A code of `bits` bits for each of the 64 positions: 16 groups of positions, or `bits` if more,
    have a code each, together spanning all keys."""
    groups = max(16, bits)
    of_group = [1 << g if g < bits else int(np.random.default_rng([3, bits, g]).integers(0, 1 << bits)) if bits else 0 for g in range(groups)]
    return np.array([of_group[i % groups] for i in range(64)], np.int64)


@cache
def _masks(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All flips of up to two bits sorted by how they change the key; those changes; where each begins."""
    code, one = _codes(bits), np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    mask = np.concatenate([np.zeros(1, np.uint64), one, one[i] | one[j]])
    change = np.concatenate([np.zeros(1, np.int64), code, code[i] ^ code[j]])
    order = np.argsort(change, kind="stable")
    changes, first = np.unique(change[order], return_index=True)
    return mask[order], changes, np.append(first, len(mask))


def _keys(fps: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The XOR of the codes of each fingerprint's set bits."""
    key = np.zeros(len(fps), np.int64)
    for i in range(64):
        key ^= np.where(fps >> np.uint64(i) & np.uint64(1), code[i], 0)
    return key


@cache
def _parts(bits: int, fine: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A second code of `fine` bits that deals the points of one key to parts; the flips of _masks, those of
    one change sorted by how they change the part; those changes."""
    code = np.random.default_rng([5, bits, fine]).integers(0, 1 << fine, 64)
    mask, _, first = _masks(bits)
    part = _keys(mask, code)
    order = np.lexsort((part, np.repeat(np.arange(len(first) - 1), np.diff(first))))
    return code, mask[order], part[order]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links, each component a star around its smallest member."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[label[far]], nodes[far]


def _meet(fps: np.ndarray, key: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints whose points with this key meet."""
    _, changes, first = _masks(bits)
    at = np.searchsorted(changes, _keys(fps, _codes(bits)) ^ key)
    total = int(np.diff(first)[at].sum())
    fine = max(0, math.ceil(math.log2(max(1, total / POINTS))))
    code, mask, part_of = _parts(bits, fine)
    own = _keys(fps, code)
    # fingerprints of one change and one part of their own: their points of a part come from one run of flips
    order = np.lexsort((own, at))
    edges = np.flatnonzero(np.diff(at[order]) | np.diff(own[order])) + 1
    groups = [(g, int(at[g[0]]), int(own[g[0]])) for g in np.split(order, edges) if len(g)]
    got_a, got_b = [], []
    for part in range(1 << fine):  # a crowded key is expanded in parts, each point once
        points, owners = [], []
        for who, c, mine in groups:
            lo, hi = (first[c] + np.searchsorted(part_of[first[c] : first[c + 1]], [part ^ mine, (part ^ mine) + 1])).tolist()
            flips = mask[lo:hi]
            if len(flips):
                points.append((fps[who][:, None] ^ flips[None, :]).ravel())
                owners.append(np.repeat(who, len(flips)))
        if not points:
            continue
        p, o = np.concatenate(points), np.concatenate(owners)
        order = np.argsort(p, kind="stable")
        p, o = p[order], o[order]
        same = np.flatnonzero(p[1:] == p[:-1])
        a, b = fps[o[same]], fps[o[same + 1]]
        near = np.bitwise_count(a ^ b) <= radius  # the check
        got_a.append(a[near])
        got_b.append(b[near])
    if not got_a:
        return fps[:0], fps[:0]
    return _forest(np.concatenate(got_a), np.concatenate(got_b))


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links that connect all of the distinct fingerprints `fp` at distance radius or less."""
    if radius != 4:
        raise ValueError("points within distance 2 meet for a radius of 4")
    spark = fps.sparkSession
    n = fps.count()
    bits = min(30, max(2, math.ceil(math.log2(max(1, n * 2081 / POINTS)) + 2)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, changes, _ = _masks(bits)
        for batch in batches:
            x = batch["fp"].to_numpy(np.int64)
            for k in range(0, len(x), 4_000):
                some = x[k : k + 4_000]
                keys = _keys(some.view(np.uint64), _codes(bits))[:, None] ^ changes[None, :]
                yield pd.DataFrame({"key": keys.ravel().astype(np.int32), "fp": np.repeat(some, len(changes))})

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        fps_here = group["fp"].to_numpy(np.int64).view(np.uint64)
        a, b = _meet(np.unique(fps_here), int(key[0]), bits, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = fps.select("fp").mapInPandas(deal, "key int, fp long").repartition(tasks, "key")
    return dealt.groupBy("key").applyInPandas(meet, "a long, b long").distinct()


#: Parts that what belongs to one node or class is dealt to in joins.
SPREAD = 32


def _spread(df: DataFrame, parts: int = SPREAD) -> DataFrame:
    """One row for each part, to meet rows that _part deals out."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))


def _part(column: str, parts: int = SPREAD) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node. Alternating large-star
    and small-star rounds until every component is a star; few rounds, logarithmic in its size. Joins are
    by merge, as the size of a checkpointed table is only guessed, and a node with many neighbours is
    dealt to parts."""

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
        return tuple(r)

    def with_least(e: DataFrame, least: DataFrame) -> DataFrame:
        return e.withColumn("part", _part("v", 8)).join(_spread(least, 8).hint("merge"), ["u", "part"])

    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = mark(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u go to the smallest around u
        large = with_least(both.filter("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them (v < u always holds here)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(large, least).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
        e = cut(small.select("s.u", "s.v").filter("u <> v").distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())


def classes(prints: DataFrame, value: Column) -> DataFrame:
    """prints: (fp, ...), best already cut. (fp, root, best): for each distinct fingerprint the smallest
    one, as a signed number, of its class and the smallest `value` of all rows of the class. Rows
    collapse to fingerprints by partial aggregation before anything is joined; only linked fingerprints
    take part in joins on the class, each class dealt to SPREAD parts."""
    per = cut(prints.groupBy("fp").agg(F.min(value).alias("own")))
    linked = cut(components(links(per.select("fp"))).join(per.hint("merge"), F.col("node") == F.col("fp")).select("node", "root", "own"))
    best = linked.groupBy("root").agg(F.min("own").alias("best"))
    told = linked.withColumn("part", _part("node")).join(_spread(best).hint("merge"), ["root", "part"]).select("node", "root", "best")
    joined = per.join(told.hint("merge"), per["fp"] == told["node"], "left")
    return cut(joined.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("own")).otherwise(F.col("best")).alias("best")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each class the row with the smallest doc_id stays (a null id only
    where the class has no other), and of rows alike in that too, one."""
    key, name = F.xxhash64("doc_id", "text"), fresh(docs, "_near_key")
    prints = cut(docs.select("doc_id", key.alias("_key"), fingerprint_column(F.col("text")).alias("fp")))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    keep = classes(prints, row).filter("fp = root").select(F.col("best._key").alias(name)).distinct()
    return docs.withColumn(name, key).join(keep.hint("merge"), name).dropDuplicates([name]).select(*docs.columns)


def op9(spark, sf_dir):
    from seqloom.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = cut(docs.select("doc_id", fingerprint_column(F.col("text")).alias("fp")))
    found = classes(prints, F.col("doc_id")).select(F.col("fp").alias("_fp"), F.col("best").alias("component_id"))
    return prints.join(found.hint("merge"), F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
