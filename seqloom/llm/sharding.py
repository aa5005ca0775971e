"""Shards by balanced label propagation, in DataFrame functions only.

Documents with equal texts are linked. Documents start in shards by hash; in each round, linked
documents look at the shards of their neighbours (counted by group and shard, so a group of any size
is a few rows) and ask to move where most of them are. How many may move from each shard to each other
one is settled from the demands, so that no shard goes over its quota: what leaves a shard makes room
in it, so full shards exchange rows. A group larger than a shard gathers in as many shards as it needs.
Rounds end when hardly fewer rows are away from their group than before (ROUNDS at most). Unlinked
documents fill what is left, and a last pass moves the few rows over quota into free places, so that
the counts of shards are at most one apart (law `rows`) while few links are cut.

Plan: one pass over texts takes size, checksum and a hash of the text; all rounds work on these narrow
rows. Joins on the group are dealt by (group, salt) with salts in proportion to the group, so that no
task gets a large group. Ranks inside shards are two-level. What reaches the driver and is broadcast in
a round are the loads of shards and the flows between them: n_shards ** 2 rows.

Defined results. Null text: as the empty text, size 16. Null ids and repeated rows: documents like
others. Fewer documents than shards: one each in the first shards. Empty table: empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import bucket_of, cut, table

#: Rounds at most, and the share of rows away from their group at which a round counts as no progress.
ROUNDS = 12
STILL = 0.98
#: A group with over this share of the rows counts as large; there can be 1 / share of them.
LARGE = 1000


def with_group_size(base: DataFrame, group: str, rows: int) -> DataFrame:
    """base with `n`, the rows of its group. Large groups, at most LARGE of them, are looked up by
    broadcast, so the shuffled join holds no group with over rows / LARGE rows."""
    limit = max(1, rows // LARGE)
    counts = cut(base.groupBy(group).agg(F.count(F.lit(1)).alias("n")))
    large = counts.filter(F.col("n") > limit)
    looked = base.join(F.broadcast(large), group, "left")
    rest = looked.filter("n is null").drop("n").join(counts.filter(F.col("n") <= limit), group)
    return looked.filter("n is not null").unionByName(rest)


def flows(demand: np.ndarray, load: np.ndarray, quota: int) -> np.ndarray:
    """Which share of demand[i, j], the rows that would go from shard i to j, may go, so that no shard ends
    over its quota (one that is over it already gets no more than it gives). Inflows shrink to the room
    that is left by what stays and what leaves, until they all fit; they only ever shrink, so this ends."""
    flow = demand.astype(float)
    while True:
        coming, going = flow.sum(0), flow.sum(1)
        room = np.maximum(0, quota - load + going)
        scale = np.minimum(1, room / np.maximum(coming, 1e-12))
        smaller = flow * scale
        if (flow - smaller).sum() < 0.5:
            return np.divide(smaller, demand, out=np.zeros_like(smaller), where=demand > 0)
        flow = smaller


def whole(quota: int) -> Column:
    """Groups so small beside a shard that they move as one."""
    return F.col("n") <= max(1, quota // 8)


def propagate(linked: DataFrame, n_shards: int, quota: int, rounds: int) -> DataFrame:
    """linked: doc columns with g, n, salt, salts, shard. Moves documents towards their neighbours."""
    spark = linked.sparkSession
    is_open, strays = np.ones(n_shards, bool), None
    for r in range(rounds):
        counted = cut(linked.groupBy("g", "n", "salts", "shard").agg(F.count(F.lit(1)).alias("c")))
        load = np.zeros(n_shards)
        for row in counted.groupBy("shard").agg(F.sum("c").alias("c")).collect():  # n_shards rows
            load[row["shard"]] = row["c"]
        takes = F.element_at(F.array(*[F.lit(int(x)) for x in is_open]), F.col("shard") + 1)
        order = F.struct((F.col("c") * takes).alias("a"), "c", F.xxhash64("g", "shard").alias("h"), "shard")
        ranked = counted.groupBy("g", "n", "salts").agg(F.sort_array(F.collect_list(order), asc=False).alias("s"))  # at most n_shards each
        need = F.greatest(F.ceil(F.col("n") / F.lit(max(1, int(quota * 0.9)))), F.lit(1)).cast("int")
        goals = ranked.select("g", F.slice(F.col("s.shard"), 1, F.least(need, F.lit(n_shards))).alias("goals"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        pick = F.element_at("goals", (bucket_of([F.col("doc_id"), F.col("crc")], F.size("goals")) + 1).cast("int"))
        asked = linked.join(goals, ["g", "salt"]).withColumn("goal", F.when(F.array_contains("goals", F.col("shard")), F.col("shard")).otherwise(pick)).drop("goals")
        asked = cut(asked)
        demand = np.zeros((n_shards, n_shards))
        for row in asked.filter("goal <> shard").groupBy("shard", "goal").agg(F.count(F.lit(1)).alias("c")).collect():  # n_shards ** 2 rows
            demand[row["shard"], row["goal"]] = row["c"]
        if not demand.any() or (strays is not None and demand.sum() > STILL * strays):
            return asked.drop("goal")
        strays = demand.sum()
        share = flows(demand, load, quota)
        coming = (demand * share).sum(0)
        is_open = (demand.sum(0) == 0) | (coming >= 0.1 * demand.sum(0))
        allowed = spark.createDataFrame([(i, j, float(share[i, j])) for i in range(n_shards) for j in range(n_shards) if share[i, j] > 0], "shard int, goal int, share double")
        own = F.when(whole(quota), F.xxhash64("g", F.lit(r))).otherwise(F.xxhash64("doc_id", "crc", F.lit(r)))
        moves = F.coalesce(F.pmod(own, F.lit(1 << 30)) < F.col("share") * F.lit(1 << 30), F.lit(False))
        moved = asked.join(F.broadcast(allowed), ["shard", "goal"], "left")
        linked = cut(moved.withColumn("shard", F.when(moves, F.col("goal")).otherwise(F.col("shard"))).drop("goal", "share"))
    return linked


def balanced_shards(docs: DataFrame, n_shards: int = 40, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, crc, g (the text's hash), n (rows with that text), shard, slot."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = cut(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"), F.xxhash64(t, F.length(t)).alias("g")))
    rows = base.count()
    quota = max(1, rows // n_shards)
    sized = with_group_size(base, "g", rows)
    per_salt = max(1, rows // LARGE)
    salts = F.ceil(F.col("n") / per_salt).cast("int")
    own = [F.col("doc_id"), F.col("size"), F.col("crc")]
    state = sized.withColumn("salts", salts).withColumn("salt", bucket_of([*own, F.lit(1)], F.col("salts")).cast("int")).withColumn("shard", bucket_of([*own, F.lit(2)], n_shards).cast("int"))
    state = cut(state)
    linked = propagate(state.filter("n > 1"), n_shards, quota, rounds)
    placed = linked.withColumn("single", F.lit(0)).unionByName(state.filter("n = 1").withColumn("single", F.lit(1)))
    return settle(placed, n_shards, rows)


def settle(placed: DataFrame, n_shards: int, rows: int) -> DataFrame:
    """Exact quotas and gapless slots; rows over quota, unlinked ones first, fill free places."""
    cells = max(1, -(-rows // n_shards // 20_000))
    own = [F.col("doc_id"), F.col("size"), F.col("crc")]
    # the rows that have to go are the last in rank: unlinked ones, then whole groups
    together = F.when(whole(max(1, rows // n_shards)), F.xxhash64("g", F.lit(3))).otherwise(F.xxhash64(*own, F.lit(3)))
    placed = cut(placed.withColumn("cell", F.pmod(together, F.lit(max(cells, 4))).cast("int")))
    counted = placed.groupBy("shard", "single", "cell").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("shard").orderBy("single", "cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counted.withColumn("before", before).drop("c")
    inside = F.row_number().over(W.partitionBy("shard", "single", "cell").orderBy("g", "doc_id", "size", "crc")) - 1
    ranked = placed.withColumn("inside", inside).join(starts, ["shard", "single", "cell"]).withColumn("rank", F.col("before") + F.col("inside"))
    loads = {r["shard"]: r["c"] for r in counted.groupBy("shard").agg(F.sum("c").alias("c")).collect()}  # n_shards rows
    quota = [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]
    load = [loads.get(s, 0) for s in range(n_shards)]
    over, free = [0], [0]
    for s in range(n_shards):
        over.append(over[-1] + max(0, load[s] - quota[s]))
        free.append(free[-1] + max(0, quota[s] - load[s]))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    at = F.col("shard") + 1
    stays = F.col("rank") < F.element_at(longs(quota), at)
    turn = F.element_at(longs(over[:-1]), at) + F.col("rank") - F.element_at(longs(quota), at)
    ranked = ranked.withColumn("turn", F.when(~stays, turn))
    to = F.size(F.filter(longs(free[1:]), lambda x: x <= F.col("turn")))
    slot = F.element_at(longs(load), to + 1) + F.col("turn") - F.element_at(longs(free), to + 1)
    return ranked.select(
        "doc_id", "size", "crc", "g", "n", F.when(F.col("turn").isNull(), F.col("shard")).otherwise(to).cast("int").alias("shard"), F.when(F.col("turn").isNull(), F.col("rank")).otherwise(slot).cast("long").alias("slot")
    )


def op2(spark, sf_dir):
    placed = balanced_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("n").alias("group_rows"))
