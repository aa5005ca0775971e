import numpy as np
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import simhash


def slow(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = b.split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def roots(fps):
    fps = np.array(sorted(set(fps)), np.uint64)
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        old = label.copy()
        for i in range(len(fps)):
            near = np.bitwise_count(fps ^ fps[i]) <= 4
            label[near] = min(label[near].min(), label[i])
        if np.array_equal(old, label):
            break
    return dict(zip(fps.tolist(), label.tolist(), strict=True))


def test_fingerprint(prose):
    for t in [None, "", "One", "one two", "A b C d", "É x Y z w", *[prose(i, 5 + i) for i in range(20)]]:
        assert simhash.fingerprint(t) == slow(t)


def test_classes_equal_all_pairs(spark):
    r = np.random.default_rng(5)
    fps = r.integers(0, 1 << 63, 200, dtype=np.uint64).tolist()
    for k in range(60):  # chains and crowds
        x = fps[k % 7] if k % 2 else fps[-1]
        for bit in r.choice(64, r.integers(1, 6), replace=False):
            x ^= 1 << int(bit)
        fps.append(x)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "doc_id long, fp long")
    got = {r["fp"] & (1 << 64) - 1: r["root"] for r in simhash.classes(df, F.col("doc_id")).collect()}
    want = roots(fps)
    classes, mine = {}, {}
    for x in got:
        classes.setdefault(want[x], set()).add(x)
        mine.setdefault(got[x], set()).add(x)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


def test_drop_near_copies(spark, docs, prose):
    base = prose(3, 300)
    near = base.replace("stone", "stones", 1)
    rows = [(5, base), (3, base), (9, near), (7, prose(8, 200)), (None, base), (3, base), (20, None), (21, ""), (None, None)]
    kept = {r["doc_id"] for r in simhash.drop_near_copies(docs(rows)).collect()}
    assert kept == {3, 7, 20}
    assert simhash.drop_near_copies(docs(rows)).count() == 3


def test_only_null_ids(docs):
    assert simhash.drop_near_copies(docs([(None, "a b c d"), (None, "a b c d")])).count() == 1


def test_empty(docs):
    assert simhash.drop_near_copies(docs([])).count() == 0


def test_op9_against_all_pairs(spark, docs, prose, tmp_path):
    from seqloom.llm.queries import QUERIES

    rows = [(i, prose(i % 40, 200 + i % 40) + (" x" if i % 5 == 0 else "")) for i in range(120)]
    rows += [(300, None), (301, ""), (None, ""), (302, "one"), (302, "one"), (303, "\u00c9t\u00c9 " * 30_000), (None, rows[7][1]), (304, "a b c"), (305, "A b  C")]
    docs(rows).selectExpr("*", "doc_id as fp", "text as key", "text as component_id").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op9_simhash"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and [t for _, t in got.dtypes] == ["bigint", "string", "bigint"]
    prints = [slow(t) for _, t in rows]
    root, best = roots(prints), {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            best[root[p]] = min(i, best.get(root[p], i))
    want = [(i, f"{p:016x}", best.get(root[p])) for (i, _), p in zip(rows, prints, strict=True)]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_a_crowded_key_in_parts_equals_all_pairs(monkeypatch):
    """Meeting in one part, and in many, finds the same classes as all pairs."""
    r = np.random.default_rng(7)
    fps = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [fps[k % 3] ^ sum((np.uint64(1) << np.uint64(b) for b in r.choice(64, r.integers(1, 7), replace=False)), np.uint64(0)) for k in range(150)]
    fps = np.unique(np.concatenate([fps, np.array(near, np.uint64)]))
    want = roots(fps.tolist())
    for points in (1_000_000, 3_000, 200):
        monkeypatch.setattr(simhash, "POINTS", points)
        links = [simhash._meet(fps, key, 2, 4) for key in range(4)]
        a, b = (np.concatenate(x) for x in zip(*links, strict=True))
        low, high = simhash._forest(a, b)
        mine = dict(zip(high.tolist(), low.tolist(), strict=True))
        classes, other = {}, {}
        for x in fps.tolist():
            classes.setdefault(want[x], set()).add(x)
            other.setdefault(mine.get(x, x), set()).add(x)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, other.values()))
