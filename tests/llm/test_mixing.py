import pytest

from seqloom.llm import mixing


def fill(sizes):
    """Targets by shares handed out again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def rows_of(seed=1):
    import random

    r = random.Random(seed)
    names = ["a", "b", "B", None, "é", "zz"]
    return [(i, " ".join(["w"] * int(r.paretovariate(1.1) * 5)), None, names[min(5, int(r.expovariate(0.8)))], None) for i in range(900)]


def test_targets_and_words_taken(spark, docs):
    rows = rows_of() + [(None, None, None, "a", None), (5, "x y", None, "b", None), (5, "x y", None, "b", None)]
    base = mixing.cut(docs(rows).select("doc_id", "source", mixing.n_words(mixing.F.col("text")).alias("size"), mixing.tie().alias("tie")))
    got = mixing.copies(base).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    want = fill(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 2
    largest = {s: max(r["size"] for r in got if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= max(largest[s], 0.02 * want[s]) for s in sizes)


def test_reruns_agree(spark, docs):
    base = lambda: mixing.cut(docs(rows_of()).repartition(7).select("doc_id", "source", mixing.n_words(mixing.F.col("text")).alias("size"), mixing.tie().alias("tie")))
    key = lambda b: sorted((r["doc_id"], r["copies"]) for r in mixing.copies(b).collect())
    assert key(base()) == key(base())


def test_mix_emits_copies(spark, docs):
    table = docs(rows_of())
    got = mixing.mix(table)
    assert got.columns == table.columns
    n = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert set(n.values()) <= {1, 2} and len(n) > 400


def test_empty_and_zero(spark, docs):
    assert mixing.mix(docs([])).count() == 0
    base = mixing.cut(docs([(1, None), (2, "")]).select("doc_id", "source", mixing.n_words(mixing.F.col("text")).alias("size"), mixing.tie().alias("tie")))
    assert all(r["copies"] == 0 and r["target"] == 0 for r in mixing.copies(base).collect())
