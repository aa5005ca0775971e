"""Properties over generated sequences, many in one job."""

import re

import pytest
from pyspark.sql import functions as F

from seqloom.functions import bases, patterns, quality
from seqloom.operators import regions, sets
from seqloom.sources.readers import from_rows

hypothesis = pytest.importorskip("hypothesis")
from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
SEQS = st.lists(st.text("ACGTN", max_size=60), min_size=1, max_size=30)


def table(spark, seqs):
    return from_rows(spark, [{"id": f"s{i}", "sequence": s} for i, s in enumerate(seqs)])


def column(df, c):
    return [r["x"] for r in df.orderBy("_ord").select(c.alias("x")).collect()]


@FEW
@given(SEQS)
def test_complement_is_an_involution(spark, seqs):
    assert column(table(spark, seqs), bases.reverse_complement(bases.reverse_complement("sequence"))) == seqs


@FEW
@given(SEQS, st.text("ACGT", min_size=1, max_size=3))
def test_exact_places(spark, seqs, pattern):
    want = [[m.start() for m in re.finditer(f"(?={pattern})", s)] for s in seqs]
    df = table(spark, seqs)
    assert column(df, patterns.find_exact("sequence", pattern)) == want
    assert column(df, patterns.fuzzy_positions("sequence", pattern, 0)) == want


@FEW
@given(SEQS)
def test_regex_hits(spark, seqs):
    got = column(table(spark, seqs), patterns.regex_hits("sequence", "A+C?|G[TN]"))
    assert [[(h["start"], h["end"], h["value"]) for h in x] for x in got] == [[(m.start(), m.end(), m[0]) for m in re.finditer("A+C?|G[TN]", s)] for s in seqs]


@FEW
@given(SEQS, st.integers(1, 7), st.integers(1, 5))
def test_windows(spark, seqs, size, step):
    got = regions.windows(table(spark, seqs), size, step).select("original_id", "window_index", "sequence").collect()
    want = {(f"s{i}", k): s[a : a + size] for i, s in enumerate(seqs) for k, a in enumerate(range(0, len(s) - size + 1, step))}
    assert {(r["original_id"], r["window_index"]): r["sequence"] for r in got} == want


@FEW
@given(st.lists(st.text("!+5:?I", max_size=25), min_size=1, max_size=30), st.integers(1, 6))
def test_trim(spark, quals, window):
    def slow(q):
        v = [ord(c) - 33 for c in q]
        if not v or len(v) < window:
            return 0, len(v)
        good = [i for i in range(len(v) - window + 1) if sum(v[i : i + window]) >= 20 * window]
        return (good[0], good[-1] + window) if good else (0, 0)

    df = spark.createDataFrame([(i, q) for i, q in enumerate(quals)], "_ord long, quality string")
    got = [tuple(r["x"]) for r in df.orderBy("_ord").select(quality.trim_range("quality", 20, window).alias("x")).collect()]
    assert got == [slow(q) for q in quals]


@FEW
@given(SEQS)
def test_first_of_each_key(spark, seqs):
    got = {r["sequence"]: r["_ord"] for r in sets.rmdup(table(spark, seqs)).collect()}
    assert got == {s: seqs.index(s) for s in seqs}
    assert sets.dedup_stats(table(spark, seqs)).first()["unique"] == len(set(seqs))


@FEW
@given(st.lists(st.text('a"b;c ,', max_size=8), min_size=1, max_size=20))
def test_spreadsheet_quotes_only_what_is_risky(spark, fields):
    from seqloom.operators.tabular import SPREADSHEET, spreadsheet_safe

    df = spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "_ord long, f string")
    want = [f'"{f}"' if any(re.search(p, f) for p in SPREADSHEET) else f for f in fields]
    assert [r["x"] for r in df.orderBy("_ord").select(spreadsheet_safe(F.col("f")).alias("x")).collect()] == want
