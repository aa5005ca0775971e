import pytest
from pyspark.sql import functions as F

from seqloom import streaming
from seqloom.operators import records
from seqloom.schema import SeqError

SCHEMA = "_ord long, id string, sequence string, quality string, ts timestamp"


@pytest.fixture
def stream(spark, tmp_path):
    def make(rows, name="in"):
        df = spark.createDataFrame([(i, n, s, None, t) for i, (n, s, t) in enumerate(rows)], "_ord long, id string, sequence string, quality string, t string")
        df.select("_ord", "id", "sequence", "quality", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / name))
        return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / name))

    return make


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return df.sparkSession.table(name).collect()
    finally:
        q.stop()


def test_rmdup_and_stateless(stream):
    s = stream([("a", "AC", "2024-01-01 00:00:00"), ("b", "AC", "2024-01-01 00:01:00"), ("c", "G", "2024-01-01 00:02:00")])
    assert len(run(streaming.rmdup(s, "ts"), "dedup")) == 2
    assert {r["sequence"] for r in run(records.transform(s, reverse_complement=True), "rc")} == {"GT", "C"}


def test_pairs(stream):
    a = stream([("p/1", "AC", "2024-01-01 00:00:00"), ("q/1", "AC", "2024-01-01 00:00:00")], "a")
    b = stream([("p/2", "GG", "2024-01-01 00:01:00")], "b")
    got = run(streaming.pairs(a, b, "ts"), "pairs")
    assert [(r["id"], r["r2"]["sequence"]) for r in got] == [("p", "GG")]


def test_rename_and_stats(stream):
    s = stream([("a", "AC", "2024-01-01 00:00:00"), ("a", "GG", "2024-01-01 00:01:00"), ("b", "G", "2024-01-01 00:07:00")])
    assert sorted(r["id"] for r in run(streaming.rename(s), "renamed")) == ["a", "a_2", "b"]
    got = run(streaming.stats(s, "ts"), "st", "complete")
    assert sorted(r["num_sequences"] for r in got) == [1, 2]
    assert sorted(tuple(r) for r in run(streaming.length_histogram(s), "hist", "complete")) == [(1, 1), (2, 2)]


def test_unsupported(stream):
    s = stream([("a", "AC", "2024-01-01 00:00:00")])
    for f in (lambda: streaming.head(s, 1), lambda: streaming.sort(s), lambda: streaming.sample_systematic(s, 1)):
        with pytest.raises(SeqError):
            f()
