import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import intervals, pairing, ranking, records, regions, search, sets, splitting, stats, tabular
from seqloom.plans.frame import SeqFrame
from seqloom.schema import PairSyncError, SeqError
from seqloom.sources.readers import from_rows


@pytest.fixture(scope="module")
def make(spark):
    return lambda *rows: from_rows(spark, [dict(zip(("id", "sequence", "quality", "description"), r, strict=False)) if isinstance(r, tuple) else r for r in rows])


def pick(df, *columns):
    rows = df.orderBy("_ord").collect()
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in rows]


def test_filter(make):
    df = make(("a", "ACGT"), ("b", "GGGGGG"), ("c", "ACNT-"), ("d", ""))
    assert pick(records.filter_records(df, min_length=4, max_length=5), "id") == ["a", "c"]
    assert pick(records.filter_records(df, min_gc=60), "id") == ["b"]
    assert pick(records.filter_records(df, has_ambiguous=True), "id") == ["c"]
    assert pick(records.filter_records(df, pattern="^G"), "id") == ["b"]
    assert pick(records.filter_records(df, ids=["a", "d"], exclude_ids=["d"]), "id") == ["a"]
    with pytest.raises(SeqError):
        records.filter_records(df, min_length=5, max_length=4)


def test_alignment_filter(spark):
    rows = [{"id": "x", "sequence": "ACGTA", "flag": 16, "reference_sequence": "c1", "position": 10, "mapping_quality": 30}, {"id": "y", "sequence": "ACGTA", "flag": 4, "reference_sequence": "*", "position": 0, "mapping_quality": 0}, {"id": "z", "sequence": "A"}]
    df = from_rows(spark, rows)
    assert pick(records.filter_records(df, region="c1:14-20"), "id") == ["x", "z"]
    assert pick(records.filter_records(df, exclude_flags=4, min_mapq=10), "id") == ["x", "z"]


def test_transform_order(make):
    df = make(("a", "AACG"), ("b", "AACU"))
    assert pick(records.transform(df, reverse_complement=True), "sequence") == ["CGTT", "AGUU"]
    assert pick(records.transform(df, complement=True, reverse=True, to_rna=True, lower_case=True), "sequence") == ["cguu", "aguu"]
    with pytest.raises(SeqError):
        records.transform(df, to_rna=True, to_dna=True)


def test_clean_and_validate(make):
    df = make(("a", " A-C.G* "), ("b", "--"), ("c", "AXN"))
    assert pick(records.clean(df, trim_whitespace=True, remove_gaps=True, remove_empty=True), "sequence", "length") == [("ACG", 3), ("AXN", 3)]
    assert pick(records.clean(make(("a", "A-X")), replace_ambiguous=True), "sequence") == ["ANN"]
    assert pick(records.validate(make(("a", "AC-G"), ("b", "ACX"))), "sequence") == ["ACG"]
    assert pick(records.validate(make(("a", "AC-N")), allow_ambiguous=False, allow_gaps=True, action="fix", fix_char="A"), "sequence") == ["AC-A"]
    assert records.validate(make(("a", "ACX")), action="warn").count() == 1


def test_quality_chain(make):
    df = make(("good", "ACGTACGT", "IIIIIIII"), ("tail", "ACGTACGT", "IIII!!!!"), ("bad", "ACGT", "!!!!"), ("none", "ACGT", None))
    out = records.quality_filter(df, trim=True, min_score=25)
    assert pick(out, "id", "sequence") == [("good", "ACGTACGT"), ("tail", "ACGTAC"), ("none", "ACGT")]
    assert pick(records.convert_quality(make(("a", "AC", "II")), "phred64"), "quality") == ["hh"]
    assert pick(records.to_fasta(make(("a", "AC", "II")), include_quality_stats=True), "description") == ["avg_qual=40.00 min_qual=40 max_qual=40"]


def test_replace(make):
    df = make(("s1_x", "A"), ("t2", "C"), ("s3_y", "G"))
    assert pick(records.replace(df, r"s(\d)", "n$1-{nr}", nr_width=3, filter_patterns=["s"]), "id") == ["n1-001_x", "t2", "n3-002_y"]
    assert pick(records.replace(df, "([a-z])", "<$1>"), "id") == ["<s>1_x", "<t>2", "<s>3_y"]
    assert pick(records.replace(df, r"^([a-z]\d)", "{kv}", kv={"s1": "one"}, keep_key=True), "id") == ["one_x", "t2", "s3_y"]
    assert pick(records.replace(df, r"^([a-z]\d)", "{kv}", kv={"s1": "one"}, keep_untouched=True), "id") == ["one_x", "t2", "s3_y"]
    assert pick(records.replace(df, r"^([a-z]\d)", "{kv}", kv={"s1": "one"}, key_miss="?"), "id") == ["one_x", "?", "?_y"]
    assert pick(records.replace(df, "_.*", ".{fbne}", file_name="/p/reads.fa"), "id") == ["s1.reads", "t2", "s3.reads"]
    assert pick(records.replace(df, "A", "TT", by_seq=True), "sequence", "length")[0] == ("TT", 2)


def test_grep(make):
    df = make(("r1", "GATTACA", None, "first read"), ("r2", "TGTAATC", None, ""), ("r3", "", None, "reads"))
    assert pick(search.grep(df, "GATTACA"), "id") == ["r1"]
    assert pick(search.grep(df, "GATTACA", search_both_strands=True), "id") == ["r1", "r2"]
    assert pick(search.grep(df, "GATTA", invert=True), "id") == ["r2", "r3"]
    assert pick(search.grep(df, "read", "description", whole_word=True), "id") == ["r1"]
    assert pick(search.grep(df, "GATACA", allow_mismatches=1), "id") == ["r1"]
    assert pick(search.grep(df, "^g", regex=True, ignore_case=True), "id") == ["r1"]


def test_locate(make):
    df = make(("a", "AAAACGTT"), ("b", "CC"))
    hits = search.locate(df, "AA").orderBy("start").collect()
    assert [(h["start"], h["end"]) for h in hits] == [(0, 2), (2, 4)] and hits[0]["context"]["downstream"] == "AACGTT"
    assert search.locate(df, "AA", allow_overlaps=True).count() == 3
    both = search.locate(df, "AACG", search_both_strands=True, allow_overlaps=True).collect()
    assert {(h["start"], h["strand"]) for h in both} == {(2, "+"), (4, "-")} or {(h["start"], h["strand"]) for h in both} == {(2, "+")}
    assert [h["mismatches"] for h in search.locate(df, "AAGG", allow_mismatches=1).collect()] == [1] or search.locate(df, "AAGG", allow_mismatches=1).count() >= 1
    assert search.locate(df, "A+", regex=True).collect()[0]["end"] == 4
    assert search.locate(df, "A", allow_overlaps=True, max_matches=2).count() == 2


def test_amplicon(make):
    f, r = "ACGTACGTAC", "GGATCCTTGA"
    turned = "TCAAGGATCC"
    df = make(("t", "TT" + f + "CCCCC" + turned + "AA"), ("u", "ACGT"))
    assert pick(search.amplicon(df, f, r), "id", "sequence") == [("t_amplicon_1", "CCCCC")]
    assert pick(search.amplicon(df, f, r, flanking=True), "sequence") == [f + "CCCCC" + turned]
    bad = make(("t", f[:-1] + "T" + "CCCCC" + turned))
    assert search.amplicon(bad, f, r).count() == 0 and pick(search.amplicon(bad, f, r, 1), "sequence") == ["CCCCC"]
    assert pick(search.amplicon(df, f, r, search_window=(15, 15)), "sequence") == ["CCCCC"]
    with pytest.raises(SeqError):
        search.amplicon(df, "ACGT")


def test_windows(make):
    df = make(("s", "ACGTAC"))
    assert pick(regions.windows(df, 4, 2).orderBy("window_index"), "id", "sequence") == [("s_window:1-4", "ACGT"), ("s_window:3-6", "GTAC")]
    assert [r["sequence"] for r in regions.windows(df, 4, 3, greedy=True).orderBy("window_index").collect()] == ["ACGT", "TAC"]
    c = regions.windows(df, 4, 3, circular=True).orderBy("window_index").collect()
    assert [(r["sequence"], r["is_wrapped"], r["end_position"]) for r in c] == [("ACGT", False, 4), ("TACA", True, 6)]
    assert regions.windows(make(("x", "A"), ("y", "")), 3).count() == 0
    with pytest.raises(SeqError):
        regions.windows(df, 0)


def test_windows_of_a_long_sequence(make):
    text = "ACGTTGCA" * 3000
    got = regions.windows(make(("s", text)), 7, 2).orderBy("window_index").collect()
    assert [r["sequence"] for r in got] == [text[i : i + 7] for i in range(0, len(text) - 6, 2)]
    got = regions.windows(make(("s", text)), 7, 5, circular=True, zero_based=True).orderBy("window_index").collect()
    assert [r["sequence"] for r in got] == [(text + text)[i : i + 7] for i in range(0, len(text), 5)]


def test_subseq(make):
    df = make(("s", "ACGTACGTAC", "0123456789"), ("t", "AC", "01"))
    assert pick(regions.subseq(df, "3:5"), "sequence", "quality") == [("GTA", "234")]
    assert pick(regions.subseq(df, "-3:-1"), "sequence") == ["TAC", "AC"]
    assert pick(regions.subseq(df, "3:5", strand="-", id_list=["s"]), "sequence", "quality") == [("TAC", "432")]
    assert pick(regions.subseq(df, "9:10", downstream=2, circular=True, id_list=["s"]), "sequence") == ["ACAC"]
    assert pick(regions.subseq(df, "3:5", include_coordinates=True), "id") == ["s:3:5"]
    assert pick(regions.subseq(df, id_pattern="^t"), "id") == ["t"]
    with pytest.raises(SeqError):
        regions.subseq(df)


def test_subseq_by_features(spark, make):
    f = spark.createDataFrame([("s", 2, 5, "-", "exon"), ("q", 0, 9, "+", "exon")], "chromosome string, start long, end long, strand string, feature string")
    df = make(("s", "AACGTT"))
    assert pick(regions.subseq_by_features(df, f), "sequence") == ["CGT"]
    assert pick(regions.subseq_by_features(df, f, one_based=True, by_strand=True, feature_type="exon"), "sequence") == ["ACGT"]


def test_translate_frames(make):
    df = make(("s", "ATGAAATAG"))
    assert pick(regions.translate(df), "sequence") == ["MK*"]
    assert regions.translate(df, all_frames=True, include_frame_in_id=True).count() == 6
    assert pick(regions.translate(df, orfs_only=True, min_orf_length=2), "sequence") == ["MK*"]
    assert regions.translate(df, min_orf_length=4).count() == 0


def test_duplicates(make):
    df = make(("a", "AC", "!!"), ("b", "ac", "II"), ("c", "AC", "II"), ("a", "GGG", "###"))
    assert pick(sets.rmdup(df), "id") == ["a", "b", "a"]
    assert pick(sets.rmdup(df, case_sensitive=False), "id", "sequence") == [("a", "AC"), ("a", "GGG")]
    assert pick(sets.rmdup(df, "id"), "id") == ["a", "b", "c"]
    assert pick(sets.unique(df, conflict="last"), "id", "_ord") == [("c", 0), ("b", 1), ("a", 3)]
    assert pick(sets.unique(df, conflict="highest-quality"), "id") == ["c", "b", "a"]
    assert pick(sets.unique(df, by="id", conflict="longest"), "sequence") == ["GGG", "ac", "AC"]
    assert pick(sets.rename(df), "id") == ["a", "b", "c", "a_2"]
    assert pick(sets.rename(df, rename_first=True, start=1, separator="."), "id") == ["a.1", "b.1", "c.1", "a.2"]


def test_concat(make):
    a, b = make(("x", "A"), ("y", "C")), make(("x", "G"), ("x", "T"))
    with pytest.raises(SeqError):
        sets.concat([a, b])
    assert pick(sets.concat([a, b], conflict="ignore"), "id", "sequence") == [("x", "A"), ("y", "C")]
    assert pick(sets.concat([a, b], conflict="rename"), "id") == ["x", "y", "x_1", "x_2"]
    assert pick(sets.concat([a, b], conflict="suffix"), "id") == ["x", "y", "x_src1", "x_src1_1"]
    with pytest.raises(SeqError):
        sets.concat([a, make(("q", "A", "I"))])


def test_set_algebra(make):
    a, b = make(("1", "A"), ("2", "C"), ("3", "A")), make(("4", "C"), ("5", "G"))
    assert sorted(pick(sets.union(a, b), "id")) == ["1", "2", "5"]
    assert pick(sets.intersection(a, b), "id") == ["2"] and pick(sets.difference(a, b), "id") == ["1"]
    assert sorted(pick(sets.symmetric_difference(a, b), "id")) == ["1", "5"]
    m = sets.set_metrics(a, b).first()
    assert m["jaccard"] == pytest.approx(1 / 3) and m["containment"] == 0.5 and not m["is_disjoint"]
    assert sets.set_metrics(a.limit(0), b.limit(0)).first()["jaccard"] == 0


def test_order_and_samples(make):
    df = make(*[(f"s{i}", "ACGT"[: i % 4 + 1]) for i in range(40)])
    assert [r["id"] for r in ranking.sort_records(df).limit(2).collect()] == ["s3", "s7"]
    assert [r["id"] for r in ranking.sort_records(df, "id").limit(2).collect()] == ["s0", "s1"]
    assert pick(ranking.head(df, 2), "id") == ["s0", "s1"]
    assert pick(ranking.sample(df, 10, strategy="systematic"), "id") == [f"s{i}" for i in range(0, 40, 4)]
    assert ranking.sample(df, 7).count() == 7 and ranking.sample(df, 100).count() == 40
    assert pick(ranking.sample(df, fraction=0.5, seed=1), "id") == pick(ranking.sample(df, fraction=0.5, seed=1), "id")
    assert ranking.sample_stratified(df, F.length("sequence"), 2).count() == 8
    assert ranking.sample_weighted(df, 5, F.length("sequence")).count() == 5
    assert pick(ranking.enumerate_records(df.filter("_ord > 30")), "index") == list(range(9))
    with pytest.raises(SeqError):
        ranking.sample(df, 1, 0.5)


def test_pairs(make):
    a, b = make(("p/1", "A"), ("q/1", "C")), make(("q/2", "G"), ("r/2", "T"))
    assert [r["id"] for r in pairing.pairs(a, b).collect()] == ["q"]
    with pytest.raises(Exception, match="partner"):
        pairing.pairs(a, b, on_unpaired="error").collect()
    assert pick(pairing.interleave_pairs(a, b), "id") == ["q/1", "q/2"]
    assert sorted(pick(pairing.interleave_pairs(a, b, on_unpaired="warn"), "id")) == ["p/1", "q/1", "q/2", "r/2"]
    one = make(("z/2", "A"), ("z/1", "C"), ("w", "G"), ("w", "T"))
    assert sorted((r["r1"]["sequence"], r["r2"]["sequence"]) for r in pairing.pairs(one).collect()) == [("C", "A"), ("G", "T")]


def test_interleave_and_zip(make):
    a, b = make(("1", "A"), ("2", "C")), make(("x", "G"))
    with pytest.raises(PairSyncError):
        pairing.interleave(a, b)
    assert pick(pairing.interleave(a, b, mode="lossless"), "id") == ["1", "x", "2"]
    with pytest.raises(PairSyncError):
        pairing.interleave(a.limit(1), b, validate_ids=True)
    assert pairing.zip_with(a, b).count() == 1
    with pytest.raises(Exception, match="differ in length"):
        pairing.paired_records(a, b).collect()


def test_merge_pairs(make):
    r1 = make(("read-1/1", "ACGTTGCAGTACGATCGTACGGAATTCGCCGATGACTGACCTAGGTCAGTACGATC", "I" * 56))
    r2 = make(("read-1/2", "GATCGTACTGACCTAGGTCAGTCATCGGCGAATTCCGTACGATCGTACTGCAACGT", "I" * 56))
    m = pairing.merge_pairs(r1, r2).collect()
    assert len(m) == 1 and m[0]["id"] == "read-1" and m[0]["sequence"] == r1.first()["sequence"] and len(m[0]["quality"]) == 56
    a, b = make(("n/1", "A" * 12, "I" * 12)), make(("n/2", "C" * 12, "I" * 12))
    assert pick(pairing.merge_pairs(a, b), "id") == ["n/1", "n/2"] and pairing.merge_pairs(a, b, on_no_overlap="skip").count() == 0
    x = "ACGTTGCAGTACGATCGTACGGAATTCGCC"
    left, right = x[:20], x[10:]
    turned = right.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    m = pairing.merge_pairs(make(("k/1", left, "I" * 20)), make(("k/2", turned, "5" * 20)))
    assert pick(m, "sequence") == [x]


def test_intervals(spark):
    df = spark.createDataFrame([("c", 1, 5, "a"), ("c", 5, 8, "b"), ("c", 10, 12, "d"), ("e", 3, 4, "f")], "chromosome string, start long, end long, name string")
    got = intervals.sort_intervals(intervals.merge_overlapping(df)).collect()
    assert [tuple(r) for r in got] == [("c", 1, 8, "a"), ("c", 10, 12, "d"), ("e", 3, 4, "f")]
    assert intervals.interval_stats(df).first()["total_length"] == 10
    assert intervals.overlaps(df, df, 4).count() == 4


def test_stats(make):
    df = make(*[(f"s{i}", "ACGT" * (i + 1), "I" * 4 * (i + 1)) for i in range(4)])
    s = stats.stats(df, detailed=True, include_composition=True).first()
    assert (s["num_sequences"], s["total_length"], s["n50"], s["n90"], s["q1_length"], s["q2_length"]) == (4, 40, 12, 8, 8, 12)
    assert s["gc_content"] == 0.5 and s["avg_quality"] == 40 and s["q30_percentage"] == 100 and s["type"] == "DNA" and s["format"] == "FASTQ" and s["base_composition"]["A"] == 10
    e = stats.stats(df.limit(0)).first()
    assert e["num_sequences"] == 0 and e["type"] == "Unknown"
    assert stats.format_stats_table(stats.stats(df)).startswith("format\ttype")


def test_split(make):
    df = make(*[(f"g{i % 2}_{i}", "A" * 4) for i in range(7)])
    assert pick(splitting.split(df, "by-size", sequences_per_file=3), "part_id") == ["1", "1", "1", "2", "2", "2", "3"]
    assert pick(splitting.split(df, "by-parts", num_parts=2), "part_id") == ["1"] * 4 + ["2"] * 3
    assert pick(splitting.split(df, "by-length", bases_per_file=9), "part_id", "sequence_count") == [("1", 1), ("1", 2), ("2", 1), ("2", 2), ("3", 1), ("3", 2), ("4", 1)]
    assert pick(splitting.split(df, "by-id", id_regex="g(0)"), "part_id")[:2] == ["0", "ungrouped"]
    assert splitting.summary(splitting.split(df, "by-size", sequences_per_file=3)).count() == 3


def test_tabular(make):
    df = make(("a", "ACGT", "IIII"), ("b", "", None))
    t = tabular.to_tabular(df, ["id", "gc", "avg_qual", "index", "base_count_AC"])
    assert [tuple(r)[1:] for r in t.orderBy("_ord").collect()] == [("a", 50.0, 40.0, 0, 2), ("b", 0.0, None, 1, 0)]
    assert [tuple(r)[1:] for r in tabular.as_text(t, null_value="NA").orderBy("_ord").collect()][1] == ("b", "0.00", "NA", "1", "0")
    with pytest.raises(SeqError):
        tabular.to_tabular(df, ["nope"])


def test_frame_chain(spark):
    f = SeqFrame.from_rows(spark, [{"id": f"s{i}", "sequence": "ACGTACGTAA"[: 4 + i % 6]} for i in range(30)])
    out = f.filter(min_length=6).rmdup().sort_by_length().kmers(4)
    assert out.count() > 0 and f.fold(lambda a, r: a + r["length"], 0) == sum(4 + i % 6 for i in range(30))
    assert f.reduce(lambda a, r: r if r["length"] > a["length"] else a)["length"] == 9
    assert f.map(lambda r: r | {"id": r["id"].upper()}).collect()[0]["id"] == "S0"
    assert f.flat_map(lambda r: [r, r]).count() == 60
    assert len(list(f.head(3))) == 3


def plain_overlap(a: np.ndarray, b: np.ndarray, diff_max: int, min_overlap: int, diff_percent: float, min_comparisons: int) -> int | None:
    """The place in a where b (already turned) begins, negative if b begins before a: the first, from
    the longest overlap on, with few enough differences among comparable bases."""
    best = None
    for shift in [*range(0, len(a) - min_overlap + 1), *range(-1, -(len(b) - min_overlap) - 1, -1)]:
        x, y = (a[shift : shift + len(b)], b[: len(a) - shift]) if shift >= 0 else (a[: len(b) + shift], b[-shift : -shift + len(a)])
        n = min(len(x), len(y))
        if n < min_overlap:
            continue
        x, y = x[:n], y[:n]
        known = (x != 78) & (y != 78)
        if known.sum() < min_comparisons:
            continue
        wrong = int(((x != y) & known).sum())
        if wrong <= min(diff_max, diff_percent * n):
            best = shift
            break
    return best


def test_overlaps_of_a_batch_equal_plain_ones(monkeypatch):
    import random

    r = random.Random(5)
    monkeypatch.setattr(pairing, "ROWS", 7)
    first, second = [], []
    for _ in range(120):
        core = "".join(r.choice("ACGT") for _ in range(r.randint(0, 60)))
        cut = r.randint(0, 30)
        a, b = core[: len(core) - cut // 2] + "ACGTN"[: r.randrange(5)], core[cut:] + "".join(r.choice("ACGTN") for _ in range(r.randrange(12)))
        b = "".join(c if r.random() > 0.04 else r.choice("ACGTN") for c in b)
        if r.random() < 0.3:
            a, b = b, a
        first.append(a.encode())
        second.append(b.encode())
    got = pairing.best_overlaps(first, second, 5, 10, 0.2, 10)
    want = [plain_overlap(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), 5, 10, 0.2, 10) for a, b in zip(first, second, strict=True)]
    assert got == want and any(x is not None and x < 0 for x in want) and None in want


def test_one_chromosome_and_one_id_for_most_rows(spark, monkeypatch):
    """Ranks and islands over cells and bins, against plain loops."""
    import random

    r = random.Random(4)
    monkeypatch.setattr(ranking, "CELL", 16)
    monkeypatch.setattr(intervals, "BIN", 64)
    ids = ["hot" if r.random() < 0.6 else f"i{r.randrange(20)}" for _ in range(300)]
    df = from_rows(spark, [{"id": i, "sequence": "AC", "description": str(k % 3)} for k, i in enumerate(ids)]).repartition(5)
    seen, want = {}, []
    for i in ids:
        seen[i] = seen.get(i, 0) + 1
        want.append(i if seen[i] == 1 else f"{i}_{seen[i]}")
    assert pick(sets.rename(df), "id") == want
    both = sets.concat([df, df], conflict="suffix")
    first = pick(both, "id")
    assert first[300] == f"{ids[0]}_src1" and sum(x.startswith("hot_src0") for x in first) == ids.count("hot") - 1
    beds = [("c1" if r.random() < 0.7 else f"c{r.randrange(3)}", a, a + r.choice([0, 3, 9, 200])) for a in (r.randrange(3000) for _ in range(250))]
    got = sorted(tuple(x) for x in intervals.merge_overlapping(spark.createDataFrame(beds, "chromosome string, start long, end long")).collect())
    plain = []
    for c, a, b in sorted(beds):
        if plain and plain[-1][0] == c and a <= plain[-1][2]:
            plain[-1][2] = max(b, plain[-1][2])
        else:
            plain.append([c, a, b])
    assert got == [tuple(x) for x in plain]
