import pytest
from pyspark.sql import functions as F

from seqloom.functions import bind, bases, bloom, codons, coords, hashing, patterns, quality
from seqloom.schema import SeqError


@pytest.fixture(scope="module")
def ev(spark):
    one = spark.range(1)

    def run(c):
        return one.select(c.alias("x")).first()["x"]

    return run


def s(x):
    return F.lit(x)


def test_complements(ev):
    assert ev(bases.complement(s("ACGTNacgtn"))) == "TGCANtgcan"
    assert ev(bases.reverse_complement(s("AACGRY"))) == "RYCGTT"
    assert ev(bases.reverse_complement(s("ACGU"), rna=True)) == "ACGU"
    assert ev(bases.to_rna(s("ATtG"))) == "AUuG" and ev(bases.to_dna(s("AUuG"))) == "ATtG"


def test_content(ev):
    assert ev(bases.gc_content(s("GGCC"))) == 100 and ev(bases.gc_content(s("ATGC"))) == 50
    assert ev(bases.gc_content(s("NN"))) == 50 and ev(bases.gc_content(s("S"))) == 100 and ev(bases.gc_content(s(""))) == 0
    assert ev(bases.at_content(s("AAUW"))) == 100
    assert ev(bases.gc_skew(s("GGC"))) == pytest.approx(100 / 3) and ev(bases.at_skew(s("C"))) == 0
    assert ev(bases.gc_fraction(s("GC--"))) == 0.5 and ev(bases.gc_fraction(s(""))) is None
    assert ev(bases.shannon_entropy(s("ACGT"))) == 2 and ev(bases.shannon_entropy(s(""))) == 0
    assert ev(bases.alphabet(s("cAGa-"))) == "-ACG" and ev(bases.kernel_alphabet(s("cAGa-"))) == "ACG"
    assert ev(bases.complexity(s("AAAA"))) == pytest.approx(100 / 3) and ev(bases.complexity(s("A"))) == 0
    assert ev(bases.base_composition(s("AAc"))) == {"A": 2, "C": 1}
    assert ev(bases.base_count(s("AaCg"), "AC")) == 3 and ev(bases.base_content(s("AaCg"), "A", True)) == 25


def test_classify_and_validity(ev):
    c = ev(bases.classify(s("ATUGCNSWRYKMBDHV.-*!acgt")))
    assert (c["a"], c["n"], c["two_base"], c["three_base"], c["gap"], c["other"]) == (2, 1, 4, 4, 3, 1)
    assert ev(bases.is_valid(s("ACGT-"), "strict_dna")) and not ev(bases.is_valid(s("ACGU"), "strict_dna")) and ev(bases.is_valid(s("ACGU"), "normal_dna"))
    assert ev(bases.replace_invalid(s("AC!G-"), "strict_dna", "N")) == "ACNG-"
    assert [ev(bases.sequence_type(s(x))) for x in ("ACGT", "ACGU", "MKL", "", "!")] == ["dna", "rna", "protein", "unknown", "unknown"]
    assert ev(bases.is_primer(s("ACGTACGTAC"))) and not ev(bases.is_primer(s("ACGT")))
    assert ev(bases.is_palindromic(s("GAATTC"))) and not ev(bases.is_palindromic(s("GAATTA")))
    assert sorted(ev(bases.expand_ambiguous(s("AR")))) == ["AA", "AG"] and ev(bases.expand_ambiguous(s("N" * 9), 1000)) is None


def test_hashes(ev):
    assert ev(hashing.md5(s("acgt"))) == ev(hashing.md5(s("ACGT"))) != ev(hashing.md5(s("acgt"), True))
    assert ev(hashing.string_hash(s("A"))) == 5381 * 31 + 65
    assert ev(hashing.murmur3(s(""))) == 0 and ev(hashing.murmur3(s("ATCG"))) != ev(hashing.murmur3(s("ATCG"), seed=42))
    with pytest.raises(KeyError):
        hashing.hash_of("x", "crc")


def test_quality(ev):
    assert ev(quality.average(s("II!!"))) == 20 and ev(quality.average(s(""))) == 0
    assert ev(quality.convert(s("IIII"), "phred33", "phred64")) == "hhhh" and ev(quality.convert(s("hhhh"), "phred64", "phred33")) == "IIII"
    assert ev(quality.convert(s("!!"), "phred33", "solexa")) == ";;"
    assert quality.convert_score(10, "solexa", "phred33") == 10 and quality.convert_score(-5, "solexa", "phred33") == 1
    assert quality.representatives([15, 30]) == [7, 22, 40] and quality.bin_index(15, [15, 30]) == 1
    assert ev(quality.binned(s("!0I"), [15, 30])) == "(7I"
    st = ev(quality.quality_stats(s("!+5I")))
    assert (st["min"], st["max"], st["mean"], st["median"], st["count"]) == (0, 40, 17.5, 15, 4)
    assert [ev(quality.detect_encoding(s(q))) for q in ("!!5", "hhhh", ";<=h", "@ABh", "")] == ["phred33", "phred64", "solexa", "phred64", "phred33"]
    assert ev(quality.detect_encoding_with_confidence(s("!!5")))["confidence"] == 0.95
    with pytest.raises(SeqError):
        quality.boundaries_of(4, "illumina")


@pytest.mark.parametrize(
    ("q", "want"),
    [("IIIIIIII", (0, 8)), ("!!!!IIIIIIII!!!!", (2, 14)), ("!!!!!!", (0, 0)), ("II", (0, 2)), ("", (0, 0)), ("IIII!!!!", (0, 6))],
)
def test_trim(ev, q, want):
    assert tuple(ev(quality.trim_range(s(q), 20, 4))) == want


def test_codons(ev):
    assert codons.codon_table(1)["ATG"] == "M" and codons.codon_table(2)["AGA"] == "*" and codons.codon_table(12)["CTG"] == "S"
    assert len(codons.list_genetic_codes()) == 26 and all(len(codons.codon_table(c)) == 64 for c in codons.CODES)
    assert codons.translate_codon("ACN") == "T" and codons.translate_codon("NTG") == "X" and codons.translate_codon("aug") == "M" and codons.translate_codon("A-G") == "X"
    assert ev(codons.translate(s("ATGGCNTAAGG"))) == "MA*" and ev(codons.translate(s("ATGGCNTAAGG"), remove_stop_codons=True)) == "MA"
    assert ev(codons.translate(s("CATGA"), frame=-3)) == "M" and ev(codons.translate(s("AT"))) == ""
    assert ev(codons.translate(s("TTGTAATTG"), convert_start_codons=True, trim_at_first_stop=True)) == "M"
    assert ev(codons.first_orf(s("CCATGAAATAGATG"), frame=3)) == "MK*" and ev(codons.first_orf(s("CCCC"))) is None
    orfs = ev(codons.find_orfs(s("ATGAAACCCTAG"), min_length=2))
    assert [(o["start"], o["end"], o["frame"], o["protein"]) for o in orfs if o["strand"] == "+" and o["frame"] == 1] == [(0, 10, 1, "MKP")]


def test_patterns(ev):
    assert ev(patterns.find_exact(s("AAAA"), "AA")) == [0, 1, 2] and ev(patterns.find_exact(s("CAAC"), "AA")) == [1] and ev(patterns.find_exact(s(""), "A")) == []
    assert ev(patterns.find_ambiguous(s("ACGTN"), "NG")) == [1] or ev(patterns.find_ambiguous(s("ACGTN"), "NG")) == [1, 3]
    assert ev(patterns.fuzzy_positions(s("ACGTACCT"), "ACGT", 1)) == [0, 4]
    assert [tuple(h) for h in ev(patterns.regex_hits(s("aXbbXc"), "b+|X"))] == [(1, 2, "X"), (2, 4, "bb"), (4, 5, "X")]
    assert ev(patterns.has_within_edits(s("GATTACA"), ["GATACA"], 1)) and not ev(patterns.has_within_edits(s("GGGGGGG"), ["GATACA"], 1)) and not ev(patterns.has_within_edits(s("GAT"), ["GATACA"], 3))
    assert ev(patterns.longest_common_substring(s("xabcy"), s("zabcw"))) == "abc"
    assert (0, 4) in [tuple(p) for p in ev(patterns.palindromes(s("ABBAC")))]
    assert [tuple(t) for t in ev(patterns.tandem_repeats(s("ACACACG"), 2))] == [(0, 6, "AC", 3)]


def test_edit_distance_against_table():
    import random

    r = random.Random(3)
    for _ in range(200):
        p, t = "".join(r.choice("ACGT") for _ in range(r.randint(1, 9))), "".join(r.choice("ACGT") for _ in range(r.randint(1, 25)))
        row = list(range(len(p) + 1))
        best = [row[-1]]
        for ch in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != ch), row[i + 1] + 1, new[i] + 1))
            row = new
            best.append(row[-1])
        for k in range(3):
            want = [i for i, d in enumerate(best) if d <= k and i > 0]
            assert list(patterns.edit_ends(t.encode(), p, k, patterns._bit_masks(p, False, False))) == want


def test_coordinates(ev):
    assert coords.parse_region("3:-1") == (3, -1)
    with pytest.raises(SeqError):
        coords.parse_region("x")
    assert [ev(coords.pair_id(s(x))) for x in ("a/1", "a.R2", "a_r1", "ab1")] == ["a", "a", "a", "ab1"]
    assert ev(coords.parse_rgb(s("1,2,300"))) is None and ev(coords.parse_rgb(s("1,2,3")))["b"] == 3
    a = ev(coords.gtf_attributes(s('gene_id "a b"; tag x; tag "y"; level 2;')))
    assert a == {"gene_id": ["a b"], "tag": ["x", "y"], "level": ["2"]}
    assert ev(coords.gtf_database(F.create_map(s("gene_biotype"), F.array(s("x"))))) == "Ensembl"


def test_bloom(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    f = bloom.build(df, "k", 500, 0.01)
    assert all(f.contains(f"k{i}") for i in range(500)) and sum(f.contains(f"z{i}") for i in range(1000)) < 40
    assert df.filter(bloom.might_contain(f, "k")).count() == 500
    c = bloom.CountingBloomFilter(10)
    c.add("a")
    assert c.contains("a") and c.remove("a") and not c.contains("a") and not c.remove("a")
    g = bloom.ScalableBloomFilter(10)
    for i in range(100):
        g.add(str(i))
    assert all(g.contains(str(i)) for i in range(100)) and len(g.filters) > 1


def test_matcher_and_validator(ev):
    from seqloom.functions.matcher import SequenceMatcher, SequenceValidator, has_pattern

    m = SequenceMatcher("ACG")
    assert ev(m.find_all(s("ACGACG"))) == [0, 3] and ev(m.find_first(s("TACG"))) == 1 and ev(m.find_first(s("TTT"))) is None and ev(m.count(s("ACGACG"))) == 2
    assert ev(SequenceMatcher("ACR", ambiguous=True).find_all(s("ACATACC"))) == [0] and ev(SequenceMatcher("acg", ignore_case=True).test(s("ACG"))) and ev(has_pattern(s("ACC"), "ACG", 1))
    v = SequenceValidator("strict", "dna")
    assert not ev(v.validate(s("ACN"))) and ev(v.clean(s("ACX"))) == "ACN" and ev(v.with_settings(mode="normal").validate(s("ACN"))) and ev(v.with_settings("permissive").validate(s("xyz")))


def test_batch_searches_equal_plain_ones(spark):
    """Edit and substitution search of whole batches, with rows longer than a stretch, against plain loops."""
    import random

    import numpy as np
    import pyarrow as pa

    from seqloom.functions.kernels import letters

    r = random.Random(8)
    texts = ["".join(r.choice("ACGT") for _ in range(r.choice([0, 3, 40, 300, 5000]))) for _ in range(60)] + [None, "é" * 30, "ACGTTTGACCAé"]
    x, starts, lengths = letters(pa.array(texts))
    for p, k in (("ACGTTTGACCA", 2), ("ACGTACGTACGTA", 3), ("AC", 0)):
        masks = patterns._bit_masks(p, False, False)
        got = patterns._any_within_edits(x, starts, lengths, p, k, masks)
        rows = [(t or "").encode("latin-1", "replace") for t in texts]
        assert got.tolist() == [len(p) <= len(t) and next(patterns.edit_ends(t, p, k, masks), None) is not None for t in rows]
        assert np.array_equal(patterns._any_within_edits(x, starts, lengths, p, k, masks), got)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in df.select("t", patterns.hamming_hits("t", "ACGTT", 1).alias("h")).collect():
        t = row["t"] or ""
        want = [(i, i + 5, d) for i in range(len(t) - 4) for d in [sum(a != b for a, b in zip(t[i : i + 5], "ACGTT", strict=True))] if d <= 1]
        assert [tuple(h) for h in row["h"]] == want


def test_blocks_and_sums(spark):
    text = "aé𝔘" * 1500
    df = spark.createDataFrame([(text,), ("abc",), ("",)], "t string")
    cut = lambda a, b: F.coalesce(patterns.taken(patterns.blocks("t"), F.lit(a), F.least(F.lit(b), F.length("t"))), F.lit(""))
    for a, b in ((0, 3), (1000, 1030), (1020, 4400), (5, 5)):
        assert [r[0] for r in df.select(cut(a, b)).collect()] == [text[a:b], "abc"[a:b], ""]
    got = df.select(bind.let(F.sequence(F.lit(1), F.length("t") + 1), patterns.prefix_sums).alias("s")).collect()
    assert got[1]["s"] == [1, 3, 6, 10] and got[0]["s"][-1] == 4501 * 4502 // 2


def test_substrings_of_a_batch_equal_plain_ones(spark):
    import random

    r = random.Random(11)
    rows = [("".join(r.choice("ACGé") for _ in range(r.randrange(30))), "".join(r.choice("ACGé") for _ in range(r.randrange(30)))) for _ in range(300)] + [(None, "A"), ("", ""), ("日本日", "本日")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a string, b string")
    got = df.select("i", patterns.longest_common_substring("a", "b").alias("c"), patterns.palindromes("a", 2, 9).alias("p"), patterns.tandem_repeats("a", 1, 3, 2).alias("t")).collect()
    for g in got:
        a, b = (x or "" for x in rows[g["i"]])
        pieces = [a[i:j] for i in range(len(a)) for j in range(i + 1, len(a) + 1)]
        common = [x for x in pieces if x in b]
        top = max(map(len, common), default=0)
        assert g["c"] == next((x for x in common if len(x) == top), "")
        assert [tuple(p) for p in g["p"]] == [(i, j) for i in range(len(a)) for j in range(i + 2, min(len(a), i + 9) + 1) if a[i:j] == a[i:j][::-1]]
        want, i = [], 0
        while i < len(a):
            for u in (1, 2, 3):
                n = 1
                while len(a[i : i + u]) == u and a[i + n * u : i + (n + 1) * u] == a[i : i + u]:
                    n += 1
                if n >= 2:
                    want.append((i, i + n * u, a[i : i + u], n))
                    i += n * u - 1
                    break
            i += 1
        assert [tuple(t) for t in g["t"]] == want
