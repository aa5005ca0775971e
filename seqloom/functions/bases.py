"""Functions of a sequence column. All are built-in expressions, so chains of them fuse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.bind import let

# IUPAC complement pairs.
COMPLEMENT_FROM = "ACGTURYSWKMBDHVN"
COMPLEMENT_TO = "TGCAAYRSWMKVHDBN"
# What each IUPAC code stands for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
#: Classes that classify() counts.
CLASSES = {"a": "A", "t": "T", "u": "U", "g": "G", "c": "C", "n": "N", "strong": "S", "weak": "W", "two_base": "RYKM", "three_base": "BDHV", "gap": ".-*"}
# The letters of each validation mode; gaps are valid in all of them.
VALID = {"strict_dna": "ACGT", "normal_dna": "ACGTURYSWKMBDHVN", "strict_rna": "ACGU", "normal_rna": "ACGURYSWKMBDHVN", "protein": "ACDEFGHIKLMNPQRSTVWYBZJXUO"}
GAPS = ".-*"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_of(seq: str | Column, letters: str, case_sensitive: bool = False) -> Column:
    """How many characters of a sequence are one of the letters."""
    s = _c(seq)
    s = s if case_sensitive else F.upper(s)
    letters = letters if case_sensitive else letters.upper()
    return F.length(s) - F.length(F.translate(s, letters, ""))


def complement(seq: str | Column, rna: bool = False) -> Column:
    to = COMPLEMENT_TO.replace("T", "U", 1) if rna else COMPLEMENT_TO
    return F.translate(_c(seq), COMPLEMENT_FROM + COMPLEMENT_FROM.lower(), to + to.lower())


def reverse(seq: str | Column) -> Column:
    return F.reverse(_c(seq))


def reverse_complement(seq: str | Column, rna: bool = False) -> Column:
    return F.reverse(complement(seq, rna))


def to_rna(seq: str | Column) -> Column:
    return F.translate(_c(seq), "Tt", "Uu")


def to_dna(seq: str | Column) -> Column:
    return F.translate(_c(seq), "Uu", "Tt")


def remove_gaps(seq: str | Column, gap_chars: str = GAPS) -> Column:
    return F.translate(_c(seq), gap_chars, "")


def replace_ambiguous(seq: str | Column, char: str = "N") -> Column:
    return F.regexp_replace(_c(seq), "[^ACGTUacgtu]", char)


def _left_out(s: Column, letters: str) -> Column:
    return F.length(s) - F.length(F.translate(s, letters, ""))


def _weighted(seq: str | Column, full: str, half: str, half_set: str) -> Column:
    """Bound once: in a filter, every mention of a sequence would be computed anew from what it is made of."""

    def of(s: Column) -> Column:
        counted = _left_out(s, "ACGTUSWRYKMNBDHV")
        part = _left_out(s, full) + 0.5 * _left_out(s, half) + 0.5 * _left_out(s, half_set)
        return F.when(counted > 0, 100.0 * part / counted).otherwise(F.lit(0.0))

    return let(F.upper(_c(seq)), of)


def gc_content(seq: str | Column) -> Column:
    """Percent G and C, ambiguity codes at half weight, of all counted letters."""
    return _weighted(seq, "GCS", "RYKM", "NBDHV")


def at_content(seq: str | Column) -> Column:
    return _weighted(seq, "ATUW", "RYKM", "NBDHV")


def _skew(seq: str | Column, plus: str, minus: str) -> Column:
    def of(x: Column) -> Column:
        return F.when(x["p"] + x["m"] > 0, 100.0 * (x["p"] - x["m"]) / (x["p"] + x["m"])).otherwise(F.lit(0.0))

    return let(F.upper(_c(seq)), lambda s: let(F.struct(_left_out(s, plus).alias("p"), _left_out(s, minus).alias("m")), of))


def gc_skew(seq: str | Column) -> Column:
    return _skew(seq, "G", "C")


def at_skew(seq: str | Column) -> Column:
    return _skew(seq, "A", "TU")


def gc_fraction(seq: str | Column) -> Column:
    """(G + C) / full length, null where empty: the sort key by GC."""
    s = _c(seq)
    return F.when(F.length(s) > 0, count_of(s, "GC") / F.length(s))


def shannon_entropy(seq: str | Column) -> Column:
    """Bits per letter; letters only, over the full length."""

    def of(s: Column) -> Column:
        def term(total: Column, x: Column) -> Column:
            share = (F.length(s) - F.length(F.replace(s, x, F.lit("")))) / F.length(s)
            return let(share, lambda p: F.when(p > 0, total - p * F.log2(p)).otherwise(total))

        return F.when(F.length(s) > 0, F.aggregate(F.split(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "(?<=.)(?=.)"), F.lit(0.0), term)).otherwise(F.lit(0.0))

    return let(F.upper(_c(seq)), of)


def letters(seq: str | Column) -> Column:
    return F.filter(F.split(_c(seq), ""), lambda x: x != "")


def alphabet(seq: str | Column, case_sensitive: bool = False) -> Column:
    """The different characters in order, joined."""
    s = _c(seq) if case_sensitive else F.upper(_c(seq))
    return F.array_join(F.array_sort(F.array_distinct(letters(s))), "")


def kernel_alphabet(seq: str | Column) -> Column:
    """As alphabet(), letters only."""
    return F.array_join(F.array_sort(F.array_distinct(letters(F.regexp_replace(F.upper(_c(seq)), "[^A-Z]", "")))), "")


def complexity(seq: str | Column) -> Column:
    """Percent of the dinucleotides that are different from all others before them."""
    n = F.length(_c(seq))
    pairs = let(letters(F.upper(_c(seq))), lambda x: F.array_distinct(F.transform(F.slice(x, 1, F.size(x) - 1), lambda a, i: F.concat(a, F.get(x, i + 1)))))
    return F.when(n >= 2, 100.0 * F.size(pairs) / (n - 1)).otherwise(F.lit(0.0))


def base_composition(seq: str | Column, case_sensitive: bool = False) -> Column:
    """map<character, count>."""
    s = _c(seq) if case_sensitive else F.upper(_c(seq))
    return let(
        letters(s),
        lambda x: let(F.array_distinct(x), lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(x) - F.size(F.array_remove(x, k))))),
    )


def base_count(seq: str | Column, bases: str, case_sensitive: bool = False) -> Column:
    return count_of(seq, bases, case_sensitive)


def base_content(seq: str | Column, bases: str, case_sensitive: bool = False) -> Column:
    n = F.length(_c(seq))
    return F.when(n > 0, 100.0 * count_of(seq, bases, case_sensitive) / n).otherwise(F.lit(0.0))


def classify(seq: str | Column) -> Column:
    """struct of twelve counts: CLASSES and other."""
    counts = {k: count_of(seq, v) for k, v in CLASSES.items()}
    rest = F.length(_c(seq))
    for c in counts.values():
        rest = rest - c
    return F.struct(*[v.cast("int").alias(k) for k, v in counts.items()], rest.cast("int").alias("other"))


def is_valid(seq: str | Column, mode: str) -> Column:
    """Whether all characters belong to the mode; gaps always do."""
    both = VALID[mode] + VALID[mode].lower()
    return F.length(F.translate(_c(seq), both + GAPS, "")) == 0


def replace_invalid(seq: str | Column, mode: str, char: str = "N") -> Column:
    both = VALID[mode] + VALID[mode].lower()
    return F.regexp_replace(_c(seq), f"[^{both}.*-]", char)


def sequence_type(seq: str | Column) -> Column:
    """dna, rna, protein or unknown, from the letters alone."""
    s = F.upper(remove_gaps(seq))
    return (
        F.when(F.length(s) == 0, "unknown")
        .when(F.rlike(s, F.lit("^[ACGTRYSWKMBDHVN]+$")), "dna")
        .when(F.rlike(s, F.lit("^[ACGURYSWKMBDHVN]+$")), "rna")
        .when(F.rlike(s, F.lit(f"^[{VALID['protein']}]+$")), "protein")
        .otherwise("unknown")
    )


def is_dna(seq: str | Column) -> Column:
    return F.rlike(_c(seq), F.lit("^[ACGTacgt]+$"))


def is_rna(seq: str | Column) -> Column:
    return F.rlike(_c(seq), F.lit("^[ACGUacgu]+$"))


def is_iupac(seq: str | Column) -> Column:
    return F.rlike(_c(seq), F.lit("^[ACGTURYSWKMBDHVNacgturyswkmbdhvn]+$"))


def is_primer(seq: str | Column) -> Column:
    return is_iupac(seq) & F.length(_c(seq)).between(10, 50)


def is_palindromic(seq: str | Column) -> Column:
    s = F.upper(_c(seq))
    return (F.length(s) > 0) & (s == reverse_complement(s))


def expand_ambiguous_base(base: str) -> list[str]:
    return list(IUPAC.get(base.upper(), ""))


def expand_ambiguous(seq: str | Column, limit: int = 1000) -> Column:
    """All concrete sequences that an IUPAC sequence stands for, null if over the limit."""
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for k, v in IUPAC.items() for x in (k, list(v))])
    steps = F.transform(letters(F.upper(_c(seq))), lambda x: F.coalesce(F.element_at(known, x), F.array(x)))
    many = F.aggregate(steps, F.lit(1.0), lambda a, x: a * F.size(x))
    grown = F.aggregate(steps, F.array(F.lit("")), lambda a, x: F.flatten(F.transform(a, lambda p: F.transform(x, lambda q: F.concat(p, q)))))
    return F.when(many <= limit, grown)


# Functions of the delimited-text parser, which define GC in other units.
def dsv_gc(seq: str | Column) -> Column:
    n = count_of(seq, "ACGTU")
    return F.when(n > 0, 100.0 * count_of(seq, "GC") / n).otherwise(F.lit(0.0))


def dsv_gc_skew(seq: str | Column) -> Column:
    g, c = count_of(seq, "G"), count_of(seq, "C")
    return F.when(g + c > 0, (g - c) / (g + c)).otherwise(F.lit(0.0))
