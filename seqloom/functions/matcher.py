"""One matcher and one validator over the functions of this package."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions import bases, patterns
from seqloom.functions.bind import let
from seqloom.schema import require


@dataclass(frozen=True)
class SequenceMatcher:
    """A pattern with its way of matching: literal, IUPAC or up to some substitutions."""

    pattern: str
    mismatches: int = 0
    ambiguous: bool = False
    ignore_case: bool = False

    def __post_init__(self) -> None:
        require(len(self.pattern) > 0 and self.mismatches >= 0, "a matcher takes a pattern and mismatches >= 0")

    def find_all(self, seq: str | Column) -> Column:
        """array<int> of places, overlapping ones too."""
        if self.mismatches:
            return F.transform(patterns.hamming_hits(seq, self.pattern, self.mismatches, self.ambiguous, self.ignore_case), lambda h: h["start"])
        if self.ambiguous:
            return patterns.find_ambiguous(seq, self.pattern)
        return patterns.positions(seq, ("(?i)" if self.ignore_case else "") + patterns.escape_regex(self.pattern))

    def find_first(self, seq: str | Column) -> Column:
        """The first place, null if none."""
        return let(self.find_all(seq), lambda x: F.get(x, F.lit(0)))

    def test(self, seq: str | Column) -> Column:
        return F.size(self.find_all(seq)) > 0

    def count(self, seq: str | Column) -> Column:
        return F.size(self.find_all(seq))


def find_pattern(seq: str | Column, pattern: str, mismatches: int = 0) -> Column:
    return SequenceMatcher(pattern, mismatches).find_all(seq)


def has_pattern(seq: str | Column, pattern: str, mismatches: int = 0) -> Column:
    return SequenceMatcher(pattern, mismatches).test(seq)


@dataclass(frozen=True)
class SequenceValidator:
    """Validation of dna, rna, protein or unknown (either nucleic acid) sequences: strict (standard
    letters), normal (ambiguity codes too) or permissive (anything). Gaps are valid in all."""

    mode: str = "normal"
    kind: str = "dna"

    def __post_init__(self) -> None:
        require(self.mode in ("strict", "normal", "permissive"), f"unknown mode {self.mode!r}")
        require(self.kind in ("dna", "rna", "protein", "unknown"), f"unknown type {self.kind!r}")

    def _letters(self) -> str:
        if self.kind == "protein":
            return bases.VALID["protein"]
        if self.kind == "unknown":
            return "ACGTU" if self.mode == "strict" else bases.VALID["normal_dna"]
        return bases.VALID[f"{self.mode}_{self.kind}"]

    def validate(self, seq: str | Column) -> Column:
        c = F.col(seq) if isinstance(seq, str) else seq
        return c.isNotNull() if self.mode == "permissive" else F.rlike(c, F.lit(f"(?i)^[{self._letters()}.*-]*$"))

    def clean(self, seq: str | Column, char: str = "N") -> Column:
        """Other letters become char."""
        c = F.col(seq) if isinstance(seq, str) else seq
        return c if self.mode == "permissive" else F.regexp_replace(c, f"(?i)[^{self._letters()}.*-]", char)

    def with_settings(self, mode: str | None = None, kind: str | None = None) -> SequenceValidator:
        return SequenceValidator(mode or self.mode, kind or self.kind)
