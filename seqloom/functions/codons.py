"""Genetic codes, translation and open reading frames."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.bases import COMPLEMENT_FROM, COMPLEMENT_TO, IUPAC
from seqloom.schema import require

# The standard genetic code, codons in the order TTT, TTC, TTA, TTG, TCT, ... GGG.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# The published genetic codes by number: how each differs from the standard code | start codons.
CODES = {
    1: " | TTG CTG ATG",
    2: "AGA* AGG* ATAM TGAW | ATT ATC ATA ATG GTG",
    3: "ATAM CTTT CTCT CTAT CTGT TGAW | ATA ATG",
    4: "TGAW | TTA TTG CTG ATT ATC ATA ATG GTG",
    5: "AGAS AGGS ATAM TGAW | TTG ATT ATC ATA ATG GTG",
    6: "TAAQ TAGQ | ATG",
    9: "AAAN AGAS AGGS TGAW | ATG GTG",
    10: "TGAC | ATG",
    11: " | TTG CTG ATT ATC ATA ATG GTG",
    12: "CTGS | CTG ATG",
    13: "AGAG AGGG ATAM TGAW | TTG ATA ATG GTG",
    14: "AAAN AGAS AGGS TAAY TGAW | ATG",
    16: "TAGL | ATG",
    21: "TGAW ATAM AGAS AGGS AAAN | ATG GTG",
    22: "TCA* TAGL | ATG",
    23: "TTA* | ATT ATG GTG",
    24: "AGAS AGGK TGAW | TTG CTG ATG GTG",
    25: "TGAG | TTG ATG GTG",
    26: "CTGA | CTG ATG",
    27: "TAAQ TAGQ TGAW | ATG",
    28: "TAAQ TAGQ TGAW | ATG",
    29: "TAAY TAGY | ATG",
    30: "TAAE TAGE | ATG",
    31: "TAAE TAGE TGAW | ATG",
    32: "TAGW | TTG CTG ATT ATC ATA ATG GTG",
    33: "AGAS AGGK TAAY TGAW | TTG CTG ATG GTG",
}
# Codons that some organisms start at besides ATG.
ALTERNATIVE_STARTS = ("CTG", "TTG", "GTG")
BASES = "TCAG"
SYMBOLS = "TCAGRYSWKMBDHVN"


def codon_table(code: int = 1) -> dict[str, str]:
    require(code in CODES, f"unknown genetic code {code}")
    codons = [a + b + c for a in BASES for b in BASES for c in BASES]
    return dict(zip(codons, STANDARD, strict=True)) | {x[:3]: x[3] for x in CODES[code].split("|")[0].split()}


def start_codons(code: int = 1) -> list[str]:
    require(code in CODES, f"unknown genetic code {code}")
    return CODES[code].split("|")[1].split()


def list_genetic_codes() -> list[int]:
    return sorted(CODES)


def _dna(codon: str) -> str:
    return codon.upper().replace("U", "T")


def is_start_codon(codon: str, code: int = 1) -> bool:
    return _dna(codon) in start_codons(code)


def is_stop_codon(codon: str, code: int = 1) -> bool:
    return codon_table(code).get(_dna(codon)) == "*"


def is_alternative_start(codon: str) -> bool:
    return _dna(codon) in ALTERNATIVE_STARTS


def translate_codon(codon: str, code: int = 1) -> str:
    """The amino acid; for ambiguity codes, that of all expansions if it is one, else X."""
    table = codon_table(code)
    codon = _dna(codon)
    if len(codon) != 3 or any(x not in IUPAC for x in codon):
        return "X"
    said = {table[a + b + c] for a in IUPAC[codon[0]] for b in IUPAC[codon[1]] for c in IUPAC[codon[2]]}
    return said.pop() if len(said) == 1 else "X"


@cache
def _amino_table(code: int) -> np.ndarray:
    """Amino acids of all codons over SYMBOLS and one sign for anything else, by rule from the code."""
    signs = "?" + SYMBOLS
    return np.frombuffer("".join(translate_codon(a + b + c, code) for a in signs for b in signs for c in signs).encode(), np.uint8)


@cache
def _start_table(starts: tuple[str, ...]) -> np.ndarray:
    signs = "?" + SYMBOLS
    return np.frombuffer("".join("s" if a + b + c in starts else "-" for a in signs for b in signs for c in signs).encode(), np.uint8)


@cache
def _symbol_numbers() -> np.ndarray:
    out = np.zeros(256, np.int32)
    for i, x in enumerate(SYMBOLS):
        out[[ord(x), ord(x.lower())]] = i + 1
    out[[ord("U"), ord("u")]] = out[ord("T")]
    return out


def _letters_of_codons(seq: Column, table: np.ndarray, frame: int) -> Column:
    """One letter of the table for each whole codon of frame 1, 2 or 3. All sequences of a batch are
    looked up at once: a lambda over an array of bases takes some twenty times as long."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        whole = ["" if t is None else t[frame - 1 : frame - 1 + max(0, len(t) - frame + 1) // 3 * 3] for t in texts]
        numbers = _symbol_numbers()[np.frombuffer("".join(whole).encode("latin-1", "replace"), np.uint8)]
        n = len(SYMBOLS) + 1
        said = table[numbers.reshape(-1, 3) @ np.array([n * n, n, 1])].tobytes().decode("latin-1")
        out, at = [], 0
        for t, w in zip(texts, whole, strict=True):
            out.append(None if t is None else said[at : at + len(w) // 3])
            at += len(w) // 3
        return pd.Series(out, dtype=object)

    return of(seq)


def proteins(seq: str | Column, code: int = 1, frame: int = 1) -> Column:
    """One letter for each whole codon of the frame 1, 2 or 3."""
    return _letters_of_codons(F.col(seq) if isinstance(seq, str) else seq, _amino_table(code), frame)


def amino_acids(seq: str | Column, code: int = 1, frame: int = 1) -> Column:
    """array<string> of these letters."""
    return F.filter(F.split(proteins(seq, code, frame), ""), lambda x: x != "")


def translate(
    seq: str | Column,
    code: int = 1,
    frame: int = 1,
    convert_start_codons: bool = False,
    allow_alternative_starts: bool = False,
    remove_stop_codons: bool = False,
    trim_at_first_stop: bool = False,
    stop_codon_char: str = "*",
    unknown_codon_char: str = "X",
) -> Column:
    """The protein of frame 1, 2, 3 or -1, -2, -3 (of the reverse complement)."""
    s = F.col(seq) if isinstance(seq, str) else seq
    if frame < 0:
        s = F.reverse(F.translate(F.translate(F.upper(s), "U", "T"), COMPLEMENT_FROM, COMPLEMENT_TO))
    protein = proteins(s, code, abs(frame))
    if convert_start_codons:
        starts = [*start_codons(code), *(ALTERNATIVE_STARTS if allow_alternative_starts else ())]
        first = F.substr(F.translate(F.upper(s), "U", "T"), F.lit(abs(frame)), F.lit(3))
        protein = F.when(first.isin(starts), F.concat(F.lit("M"), F.substr(protein, F.lit(2)))).otherwise(protein)
    if trim_at_first_stop:
        protein = F.substring_index(protein, "*", 1)
    if remove_stop_codons:
        protein = F.replace(protein, F.lit("*"), F.lit(""))
    elif stop_codon_char != "*":
        protein = F.replace(protein, F.lit("*"), F.lit(stop_codon_char))
    if unknown_codon_char != "X":
        protein = F.replace(protein, F.lit("X"), F.lit(unknown_codon_char))
    return protein


def translate_to_stop(seq: str | Column, code: int = 1) -> Column:
    """array<string>: the three forward frames, each up to its first stop."""
    return F.array(*[translate(seq, code, f, trim_at_first_stop=True) for f in (1, 2, 3)])


def six_frames(seq: str | Column, code: int = 1) -> Column:
    """map<frame, protein>."""
    return F.create_map(*[x for f in (1, 2, 3, -1, -2, -3) for x in (F.lit(f), translate(seq, code, f))])


def first_orf(seq: str | Column, code: int = 1, frame: int = 1, min_length: int = 1, convert_start_codons: bool = False, allow_alternative_starts: bool = False, remove_stop_codons: bool = False, stop_codon_char: str = "*") -> Column:
    """The frame's first reading frame, from its first start codon to the stop or the end; null where
    there is none or it is shorter than min_length."""
    s = F.col(seq) if isinstance(seq, str) else seq
    if frame < 0:
        s = F.reverse(F.translate(F.translate(F.upper(s), "U", "T"), COMPLEMENT_FROM, COMPLEMENT_TO))
    starts = (*start_codons(code), *(ALTERNATIVE_STARTS if allow_alternative_starts else ()))
    whole = proteins(s, code, abs(frame))
    first = F.instr(_letters_of_codons(s, _start_table(starts), abs(frame)), F.lit("s"))

    def of(at: Column) -> Column:
        rest = F.substr(whole, at)
        lead = F.lit("M") if convert_start_codons else F.substr(rest, F.lit(1), F.lit(1))
        tail = F.substr(rest, F.lit(2))
        stop = F.lit("") if remove_stop_codons else F.when(F.contains(tail, F.lit("*")), F.lit(stop_codon_char)).otherwise("")
        protein = F.concat(lead, F.substring_index(tail, "*", 1), stop)
        return F.when((at > 0) & (F.length(protein) >= min_length), protein)

    return of(first)


def find_orfs(seq: str | Column, code: int = 1, min_length: int = 20) -> Column:
    """array<struct<start, end, frame, strand, length, protein>> on both strands, frames 1 to 3 each. A
    reading frame ends at its stop codon (end is one past the codon's first base) or at the end of the
    sequence (end is the last base). A scan with state, so an Arrow function."""
    table, starts = codon_table(code), set(start_codons(code))
    flip = str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO)

    def scan(dna: str, frame: int, strand: str) -> Iterator[tuple]:
        begin, protein, sign = -1, [], 1 if strand == "+" else -1
        for i in range(frame, len(dna) - 2, 3):
            amino = table.get(dna[i : i + 3])
            if amino is None:
                continue
            if begin < 0:
                if dna[i : i + 3] in starts:
                    begin, protein = i, [amino]
            elif amino == "*":
                if len(protein) >= min_length:
                    yield begin, i + 1, sign * (frame + 1), strand, len(protein), "".join(protein)
                begin, protein = -1, []
            else:
                protein.append(amino)
        if begin >= 0 and len(protein) >= min_length:
            yield begin, len(dna) - 1, sign * (frame + 1), strand, len(protein), "".join(protein)

    @F.pandas_udf("array<struct<start:int,end:int,frame:int,strand:string,length:int,protein:string>>")
    def of(texts: pd.Series) -> pd.Series:
        names = ("start", "end", "frame", "strand", "length", "protein")
        out = []
        for t in texts:
            dna = _dna(t or "")
            out.append([dict(zip(names, x, strict=True)) for strand, d in (("+", dna), ("-", dna.translate(flip)[::-1])) for f in range(3) for x in scan(d, f, strand)])
        return pd.Series(out)

    return of(F.col(seq) if isinstance(seq, str) else seq)
