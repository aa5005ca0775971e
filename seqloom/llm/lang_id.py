"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (from a generator seeded by the letter alone, so any
letter of any script has one everywhere without a table). A 3-gram binds its letters' vectors, each
permuted (rotated) by its place, by multiplication; a text bundles its 3-grams' vectors by addition.
A language's prototype bundles its training texts; a document gets the language whose prototype has
the largest cosine.

Plan: training is one narrow pass that folds each task's texts into one integer vector per language;
Spark sums those by (language, dimension) with partial aggregation, so what the driver gets is
languages x dimensions. Prediction is another narrow pass. Nothing else moves. Integer sums make the
prototypes independent of order and of retries.

Defined results. Null text or one without a letter: `und`, score 0. Null lang: not trained on. Null
doc_id: the checksum of a null is null, so it is trained on and not held out. No training language at
all: `und`. Ties: the smaller language name. Extra columns are ignored; repeated rows count each.
"""

from __future__ import annotations

import sys
import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import fresh, table

DIMENSIONS = 1024
#: 3-gram vectors that a Python worker keeps, as 8-bit numbers: 16 MB.
CACHE = 16_384


class Profiles:
    """3-gram vectors of one worker."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        self.d, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((CACHE, dimensions), np.int8)
        n = sys.maxunicode + 1
        self.fold = np.fromiter((ord(c[0]) if c[0].isalpha() else 0 for c in map(str.lower, map(chr, range(n)))), np.int32, n)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            self.letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.d, dtype=np.int8) * 2 - 1
        return self.letters[code]

    def vector(self, gram: int) -> np.ndarray:
        a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        try:
            return self.table[[self.rows[g] for g in grams.tolist()]]
        except KeyError:
            pass
        if len(grams) > CACHE:
            return np.stack([self.vector(g) for g in grams.tolist()])
        new = [g for g in grams.tolist() if g not in self.rows]
        if len(self.rows) + len(new) > CACHE:
            self.rows.clear()
            new = grams.tolist()
        for g in new:
            self.table[len(self.rows)] = self.vector(g)
            self.rows[g] = len(self.rows)
        return self.table[[self.rows[g] for g in grams.tolist()]]

    def grams(self, text: str) -> np.ndarray:
        """The 3-grams of a text's letters, one per place; words are set apart by one space (0)."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self.fold[codes].astype(np.int64)
        if not letters.any():
            return np.empty(0, np.int64)
        s = np.concatenate([[0], letters, [0]])
        s = s[(s != 0) | np.concatenate([[True], s[:-1] != 0])]
        if len(s) < 3:
            return np.empty(0, np.int64)
        return (s[:-2] << 42) | (s[1:-1] << 21) | s[2:]

    def bundle(self, grams: np.ndarray, times: np.ndarray) -> np.ndarray:
        total = np.zeros(self.d, np.int64)
        for k in range(0, len(grams), CACHE // 2):
            total += times[k : k + CACHE // 2].astype(np.float64).dot(self.vectors(grams[k : k + CACHE // 2]).astype(np.float64)).astype(np.int64)
        return total


_LOCAL = threading.local()


def profiles() -> Profiles:
    if not hasattr(_LOCAL, "p"):
        _LOCAL.p = Profiles()
    return _LOCAL.p


def train(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from columns text and lang; their number is the number of languages."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, sums = profiles(), {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                held, size = [], 0
                for t in [*texts, None]:
                    if t is not None:
                        held.append(p.grams(t))
                        size += len(held[-1])
                    if held and (t is None or size > 2_000_000):
                        grams, times = np.unique(np.concatenate(held), return_counts=True)
                        sums[lang] = sums.get(lang, 0) + p.bundle(grams, times)
                        held, size = [], 0
        for lang, v in sums.items():
            yield pd.DataFrame({"lang": lang, "dim": np.arange(len(v), dtype=np.int32), "v": v})

    known = labelled.select("lang", "text").filter("lang is not null and text is not null")
    summed = known.mapInPandas(fold, "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    got = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("v")).select("lang", F.col("v.v").alias("v"))
    return {r["lang"]: np.array(r["v"], float) for r in got.collect()}  # languages x dimensions


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs, and lang_pred, score."""
    names = sorted(k for k, v in prototypes.items() if np.abs(v).sum() > 0)
    unit = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]) if names else None

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = profiles()
        for texts in batches:
            out = []
            for t in texts:
                grams, times = np.unique(p.grams(t), return_counts=True) if t else ((), ())
                if not len(grams) or unit is None:
                    out.append(("und", 0.0))
                    continue
                v = p.bundle(grams, times).astype(float)
                cos = unit @ v / (np.linalg.norm(v) or 1.0)
                best = int(cos.argmax())
                out.append((names[best], float(min(1.0, max(0.0, cos[best])))))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    name = fresh(docs, "_guess")
    return docs.withColumn(name, guess(F.col(text))).select(*keep, f"{name}.lang_pred", f"{name}.score")


def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    return predict(docs, train(docs.filter(~F.col("held_out"))), ["doc_id", "held_out"])
