"""Quality rules as weak supervision.

Rules vote good (1), bad (-1) or abstain (0) on every document; expectation-maximisation over the
counts of vote patterns estimates each rule's confusion with the hidden quality; the posterior
probability of good quality decides, so no single rule can reject a document by itself.

Plan: one pass takes the features of every text and writes them with the narrow columns that the caller
keeps, or, where whole documents go on, takes them once more; vote patterns are counted (at most
3 ** len(RULES) rows reach the driver, whatever the input), EM runs on those counts, and the posteriors,
a table of as many rows, are joined by broadcast. Nothing but the pattern counts is shuffled.

A rule votes only where it can tell. Function words are known for four languages, so many of them speak
for a text and none of them says nothing.

Defined results. Null or empty text: no words, base_failed, not kept. Null ids: kept as null. Extra
columns pass through `judge`; its own result is one struct column whose name the caller gives.
Repeated rows: each judged alike. Empty table: empty result.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import fresh, table, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
STOP_WORDS = frozenset(
    "the of and to in is was for that it with as be by on are this from or an "
    "der die das und ist von zu den nicht ein eine mit im auf für "
    "le la les de des et en un une du est que qui dans pour "
    "el los las y que por con para del una se".split()
)
#: Words of marks alone.
BARE = re.compile(rb"(?<![^\x20\x09-\x0D])[!-/:-@\[-`{-~]+(?![^\x20\x09-\x0D])")
RULES = ("length", "repeats", "symbols", "lines", "word_size", "stop_words", "capitals", "letters", "bare_marks")
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, votes string"
MIN_WORDS = 50
#: Documents of either class that the start values of EM stand for.
PRIOR = 10


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) < 1 << 21:
        key = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    else:
        _, where, times = np.unique(np.stack([code[:-2], code[1:-1], code[2:]], 1), axis=0, return_inverse=True, return_counts=True)
    twice = times[where.ravel()] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= twice
    return int(covered.sum())


def _vote(good: bool, bad: bool) -> str:
    return "-" if bad else "+" if good else "0"


def features(text: str | None) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    n_upper, n_letters = _letters(text)
    stops = len({w.lower() for w in set(words)} & _STOP_BYTES)
    bare = len(BARE.findall(raw))
    votes = "".join(
        (
            _vote(n >= 2 * MIN_WORDS, n < MIN_WORDS),
            _vote(repeats <= 0.2 * n, repeats > 0.5 * n) if n else "0",
            _vote(symbols <= 0.05 * n, symbols > 0.3 * n) if n else "0",
            _vote(dup_lines <= 0.1 * len(lines), dup_lines > 0.3 * len(lines)) if len(lines) > 1 else "0",
            _vote(2.5 * n <= chars <= 9 * n, chars < 1.5 * n or chars > 14 * n) if n else "0",
            _vote(stops >= 5, False),
            _vote(n_upper <= 0.15 * n_letters, n_upper > 0.4 * n_letters) if n_letters else "0",
            _vote(n_letters >= 0.9 * chars, n_letters < 0.75 * chars) if chars else "0",
            _vote(bare <= 0.03 * n, bare > 0.25 * n) if n else "0",
        )
    )
    return n, chars, symbols, dup_lines, repeats, failed, votes


_STOP_BYTES = frozenset(w.encode() for w in STOP_WORDS)


def _letters(text: str) -> tuple[int, int]:
    """Capital letters, and letters, of all code points."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper, letter = _case_tables()
    return int(upper[codes].sum()), int(letter[codes].sum())


_TABLES: list[np.ndarray] = []


def _case_tables() -> list[np.ndarray]:
    if not _TABLES:
        n = sys.maxunicode + 1
        _TABLES.extend([np.fromiter((chr(i).isupper() for i in range(n)), bool, n), np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)])
    return _TABLES


def feature_column(text: Column) -> Column:
    """FEATURES of a text."""
    names = [x.split()[0] for x in FEATURES.split(", ")]

    @F.pandas_udf(FEATURES)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([features(t) for t in texts], columns=names)

    return measure(text)


def fit(counts: dict[str, int], rounds: int = 100, tolerance: float = 1e-9) -> dict[str, float]:
    """EM over vote patterns: posterior probability of good quality by pattern.

    Each rule has an accuracy for either hidden quality: how often, where it votes at all, it says bad
    (Dawid and Skene). Abstaining says nothing. The accuracies start where clean documents hardly ever
    get a bad vote while bad ones pass most rules, which also settles which of the two hidden classes is
    called good; a prior of ten documents a class, which fades as the corpus grows, keeps rules that never voted finite.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    onehot = np.array([[(v == "-", v == "+") for v in p] for p in patterns], float)  # pattern, rule, vote
    like = np.array([[0.45, 0.55], [0.04, 0.96]])  # class, vote
    score = np.einsum("prv,cv->pc", onehot, np.log(like)) + np.log([0.2, 0.8])
    good = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -700, 700)))
    prior_counts = like[:, None, :] * PRIOR
    for _ in range(rounds):
        q = np.stack([1 - good, good]) * weight  # class, pattern
        theta = np.einsum("cp,prv->crv", q, onehot) + prior_counts
        theta /= theta.sum(2, keepdims=True)
        prior = (q.sum(1) + [0.2, 0.8]) / (weight.sum() + 1)
        score = np.einsum("prv,crv->pc", onehot, np.log(theta)) + np.log(prior)
        new = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -700, 700)))
        done = np.abs(new - good).max() < tolerance
        good = new
        if done:
            break
    return dict(zip(patterns, good.round(9).tolist(), strict=True))


def judge(docs: DataFrame, result: str, text: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs, all if not given, with a struct column `result` (in place of one of that
    name): the base features, votes, posterior and kept. With `keep`, features are written once; whole
    documents are measured twice, which costs as much as writing them and takes no disk."""
    kept_columns = [c for c in (docs.columns if keep is None else keep) if c.lower() != result.lower()]
    scored = docs.select(*kept_columns, feature_column(F.col(text)).alias(result))
    scored = scored if keep is None else written(scored)
    votes, said, p = F.col(result)["votes"], fresh(scored, "_votes"), fresh(scored, "_posterior")
    posterior = fit({r["v"]: r["count"] for r in scored.groupBy(votes.alias("v")).count().collect()})  # at most 3 ** len(RULES) rows
    known = docs.sparkSession.createDataFrame(list(posterior.items()), f"{said} string, {p} double")
    told = scored.join(F.broadcast(known), votes == F.col(said), "left")
    kept = ~F.col(result)["base_failed"] & (F.col(p) >= threshold)
    return told.withColumn(result, F.col(result).withField("posterior", F.col(p)).withField("kept", F.coalesce(kept, F.lit(False)))).drop(said, p)


def op1(spark, sf_dir):
    r = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), "r", keep=["doc_id"])
    return r.select("doc_id", *[F.col("r")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "posterior")])
