"""Packing by concatenate and cut.

All documents, each followed by an end id, are laid end to end and cut into windows of fixed length.
First pass: every task tokenizes its rows once and writes ids with the tokens before each document in
its partition. The totals of the partitions, one number each, are summed into global offsets. Second
pass: every document knows its global place and is cut at the window borders, each piece a boundary
record (document, start in it, length, sequence, offset). Only the last window is not full; nothing is
shuffled.

The ids are written once, compressed, in the shared folder, so the second pass and every retry see the
same order. The driver holds one number for each partition of the input.

Defined results. Null text: empty, the end id alone. Null ids, repeated rows: documents like others.
Very long texts: cut into as many pieces as needed. Empty table: empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import table, written

LENGTH = 2048
END_ID = 1
#: Words whose ids a Python worker keeps.
KEPT_WORDS = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Where a letter meets a mark other than an apostrophe, the vocabulary always begins another token.
EDGE = re.compile(r"(?<=[a-zà-öø-ÿ])(?=[!-&(-/:-@\[-`{-~])")
#: Texts of these characters alone, without runs of marks, have an edge before every mark.
SIMPLE, RUNS = b"abcdefghijklmnopqrstuvwxyz0123456789 \n,.", (b",,", b"..", b",.", b".,")
LETTERS = re.compile(r"[a-zà-öø-ÿ]+")


class Encoder:
    """Ids of texts as little-endian 16-bit numbers.

    The vocabulary lowers case, drops white space and never joins across it or across an EDGE, so a
    text's ids are those of its parts, and parts that come again are looked up. New words of plain
    letters are encoded many at a time; the ids that end a word tell them apart. Texts that may hold a
    special token are encoded whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids are kept as 16-bit numbers")
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > KEPT_WORDS:  # words that came early are the frequent ones
            self.known = dict(itertools.islice(self.known.items(), KEPT_WORDS // 2))
        plain = [w for w in new if LETTERS.fullmatch(w)]
        other = [w for w in new if not LETTERS.fullmatch(w)]
        groups = [plain[k : k + 100] for k in range(0, len(plain), 100)]
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups]), strict=True):
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group):
                other += group
                continue
            raw, start = ids.tobytes(), 0
            for word, stop in zip(group, (2 * stops).tolist(), strict=True):
                self.known[word] = raw[start:stop]
                start = stop
        for word, ids in zip(other, self._ids(other), strict=True):
            self.known[word] = ids.tobytes()

    @staticmethod
    def _parts(text: str) -> list[str] | None:
        if "<|" in text:
            return None
        low = text.encode("utf-8", "surrogatepass").lower()  # ASCII letters only
        if not low.translate(None, SIMPLE) and not any(run in low for run in RUNS):
            return low.replace(b"\n", b" ").replace(b",", b" ,").replace(b".", b" .").decode("ascii").split(" ")
        return EDGE.sub(" ", low.decode("utf-8", "surrogatepass").replace("\n", " ")).split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        parts = [self._parts(t or "") for t in texts]
        found = [p and list(map(self.known.get, p)) for p in parts]
        gaps = [[i for i, x in enumerate(f) if x is None] if f and None in f else () for f in found]
        if new := {p[i] for p, g in zip(parts, gaps, strict=True) for i in g}:
            self._learn(list(new))
        for p, f, g in zip(parts, found, gaps, strict=True):
            for i in g:
                f[i] = self.known[p[i]]
        return [self._ids([t])[0].tobytes() if f is None else b"".join(f) for t, f in zip(texts, found, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, which Spark uses for many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenized(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """part (the input partition), before (tokens before the document in it), doc_id, doc_tokens, ids;
    written."""
    end = np.array([END_ID], "<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for k in range(0, batch.num_rows, 250):
                some = batch.slice(k, 250)
                ids = [x + end for x in encoder(vocabulary).encode(some.column(1).to_pylist())]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                at = before + np.concatenate([[0], np.cumsum(n)[:-1]])
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(at), some.column(0), pa.array(n), pa.array(ids, pa.binary())], names=["part", "before", "doc_id", "doc_tokens", "ids"])

    two = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return written(two.mapInArrow(encode, "part int, before long, doc_id long, doc_tokens long, ids binary"))


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary)."""
    rows = tokenized(docs, vocabulary or default_vocabulary())
    totals = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()}  # one for each partition
    starts = np.zeros(max(totals, default=0) + 2, np.int64)
    for part, n in totals.items():
        starts[part + 1] = n
    starts = np.cumsum(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in batches:
            if not batch.num_rows:
                continue
            part, before, doc, n = (batch.column(i).to_numpy(zero_copy_only=False) if i != 2 else batch.column(2) for i in range(4))
            first = starts[part] + before
            pieces = (first + n - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] // length + nth
            begin = np.maximum(sequence * length, first[row])
            stop = np.minimum((sequence + 1) * length, (first + n)[row])
            start, size = begin - first[row], stop - begin
            ids = batch.column(4)
            held = [memoryview(x.as_buffer()) for x in ids]
            for k in range(0, len(row), 1000):
                to = slice(k, k + 1000)
                slices = [np.frombuffer(held[r], "<u2")[a : a + b].astype("<u4").tobytes() for r, a, b in zip(row[to].tolist(), start[to].tolist(), size[to].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array(row[to])), pa.array(start[to]), pa.array(size[to]), pa.array(n[row[to]]), pa.array(sequence[to]), pa.array(begin[to] - sequence[to] * length), pa.array(slices, pa.binary())], names=names
                )

    return rows.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences: sequence_id, ids (binary, at most one window) and their boundary records."""
    record = F.struct("offset", "length", "doc_id", "start", "ids")
    s = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(record)).alias("r"))  # at most one window of tokens each
    whole = F.aggregate("r", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return s.select("sequence_id", whole.alias("ids"), F.transform("r", lambda x: F.struct(x["offset"], x["length"], x["doc_id"], x["start"])).alias("boundaries"))


def op4(spark, sf_dir):
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
