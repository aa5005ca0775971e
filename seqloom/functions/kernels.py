"""Vectorised work on a batch of strings: all characters in one array, reduced by row."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


def flat(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all characters, and the length of each row."""
    held = ["" if t is None else t for t in texts]
    return np.frombuffer("".join(held).encode("latin-1", "replace"), np.uint8), np.fromiter(map(len, held), np.int64, len(held))


def by_row(reduce: np.ufunc, values: np.ndarray, lengths: np.ndarray, empty: float) -> np.ndarray:
    """reduce over each row's values; `empty` for rows without any."""
    out = np.full(len(lengths), empty, values.dtype if np.issubdtype(values.dtype, np.floating) else np.int64)
    full = lengths > 0
    if full.any():
        starts = (np.cumsum(lengths) - lengths)[full]
        out[full] = reduce.reduceat(values, starts)
    return out


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of all characters of a batch, and where each row begins and how long it is; nulls are
    empty. ASCII is read from the batch's own buffer; other characters become one code each."""
    held = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
    raw = held.buffers()[2] if len(held) else None
    codes = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.empty(0, np.uint8)
    if codes.size and codes.max() > 127:
        rows = [t.encode("latin-1", "replace") for t in held.to_pylist()]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.frombuffer(b"".join(rows), np.uint8), np.cumsum(lengths) - lengths, lengths
    return codes, offsets[:-1] - offsets[0], np.diff(offsets)


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As letters, with the code points of any text."""
    rows = [t or "" for t in texts.to_pylist()]
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(lengths) - lengths, lengths


def padded(rows: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of rows in a matrix, `pad` behind their ends, and their lengths."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.full((len(rows), int(lengths.max(initial=0))), pad, np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, lengths
