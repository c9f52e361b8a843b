"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WIDTH = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xA0761D6478BD642F], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, A-Z in lower case, in turn; and the bounds of each text's words."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = np.asarray(parts.offsets, dtype=np.int64) - parts.offsets[0].as_py()
    values = parts.flatten()
    coded = values.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    known = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    words = known[np.asarray(coded.indices)] if len(known) else np.zeros(0, np.uint64)
    real = np.asarray(pc.binary_length(values)) > 0  # white space at an end gives an empty part
    if not real.all():
        offsets = np.concatenate(([0], np.cumsum(real)))[offsets]
        words = words[real]
    return words, offsets


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingles of each text; a text of fewer words has its whole sequence as one, one without words none."""
    words, offsets = word_hashes(texts)
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    rows = np.zeros(len(words), np.uint64)
    for i in range(width):
        rows += padded[i : i + len(words)] * _ODD[i]
    rows = mix64(rows + np.uint64(width))
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rows[a : b - width + 1]))
        elif b > a:
            short = (words[a:b] * _ODD[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix64(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
