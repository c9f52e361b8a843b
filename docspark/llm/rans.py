"""Static range asymmetric numeral system over token ids: interleaved lanes, one shared frequency table, checkpoints, checksum.

A block's ids are dealt to LANES lanes in turn; every lane has a 64-bit state and shifts out 32-bit words, so one array
operation codes LANES ids. A checkpoint holds all lane states and the word position before a step, so decoding can begin there.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

SCALE_BITS = 18
LANES = 2048
#: Steps between checkpoints.
CHECKPOINT_STEPS = 256
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIIII")
MAGIC = b"RANS"


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that add up to 2**bits, at least 1 for every id that occurs."""
    counts = np.asarray(counts, dtype=np.float64)
    seen = counts > 0
    if not seen.any():
        return np.zeros(len(counts), np.uint32)
    room = 1 << bits
    if seen.sum() > room:
        raise ValueError("more ids than the scale has room for")
    out = np.where(seen, np.maximum(1, np.floor(counts / counts.sum() * room)), 0).astype(np.int64)
    order = np.argsort(-out, kind="stable")
    extra = room - int(out.sum())
    i = 0
    while extra:  # the largest give or take what rounding left
        k = order[i % len(order)]
        step = extra if extra > 0 else -min(-extra, int(out[k]) - 1, max(1, int(out[k]) // 8))
        out[k] += step
        extra -= step
        i += 1
    return out.astype(np.uint32)


@dataclass
class Table:
    freq: np.ndarray
    cum: np.ndarray = field(init=False)
    symbol: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.freq = np.asarray(self.freq, dtype=np.uint64)
        self.cum = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    def checksum(self) -> int:
        return zlib.crc32(self.freq.astype("<u4").tobytes())


def encode(ids: np.ndarray, table: Table) -> bytes:
    n, lanes = len(ids), max(1, min(LANES, len(ids) // 256))  # few ids: few states
    steps = -(-n // lanes)
    f, c = table.freq[ids], table.cum[ids]
    if n and not f.all():
        raise ValueError("an id without a frequency")
    limit = f << np.uint64(63 - SCALE_BITS)
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    written = 0
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        x, ft = state[: b - a], f[a:b]
        out = x >= limit[a:b]
        if out.any():
            w = x[out].astype("<u4")
            words.append(w)
            written += len(w)
            x = np.where(out, x >> np.uint64(32), x)
        q, r = np.divmod(x, ft)
        state[: b - a] = (q << np.uint64(SCALE_BITS)) + r + c[a:b]
        if t % CHECKPOINT_STEPS == 0:
            marks.append((t, written, state.copy()))
    stream = b"".join(w.tobytes() for w in reversed(words))
    points = b"".join(struct.pack("<II", t, written - at) + s.astype("<u8").tobytes() for t, at, s in reversed(marks))
    body = points + stream
    return _HEAD.pack(MAGIC, n, lanes, len(marks), written, zlib.crc32(np.asarray(ids, "<u4").tobytes())) + body


def decode(data: bytes, table: Table, segment: int | None = None) -> np.ndarray:
    """All ids of a block, or those from one checkpoint to the next. A whole block is checked against its checksum."""
    magic, n, lanes, points, written, crc = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not an encoded block")
    if not n:
        return np.zeros(0, np.uint32)
    size, steps = 8 + 8 * lanes, -(-n // lanes)
    first = segment or 0
    t0, at = struct.unpack_from("<II", data, _HEAD.size + first * size)
    state = np.frombuffer(data, "<u8", lanes, _HEAD.size + first * size + 8).copy()
    words = np.frombuffer(data, "<u4", written, _HEAD.size + points * size).astype(np.uint64)
    stop = steps if segment is None or first + 1 >= points else min(steps, (first + 1) * CHECKPOINT_STEPS)
    out = np.empty(min(n, stop * lanes) - t0 * lanes, np.uint32)
    mask = np.uint64((1 << SCALE_BITS) - 1)
    for t in range(t0, stop):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        x = state[: b - a]
        slot = x & mask
        s = table.symbol[slot]
        out[a - t0 * lanes : b - t0 * lanes] = s
        x = table.freq[s] * (x >> np.uint64(SCALE_BITS)) + slot - table.cum[s]
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
            at += len(low)
        state[: b - a] = x
    if segment is None and (zlib.crc32(out.astype("<u4").tobytes()) != crc or at != written or (state != _LOW).any()):
        raise ValueError("a block's ids do not have its checksum, or its words were changed")
    return out


def segments(data: bytes) -> int:
    return _HEAD.unpack_from(data)[3]
