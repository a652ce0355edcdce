"""Sorted 64-bit hashes, cut by value into buckets and packed as bytes."""

from __future__ import annotations

import numpy as np

MIN_BUCKETS = 256
BLOCKS_A_BUCKET = 4     # a bucket gathers about as many hashes as this many blocks send


def pack(h: np.ndarray) -> bytes:
    """The lower 56 bits of each hash; the bucket keeps the upper ones."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def unpack(raw: bytes, top: int) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    out[:, 7] = top
    return out.view("<u8").ravel()


def bucket_edges(blocks: int) -> np.ndarray:
    """First hash of each bucket; a bucket never mixes two upper bytes.  The
    number of buckets grows with the number of sending blocks."""
    a_byte = -(-max(MIN_BUCKETS, blocks // BLOCKS_A_BUCKET) // 256)
    inside = [k * (1 << 56) // a_byte for k in range(a_byte)]
    return np.array([(top << 56) + x for top in range(256) for x in inside], np.uint64)
