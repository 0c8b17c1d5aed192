"""Content-defined anchors of byte strings: each window of WINDOW bytes has one, chosen by the bytes alone.

Of the K-byte strings inside a window the one with the smallest hash, the
leftmost of equals, is its anchor; equal windows have equal anchors at equal
places. Consecutive windows mostly share an anchor: such a run of windows and the
bytes that it spans are a segment.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .shingles import mixed

WINDOW, K = 100, 16
PLACES_BITS = 23
CHUNK = (1 << PLACES_BITS) - 1

_bytes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_steps = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)]


def _segments(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    h = _bytes[raw]
    have = 1
    for step in _steps:  # hashes of 2, 4, 8, 16 bytes
        h = h[:-have] * step + h[have:]
        have *= 2
    h = mixed(h)
    low = np.uint64(CHUNK)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, need = 1, WINDOW - K + 1
    while width < need:
        by = min(width, need - width)
        m = np.minimum(m[:-by], m[by:])
        width += by
    at = (m & low).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return first, np.diff(np.append(first, len(at))), at[first] - first, h[at[first]]


def segments(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, place of the anchor, anchor hash and content hash of each segment of a text."""
    found = []
    raw = np.frombuffer(text, np.uint8)
    low = 0
    while len(raw) - low >= WINDOW:
        part = raw[low : low + CHUNK]
        first, n, mark, anchor = _segments(part)
        found.append((first + low, n, mark, anchor))
        low += len(part) - WINDOW + 1
    if not found:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty
    at, n, mark, anchor = (np.concatenate(x) for x in zip(*found))
    view = memoryview(text)
    digest = xxhash.xxh3_64_intdigest
    whole = np.fromiter((digest(view[a:b]) for a, b in zip(at.tolist(), (at + n + WINDOW - 1).tolist())), np.uint64, len(at))
    return at, n, mark, anchor.view(np.int64), whole.view(np.int64)
