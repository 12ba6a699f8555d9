"""Hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Bytes that are hashed in one step; a longer word makes a longer step.
PIECE = 1 << 18

_rng = np.random.default_rng(11)
_OF_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**63)) * 2 + 1
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
#: Byte classes of a text with its ASCII letters folded, for bytes.translate.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(32)) * _U(0xD6E8FEB86659FD93)
    return x ^ x >> _U(29)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_up, _down = _powers(_BASE, PIECE), _powers(pow(_BASE, -1, 1 << 64), PIECE)


def _piece(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a run of bytes: a sum of a random number for each byte times a power for its place."""
    border = np.diff(np.concatenate([[0], (~_SPACE[a]).view(np.int8), [0]]))
    start, end = np.flatnonzero(border == 1), np.flatnonzero(border == -1)
    up, down = (_up, _down) if len(a) <= PIECE else (_powers(_BASE, len(a)), _powers(pow(_BASE, -1, 1 << 64), len(a)))
    upto = np.concatenate([[_U(0)], np.cumsum(_OF_BYTE[a] * up[: len(a)], dtype=_U)])
    return start, mixed((upto[end] - upto[start]) * down[start] + (end - start).astype(_U))


def word_hashes(texts: list[bytes], fold: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts end to end, and each text's number of words; ASCII white space parts words."""
    whole = b"\n".join(texts)
    a = np.frombuffer(whole.translate(fold) if fold else whole, np.uint8)
    starts, hashes, low = [], [], 0
    while low < len(a):
        high = min(len(a), low + PIECE)
        if high < len(a):
            gaps = np.flatnonzero(_SPACE[a[low:high]])
            while not len(gaps) and high < len(a):
                gaps = np.flatnonzero(_SPACE[a[high : high + PIECE]]) + (high - low)
                high = min(len(a), high + PIECE)
            high = low + int(gaps[-1]) + 1 if len(gaps) else high
        start, h = _piece(a[low:high])
        starts.append(start + low)
        hashes.append(h)
        low = high
    ends = np.cumsum([len(t) + 1 for t in texts])
    if not starts:
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    upto = np.searchsorted(np.concatenate(starts), ends)
    return np.concatenate(hashes), np.diff(np.concatenate([[0], upto]))
