"""Words and word hashes of whole texts, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

NOT_A_WORD = bytes(0x20 if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80) else b for b in range(256))
CHUNK_BYTES = 1 << 18
# of byte values that part words: ASCII white space, and all but digits, letters and bytes beyond ASCII
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
MARK = np.frombuffer(NOT_A_WORD, np.uint8) == 0x20
_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; nothing for null."""
    return b"" if text is None else text.encode("utf-8", "replace").lower()


def space_words(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, A-Z lower-cased."""
    return utf8(text).split()


def plain_words(text: str | None) -> list[bytes]:
    """Runs of ASCII digits and letters and of all other characters beyond
    ASCII, A-Z lower-cased."""
    return utf8(text).translate(NOT_A_WORD).split()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first ``n`` powers modulo 2**64, and their inverses."""
    steps = np.empty((2, n), np.uint64)
    steps[:] = np.array([[_BASE], [_INVERSE]], np.uint64)
    steps[:, 0] = 1
    return tuple(np.multiply.accumulate(steps, axis=1))


@lru_cache(1)
def _table() -> tuple[np.ndarray, np.ndarray]:
    return _powers(CHUNK_BYTES + 4096)


def _chunk_hashes(text: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~separator[text]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _table() if len(text) <= CHUNK_BYTES + 4096 else _powers(len(text))
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:len(text)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts]), starts, ends


def word_places(text: bytes, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a whole text, and the bytes they start
    and end at, without making the words: each hash is a difference of two running
    sums of a polynomial in the bytes. Long texts go through in pieces cut
    between words."""
    hashes, starts, ends, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    view = np.frombuffer(text, np.uint8)
    while at < len(view):
        end = at + CHUNK_BYTES
        while end < len(view) and not separator[view[end:end + CHUNK_BYTES]].any():
            end += CHUNK_BYTES
        if end < len(view):
            end += int(np.argmax(separator[view[end:end + CHUNK_BYTES]]))
        found, first, last = _chunk_hashes(view[at:end], separator)
        hashes.append(found)
        starts.append(first + at)
        ends.append(last + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def word_hashes(text: bytes, separator: np.ndarray = SPACE) -> np.ndarray:
    return word_places(text, separator)[0]


def batch_hashes(texts: list[str | None], separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of many texts one after the other, and where each text
    begins among them, with the number of all words at the end."""
    parts = [utf8(text) for text in texts]
    bounds = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)])
    hashes, starts, _ = word_places(b" ".join(parts), separator)
    return hashes, np.searchsorted(starts, bounds)


def text_groups(texts: list[str | None], size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` characters together, or one longer text."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "") + 1
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * _ODD[1]
    x = (x ^ (x >> np.uint64(29))) * _ODD[2]
    return x ^ (x >> np.uint64(32))


def window_hashes_at(hashes: np.ndarray, offsets: range | list[int], starts: np.ndarray) -> np.ndarray:
    """A hash for each window in ``starts``, of the words at ``offsets`` from its start."""
    total = np.zeros(len(starts), np.uint64)
    for at in offsets:
        total = (total ^ hashes[starts + at]) * _ODD[0]
        total ^= total >> np.uint64(32)
    return mixed(total)


def window_hashes(hashes: np.ndarray, offsets: range | list[int]) -> np.ndarray:
    """The same for every window."""
    n = max(0, len(hashes) - offsets[-1])
    total = np.zeros(n, np.uint64)
    for at in offsets:
        total = (total ^ hashes[at:at + n]) * _ODD[0]
        total ^= total >> np.uint64(32)
    return mixed(total)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of all words as
    one run where there are fewer; nothing without words."""
    hashes = word_hashes(utf8(text))
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hashes, range(min(size, len(hashes)))))
