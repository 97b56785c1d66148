"""Words and word shingles of Arrow text columns as 64-bit numbers, in numpy.

A word is a maximal run of bytes other than the six ASCII white-space bytes
(0x20 and 0x09 to 0x0D).  A null text has no words.  Texts are read in pieces
cut at white space, so the extra memory is bounded by ``PIECE`` (or by the
longest word), never by the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time.
PIECE = 1 << 20
#: Words in a shingle.
WIDTH = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(4) + np.uint64(3)
_LOW = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the offsets of the texts (null: empty)."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _piece_words(data: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of some bytes; no word goes on over a cut."""
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    first[inner] = ~space[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    place = np.zeros(len(data), np.int64)
    place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = _BYTE[_LOWER[data] if lower else data] * _LOW[place & 4095]
    if len(data) > 4096 and place.max() > 4095:
        far = place >> 12
        value[far > 0] *= mix(far[far > 0].astype(np.uint64)) | np.uint64(1)
    value[space] = 0
    return starts, mix(np.add.reduceat(value, starts))


def words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the offsets of the texts in them."""
    hashes, _, offsets = _words(*text_bytes(column), lower)
    return hashes, offsets


def words_and_lines(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As words, and the sorted word offsets at which lines (parted by \\n) or texts start."""
    data, offsets = text_bytes(column)
    hashes, starts, of_text = _words(data, offsets, lower)
    lines = np.searchsorted(starts, np.flatnonzero(data == 0x0A)).astype(np.int64)
    return hashes, of_text, np.unique(np.concatenate([lines, of_text]))


def words_and_blocks(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words_and_lines, and the sorted word offsets at which texts start or a blank line ends."""
    data, offsets = text_bytes(column)
    hashes, starts, of_text = _words(data, offsets, lower)
    lines = np.searchsorted(starts, np.flatnonzero(data == 0x0A)).astype(np.int64)
    blank = lines[1:][lines[1:] == lines[:-1]]
    return hashes, of_text, np.unique(np.concatenate([lines, of_text])), np.unique(np.concatenate([blank, of_text]))


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):  # go back to white space or the start of a text; else forward to them
            back = np.flatnonzero(_SPACE[data[at:end]])
            text = offsets[np.searchsorted(offsets, end, "right") - 1]
            cut = max(at + int(back[-1]) + 1 if len(back) else 0, int(text))
            while cut <= at and end < len(data):
                ahead = np.flatnonzero(_SPACE[data[end : end + PIECE]])
                text = int(offsets[np.searchsorted(offsets, end)])
                space = end + int(ahead[0]) + 1 if len(ahead) else len(data) + 1
                if min(text, space) <= end + PIECE or end + PIECE >= len(data):
                    cut = min(text, space, len(data))
                end = min(end + PIECE, len(data))
            end = cut if cut > at else len(data)
        s, h = _piece_words(data[at:end], offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at, lower)
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    at_bytes = np.concatenate(starts)
    return np.concatenate(hashes), at_bytes, np.searchsorted(at_bytes, offsets).astype(np.int64)


def shingles(column: pa.Array, width: int = WIDTH, lower: bool = True) -> list[np.ndarray]:
    """Of each text the sorted distinct shingles; all its words as one shingle if it has fewer."""
    word, offsets = words(column, lower)
    return sets(word, windows(word, width), offsets, width)


def windows(word: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The hash of the ``width`` words from each word on."""
    total = np.zeros(max(0, len(word) - width + 1), np.uint64)
    for j in range(width if len(total) else 0):
        total += word[j : len(word) - width + 1 + j] * _PLACE[j]
    return mix(total + np.uint64(width))


def sets(word: np.ndarray, total: np.ndarray, offsets: np.ndarray, width: int = WIDTH, ends: np.ndarray | None = None) -> list[np.ndarray]:
    """The sorted distinct shingles of each run of words (from each offset to the next, or to its end)."""
    out = []
    for a, b in zip(offsets.tolist() if ends is not None else offsets[:-1].tolist(), (offsets[1:] if ends is None else ends).tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            out.append(mix((word[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(1 << 20) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
