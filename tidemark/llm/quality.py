"""Quality rules: base counts and zstandard compression bands.

Words are runs of bytes other than ASCII white space.  A text fails the base
rules with under 50 words, or when over half of its words stand in 3-word
windows that the text holds twice or more.  What passes is judged by its
compression ratio (compressed over raw bytes, zstandard level 3): the ratio of
the whole text, and those of its fixed chunks, must lie within the band for
their length.  Under the band a text is repetitive, over it incompressible.  A
text is rejected if its own ratio is outside, or if the chunks outside hold over
a third of its bytes.

A null or empty text has no words and fails the base rules.  Each row is judged
by itself, so repeated rows get equal verdicts; an empty table gives an empty
one; columns other than doc_id and text play no part.  Memory follows the
longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.runtime import map_batches, ship

#: Least bytes, lowest and highest ratio of each band.  The lowest ratios lie under all those of clean labelled rows of the length.
BANDS = ((0, 0.30, 1.60), (256, 0.42, 0.90), (512, 0.48, 0.80), (1024, 0.465, 0.72), (2048, 0.44, 0.68), (4096, 0.42, 0.65), (8192, 0.405, 0.62), (16384, 0.385, 0.60), (65536, 0.37, 0.60), (262144, 0.34, 0.60), (1048576, 0.30, 0.60))
CHUNK, LEVEL, OUTSIDE = 4096, 3, 1 / 3
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
_SYMBOLS = b"#*$%&|<>"
_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, chunks_outside double, kept boolean"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows found twice or more, the first included."""
    n = len(words)
    if n <= window:
        return 0
    code: dict[bytes, int] = {}
    codes = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n)
    key = codes[: n - window + 1]
    for j in range(1, window):  # exact: equal prefixes get equal numbers, renumbered to stay small
        key = key * len(code) + codes[j : n - window + 1 + j]
        if j < window - 1 and n * len(code) ** 2 >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].reshape(-1)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key) + window, np.int64)
    found = np.zeros(len(key), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    at = np.flatnonzero(found)
    np.add.at(twice, at, 1)
    np.add.at(twice, at + window, -1)
    return int(np.count_nonzero(np.cumsum(twice)[:n] > 0))


def within(ratio: float, size: int, bands=BANDS) -> bool:
    _, low, high = max((b for b in bands if b[0] <= size), key=lambda b: b[0])
    return low <= ratio <= high


def judge(text: str | None, compress, chunk: int = CHUNK, bands=BANDS) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
    ratio = len(compress(raw)) / len(raw) if raw else 0.0
    outside = 0
    for at in range(0, len(raw), chunk) if len(raw) > chunk else ():
        piece = raw[at : at + chunk]
        outside += 0 if within(len(compress(piece)) / len(piece), len(piece), bands) else len(piece)
    share = outside / len(raw) if raw else 0.0
    kept = not failed and within(ratio, len(raw), bands) and share <= OUTSIDE
    return len(words), len(b"".join(words).decode()), len(raw) - len(raw.translate(None, _SYMBOLS)), dup, repeat, failed, ratio, share, kept


def quality(documents: DataFrame, chunk: int = CHUNK, bands=BANDS) -> DataFrame:
    """doc_id with the counts, ratios and verdict of each document."""
    ship(documents.sparkSession)
    names = [x.split()[0] for x in _COLUMNS.split(", ")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        for part in parts:
            rows = list(zip(*(judge(t.as_py(), compress, chunk, bands) for t in part.column("text")), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, k) for v, k in zip(rows, kinds, strict=True))], ["doc_id", *names])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, {_COLUMNS}")


def keep_good(documents: DataFrame, chunk: int = CHUNK, bands=BANDS) -> DataFrame:
    """The documents that the rules keep, with all their columns, judged row by row without a join."""
    ship(documents.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for part in parts:
            yield part.filter(pa.array([judge(t.as_py(), compress, chunk, bands)[-1] for t in part.column("text")], pa.bool_()))

    return map_batches(documents, batches, documents.schema)
