"""Token counts of whole texts with a sentencepiece BPE model.

Texts of up to ``chunk`` characters are encoded at once.  A longer text is
encoded in overlapping chunks.  Each chunk's tokens have character offsets; two
neighbours are spliced at an offset where both have a token boundary and which
is proven stable: no piece of the vocabulary matches the text across it.  BPE
only ever merges two symbols into a piece, so no merge crosses such an offset in
either chunk or in the whole text, and the tokens on each side are those of the
whole text.  Where an overlap has no such offset it is doubled, at the utmost
until it starts where the last splice was, when the two chunks are one.  Such a
stretch without a stable offset (a run of one character, say) is then made twice as
long, so that encoding it again costs as much as encoding it, not its square.

Null and empty texts have 0 bytes and 0 tokens.  Equal rows give equal rows; an
empty table gives an empty one.  Further input columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from tidemark.llm.runtime import ship

#: Characters of a chunk and of its overlap with the one before.
CHUNK, OVERLAP = 16_384, 256
#: Offsets' surroundings whose stability a worker remembers.
KEPT = 200_000
_models: dict[str, PieceCounter] = {}


class PieceCounter:
    def __init__(self, model: bytes, chunk: int = CHUNK, overlap: int = OVERLAP):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        self.chunk, self.overlap = chunk, overlap
        ids = range(self.model.get_piece_size())
        self.pieces = {self.model.id_to_piece(i) for i in ids if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))}
        self.reach = max(map(len, self.pieces))
        self.width = np.zeros(len(ids), np.int64)
        for i in ids:
            if self.model.is_byte(i):  # the first byte of a character counts for it
                self.width[i] = not 0x80 <= int(self.model.id_to_piece(i)[3:5], 16) < 0xC0
            else:
                self.width[i] = len(self.model.id_to_piece(i))
        self.widened = 0
        self._stable: dict[str, bool] = {}  # by what stands around an offset

    def ends(self, text: str) -> np.ndarray:
        """Of each token of a text the offset after it; the leading space that the model adds has width 0."""
        return np.cumsum(self.width[np.asarray(self.model.encode(text, num_threads=1), np.int64)]) - 1

    def stable(self, text: str, at: int) -> bool:
        """Whether no piece matches across an offset."""
        mid = min(at, self.reach - 1)
        near = text[at - mid : at + self.reach - 1]
        key = f"{mid} {near}"
        found = self._stable.get(key)
        if found is None:
            if len(self._stable) >= KEPT:
                self._stable.clear()
            near = near.replace(" ", "▁")
            found = not any(near[mid - a : mid + b] in self.pieces for a in range(1, mid + 1) for b in range(1, min(self.reach - a, len(near) - mid) + 1))
            self._stable[key] = found
        return found

    def splice(self, text: str, left: np.ndarray, right: np.ndarray, start: int, end: int) -> int | None:
        """The first stable boundary of both sides in the overlap, away from its edges."""
        common = np.intersect1d(left, right)
        for at in common[(common >= start + self.reach) & (common <= end - self.reach)].tolist():
            if self.stable(text, at):
                return at
        return None

    def count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(self.model.encode(text, num_threads=1))
        done, at, end = 0, 0, self.chunk  # tokens before the offset `at`, the last splice
        ends = self.ends(text[:end])
        while end < len(text):
            overlap, stop = self.overlap, min(len(text), end + self.chunk)
            while True:
                start = max(at, end - overlap)
                if start == at:  # the two chunks are one, encoded from the last splice
                    stop = min(len(text), end + max(self.chunk, end - at))
                    # before a splice that isn't the text's start the model's own leading space must not count
                    ends = self.ends_from(text, at, stop)
                    break
                more = self.ends(text[start:stop]) + start
                found = self.splice(text, ends, more, start, end)
                if found is not None:
                    done += int(np.count_nonzero((ends > at) & (ends <= found))) + int(np.count_nonzero(ends <= at)) * (at == 0)
                    at, ends = found, more[more > found]
                    break
                overlap *= 2
                self.widened += 1
            end = stop
        return done + len(ends)

    def ends_from(self, text: str, at: int, stop: int) -> np.ndarray:
        """Token ends after a stable offset: the tokens that begin there, encoded with enough text before it."""
        if at == 0:
            return self.ends(text[:stop])
        back = max(0, at - 4 * self.reach)
        while True:
            more = self.ends(text[back:stop]) + back
            if back == 0 or at in more:
                return more[more > at]
            back = max(0, back - (at - back))

    def counts(self, texts: list[str]) -> list[int]:
        short = [t if len(t) <= self.chunk else "" for t in texts]
        found = [len(x) for x in self.model.encode(short, num_threads=1)]
        return [n if len(t) <= self.chunk else self.count(t) for n, t in zip(found, texts, strict=True)]


def counter(model: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> PieceCounter:
    key = f"{hashlib.sha256(model).hexdigest()}-{chunk}-{overlap}"
    if key not in _models:
        _models[key] = PieceCounter(model, chunk, overlap)
    return _models[key]


def token_counts(documents: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than the limit) of each document."""
    ship(documents.sparkSession)
    model = Path(model_path).read_bytes()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_model = counter(model, chunk, overlap)
        for part in parts:
            texts = part.column("text").fill_null("")
            n = np.asarray(with_model.counts(texts.to_pylist()), np.int64)
            size = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
