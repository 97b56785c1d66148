"""Byte-level BPE as a deterministic automaton over tokens.

The automaton starts as one state with a loop for each byte and takes one merge
gadget per merge, in rank order.  The gadget of ``u v -> w`` splits the state
that ``u`` leads to: the copy has no arc ``v``, every arc ``u`` is redirected
to the copy, and wherever an arc ``u`` starts an arc ``w`` is added that leads
where ``u v`` led.  All arcs of a label lead to one state, so a state is named by
its label.  What is left at the end accepts exactly the token sequences that the
merges yield, each text by one path (Berglund, Martens and van der Merwe 2024;
Cognetta and Okazaki 2024).

The states of 50,000 merges share nearly all arcs, so a state is stored as what
its gadgets changed: the state it was copied from, when, and the arcs cut from
it (``_cut``).

``Transitions`` compiles this into a deterministic automaton over bytes.  Every
prefix of a word has one path, so it ends in one label; what decides the labels
further on is that label and, for each shorter suffix that some token begins with,
the node of that suffix in the trie of all tokens and the label before it.  This is
a state.  Its transition by a byte moves all nodes on, and the one token that ends
there and whose arc the automaton has is the next label.  States and transitions are
numbered and kept in a table as words first need them, and a word is encoded by one
look-up a byte, without search or return; its labels are then read back from its
end.  Decoding emits the labels of the arcs.

Texts are whole; null is an empty text; special tokens in a text are tokens of their
own, as the file lists them.  Each row is encoded by itself, so repeated rows give
equal rows; an empty table gives an empty one; columns other than doc_id and text
play no part.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.runtime import ship

#: Fixed value: the pre-split pattern of byte-level BPE files, with white space spelt out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words and transitions kept by a worker.
KEPT_WORDS, KEPT_TRANSITIONS = 700_000, 250_000
START = -1
_loaded: dict[str, ByteBPE] = {}


def byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class MergeAutomaton:
    def __init__(self, labels: list[int]):
        """One state with a loop for each single-byte label."""
        self.time = 0
        self._born = dict.fromkeys(labels, 0)
        self._first: dict[int, int] = {}
        self._copied: dict[int, int] = {}
        self._cut: dict[tuple[int, int], int] = {}

    def gadget(self, u: int, v: int, w: int) -> None:
        """The next merge, u v -> w."""
        if u not in self._born or v not in self._born or w in self._born:
            raise ValueError(f"merge {u} {v} -> {w} uses a label that no earlier merge made, or makes one again")
        self.time += 1
        self._cut[u, v] = self.time
        self._born[w] = self.time
        self._first[w] = u
        self._copied[w] = v

    def _arc_at(self, state: int, label: int, time: int) -> bool:
        """Whether the arc was there just after so many gadgets."""
        while True:
            if self._cut.get((state, label), time + 1) <= time:
                return False
            a, b = self._born[state], self._born[label]
            if a == b == 0:
                return True
            if b >= a:  # added with the label, where its first part had an arc once this gadget had cut
                label, time = self._first[label], b
            else:  # copied from the state of its second part before this gadget cut
                state, time = self._copied[state], a - 1

    def arc(self, state: int, label: int) -> bool:
        """Whether label may follow."""
        return self._arc_at(state, label, self.time)


class Transitions:
    """The automaton over bytes: its trie of tokens, and the table of states and transitions met so far."""

    def __init__(self, automaton: MergeAutomaton, ids: dict[bytes, int]):
        self.arc = automaton.arc
        self.child: dict[int, int] = {}  # node * 256 + byte -> node; the root is 0
        self.token = [START]
        for raw, label in ids.items():
            node = 0
            for b in raw:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(START)
                node = self.child[key]
            self.token[node] = label
        self.forget()

    def forget(self) -> None:
        """An empty table but for the first state."""
        first = ((START, 0),)  # (label before a suffix, the suffix's node)
        self.states, self.number, self.table = [first], {first: 0}, {}

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The transition's state and label, compiled into the table."""
        after, last = [], None
        for label, node in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            after.append((label, node))
            token = self.token[node]
            if token != START and (label == START or self.arc(label, token)):
                last = token
        if last is None:
            raise ValueError("no path spells this word")
        to = (*after, (last, 0))
        found = self.number.get(to)
        if found is None:
            found = self.number[to] = len(self.states)
            self.states.append(to)
        out = self.table[state << 8 | byte] = found, last
        return out

    def labels(self, word: bytes) -> list[int]:
        """The last label of each prefix of a word."""
        table, state, out = self.table, 0, []
        for byte in word:
            found = table.get(state << 8 | byte)
            if found is None:
                found = self.step(state, byte)
                if len(table) >= KEPT_TRANSITIONS:  # begin an empty table at this state
                    at = self.states[found[0]]
                    self.forget()
                    table, found = self.table, (len(self.states), found[1])
                    self.states.append(at)
                    self.number[at] = found[0]
            state = found[0]
            out.append(found[1])
        return out


class _Words(dict):
    """Encoded words; a missing one is encoded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = np.asarray(self.encode(word.encode()), "<u4").tobytes()
        if len(word) < 64:
            self[word] = found
        return found


class ByteBPE:
    def __init__(self, file: bytes):
        spec = json.loads(file)
        vocab, merges, byte = spec["model"]["vocab"], spec["model"]["merges"], byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        raw = lambda token: bytes(byte[c] for c in token)
        ids = {raw(t): i for t, i in vocab.items() if t not in self.special}
        self.automaton = MergeAutomaton([ids[bytes([b])] for b in range(256)])
        self.ids = {bytes([b]): ids[bytes([b])] for b in range(256)}
        for pair in merges:
            u, v = (raw(t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            self.automaton.gadget(ids[u], ids[v], ids[u + v])
            self.ids[u + v] = ids[u + v]
        self.transitions = Transitions(self.automaton, self.ids)
        self.size = {i: len(t) for t, i in self.ids.items()}
        self.label = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in ids.items():
            self.label[i] = t
        for t, i in self.special.items():
            self.label[i] = t.encode()
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.words = _Words(self.encode_word)

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the path that spells a pre-split word."""
        last, size = self.transitions.labels(word), self.size
        out, at = [], len(word)
        while at:
            label = last[at - 1]
            out.append(label)
            at -= size[label]
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        word = self.words.__getitem__
        if self.cut is None or not any(t in text for t in self.special):
            return b"".join(map(word, self.split(text)))
        parts = self.cut(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else b"".join(map(word, self.split(p))) for p in parts)

    def decode(self, ids: bytes) -> str:
        """The labels of the ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.label.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def load(file: bytes) -> ByteBPE:
    key = hashlib.sha256(file).hexdigest()
    if key not in _loaded:
        _loaded[key] = ByteBPE(file)
    return _loaded[key]


def encode_documents(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of each document."""
    ship(documents.sparkSession)
    file = Path(tokenizer_path).read_bytes()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for part in parts:
            ids = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, ids binary")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and text of each row of ids."""
    ship(encoded.sparkSession)
    file = Path(tokenizer_path).read_bytes()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for part in parts:
            texts = [bpe.decode(x or b"") for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(batches, f"doc_id {kind}, text string")


def round_trip(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, encoded and decoded in one pass."""
    ship(documents.sparkSession)
    file = Path(tokenizer_path).read_bytes()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, digest = load(file), lambda x: hashlib.sha256(x).hexdigest()
        for part in parts:
            n, of_ids, of_text = [], [], []
            for text in part.column("text"):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                of_ids.append(digest(ids))
                of_text.append(digest(bpe.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
