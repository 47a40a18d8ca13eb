"""BPE encoding and decoding with a tokenization automaton.

The automaton reads token labels. Its states are the tokens themselves: the
state after a token says which tokens may follow. It starts as one state a byte
with every byte allowed after every byte; each merge (u, v) -> w, in order, adds
its gadget:

* the arc v leaves the state u, as u v is now always written w;
* a state w appears with the arcs that v had before, as a text after w is a text after v;
* any state with an arc u gets an arc w, any state without one gets none.

After the last merge exactly one path of arcs spells a word: its encoding. The
driver compiles all merges once into a table of bits, a row a class of states and
a column a class of tokens: a token that is never the left part of a merge loses
no arc, so it shares the row its right part had when it was made, and so for
columns. Every beginning of a word also has exactly one path, so a word is
encoded in one walk over its bytes: at each place the arcs of the token that ends
there, by the table, give the tokens that end later. Decoding emits the labels of
the arcs.

Words come from the byte-level pre-tokenizer's pattern; pieces of text seen before
are looked up (see ``pieces``).

Results: null texts are empty texts (no tokens). Special tokens in a text give
their own id. Whole texts are encoded, of any length; rows with equal doc_id are
separate documents. An empty table gives an empty result. A vocabulary in which
two merges make one token is refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, replace
from itertools import pairwise
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from filelens.llm.common_arrow import map_arrays, worker_state
from filelens.llm.pieces import PATTERN, PieceTable, text_groups

#: Pieces kept by a worker, and words beside them.
KEPT, WORDS = 500_000, 300_000
GROUP_BYTES = 8 << 20


@dataclass(frozen=True)
class Vocabulary:
    """What goes to every task: bounded by the vocabulary's own size, a few MB."""

    labels: tuple[bytes, ...]  # by id; empty where an id has no label
    merges: tuple[tuple[int, int, int], ...]  # left, right, made; in order of priority
    special: tuple[tuple[str, int], ...]


def _byte_letters() -> dict[str, int]:
    """The printable letter for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


def read_vocabulary(path: str) -> Vocabulary:
    """From a byte-level BPE tokenizer.json."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids, letters = spec["model"]["vocab"], _byte_letters()
    special = tuple((t["content"], t["id"]) for t in spec["added_tokens"])
    labels = [b""] * (1 + max([*ids.values(), *(i for _, i in special)]))
    for token, i in ids.items():
        labels[i] = bytes(letters[c] for c in token)
    for content, i in special:
        labels[i] = content.encode()
    merges = []
    for pair in spec["model"]["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((ids[left], ids[right], ids[left + right]))
    return Vocabulary(tuple(labels), tuple(merges), special)


@dataclass(frozen=True)
class Transitions:
    """The compiled automaton: bounded by the vocabulary, at most its size squared in bits."""

    rows: np.ndarray  # by token, the class of the state after it; -1 where a token is in no path
    columns: np.ndarray  # by token, the class of its arcs
    bits: np.ndarray  # rows x columns, eight columns a byte


def _shared_classes(vocabulary: Vocabulary, side: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Class of each token, and (step, class, class it copies) of those that merges add.

    ``side`` 0 is for rows, which the left part of a merge changes and its right part
    hands on; 1 for columns, the other way round.
    """
    changed = {m[side] for m in vocabulary.merges}
    found, times, known, added = np.full(len(vocabulary.labels), -1), {}, {}, []
    for t, label in enumerate(vocabulary.labels):
        if len(label) == 1:
            found[t] = known.setdefault(t if t in changed else None, len(known))
    for step, merge in enumerate(vocabulary.merges):
        source, made = merge[1 - side], merge[2]
        if side == 1:  # an arc is laid after the cut of its own merge, a row copied before it
            times[merge[1]] = times.get(merge[1], 0) + 1
        if made in changed:
            key = made
        elif source in changed:
            key = source, times.get(source, 0)
        else:
            found[made] = found[source]
            continue
        if key not in known:
            known[key] = len(known)
            added.append((step, known[key], int(found[source])))
        found[made] = known[key]
        if side == 0:
            times[merge[0]] = times.get(merge[0], 0) + 1
    return found, added


def compile_merges(vocabulary: Vocabulary) -> Transitions:
    """Add the gadgets of all merges, in order."""
    if len({m[2] for m in vocabulary.merges}) < len(vocabulary.merges):
        raise ValueError("two merges make one token")
    (rows, new_rows), (columns, new_columns) = _shared_classes(vocabulary, 0), _shared_classes(vocabulary, 1)
    bits = np.zeros((int(rows.max()) + 1, int(columns.max()) // 8 + 1), dtype=np.uint8)
    singles = [t for t, label in enumerate(vocabulary.labels) if len(label) == 1]
    for c in set(columns[singles].tolist()):
        bits[list(set(rows[singles].tolist())), c >> 3] |= 1 << (c & 7)
    row_at, column_at = {s: x for s, *x in new_rows}, {s: x for s, *x in new_columns}
    n_rows = len(set(rows[singles].tolist()))
    for step, (u, v, _) in enumerate(vocabulary.merges):
        if step in row_at:
            new, source = row_at[step]
            bits[new], n_rows = bits[source], new + 1
        r, c = rows[u], columns[v]
        bits[r, c >> 3] &= ~np.uint8(1 << (c & 7))
        if step in column_at:
            new, source = column_at[step]
            bits[:n_rows, new >> 3] |= ((bits[:n_rows, source >> 3] >> (source & 7)) & 1) << (new & 7)
    return Transitions(rows.astype(np.int32), columns.astype(np.int32), bits)


class TokenAutomaton:
    """Walks the compiled table; see the module's text."""

    def __init__(self, vocabulary: Vocabulary, table: Transitions):
        self.width, self.bits = table.bits.shape[1], table.bits.ravel().data
        self.row, self.column = (table.rows * self.width).tolist(), table.columns.tolist()
        self.size = [len(label) for label in vocabulary.labels]
        special = {i for _, i in vocabulary.special}
        self.step: dict[int, int] = {}  # spelling tree: 256 * node + byte -> node
        self.token = [-1]
        for t, label in enumerate(vocabulary.labels):
            if not label or t in special or table.rows[t] < 0:
                continue
            node = 0
            for b in label:
                key = node << 8 | b
                if (node := self.step.get(key, -1)) < 0:
                    node = self.step[key] = len(self.token)
                    self.token.append(-1)
            self.token[node] = t

    def has_arc(self, p: int, t: int) -> bool:
        """Whether the token t may follow the state p."""
        c = self.column[t]
        return bool(self.bits[self.row[p] + (c >> 3)] >> (c & 7) & 1)

    def encode(self, word: bytes) -> list[int]:
        """The path that spells ``word``."""
        step, token, column, bits, n = self.step.get, self.token, self.column, self.bits, len(word)
        ends = [-1] * (n + 1)  # the token that ends at each place
        for at in range(n):
            if at and ends[at] < 0:
                continue
            row, node = self.row[ends[at]], 0
            for end in range(at, n):
                node = step(node << 8 | word[end], -1)
                if node < 0:
                    break
                t = token[node]
                if t >= 0:
                    c = column[t]
                    if not at or bits[row + (c >> 3)] >> (c & 7) & 1:
                        ends[end + 1] = t
        path = []
        while n:
            if ends[n] < 0:
                raise ValueError("no path spells this word")
            path.append(ends[n])
            n -= self.size[ends[n]]
        return path[::-1]


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: Vocabulary, table: Transitions | None = None):
        self.automaton = TokenAutomaton(vocabulary, table or compile_merges(vocabulary))
        self.special = dict(vocabulary.special)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.labels = pa.array(vocabulary.labels, pa.binary())
        self.words, self.find = {}, regex.compile(PATTERN).findall
        self.table = PieceTable(self.special, lambda pieces: list(map(self._plain, pieces)), self._whole, KEPT)

    def _word(self, word: str) -> bytes:
        if (known := self.words.get(word)) is None:
            ids = self.automaton.encode(word.encode())
            known = pack(f"<{len(ids)}I", *ids)
            if len(self.words) >= WORDS:
                self.words.clear()
            if len(word) < 64:
                self.words[word] = known
        return known

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._word, self.find(text)))

    def _whole(self, text: str) -> bytes:
        spans = self.cut.split(text) if self.cut else [text]
        return b"".join(pack("<I", self.special[s]) if i % 2 else self._plain(s) for i, s in enumerate(spans))

    def encode_group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of a group of texts one after another, and where each text's begin and end."""
        return self.table.encode(texts)

    def decode_group(self, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
        """The labels of the arcs one after another, text by text."""
        taken = self.labels.take(pa.array(ids.astype(np.int64)))
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, dtype=np.int32)[: len(taken) + 1][begin].tolist()
        data = data.to_pybytes() if data is not None else b""
        return [data[i:j] for i, j in pairwise(at)]

    def encode(self, text: str) -> list[int]:
        return self.encode_group(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.fromiter(ids, dtype=np.int64)
        return self.decode_group(ids, np.array([0, len(ids)]))[0].decode("utf-8", "replace")

    def accepts(self, ids: list[int]) -> bool:
        """Whether a sequence is a path of the automaton, as any word's encoding is."""
        return all(self.automaton.has_arc(a, b) for a, b in pairwise(ids))


def encode_documents(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with n_tokens, ids (binary, little-endian 32-bit) and decoded text."""
    return _encoded(docs, path, keep, "n_tokens long, ids binary, decoded string", lambda packed, text: (packed, text.decode("utf-8", "replace")))


def digest_documents(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with n_tokens and the SHA-256 of ids and of the decoded text."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _encoded(docs, path, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda packed, text: (sha(packed), sha(text.decode("utf-8", "replace").encode())))


def _encoded(docs: DataFrame, path: str, keep: list[str], added: str, row) -> DataFrame:
    with open(path, "rb") as f:
        name = "bpe " + hashlib.file_digest(f, "sha256").hexdigest()
    vocabulary = read_vocabulary(path)
    sent = docs.sparkSession.sparkContext.broadcast((replace(vocabulary, merges=()), compile_merges(vocabulary)))  # the merges are in the table
    fields = [f.split(" ")[0] for f in added.split(", ")]

    def make():
        codec = worker_state(name, lambda: Codec(*sent.value))

        def run(texts: pa.Array) -> dict[str, list]:
            out = {f: [] for f in fields}
            for _, group in text_groups(texts, GROUP_BYTES):
                ids, begin = codec.encode_group(group)
                decoded, packed, at = codec.decode_group(ids, begin), ids.tobytes(), (4 * begin).tolist()
                rows = [row(packed[i:j], text) for (i, j), text in zip(pairwise(at), decoded, strict=True)]
                out[fields[0]].extend(np.diff(begin).tolist())
                for k, f in enumerate(fields[1:]):
                    out[f].extend([r[k] for r in rows])
            return out

        return run

    return map_arrays(docs, "text", keep, added, make, keeps=name)
