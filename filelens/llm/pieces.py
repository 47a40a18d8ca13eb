"""Texts as pieces that are encoded once and then looked up, for byte-level BPE.

The pre-tokenizer's pattern always cuts before a space that a non-space follows,
whatever lies left of it. In texts without white space in a row or at an edge it
also cuts around every line end. So texts are cut there, by Arrow: a group of
texts becomes distinct pieces and a list of their numbers, only pieces never seen
before are encoded, and the packed ids of the group are taken by number.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: white space of Python or of Unicode.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
IN_A_ROW = f"{SPACE}{SPACE}|^{SPACE}|{SPACE}$"
SAFE_CUT = regex.compile(r" (?=\S)")
HAS_SPACE = re.compile(r"\s")


def text_groups(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """Where a group of texts begins, and the group, of about ``size`` bytes at most; nulls become empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


class _Kept:
    """Packed ids by piece, two generations of Arrow arrays: once more than ``most`` are kept, those not asked for again are forgotten."""

    def __init__(self, encode: Callable[[pa.Array], list[bytes]], most: int):
        self.encode, self.most = encode, most
        self.names, self.packed = self.old = pa.array([], pa.string()), pa.array([], pa.binary())

    def _add(self, names: pa.Array, packed: pa.Array) -> None:
        self.names, self.packed = pa.concat_arrays([self.names, names]), pa.concat_arrays([self.packed, packed])

    def look_up(self, pieces: pa.Array) -> pa.Array:
        """Packed ids of distinct pieces."""
        if len(self.names) > self.most:
            self.old, self.names, self.packed = (self.names, self.packed), *(x.slice(0, 0) for x in self.old)
        at = pc.index_in(pieces, value_set=self.names)
        if at.null_count:
            missing = pieces.filter(at.is_null())
            if len(self.old[0]) and (again := pc.index_in(missing, value_set=self.old[0])).null_count < len(missing):
                self._add(missing.filter(again.is_valid()), self.old[1].take(again.drop_null()))
                missing = missing.filter(again.is_null())
            self._add(missing, pa.array(self.encode(missing), pa.binary()))
            at = pc.index_in(pieces, value_set=self.names)
        return self.packed.take(at)


class PieceTable:
    """Packed ids of texts, by pieces. ``encode_new`` packs the ids of pieces, ``encode_whole`` those of a text with special tokens.

    Pieces are told apart by their text and whether a space stands before it; about ``most`` are kept of either kind.
    """

    def __init__(self, special: Iterable[str], encode_new: Callable[[list[str]], list[bytes]], encode_whole: Callable[[str], bytes], most: int):
        self.special, self.encode_whole = list(special), encode_whole
        self.bare = _Kept(lambda names: encode_new(names.to_pylist()), most)
        self.spaced = _Kept(lambda names: encode_new([" " + n for n in names.to_pylist()]), most)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids (unsigned 32-bit) of a group of texts one after another, and where each text's begin and end."""
        odd = pc.match_substring_regex(texts, IN_A_ROW)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(odd), "", texts), "\n", " \n "), " ")
        first, values = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        first = first - first[0]
        number, names = values.indices.to_numpy(), values.dictionary
        ends = number == pc.index(names, "\n").as_py()
        spaced = ~ends
        spaced[1:] &= ~ends[:-1]
        spaced[first[:-1]] = False
        key = number + spaced * len(names)
        used = np.zeros(2 * len(names), dtype=bool)
        used[key] = True
        place = np.cumsum(used) - 1
        bare, after = np.flatnonzero(used[: len(names)]), np.flatnonzero(used[len(names) :])
        packed = pa.concat_arrays([self.bare.look_up(names.take(pa.array(bare))), self.spaced.look_up(names.take(pa.array(after)))])
        taken = packed.take(pa.array(place[key]))
        _, offsets, data = taken.buffers()
        begin = np.frombuffer(offsets, dtype=np.int32)[: len(taken) + 1][first].astype(np.int64) // 4
        ids = np.frombuffer(data, dtype="<u4", count=int(begin[-1])) if data is not None else np.empty(0, "<u4")
        if odd.any():
            ids, begin = self._with_odd(texts, np.flatnonzero(odd).tolist(), ids, begin)
        return ids, begin

    def _with_odd(self, texts: pa.Array, odd: list[int], ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put in the texts that Arrow can't cut."""
        whole, cut = {}, {}
        for i in odd:
            text = texts[i].as_py()
            if any(x in text for x in self.special):
                whole[i] = text
            else:
                cut[i] = SAFE_CUT.split(text)
        known = []
        for kept, pieces in ((self.bare, (p[0] for p in cut.values())), (self.spaced, (x for p in cut.values() for x in p[1:]))):
            wanted = list(dict.fromkeys(pieces))
            known.append(dict(zip(wanted, kept.look_up(pa.array(wanted, pa.string())).to_pylist(), strict=True)))
        bare, spaced = known
        rows, at = [], 0
        for i in odd:
            rows.append(ids[begin[at] : begin[i]])
            packed = self.encode_whole(whole[i]) if i in whole else bare[cut[i][0]] + b"".join(map(spaced.__getitem__, cut[i][1:]))
            rows.append(np.frombuffer(packed, dtype="<u4"))
            at = i + 1
        rows.append(ids[begin[at] :])
        size = np.diff(begin)
        size[odd] = [len(r) for r in rows[1::2]]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum(size)])
