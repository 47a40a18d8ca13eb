"""Periodic runs of words, found online by catchers over dyadic blocks.

A run is a maximal stretch of words with smallest period q. The words of a text are
appended in strides. Every completed block of 2**k words has a catcher, which waits for
its block to come again 2 * 2**k to 4 * 2**k - 1 words later: the first half of each
square of such a period holds a whole block. Each appended word ends one suffix of
2**k words for every k, and that suffix is compared, by fingerprint, with the two
catchers that wait for it (three where blocks are single words), so a word costs
O(log n). Squares caught at one distance from consecutive blocks are one chain; chains are
compared word by word at the end, widened to both sides and merged into runs. Multiples of
a run's period inside it are let go.

State: the words and, for each k, the fingerprints of the last 5 * 2**k places: memory in
proportion to one text. Short texts are appended to the same catchers one after another, with
a word between them that is nowhere else, so no run goes from one into the next. Rows are
independent; nothing is shuffled.

Odd rows: a null or empty text, or one of white space, has no words, no runs, four
nulls and the digests of empty texts. A null doc_id leaves the words as they are. Rows
with equal doc_id are documents of their own. Extra columns aren't read, so their names
can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.llm.common_arrow import give_back, raw, steps, worker_state


@dataclass(frozen=True)
class RunConfig:
    least_words: int = 24
    least_times: int = 3
    stride: int = 1 << 15  # words appended together


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprints of joined halves: not linear, so no text is built to meet another's."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= (b ^ (b >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


class _Level:
    """The catchers over blocks of ``width`` words: fingerprints kept from place ``base`` on, and open chains."""

    def __init__(self, width: int):
        self.width, self.base, self.done = width, 0, 0
        self.prints = np.zeros(0, np.uint64)
        self.gaps = (1, 2, 3) if width == 1 else (2, 3)
        # By gap and column (the period is gap * width + column): the first block of the open chain, or -1.
        self.first = {g: np.full(width, -1, np.int64) for g in self.gaps}

    def of(self, low: int, high: int) -> np.ndarray:
        return self.prints[low - self.base : high - self.base]

    def add(self, new: np.ndarray) -> tuple[int, int]:
        self.prints = np.concatenate([self.prints, new])
        at, self.done = self.done, self.done + len(new)
        return at, self.done

    def trim(self) -> None:
        """Give up what neither a catcher nor the next level needs."""
        keep = (self.done // self.width - 3) * self.width
        if keep - self.base > len(self.prints) // 2:
            self.prints, self.base = self.prints[keep - self.base :], keep


class SquareCatchers:
    """Runs of ``codes``, appended a stride at a time; any cut into strides gives the same runs.

    Catchers of periods beyond ``longest_period``, where that is known, are not set up.
    """

    def __init__(self, least_words: int = 24, least_times: int = 3, longest_period: int | None = None):
        self.least_words, self.least_times, self.longest_period = least_words, least_times, longest_period
        self.levels: list[_Level] = []
        self.codes: list[np.ndarray] = []
        self.n = 0
        self.chains: list[np.ndarray] = []  # rows of period, first place, place after the last, width

    def append(self, codes: np.ndarray) -> None:
        codes = codes.astype(np.uint64)
        self.codes.append(codes)
        self.n += len(codes)
        k = 0
        while (width := 1 << k) <= self.n and (self.longest_period is None or k == 0 or 2 * width <= self.longest_period):
            if k == len(self.levels):
                self.levels.append(_Level(width))
            level = self.levels[k]
            if k == 0:
                new = _mixed(codes, codes)
            else:
                half, below = width // 2, self.levels[k - 1]
                high = self.n - width + 1
                new = _mixed(below.of(level.done, high), below.of(level.done + half, high + half))
            low, high = level.add(new)
            for gap in level.gaps:
                self._catch(level, gap, low, high)
            k += 1
        for level in self.levels:
            level.trim()

    def _catch(self, level: _Level, gap: int, low: int, high: int) -> None:
        """Compare the new suffixes, which begin at low to high - 1, with the catchers ``gap`` blocks before them."""
        width = level.width
        low = max(low, gap * width)
        if low >= high:
            return
        row, column = divmod(low, width)
        if column:  # the rest of a row
            end = min(width, column + high - low)
            self._rows(level, gap, row, row + 1, column, end)
            row += 1
        last, rest = divmod(high, width)
        if row < last:
            self._rows(level, gap, row, last, 0, width)
        if rest and row <= last:
            self._rows(level, gap, last, last + 1, 0, rest)

    def _rows(self, level: _Level, gap: int, low: int, high: int, left: int, right: int) -> None:
        """Rows low to high - 1 of suffixes, a row a block's width, in columns left to right - 1."""
        width = level.width
        suffixes = level.of(low * width, high * width)
        if len(suffixes) < (high - low) * width:  # one row that isn't whole yet
            same = (suffixes[left:right] == level.of((low - gap) * width, (low - gap) * width + 1))[None, :]
        else:
            blocks = level.of((low - gap) * width, (high - gap) * width)[::width]
            same = suffixes.reshape(high - low, width)[:, left:right] == blocks[:, None]
        first = level.first[gap][left:right]
        before = first >= 0
        if not same.any():
            if before.any():
                at = np.nonzero(before)[0]
                self._close(gap * width + left + at, first[at], np.full(len(at), low - gap), width)
                first[at] = -1
            return
        # A column is a period, its rows follow each other: where chains begin and where they are broken.
        held = np.vstack([before[None, :], same]).T
        begins, breaks = np.nonzero(held[:, 1:] & ~held[:, :-1]), np.nonzero(held[:, :-1] & ~held[:, 1:])
        old = np.nonzero(before)[0]
        columns, rows = np.concatenate([old, begins[0]]), np.concatenate([np.full(len(old), -1), begins[1]])
        blocks = np.concatenate([first[old], begins[1] + (low - gap)])
        order = np.lexsort((rows, columns))
        columns, blocks = columns[order], blocks[order]
        is_open = held[:, -1]
        latest = np.append(columns[1:] != columns[:-1], True) & is_open[columns]  # goes on after these rows
        first[:] = -1
        first[columns[latest]] = blocks[latest]
        self._close(gap * width + left + columns[~latest], blocks[~latest], breaks[1] + (low - gap), width)

    def _close(self, periods: np.ndarray, first: np.ndarray, after: np.ndarray, width: int) -> None:
        """Keep chains of blocks first to after - 1 that a run may hold; shorter ones are squares of no reported run."""
        agree = np.maximum((self.least_times - 1) * periods, self.least_words - periods)
        need = np.maximum(1, (agree - width + 1) // width)
        long = after - first >= need
        if long.any():
            self.chains.append(np.stack([periods[long], first[long] * width, after[long] * width, np.full(long.sum(), width)], axis=1))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run of the words so far, by start, then period."""
        closed = list(self.chains)
        for level in self.levels:
            for gap in level.gaps:
                at = np.nonzero(level.first[gap] >= 0)[0]
                if len(at):
                    self._close(gap * level.width + at, level.first[gap][at], (level.done - 1 - at) // level.width - gap + 1, level.width)
        chains, self.chains = self.chains, closed
        return self._merged(np.concatenate(chains)) if chains else []

    def _merged(self, chains: np.ndarray) -> list[tuple[int, int, int]]:
        codes = np.concatenate(self.codes)
        chains = chains[np.argsort(chains[:, 1], kind="stable")]
        periods, lows, highs = chains[:, 0], chains[:, 1], chains[:, 2]
        alive = np.ones(len(chains), bool)
        found = set()
        for i in np.argsort(periods, kind="stable"):
            if not alive[i]:
                continue
            p = int(periods[i])
            for low, high in self._agreeing(codes, *(int(x) for x in chains[i])):
                length = high - low + p
                if length < max(self.least_words, self.least_times * p):
                    continue
                found.add((low, length, p))
                a, b = np.searchsorted(lows, [low, low + length])
                inside = (highs[a:b] + periods[a:b] <= low + length) & (periods[a:b] % p == 0)
                alive[a:b] &= ~inside
        return sorted(((int(s), int(n), int(p)) for s, n, p in found), key=lambda r: (r[0], r[2]))

    def _agreeing(self, codes: np.ndarray, period: int, low: int, high: int, width: int) -> Iterator[tuple[int, int]]:
        """The maximal stretches that meet low to high - 1 whose words are those ``period`` later, compared word by word."""
        end = len(codes) - period
        first, after = low, high
        low, high = max(0, low - width), min(end, high + width)
        same = codes[low:high] == codes[low + period : high + period]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for a, b in zip((edges[::2] + low).tolist(), (edges[1::2] + low).tolist()):
            while a == low > 0 and codes[a - 1] == codes[a - 1 + period]:
                a = low = a - 1
            while b == high < end and codes[b] == codes[b + period]:
                b = high = b + 1
            if a < after and b > first:  # others are chains of their own
                yield a, b


def runs_of(texts: list[list[bytes]], config: RunConfig = RunConfig()) -> list[list[tuple[int, int, int]]]:
    """The runs of each text's words: (start, length, period)."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    parts, starts, at = [], [], 0
    for i, words in enumerate(texts):
        starts.append(at)
        parts += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), np.array([-1 - i])]  # negative: between texts
        at += len(words) + 1
    catchers = SquareCatchers(config.least_words, config.least_times, max(map(len, texts), default=0) // config.least_times)
    codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    for at in range(0, len(codes), config.stride):
        catchers.append(codes[at : at + config.stride])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in catchers.runs():
        i = bisect_right(starts, start) - 1
        found[i].append((start - starts[i], length, period))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.nonzero(kept)[0]])


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; of equal ones that of the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of every tenth document, by its id's crc32, loop from some word on; the others stay."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    cycle = words[at : at + period]
    return words[:at] + (cycle * ((n - at) // len(cycle) + 1))[: n - at]


_OUT = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
)


def periodic_runs(docs: DataFrame, config: RunConfig = RunConfig(), change=lambda words, doc_id: words) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the strongest run, and digests of all runs and of the
    text without repetitions, for every row of ``docs`` (doc_id, text). ``change`` may alter the words of a document first."""

    def digest(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    def rows(ids: list[int | None], texts: list[list[bytes]]) -> Iterator[tuple]:
        for doc_id, words, runs in zip(ids, texts, runs_of(texts, config), strict=True):
            best = strongest(runs)
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
            shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            yield doc_id, len(runs), *shown, digest(listed), digest(collapsed(words, runs))

    def groups(batch: pa.RecordBatch) -> Iterator[tuple]:
        """Rows of texts that together have about a stride's words, one text at least."""
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text")), strict=True):
            words = change((text or b"").split(), doc_id)  # bytes are split at ASCII white space alone
            if texts and size + len(words) > config.stride:
                yield from rows(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(words)
            size += len(words)
        yield from rows(ids, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None)
        for batch in steps(batches, "text"):
            columns = zip(*groups(batch)) if batch.num_rows else [[] for _ in _OUT]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)
        give_back()

    kinds = {pa.int64(): "long", pa.string(): "string"}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in _OUT))
