"""Periodic runs of words, found online by catchers over completed blocks of a power of two.

A run of period ``p`` is a maximal stretch whose words equal the words ``p`` places before. For the
periods from ``P`` to ``2P - 1`` (``P`` a power of two) the text is cut into blocks of ``block`` words.
Once a block is complete and ``look`` further words have been appended, a catcher stands on its end
``e``: it compares those words with the ones ``p`` places before, for all periods at once, by rolling
hashes. Where they agree, the suffix comparison is taken backwards as far as it goes and from then
on advances with every appended word until it fails. ``block`` and ``look`` are chosen such that no
run of the wanted exponent can pass between two catchers. Catchers that meet the same run merge into one
entry, whose end moves on; a run of a multiple of a smaller period has the same bounds and goes.

Words may be appended one at a time or in slices of any size; what is reported is the same.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import BASE_A, Powers, bounded_batches, fields, mixed

#: Least length over period, and least length, of a run that is reported.
EXPONENT = 4
LENGTH = 6
#: Words appended to the catchers at a time.
SLICE_WORDS = 1 << 16
#: Pairs of catchers and periods compared in one go, so that memory stays bounded.
PAIRS = 1 << 20

_POWERS = Powers(BASE_A)


@dataclass
class _Level:
    """Catchers for the periods from ``least`` to ``2 * least - 1``."""

    least: int
    block: int
    look: int
    next_end: int

    @classmethod
    def of(cls, least: int, exponent: int) -> _Level:
        # a run of period p >= least agrees with itself over (exponent - 1) * p places
        agree = (exponent - 1) * least
        block = 1 << max(0, (2 * agree // 3).bit_length() - 1)
        return cls(least, block, agree - block + 1, block)


class SquareCatcher:
    """Finds all runs of a growing text of word numbers.

    ``append`` takes further words and returns the ``(start, period)`` of runs that reached the wanted
    exponent by them; ``runs`` are all of these as ``(start, length, period)``.
    """

    def __init__(self, exponent: int = EXPONENT, length: int = LENGTH):
        self.exponent, self.length = exponent, length
        self.n = 0
        self.words = np.zeros(0, np.int64)
        self.sums = np.zeros(1, np.uint64)
        self.levels: list[_Level] = []
        # suffix comparisons that have not failed yet: period, first word and end of the stretch so far
        self.open = np.zeros((3, 0), np.int64)
        self.found: dict[tuple[int, int], int] = {}
        self.starts: dict[int, list[int]] = {}

    @property
    def runs(self) -> list[tuple[int, int, int]]:
        return sorted((s, e - s, p) for (s, p), e in self.found.items() if e - s >= self.length)

    def append(self, words: np.ndarray) -> list[tuple[int, int]]:
        before = self._reported()
        self._grow(np.asarray(words, np.int64))
        self._advance()
        while self.exponent << len(self.levels) <= self.n:
            self.levels.append(_Level.of(1 << len(self.levels), self.exponent))
        for level in self.levels:
            self._catch(level)
        return sorted(self._reported() - before)

    def _reported(self) -> set:
        return {k for k, e in self.found.items() if e - k[0] >= self.length}

    def _grow(self, words: np.ndarray) -> None:
        n = self.n + len(words)
        up, self.down = _POWERS.upto(n + 1)
        if n > len(self.words):
            size = max(n, 2 * len(self.words))
            self.words = np.concatenate([self.words[: self.n], np.zeros(size - self.n, np.int64)])
            self.sums = np.concatenate([self.sums[: self.n + 1], np.zeros(size - self.n, np.uint64)])
        self.words[self.n : n] = words
        values = mixed(words.astype(np.uint64) + np.uint64(1)) * up[self.n : n]
        np.cumsum(values, out=self.sums[self.n + 1 : n + 1])
        self.sums[self.n + 1 : n + 1] += self.sums[self.n]
        self.n = n

    def _hash(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def _advance(self) -> None:
        """Take the open comparisons on over the appended words; those that fail are closed."""
        if not self.open.shape[1]:
            return
        period, start, end = self.open
        end = self._forward(period, end)
        self._merge(period, start, end)
        alive = end == self.n
        self.open = np.array([period[alive], start[alive], end[alive]])

    def _forward(self, period: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on whose word differs from the one ``period`` before, or the end."""
        most = self.n - at
        return at + self._agree(lambda i, k: self._hash(at[i], k) == self._hash(at[i] - period[i], k), most)

    def _backward(self, period: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first place of the stretch before ``at`` whose words all equal those ``period`` further on."""
        most = at - period
        return most - self._agree(lambda i, k: self._hash(at[i] - k, k) == self._hash(at[i] - period[i] - k, k), most)

    @staticmethod
    def _agree(same, most: np.ndarray) -> np.ndarray:
        """Per comparison the greatest length up to ``most`` that agrees: doubled, then halved."""
        low, step = np.zeros_like(most), np.ones_like(most)
        i = np.flatnonzero(most > 0)
        while len(i):
            k = np.minimum(low[i] + step[i], most[i])
            ok = same(i, k)
            low[i[ok]] = k[ok]
            step[i[ok]] *= 2
            i = i[ok & (k < most[i])]
        high = np.minimum(low + step, most + 1)
        i = np.flatnonzero(high - low > 1)
        while len(i):
            k = (low[i] + high[i]) // 2
            ok = same(i, k)
            low[i[ok]] = k[ok]
            high[i[~ok]] = k[~ok]
            i = i[high[i] - low[i] > 1]
        return low

    def _catch(self, level: _Level) -> None:
        """Set the catchers of a level whose block is complete and whose words to compare are there."""
        stop = self.n - level.look
        if level.next_end > stop:
            return
        ends = np.arange(level.next_end, stop + 1, level.block)
        level.next_end = int(ends[-1]) + level.block
        ends = self._uncovered(ends, level)
        some = max(1, PAIRS // level.least)
        for i in range(0, len(ends), some):
            self._compare(ends[i : i + some], level)

    def _uncovered(self, ends: np.ndarray, level: _Level) -> np.ndarray:
        """Less the ends inside a run of a smaller period: there every further period is a multiple of that one."""
        small = [(s, e) for (s, p), e in self.found.items() if p < level.least and p <= level.look and e - s >= level.look]
        if not small or not len(ends):
            return ends
        keep = np.ones(len(ends), bool)
        for s, e in small:
            first = np.searchsorted(ends, s + 2 * level.least - 1) if s else 0
            keep[first : np.searchsorted(ends, e - level.look, side="right")] = False
        return ends[keep]

    def _compare(self, ends: np.ndarray, level: _Level) -> None:
        periods = np.arange(level.least, 2 * level.least)
        back = ends[:, None] - periods[None, :]
        ahead = self._hash(ends, level.look)
        at, which = np.nonzero((self._hash(np.maximum(back, 0), level.look) == ahead[:, None]) & (back >= 0))
        if not len(at):
            return
        period, end = periods[which], ends[at]
        start = self._backward(period, end)
        end = self._forward(period, end)
        self._merge(period, start, end)
        alive = end == self.n
        if alive.any():
            self.open = np.unique(np.concatenate([self.open, np.array([period[alive], start[alive], end[alive]])], axis=1), axis=1)

    def _merge(self, period: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Enter stretches of the wanted exponent under their first word and smallest period."""
        far = np.flatnonzero(end - start >= self.exponent * period)
        for i in far[np.argsort(period[far], kind="stable")].tolist():
            p, s, e = int(period[i]), int(start[i]), int(end[i])
            if self.found.get((s, p)) == e:
                continue
            for s, e in [(s, e)] if self._same(s, p, e) else self._plainly(s, p, e):
                # a run of a multiple of another one's period has its bounds
                if e - s >= self.exponent * p and not any(q < p and p % q == 0 and self.found[s, q] >= e for q in self.starts.get(s, ())):
                    if (s, p) not in self.found:
                        self.starts.setdefault(s, []).append(p)
                    self.found[s, p] = e

    def _same(self, s: int, p: int, e: int) -> bool:
        """Whether the words really have the period, as the hashes say."""
        return bool(np.array_equal(self.words[s + p : e], self.words[s : e - p]))

    def _plainly(self, s: int, p: int, e: int) -> list[tuple[int, int]]:
        """Where unequal words had equal hashes: the stretches of the period, by comparing words."""
        same = np.concatenate([[False], self.words[s + p : e] == self.words[s : e - p], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        return [(s + a, s + p + b) for a, b in turns.tolist()]


def find_runs(words: np.ndarray, exponent: int = EXPONENT, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of ``words`` (numbers), by start, then period."""
    catcher = SquareCatcher(exponent, length)
    for i in range(0, len(words), SLICE_WORDS):
        catcher.append(words[i : i + SLICE_WORDS])
    return catcher.runs


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Words as numbers: equal words get the same one."""
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but for those that stand in a run after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", exponent: int = EXPONENT, length: int = LENGTH, unrolled=None) -> DataFrame:
    """Per row its key, ``n_words``, ``runs`` (array of start, length, period) and ``collapsed`` (the text without repeats).

    Words are the stretches between ASCII white space; null texts have none. Nulls and repeats among the keys are
    kept as they are, an empty table gives an empty result, texts are read whole whatever their length. ``unrolled``
    may be a function of key and words that gives the words to read instead.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            counts, spans, texts = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (t or "").encode().split()
                if unrolled is not None:
                    words = unrolled(k, words)
                found = find_runs(word_numbers(words), exponent, length)
                counts.append(len(words))
                spans.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(collapsed(words, found).decode())
            span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(texts, pa.string())], names=[key, "n_words", "runs", "collapsed"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the contract: in one document of ten (by CRC-32 of its number) the end is made periodic."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    times = -(-(n - a) // len(period))
    return words[:a] + (period * times)[: n - a]


def run_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_runs, the run of greatest exponent, and digests of all runs and of the collapsed text.

    A null doc_id plants nothing; null and empty texts have no run, null columns for the best one and the digests of
    nothing; equal exponents go to the smallest start, then period. Repeated rows give repeated results, an empty
    table none; further columns of ``docs`` are not read.
    """
    found = periodic_runs(fields(docs, doc_id="long", text="string"), unrolled=planted)

    # a / b > c / d for the exact quotients: lengths and periods are word counts, so products fit a long
    def better(best, x):
        ahead = x["length"] * best["period"] > best["length"] * x["period"]
        return F.when(best.isNull() | ahead, x).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed").select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", "lines"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
