"""Packing of documents into sequences by linear grouping, configurations and best fit.

The lengths of a corpus are whole numbers up to the length of a sequence, so all there is to decide
is decided on their counts (Spark aggregates them; at most one row per length reaches the driver):

1. Large pieces, longest first, are cut into groups of equal cardinality and rounded up to the
   longest length of their group, which leaves few sizes.
2. For these the best mixture of configurations (how many pieces of each size share a sequence) is
   the solution of the fractional cutting-stock problem, found by column generation.
3. Configurations are filled with the actual, not longer, pieces of the groups.
4. What is left over, and the small pieces, go by decreasing length to the fullest sequence that has
   room, all pieces of one length at a time.

The plan names pieces by length and rank among the pieces of that length. Ranks come from counts per
partition and length, so no length, however frequent, is gathered in one task; the plan itself has a
size that depends on the sequence length and the number of groups, not on the corpus.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import bounded_batches, fields
from tickloom.session import staged

#: Tokens of a sequence.
LIMIT = 2048
#: Id put behind every document.
END = 0
#: Numbers of groups of large pieces, each with the part of a sequence beyond which a piece is large. They are tried
#: in this order until a plan needs no more sequences than the tokens fill; the best plan counts.
SETTINGS = ((512, 0.45), (384, 1 / 3), (256, 1 / 4), (96, 1 / 6), (32, 1 / 8))
#: Bounds of a worker's two caches: entries kept, and the longest one that is kept.
CACHE_WORDS = 500_000
CACHE_BYTES = 64

_worker: dict = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words whose characters are printable ones below 256: lower case and splitting are plain for them.
_PLAIN = re.compile("[!-~\xa1-\xff]+").fullmatch
#: The tokenizer file's own pattern, for lower-case words of this kind.
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+").findall


class WordEncoder:
    """Token ids of texts, word by word: this tokenizer drops white space and never joins across it.

    Words are looked up, unknown ones cut into the parts that the tokenizer's model sees, and those looked up before
    the model encodes them. Words with characters beyond 255 or with special strings go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the printable stand-ins of the 256 bytes, as byte-level models spell them
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.spelling = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        self.cache: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if _PLAIN(text) and not any(s in text for s in self.special):
            ids = b"".join([self.parts.get(p) or self._part(p) for p in _PARTS(text.lower())])
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= CACHE_BYTES:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.spelling)
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(spelled)])
        if len(part) <= CACHE_BYTES:
            if len(self.parts) >= CACHE_WORDS:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Ids of the whole text as little-endian 32-bit numbers."""
        words = text.encode().split()
        return b"".join([ids if ids is not None else self._word(w) for w, ids in zip(words, map(self.cache.get, words))])


def _encoder(path: str) -> WordEncoder:
    if path not in _worker:
        _worker.clear()
        _worker[path] = WordEncoder(path)
    return _worker[path]


def token_pieces(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` (and ``ids``, four bytes each) of the pieces of every document.

    A document is its token ids and the end id; longer ones than ``limit`` are cut into pieces of that length. Null
    and empty texts are the end id alone.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([END], "<u4").tobytes()

    def cut(batches):
        encoder = _encoder(path)
        for batch in batches:
            rows, ids = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                data = encoder.ids(t or "") + end
                for piece, at in enumerate(range(0, len(data), 4 * limit)):
                    part = data[at : at + 4 * limit]
                    rows.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    ids.append(part)
            found = np.array(rows, np.int64).reshape(-1, 5)
            columns = [batch.column(0).take(pa.array(found[:, 0])), pa.array(found[:, 1].astype(np.int32)), *[pa.array(found[:, c]) for c in (2, 3, 4)]]
            names = [key, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())] if with_ids else columns, names=[*names, "ids"] if with_ids else names)

    return docs.select(key, text).mapInArrow(cut, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


@dataclass
class Plan:
    """Where the pieces of each length go: ``rows`` of (length, first rank, count, first sequence, pieces a sequence, offset)."""

    limit: int
    sequences: int = 0
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    #: sequences with room, as (first, count) by the room they have, and the rooms in order
    free: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    rooms: list[int] = field(default_factory=list)

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def release(self, first: int, count: int, room: int) -> None:
        if count and room:
            if room not in self.free:
                self.free[room] = []
                insort(self.rooms, room)
            self.free[room].append((first, count))

    def best_fit(self, length: int, rank: int, count: int) -> None:
        """Pieces of one length: each goes to the fullest sequence that has room for it, or a new one."""
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                self.release(self.open(-(-count // (self.limit // length))), -(-count // (self.limit // length)), self.limit)
                continue
            room = self.rooms[at]
            first, have = self.free[room].pop()
            if not self.free[room]:
                del self.free[room], self.rooms[at]
            each = room // length
            full = min(have, count // each)
            if full:
                self.rows.append((length, rank, full * each, first, each, self.limit - room))
                self.release(first, full, room - each * length)
                rank, count, first, have = rank + full * each, count - full * each, first + full, have - full
            if have and count:
                self.rows.append((length, rank, count, first, count, self.limit - room))
                self.release(first, 1, room - count * length)
                first, have, count = first + 1, have - 1, 0
            self.release(first, have, room)


def linear_groups(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Lengths, longest first, cut into groups of equal cardinality: per group ``[length, first rank, count]``."""
    total = sum(counts.values())
    size = -(-total // groups) if total else 1
    out, room = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if not room:
                out.append([])
                room = size
            n = min(left, room)
            out[-1].append([length, rank, n])
            rank, left, room = rank + n, left - n, room - n
    return out


def best_pattern(sizes: np.ndarray, worth: np.ndarray, limit: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest worth that fits, and its worth; a piece of a size may repeat."""
    value, chosen = np.zeros(limit + 1), []
    for _ in range(limit // int(sizes.min())):
        with_one = np.full((len(sizes), limit + 1), -1.0)
        for i, s in enumerate(sizes):
            with_one[i, s:] = value[: limit + 1 - s] + worth[i]
        pick = with_one.argmax(axis=0)
        top = with_one[pick, np.arange(limit + 1)]
        better = top > value + 1e-12
        chosen.append(np.where(better, pick, -1))
        value = np.where(better, top, value)
        if not better.any():
            break
    pattern, room = np.zeros(len(sizes), np.int64), limit
    for step in reversed(chosen):
        if step[room] >= 0:
            pattern[step[room]] += 1
            room -= int(sizes[step[room]])
    return float(value[limit]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, limit: int) -> list[tuple[np.ndarray, float]]:
    """The fractional optimum: configurations with the number of sequences that take them.

    Simplex steps over a basis of one configuration per size; the next column is the one of greatest worth at
    the present prices. Every step keeps a solution, so stopping after a bounded number of them costs quality only.
    """
    k = len(sizes)
    if not k:
        return []
    basis = np.diag(limit // sizes).astype(float)
    amount = demand / np.diag(basis)
    for _ in range(60 * k):
        prices = np.linalg.solve(basis.T, np.ones(k))
        worth, pattern = best_pattern(sizes, np.maximum(prices, 0), limit)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.full(k, np.inf)
        ratio[step > 1e-9] = amount[step > 1e-9] / step[step > 1e-9]
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        amount = np.maximum(amount - ratio[leaves] * step, 0)
        amount[leaves] = ratio[leaves]
        basis[:, leaves] = pattern
    return [(basis[:, i].astype(np.int64), float(amount[i])) for i in range(k)]


def plan_packing(counts: dict[int, int], limit: int = LIMIT, settings: tuple[tuple[int, float], ...] = SETTINGS) -> Plan:
    """Sequences for ``counts`` pieces of each length from 1 to ``limit``, as few as one of the settings gives."""
    least, best = -(-sum(n * c for n, c in counts.items()) // limit), None
    for groups, large in settings:
        plan = grouped_plan(counts, limit, groups, large)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == least:
            break
    return best


def grouped_plan(counts: dict[int, int], limit: int, groups: int, large: float) -> Plan:
    """The linear grouping scheme for one number of groups and one bound of large pieces."""
    plan = Plan(limit)
    full = counts.get(limit, 0)
    if full:
        plan.rows.append((limit, 0, full, plan.open(full), 1, 0))
    big = {n: c for n, c in counts.items() if large * limit < n < limit and c}
    stock: dict[int, list[list[int]]] = {}
    for group in linear_groups(big, groups):
        stock.setdefault(group[0][0], []).extend(group)
    sizes = np.array(list(stock), np.int64)
    demand = np.array([sum(n for _, _, n in stock[s]) for s in stock], float)
    for pattern, amount in sorted(configurations(sizes, demand, limit), key=lambda c: -float(c[0] @ sizes)):
        times = int(amount + 1e-9)
        spans = [(plan.open(times), times, 0)] if times else []
        for i in np.flatnonzero(pattern).tolist():
            for _ in range(int(pattern[i])):
                spans = _place(plan, spans, stock[int(sizes[i])])
        for first, count, used in spans:
            plan.release(first, count, limit - used)
    rest = [part for parts in stock.values() for part in parts]
    rest += [[n, 0, c] for n, c in counts.items() if n <= large * limit and c]
    for length, rank, count in sorted(rest, key=lambda part: (-part[0], part[1])):
        plan.best_fit(length, rank, count)
    return plan


def _place(plan: Plan, spans: list[tuple[int, int, int]], parts: list[list[int]]) -> list[tuple[int, int, int]]:
    """One actual piece of a group for each sequence of ``spans`` (first, count, tokens used) as long as there are any."""
    out = []
    for first, count, used in spans:
        while count and parts:
            length, rank, have = parts[0]
            n = min(count, have)
            plan.rows.append((length, rank, n, first, 1, used))
            out.append((first, n, used + length))
            first, count = first + n, count - n
            if n == have:
                parts.pop(0)
            else:
                parts[0] = [length, rank + n, have - n]
        if count:
            out.append((first, count, used))
    return out


def pack(pieces: DataFrame, limit: int = LIMIT, settings: tuple[tuple[int, float], ...] = SETTINGS) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``limit``) with ``sequence_id`` and ``offset``, in as few sequences as the method can.

    Pieces of equal length are interchangeable; repeated rows are pieces of their own; an empty table stays empty.
    """
    names = pieces.columns
    held = staged(_ranked(pieces), "packing-pieces")
    # one row per partition and length; a frequent length has at most one row per partition in its window
    parts = held.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(parts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))), "packing-starts")
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if not counts:
        return pieces.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long"))
    if min(counts) < 1 or max(counts) > limit:
        raise ValueError(f"lengths must be from 1 to {limit}")
    plan = plan_packing(counts, limit, settings)
    # its size is bounded by lengths and groups; rank and length fit one sort key
    rows = np.array(sorted(plan.rows), np.int64)
    shared = pieces.sparkSession.sparkContext.broadcast((rows, (rows[:, 0] << 48) + rows[:, 1]))
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}

    def assign(batches):
        table, keys = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("_nth").to_numpy() + batch.column("_start").to_numpy()
            of = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            turn, place = np.divmod(rank - of[:, 1], of[:, 4])
            columns = [batch.column(c) for c in names] + [pa.array(of[:, 3] + turn), pa.array(of[:, 5] + place * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    joined = held.join(starts.drop("_n"), ["_part", "length"])
    return joined.mapInArrow(assign, ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + ", sequence_id long, offset long")


def _ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the partition they stand in and their rank among its pieces of the same length."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def number(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            nth = []
            for n in batch.column("length").to_pylist():
                nth.append(seen.get(n, 0))
                seen[n] = nth[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64())], names=[*batch.schema.names, "_nth"])

    return pieces.mapInArrow(number, kinds + ", _nth long").withColumn("_part", F.spark_partition_id())


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids`` of packed pieces that carry their ``ids``: the sequences themselves."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(ordered, lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def packing_digest(docs: DataFrame, path: str) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one token; null and repeated ids are documents like others; texts are
    encoded whole, whatever their length; an empty table gives an empty result; further columns are not read.
    """
    return pack(token_pieces(fields(docs, doc_id="long", text="string"), path))
