"""Benchmark decontamination by greedy string tiling.

A seed is a window of ``SEED`` tokens of a benchmark item (a shorter item is one seed as a whole). Seeds and
the windows of documents meet in an equi-join on two hashes of their words, so neither table passes through
the driver and documents are read once, whatever the size of the benchmark. Before the join, documents drop
the windows that a bit filter of bounded size shows to be no seed.

Seeds that are frequent in documents need not find an item: those of an item's seeds, most frequent first, whose words
together are less than the wanted coverage are left out of the join, because a document that reaches the
coverage holds another one too. So a phrase that all items and many documents share pairs nothing.

For each joined pair the item's tokens are tiled: the longest common token run that touches no earlier tile
is marked, found by Karp-Rabin hashes of shrinking length, until no run of ``SEED`` tokens is left. Tiles may
come in any order, so reordered passages are covered as well as verbatim ones. A document is contaminated by
an item if tiles cover enough of the item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import BASE_A, BASE_B, Powers, Rolling, bounded_batches, fields, fresh
from tickloom.session import staged

#: Tokens of a seed, and the shortest tile.
SEED = 5
#: Part of an item's tokens that tiles have to cover.
COVERAGE = 0.5
#: Bits of the filter for each seed, and the most bits it has (32 MB); a fuller filter passes more windows on to the join.
SEED_BITS = 32
MOST_BITS = 1 << 28

_TOKEN = re.compile(r"\w+")

#: Base of the hashes of token runs (any odd number does).
_BASE = 0x9E3779B97F4A7C15


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


class Windows:
    """Two hashes of every run of words of a text: equal runs hash alike in all texts."""

    _powers = Powers(BASE_A), Powers(BASE_B)

    def __init__(self, words: list[str]):
        self.n = len(words)
        self.data = np.frombuffer((" ".join(words) + " ").encode(), np.uint8)
        self.ends = np.flatnonzero(self.data == 32)
        self.starts = np.r_[0, self.ends[:-1] + 1]

    def hashes(self, size: int, which: int = 0) -> np.ndarray:
        """Hashes of the runs of ``size`` words, in order of their starts."""
        return Rolling(self.data, self._powers[which]).of(self.starts[: self.n - size + 1], self.ends[size - 1 :])

    def found(self, size: int, bits: np.ndarray | None = None) -> list[tuple[int, int, list[int]]]:
        """``(seed, check, places)`` of the distinct runs of ``size`` words that pass the filter, all without one."""
        if self.n < size:
            return []
        seed = self.hashes(size)
        at = np.arange(len(seed)) if bits is None else np.flatnonzero(passes(bits, seed))
        if not len(at):
            return []
        seed, check = seed[at].view(np.int64), self.hashes(size, 1)[at].view(np.int64)
        order = np.lexsort((at, check, seed))
        seed, check, at = seed[order], check[order], at[order]
        first = np.flatnonzero(np.r_[True, (seed[1:] != seed[:-1]) | (check[1:] != check[:-1])])
        return [(int(seed[a]), int(check[a]), at[a:b].tolist()) for a, b in zip(first, np.r_[first[1:], len(at)], strict=True)]


def passes(bits: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set in the filter."""
    last = np.uint64(len(bits) * 64 - 1)
    good = np.ones(len(seed), bool)
    for p in (seed & last, (seed >> np.uint64(32)) & last):
        good &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return good


def tile(item: list, doc: list, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles ``(place in item, place in doc, length)``: longest first, none touching another on either side.

    Ties go to the first place in the item, then in the document. ``least`` is lowered to the length of a shorter item.
    """
    least = max(1, min(least, len(item)))
    item_used, doc_used = [False] * len(item), [False] * len(doc)

    def places(size: int) -> dict[int, list[int]]:
        """Unmarked runs of the document by hash, in order."""
        at: dict[int, list[int]] = {}
        for j, h in enumerate(_hashes(doc, doc_used, size)):
            if h is not None:
                at.setdefault(h, []).append(j)
        return at

    def shared(size: int) -> bool:
        """Whether some unmarked run of ``size`` words is common: looked up by hash, then compared."""
        at = places(size)
        return any(item[i : i + size] == doc[j : j + size] for i, h in enumerate(_hashes(item, item_used, size)) if h is not None for j in at.get(h, ()))

    def mark(size: int) -> None:
        """Tiles of the greatest common length; places that are marked on the way are passed over for good."""
        at = places(size)
        first = dict.fromkeys(at, 0)
        for i, h in list(enumerate(_hashes(item, item_used, size))):
            # what is marked by now is as long as a run, so it holds one of the run's ends
            if h not in at or item_used[i] or item_used[i + size - 1]:
                continue
            options = at[h]
            for n in range(first[h], len(options)):
                j = options[n]
                if doc_used[j] or doc_used[j + size - 1]:
                    first[h] += n == first[h]
                elif item[i : i + size] == doc[j : j + size]:
                    tiles.append((i, j, size))
                    item_used[i : i + size] = doc_used[j : j + size] = [True] * size
                    break

    tiles, reach = [], min(len(item), len(doc))
    while reach >= least:
        # a common run of some length holds one of every smaller length, so the longest is found by halving
        low, size = least - 1, reach
        while low < size:
            middle = (low + size + 1) // 2
            if shared(middle):
                low = middle
            else:
                size = middle - 1
        if low < least:
            break
        mark(low)
        reach = low - 1
    return tiles


def _hashes(words: list, used: list[bool], size: int) -> Iterator[int | None]:
    """Rolling hash of every run of ``size`` words; None where the run touches a marked word."""
    value, clean, top = 0, 0, pow(_BASE, size, 1 << 61)
    for k, w in enumerate(words):
        value = (value * _BASE + hash(w)) % (1 << 61)
        if k >= size:
            value = (value - hash(words[k - size]) * top) % (1 << 61)
        clean = 0 if used[k] else clean + 1
        if k >= size - 1:
            yield value if clean >= size else None


# --- the tables ----------------------------------------------------------------------------------

_SEEN = "array<struct<seed: bigint, check: bigint, places: array<int>>>"
_SEEN_ARROW = pa.list_(pa.struct([("seed", pa.int64()), ("check", pa.int64()), ("places", pa.list_(pa.int32()))]))


def _told(found: list[tuple[int, int, list[int]]]) -> list[dict]:
    return [{"seed": s, "check": c, "places": p} for s, c, p in found]


def item_seeds(items: DataFrame) -> DataFrame:
    """item, total (tokens), size (tokens of a seed), seed, check, places: one row per item and distinct seed."""

    def cut(batches):
        for batch in batches:
            ids, totals, sizes, seen = [], [], [], []
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(t)
                if words:
                    size = min(SEED, len(words))
                    ids.append(item)
                    totals.append(len(words))
                    sizes.append(size)
                    seen.append(_told(Windows(words).found(size)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(totals, pa.int32()), pa.array(sizes, pa.int32()), pa.array(seen, _SEEN_ARROW)], names=["item", "total", "size", "seen"])

    rows = items.select("item", "text").mapInArrow(cut, f"item long, total int, size int, seen {_SEEN}")
    return rows.select("item", "total", "size", F.inline("seen"))


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """Two bits per seed in a filter of at most ``MOST_BITS`` bits, put together by Spark 64 bits at a time."""
    bits = 64
    while bits < min(MOST_BITS, SEED_BITS * seeds.count()):
        bits *= 2
    places = F.array(F.col("seed").bitwiseAND(bits - 1), F.shiftrightunsigned("seed", 32).bitwiseAND(bits - 1))
    words = seeds.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("mask"))
    told = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[told.column("word").to_numpy()] = told.column("mask").to_numpy().view(np.uint64)
    return out


def seen_seeds(docs: DataFrame, keep: list[str], text: str, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """``keep``, content (digest of the text), seen (seed, check, places): rows with a window that passes the filter."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(bits)
    n = len(keep)

    def find(batches):
        for batch in batches:
            rows, seen = [], []
            for r, t in enumerate(batch.column(n + 1).to_pylist() if sizes else []):
                words = tokens(t)
                if words:
                    windows = Windows(words)
                    found = [x for size in sizes for x in windows.found(size, shipped.value)]
                    if found:
                        rows.append(r)
                        seen.append(_told(found))
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[kept.column(i) for i in range(n + 1)], pa.array(seen, _SEEN_ARROW)], names=[*[f"k{i}" for i in range(n)], "content", "seen"])

    columns = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    digest = F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))).alias("content")
    kinds = "".join(f"k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    return docs.select(*columns, digest, F.col(f"`{text}`").alias("text")).mapInArrow(find, f"{kinds}content binary, seen {_SEEN}")


def needed_seeds(seeds: DataFrame, hits: DataFrame, coverage: float) -> DataFrame:
    """item, seed, check, finds: the seeds that occur in documents, and whether they find their item.

    Of an item's seeds, most frequent first, those do not whose words together stay below the coverage.
    """
    often = hits.groupBy("seed", "check").agg(F.count("*").alias("often"))
    known = seeds.join(often, ["seed", "check"])
    each = known.groupBy("item", "total", "size").agg(F.collect_list(F.struct("often", "seed", "check", "places")).alias("seen"))

    def choose(batches):
        for batch in batches:
            out = {"item": [], "seed": [], "check": [], "finds": []}
            for row in batch.to_pylist():
                inside, need = np.zeros(row["total"], bool), coverage * row["total"]
                for x in sorted(row["seen"], key=lambda x: (-x["often"], x["seed"], x["check"])):
                    new = np.unique(np.add.outer(x["places"], np.arange(row["size"])))
                    new = new[~inside[new]]
                    spare = inside.sum() + len(new) < need
                    if spare:
                        inside[new] = True
                    for name, value in (("item", row["item"]), ("seed", x["seed"]), ("check", x["check"]), ("finds", not spare)):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["item"], pa.int64()), pa.array(out["seed"], pa.int64()), pa.array(out["check"], pa.int64()), pa.array(out["finds"], pa.bool_())], names=list(out))

    return each.mapInArrow(choose, "item long, seed long, check long, finds boolean")


def shared_seeds(hits: DataFrame, needed: DataFrame) -> DataFrame:
    """content, item, seed, check, places: all seeds of an item in a text that holds one that finds it."""
    found = staged(hits.join(needed.where("finds").drop("finds"), ["seed", "check"]).select("content", "item", "seed", "check", "places"), "found")
    pairs = found.select("content", "item").distinct()
    rest = pairs.join(needed.where("NOT finds").drop("finds"), "item").join(hits, ["content", "seed", "check"])
    return found.unionByName(rest.select("content", "item", "seed", "check", "places"))


def _tiles_of(item: list[str], seen: list[dict]) -> list[tuple[int, int, int]]:
    """Tiles of an item in a text of which the shared seeds are given: no other word can be part of a tile."""
    size = min(SEED, len(item))
    at = {(s, c): p[0] for s, c, p in Windows(item).found(size)}
    steps = np.arange(size)
    places = np.concatenate([np.add.outer(x["places"], steps).ravel() for x in seen])
    source = np.concatenate([np.tile(at[x["seed"], x["check"]] + steps, len(x["places"])) for x in seen])
    kept, first = np.unique(places, return_index=True)
    # a gap becomes one foreign word, so that no tile crosses it
    words, origin, last = [], [], -1
    for place, k in zip(kept.tolist(), source[first].tolist(), strict=True):
        if place != last + 1:
            words.append(None)
            origin.append(-1)
        words.append(item[k])
        origin.append(place)
        last = place
    return [(i, origin[j], n) for i, j, n in tile(item, words)]


def _tiled(pairs: DataFrame, coverage: float) -> DataFrame:
    """content, item, covered, item_tokens, coverage, tiles of the pairs (content, item, text, seen) that reach ``coverage``."""
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("length", pa.int32())]))]
    names = ["content", "item", "covered", "item_tokens", "coverage", "tiles"]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words = tokens(row["text"])
                tiles = _tiles_of(words, row["seen"])
                covered = sum(n for _, _, n in tiles)
                if covered >= coverage * len(words):
                    out.append((row["content"], row["item"], covered, len(words), covered / len(words), [{"item_at": a, "doc_at": b, "length": n} for a, b, n in tiles]))
            values = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(values, kinds, strict=True)], names=names)

    return pairs.select("content", "item", "text", "seen").mapInArrow(run, "content binary, item long, covered long, item_tokens long, coverage double, tiles array<struct<item_at: int, doc_at: int, length: int>>")


def _leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str, coverage: float) -> tuple[DataFrame, DataFrame]:
    """``(rows, found)``: rows (k0, k1, ... for ``keep``, content) that may match, and the items that texts really hold."""
    bounded_batches(docs.sparkSession)
    items = staged(benchmark.where(F.col("text").isNotNull()).select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    seeds = staged(item_seeds(items), "seeds")
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())  # at most SEED values
    rows = staged(seen_seeds(docs, keep, text, seed_filter(seeds), sizes), "seen")
    # copies of a text are looked at once
    hits = rows.select("content", "seen").dropDuplicates(["content"]).select("content", F.inline("seen"))
    hits = staged(hits.join(seeds.select("seed", "check").distinct(), ["seed", "check"], "left_semi"), "hits")
    needed = staged(needed_seeds(seeds, hits, coverage), "needed")
    pairs = shared_seeds(hits, needed).groupBy("content", "item").agg(F.collect_list(F.struct("seed", "check", "places")).alias("seen"))
    found = staged(_tiled(pairs.join(items.select("item", "text"), "item"), coverage), "tiled")
    return rows, found.join(items.select("item", "item_id"), "item")


def contaminations(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """``keep``, item_id, covered, item_tokens, coverage, tiles: one row per document and item that reaches ``coverage`` (above 0).

    Tiles list (item_at, doc_at, length) in tokens. Null and empty texts and items match nothing; texts and items
    may be of any length; repeated rows and items give repeated results; an empty table on either side gives an
    empty result.
    """
    rows, found = _leaks(docs, benchmark, keep, text, coverage)
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    return rows.drop("seen").join(found, "content").select(*names, "item_id", "covered", "item_tokens", "coverage", "tiles")


def leak_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document and item that it holds: doc_id, item_id, covered, item_tokens, coverage, n_tiles.

    Null and empty texts and items match nothing; null ids stay null, repeated rows and items give repeated results;
    extra columns are ignored; an empty table on either side gives an empty result.
    """
    docs, benchmark = fields(docs, doc_id="long", text="string"), fields(benchmark, item_id="long", text="string")
    return contaminations(docs, benchmark, ["doc_id"]).select("doc_id", "item_id", "covered", "item_tokens", "coverage", F.size("tiles").cast("long").alias("n_tiles"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns unchanged, whatever they are called.

    Rows with null and empty texts stay, and so does every row if the benchmark is empty.
    """
    _, found = _leaks(docs, fields(benchmark, item_id="long", text="string"), [], text, COVERAGE)
    name = fresh(docs, "_content")
    leaked = staged(found.select(F.col("content").alias(name)).distinct(), "leaked")
    return docs.withColumn(name, F.unhex(F.md5(F.col(f"`{text}`").cast("binary")))).join(leaked, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
