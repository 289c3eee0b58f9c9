"""Exact removal of byte strings that occur more than once anywhere in the corpus.

A suffix array of the whole corpus does not fit in any task, so the windows of ``LENGTH`` bytes are dealt
out by their content. The key of a window is the smallest hash among its strings of ``GRAM`` bytes:
equal windows have equal keys, and neighbouring windows mostly share one, so a text falls into segments,
runs of windows with one key. Only keys that occur twice can hold a repeat; all other text is out of the
game at once.

* A segment that occurs twice as a whole is repeated in full; that takes counting only.
* Where different segments share a key, their bytes are brought together by key and a suffix array over
  them, made by two-stage sorting (``suffixes``), finds the windows they have in common.
* A key that gathers more than ``HOT_BYTES`` is dealt out once more, by the content of each window, so
  that no key is ever one task's alone.

The removed ranges go back to the texts, and what is left of a text is hashed or returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import BASE_A, BASE_B, Powers, Rolling, bounded_batches, fields, group_bounds, sorted_groups
from tickloom.llm.suffixes import repeated_starts
from tickloom.session import staged

LENGTH = 200
GRAM = 40
#: Windows of a segment; longer runs (in periodic text) are cut.
RUN = 256
#: Bytes of text hashed at a time, of pieces in one suffix array, and of one key before it is dealt out anew.
HASH_BYTES = 1 << 20
SORT_BYTES = 1 << 20
HOT_BYTES = 4 << 20

_powers = (Powers(BASE_A), Powers(BASE_B))


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values, from minima running through blocks in both directions."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // size)
    padded = np.full(blocks * size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, size)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[size - 1 : size - 1 + n])


def segments(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """``start, windows, key, digest, again`` of a text's segments; a text shorter than ``LENGTH`` has none.

    ``again`` tells that a segment holds its key's string at two places, so it may repeat itself.
    """
    found: list[tuple[np.ndarray, ...]] = []
    n = len(data) - LENGTH + 1
    for at in range(0, max(n, 0), HASH_BYTES):
        part = data[at : min(at + HASH_BYTES, n) + LENGTH - 1]
        a = Rolling(part, _powers[0])
        grams = np.arange(len(part) - GRAM + 1)
        hashes = a.of(grams, grams + GRAM)
        key = window_minima(hashes, LENGTH - GRAM + 1)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.append(first, len(key)))
        extra = (length - 1) // RUN  # cuts inside long runs
        if extra.any():
            own = np.repeat(np.arange(len(first)), extra + 1)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
            length = np.minimum(length[own] - nth * RUN, RUN)
            first = first[own] + nth * RUN
        digest = Rolling(part, _powers[1]).of(first, first + length + LENGTH - 1)
        inside = length + LENGTH - GRAM  # places of the key's string in each segment
        ends = np.cumsum(inside)
        place = np.arange(ends[-1]) + np.repeat(first - ends + inside, inside)
        again = np.add.reduceat(hashes[place] == np.repeat(key[first], inside), ends - inside, dtype=np.int32) > 1
        found.append((first + at, length, key[first], digest, again))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


_SEGMENT = pa.struct([("start", pa.int32()), ("windows", pa.int32()), ("m", pa.int64()), ("h", pa.int64()), ("again", pa.bool_())])


def _segment_table(docs: DataFrame) -> DataFrame:
    """Per row: row_id, doc_id, content (digest of the text), n_bytes, sha, segs."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.unhex(F.md5("text")).alias("content"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), "text"
    )

    def cut(batches):
        for batch in batches:
            lists, sizes = [], []
            for t in batch.column(5).to_pylist():
                s = segments(np.frombuffer(t.encode(), np.uint8))
                sizes.append(len(s[0]))
                lists.append(s)
            start, windows, m, h, again = (np.concatenate(x) for x in zip(*lists or [segments(np.zeros(0, np.uint8))], strict=True))
            inner = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(m.view(np.int64)), pa.array(h.view(np.int64)), pa.array(again)], fields=list(_SEGMENT))
            segs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), inner)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], segs], names=[*batch.schema.names[:5], "segs"])

    return rows.mapInArrow(cut, "row_id long, doc_id long, content binary, n_bytes long, sha string, segs array<struct<start:int, windows:int, m:long, h:long, again:boolean>>")


def _runs(hit: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return edges[::2].tolist(), edges[1::2].tolist()


_FLAGS = "m long, h long, lo array<int>, hi array<int>"
_FLAGS_ARROW = pa.schema([("m", pa.int64()), ("h", pa.int64()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))])


def _sort_pieces(batches):
    """Suffix arrays over whole keys, as many at a time as make up ``SORT_BYTES``."""

    def flush(held):
        out: dict[str, list] = {"m": [], "h": [], "lo": [], "hi": []}
        for (m, h, _), hit in zip(held, repeated_starts([d for _, _, d in held], LENGTH), strict=True):
            if hit.any():
                lo, hi = _runs(hit)
                for name, value in zip(out, (m, h, lo, hi), strict=True):
                    out[name].append(value)
        return pa.RecordBatch.from_pydict(out, schema=_FLAGS_ARROW)

    held, size = [], 0
    for table in sorted_groups(batches, ["m"]):
        bounds = group_bounds(table, ["m"])
        rows = list(zip(*(table.column(c).to_pylist() for c in ("m", "h", "data")), strict=True))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            held += rows[a:b]
            size += sum(len(r[2]) for r in rows[a:b])
            if size >= SORT_BYTES:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def _hot_windows(batches):
    """Every window of the pieces by two independent hashes of its content."""
    for batch in batches:
        for m, h, d in zip(*(batch.column(c).to_pylist() for c in ("m", "h", "data")), strict=True):
            data = np.frombuffer(d, np.uint8)
            at = np.arange(len(data) - LENGTH + 1)
            a, b = (Rolling(data, p).of(at, at + LENGTH).view(np.int64) for p in _powers)
            yield pa.RecordBatch.from_pydict({"m": np.full(len(at), m), "h": np.full(len(at), h), "at": at.astype(np.int32), "a": a, "b": b})


def _merge_offsets(batches):
    for batch in batches:
        out: dict[str, list] = {"m": batch.column(0).to_pylist(), "h": batch.column(1).to_pylist(), "lo": [], "hi": []}
        for offsets in batch.column(2).to_pylist():
            hit = np.zeros(max(offsets) + 1, bool)
            hit[offsets] = True
            lo, hi = _runs(hit)
            out["lo"].append(lo)
            out["hi"].append(hi)
        yield pa.RecordBatch.from_pydict(out, schema=_FLAGS_ARROW)


def _shared_windows(pieces: DataFrame, hot_bytes: int) -> DataFrame:
    """Per segment (m, h) the runs ``lo, hi`` of its windows that other segments of the same key hold too."""
    weights = pieces.groupBy("m").agg(F.sum(F.length("data")).alias("weight")).where(F.col("weight") > hot_bytes).select("m")
    hot_keys = staged(weights, "hotkeys")
    usual = pieces.join(hot_keys, "m", "left_anti").select("m", "h", "data").repartition("m").sortWithinPartitions("m").mapInArrow(_sort_pieces, _FLAGS)
    if hot_keys.isEmpty():
        return usual
    windows = pieces.join(hot_keys, "m", "left_semi").select("m", "h", "data").mapInArrow(_hot_windows, "m long, h long, at int, a long, b long")
    windows = staged(windows, "hotwindows")
    twice = windows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    offsets = windows.join(twice, ["a", "b"], "left_semi").groupBy("m", "h").agg(F.collect_list("at").alias("offsets"))
    return usual.unionByName(offsets.mapInArrow(_merge_offsets, _FLAGS))


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in sorted((r["lo"], r["hi"]) for r in ranges):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return [(a, b) for a, b in out]


def repeated_ranges(docs: DataFrame, hot_bytes: int = HOT_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, ranges, texts)`` for ``docs`` with columns doc_id, text (no nulls).

    ``rows`` has one row per input row: row_id (of the text's first copy), doc_id, n_bytes, sha, copies.
    ``ranges`` has, for texts that occur once, row_id and the byte ranges to remove (not yet merged).
    ``texts`` has row_id and text for every row id in ``ranges``.
    """
    bounded_batches(docs.sparkSession)
    base = staged(_segment_table(docs), "segments")
    firsts = staged(base.groupBy("content").agg(F.min(F.struct("row_id", "doc_id")).alias("f"), F.count("*").alias("copies")).select("content", "f.row_id", "f.doc_id", "copies"), "contents")
    exploded = base.select("row_id", F.inline("segs"))
    keys = exploded.groupBy("m").agg(F.count("*").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.max("again").alias("again"))
    keys = keys.where("n > 1 or again").select("m", (F.col("again") | (F.col("h0") != F.col("h1"))).alias("several"))
    shared = staged(exploded.drop("again").join(staged(keys, "keys"), "m"), "shared")

    kinds = shared.groupBy("m", "h").agg(F.count("*").alias("n"), F.min(F.struct("row_id", "start", "windows")).alias("at"), F.max("several").alias("several"))
    kinds = staged(kinds.select("m", "h", "n", "several", "at.*"), "kinds")
    # bytes are needed only where a key has different segments and one of them occurs once
    unsure = kinds.where("several").groupBy("m").agg(F.min("n").alias("least")).where("least = 1").select("m")
    wanted = kinds.join(unsure, "m", "left_semi").groupBy("row_id").agg(F.collect_list(F.struct("m", "h", "start", "windows")).alias("wanted"))
    # texts of the first copies of all documents that hold a shared key; those that occur once are needed again
    some = shared.select("row_id").distinct().join(wanted, "row_id", "left").join(firsts, "row_id")
    some = some.select(F.col("row_id"), "content", F.col("doc_id").alias("first_id"), "copies", "wanted").where(F.col("wanted").isNotNull() | (F.col("copies") == 1))
    full = docs.select("doc_id", F.unhex(F.md5("text")).alias("content"), "text")
    met = full.join(some, (full["content"] == some["content"]) & full["doc_id"].eqNullSafe(some["first_id"])).select("row_id", "text", "copies", "wanted")
    texts = staged(met, "texts")

    def fetch(batches):
        for batch in batches:
            out: dict[str, list] = {"m": [], "h": [], "data": []}
            for t, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = t.encode()
                for w in wants:
                    out["m"].append(w["m"])
                    out["h"].append(w["h"])
                    out["data"].append(b[w["start"] : w["start"] + w["windows"] - 1 + LENGTH])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("m", pa.int64()), ("h", pa.int64()), ("data", pa.binary())]))

    pieces = texts.where(F.col("wanted").isNotNull()).select("text", "wanted").mapInArrow(fetch, "m long, h long, data binary")
    found = _shared_windows(staged(pieces, "pieces"), hot_bytes)
    once = kinds.where("n = 1").join(found, ["m", "h"]).select("m", "h", "lo", "hi")
    whole = kinds.where("n > 1").select("m", "h", F.array(F.lit(0)).alias("lo"), F.array("windows").alias("hi"))
    flags = staged(once.unionByName(whole), "flags")
    single = firsts.where("copies = 1").select("row_id")
    hits = shared.join(flags, ["m", "h"]).select("row_id", "start", F.explode(F.arrays_zip("lo", "hi")).alias("r"))
    ranges = hits.select("row_id", F.struct((F.col("start") + F.col("r.lo")).alias("lo"), (F.col("start") + F.col("r.hi") - 1 + LENGTH).alias("hi")).alias("range"))
    ranges = ranges.groupBy("row_id").agg(F.collect_list("range").alias("ranges")).join(single, "row_id", "left_semi")
    rows = base.select("doc_id", "content", "n_bytes", "sha").join(firsts.select("content", "row_id", "copies"), "content").drop("content")
    return rows, ranges, texts.where("copies = 1").select("row_id", "text")


def repeat_digest(docs: DataFrame, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts count as empty. A text that occurs twice, in whichever rows, is removed whole if it has
    ``LENGTH`` bytes; repeated rows and ids are thus copies of each other. An empty table gives an empty
    result; other columns are ignored.
    """
    docs = fields(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, ranges, texts = repeated_ranges(docs, hot_bytes)

    def cut(batches):
        for batch in batches:
            out: dict[str, list] = {"row_id": batch.column(0).to_pylist(), "n_removed": [], "n_spans": [], "kept": []}
            for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                b, spans = t.encode(), _merged(r)
                digest, done = hashlib.sha256(), 0
                for lo, hi in spans:
                    digest.update(b[done:lo])
                    done = hi
                digest.update(b[done:])
                out["n_removed"].append(sum(hi - lo for lo, hi in spans))
                out["n_spans"].append(len(spans))
                out["kept"].append(digest.hexdigest())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("row_id", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string())]))

    part = texts.join(ranges, "row_id").select("row_id", "text", "ranges").mapInArrow(cut, "row_id long, n_removed long, n_spans long, kept string")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return rows.join(part, "row_id", "left").select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, removed``: byte ranges to cut from each text that occurs once; texts that occur twice go whole."""
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows, ranges, _ = repeated_ranges(docs)
    return rows.join(ranges, "row_id", "left").select("doc_id", F.when(F.col("copies") > 1, F.array(F.struct(F.lit(0).alias("lo"), F.col("n_bytes").cast("int").alias("hi")))).otherwise(F.col("ranges")).alias("removed"))
