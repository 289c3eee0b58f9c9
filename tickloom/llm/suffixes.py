"""Suffix arrays of byte pieces by two-stage sorting, and the strings that occur more than once."""

from __future__ import annotations

import numpy as np

#: Ends a piece; text bytes are shifted up by one, so it is smaller than all of them.
END = 0


def joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces one after the other, each followed by ``END``, and where each begins."""
    sizes = np.array([len(p) + 1 for p in pieces], np.int64)
    starts = np.cumsum(sizes) - sizes
    # valid UTF-8 never holds the byte 255, so the shift cannot wrap around
    data = np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8) + np.uint8(1)
    return data, starts


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the one behind it; the last one is not."""
    n = len(data)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[-1:] = -1
    # within a run of one byte all suffixes compare as the last of the run does
    places = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(places[::-1])[::-1]] > 0


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in order of their first ``depth`` bytes (at least).

    Only suffixes smaller than their successors are compared with one another. The others are induced:
    buckets of first bytes are scanned upwards, and every suffix met puts the one before it, if that is
    the larger of the two, at the next free place of its own bucket.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    small = np.flatnonzero(smaller_than_next(data))
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[small]).view(f"S{depth}").ravel()
    small = small[np.argsort(keys, kind="stable")]
    bounds = np.searchsorted(data[small], np.arange(257))
    waiting: dict[int, list[np.ndarray]] = {int(data[-1]): [np.array([n - 1])]}
    out = []
    for c in range(256):
        last = np.concatenate(waiting.pop(c)) if c in waiting else np.zeros(0, np.int64)
        bucket = [last]
        while len(last):  # runs of c: each suffix induces the one before it in its own bucket
            last = last[last > 0] - 1
            last = last[data[last] == c]
            bucket.append(last)
        bucket.append(small[bounds[c] : bounds[c + 1]])
        full = np.concatenate(bucket)
        if not len(full):
            continue
        out.append(full)
        before = full[full > 0] - 1
        first = data[before]
        before, first = before[first > c], first[first > c]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts):
            if len(part):
                waiting.setdefault(int(data[part[0]]), []).append(part)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in ``order``, ``depth`` at most."""
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    lcp = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, depth, 8):
        if not len(live):
            break
        a, b = order[live - 1] + at, order[live] + at
        diff = np.ascontiguousarray(words[a]).view(np.uint64).ravel() ^ np.ascontiguousarray(words[b]).view(np.uint64).ravel()
        same = diff == 0
        ends = diff[~same]
        lowest = ends & (~ends + np.uint64(1))
        lcp[live[~same]] = at + (np.log2(lowest.astype(np.float64)) // 8).astype(np.int64)
        live = live[same]
    lcp[live] = depth
    return np.minimum(lcp, depth)


def repeated_starts(pieces: list[bytes], depth: int) -> list[np.ndarray]:
    """For every piece, which of its places begin a string of ``depth`` bytes that the pieces hold again elsewhere."""
    data, starts = joined(pieces)
    sizes = np.array([len(p) for p in pieces])
    counts = np.maximum(sizes - depth + 1, 0)
    valid = np.zeros(len(data) + 1, np.int32)
    np.add.at(valid, starts, 1)
    np.add.at(valid, starts + counts, -1)
    whole = np.cumsum(valid[:-1]) > 0
    order = suffix_order(data, depth)
    order = order[whole[order]]
    long = common_prefixes(data, order, depth) >= depth
    hit = np.zeros(len(data), bool)
    hit[order] = long
    hit[order[:-1]] |= long[1:]
    return [hit[s : s + c] for s, c in zip(starts, counts, strict=True)]
