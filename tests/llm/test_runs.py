import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tickloom.llm import runs


def plain_runs(words, exponent=4, length=6):
    """All maximal stretches of each period, kept under their smallest period."""
    found = {}
    n = len(words)
    for p in range(1, n // exponent + 1):
        i = p
        while i < n:
            if words[i] != words[i - p]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - p]:
                j += 1
            s, size = i - p, j - i + p
            if size >= max(length, exponent * p):
                found.setdefault((s, size), p)
            i = j
    return sorted((s, size, p) for (s, size), p in found.items())


def samples():
    rng = random.Random(5)
    for letters in (1, 2, 3, 8):
        for n in (0, 1, 3, 5, 6, 7, 30, 200):
            yield [rng.randrange(letters) for _ in range(n)]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            word = [rng.randrange(3) for _ in range(rng.randrange(1, 12))]
            times = rng.randrange(1, 9)
            parts += (word * times)[: len(word) * times - rng.randrange(len(word))]
        yield parts
    block = ([0] * 40 + [1]) * 9
    yield block * 2 + [2] + block
    thue = [0]
    for _ in range(8):
        thue += [1 - x for x in thue]
    yield thue * 5
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]


@pytest.mark.parametrize("exponent", [2, 3, 4, 5])
def test_all_runs_are_found(exponent):
    for words in samples():
        assert runs.find_runs(np.array(words, np.int64), exponent, 1) == plain_runs(words, exponent, 1), words


def test_slices_make_no_difference_and_runs_are_told_as_they_come():
    rng = random.Random(9)
    for words in list(samples())[::4]:
        whole = runs.find_runs(np.array(words, np.int64))
        for _ in range(2):
            catcher, told, i = runs.SquareCatcher(), [], 0
            while i < len(words):
                k = rng.randrange(1, 9)
                told += catcher.append(np.array(words[i : i + k]))
                i += k
            assert catcher.runs == whole
            assert {(s, p) for s, _, p in whole} == set(told) and len(told) == len(whole)
    catcher = runs.SquareCatcher()
    assert [catcher.append(np.array([w])) for w in [7, 1, 2, 3] + [1, 2, 3] * 3] == [[]] * 12 + [[(1, 3)]]


def test_equal_hashes_of_unequal_words_are_noticed(monkeypatch):
    monkeypatch.setattr(runs.SquareCatcher, "_hash", lambda self, start, length: np.zeros(np.broadcast(start, length).shape, np.uint64))
    for words in list(samples())[:60]:
        assert runs.find_runs(np.array(words, np.int64)) == plain_runs(words)


def test_long_texts_take_little_time():
    import time

    rng = np.random.default_rng(1)
    begin = time.perf_counter()
    assert runs.find_runs(np.zeros(400_000, np.int64)) == [(0, 400_000, 1)]
    block = np.append(np.zeros(1000, np.int64), 1)
    assert (0, 1001 * 300, 1001) in runs.find_runs(np.tile(block, 300))
    assert runs.find_runs(rng.integers(0, 50_000, 300_000)) == []
    assert (0, 250_000, 50_000) in runs.find_runs(np.tile(rng.integers(0, 9, 50_000), 5))
    assert time.perf_counter() - begin < 20


def plain_digest(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, size, p in found for i in range(s + p, s + size)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{size},{p}\n" for s, size, p in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = best[1] * 1000 // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def key(row):
    return tuple((x is not None, x) for x in row)


def test_digest_matches_plain_version(spark, sf, odd_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 6000")
    for frame in (odd_docs, docs):
        want = sorted((plain_digest(r["doc_id"], r["text"]) for r in frame.collect()), key=key)
        assert sorted(map(tuple, runs.run_digest(frame).collect()), key=key) == want
    assert any(r["n_runs"] for r in runs.run_digest(docs).collect())


def test_runs_of_any_table(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in runs.periodic_runs(odd_docs).collect()}
    assert [tuple(x) for x in got[10]["runs"]] == [(0, 300, 5)] and got[10]["collapsed"] == "a b c d e"
    assert got[0]["runs"] == [] and got[0]["collapsed"] == ""
    assert runs.run_digest(no_docs).count() == 0
    long = spark.createDataFrame([(1, "na " * 400_000 + "batman"), (2, "x" * 2_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.run_digest(long).collect()}
    assert (got[1]["start"], got[1]["length"], got[1]["period"]) == (0, 400_000, 1) and got[2]["n_runs"] == 0
