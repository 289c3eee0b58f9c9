import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


def check_sequences(rows, limit):
    """Sequences hold whole pieces without gaps; returns how many there are."""
    found = defaultdict(list)
    for sequence, offset, length in rows:
        found[sequence].append((offset, length))
    for parts in found.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(found)


def planned(plan):
    return [(first + i // each, offset + i % each * length, length) for length, _, count, first, each, offset in plan.rows for i in range(count)]


def first_fit(counts, limit):
    rooms = []
    for n in sorted(Counter(counts).elements(), reverse=True):
        i = next((i for i, room in enumerate(rooms) if room >= n), None)
        if i is None:
            rooms.append(limit - n)
        else:
            rooms[i] -= n
    return len(rooms)


def test_ids_are_the_library_s(tokenizer, odd_texts):
    encoder = packing.WordEncoder(packing.tokenizer_path())
    more = [" \x0b\x0c x\x0by\x1cz\x85q　r", "don't WON'T ΣΑΣ Σ ́a é é", "<|endoftext|>foo <|startoftext|> x<|endoftext|>  y", "１２３ 4567 ٣", "İstanbul ß ẞ", "' s' s 's"]
    more += ["".join(map(chr, range(1, 700))), " x".join(map(chr, range(1, 700))), "A'LL we'Re I'M it'S ²½ªº÷×ÀÞµ a\xa0b c\x85d e\xadf", "e\u0301 A\u030a"]
    for t in [t or "" for t in odd_texts] + more:
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_words_beyond_the_cache_count_as_well(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    encoder = packing.WordEncoder(packing.tokenizer_path())
    text = "one two three four five six one two " + "long" * 40
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids and len(encoder.cache) <= 3 >= len(encoder.parts)


def test_plans_hold_every_piece_once():
    rng = random.Random(2)
    for limit in (1, 2, 7, 50, 2048):
        for _ in range(12):
            counts = Counter(rng.randint(1, limit) if rng.random() < 0.5 else rng.randint(1, max(1, limit // 3)) for _ in range(rng.randrange(1, 300)))
            for settings in (((5, 0.2),), ((1000, 0.3), (3, 0.5))):
                plan = packing.plan_packing(counts, limit, settings)
                ranks = defaultdict(list)
                for length, rank, count, *_ in plan.rows:
                    ranks[length] += range(rank, rank + count)
                assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
                assert check_sequences(planned(plan), limit) == plan.sequences


def test_groups_have_equal_cardinality_and_cover_lengths():
    counts = {1000: 7, 900: 1, 800: 12}
    groups = packing.linear_groups(counts, 4)
    assert [sum(n for _, _, n in g) for g in groups] == [5, 5, 5, 5]
    assert [g[0][0] for g in groups] == [1000, 1000, 800, 800]
    got = defaultdict(list)
    for g in groups:
        for length, rank, n in g:
            got[length] += range(rank, rank + n)
    assert got == {n: list(range(c)) for n, c in counts.items()}


def test_configurations_beat_first_fit_where_it_is_wrong():
    # halves and thirds with a little over: pairing by configuration needs fewer sequences
    counts = {1030: 600, 690: 600, 320: 600}
    plan = packing.plan_packing(counts, 2048)
    assert plan.sequences <= 601 < 0.95 * first_fit(counts, 2048) + 60
    mixed = packing.configurations(np.array([6, 5, 4]), np.array([10.0, 10.0, 10.0]), 15)
    assert sum(x for _, x in mixed) == pytest.approx(10.0)


def test_sequences_are_few():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2049, 4000), rng.lognormal(5.5, 1, 9000).astype(int) % 2048 + 1, rng.integers(300, 1500, 5000)):
        counts = Counter(lengths.tolist())
        least = -(-sum(n * c for n, c in counts.items()) // 2048)
        assert packing.plan_packing(counts).sequences <= min(1.02 * least, first_fit(counts, 2048) * 1.005)


def test_digest_matches_the_library(spark, sf, odd_docs, tokenizer):
    for frame in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        want = []
        for r in frame.collect():
            ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
            for k, at in enumerate(range(0, len(ids), 2048)):
                part = ids[at : at + 2048]
                want.append((r["doc_id"], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        got = packing.packing_digest(frame, packing.tokenizer_path()).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter(want)
        used = check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got], 2048)
        assert used <= -(-sum(w[3] for w in want) // 2048) + 1


def test_a_frequent_length_spreads_over_tasks(spark):
    pieces = spark.range(0, 30_000, 1, 40).select("id", F.when(F.col("id") % 3 == 0, 700).otherwise(F.col("id") % 2000 + 1).alias("length"))
    got = packing.pack(pieces)
    rows = got.collect()
    assert len({r["id"] for r in rows}) == 30_000
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048)


def test_sequences_hold_the_ids(spark, odd_docs, tokenizer):
    pieces = packing.token_pieces(odd_docs, packing.tokenizer_path(), limit=64, with_ids=True)
    packed = packing.pack(pieces, 64).collect()
    found = {r["sequence_id"]: r for r in packing.sequences(spark.createDataFrame(packed)).collect()}
    for r in packed:
        whole = found[r["sequence_id"]]
        assert whole["n_tokens"] * 4 == len(whole["ids"]) <= 256
        assert whole["ids"][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]


def test_empty_table_and_wrong_lengths(spark, no_docs):
    assert packing.packing_digest(no_docs, packing.tokenizer_path()).collect() == []
    with pytest.raises(ValueError, match="lengths"):
        packing.pack(spark.createDataFrame([(0,)], "length long"))
