import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import repeats, suffixes


def plain(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        hit = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                hit[i : i + 200] = b"\1" * 200
        spans = sum(1 for i in range(len(b)) if hit[i] and not (i and hit[i - 1]))
        out.append((len(b), sum(hit), spans, hashlib.sha256(bytes(x for x, h in zip(b, hit, strict=True) if not h)).hexdigest()))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=30).map(str.encode), min_size=1, max_size=5), st.integers(2, 10))
def test_suffix_order_and_repeats(pieces, depth):
    data, _ = suffixes.joined(pieces)
    keys = [bytes(data[i : i + depth]).ljust(depth, b"\0") for i in suffixes.suffix_order(data, depth)]
    assert keys == sorted(keys) and len(keys) == len(data)
    seen = Counter(p[i : i + depth] for p in pieces for i in range(len(p) - depth + 1))
    for p, hit in zip(pieces, suffixes.repeated_starts(pieces, depth), strict=True):
        assert hit.tolist() == [seen[p[i : i + depth]] > 1 for i in range(max(0, len(p) - depth + 1))]


def test_equal_windows_have_equal_keys():
    rng = random.Random(1)
    common = bytes(rng.choice(b"abcdef ") for _ in range(600))
    places = []
    for left in (0, 37, 401):
        data = np.frombuffer(bytes(rng.choice(b"xyz ") for _ in range(left)) + common, np.uint8)
        keys = {}
        for start, n, key, *_ in zip(*repeats.segments(data), strict=True):
            keys |= {start + i - left: key for i in range(n)}
        places.append([keys[i] for i in range(400)])
    assert places[0] == places[1] == places[2]


@pytest.mark.parametrize("hot_bytes", [repeats.HOT_BYTES, 300])
def test_matches_plain_version(spark, odd_texts, odd_docs, no_docs, hot_bytes):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(450))
    more = ["".join(rng.choice("ijklmnop ") for _ in range(rng.randint(0, 300))) + passage[rng.randint(0, 200) :] + "".join(rng.choice("qrstuv ") for _ in range(rng.randint(0, 300))) for _ in range(12)]
    docs = spark.createDataFrame([(1000 + i, t, "x") for i, t in enumerate(more)], "doc_id long, text string, kept string").unionByName(odd_docs.select("doc_id", "text", "kept"))
    rows = docs.collect()
    want = Counter((r["doc_id"], *p) for r, p in zip(rows, plain([r["text"] for r in rows]), strict=True))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeat_digest(docs, hot_bytes).collect())
    assert got == want
    assert repeats.repeat_digest(no_docs, hot_bytes).count() == 0
