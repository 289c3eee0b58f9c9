import numpy as np

from tickloom.llm import jaccard
from tickloom.llm.graphs import components


def sets_of(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows):
    texts = {}
    for r in rows:
        texts.setdefault(r["text"] if sets_of(r["text"]) else ("blank", id(r)), []).append(r["doc_id"])
    keys = list(texts)
    sets = [sets_of(k) if isinstance(k, str) else frozenset() for k in keys]
    links, root = [0] * len(keys), list(range(len(keys)))
    for _ in range(len(keys)):
        for i in range(len(keys)):
            for j in range(len(keys)):
                common = len(sets[i] & sets[j])
                if i != j and sets[i] and sets[j] and 10 * common >= 8 * (len(sets[i]) + len(sets[j]) - common):
                    root[i] = root[j] = min(root[i], root[j])
    for i in range(len(keys)):
        links[i] = sum(1 for j in range(len(keys)) if i != j and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]))
    out = []
    for i, k in enumerate(keys):
        ids = [d for j in range(len(keys)) if root[j] == root[i] for d in texts[keys[j]] if d is not None]
        out += [(d, min(ids, default=None), links[i], len(texts[k])) for d in texts[k]]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_matches_plain_version(odd_docs, no_docs):
    got = [(r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard.join_digest(odd_docs).collect()]
    assert order(got) == order(plain(odd_docs.collect()))
    assert jaccard.join_digest(no_docs).count() == 0


def test_blocks_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for p in rng.integers(0, 150, rng.integers(0, 7)):
            w[p] = f"v{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "FAMILY_BLOCK", 8)
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 16)
    got = [(r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard.join_digest(docs).collect()]
    assert order(got) == order(plain(docs.collect()))


def test_one_row_of_each_group(odd_docs, no_docs):
    out = jaccard.one_of_each(odd_docs)
    assert out.columns == odd_docs.columns
    classes = {(r[0], r[1]) for r in plain(odd_docs.collect())}
    blank = sum(not sets_of(r["text"]) for r in odd_docs.collect())
    named = {c for d, c in classes if c is not None}
    assert out.count() == len(named) + sum(c is None for d, c in classes) and blank == 3
    assert jaccard.one_of_each(no_docs).count() == 0


def test_components_of_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, i) for i in range(200, 400)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + hub + hub, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {5: 5} | {i: 5 for i in range(200, 400)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard.least_matches()
    assert all(a < b for a, b in zip(least[:-1], least[1:], strict=True))
    rng = np.random.default_rng(0)
    kept = 0
    for _ in range(400):
        same = rng.random(jaccard.HASHES) < 0.8
        a = rng.integers(0, 256, jaccard.HASHES, dtype=np.uint8)
        b = np.where(same, a, a + np.uint8(1)).astype(np.uint8)
        kept += len(jaccard.likely_pairs(a[None], b[None], np.array([100]), np.array([100]), False)[0])
    assert kept == 400


def changed_copies(rng, n, words, most):
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for p in rng.integers(0, words, rng.integers(0, most)):
            w[p] = f"v{rng.integers(1000)}"
        out.append((i, " ".join(w)))
    return out


def test_blocks_by_bytes_lose_no_link(spark, monkeypatch):
    docs = spark.createDataFrame(changed_copies(np.random.default_rng(6), 50, 150, 8), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "FAMILY_BYTES", 4000)
    got = [(r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard.join_digest(docs).collect()]
    assert order(got) == order(plain(docs.collect()))


def test_bounds_and_differences_are_exact():
    """Sets near and far from the first one, as differences and plain, against Python sets."""
    rng = np.random.default_rng(5)
    first = np.unique(rng.integers(0, 400, 90)).astype(np.uint64)
    sets, plain_rows, gone, new = [], [], [], []
    for k in range(60):
        drop = rng.random(len(first)) < rng.choice([0.0, 0.05, 0.1, 0.2, 0.6])
        added = np.unique(rng.integers(400, 430, rng.integers(0, 25))).astype(np.uint64)
        own = np.union1d(first[~drop], added)
        sets.append(set(own.tolist()))
        plain_rows.append(k % 7 == 0)
        gone.append(np.zeros(0, np.uint64) if plain_rows[-1] else first[drop])
        new.append(own if plain_rows[-1] else added)
    i, j = np.nonzero(np.arange(60)[:, None] < np.arange(60)[None, :])
    good = jaccard.similar_enough(i, j, np.array([len(s) for s in sets]), first, np.array(plain_rows), gone, new)
    want = [10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) for a, b in zip(i, j, strict=True)]
    assert good.tolist() == want and 0 < sum(want) < len(want)


def test_large_family_sends_differences(spark):
    """One family of 5,000 texts: what goes to the blocks is far less than the texts, and links are complete."""
    rows = changed_copies(np.random.default_rng(9), 5000, 400, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = len({t for _, t in rows})
    got = jaccard.join_digest(docs).select("class_id", "n_links").distinct().collect()
    assert [(r["class_id"], r["n_links"]) for r in got] == [(0, texts - 1)]
    first = jaccard.shingles(rows[0][1]).tobytes()
    batch = jaccard.pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "family": [0] * 5000, "text": [t for _, t in rows], "whole": [first] * 5000})
    sent = next(jaccard._differences([batch]))
    bytes_sent = sum(len(x) for c in ("gone", "new") for x in sent.column(c).to_pylist())
    assert not any(sent.column("plain").to_pylist()) and bytes_sent * 8 < 5000 * len(first)
