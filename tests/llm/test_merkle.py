import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def stated(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text):
    return h(*[stated(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def plain_tree(leaves):
    """Root, and per leaf the (left, right) siblings of every level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            first = at[i] // 8 * 8
            path.append((nodes[first : at[i]], nodes[at[i] + 1 : first + 8]))
            at[i] //= 8
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain_digest(rows):
    def order(x):
        return (x is not None, x)

    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = []
    for lang in langs:
        mine = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (order(r["doc_id"]), leaf_of(r, r["text"])))
        groups.append((mine, *plain_tree([leaf_of(r, r["text"]) for r in mine])))
    root, tops = plain_tree([g[1] for g in groups])
    out = []
    for (mine, sub, paths), top in zip(groups, tops):
        for r, path in zip(mine, paths):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            node, proof = leaf_of(r, text), ""
            for left, right in path + top:
                node, proof = h(*left, node, *right), proof + "".join(left + right)
            out.append((r["doc_id"], leaf_of(r, r["text"]), sub, root, h(proof), node, node == root))
    return out


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5, 6])
def test_places_fill_the_array_and_subtrees_stand_together(levels):
    plan = merkle.Layout(levels, 3)
    places = {(d, i): int(plan.place(d, np.array([i]))[0]) for d in range(levels) for i in range(3**d)}
    assert sorted(places.values()) == list(range((3**levels - 1) // 2))
    top = levels // 2
    assert sorted(v for (d, _), v in places.items() if d < top) == list(range((3**top - 1) // 2))
    for i in range(3**top if levels > 1 else 0):
        inside = sorted(places[d, n] for d in range(top, levels) for n in range(3**d) if n // 3 ** (d - top) == i)
        assert inside == list(range(inside[0], inside[0] + len(inside)))


def test_blocks_prove_their_leaves():
    for n in (1, 2, 7, 8, 9, 64, 65, 300):
        leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(n)]
        above = merkle.levels_above(n, merkle.HEIGHT)
        block = merkle.build_block(leaves, above)
        root, paths = plain_tree([x.hex() for x in leaves])
        assert block[:32].hex() == root
        for i in range(n):
            path = merkle.siblings(block, above, i, n)
            assert [([x.hex() for x in a], [x.hex() for x in b]) for a, b in path] == paths[i]
            assert merkle.fold(leaves[i], path) == block[:32]
            assert merkle.unpack_path(merkle.pack_path(path)) == path


def test_digest_matches_plain_version(spark, sf, odd_docs):
    for frame in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        assert Counter(map(tuple, merkle.manifest_digest(frame).collect())) == Counter(plain_digest(frame.collect()))


def test_trees_of_several_tiers_and_many_languages(spark):
    rows = [(i, "s", f"l{i % 90}" if i % 3 else "hot", i, f"Text {i}") for i in range(400)] + [(None, None, None, None, None), (None, None, None, None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert Counter(map(tuple, merkle.manifest_digest(frame, height=1).collect())) == Counter(plain_digest(frame.collect()))


def test_one_row_empty_table_and_long_text(spark, no_docs):
    one = spark.createDataFrame([(3, "A" * 2_000_000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest_digest(one).collect()
    assert [tuple(r) for r in got] == plain_digest(one.collect()) and got[0]["proof_sha256"] == h()
    assert merkle.manifest_digest(no_docs).collect() == []
