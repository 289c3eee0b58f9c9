import random

from tickloom.llm import decontam


def greedy(item, doc, least=5):
    least = max(1, min(least, len(item)))
    iu, du, out = [0] * len(item), [0] * len(doc), []
    while True:
        best, places = 0, []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not iu[i + n] and not du[j + n]:
                    n += 1
                if n > best:
                    best, places = n, []
                if n == best and n:
                    places.append((i, j))
        if best < least:
            return out
        for i, j in places:
            if not any(iu[i : i + best]) and not any(du[j : j + best]):
                out.append((i, j, best))
                iu[i : i + best] = du[j : j + best] = [1] * best


def test_tiles_match_plain_version():
    rng = random.Random(2)
    for _ in range(200):
        letters = "abc" if rng.random() < 0.5 else "abcdefgh"
        item, doc = ([rng.choice(letters) for _ in range(rng.randint(1, 20))] for _ in range(2))
        assert decontam.tile(item, doc, 3) == greedy(item, doc, 3)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_reordered_passage_is_caught(spark, odd_docs, no_docs, monkeypatch):
    a, b = "the first half of this item stands here", "while its second half is found over there"
    docs = spark.createDataFrame([(1, f"Intro words. {b.upper()}! some filler {a}, end"), (2, "nothing of the kind is in this one at all"), (3, "seven"), (4, None), (5, "only four words match: the first half of")], "doc_id long, text string")
    bench = items(spark, [(10, f"{a} {b}"), (11, "seven"), (12, ""), (13, None)])
    monkeypatch.setattr(decontam, "MOST_BITS", 64)
    rows = {(r["doc_id"], r["item_id"]): r for r in decontam.leak_digest(docs, bench).collect()}
    assert set(rows) == {(1, 10), (3, 11)}
    assert rows[1, 10]["covered"] == rows[1, 10]["item_tokens"] == 16 and rows[1, 10]["n_tiles"] == 2
    assert {r["doc_id"] for r in decontam.without_leaks(docs, bench).collect()} == {2, 4, 5}
    assert decontam.leak_digest(docs, items(spark, [])).count() == 0
    assert decontam.leak_digest(no_docs, bench).count() == 0
    assert decontam.without_leaks(odd_docs, bench).columns == odd_docs.columns


def test_matches_plain_version_on_the_tables(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = set()
    pool = [(r["item_id"], decontam.tokens(r["text"])) for r in bench.collect()]
    for d in docs.collect():
        words = decontam.tokens(d["text"])
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for k, item in pool:
            if any(tuple(item[i : i + 5]) in grams for i in range(len(item) - 4)):
                covered = sum(n for _, _, n in greedy(item, words))
                if covered >= decontam.COVERAGE * len(item):
                    want.add((d["doc_id"], k, covered))
    assert {(r["doc_id"], r["item_id"], r["covered"]) for r in decontam.leak_digest(docs, bench).collect()} == want and want


def test_repeated_words_take_little_time():
    import time

    begin = time.perf_counter()
    assert decontam.tile(["a"] * 2000, ["a"] * 20_000) == [(0, 0, 2000)]
    found = decontam.tile(["a", "b"] * 1000, ["b", "a"] * 10_000)
    assert found == [(0, 1, 2000)]
    found = decontam.tile(["a"] * 2000, (["a"] * 150 + ["x"]) * 130)
    assert sum(n for _, _, n in found) == 2000 and [n for _, _, n in found][:13] == [150] * 13
    assert time.perf_counter() - begin < 4


def test_large_benchmark_stays_in_tables(spark, monkeypatch):
    """50,000 items: none passes through the driver, documents are scanned once, and repeated rows and items stay."""
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    # every item has words of its own, but for a header that all of them share
    word = lambda i, k: F.concat(F.lit("w"), (i * 97 + k * 31 + k * k).cast("string"))
    body = lambda i: F.concat_ws(" ", *[word(i, k) for k in range(12)])
    header = "choose the one right answer below"
    bench = spark.range(50_000).select(F.col("id").alias("item_id"), F.concat_ws(" ", F.lit(header), body(F.col("id"))).alias("text"))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.concat_ws(" ", F.lit(header), F.lit("filler"), body(F.col("id") * 7 + 40_000))).otherwise(F.concat_ws(" ", F.lit("much like this:"), F.lit(header))).alias("text"))
    docs = docs.union(docs.where("doc_id = 8"))
    looked = []
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **k: looked.append(1))
    got = sorted((r["doc_id"], r["item_id"], r["covered"]) for r in decontam.leak_digest(docs, bench).collect())
    assert not looked and got == sorted([(i, i * 7 + 40_000, 18) for i in range(0, 400, 4)] + [(8, 40_056, 18)])


def test_shared_phrase_pairs_nothing(spark, tmp_path):
    """A phrase of all items that many texts hold finds no item, but it counts in the tiles of those found otherwise."""
    header = "choose the one right answer below"
    bench = items(spark, [(i, f"{header} " + " ".join(f"q{i}x{k}" for k in range(10))) for i in range(60)])
    docs = spark.createDataFrame([(i, f"{header} and nothing else but {i}") for i in range(300)] + [(900, bench.first()["text"])], "doc_id long, text string")
    rows = bench.withColumnRenamed("item_id", "item")
    seeds = decontam.item_seeds(rows).persist()
    hits = decontam.seen_seeds(docs, [], "text", decontam.seed_filter(seeds), [5]).selectExpr("content", "inline(seen)").join(seeds.select("seed", "check").distinct(), ["seed", "check"], "left_semi")
    shared = decontam.shared_seeds(hits, decontam.needed_seeds(seeds, hits, 0.5)).select("content", "item").distinct().count()
    seeds.unpersist()
    assert hits.select("content").distinct().count() == 301 and shared == 1
    assert [(r["doc_id"], r["item_id"], r["covered"]) for r in decontam.leak_digest(docs, bench).collect()] == [(900, 0, 16)]


def test_reconstructed_words_give_the_same_tiles(spark):
    """Random texts of few words: tables against the plain version, with short, repeated and null items."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    pool = [(i, text(rng.choice([1, 3, 5, 9, 20, 40]))) for i in range(40)] + [(3, None), (50, ""), (7, "a b c d a")]
    docs = [(i if i % 9 else None, text(rng.choice([0, 2, 6, 30, 80]))) for i in range(60)] + [(70, None)]
    want = []
    for d, t in docs:
        for k, i in pool:
            item = decontam.tokens(i)
            covered = sum(n for _, _, n in greedy(item, decontam.tokens(t))) if item else 0
            if item and covered >= 0.5 * len(item):
                want.append((d, k, covered))
    got = decontam.leak_digest(spark.createDataFrame(docs, "doc_id long, text string"), items(spark, pool)).collect()
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["item_id"], r["covered"]) for r in got), key=order) == sorted(want, key=order)
