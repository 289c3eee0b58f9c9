import re
from collections import Counter

from pyspark.sql import functions as F

from tickloom.llm import rules


def plain(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_counts_match_plain_version(odd_docs):
    got = Counter((r["doc_id"], *[r[c] for c in rules.COUNTS], r["base_failed"]) for r in rules.rule_digest(odd_docs).collect())
    want = Counter()
    for r in odd_docs.collect():
        p = plain(r["text"])
        want[(r["doc_id"], *p, p[0] < 10 or 100 * p[4] > 20 * p[0])] += 1
    assert got == want


def test_bad_host_is_rejected_and_small_one_is_not(spark):
    good = "one two three four five six seven eight nine ten eleven"
    rows = [(i, "spam.example", "x" if i < 95 else good) for i in range(100)] + [(200 + i, "fine.example", good) for i in range(100)] + [(400, "tiny.example", "x"), (401, "tiny.example", good), (402, None, good)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r["doc_id"] for r in rules.rule_digest(docs).where("kept").collect()}
    assert kept == set(range(200, 300)) | {401, 402}
    assert {r["doc_id"] for r in rules.keep_good(docs).collect()} == kept


def test_keep_good_leaves_columns_alone(odd_docs, no_docs):
    out = rules.keep_good(odd_docs)
    assert out.columns == odd_docs.columns and out.where(F.col("kept") != "x").count() == 0
    assert rules.keep_good(no_docs).count() == 0 and rules.rule_digest(no_docs).count() == 0


def test_repeated_words_of_one_window():
    assert rules.repeated_words("a b c d e".split()) == 0
    assert rules.repeated_words(["a"] * 6) == 6
