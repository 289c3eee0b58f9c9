import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import pii
from tickloom.llm.tagger import KINDS, LABELS, Tagger

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    good = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and good(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def test_patterns_match_plain_version():
    rng = random.Random(8)
    bits = ["a", "b.c", "@", "@x", ".com", ".", "-", "+", "1", "23", "255", "256", "0001", " ", "(", ")", "4111111111111111", "+1 612 555 7038", "1.2.3.4", "é", "a@b.c", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.pattern_spans(text) == plain(text), text


@pytest.fixture(scope="module")
def tagger(spark, sf):
    return pii.train(spark.read.parquet(f"{sf}/documents.parquet"))


def test_tagger_finds_held_out_variants(tagger):
    rng = random.Random(77)
    hits, misses, wrong, others = 0, 0, 0, 0
    for _ in range(400):
        inner, kind = pii._variant(rng)
        text = "some words stand before " + inner + " and others come behind it"
        (base, added), = pii.all_spans([text], tagger)
        if kind is None:
            others += 1
            wrong += bool(added)
        elif any(s < 24 + len(inner) and e > 24 and k == kind for s, k, e in base + added):
            hits += 1
        else:
            misses += 1
    assert hits > 0.9 * (hits + misses) and wrong < 0.05 * others


def test_gradients_of_the_tagger():
    rng = np.random.default_rng(0)
    net = Tagger(seed=3, embed=4, hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    codes, gold = rng.integers(0, 20, (2, 6)), np.array([[0, 1, 2, 0, 3, 4], [0, 0, 5, 6, 0, 0]])
    _, grads = net._loss(codes, gold)
    for name in ("out", "move", "xf", "hb"):
        at = (1, 2)
        old = net.w[name][at]
        net.w[name][at] = old + 1e-3
        up, _ = net._loss(codes, gold)
        net.w[name][at] = old - 1e-3
        down, _ = net._loss(codes, gold)
        net.w[name][at] = old
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-2 * max(1.0, abs(grads[name][at])), name


def test_best_path_obeys_transitions():
    net = Tagger(seed=1)
    path = net.best_path(np.random.default_rng(0).standard_normal((20, 30, LABELS)).astype(np.float32) * 3)
    for row in path:
        for a, b in zip(row[:-1], row[1:], strict=True):
            assert b == 0 or b % 2 or a in (b, b - 1)


def test_digest_keeps_base_spans(odd_docs, no_docs):
    for r in pii.pii_digest(odd_docs).join(odd_docs.select("doc_id", "text").distinct(), "doc_id").collect():
        base = plain(r["text"] or "")
        line = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[1] == i for x in base) for i in range(4)]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))
    assert pii.pii_digest(odd_docs).count() == odd_docs.count()
    assert pii.pii_digest(no_docs).count() == 0


def test_redaction(spark, tagger, odd_docs):
    docs = spark.createDataFrame([(1, "write to joe@mail.example.com, or 10.0.0.1"), (2, None), (3, "no data in here")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs, tagger).collect()}
    assert got == {1: "write to <EMAIL>, or <IP>", 2: None, 3: "no data in here"}
    assert pii.redact(odd_docs, tagger).columns == odd_docs.columns


def test_spans_across_windows_are_whole(tagger):
    text = "word " * 30 + "joe.doe@mail.example.com" + " word" * 30 + " 4111 1111 1111 1111 " + "7 " * 200
    (base, added), = pii.all_spans([text], tagger)
    assert base == plain(text)
    assert all(0 <= s < e <= len(text) for s, _, e in added)


def test_masked_addresses_are_found_whole(tagger):
    before, after = "some words stand before and more of them go on ", " and others come behind it, none of them of note"
    for inner in [
        "jane.doe [at] linguistics.uni-heidelberg [dot] de", "a.very.long.local.part.of.some.forty.characters [at] mail [dot] org",
        "someone (at) department-of-comparative-linguistics.faculty-of-letters.university (dot) edu", "joe at host dot com",
    ]:
        text = before + inner + after
        (base, added), = pii.all_spans([text], tagger)
        assert not base and added == [(len(before), 0, len(before) + len(inner))], (inner, [text[s:e] for s, _, e in added])


def test_forms_of_masked_addresses():
    texts = {"x jane [dot] doe [at] uni [dot] de y": "jane [dot] doe [at] uni [dot] de", "look at example.com": None, "we met at noon": None, "JOE AT HOST DOT COM": "JOE AT HOST DOT COM", "[at] host [dot] de": None}
    for text, want in texts.items():
        assert [text[a:b] for a, b in pii.masked_addresses(text)] == ([want] if want else []), text


def test_sample_is_as_large_where_anchors_are_rare(spark, monkeypatch):
    monkeypatch.setattr(pii, "TRAIN_DOCS", 5)
    # one row in a hundred can be sampled
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("call "), "id")).otherwise(F.lit("no digits here")).alias("text"))
    assert pii.sample_contexts(docs, "doc_id", "text").count() == 5 * 2


def test_reading_whole_texts_gives_the_same_spans(tagger, spark, sf, odd_docs):
    rng = random.Random(91)
    docs = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("n_chars").limit(40).collect()]
    texts = ["", "no data in here"]
    for i, t in enumerate(docs):
        # every layout of the generators, set between the words of real texts
        words = t.split(" ")[:80]
        for _ in range(3):
            words.insert(rng.randint(0, len(words)), (pii._variant if i % 2 else pii._long_variant)(rng)[0])
        texts.append(" ".join(words))
    near, whole = (pii.all_spans(texts, tagger, whole=w) for w in (False, True))
    assert [b for b, _ in near] == [b for b, _ in whole]
    found = sum(len(a) for _, a in whole)
    same = sum(len(set(a) & set(b)) for (_, a), (_, b) in zip(near, whole, strict=True))
    assert found > 40 and same >= 0.97 * max(found, sum(len(a) for _, a in near))
    read = {r["doc_id"]: r for r in pii.personal_spans(odd_docs, tagger, ["doc_id"], whole=True).collect()}
    assert len(read) == odd_docs.select("doc_id").distinct().count()
