import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import language


def test_labels_are_found_again(spark, sf):
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    out = language.staged(language.language_digest(docs, pages), "test")
    assert out.count() == docs.count() + pages.count()
    right = out.where("kind = 'document'").join(docs.select("doc_id", F.col("lang").alias("label")), "doc_id")
    assert right.where("lang = label").count() > 0.95 * docs.count()
    declared = pages.select("page_id", F.regexp_extract("html", '<html lang="(..)"', 1).alias("label"))
    assert out.where("kind = 'page'").join(declared, "page_id").where("lang = label").count() > 0.95 * pages.count()


def test_surroundings_decide_where_the_text_does_not(spark):
    rows = [("the cat and the dog and the house " * 3, "en", "/en", f"h{i % 3}", "d") for i in range(30)] + [("der hund und die katze und das haus " * 3, "de", "/de", "k", "d") for _ in range(30)]
    rows += [("", "de", None, "h0", "d"), ("", None, None, "k", "d"), (None, None, None, None, None), ("42", "en", "/en", "k", "d")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, declared string, suffix string, host string, domain string")
    model = language.fit(df.select("text", F.col("declared").alias("lang")))
    assert model.languages == ["de", "en"]
    got = {r["id"]: r for r in language.identify(df, model, ["id"]).collect()}
    assert len(got) == len(rows)
    assert [got[i]["lang"] for i in (0, 30, 60, 61)] == ["en", "de", "de", "de"]
    assert got[62]["lang"] in ("de", "en") and got[62]["text_lang"] is None
    assert all(0.5 <= r["probability"] <= 1 for r in got.values())


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    pages = spark.createDataFrame([(1, None, None), (2, "not a url", ""), (None, "http://h.example.org/de/x", "<HTML class=a LANG='DE-at'>" + "x" * 9000)], "page_id long, url string, html string")
    out = language.language_digest(odd_docs, pages)
    assert out.count() == odd_docs.count() + 3
    nothing = language.language_digest(no_docs, pages).collect()
    assert len(nothing) == 3 and all(r["lang"] is None for r in nothing)


def test_address_parts(spark):
    urls = ["https://blog.site.example.com/en/7?x#y", "http://u@M.Site.Org:80/de", "http://h.net/eng/", "nothing", None]
    host, domain, suffix = language.address_parts(F.col("url"))
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").select("i", host, domain, suffix).orderBy("i").collect()
    assert [tuple(r)[1:] for r in rows] == [("blog.site.example.com", "example.com", "/en"), ("m.site.org", "site.org", "/de"), ("h.net", "h.net", ".net"), (None, None, None), (None, None, None)]


def test_late_html_element_declares_its_language(spark):
    late = "<!-- " + "licence " * 2000 + "-->\n<html class=a lang='de-AT'><p>hallo"
    pages = spark.createDataFrame([(1, "http://a.example.org/x", late), (2, "http://a.example.org/y", "<html lang=en><p>hello"), (3, "http://a.example.org/z", "x" * 9000)], "page_id long, url string, html string")
    assert {r["page_id"]: r["declared"] for r in language.page_rows(pages).collect()} == {1: "de", 2: "en", 3: None}


def test_markup_goes_as_by_pattern():
    pattern = re.compile(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>")
    rng = random.Random(8)
    parts = ["<", ">", "<!--", "-->", "<script", "</script >", "<STYLE x", "</style>", "<scripts>", "a", " ", "<b c='", "\n", "/", "-", "<script>"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert language.plain_text(text) == pattern.sub(" ", text), text


def test_unclosed_markup_takes_little_time(spark):
    texts = [opener * (1_000_000 // len(opener)) for opener in ("<!-- a ", "<script ", "<style>", "<", "<html ", "<html lang ", "</script ")]
    begin = time.perf_counter()
    for text in texts:
        language.plain_text(text)
    assert time.perf_counter() - begin < 5
    pages = spark.createDataFrame([(i, "http://h.example.org/x", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    docs = spark.createDataFrame([(1, "some words here", "en", "s"), (2, "andere worte", "de", "s")], "doc_id long, text string, lang string, source string")
    begin = time.perf_counter()
    assert language.language_digest(docs, pages).count() == 9
    assert time.perf_counter() - begin < 90


def test_labels_of_any_spelling_and_number(spark):
    codes = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"] + [f"q{a}{b}" for a in "abcde" for b in "abcdef"]
    rows = [(i, f"{c}{c} {c}x{c} {c}yy" * 3, f"{c.upper()}-US" if i % 2 else f" {c}_latn", "s") for i, c in enumerate(codes)]
    rows += [(900, "xx", "english", "s"), (901, "xx", "", "s"), (902, "xx", "e", "s"), (903, "xx", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.fit(docs)
    assert len(codes) > 700 and model.languages == sorted(codes)
    declared = {r["doc_id"]: r["declared"] for r in language.document_rows(docs).collect()}
    assert all(declared[i] == c for i, c in enumerate(codes)) and [declared[i] for i in range(900, 904)] == [None] * 4
    for i in range(0, len(codes), 97):
        told = model.likelihoods(rows[i][1])
        assert model.languages[int(np.argmax(told))] == codes[i]


def plain_results(rows, labelled):
    """Language and probability of every row by plain arithmetic."""
    counts, size = defaultdict(Counter), language.BUCKETS
    for text, label in labelled:
        code = (label or "").lower().replace("_", "-").split("-")[0].strip()
        if re.fullmatch(language.CODE, code) and text:
            counts[code].update(language.trigrams(language.plain_text(text)).tolist())
    langs = sorted(counts)
    told, votes = [], []
    for r in rows:
        n = Counter(language.trigrams(language.plain_text(r["text"])).tolist()) if r["text"] else {}
        logs = [sum(k * float(np.float32(math.log((counts[x][b] + 0.5) / (sum(counts[x].values()) + 0.5 * size)))) for b, k in n.items()) / 3 for x in langs]
        told.append(logs)
        votes.append(max(range(len(langs)), key=lambda i: (logs[i], -i)) if n else None)

    def votes_of(column, value, less):
        c = Counter(v for r, v in zip(rows, votes) if v is not None and value is not None and r[column] == value)
        return [max(c[i] - (i == less), 0) for i in range(len(langs))]

    everything = Counter(v for v in votes if v is not None)
    out = []
    for r, logs, own in zip(rows, told, votes):
        prior = [1 / len(langs)] * len(langs)
        for found, strength in (([max(everything[i] - (i == own), 0) for i in range(len(langs))], 1.0), (votes_of("domain", r["domain"], own), 16.0), (votes_of("host", r["host"], own), 8.0)):
            total = sum(found)
            prior = [(v + strength * p) / (total + strength) for v, p in zip(found, prior)]
        logs = [a + math.log(p) for a, p in zip(logs, prior)]
        for column in ("declared", "suffix"):
            seen = {x[column] for x, v in zip(rows, votes) if v is not None and x[column] is not None}
            if r[column] in seen:
                for i in range(len(langs)):
                    mine = [x[column] for x, v in zip(rows, votes) if v == i and x[column] is not None]
                    logs[i] += math.log((mine.count(r[column]) + 1) / (len(mine) + len(seen) + 1))
        top = max(logs)
        out.append((langs[logs.index(top)], 1 / sum(math.exp(x - top) for x in logs), None if own is None else langs[own]))
    return out


def test_every_row_matches_plain_arithmetic(spark, sf, odd_docs):
    few = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60 AND n_chars < 4000")
    docs = few.select("doc_id", "text", "lang", "source").unionByName(odd_docs.select("doc_id", "text", "lang", "source"))
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(40)
    rows = language.staged(language.document_rows(docs).unionByName(language.page_rows(pages)).withColumn("i", F.monotonically_increasing_id()), "test")
    plain = rows.orderBy("i").collect()
    want = plain_results(plain, [(r["text"], r["lang"]) for r in docs.collect()])
    got = {r["i"]: r for r in language.identify(rows, language.fit(docs), ["i"]).collect()}
    assert len(got) == len(plain) > 90
    for r, (lang, probability, text_lang) in zip(plain, want):
        found = got[r["i"]]
        assert (found["lang"], found["text_lang"]) == (lang, text_lang) and abs(found["probability"] - probability) < 1e-4, r
