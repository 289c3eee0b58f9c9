import re

from tickloom.llm import licenses


def plain(text):
    words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hits = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = [
    "Under the MIT License and again under the mit license", "cc by nc cc by nc cc-by-nc", "cc by", "", None, "apache license version 2 apache license version 2.0", "under the mit under the mit license x",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files (the Software), to deal in the Software without restriction",
    "permission is granted to walk on the grass", "KK cc by nc İ",
]


def test_base_columns_match_plain_version(spark, odd_docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(odd_docs.selectExpr("doc_id + 100", "text"))
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.license_digest(docs).collect()), key=key)
    want = sorted(((r["doc_id"], *plain(r["text"])) for r in docs.collect()), key=key)
    assert got == want


def test_changed_notice_is_found_and_clean_text_is_not(spark):
    docs = spark.createDataFrame([(7, TEXTS[7]), (8, TEXTS[8])], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.license_digest(docs).collect()}
    assert rows[7]["labels"] == "mit" and rows[7]["base_labels"] == "" and 0.6 <= rows[7]["score"] < 1
    assert rows[8]["labels"] == "" and rows[8]["score"] == 0
    span = licenses.license_spans(docs, ["doc_id"], licenses.standard_templates()).collect()
    assert [(s["doc_id"], s["first_word"], s["label"]) for s in span] == [(7, 0, "mit")]


def test_empty_table_and_native_plan(no_docs, odd_docs):
    assert licenses.license_digest(no_docs).count() == 0
    plan = licenses.license_digest(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
