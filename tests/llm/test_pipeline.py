import random

import corpus_pipeline
import test_decontam
import test_jaccard
import test_pii
import test_rules
from tickloom.llm import decontam


def plain(rows, items):
    """Stage by stage in plain Python: ids that stay, and their texts with pattern spans replaced."""
    good = [r for r in rows if (p := test_rules.plain(r["text"]))[0] >= 10 and 100 * p[4] <= 20 * p[0]]
    first = {d: c for d, c, *_ in test_jaccard.plain(good)}
    single = [r for r in good if first[r["doc_id"]] == r["doc_id"]]
    out = {}
    for r in single:
        words = decontam.tokens(r["text"])
        if not any(sum(n for *_, n in test_decontam.greedy(decontam.tokens(t), words)) >= decontam.COVERAGE * len(decontam.tokens(t)) for _, t in items):
            text, done, parts = r["text"], 0, []
            for s, k, e in test_pii.plain(text):
                if s >= done:
                    parts += [text[done:s], f"<{test_pii.KINDS[k].upper()}>"]
                done = max(done, e)
            out[r["doc_id"]] = "".join([*parts, text[done:]])
    return out


def test_pipeline_matches_plain_version(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(30, 80))) for _ in range(40)]
    items = [(1, " ".join(word() for _ in range(20))), (2, " ".join(word() for _ in range(12)))]
    texts += [texts[3], texts[3], texts[4] + " tail", "short one", "again and again we say so " * 9]
    texts += [f"{texts[7]} {items[0][1]} {texts[8]}", f"{texts[9]} {items[1][1]}", "write to joe@mail.example.com or 10.0.0.1 " + texts[10][::-1], texts[11][::-1] + " +1 (612) 555-7038 and more"]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain([{"doc_id": r[0], "text": r[1]} for r in rows], items)
    assert {r["doc_id"]: r["text"] for r in out} == want
    assert len({r["position"] for r in out}) == len(out) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert len(want) == 42
