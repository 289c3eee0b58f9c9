from collections import defaultdict

import pytest

from tickloom.llm import mixing


def earliest_deadline_first(shares):
    """Slot by slot: the released block with the earliest deadline."""
    frame, done, out = sum(shares.values()), dict.fromkeys(shares, 0), []
    for slot in range(frame):
        ready = [(-(-(n + 1) * frame // shares[s]), n * frame // shares[s], s is not None, s or "") for s, n in done.items() if n * frame < (slot + 1) * shares[s]]
        _, _, _, s = min(ready)
        s = s or (None if None in shares else s)
        out.append(s)
        done[s] += 1
    return out


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 2, "b": 1, "c": 1}, {"a": 7, "b": 3, "c": 2, None: 1}, {"x": 38, "y": 11, "z": 5, "w": 1}])
def test_frame_is_the_schedule_and_lag_is_below_one(spark, shares):
    df = spark.createDataFrame(list(shares.items()), "source string, share long")
    rows = mixing.frame_slots(df).orderBy("slot").collect()
    assert [r["source"] for r in rows] == earliest_deadline_first(shares)
    frame = sum(shares.values())
    done = defaultdict(int)
    for t, r in enumerate(rows, 1):
        assert r["release"] <= r["slot"] < r["deadline"]
        done[r["source"]] += 1
        assert all(abs(frame * done[s] - share * t) < frame for s, share in shares.items())


def test_mixture_keeps_rows_and_places(odd_docs, no_docs):
    out = mixing.mix_by_size(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert len({r["position"] for r in out}) == len(out)
    assert mixing.mix_digest(no_docs).count() == 0
    assert set(odd_docs.columns) <= set(out[0].asDict())


def test_blocks_follow_ids(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(3000)], "doc_id long, source string")
    rows = mixing.mix_digest(docs).collect()
    for s in "ab":
        own = sorted(r["doc_id"] for r in rows if r["source"] == s)
        rank = {d: i for i, d in enumerate(own)}
        assert all(r["block"] == rank[r["doc_id"]] // mixing.BLOCK_ROWS for r in rows if r["source"] == s)
        assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)


def test_too_many_shares(spark):
    with pytest.raises(ValueError):
        mixing.frame_slots(spark.createDataFrame([("a", 5000)], "source string, share long"))


def test_no_python_in_the_plan(odd_docs):
    plan = mixing.mix_digest(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 7, "b": 3, "c": 2, None: 1}, {"x": 38, "y": 11, "z": 5, "w": 1}, {None: 3, "b": 3}, {"hot": 41, "m": 6, "n": 6, None: 1} | {f"s{i}": 1 for i in range(90)}])
def test_long_frames_have_the_same_schedule(spark, shares):
    rows = mixing.long_frame_slots(spark.createDataFrame(list(shares.items()), "source string, share long")).orderBy("slot").collect()
    assert [r["source"] for r in rows] == earliest_deadline_first(shares)
    assert [r["slot"] for r in rows] == list(range(sum(shares.values())))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)


def test_more_sources_than_slots_of_a_short_frame(spark):
    n = mixing.MAX_FRAME + 900
    docs = spark.range(3 * n).selectExpr("id AS doc_id", f"CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % {n} = 1 THEN NULL ELSE concat('s', id % {n}) END AS source")
    rows = mixing.mix_digest(docs).collect()
    assert len(rows) == len({r["position"] for r in rows}) == 3 * n
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
