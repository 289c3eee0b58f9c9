import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickloom.llm import mixing, supertasks


def plain(weights, turns):
    """Source of every slot, by walking the frames slot by slot: earliest deadline first, members in turn."""
    classes = {}
    for s, w in weights.items():
        classes.setdefault(f"{math.floor(math.log(w) / math.log(supertasks.WIDTH)) + 100_000:06d}", []).append(s)
    frames = supertasks.frames_of({c: math.fsum(weights[s] for s in own) for c, own in classes.items()})
    orders = []
    for frame in frames:
        size, done, order = sum(s for _, s in frame), dict.fromkeys(dict(frame), 0), []
        for slot in range(size):
            order.append(min((-(-(done[t] + 1) * size // s), done[t] * size // s, t) for t, s in frame if done[t] * size < (slot + 1) * s)[2])
            done[order[-1]] += 1
        orders.append(order)
    seen = Counter()

    def pick(level):
        n = seen[level]
        seen[level] += 1
        task = orders[level][n % len(orders[level])]
        if task == supertasks.REST:
            return pick(level + 1)
        own = sorted(classes[task], key=lambda s: "" if s is None else "=" + s)
        seen[task] += 1
        return own[(seen[task] - 1) % len(own)]

    return [pick(0) for _ in range(turns)]


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 0.5, "b": 0.25, None: 0.25, "c": 0.251}, {"hot": 3e5, "m": 40.0, "n": 41.0, None: 0.02} | {f"s{i:02d}": 1.0 + i / 9 for i in range(30)}])
def test_slots_are_those_of_the_plain_walk(spark, weights):
    turns = 9000
    want = plain(weights, turns)
    own = Counter(want)
    rows = [(None if s is None else s, i) for s in weights for i in range(own[s])]
    docs = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "doc_id long, source string")
    table = spark.createDataFrame(list(weights.items()), "source string, weight double")
    got = {r["slot"]: r["source"] for r in supertasks.mixed_by_weight(docs, table, block_rows=1).collect()}
    assert [got.get(i) for i in range(turns)] == want and len(got) == turns


def test_thousands_of_sources_keep_their_weights(spark):
    # one row in three is of one source, 2000 others share the rest
    n = 300_000
    docs = spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 2000) END AS source")
    sizes = {r["source"]: r["rows"] for r in mixing.source_sizes(docs).collect()}
    total = sum(math.sqrt(x) for x in sizes.values())
    out = supertasks.mixed_by_root(docs)
    got = {r["source"]: r for r in out.groupBy("source").agg(F.count("*").alias("n"), F.max("weight").alias("w"), F.count_distinct("position").alias("p")).collect()}
    assert {s: r["n"] for s, r in got.items()} == sizes and all(r["p"] == r["n"] for r in got.values())
    assert all(abs(r["w"] * total / math.sqrt(sizes[s]) - 1) < 0.05 for s, r in got.items())
    assert out.select("position").distinct().count() == n
    # what is realised while all sources have rows
    slots = min(sizes.values()) // mixing.BLOCK_ROWS * len(sizes) // 2
    first = out.where(F.col("slot") < slots).select("source", "slot").distinct().groupBy("source").count().collect()
    hot = next(r["count"] for r in first if r["source"] == "hot")
    assert abs(hot - got["hot"]["w"] * slots) < 1 + 1e-9


def test_weights_over_many_scales(spark):
    classes = {f"{i:06d}": 1.3**i for i in range(240)}
    frames = supertasks.frames_of(classes)
    assert sorted(t for f in frames for t, _ in f if t != supertasks.REST) == sorted(classes)
    assert all(sum(s for _, s in f) <= mixing.MAX_FRAME and len(f) <= supertasks.FAN for f in frames)
    even = supertasks.frames_of({f"{i:06d}": 1.0 for i in range(700)})
    assert [len(f) for f in even] == [256, 256, 190] and all(sum(s for _, s in f) <= mixing.MAX_FRAME for f in even)


def test_odd_tables(spark, odd_docs, no_docs):
    out = supertasks.mixed_by_root(odd_docs).collect()
    assert len(out) == odd_docs.count() == len({r["position"] for r in out})
    assert set(odd_docs.columns) <= set(out[0].asDict())
    assert supertasks.mixed_by_root(no_docs).count() == 0
    clash = odd_docs.withColumnRenamed("kept", "slot").withColumnRenamed("n_words", "task")
    assert supertasks.mixed_by_root(clash).columns.count("slot") == 1 and "task" in supertasks.mixed_by_root(clash).columns
    plan = supertasks.mixed_by_root(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("rows", [[("a", 0.0)], [("a", None)], [("a", float("nan"))], [("a", 1.0), ("a", 2.0)]])
def test_weights_that_are_none(spark, odd_docs, rows):
    with pytest.raises(ValueError):
        supertasks.mixed_by_weight(odd_docs, spark.createDataFrame(rows, "source string, weight double"))


def test_a_source_without_a_weight_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    with pytest.raises(Exception, match="no weight"):
        supertasks.mixed_by_weight(docs, spark.createDataFrame([("a", 1.0)], "source string, weight double")).collect()
