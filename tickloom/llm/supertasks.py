"""Mixing any number of sources to any target weights: hierarchical Pfair scheduling. DataFrame functions only.

One frame of whole shares (``mixing``) cannot hold the weights of thousands of sources. Here sources whose
weights lie within a factor of ``WIDTH`` form a class, which is scheduled as one task of their summed weight
and gives its slots to its members in turn: with equal weights that is their Pfair schedule. The classes are
scheduled by earliest deadline first in a frame of at most ``mixing.MAX_FRAME`` slots; those too light for it are
one task there, with a frame of their own, and so on. A block finds its slot by arithmetic, frame by frame.

A task is less than one block ahead of or behind its share of its parent's slots. A source's realised weight is
within 6 % of its target where its class, and every bundle of light classes around it, holds 1/256 or more of its frame;
a lighter bundle still has one slot of its frame, which is at most 1/3840 of it too much.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.ordering import dense_index
from tickloom.llm.common import fresh
from tickloom.llm.mixing import BLOCK_ROWS, MAX_FRAME, _named, frame_slots, numbered, source_sizes
from tickloom.session import staged

#: Sources of one class differ in weight by less than this factor.
WIDTH = 1.05
#: Most tasks of a frame; one that holds less than this part of it goes to the next frame. Rounded shares of so many tasks stay within ``MAX_FRAME``.
FAN = 256
SLOTS = MAX_FRAME - FAN
#: The task that stands for all classes of the next frame.
REST = "rest"

Frame = list[tuple[str, int]]  # task and share


def frames_of(classes: dict[str, float]) -> list[Frame]:
    """The frames, outermost first, for the summed weights of classes; all but the last one hold the task ``REST``."""
    left, out = sorted(classes.items(), key=lambda c: (-c[1], c[0])), []
    while left:
        total = math.fsum(w for _, w in left)
        heavy = sum(w >= total / FAN for _, w in left[: FAN - 1]) or FAN - 1
        tasks, left = left[:heavy], left[heavy:]
        if left:
            tasks.append((REST, math.fsum(w for _, w in left)))
        out.append([(name, max(1, round(w / total * SLOTS))) for name, w in tasks])
    return out


def _rows(spark: SparkSession, rows: list[Column]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*rows)))


def _slots(spark: SparkSession, frames: list[Frame]) -> DataFrame:
    """``level, task, nth, slot`` of all frames: at most ``MAX_FRAME`` rows each."""
    tables = []
    for level, frame in enumerate(frames):
        shares = _rows(spark, [F.struct(F.lit(t).alias("source"), F.lit(s).cast("long").alias("share")) for t, s in frame])
        tables.append(frame_slots(shares).select(F.lit(level).alias("level"), F.col("source").alias("task"), "nth", "slot"))
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return staged(out, "frames")


def members(weights: DataFrame) -> DataFrame:
    """``_own, task, place, size, weight``: each source's class, its place there, the class's sources and summed weight."""
    level = F.floor(F.log(F.col("weight")) / math.log(WIDTH)) + 100_000
    named = weights.select(_named(F.col("source")).alias("_own"), F.col("weight").cast("double"), F.lpad(level.cast("string"), 6, "0").alias("task"))
    named = staged(named.withColumn("_at", F.concat("task", "_own")), "weights")
    ranks, _ = dense_index(named, "_at", "_rank")
    # the classes are few whatever the number of sources: one for each 5 % between the least and the greatest weight
    sums = named.join(ranks, "_at").groupBy("task").agg(F.count("*").alias("size"), F.sum("weight").alias("total"), F.min("_rank").alias("_first"))
    return staged(
        named.join(ranks, "_at").join(sums, "task").select("_own", "task", (F.col("_rank") - F.col("_first")).cast("long").alias("place"), "size", F.col("total").alias("weight")), "members"
    )


def mixed_by_weight(docs: DataFrame, weights: DataFrame, source: str = "source", key: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with ``block, slot, position, weight``, in a mixture that follows ``weights`` (``source, weight``).

    Weights are positive numbers of any scale, one row per source (null is a source), of which there may be any number.
    ``block`` numbers a source's blocks, ``slot`` is the block's place in the mixture, ``position`` the row's, and
    ``weight`` the source's realised part of all slots. No row is left out: a source of ``docs`` without a weight, one
    that is listed twice and weights that are not positive are errors. Rows of equal key stand in any order. Added
    columns replace columns of the same name; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    good = F.coalesce((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.lit(False))
    told = weights.agg(F.count_if(~good).alias("bad"), F.count("*").alias("n"), (F.count_distinct(_named(F.col("source")))).alias("names")).first()
    if told["bad"] or told["n"] != told["names"]:
        raise ValueError("weights have to be positive numbers, one for each source")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("block", "slot", "position", "weight")])
    of_source = members(weights)
    frames = frames_of({r["task"]: r["weight"] for r in of_source.select("task", "weight").distinct().collect()}) or [[(REST, 1)]]
    sizes = [sum(s for _, s in frame) for frame in frames]
    rest = [dict(frame).get(REST, 1) for frame in frames]
    slots = _slots(spark, frames)

    part, tasks = 1.0, []
    for level, frame in enumerate(frames):
        tasks += [F.struct(F.lit(t).alias("task"), F.lit(level).alias("level"), F.lit(s).cast("long").alias("share"), F.lit(part * s / sizes[level]).alias("part")) for t, s in frame if t != REST or len(frames) == 1]
        part *= rest[level] / sizes[level]
    of_source = of_source.drop("weight").join(_rows(spark, tasks), "task").withColumn("part", F.col("part") / F.col("size"))

    order = fresh(docs, "_order")
    rows = numbered(docs, source, key, order).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _named(F.col(f"`{source}`")).alias("_own"), F.col(order).alias("order"))
    rows = rows.withColumn("block", F.expr(f"order div {block_rows}")).join(of_source, "_own", "left")
    rows = rows.withColumn("size", F.coalesce("size", F.raise_error(F.lit("a source has no weight")).cast("long")))
    # the place among all blocks of the class, then among those of each frame around it
    rows = rows.withColumn("at", F.col("block") * F.col("size") + F.col("place"))
    for level in reversed(range(len(frames))):
        inside = F.col("level") >= level
        here = slots.where(F.col("level") == level).select("task", "nth", "slot")
        rows = rows.withColumn("nth", F.when(inside, F.col("at") % F.col("share"))).join(here, ["task", "nth"], "left")
        rows = rows.withColumn("at", F.when(inside, F.expr("at div share") * sizes[level] + F.col("slot")).otherwise(F.col("at"))).drop("nth", "slot")
        if level:
            rows = rows.withColumn("task", F.when(inside, F.lit(REST)).otherwise(F.col("task"))).withColumn("share", F.when(inside, F.lit(rest[level - 1]).cast("long")).otherwise(F.col("share")))
    return rows.select("doc.*", "block", F.col("at").alias("slot"), (F.col("at") * block_rows + F.col("order") % block_rows).alias("position"), F.col("part").alias("weight"))


def mixed_by_root(docs: DataFrame, source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mixture whose weights are the square roots of the sources' rows, for any number of sources."""
    weights = staged(source_sizes(docs, source).select("source", F.sqrt("rows").alias("weight")), "weights")
    return mixed_by_weight(docs, weights, source, key)
