"""Exact group quantiles in which no group is ever one task's alone.

Values are reduced to ``(group, value, count)`` with map-side partials. A group with at most
``GROUP_VALUES`` different values is one entry of an exact percentile aggregate. Larger groups are laid out
in (group, value) order by range and numbered: rows before a range partition come from one count per group
and partition, rows inside it from a running sum, and only partitions that hold a wanted rank are
sorted. Such a group may span any number of partitions. Where groups are known to be few, wanted ranks are
narrowed down by counting values in ranges instead, and no value is shuffled or stored. All ways interpolate alike.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tickloom.functions.scalars import finite_or_null
from tickloom.session import staged


def _long(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    values = [finite_or_null(c).cast("double").alias(c) for c in cols]
    long = df.select(*keys, *values).unpivot(keys, cols, "_measure", "_v")
    return long.where(F.col("_v").isNotNull())


#: Different values up to which a group is one task's: a few megabytes.
GROUP_VALUES = 50_000
#: Ranges that a pass over few groups counts in, for each bracket of a wanted rank.
BINS = 4096


def exact_quantiles(df: DataFrame, keys: list[str], cols: list[str], probs: list[float], group_values: int = GROUP_VALUES, few: bool = False) -> DataFrame:
    """Linear-interpolated quantiles: ``(*keys, measure, prob, value)``.

    Groups are (keys, measure). Missing and non-finite values and rows without key are left out. ``few`` says that groups
    are few, whatever their sizes: ``df`` is then read some four times, and should be a stored table.
    """
    if few:
        return _of_few(df.dropna(subset=keys), keys, cols, probs)
    group = [*keys, "_measure"]
    counted = staged(_long(df.dropna(subset=keys), keys, cols).groupBy(*group, "_v").agg(F.count("*").alias("_c")), "counted")
    large = staged(counted.groupBy(*group).agg(F.count("*").alias("_d")).where(F.col("_d") > group_values).select(*group), "large-groups")
    if large.isEmpty():
        return _of_groups(counted, keys, probs)
    small = _of_groups(counted.join(large, group, "left_anti"), keys, probs)
    return small.unionByName(_of_ranges(counted.join(large, group, "left_semi"), keys, probs))


def _of_groups(counted: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Quantiles of groups that fit in a task each."""
    levels = [float(p) for p in probs]
    found = counted.groupBy(*keys, "_measure").agg(F.percentile("_v", levels, F.col("_c")).alias("_q"))
    each = F.transform(F.col("_q"), lambda v, i: F.struct(F.get(F.array(*[F.lit(p) for p in levels]), i).alias("prob"), v.alias("value")))
    return found.select(*keys, F.col("_measure").alias("measure"), F.inline(each))


def _of_ranges(counted: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Quantiles of groups of any size, dealt out by group and value."""
    group = [*keys, "_measure"]
    # written with its partition number, which both counts below have to agree on
    ranged = staged(counted.repartitionByRange(*group, "_v").withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(*group, "_part").agg(F.sum("_c").alias("_rows"))
    # one row per group and partition that it reaches into
    of_group = Window.partitionBy(*group)
    before = F.sum("_rows").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*group, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(of_group).alias("_n"), "_rows")
    ranks = [F.struct(F.lit(float(p)).alias("prob"), ((F.col("_n") - 1) * float(p)).alias("at")) for p in probs]

    def here(q):
        return (F.ceil(q["at"]) >= F.col("_before")) & (F.floor(q["at"]) < F.col("_before") + F.col("_rows"))

    wanted = staged(starts.withColumn("_ranks", F.filter(F.array(*ranks), here)).where(F.size("_ranks") > 0).drop("_rows"), "starts")
    running = F.sum("_c").over(Window.partitionBy("_part", *group).orderBy("_v"))
    placed = ranged.join(wanted, [*group, "_part"]).withColumn("_last", F.col("_before") + running - 1).withColumn("_first", F.col("_last") - F.col("_c") + 1)
    # a value is kept for each rank it covers: the one below and the one above a quantile's place
    each = placed.withColumn("_q", F.explode("_ranks")).select(*group, "_v", "_first", "_last", "_q.prob", "_q.at")
    covers = lambda rank: (F.col("_first") <= rank) & (rank <= F.col("_last"))
    low, high = covers(F.floor("at")), covers(F.ceil("at"))
    found = each.where(low | high).groupBy(*group, "prob").agg(F.max(F.when(low, F.col("_v"))).alias("_a"), F.max(F.when(high, F.col("_v"))).alias("_b"), F.first("at").alias("_at"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))
    return found.select(*keys, F.col("_measure").alias("measure"), "prob", value.alias("value"))


def _of_few(df: DataFrame, keys: list[str], cols: list[str], probs: list[float]) -> DataFrame:
    """Quantiles of few groups of any size: each wanted rank has a bracket of values, which a pass over the rows narrows
    to the least and largest value of one of ``BINS`` ranges, until these are equal."""
    long, group = _long(df, keys, cols), [*keys, "_measure"]
    told = long.groupBy(*group).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()
    size = {tuple(r[c] for c in group): r["n"] for r in told}
    places = {g: [(n - 1) * float(p) for p in probs] for g, n in size.items()}
    # (group, least, largest): values of the group below the bracket, and the ranks in it
    brackets = {(tuple(r[c] for c in group), r["lo"], r["hi"]): (0, {k for at in places[tuple(r[c] for c in group)] for k in (math.floor(at), math.ceil(at))}) for r in told}
    found, fields = {}, [df.schema[c] for c in keys]
    schema = T.StructType([*fields, *T.StructType.fromDDL("_measure string, _b int, _lo double, _hi double, _unit double")])
    while True:
        found |= {(g, k): lo for (g, lo, hi), (_, ranks) in brackets.items() if lo == hi for k in ranks}
        ahead = [(b, *held) for b, held in brackets.items() if b[1] < b[2]]
        if not ahead:
            break
        table = df.sparkSession.createDataFrame([(*g, i, lo, hi, 1.0 if math.isfinite(hi - lo) else 0.5) for i, ((g, lo, hi), _, _) in enumerate(ahead)], schema)
        inside = long.join(F.broadcast(table), group).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        # halves where the range of a bracket is beyond that of doubles
        low, unit = F.col("_lo") * F.col("_unit"), F.col("_unit")
        part = (F.col("_v") * unit - low) / (F.col("_hi") * unit - low)
        counted = inside.groupBy("_b", F.least(F.floor(part * BINS), F.lit(BINS - 1)).alias("_bin")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        bins = sorted((r["_b"], r["_bin"], r["n"], r["lo"], r["hi"]) for r in counted.collect())
        brackets = {}
        for i, ((g, _, _), below, ranks) in enumerate(ahead):
            mine = [b for b in bins if b[0] == i]
            upto = below + np.cumsum([b[2] for b in mine])
            for k in ranks:
                at = int(np.searchsorted(upto, k, side="right"))
                held = brackets.setdefault((g, *mine[at][3:]), (int(upto[at]) - mine[at][2], set()))
                held[1].add(k)
    rows = []
    for g, ats in places.items():
        for p, at in zip(probs, ats):
            a, b = found[g, math.floor(at)], found[g, math.ceil(at)]
            rows.append((*g, float(p), a + (b - a) * (at - math.floor(at))))
    return df.sparkSession.createDataFrame(rows, T.StructType([*fields, *T.StructType.fromDDL("measure string, prob double, value double")]))
