"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only.

A source's rows are dealt into blocks. With weight w, its i-th block (from 1) is released at slot
floor((i - 1) / w) and has to run before slot ceil(i / w). Slots are given to the released block with
the earliest deadline, so after any number of slots a source is less than one block ahead of or behind
its share, as long as it has rows.

Weights are whole shares of a frame of slots. Releases and deadlines repeat from frame to frame, so the
schedule of one frame is the schedule of all: it is computed once, over as many slots as the shares add
up to, and every block finds its slot by arithmetic. No row waits for another one. In a frame with very many
sources nearly all have one share; those take the slots that the others leave free, in order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.ordering import dense_index
from tickloom.llm.common import fields, fresh
from tickloom.session import staged

#: Rows of a block.
BLOCK_ROWS = 16
#: Most slots that are scheduled one after the other; longer frames fold only over blocks that are not their source's last.
MAX_FRAME = 4096
#: Shares follow the square root of a source's rows, so large sources do not drown the small ones.
SHARES_WANTED = 256
#: Ids are counted in ranges of this length before any row is numbered.
ID_RANGE = 512


def _ceil_div(a: Column, b: Column) -> Column:
    return (a + b - 1) / b


def shares_by_size(sizes: DataFrame, wanted: int = SHARES_WANTED) -> DataFrame:
    """``source, rows, share`` from ``source, rows``: shares as the square roots of the rows, adding up to about ``wanted``."""
    root = F.sqrt("rows")
    total = sizes.agg(F.sum(root)).first()[0] or 1.0
    return sizes.withColumn("share", F.greatest(F.lit(1), F.round(root * (wanted / total)).cast("int")).cast("long"))


def frame_slots(shares: DataFrame) -> DataFrame:
    """``source, share, frame, nth, slot, release, deadline``: the slots of one frame, earliest deadline first.

    ``shares`` has one row per source; a frame of more than ``MAX_FRAME`` slots is an error, so every
    table here is small. The loop over slots is one fold over an array. Ties go to the earlier release,
    then to the source that comes first by name (null before all names).
    """
    size = shares.agg(F.sum("share")).first()[0] or 0
    if size > MAX_FRAME:
        raise ValueError(f"shares add up to {size} slots, more than {MAX_FRAME}")
    names = shares.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNotNull().alias("named"), "source", "share"))).alias("s"), F.lit(size).cast("long").alias("frame"))
    share = lambda i: F.element_at("s", (i + 1).cast("int"))["share"]
    empty = F.struct(F.transform("s", lambda _: F.lit(0).cast("long")).alias("done"), F.expr("array()").cast("array<int>").alias("picked"))

    def run(state: Column, slot: Column) -> Column:
        # of the released next blocks, the least (deadline, release, place); nothing is released: null
        due = F.transform(
            state["done"],
            lambda n, i: F.when(
                n * F.col("frame") < (slot + 1) * share(i),
                F.struct(F.floor(_ceil_div((n + 1) * F.col("frame"), share(i))).alias("deadline"), F.floor(n * F.col("frame") / share(i)).alias("release"), i.alias("i")),
            ),
        )
        pick = F.array_min(due)["i"]
        return F.struct(F.transform(state["done"], lambda n, i: F.when(i == pick, n + 1).otherwise(n)).alias("done"), F.concat(state["picked"], F.array(pick)).alias("picked"))

    slots = F.when(F.col("frame") > 0, F.sequence(F.lit(0).cast("long"), F.col("frame") - 1)).otherwise(F.expr("array()").cast("array<long>"))
    picked = names.select("s", "frame", F.posexplode(F.aggregate(slots, empty, run, lambda state: state["picked"])).alias("slot", "i"))
    each = picked.select("frame", F.col("slot").cast("long"), F.element_at("s", F.col("i") + 1).alias("s"))
    n = F.row_number().over(Window.partitionBy("s").orderBy("slot")).cast("long") - 1
    table = each.select("s.source", "s.share", "frame", n.alias("nth"), "slot")
    return table.withColumn("release", F.floor(F.col("nth") * F.col("frame") / F.col("share"))).withColumn("deadline", F.floor(_ceil_div((F.col("nth") + 1) * F.col("frame"), F.col("share"))))


def long_frame_slots(shares: DataFrame) -> DataFrame:
    """The table of ``frame_slots`` for frames of any length and any number of sources.

    A source's last block of the frame has the frame's end for a deadline, later than all other blocks. So
    the others are scheduled as if alone, and the slots they leave free go to the last blocks in order of
    release and name: first to the sources of one share, which are released at slot 0 and numbered by
    ranges, then to the rest. Shares whose blocks without the last ones are more than ``MAX_FRAME`` are an
    error; shares of ``shares_by_size`` never are, whatever the number of sources.
    """
    sums = shares.agg(F.sum("share").alias("frame"), F.sum(F.col("share") - 1).alias("early"), F.sum((F.col("share") == 1).cast("long")).alias("ones")).first()
    frame, early, ones = sums["frame"] or 0, sums["early"] or 0, sums["ones"] or 0
    if early > MAX_FRAME:
        raise ValueError(f"{early} blocks besides the last ones of their sources, more than {MAX_FRAME}")
    size = F.lit(frame).cast("long")
    named = F.col("source").isNotNull()
    several = shares.where("share > 1").agg(F.array_sort(F.collect_list(F.struct(named.alias("named"), "source", "share"))).alias("s"))
    share = lambda i: F.element_at("s", (i + 1).cast("int"))["share"]
    empty = F.struct(F.transform("s", lambda _: F.lit(0).cast("long")).alias("done"), F.lit(0).cast("long").alias("time"), F.expr("array()").cast("array<struct<slot:bigint,i:int>>").alias("picked"))

    def run(state: Column, _: Column) -> Column:
        # the next block of every source that has more than its last one; time goes on to the first release
        due = F.filter(
            F.transform(
                state["done"],
                lambda n, i: F.when(n < share(i) - 1, F.struct(F.floor(_ceil_div((n + 1) * size, share(i))).alias("deadline"), F.floor(n * size / share(i)).alias("release"), i.alias("i"))),
            ),
            lambda x: x.isNotNull(),
        )
        time = F.greatest(state["time"], F.array_min(F.transform(due, lambda x: x["release"])))
        pick = F.array_min(F.filter(due, lambda x: x["release"] <= time))["i"]
        told = F.struct(time.alias("slot"), pick.alias("i"))
        return F.struct(F.transform(state["done"], lambda n, i: F.when(i == pick, n + 1).otherwise(n)).alias("done"), (time + 1).alias("time"), F.concat(state["picked"], F.array(told)).alias("picked"))

    turns = F.sequence(F.lit(1), F.lit(early)) if early else F.expr("array()").cast("array<int>")
    picked = staged(several.select("s", F.aggregate(turns, empty, run, lambda state: state["picked"]).alias("picked")), "early")
    each = picked.select("s", F.explode("picked").alias("p")).select(F.element_at("s", F.col("p.i") + 1).alias("s"), F.col("p.slot").alias("slot"))
    n = F.row_number().over(Window.partitionBy("s").orderBy("slot")).cast("long") - 1
    first = each.select("s.source", "s.share", n.alias("nth"), "slot")

    single = shares.where("share = 1")
    ranks, others = dense_index(single.where(named), "source", "_k")
    late = ranks.select("source", F.lit(1).cast("long").alias("share"), (F.col("_k") + F.lit(ones - others)).cast("long").alias("_k"))
    late = late.union(single.where(~named).select("source", F.lit(1).cast("long"), F.lit(0).cast("long")))
    final = F.array_sort(F.transform("s", lambda x: F.struct(F.floor((x["share"] - 1) * size / x["share"]).alias("release"), x["named"], x["source"], x["share"])))
    last = picked.select(F.posexplode(final).alias("_k", "x")).select("x.source", "x.share", (F.col("_k") + F.lit(ones)).cast("long").alias("_k"))
    # of the slots that the others leave free, the k-th: as many of theirs stand before it as have no more than k free ones before them
    gaps = picked.select(F.transform("picked", lambda p, i: p["slot"] - i).alias("gaps"))
    free = F.col("_k") + F.size(F.filter("gaps", lambda g: g <= F.col("_k")))
    rest = late.union(last).crossJoin(F.broadcast(gaps)).select("source", "share", (F.col("share") - 1).alias("nth"), free.cast("long").alias("slot"))
    table = first.union(rest).select("source", "share", size.alias("frame"), "nth", "slot")
    return table.withColumn("release", F.floor(F.col("nth") * F.col("frame") / F.col("share"))).withColumn("deadline", F.floor(_ceil_div((F.col("nth") + 1) * F.col("frame"), F.col("share"))))


def _named(source: Column) -> Column:
    """A source's name that is never null, so that equal names can be hashed and joined."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def numbered(docs: DataFrame, source: str, key: str, name: str) -> DataFrame:
    """``docs`` with ``name``: every row's number within its source, in order of ``key``, from 0.

    A source may hold any part of the rows, so rows are numbered within ranges of ``ID_RANGE`` keys, and
    each range begins where the counts of the source's earlier ranges end. Rows without a key come first,
    spread by a hash of their content; rows with the same key stand in any order.
    """
    own, part, start = fresh(docs, "_own"), fresh(docs, "_part"), fresh(docs, "_start")
    loose = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(ID_RANGE)) - (1 << 62)
    rows = docs.withColumn(own, _named(F.col(f"`{source}`"))).withColumn(part, F.coalesce(F.floor(F.col(f"`{key}`") / ID_RANGE), loose))
    before = F.sum("_n").over(Window.partitionBy(own).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(own, part).agg(F.count("*").alias("_n")).select(own, part, F.coalesce(before, F.lit(0)).alias(start))
    inside = F.row_number().over(Window.partitionBy(own, part).orderBy(F.col(f"`{key}`")))
    joined = rows.withColumn(name, inside.cast("long") - 1).join(starts, [own, part])
    return joined.withColumn(name, F.col(name) + F.col(start)).drop(own, part, start)


def mixed(docs: DataFrame, shares: DataFrame, source: str = "source", key: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with ``share, frame, slot, release, deadline, block, position``.

    ``block`` numbers a source's blocks, ``slot`` is the place of the block in the mixture, and ``position``
    the place of the row: the mixture read in the order of ``position`` keeps to the weights until a
    source has no more rows; its later slots stay empty and the others go on. No row is left out; null
    sources are a source. ``shares`` needs a row for every source. Added columns replace columns of the
    same name; an empty table gives an empty result.
    """
    added = ["share", "frame", "slot", "release", "deadline", "block", "position"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    order = fresh(docs, "_order")
    block = F.floor(F.col(order) / block_rows)
    size = shares.agg(F.sum("share")).first()[0] or 0
    slots = frame_slots(shares) if size <= MAX_FRAME else staged(long_frame_slots(shares), "slots")
    turns = slots.withColumn("_own", _named(F.col("source"))).drop("source")
    lengths = shares.select(_named(F.col("source")).alias("_own"), F.col("share").alias("_share"))
    rows = numbered(docs, source, key, order).withColumn("_own", _named(F.col(f"`{source}`"))).withColumn("block", block)
    rows = rows.join(lengths, "_own").withColumn("nth", F.col("block") % F.col("_share"))
    placed = rows.join(turns, ["_own", "nth"])
    frames = F.floor(F.col("block") / F.col("share"))
    shifted = [(F.col(c) + frames * F.col("frame")).alias(c) for c in ("slot", "release", "deadline")]
    out = placed.select(*[F.col(f"`{c}`") for c in docs.columns], order, "share", "frame", *shifted, "block")
    return out.withColumn("position", F.col("slot") * block_rows + F.col(order) % block_rows).drop(order)


def source_sizes(docs: DataFrame, source: str = "source") -> DataFrame:
    return docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count("*").alias("rows"))


def mix_by_size(docs: DataFrame, source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mixture with the default weights (``shares_by_size``)."""
    shares = staged(shares_by_size(source_sizes(docs, source)), "shares")
    return mixed(docs, shares, source, key)


def mix_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, share, block, slot, release, deadline, position."""
    docs = fields(docs, doc_id="long", source="string")
    return mix_by_size(docs).select("doc_id", "source", "share", "block", "slot", "release", "deadline", "position")
