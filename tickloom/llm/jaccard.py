"""Jaccard join on word n-grams with Bayesian pruning of candidate pairs.

Texts are sets of windows of five words. MinHash values give each text bands; texts that agree on a band
are candidates. Inside a bucket, pairs are compared on more and more MinHash values, and a pair is
dropped as soon as the posterior probability that its similarity reaches the threshold falls below
``TOLERANCE``. Survivors tie texts into families. Inside a family the same comparison decides which
pairs are verified exactly, on the full sets.

Pairs are never rows. Buckets and families are cut into blocks, every two blocks meet in a group of their
own, and a group returns for each of its texts the links it counted and the smallest text it is linked to,
so results grow with texts and not with pairs, and no bucket or family is one task's alone.

What a family's texts send to every block is small: their signature and the windows in which they differ from
the family's first text (all windows where those are fewer). The sizes of the differences alone decide most pairs
exactly, without a look at the windows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import BASE_A, Powers, Rolling, bounded_batches, fields, group_bounds, sorted_groups
from tickloom.llm.graphs import components
from tickloom.session import staged

WORDS = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 4  # a pair at the threshold misses all bands with probability 5e-8
HASHES = BANDS * ROWS
#: Posterior probability below which a pair is dropped, and values compared between two looks.
TOLERANCE = 1e-7
STEP = 16
#: Texts of a block, and bytes of windows of a family's block; two blocks meet in a group.
BUCKET_BLOCK = 1024
FAMILY_BLOCK = 1024
FAMILY_BYTES = 16 << 20

_powers = Powers(BASE_A)
_rng = np.random.default_rng(1)
_MULTIPLY = (_rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's windows of ``WORDS`` words (split at ASCII white space).

    A shorter text is one window; a text without words has none.
    """
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.r_[0, ends[:-1] + 1]
    n = min(WORDS, len(words))
    return np.unique(Rolling(data, _powers).of(starts[: len(starts) - n + 1], ends[n - 1 :]))


def minhashes(found: np.ndarray) -> np.ndarray:
    """``HASHES`` minima of a set of 64-bit hashes under as many mixings of their folded halves."""
    x = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 1024):
        y = (x[at : at + 1024] ^ _XOR) * _MULTIPLY
        y ^= y >> np.uint32(15)
        np.minimum(out, (y * np.uint32(0x2C1B3C6D)).min(axis=1), out=out)
    return out


def _log_beta_tail(a: float, b: float, at: float, steps: int = 4000) -> float:
    """Probability that a Beta(a, b) variable exceeds ``at``, by summing its density on a fine grid."""
    x = (np.arange(steps) + 0.5) / steps
    log = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    weight = np.exp(log - log.max())
    return float(weight[x >= at].sum() / weight.sum())


@lru_cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For 16, 32, ... compared values: the fewest matches with which a pair stays.

    With k matches of n and a flat prior, the similarity's posterior is Beta(k + 1, n - k + 1). Values are
    compared by one byte, so different values agree once in 256 times; that can only keep a pair longer.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        out.append(next(k for k in range(n + 1) if _log_beta_tail(k + 1, n - k + 1, threshold) >= tolerance))
    return tuple(out)


def likely_pairs(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, same: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs between two blocks of signatures that survive the incremental comparison.

    ``same``: the blocks are one and the same, so each pair is looked at once. Sizes of sets alone rule
    out pairs whose smaller set is less than ``threshold`` of the larger one.
    """
    smaller, larger = np.minimum(size_a[:, None], size_b[None, :]), np.maximum(size_a[:, None], size_b[None, :])
    live = smaller >= threshold * larger
    if same:
        live &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    i, j = np.nonzero(live)
    matches = np.zeros(len(i), np.int32)
    for look, least in enumerate(least_matches(threshold)):
        part = slice(look * STEP, (look + 1) * STEP)
        left, right = a[:, part], b[:, part]
        keep = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            matches[s] += (left[i[s]] == right[j[s]]).sum(1, dtype=np.int32)
            keep[s] = matches[s] >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place connected to each of ``n`` places by the pairs."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


# --- the tables ----------------------------------------------------------------------------------


def signatures(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep``, n_shingles, sig (one byte per MinHash value) and bands (long per band) of every row."""
    bounded_batches(docs.sparkSession)
    columns = [*keep, text]

    def sign(batches):
        for batch in batches:
            n, sig, bands = [], [], []
            for t in batch.column(len(keep)).to_pylist():
                s = shingles(t or "")
                n.append(len(s))
                h = minhashes(s)
                sig.append((h >> np.uint32(24)).astype(np.uint8).tobytes() if len(s) else None)
                if len(s):
                    rows = h.reshape(BANDS, ROWS)
                    mixed = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    for r in range(ROWS):
                        mixed = (mixed ^ rows[:, r]) * np.uint64(0xD6E8FEB86659FD93)
                        mixed ^= mixed >> np.uint64(32)
                    bands.append(mixed.view(np.int64).tolist())
                else:
                    bands.append([])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=[*keep, "n_shingles", "sig", "bands"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*columns).mapInArrow(sign, f"{kinds}, n_shingles int, sig binary, bands array<long>")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """``rows`` (with blocks, the number of their group's) once for each pair of blocks x <= y they take part in; own is their block."""
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    each = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("blocks", "other")


def _met(rows: DataFrame, group: str, task, schema: str) -> DataFrame:
    keys = [group, "x", "y"]
    # the work of a group is not in its bytes, so partitions are not merged by them
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(task, schema)


def _bytes_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _groups(batches, keys):
    """``(table, block of each row, first row of block x)`` of every pair of blocks."""
    for table in sorted_groups(batches, keys):
        bounds = group_bounds(table, keys)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1:
                yield table.slice(int(a), int(b - a))


def _pairs_of(table) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs (row numbers of the table) between the two blocks of a table."""
    sig, n = _bytes_matrix(table.column("sig")), table.column("n_shingles").to_numpy()
    own = table.column("own").to_numpy()
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    i, j = likely_pairs(sig[left], sig[right], n[left], n[right], x == y)
    return left[i], right[j]


def _tie_bucket(batches):
    for table in _groups(batches, ["bucket", "x", "y"]):
        i, j = _pairs_of(table)
        if len(i):
            ids = table.column("id").to_numpy()
            root = _local_roots(len(ids), i, j)
            moved = root != np.arange(len(ids))
            yield pa.RecordBatch.from_pydict({"a": ids[moved], "b": ids[root[moved]]})


def _differences(batches):
    """id, family, plain, gone, new of texts beside their family's first one: windows that only the first has, and only the text."""
    for batch in batches:
        plain, gone, new = [], [], []
        for text, whole in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            own, first = shingles(text), np.frombuffer(whole, np.uint64)
            a, b = np.setdiff1d(first, own, assume_unique=True), np.setdiff1d(own, first, assume_unique=True)
            plain.append(len(a) + len(b) >= len(own))
            gone.append(b"" if plain[-1] else a.tobytes())
            new.append(own.tobytes() if plain[-1] else b.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(plain, pa.bool_()), pa.array(gone, pa.binary()), pa.array(new, pa.binary())], names=["id", "family", "plain", "gone", "new"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def similar_enough(i: np.ndarray, j: np.ndarray, sizes: np.ndarray, first: np.ndarray, plain: np.ndarray, gone: list[np.ndarray], new: list[np.ndarray]) -> np.ndarray:
    """Which of the pairs of rows reach ``THRESHOLD``, exactly.

    Two texts that lack a and a' windows of the first text and add b and b' share at least |first| - a - a'
    windows, and at most |first| - max(a, a') + min(b, b'). Where both bounds agree on the threshold, that is the answer.
    """
    part = round(10 * THRESHOLD)
    lacks, adds = (np.array([len(x) for x in found], np.int64) for found in (gone, new))
    # in whole numbers, so that a similarity of exactly 4/5 counts
    need = part * (sizes[i].astype(np.int64) + sizes[j])
    both = ~(plain[i] | plain[j])
    least = len(first) - lacks[i] - lacks[j]
    most = len(first) - np.maximum(lacks[i], lacks[j]) + np.minimum(adds[i], adds[j])
    good = both & ((10 + part) * least >= need)
    wholes: dict[int, np.ndarray] = {}

    def whole(k: int) -> np.ndarray:
        if k not in wholes:
            wholes[k] = new[k] if plain[k] else np.union1d(np.setdiff1d(first, gone[k], assume_unique=True), new[k])
        return wholes[k]

    for p in np.flatnonzero(~good & ~(both & ((10 + part) * most < need))).tolist():
        a, b = int(i[p]), int(j[p])
        shared = least[p] + _common(gone[a], gone[b]) + _common(new[a], new[b]) if both[p] else _common(whole(a), whole(b))
        good[p] = (10 + part) * shared >= need[p]
    return good


def _verify_family(batches):
    for table in _groups(batches, ["family", "x", "y"]):
        i, j = _pairs_of(table)
        if not len(i):
            continue
        gone, new = ([np.frombuffer(s, np.uint64) for s in table.column(c).to_pylist()] for c in ("gone", "new"))
        # the family's first text stands in every group, outside of the blocks
        first = new[int(np.flatnonzero(table.column("own").to_numpy() < 0)[0])]
        good = similar_enough(i, j, table.column("n_shingles").to_numpy(), first, table.column("plain").to_numpy(), gone, new)
        i, j = i[good], j[good]
        if len(i):
            ids = table.column("id").to_numpy()
            links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            root = _local_roots(len(ids), i, j)
            linked = links > 0
            yield pa.RecordBatch.from_pydict({"id": ids[linked], "links": links[linked], "root": ids[root[linked]]})


def family_rows(members: DataFrame, firsts: DataFrame) -> DataFrame:
    """``members`` (id, family, plain, gone, new, n_shingles, sig) for every pair of blocks, each with the family's first text (``firsts``: family, whole)."""
    size = F.sum(F.length("gone") + F.length("new") + F.lit(HASHES))
    blocks = F.greatest(F.ceil(F.count("*") / FAMILY_BLOCK), F.ceil(size / FAMILY_BYTES)).cast("int").alias("blocks")
    sizes = staged(members.groupBy("family").agg(F.count("*").alias("n"), blocks).where("n > 1").drop("n"), "blocks")
    rows = _block_pairs(members.join(sizes, "family"))
    each = firsts.join(sizes, "family").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("y", F.explode(F.sequence("x", F.col("blocks") - 1)))
    none = F.lit(b"")
    each = each.select(F.col("family").alias("id"), "family", F.lit(True).alias("plain"), none.alias("gone"), F.col("whole").alias("new"), F.lit(0).alias("n_shingles"), F.lit(bytes(HASHES)).alias("sig"), F.lit(-1).alias("own"), "x", "y")
    return rows.unionByName(each)


def similar_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, classes)`` of ``docs`` with columns key (long, may repeat or be null) and text.

    ``rows``: key and id (one id per distinct text with words; null for texts without words).
    ``classes``: per id copies (rows with that text), first_key (smallest key), links (other distinct
    texts at the threshold or above), root (the smallest id of its connected group).
    """
    docs = docs.select("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("content"), F.coalesce("text", F.lit("")).alias("text"))
    signed = staged(signatures(docs.select("key", "content", F.monotonically_increasing_id().alias("row"), "text"), ["key", "content", "row"], "text"), "signed")
    firsts = signed.where("n_shingles > 0").groupBy("content").agg(F.min("row").alias("id"), F.count("*").alias("copies"), F.min("key").alias("first_key"))
    firsts = staged(firsts, "contents")
    one = signed.join(firsts.select("id"), signed["row"] == F.col("id"), "left_semi").select(F.col("row").alias("id"), "n_shingles", "sig", "bands")
    one = staged(one, "distinct")

    banded = one.select("id", F.explode("bands").alias("bucket"))
    shared = banded.join(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket")
    members = shared.join(one.select("id", "n_shingles", "sig"), "id").withColumn("blocks", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")).drop("n")
    ties = _met(_block_pairs(members), "bucket", _tie_bucket, "a long, b long")
    families = staged(components(ties, "ties").select(F.col("node").alias("id"), F.col("root").alias("family")), "families")

    wanted = families.join(firsts, "id").select("id", "family", F.col("content").alias("c"), F.col("first_key").alias("k"))
    chosen = docs.join(wanted, (docs["content"] == F.col("c")) & docs["key"].eqNullSafe(F.col("k"))).select("id", "family", "text")
    chosen = staged(chosen, "members")

    def whole(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["family", "whole"])

    # a repeated row (same key, same text) comes more than once
    leads = staged(chosen.where("id = family").select("family", "text").mapInArrow(whole, "family long, whole binary").dropDuplicates(["family"]), "leads")
    differ = chosen.join(leads, "family").select("id", "family", "text", "whole").mapInArrow(_differences, "id long, family long, plain boolean, gone binary, new binary")
    differ = staged(differ.dropDuplicates(["id"]).join(one.select("id", "n_shingles", "sig"), "id"), "differences")
    found = staged(_met(family_rows(differ, leads), "family", _verify_family, "id long, links long, root long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "groups")
    classes = firsts.join(links, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    classes = classes.select("content", "id", "copies", "first_key", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root"))
    rows = signed.select("key", "n_shingles", "content")
    return rows, classes


def join_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id, n_links, n_copies.

    ``class_id`` is the smallest doc_id of the group of texts connected by links (similarity 0.8 or more),
    ``n_links`` the number of other distinct texts linked to this one, ``n_copies`` the number of rows
    with this very text. A null, empty or blank text is alone, in a class of its own id. Null ids come
    last in the choice of a class id. Repeated rows are copies; other columns are ignored; an empty table
    gives an empty result.
    """
    docs = fields(docs, doc_id="long", text="string").withColumnRenamed("doc_id", "key")
    rows, classes = similar_texts(docs)
    classes = staged(classes, "classes")
    names = classes.groupBy("root").agg(F.min("first_key").alias("class_id"))
    told = classes.join(names, "root").select("content", "class_id", "links", "copies")
    return rows.join(told, "content", "left").select(
        F.col("key").alias("doc_id"), F.coalesce("class_id", "key").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of similar texts: the first copy of the text with the smallest key.

    Rows with blank texts all stay. Columns are unchanged, whatever they are called.
    """
    columns = docs.columns
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    kept = staged(docs.toDF(*names.values()).withColumn("row", F.monotonically_increasing_id()), "rows")
    rows, classes = similar_texts(kept.select(F.col("row").alias("key"), F.col(names[text]).alias("text")))
    order = F.struct(F.col(names[key]).isNull(), F.col(names[key]), F.col("row"))
    best = rows.select(F.col("key").alias("row"), "content").join(classes.select("content", "root"), "content").join(kept.select("row", names[key]), "row")
    best = best.groupBy("root").agg(F.min_by("row", order).alias("row")).select("row")
    blank = rows.where("n_shingles = 0").select(F.col("key").alias("row"))
    return kept.join(best.union(blank), "row", "left_semi").select(*[F.col(v).alias(c) for c, v in names.items()])
