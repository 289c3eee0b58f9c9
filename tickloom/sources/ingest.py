"""Incremental, idempotent staging of a collection with a monotonically increasing key."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tickloom.functions.scalars import is_finite
from tickloom.operators.clean import align_to_schema
from tickloom.schemas import DATE

log = logging.getLogger(__name__)


def ingest_incremental(df: DataFrame, key: str, after=None, upto=None) -> DataFrame:
    """Rows with ``after < key <= upto``; both bounds reach the scan as filters."""
    rows = df
    if after is not None:
        rows = rows.where(F.col(key) > F.lit(after))
    if upto is not None:
        rows = rows.where(F.col(key) <= F.lit(upto))
    return rows


def high_water_mark(df: DataFrame, key: str, after=None):
    """Largest key above ``after``, or ``after`` itself when nothing is new."""
    top = ingest_incremental(df, key, after).agg(F.max(key)).first()[0]
    return after if top is None else top


def cutoff(df: DataFrame, as_of: str, ignore_days: int = 0) -> DataFrame:
    """Rows dated up to ``ignore_days`` before ``as_of``; never reads the clock."""
    bound = F.date_sub(F.lit(as_of).cast("date"), ignore_days)
    return df.where(F.col(DATE) <= bound.cast(df.schema[DATE].dataType))


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    """Only the listed fields, so that only these are read."""
    return df.select(*cols)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _marks_path(path: str) -> str:
    return os.path.join(path, "_marks")


def read_mark(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """``(batch number, key as text)`` of the last committed append; None before the first."""
    marks = _marks_path(path)
    if not _exists(spark, marks):
        return None
    row = spark.read.schema("mark string, seq long").parquet(marks).agg(F.max(F.struct("seq", "mark"))).first()[0]
    return (row["seq"], row["mark"]) if row else None


def read_staged(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All committed batches; the folder of an unfinished append is pruned away."""
    committed = read_mark(spark, path)
    if committed is None:
        return spark.createDataFrame([], schema)
    numbered = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(numbered).parquet(path).where(F.col("batch") <= committed[0]).drop("batch")


def observed_write(df: DataFrame, path: str, **metrics: Column) -> dict:
    """Write ``df`` and return the metrics of the rows that were written, all in one job."""
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return seen.get


def append_staged(
    spark: SparkSession, source: Callable[[object], DataFrame], key: str, path: str, schema: T.StructType, finite: list[str] = []
) -> int:
    """Append what is newer than the stored mark; returns the number of rows written.

    ``source`` maps the mark to a DataFrame, which is evaluated once: the new mark, the counts and the check are
    observed on the rows as they are written. The batch folder is numbered after the last commit, so a run
    that dies between data and mark is repeated into the same folder instead of duplicating rows. Missing
    numbers stay missing. Rows without a key can never be told from staged ones; they are left out, counted and
    logged. If a column of ``finite`` (names of ``schema``) holds a missing or infinite number, the batch stays
    uncommitted, as if it had not been written, and ``ValueError`` names the columns.
    """
    committed = read_mark(spark, path)
    seq, after = (committed[0] + 1, committed[1]) if committed else (0, None)
    fresh = source(after)
    if after is not None:
        after = spark.range(1).select(F.lit(after).cast(fresh.schema[key].dataType)).first()[0]
        # still a filter of the scan; rows without a key pass so that they are counted
        fresh = fresh.where(F.col(key).isNull() | (F.col(key) > F.lit(after)))
    aligned = align_to_schema(fresh.withColumn("_key", F.col(key)), T.StructType([*schema.fields, T.StructField("_key", fresh.schema[key].dataType)]), fill=False)
    marked = F.col("_key").isNotNull()
    bad = {f"bad_{i}": F.count_if(marked & ~is_finite(c)) for i, c in enumerate(finite)}
    target = os.path.join(path, f"batch={seq:08d}")
    seen = Observation()
    rows = aligned.observe(seen, F.max("_key").alias("top"), F.count_if(marked).alias("n"), F.count_if(~marked).alias("keyless"), *[c.alias(n) for n, c in bad.items()])
    rows.where(marked).drop("_key").write.mode("overwrite").option("compression", "zstd").parquet(target)
    told = seen.get
    if told["keyless"]:
        log.warning("%d rows without %s are not staged to %s", told["keyless"], key, path)
    if not told["n"]:
        return 0
    if wrong := {c: told[f"bad_{i}"] for i, c in enumerate(finite) if told[f"bad_{i}"]}:
        raise ValueError(f"non-finite values, batch {seq} of {path} stays uncommitted: {wrong}")
    mark = spark.range(1).select(F.lit(str(told["top"])).alias("mark"), F.lit(seq).cast("long").alias("seq"))
    mark.write.mode("append").parquet(_marks_path(path))
    return told["n"]


def write_finite(df: DataFrame, path: str, cols: list[str]) -> int:
    """Write a table whose columns must hold finite numbers; returns its rows.

    One job writes and counts. Data go to a folder beside ``path`` and take its place only if the check holds, so
    readers of ``path`` never meet a bad table; otherwise ``ValueError`` names the columns and their counts.
    """
    spark = df.sparkSession
    pending = f"{path.rstrip('/')}.pending"
    told = observed_write(df, pending, n=F.count("*"), **{f"bad_{i}": F.count_if(~is_finite(c)) for i, c in enumerate(cols)})
    jvm = spark._jvm
    here, there = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(pending)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if wrong := {c: told[f"bad_{i}"] for i, c in enumerate(cols) if told[f"bad_{i}"]}:
        fs.delete(there, True)
        raise ValueError(f"non-finite values, {path} is left as it was: {wrong}")
    if fs.exists(here):
        fs.delete(here, True)
    if not fs.rename(there, here):
        raise OSError(f"{pending} could not take the place of {path}")
    return told["n"]


def read_required(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet input that must exist; says which one is missing."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as failure:
        if "PATH_NOT_FOUND" in str(failure):
            raise FileNotFoundError(f"required input {path!r} does not exist; stage it first") from failure
        raise


def map_table(spark: SparkSession, source: str, target: str, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Read a table, apply a frame-to-frame function, write the result, return it re-read."""
    out = read_required(spark, source).transform(fn)
    out.write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.schema(out.schema).parquet(target)


def resolve_source(spark: SparkSession, spec: str | None, default: str) -> DataFrame:
    """A panel given as SELECT text, ``read_parquet('path')``, a parquet path or a table name."""
    text = (spec or "").strip() or default
    lowered = text.lower()
    if lowered.startswith("select "):
        return spark.sql(text)
    if lowered.startswith("read_parquet("):
        return read_required(spark, text[text.index("(") + 1 : text.rindex(")")].strip().strip("'\""))
    if lowered.endswith(".parquet"):
        return read_required(spark, text)
    return spark.table(text)


def read_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """External SQL source; url, credentials and partitioning come from the caller."""
    return spark.read.format("jdbc").options(**options).load()


def distinct_symbols(df: DataFrame, col: str = "symbol") -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def date_bounds_table(df: DataFrame, col: str = DATE) -> DataFrame:
    """One row with the first and last date."""
    return df.agg(F.min(col).alias("min_date"), F.max(col).alias("max_date"))


def stored_bounds(spark: SparkSession, path: str, col: str = DATE) -> tuple[object, object, int]:
    """First and last ``col`` and the rows of a stored Parquet table, from the statistics of its files.

    The aggregate is pushed into the reader, so no column is read: a table of any size costs its footers.
    """
    found = stored_bounds_table(spark, path, col).first()
    return found["first"], found["last"], found["n"] or 0


def stored_bounds_table(spark: SparkSession, path: str, col: str = DATE) -> DataFrame:
    """``first, last, n`` of a stored table as a plan whose scan answers from statistics."""
    old = spark.conf.get("spark.sql.sources.useV1SourceList")
    # the aggregate is pushed into the v2 reader only, which is chosen when the table is opened
    spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(s for s in old.split(",") if s != "parquet"))
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    try:
        table = read_required(spark, path)
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", old)
    told = table.agg(F.min(col).alias("first"), F.max(col).alias("last"), F.count(F.lit(1)).alias("n"))
    # files without row groups have no statistics, and the pushed count is null against its own type
    return told.withColumn("n", F.greatest("n", F.lit(0).cast("long")))
