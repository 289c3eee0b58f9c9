"""Quality rules per document, with verdicts on whole hosts from shrunken failure rates.

Every text gets a few counts and a rule verdict in one pass. Failures are then summed by host with
map-side partials, host rates are shrunk towards a beta prior fitted to all hosts (method of moments),
and the verdicts on hosts are joined back by host name. Only a host whose failure rate is surely above
the limit - its posterior mean less two posterior deviations - is rejected, so a few bad documents
never condemn a small host.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import bounded_batches, fields
from tickloom.session import staged

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: A host is rejected where even the lower end of its shrunken failure rate lies above this.
HOST_LIMIT = 0.5
DEVIATIONS = 2.0

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SPACES = "\t\n\x0b\x0c\r "
_NO_SPACES = dict.fromkeys(map(ord, _SPACES))


def repeated_words(words: list, size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that the list holds at least twice."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    repeated = bytearray(len(windows))
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            repeated[i] = repeated[j] = 1
    total, end = 0, 0
    for i, hit in enumerate(repeated):
        if hit:
            total += i + size - max(i, end)
            end = i + size
    return total


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``COUNTS`` of one text; null and empty texts have none."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # splits bytes at exactly \x20 and \x09-\x0D
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def scored(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``COUNTS`` of every row, computed in one pass over the texts."""
    bounded_batches(docs.sparkSession)
    columns = list(dict.fromkeys([*keep, text]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in COUNTS])
    at = columns.index(text)

    def count(batches):
        for batch in batches:
            rows = [text_counts(t) for t in batch.column(at).to_pylist()]
            counts = zip(*rows, strict=True) if rows else [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(columns.index(c)) for c in keep] + [pa.array(list(c), pa.int64()) for c in counts], names=[*keep, *COUNTS])

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(count, schema)


@dataclass(frozen=True)
class BetaPrior:
    """Beta distribution of the hosts' failure rates."""

    alpha: float
    beta: float


def fit_prior(hosts: DataFrame) -> BetaPrior:
    """Prior from ``n_docs, n_failed`` per host by the method of moments.

    Without hosts, or where their rates do not vary, the prior is one pseudo-document at the mean rate.
    """
    rate = F.col("n_failed") / F.col("n_docs")
    m = hosts.agg(
        F.count("*").alias("hosts"), F.sum("n_failed").alias("failed"), F.sum("n_docs").alias("docs"),
        F.var_samp(rate).alias("spread"), F.avg(1 / F.col("n_docs")).alias("noise"),
    ).first()
    if not m["docs"]:
        return BetaPrior(0.5, 0.5)
    mean = min(max(m["failed"] / m["docs"], 1e-6), 1 - 1e-6)
    inner = mean * (1 - mean)
    # the spread of the observed rates, less what the hosts' sizes alone would cause
    spread = (m["spread"] or 0.0) - inner * m["noise"]
    size = min(max(inner / spread - 1, 1.0), 1e6) if spread > 0 else 1.0
    return BetaPrior(mean * size, (1 - mean) * size)


def host_verdicts(scores: DataFrame, host: str, failed: str) -> DataFrame:
    """``host, n_docs, n_failed, host_rate, host_rejected``: one row per host; null is a host like any other."""
    hosts = staged(scores.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed")), "hosts")
    prior = fit_prior(hosts)
    a, b = F.col("n_failed") + prior.alpha, F.col("n_docs") - F.col("n_failed") + prior.beta
    rate = a / (a + b)
    low = rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (a + b + 1))
    return hosts.select(host, "n_docs", "n_failed", rate.alias("host_rate"), (low > HOST_LIMIT).alias("host_rejected"))


def judged(scores: DataFrame, host: str) -> DataFrame:
    """``scores`` with ``base_failed, host_rate, host_rejected, kept``; ``scores`` is read twice, so stage it."""
    scores = scores.withColumn("base_failed", base_failed())
    verdicts = host_verdicts(scores, host, "base_failed").select(F.col(host).alias("_host"), "host_rate", "host_rejected")
    return scores.join(verdicts, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def rule_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept, host_rate.

    Null texts have no words and fail. Null sources form a host. Repeated rows and ids are judged one
    by one; an empty table gives an empty result; other columns of ``docs`` are ignored.
    """
    docs = fields(docs, doc_id="long", source="string", text="string")
    scores = staged(scored(docs, ["doc_id", "source"]), "rules")
    return judged(scores, "source").select("doc_id", *COUNTS, "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass the rules and whose host is not rejected, columns unchanged.

    Texts are counted once: the rows are staged with their verdict, and only the small table of
    rejected hosts meets them again. Columns of ``docs`` that are called like a count are kept as they are.
    """
    columns = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    names = dict(zip(columns, inner.columns, strict=True))
    scores = staged(scored(inner, inner.columns, names[text]).withColumn("base_failed", base_failed()), "rules")
    rejected = host_verdicts(scores, names[host], "base_failed").where("host_rejected").select(F.col(names[host]).alias("_host"))
    passed = scores.where(~F.col("base_failed")).join(rejected, F.col(names[host]).eqNullSafe(F.col("_host")), "left_anti")
    return passed.select(*[F.col(v).alias(k) for k, v in names.items()])
