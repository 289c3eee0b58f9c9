"""Language identification: text likelihoods fused with what surrounds a text, by Bayes' rule.

Four pieces of evidence meet in log space:

* the text: byte trigrams under one model per language, fitted to the counts of all labelled documents;
* the language its markup declares and the one its address suggests (a path segment, or else the last
  label of the host name), each weighed by how often it went with each language over all rows;
* the host: the languages of its other texts, shrunk towards those of its domain, which are shrunk
  towards those of the whole corpus. A row's own vote is taken out of its prior.

All counts are grouped aggregates with map-side partials. The models are small arrays of fixed size per
language; what is known of hosts may be large and is joined, not broadcast.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import bounded_batches, fields
from tickloom.session import staged

#: Trigrams are folded into so many counts per language.
BUCKETS = 1 << 14
#: Labels that are language codes; everything else is no label.
CODE = "^[a-z]{2,3}$"
#: Languages scored at a time.
LANGUAGE_BLOCK = 128
#: Rows that a domain's or the corpus's languages count for in the prior of a host or domain.
HOST_STRENGTH = 8.0
DOMAIN_STRENGTH = 16.0
#: Count added to every pair of a language and a declared or suggested one.
EVIDENCE_PRIOR = 1.0
#: Overlapping trigrams see each byte three times.
TEMPER = 1 / 3

_RAW = re.compile(r"(?i)<(script|style)\b")
_RAW_END = {"script": re.compile(r"(?i)</script\s*>"), "style": re.compile(r"(?i)</style\s*>")}


def plain_text(text: str) -> str:
    """Text without markup: scripts, styles, comments and tags become blanks.

    One walk from "<" to "<". What closes none of the openers behind some place is looked for once, so the walk
    takes time in proportion to the text even where nothing is closed; an opener that is not closed is a tag.
    """
    out, at, absent = [], 0, set()
    lt = text.find("<")
    while lt >= 0:
        end = -1
        if text.startswith("<!--", lt):
            if "-->" not in absent:
                found = text.find("-->", lt + 4)
                end = found + 3 if found >= 0 else -1
                if end < 0:
                    absent.add("-->")
        elif (raw := _RAW.match(text, lt)) and (name := raw[1].lower()) not in absent:
            found = _RAW_END[name].search(text, raw.end())
            end = found.end() if found else -1
            if end < 0:
                absent.add(name)
        if end < 0 and ">" not in absent:
            end = text.find(">", lt) + 1 or -1
            if end < 0:
                absent.add(">")
        if end < 0:
            break
        out += [text[at:lt], " "]
        at = end
        lt = text.find("<", at)
    return "".join([*out, text[at:]])


def label_code(label: Column) -> Column:
    """The language code of a label: lower case, without what follows a hyphen or underscore; null if that is none."""
    code = F.lower(F.trim(F.split(label, "[-_]", 2)[0]))
    return F.when(code.rlike(CODE), code)


def trigrams(text: str) -> np.ndarray:
    """Bucket of every three bytes of the lower-cased text, with a blank at either end."""
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64)


def trigram_counts(docs: DataFrame, text: str, label: str) -> DataFrame:
    """``lang, bucket, n`` over all labelled rows; each task sends at most one row per language and bucket."""
    bounded_batches(docs.sparkSession)

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    mine = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    mine += np.bincount(trigrams(plain_text(t)), minlength=BUCKETS)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": at.astype(np.int32), "n": n[at]})

    rows = docs.select(text, label_code(F.col(label)).alias("code")).where(F.col("code").isNotNull())
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of trigram buckets, a row per language (in order of their codes)."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def likelihoods(self, text: str | None) -> list[float]:
        """Tempered log likelihood of a text under every language; 0 for null and empty texts."""
        if not text or not self.languages:
            return [0.0] * len(self.languages)
        n = np.bincount(trigrams(plain_text(text)), minlength=BUCKETS)
        at = np.flatnonzero(n)
        blocks = [self.weights[i : i + LANGUAGE_BLOCK, at] @ n[at] for i in range(0, len(self.weights), LANGUAGE_BLOCK)]
        return (TEMPER * np.concatenate(blocks)).tolist()


def fit(docs: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """Model of all labelled rows, with every language that occurs; without labels it has none and every result is null.

    A language is 64 KB of weights; how many there can be is bounded by the codes of two and three letters.
    """
    counts = staged(trigram_counts(docs, text, label), "trigrams")
    languages = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    weights = np.zeros((len(languages), BUCKETS), np.float32)
    for i in range(0, len(languages), LANGUAGE_BLOCK):
        # at most BUCKETS rows per language
        some = languages[i : i + LANGUAGE_BLOCK]
        table = counts.where(F.col("lang").isin(some)).toPandas()
        n = np.zeros((len(some), BUCKETS))
        n[table["lang"].map({x: k for k, x in enumerate(some)}).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"]
        smooth = n + 0.5
        weights[i : i + len(some)] = np.log(smooth / smooth.sum(1, keepdims=True))
    return Model(languages, weights)


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """``(host, domain, suffix)`` of a URL: its domain is the last two labels of the host name, its suffix a
    path segment that is a language code, or else the host's last label; nulls where there is no host."""
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    segment = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2})(?=[/?#]|$)", 1))
    last = F.element_at(F.split(host, r"\."), -1)
    return host, F.element_at(F.regexp_extract_all(host, F.lit(r"([^.]+\.[^.]+)$"), F.lit(1)), 1), F.when(segment != "", F.concat(F.lit("/"), segment)).otherwise(F.concat(F.lit("."), last))


def declared_language(html: Column) -> Column:
    """The two- or three-letter code that the html element declares, null if none."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^<>]*?\slang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return F.when(found != "", found)


def _votes(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """Votes for each language (an array in model order) per value of ``by``."""
    sums = [F.sum((F.col("vote") == i).cast("long")) for i in range(n)]
    return rows.groupBy(*by).agg(F.array(*sums).alias("votes"))


def _log_prior(parts: list[tuple[Column, float]], own: Column, n: int) -> Column:
    """Log prior per language: vote arrays from the narrowest group to the widest, each shrunk to the next."""
    prior = F.array_repeat(F.lit(1.0 / n), n)
    for votes, strength in reversed(parts):
        safe = F.coalesce(votes, F.array_repeat(F.lit(0).cast("long"), n))
        others = F.transform(safe, lambda v, i: F.greatest(v - F.when(i == own, 1).otherwise(0), F.lit(0)).cast("double"))
        total = F.aggregate(others, F.lit(0.0), lambda a, v: a + v)
        prior = F.zip_with(others, prior, lambda v, p: (v + strength * p) / (total + strength))  # noqa: B023
    return F.transform(prior, lambda p: F.log(p))


def _evidence(rows: DataFrame, column: str, n: int) -> DataFrame:
    """``column, ev_<column>``: log probability of each seen value given each language, smoothed."""
    votes = staged(_votes(rows.where(F.col(column).isNotNull()), [column], n), "evidence")
    totals = votes.agg(F.count("*").alias("values"), *[F.sum(F.element_at("votes", i + 1)).alias(f"t{i}") for i in range(n)]).first()
    values = totals["values"] or 1
    logs = [F.log((F.element_at("votes", i + 1) + EVIDENCE_PRIOR) / ((totals[f"t{i}"] or 0) + EVIDENCE_PRIOR * (values + 1))) for i in range(n)]
    return votes.select(F.col(column), F.array(*logs).alias(f"ev_{column}"))


def identify(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep``, lang, probability and text_lang of ``rows`` with columns text, declared, suffix, host, domain.

    All evidence may be null and then says nothing; a row with no evidence at all gets the commonest
    language of the corpus. Ties go to the first code. Repeated rows are judged one by one.
    """
    n = len(model.languages)
    schema_of = lambda c: rows.schema[c].dataType.simpleString()
    if n == 0:
        none = F.lit(None)
        return rows.select(*keep, none.cast("string").alias("lang"), none.cast("double").alias("probability"), none.cast("string").alias("text_lang"))
    bounded_batches(rows.sparkSession)
    shipped = rows.sparkSession.sparkContext.broadcast(model)
    side = [*keep, "declared", "suffix", "host", "domain"]

    def score(batches):
        for batch in batches:
            told = [shipped.value.likelihoods(t) for t in batch.column(len(side)).to_pylist()]
            votes = [int(np.argmax(x)) if any(x) else None for x in told]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(side))], pa.array(told, pa.list_(pa.float64())), pa.array(votes, pa.int32())], names=[*side, "told", "vote"])

    kinds = ", ".join(f"`{c}` {schema_of(c)}" for c in side)
    scores = staged(rows.select(*side, "text").mapInArrow(score, f"{kinds}, told array<double>, vote int"), "scores")
    voted = scores.where(F.col("vote").isNotNull())
    hosts = _votes(voted.where(F.col("host").isNotNull()), ["host"], n).withColumnRenamed("votes", "host_votes")
    domains = _votes(voted.where(F.col("domain").isNotNull()), ["domain"], n).withColumnRenamed("votes", "domain_votes")
    everything = voted.agg(*[F.sum((F.col("vote") == i).cast("long")).alias(f"v{i}") for i in range(n)]).first()
    whole = F.array(*[F.lit(everything[f"v{i}"] or 0).cast("long") for i in range(n)])
    out = scores.join(hosts, "host", "left").join(domains, "domain", "left")
    for column in ("declared", "suffix"):
        out = out.join(_evidence(voted, column, n), column, "left")
    prior = _log_prior([(F.col("host_votes"), HOST_STRENGTH), (F.col("domain_votes"), DOMAIN_STRENGTH), (whole, 1.0)], F.col("vote"), n)
    total = prior
    for piece in ("told", "ev_declared", "ev_suffix"):
        total = F.zip_with(total, F.coalesce(piece, F.array_repeat(F.lit(0.0), n)), lambda a, b: a + b)
    codes = F.array(*[F.lit(x) for x in model.languages])
    out = out.select(*keep, "vote", total.alias("logs")).withColumn("top", F.array_max("logs"))
    mass = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return out.select(*keep, F.element_at(codes, F.array_position("logs", F.col("top")).cast("int")).alias("lang"), (1 / mass).alias("probability"), F.when(F.col("vote").isNotNull(), F.element_at(codes, F.col("vote") + 1)).alias("text_lang"))


def page_rows(pages: DataFrame) -> DataFrame:
    pages = fields(pages, page_id="long", url="string", html="string")
    host, domain, suffix = address_parts(F.col("url"))
    return pages.select(
        F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), "page_id", F.col("html").alias("text"), declared_language(F.col("html")).alias("declared"), suffix.alias("suffix"), host.alias("host"), domain.alias("domain")
    )


def document_rows(docs: DataFrame) -> DataFrame:
    docs = fields(docs, doc_id="long", text="string", lang="string", source="string")
    none = F.lit(None).cast("string")
    return docs.select(F.lit("document").alias("kind"), "doc_id", F.lit(None).cast("long").alias("page_id"), "text", label_code(F.col("lang")).alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))


def language_digest(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Per document and page: kind, doc_id (null for pages), page_id (null for documents), lang, probability, text_lang.

    The text models come from all documents with a language code for a label, in any case and with or without a region. Documents declare that
    label and have their source for a host; pages declare what their markup says and have an address.
    Empty tables add no rows; without any label all languages are null. Other columns are ignored.
    """
    model = fit(fields(docs, text="string", lang="string"))
    return identify(document_rows(docs).unionByName(page_rows(pages)), model, ["kind", "doc_id", "page_id"])
