"""Token counts: a broadcast table of frequent pre-token lengths, worker caches for the rest.

A pre-token here is a run of white space with the run of other characters behind it. Byte-level
pre-tokenizers never join a character with white space that follows it, and special tokens hold no
white space, so a text's token count is the sum over these pieces, and a piece's count can be looked
up. A missed piece is cut by the tokenizer's own pattern and its parts are looked up before any is encoded. No piece is ever shuffled: frequent ones are in a table of bounded size that every task gets,
the others are encoded in the task that meets them and kept in a bounded cache of its worker.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import bounded_batches, fields, sample_keys

#: Bounds of the first tier, whose content only affects speed: texts read for it, and entries.
TABLE_TEXTS = 512
TABLE_ENTRIES = 20_000
#: Bounds of the second tier: entries a worker keeps, and the longest piece that is kept.
CACHE_ENTRIES = 400_000
CACHE_CHARS = 64
#: Characters of a text that are cut up at a time.
SLICE_CHARS = 1 << 20

_UNSAFE = re.compile(r"\s | \s")
_CUT = re.compile(r"(?<=\S)(?= )")

_worker: dict = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(text: str) -> Iterator[str]:
    """The text in slices of about ``SLICE_CHARS``, cut only where a piece begins."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        cut = _CUT.search(text, at + SLICE_CHARS)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def pieces(text: str) -> list[str]:
    """Pre-tokens of a text: it is cut before each space that follows something other than white space."""
    if not text:
        return []
    if _UNSAFE.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    out = [" " + x for x in rest]
    if first:
        return [first, *out]
    return out


class Encoder:
    """Token counts of pre-tokens by the library's own model, with a bounded cache in front."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        # the printable stand-ins of the 256 bytes, as byte-level models spell them
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.spelling = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.cache: dict[str, int] = {}

    def _model(self, token: str) -> int:
        return len(self.tokenizer.model.tokenize(token.encode().decode("latin-1").translate(self.spelling)))

    def length(self, piece: str, table: dict[str, int]) -> int:
        """Tokens of one piece: its pre-tokens are looked up, the unknown ones encoded and kept."""
        if any(s in piece for s in self.special):
            return len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        cache, total = self.cache, 0
        for token in self.split(piece):
            n = table.get(token) or cache.get(token)
            if n is None:
                n = self._model(token)
                if len(token) <= CACHE_CHARS:
                    cache[token] = n
            total += n
        if len(piece) <= CACHE_CHARS:
            cache[piece] = total
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        return total

    def count(self, text: str, table: dict[str, int]) -> int:
        total = 0
        for part in slices(text):
            found = pieces(part)
            known = list(map(table.get, found))
            for i, n in enumerate(known):
                total += n or self.cache.get(found[i]) or self.length(found[i], table)
        return total


def _encoder(path: str) -> Encoder:
    """The worker's encoder: tasks that run one after the other in a worker share its cache."""
    if path not in _worker:
        _worker.clear()
        _worker[path] = Encoder(path)
    return _worker[path]


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> dict[str, int]:
    """First tier: token counts of the commonest pieces of ``TABLE_TEXTS`` texts spread by a hash of the key."""
    ids = sample_keys(docs, key, TABLE_TEXTS, docs.count(), 8)
    if not ids:
        return {}

    def counts(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for part in slices(t or ""):
                    seen.update(p for p in pieces(part) if len(p) <= CACHE_CHARS)
        top = seen.most_common(TABLE_ENTRIES)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    found = docs.where(F.col(key).isin(ids)).select(text).mapInArrow(counts, "piece string, n long")
    rows = found.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(TABLE_ENTRIES).collect()
    encoder = Encoder(path)
    return {r["piece"]: encoder.length(r["piece"], {}) for r in rows}


def token_counts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 512) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Null and empty texts count 0 bytes and 0 tokens; repeated rows and null keys are kept as they are;
    an empty table gives an empty result. Special-token strings inside texts are handled as the
    tokenizer file says (its default). No text is cut off.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, text, key))
    kind = docs.schema[key].dataType.simpleString()

    def count(batches):
        encoder, known = _encoder(path), table.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [encoder.count(t, known) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def token_digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""
    return token_counts(fields(docs, doc_id="long", text="string"), path)
