"""Personal data in texts: fixed patterns, and a character tagger for what they do not spell out.

The tagger (``tagger.Tagger``, a bidirectional LSTM with CRF transitions) is trained on labelled spans:
pattern matches in a bounded sample of documents and generated variants of them (masked addresses,
numbers in other layouts, look-alikes that are no personal data). A tagged span is kept only if it has the
parts of its kind, so it always holds an anchor - a digit, an at sign, a bracketed "at" or "dot", or the word
"dot" - and the tagger reads from the anchors outwards: the whole of whatever may be a masked address, and on
for as long as a span reaches the edge of what was read. Overlapping windows are scored, their scores are
averaged by how central a character is, and one best path per stretch reconciles them. A tagged address
has the bounds of its whole local part and host. Pattern matches always stay; tagged spans are added where they meet none.
"""

from __future__ import annotations

import pickle
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import bounded_batches, fields, sample_keys
from tickloom.llm.tagger import KINDS, WIDTH, Tagger, encode

#: Bounds of the training sample: documents with an anchor, and windows from each of them.
TRAIN_DOCS = 400
WINDOWS_PER_DOC = 3
GENERATED = 900
LONG_GENERATED = 1200
#: Characters read at first on either side of an anchor or a masked address, and the outermost ones that
#: have to be outside of spans, or more is read; the step between overlapping windows.
REACH = 28
EDGE = 8
STEP = 32
#: Windows scored at a time.
SCORED_AT_ONCE = 1024

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"(?i)[0-9@]|[\[(] ?(?:at|dot) ?[\])]| dot ")
_AT = re.compile(r"(?i) ?[\[(] ?at ?[\])] ?| @ ?|@ | at ")
_DOT = r"(?: ?[\[(] ?dot ?[\])] ?| dot )"
_DOT_BEFORE = re.compile(f"(?i){_DOT}$")
_SPELLED_DOT = re.compile(f"(?i){_DOT}")
_HOST = re.compile(rf"(?i)[a-z0-9-]+(?:(?:\.|{_DOT})[a-z0-9-]+)*(?:\.|{_DOT})[a-z]{{2,}}(?![a-z0-9])")
_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def pattern_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns by start, then kind; leftmost and not overlapping within a kind."""
    if not _ANCHOR.search(text):
        return []
    found: list[Span] = []
    # every address holds an at sign, so the search goes from one to the next instead of trying every start
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            found.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.sub("", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --- training data -------------------------------------------------------------------------------


def _variant(rng: random.Random) -> tuple[str, int | None]:
    """A string and its kind: personal data in some layout, or a look-alike without a kind."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 9)))
    host = "".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randint(3, 8)))
    kind = rng.choice([0, 0, 1, 2, 3, 3, None, None, None])
    if kind == 0:
        at = rng.choice(["@", "@", " [at] ", "(at)", " (at) ", "[at]", " @ "])
        dot = rng.choice([".", "."]) if at == "@" else rng.choice([".", " [dot] ", "[dot]", " (dot) "])
        return f"{name}{rng.choice(['', '.', '_'])}{digits(rng.randint(0, 2))}".rstrip("._") + at + host + dot + rng.choice(["com", "org", "net", "de"]), 0
    if kind == 1:
        dot = rng.choice([".", ".", "[.]", " . "])
        return dot.join(str(rng.randint(0, 255)) for _ in range(4)), 1
    if kind == 2:
        body = "4" + digits(14)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        gap = rng.choice(["", " ", "-", ".", "_"])
        return gap.join(number[i : i + 4] for i in range(0, 16, 4)), 2
    if kind == 3:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {a} {b}{c}", f"00{a[:2]} {b} {c}{a}", f"tel. {a}.{b}.{c}"[5:]]), 3
    return rng.choice(
        [
            f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", digits(rng.randint(1, 6)), f"v{rng.randint(0, 9)}.{rng.randint(0, 99)}",
            f"token={''.join(rng.choice('0123456789abcdef') for _ in range(rng.randint(16, 40)))}", "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16)),
            f"{rng.randint(1, 99)}.{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", f"{rng.randint(300, 999)}.{rng.randint(300, 999)}.1.2", f"{rng.randint(0, 23)}:{digits(2)}", f"Version {digits(1)}.0", f"@{name}",
        ]
    ), None


def _long_variant(rng: random.Random) -> tuple[str, int | None]:
    """A masked address with long parts or spelled-out signs, or words that look like one, and its kind."""
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(a, b)))
    parts = lambda n, gaps: "".join(x + rng.choice(gaps) for x in [word(3, 12) for _ in range(n - 1)]) + word(3, 12)
    if rng.random() < 0.25:
        return rng.choice([f"{word(3, 8)} at {word(3, 8)}", f"{word(3, 8)} dot {word(3, 8)}", f"at {word(2, 5)} the dot {word(3, 8)}", f"{word(3, 8)} at the {word(3, 8)}.", f"{word(2, 6)} (dot) {word(3, 7)}"]), None
    at = rng.choice([" at "] * 6 + [" [at] ", "[at]", " (at) ", "(at)"])
    dot = rng.choice([" dot ", " dot ", " dot ", " [dot] ", " (dot) "] if at == " at " else [" dot ", " [dot] ", "[dot]", " (dot) ", "."])
    host = parts(rng.choice([1, 1, 1, 2, 3]), ["-", ".", dot])
    return parts(rng.choice([1, 1, 1, 2, 3]), [".", "_", "-"]) + at + host + dot + rng.choice(["com", "org", "net", "de", "edu", "uk"]), 0


def _window(text: str, spans: list[Span], start: int) -> tuple[np.ndarray, np.ndarray]:
    codes, gold = np.zeros(WIDTH, np.int64), np.zeros(WIDTH, np.int64)
    part = encode(text[start : start + WIDTH])
    codes[: len(part)] = part
    for s, k, e in spans:
        a, b = max(s - start, 0), min(e - start, WIDTH)
        if a < b:
            gold[a:b] = 2 + 2 * k
            if s >= start:
                gold[a] = 1 + 2 * k
    return codes, gold


def training_windows(contexts: list[str], n: int = GENERATED, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: pattern matches inside the contexts, and generated strings set into them."""
    rng, out = random.Random(seed), []
    plain = [c for c in contexts if not _ANCHOR.search(c)] or ["lorem ipsum dolor sit amet, consectetur adipiscing elit sed do eiusmod tempor"]
    for c in contexts:
        spans = pattern_spans(c)
        out.append(_window(c, spans, max(0, (len(c) - WIDTH) // 2)))
    for turn in range(n + LONG_GENERATED):
        left, right = rng.choice(plain), rng.choice(plain)
        inner, kind = _variant(rng) if turn < n else _long_variant(rng)
        left = left[: rng.randint(0, WIDTH)] + rng.choice([" ", " ", ", ", ": ", "\n"])
        text = left + inner + rng.choice([" ", " ", ". ", ", ", "\n"]) + right
        spans = [] if kind is None else [(len(left), kind, len(left) + len(inner))]
        out.append(_window(text, spans, max(0, len(left) + len(inner) // 2 - rng.randint(8, WIDTH - 8))))
    codes, gold = zip(*out, strict=True)
    return np.stack(codes), np.stack(gold)


def sample_contexts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``c``: stretches around anchors, and one plain stretch, of ``TRAIN_DOCS`` documents in the order of a hash of the key.

    The sample is bounded by ``TRAIN_DOCS`` and ``WINDOWS_PER_DOC``; it is as large however rare anchors are.
    """
    eligible = docs.where(F.col(text).rlike("[0-9@]"))
    ids = sample_keys(eligible, key, TRAIN_DOCS, eligible.count(), 64)

    def cut(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits, last = [], -WIDTH
                for m in _ANCHOR.finditer(t):
                    if m.start() >= last + WIDTH:
                        last = m.start()
                        hits.append(t[max(0, last - WIDTH // 3) : last + WIDTH])
                    if len(hits) == WINDOWS_PER_DOC:
                        break
                rows += [(k, i, h) for i, h in enumerate([t[:WIDTH], *hits])]
            yield pa.RecordBatch.from_pydict({"k": pa.array([r[0] for r in rows], pa.int64()), "i": pa.array([r[1] for r in rows], pa.int64()), "c": pa.array([r[2] for r in rows], pa.string())})

    rows = docs.where(F.col(key).isin(ids) & F.col(text).rlike("[0-9@]")).select(F.col(key).cast("long"), text)
    return rows.mapInArrow(cut, "k long, i long, c string").orderBy("k", "i", "c").limit(TRAIN_DOCS * (WINDOWS_PER_DOC + 1)).select("c")


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Tagger:
    """A tagger fitted to the documents' sample; with no usable documents it learns from generated strings alone.

    The sample is bounded, so one task fits it; only the weights come to the driver.
    """
    bounded_batches(docs.sparkSession)

    def fit(batches):
        contexts = sorted(c for batch in batches for c in batch.column(0).to_pylist() if c is not None)
        tagger = Tagger()
        tagger.fit(*training_windows(contexts))
        yield pa.RecordBatch.from_pydict({"tagger": [pickle.dumps(tagger)]})

    nothing = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("c"))
    return pickle.loads(sample_contexts(docs, key, text).union(nothing).coalesce(1).mapInArrow(fit, "tagger binary").first()["tagger"])


# --- reading texts -------------------------------------------------------------------------------


def masked_addresses(text: str) -> list[tuple[int, int]]:
    """Bounds of whatever has the form of a masked address: local part, a masked at, host with a dot.

    A plain " at " counts only before a host with a spelled-out dot. Parts may have any length.
    """
    out: list[tuple[int, int]] = []
    done, at = 0, _AT.search(text)
    while at:
        host = _HOST.match(text, at.end())
        start = at.start()
        while start > done:
            if text[start - 1] in _LOCAL:
                start -= 1
            elif start < at.start() and (dot := _DOT_BEFORE.search(text, max(done, start - 9), start)) and dot.start() > done and text[dot.start() - 1] in _LOCAL:
                start = dot.start()
            else:
                break
        if host and start < at.start() and (at.group().lower() != " at " or _SPELLED_DOT.search(host.group())):
            done = host.end()
            out.append((start, done))
        at = _AT.search(text, max(at.start() + 1, done))
    return out


def _merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def stretches(text: str, addresses: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Merged surroundings of the anchors and masked addresses, ``REACH`` characters to either side."""
    hits = [(m.start(), m.end()) for m in _ANCHOR.finditer(text)]
    return _merged([(max(0, a - REACH), min(len(text), b + REACH)) for a, b in [*hits, *addresses]])


_CENTRAL = (1.0 - np.abs(np.arange(WIDTH) - (WIDTH - 1) / 2) / WIDTH).astype(np.float32)


def _tag(tagger: Tagger, parts: list[str]) -> list[np.ndarray]:
    """Labels of every stretch: window scores, weighted by centrality, then one best path per stretch."""
    owners, starts, codes = [], [], []
    for i, p in enumerate(parts):
        code = encode(p)
        last = max(0, len(code) - WIDTH)
        for s in sorted({*range(0, last, STEP), last}):
            w = np.zeros(WIDTH, np.int64)
            piece = code[s : s + WIDTH]
            w[: len(piece)] = piece
            owners.append(i)
            starts.append(s)
            codes.append(w)
    total = [np.zeros((len(p), 1 + 2 * len(KINDS)), np.float32) for p in parts]
    weight = [np.zeros((len(p), 1), np.float32) for p in parts]
    for at in range(0, len(codes), SCORED_AT_ONCE):
        scores = tagger.scores(np.stack(codes[at : at + SCORED_AT_ONCE]))
        for i, s, sc in zip(owners[at : at + SCORED_AT_ONCE], starts[at : at + SCORED_AT_ONCE], scores, strict=True):
            n = min(WIDTH, len(parts[i]) - s)
            total[i][s : s + n] += _CENTRAL[:n, None] * sc[:n]
            weight[i][s : s + n] += _CENTRAL[:n, None]
    labels: list[np.ndarray] = [np.zeros(0, np.int8)] * len(parts)
    order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
    at = 0
    while at < len(order):
        # stretches of like length go through the best path together
        end, longest = at + 1, len(parts[order[at]])
        while end < len(order) and len(parts[order[end]]) <= longest + WIDTH and end - at < SCORED_AT_ONCE:
            end += 1
        size = len(parts[order[end - 1]])
        padded = np.zeros((end - at, size, 1 + 2 * len(KINDS)), np.float32)
        padded[:, :, 0] = 1
        for row, i in enumerate(order[at:end]):
            padded[row, : len(parts[i])] = total[i] / weight[i]
        for row, path in enumerate(tagger.best_path(padded)):
            i = order[at + row]
            labels[i] = path[: len(parts[i])]
        at = end
    return labels


_MASKED = re.compile(r"(?:@|[\[(] ?at ?[\])]).*(?:\.|[\[(] ?dot ?[\])]| dot ) ?[A-Za-z]{2}| at .*(?:[\[(] ?dot ?[\])]| dot ) ?[A-Za-z]{2}", re.DOTALL | re.IGNORECASE)


def _plausible(kind: int, text: str, start: int, end: int) -> bool:
    """Whether a tagged span can be what it is tagged as: it stands free, and has the parts or digits of its kind."""
    found = text[start:end]
    if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum():
        return False
    numbers = [int(x[-4:]) for x in _DIGITS.split(found) if x]
    digits = len(_DIGITS.sub("", found))
    return [bool(_MASKED.search(found)), len(numbers) == 4 and max(numbers) <= 255, 14 <= digits <= 19, 7 <= digits <= 15][kind]


def _spans_of(labels: np.ndarray) -> list[Span]:
    out, start = [], None
    for i, x in enumerate(labels):
        if start is not None and x != 2 + 2 * start[1]:
            out.append((start[0], start[1], i))
            start = None
        if x and x % 2:
            start = (i, (x - 1) // 2)
    if start is not None:
        out.append((start[0], start[1], len(labels)))
    return [(int(a), int(k), int(b)) for a, k, b in out]


def _read(tagger: Tagger, texts: list[str], wanted: list[list[tuple[int, int]]]) -> list[list[tuple[int, np.ndarray]]]:
    """``(start, labels)`` of the stretches of every text, which grow until no span reaches their edges."""
    known: dict[tuple[int, int, int], np.ndarray] = {}
    while todo := [(i, a, b) for i, parts in enumerate(wanted) for a, b in parts if (i, a, b) not in known]:
        for at, labels in zip(todo, _tag(tagger, [texts[i][a:b] for i, a, b in todo]), strict=True):
            known[at] = labels
        for i in {i for i, _, _ in todo}:
            # twice as long each time, so that what is read stays in proportion to what there is
            grown = []
            for a, b in wanted[i]:
                labels = known[i, a, b]
                grown.append((max(0, a - (b - a)) if labels[:EDGE].any() else a, min(len(texts[i]), b + (b - a)) if labels[-EDGE:].any() else b))
            wanted[i] = _merged(grown)
    return [[(a, known[i, a, b]) for a, b in parts] for i, parts in enumerate(wanted)]


def all_spans(texts: list[str], tagger: Tagger, whole: bool = False) -> list[tuple[list[Span], list[Span]]]:
    """Pattern spans and added spans of every text; with ``whole`` the tagger reads every character."""
    base = [pattern_spans(t) for t in texts]
    masked = [masked_addresses(t) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    wanted = [[(0, len(t))] if t else [] for t in texts] if whole else [stretches(t, m) for t, m in zip(texts, masked, strict=True)]
    for i, parts in enumerate(_read(tagger, texts, wanted)):
        for a, labels in parts:
            for s, k, e in _spans_of(labels) if labels.any() else []:
                s, e = s + a, e + a
                address = [(x, y) for x, y in masked[i] if x < e and s < y] if k == 0 else []
                for x, y in address or [(s, e)]:
                    free = not any(p < y and x < q for p, _, q in base[i] + added[i])
                    if free and _plausible(k, texts[i], x, y):
                        added[i].append((x, k, y))
    return list(zip(base, added, strict=True))


def personal_spans(docs: DataFrame, tagger: Tagger, keep: list[str], text: str = "text", whole: bool = False) -> DataFrame:
    """The columns ``keep``, and ``base`` and ``added``: arrays of (kind, start, end) in code points.

    Null texts count as empty; repeated rows are read one by one. Patterns are searched in whole texts, the
    tagger reads the surroundings of anchors and of masked addresses (see ``stretches``), or with ``whole`` every
    character, which takes many times as long.
    """
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(tagger)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("base", span), T.StructField("added", span)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    columns = list(dict.fromkeys([*keep, text]))

    def read(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(columns.index(text)).to_pylist()]
            found = all_spans(texts, shipped.value, whole)
            told = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x[j]] for x in found], arrow) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(columns.index(c)) for c in keep] + told, names=[*keep, "base", "added"])

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(read, schema)


def pii_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of pattern spans by kind, base_sha256, spans (pattern and added), n_added.

    Null and empty texts have no spans; texts of any length are searched whole by the patterns; spans that start
    together stand in the order of their kinds; repeated rows give repeated results, an empty table none.
    """
    docs = fields(docs, doc_id="long", text="string")
    found = personal_spans(docs, train(docs), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    line = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    both = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(both).alias("spans"), F.size("added").cast("long").alias("n_added")
    )


def redact(docs: DataFrame, tagger: Tagger, text: str = "text", whole: bool = False) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in angle brackets; other columns unchanged.

    Overlapping spans of different kinds are replaced as one, under the kind that begins first. Null texts stay null.
    ``whole`` as in ``personal_spans``.
    """
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(tagger)
    at = docs.columns.index(text)

    def clean(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = []
            for t, (base, added) in zip(texts, all_spans([t or "" for t in texts], shipped.value, whole), strict=True):
                parts, done = [], 0
                for s, k, e in sorted(base + added):
                    if s >= done:
                        parts += [t[done:s], f"<{KINDS[k].upper()}>"]
                    done = max(done, e)
                out.append(t if t is None else "".join([*parts, t[done:]]))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(clean, docs.schema)
