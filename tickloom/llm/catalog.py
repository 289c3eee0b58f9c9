"""Registered queries of the text operators, each over its whole table, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import decontam, jaccard, language, licenses, merkle, mixing, packing, pii, repeats, rules, runs, tokens, warc

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_string_tiling")
def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_language_evidence")
def op2_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


# one slot a step: of the released next blocks, the one with the least (deadline, release, source)
_MIX_SQL = f"""WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
shares AS (SELECT source, greatest(1, CAST(round(sqrt(n) * ({mixing.SHARES_WANTED} / (SELECT sum(sqrt(n)) FROM sizes))) AS BIGINT)) AS share,
    row_number() OVER (ORDER BY source NULLS FIRST) AS k FROM sizes),
whole AS (SELECT list(CAST(share AS BIGINT) ORDER BY k) AS s, CAST(sum(share) AS BIGINT) AS frame FROM shares),
slots AS (SELECT CAST(-1 AS BIGINT) AS slot, list_transform(s, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM whole
    UNION ALL SELECT slot, list_transform(done, lambda x, i: x + CASE WHEN i = pick THEN 1 ELSE 0 END), pick FROM (
    SELECT slot + 1 AS slot, done, list_min(list_transform(done, lambda n, i: CASE WHEN n * frame < (slot + 2) * s[i]
        THEN ((((n + 1) * frame + s[i] - 1) // s[i]) * 10000 + (n * frame) // s[i]) * 10000 + i END)) % 10000 AS pick
    FROM slots CROSS JOIN whole WHERE slot + 1 < frame)),
turns AS (SELECT pick AS k, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS nth FROM slots WHERE slot >= 0),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents),
dealt AS (SELECT doc_id, r.source, share, k, r, r // {mixing.BLOCK_ROWS} AS block FROM ranked r JOIN shares ON shares.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, share, block, slot + (block // share) * frame AS slot, (block * frame) // share AS release, ((block + 1) * frame + share - 1) // share AS deadline,
    (slot + (block // share) * frame) * {mixing.BLOCK_ROWS} + r % {mixing.BLOCK_ROWS} AS position
FROM dealt JOIN turns ON turns.k = dealt.k AND turns.nth = dealt.block % dealt.share CROSS JOIN whole"""


@query("op3_pfair_mixing", _MIX_SQL)
def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


_SPACE = r"\x20\x09-\x0D"
_RULES_SQL = rf"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^{_SPACE}]+') AS words FROM t),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
    WHERE regexp_matches(line, '[^{_SPACE}]') GROUP BY doc_id),
counts AS (SELECT w.doc_id, source, len(words) AS n_words, length(regexp_replace(text, '[{_SPACE}]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
    FROM w LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN covered ON covered.doc_id = w.doc_id),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
hosts AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS f FROM judged GROUP BY source),
m AS (SELECT greatest(least(sum(f) / sum(n), 1 - 1e-6), 1e-6) AS mean, coalesce(var_samp(f / n), 0) AS spread, avg(1 / n) AS noise FROM hosts),
prior AS (SELECT mean, CASE WHEN spread - mean * (1 - mean) * noise > 0
    THEN least(greatest(mean * (1 - mean) / (spread - mean * (1 - mean) * noise) - 1, 1.0), 1e6) ELSE 1.0 END AS size FROM m),
rates AS (SELECT source, n + size AS total, (f + mean * size) / (n + size) AS rate FROM hosts CROSS JOIN prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (rate - 2 * sqrt(rate * (1 - rate) / (total + 1)) > 0.5) AS kept, round(rate, 6) AS host_rate
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source"""


@query("op4_host_rules", _RULES_SQL)
def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_digest(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    rows = []
    for t in licenses.standard_templates():
        n = len(t.words) - licenses.K + 1
        rows += [f"('{t.name}', '{t.label}', {t.whole}, {n}, {j}, '{' '.join(t.words[j : j + licenses.K])}')" for j in range(n)]
    return rf"""WITH templates(template, label, whole, windows, j, gram) AS (VALUES {', '.join(rows)}),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{licenses.WORD}') AS words FROM documents),
grams AS (SELECT doc_id, i - 1 AS i, array_to_string(words[i:i + 2], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
hits AS (SELECT doc_id, template, label, whole, windows, j, i, i - j AS diagonal FROM grams JOIN templates USING (gram)),
diagonals AS (SELECT DISTINCT doc_id, template, whole, diagonal FROM hits),
steps AS (SELECT *, whole OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {licenses.DRIFT}, true) AS begins FROM diagonals),
merged AS (SELECT *, sum(begins::INTEGER) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS passage FROM steps),
spans AS (SELECT h.doc_id, h.template, h.label, h.whole, count(DISTINCT j) AS found, max(windows) AS windows, min(i) AS first_word FROM hits h
    JOIN merged m ON m.doc_id = h.doc_id AND m.template = h.template AND m.diagonal = h.diagonal GROUP BY h.doc_id, h.template, h.label, h.whole, m.passage),
good AS (SELECT *, found::DOUBLE / windows AS covered FROM spans WHERE found = windows OR (NOT whole AND found::DOUBLE / windows >= {licenses.COVERAGE})),
told AS (SELECT doc_id, count(*) FILTER (WHERE whole) AS n_base, min(first_word) FILTER (WHERE whole) AS first_word, max(first_word) FILTER (WHERE whole) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE whole) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered) AS score FROM good GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN told ON told.doc_id = w.doc_id"""


@query("op5_license_scan", _license_sql())
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(table(spark, sf_dir, "documents"))


@query("op6_ngram_jaccard")
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_digest(table(spark, sf_dir, "documents"))


@query("op7_personal_data")
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digest(table(spark, sf_dir, "documents"), tokens.tokenizer_path())


@query(
    "op9_warc_archive",
    """SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY html) THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY html) THEN max(page_id) OVER (PARTITION BY html) END AS refers_to
    FROM pages""",
)
def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_digest(table(spark, sf_dir, "pages"))


@query("op10_repeated_strings")
def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digest(table(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(table(spark, sf_dir, "documents"))


@query("op12_grouped_packing")
def op12_grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(table(spark, sf_dir, "documents"), packing.tokenizer_path())


def _merkle_sql() -> str:
    def part(value: str) -> str:
        return f"coalesce(strlen({value}) || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        return "sha256(concat(" + ", ".join([part("doc_id::VARCHAR"), part("source"), part("lang"), part("n_chars::VARCHAR"), part(text)]) + "))"

    # CRC-32 of the digits, bit by bit: every ninth step takes in a byte
    crc = """xor(list_reduce(range(0, 9 * length(doc_id::VARCHAR)), lambda c, i: CASE WHEN i % 9 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, i // 9 + 1, 1))::BIGINT)
    WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, 4294967295), 4294967295)"""
    sides = """coalesce(string_agg(h, '') OVER (PARTITION BY {0} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY {0} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"""
    return f"""WITH RECURSIVE hashed AS (SELECT doc_id, lang, {leaf('text')} AS leaf,
    {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low, {crc} % 3 = 0 AS changed FROM documents),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes AS (SELECT tree, 0 AS level, pos, n, leaf AS h FROM leaves
    UNION ALL SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8, n),
upper AS (SELECT 0 AS level, tree AS pos, (SELECT count(DISTINCT tree) FROM leaves) AS n, h FROM nodes WHERE n = 1
    UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 8, n),
low_sides AS (SELECT tree, level, pos, {sides.format('tree, level, pos // 8')} FROM nodes WHERE n > 1),
up_sides AS (SELECT level, pos, {sides.format('level, pos // 8')} FROM upper WHERE n > 1),
low_proof AS (SELECT a.tree, a.pos, string_agg(l || r, '' ORDER BY s.level) AS p FROM leaves a JOIN low_sides s ON s.tree = a.tree AND s.pos = a.pos // power(8, s.level)::BIGINT GROUP BY a.tree, a.pos),
up_proof AS (SELECT t.tree, string_agg(l || r, '' ORDER BY s.level) AS p FROM (SELECT DISTINCT tree FROM leaves) t JOIN up_sides s ON s.pos = t.tree // power(8, s.level)::BIGINT GROUP BY t.tree),
low_fold AS (SELECT tree, pos AS own, 0 AS level, pos, CASE WHEN changed THEN low ELSE leaf END AS h FROM leaves
    UNION ALL SELECT f.tree, own, f.level + 1, f.pos // 8, sha256(l || h || r) FROM low_fold f JOIN low_sides s ON s.tree = f.tree AND s.level = f.level AND s.pos = f.pos),
up_fold AS (SELECT tree, own, 0 AS level, tree AS pos, h FROM low_fold WHERE NOT EXISTS (SELECT 1 FROM low_sides s WHERE s.tree = low_fold.tree AND s.level = low_fold.level)
    UNION ALL SELECT f.tree, own, f.level + 1, f.pos // 8, sha256(l || h || r) FROM up_fold f JOIN up_sides s ON s.level = f.level AND s.pos = f.pos),
ends AS (SELECT tree, own, arg_max(h, level) AS h FROM up_fold GROUP BY tree, own)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(coalesce(lp.p, '') || coalesce(up.p, '')) AS proof_sha256, e.h AS folded_root, e.h = top.h AS verified
FROM leaves a JOIN nodes sub ON sub.tree = a.tree AND sub.n = 1 CROSS JOIN (SELECT h FROM upper WHERE n = 1) top JOIN ends e ON e.tree = a.tree AND e.own = a.pos
LEFT JOIN low_proof lp ON lp.tree = a.tree AND lp.pos = a.pos LEFT JOIN up_proof up ON up.tree = a.tree"""


@query("op13_merkle_manifest", _merkle_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_digest(table(spark, sf_dir, "documents"))
