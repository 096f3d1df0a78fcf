"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legwise.llm import (
    binary_search, language, manifest, mixing, near_dedup, ngrams, packing, page_text, quality_rules, spans, toxicity,
    vector_links, whitening,
)
from legwise.llm.text import id_remainder, read

QUERIES = {}
SQL = {}


def query(build):
    """Register a function of (spark, folder) under its own name."""
    QUERIES[build.__name__] = build
    return build


@query
def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-copy component of every document."""
    found = near_dedup.near_groups(read(spark, folder, "documents"))
    return found.select("doc_id", near_dedup.fingerprint_text().alias("fingerprint"), "component_id")


@query
def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return page_text.extract(read(spark, folder, "pages"))


@query
def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document under a backoff automaton."""
    return ngrams.score(read(spark, folder, "documents"))


@query
def op4_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest sign codes of every fiftieth vector, among all vectors."""
    vectors = read(spark, folder, "embeddings")
    found = binary_search.search(vectors, vectors.where("vec_id % 50 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


SQL["op4_exact_topk"] = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    list_sum(list_transform(generate_series(1, 64), lambda i: CASE
      WHEN coalesce(q.embedding[i] > 0, false) <> coalesce(v.embedding[i] > 0, false) THEN 1 ELSE 0 END)) AS distance
  FROM embeddings q, embeddings v
  WHERE q.vec_id % 50 = 0 AND q.embedding IS NOT NULL AND v.embedding IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance
FROM ranked WHERE rank <= 10
"""


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules.judge(read(spark, folder, "documents"))


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the ids outside one residue class."""
    docs = read(spark, folder, "documents")
    machine = toxicity.train(docs.where(id_remainder(5) != 0), read(spark, folder, "labels"))
    scored = toxicity.predict(docs, machine)
    return scored.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its sequence."""
    return packing.pack(read(spark, folder, "documents"))


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the ids outside one residue class."""
    docs = read(spark, folder, "documents")
    model = language.train(docs.where(id_remainder(5) != 0))
    named = language.predict(docs, model, keep=(F.col("doc_id"),))
    return named.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


@query
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every showing of every document in the mix."""
    mixed = mixing.mix(read(spark, folder, "documents"), order=True)
    return mixed.select("doc_id", "source", "n_tokens", "epoch", "block_order", "doc_order")


@query
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages that an earlier one holds."""
    cut = spans.drop_repeated(read(spark, folder, "documents"), counts=True)
    return cut.select("doc_id", "text", "n_sentences", "n_removed")


@query
def op11_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links, component and verdict of every vector."""
    return vector_links.link(read(spark, folder, "embeddings"))


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, proof and audit of every document."""
    shown = manifest.audit(read(spark, folder, "documents"), F.col("doc_id").isNotNull() & (id_remainder(5) == 0))
    return shown.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The first sixteen whitened components of every vector."""
    return whitening.whiten(read(spark, folder, "embeddings")).withColumn(
        "deviation", F.expr("try_cast(deviation AS BIGINT)"))


#: What both engines take as words; DuckDB's patterns have the same classes.
_WORD = r"[^\x20\x09-\x0D]+"

SQL["op5_quality_rules"] = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT *, regexp_extract_all(text, '{_WORD}') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM cut WHERE len(w) >= 3)),
rep AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY r),
measured AS (
  SELECT c.r, doc_id, lang, source, len(w) AS n_words,
    length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM cut c LEFT JOIN covered USING (r)),
binned AS (
  SELECT *, least(n_symbols * 1000 // greatest(word_chars, 1), 2000) AS symbol_rate,
    least(n_dup_lines * 1000 // greatest(n_lines, 1), 2000) AS line_rate,
    least(n_repeat_words * 1000 // greatest(n_words, 1), 2000) AS repeat_rate,
    least(word_chars * 10 // greatest(n_words, 1), 2000) AS word_length FROM measured),
rates AS (
  SELECT lang, source, unnest(['symbol_rate', 'line_rate', 'repeat_rate', 'word_length']) AS rate,
    unnest([symbol_rate, line_rate, repeat_rate, word_length]) AS bin FROM binned),
sketch AS (SELECT lang, source, rate, bin, count(*) AS n FROM rates GROUP BY ALL),
tongue AS (SELECT lang, rate, bin, sum(n) AS n FROM sketch GROUP BY ALL),
whole AS (SELECT rate, bin, sum(n) AS n FROM sketch GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM sketch),
merged AS (
  SELECT lang, source, rate, bin, n * 1000000 AS w FROM sketch
  UNION ALL SELECT g.lang, g.source, rate, bin, w FROM groups g JOIN (
    SELECT lang, rate, bin, floor(n::DOUBLE / sum(n) OVER (PARTITION BY lang, rate)::DOUBLE * 50000000)::BIGINT AS w FROM tongue) t
    ON g.lang IS NOT DISTINCT FROM t.lang
  UNION ALL SELECT g.lang, g.source, rate, bin, w FROM groups g, (
    SELECT rate, bin, floor(n::DOUBLE / sum(n) OVER (PARTITION BY rate)::DOUBLE * 50000000)::BIGINT AS w FROM whole)),
upto AS (
  SELECT lang, source, rate, bin, sum(w) OVER g AS u, sum(w) OVER (PARTITION BY lang, source, rate) AS t
  FROM (SELECT lang, source, rate, bin, sum(w) AS w FROM merged WHERE bin > 0 GROUP BY ALL)
  WINDOW g AS (PARTITION BY lang, source, rate ORDER BY bin)),
quartiles AS (
  SELECT lang, source, rate, min(bin) FILTER (4 * u >= t) AS q1, min(bin) FILTER (4 * u >= 2 * t) AS q2,
    min(bin) FILTER (4 * u >= 3 * t) AS q3 FROM upto GROUP BY ALL),
bounds AS (
  SELECT g.lang, g.source, r.rate, coalesce(q2, 0) AS q2, 6 * greatest(coalesce(q3 - q1, 0), 1) AS reach
  FROM groups g CROSS JOIN (SELECT unnest(['symbol_rate', 'line_rate', 'repeat_rate', 'word_length']) AS rate) r
  LEFT JOIN quartiles q ON g.lang IS NOT DISTINCT FROM q.lang AND g.source IS NOT DISTINCT FROM q.source AND r.rate = q.rate),
pairs AS (
  SELECT r, lang, source, unnest(['symbol_rate', 'line_rate', 'repeat_rate', 'word_length']) AS rate,
    unnest([symbol_rate, line_rate, repeat_rate, word_length]) AS bin FROM binned),
verdict AS (
  SELECT p.r, bool_and(bin <= q2 + reach AND (p.rate <> 'word_length' OR bin >= q2 - reach)) AS fine
  FROM pairs p JOIN bounds b ON p.lang IS NOT DISTINCT FROM b.lang AND p.source IS NOT DISTINCT FROM b.source
    AND p.rate = b.rate GROUP BY p.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND fine AS kept
FROM measured JOIN verdict USING (r)
"""

_ENDS = ".!?\\n\u2026\u3002\uff01\uff1f\u0964\u061f\u06d4"
_SENTENCE = rf"[^{_ENDS}]*[{_ENDS}]+[\x20\x09-\x0D]*|[^{_ENDS}]+"

SQL["op10_substring_dedup"] = rf"""
WITH base AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{_SENTENCE}') AS s FROM documents),
sent AS (
  SELECT doc_id, i, s[i] AS raw, trim(translate(s[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')) AS t,
    len(regexp_extract_all(s[i], '{_WORD}')) AS n
  FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM base)),
summed AS (SELECT *, sum(n) OVER w AS upto, lead(n) OVER w AS next_n FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
spots AS (
  SELECT doc_id, i, i + 1 AS j FROM summed WHERE n + next_n >= 10
  UNION ALL SELECT a.doc_id, a.i, b.i FROM summed a ASOF JOIN (SELECT doc_id, i, upto FROM summed WHERE n > 0) b
    ON a.doc_id = b.doc_id AND b.upto >= a.upto - a.n + 30 WHERE coalesce(a.n + a.next_n, 0) < 10
  UNION SELECT doc_id, i, i FROM summed WHERE n >= 25),
named AS (SELECT doc_id, list(t ORDER BY i) AS ts FROM sent GROUP BY doc_id),
later AS (
  SELECT doc_id, i, j FROM (
    SELECT doc_id, i, j, row_number() OVER (PARTITION BY ts[i:j] ORDER BY doc_id, i) AS k FROM spots JOIN named USING (doc_id)) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(generate_series(i, j)) AS i FROM later)),
rest AS (
  SELECT s.doc_id, string_agg(raw, '' ORDER BY s.i) FILTER (g.i IS NULL) AS text, count(g.i) AS n_removed
  FROM sent s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i GROUP BY s.doc_id)
SELECT b.doc_id, CASE WHEN b.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text,
  CAST(len(b.s) AS BIGINT) AS n_sentences, coalesce(r.n_removed, 0) AS n_removed
FROM base b LEFT JOIN rest r USING (doc_id)
"""

#: The exponent is found bit by bit; largest step whose entropy is high enough, raised to the repetition limit.
SQL["op9_mixing"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS tokens FROM documents),
s AS (SELECT source, count(*) AS docs, sum(tokens)::BIGINT AS tokens, sum(tokens) / (SELECT sum(tokens) FROM d) AS share
      FROM d GROUP BY source),
l AS (SELECT list(share::DOUBLE) AS p, ln(count(*)) * 0.9::DOUBLE AS goal, max(share) / min(share) AS ratio
      FROM s WHERE share > 0),
bits(i, low, below) AS (
  SELECT 20, 0::BIGINT, -1::BIGINT
  UNION ALL
  SELECT i - 1,
    low + CASE WHEN ln(list_sum(list_transform(p, lambda x: x ** ((low + step) / 1048576.0::DOUBLE))))
        - ((low + step) / 1048576.0::DOUBLE)
        * list_sum(list_transform(p, lambda x: x ** ((low + step) / 1048576.0::DOUBLE) * ln(x)))
        / list_sum(list_transform(p, lambda x: x ** ((low + step) / 1048576.0::DOUBLE))) >= goal THEN step ELSE 0 END,
    below + CASE WHEN ratio ** (1 - (below + step) / 1048576.0::DOUBLE) > 2 THEN step ELSE 0 END
  FROM (SELECT *, (1 << (i - 1))::BIGINT AS step FROM bits, l WHERE i > 0)),
e AS (SELECT greatest(low, below + 1) / 1048576.0::DOUBLE AS a FROM bits WHERE i = 0),
w AS (SELECT s.*, CASE WHEN share > 0 THEN share::DOUBLE ** a END AS power FROM s, e),
q AS (SELECT *, floor(power * (SELECT max(tokens / power) FROM w) + 1e-6 * tokens)::BIGINT AS quota,
        ((docs + 4095) // 4096)::BIGINT AS blocks FROM w),
r AS (SELECT *, quota // tokens AS epochs, quota - quota // tokens * tokens AS rest FROM q),
x AS (
  SELECT d.doc_id, d.source, d.tokens, epochs, rest,
    ('0x' || substr(md5('mix:' || d.doc_id || ':block'), 1, 8))::BIGINT % blocks AS block
  FROM d JOIN r ON d.source = r.source),
y AS (SELECT *, md5(concat('mix:', source, ':', epochs, ':', block)) AS last_block, md5(concat('mix:', doc_id, ':', epochs)) AS last_doc FROM x),
held AS (SELECT source, block, last_block, rest, sum(tokens) AS n FROM y GROUP BY ALL),
upto AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY last_block, block) AS u FROM held),
cut AS (SELECT source, min_by(last_block, u) AS end_block, min_by(block, u) AS block, min_by(rest - (u - n), u) AS room
        FROM upto WHERE u > rest GROUP BY source),
inside AS (
  SELECT y.source, last_doc, room, sum(tokens) OVER (PARTITION BY y.source ORDER BY last_doc RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u
  FROM y JOIN cut USING (source, block)),
ends AS (SELECT source, max(last_doc) FILTER (u <= room) AS end_doc FROM inside GROUP BY source),
shown AS (
  SELECT y.*, epochs + coalesce(rest > 0 AND (last_block < end_block OR last_block = end_block AND last_doc <= end_doc), false)::INT AS copies
  FROM y LEFT JOIN cut ON y.source = cut.source LEFT JOIN ends ON y.source = ends.source)
SELECT doc_id, source, tokens AS n_tokens, epoch::INT AS epoch, md5(concat('mix:', source, ':', epoch, ':', block)) AS block_order,
  md5(concat('mix:', doc_id, ':', epoch)) AS doc_order
FROM (SELECT *, unnest(generate_series(0, copies - 1)) AS epoch FROM shown)
"""

SQL["op11_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda c: c * c))) AS size FROM v
  WHERE label IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(e, lambda c: c <> 0)) > 0),
pairs AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
reach(a, b) AS (SELECT r, r FROM v UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
least AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY ALL),
linked AS (SELECT a AS r, count(*) AS n FROM pairs GROUP BY ALL)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id IS NOT DISTINCT FROM vec_id AS kept
FROM v JOIN least USING (r) LEFT JOIN linked USING (r)
"""

#: crc32 bit by bit; levels of runs of 16 first within a source, then over the sources.
SQL["op12_merkle_manifest"] = """
WITH RECURSIVE fields AS (
  SELECT row_number() OVER () AS r, doc_id, source,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(doc_id::VARCHAR), ':', doc_id) END,
      CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
      CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END,
      CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(n_chars::VARCHAR), ':', n_chars) END) AS head,
    CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END AS body,
    CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':',
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS changed,
    xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc
  FROM documents),
leaves AS (
  SELECT r, doc_id, source, sha256(head || body) AS leaf,
    CASE WHEN crc % 5 = 0 THEN sha256(head || changed) ELSE sha256(head || body) END AS used FROM fields),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
    count(*) OVER (PARTITION BY source) AS size FROM leaves),
tree(source, h, rank, size, digest) AS (
  SELECT source, 0, rank, size, leaf FROM ranked
  UNION ALL
  SELECT source, h + 1, rank // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY rank))
  FROM tree WHERE size > 1 GROUP BY source, h, rank // 16, (size + 15) // 16),
runs AS (SELECT source, h, rank // 16 AS run, list(digest ORDER BY rank) AS kids FROM tree WHERE size > 1 GROUP BY ALL),
subroots AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank,
  count(*) OVER () AS size FROM tree WHERE size = 1),
crown(h, rank, size, digest) AS (
  SELECT 0, rank, size, subroot FROM subroots
  UNION ALL
  SELECT h + 1, rank // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY rank))
  FROM crown WHERE size > 1 GROUP BY h, rank // 16, (size + 15) // 16),
crown_runs AS (SELECT h, rank // 16 AS run, list(digest ORDER BY rank) AS kids FROM crown WHERE size > 1 GROUP BY ALL),
climb(r, source, h, pos, proof, node) AS (
  SELECT r, source, 0, rank, '', used FROM ranked
  UNION ALL
  SELECT c.r, c.source, c.h + 1, c.pos // 16,
    concat(c.proof, array_to_string(kids[1:c.pos % 16], ''), array_to_string(kids[c.pos % 16 + 2:], '')),
    sha256(concat(array_to_string(kids[1:c.pos % 16], ''), c.node, array_to_string(kids[c.pos % 16 + 2:], '')))
  FROM climb c JOIN runs k ON c.source IS NOT DISTINCT FROM k.source AND c.h = k.h AND c.pos // 16 = k.run),
in_source AS (SELECT r, source, max_by(proof, h) AS proof, max_by(node, h) AS node FROM climb GROUP BY r, source),
over(r, h, pos, proof, node) AS (
  SELECT i.r, 0, s.rank, i.proof, i.node FROM in_source i JOIN subroots s ON i.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT c.r, c.h + 1, c.pos // 16,
    concat(c.proof, array_to_string(kids[1:c.pos % 16], ''), array_to_string(kids[c.pos % 16 + 2:], '')),
    sha256(concat(array_to_string(kids[1:c.pos % 16], ''), c.node, array_to_string(kids[c.pos % 16 + 2:], '')))
  FROM over c JOIN crown_runs k ON c.h = k.h AND c.pos // 16 = k.run),
done AS (SELECT r, max_by(proof, h) AS proof, max_by(node, h) AS folded_root FROM over GROUP BY r)
SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, sha256(d.proof) AS proof_sha256, d.folded_root,
  d.folded_root = t.digest AS verified
FROM leaves l JOIN done d USING (r) JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
  JOIN (SELECT digest FROM crown WHERE size = 1) t ON TRUE
"""
