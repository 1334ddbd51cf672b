"""The queries op1 to op13: each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytepairs, language, lines, media, negatives, packing, phrases, pieces, quality, rules, simhash, toxicity, warc
from .common import documents

#: Vocabulary files of the public tokenizers; the same paths on the driver and the executors.
WORD_VOCABULARY, PIECE_MODEL = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base rules and adaptive fences of all documents."""
    return rules.quality_rules(documents(spark, sf_dir)).drop("lang", "source")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; n_passages counts their significant passages."""
    docs = documents(spark, sf_dir)
    out = toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    out = warc.roundtrip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as images and read back; tile_npy is the NPY tile of 16 by 16 means."""
    out = media.media_features(media.text_images(documents(spark, sf_dir)), digests=True, size_col="n_bytes")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("dhash").alias("feature"), "tile_npy")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components that their links form."""
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack_documents(documents(spark, sf_dir), WORD_VOCABULARY)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = documents(spark, sf_dir)
    return language.predict(docs, language.learn(docs))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts encoded and decoded."""
    return pieces.encode_texts(documents(spark, sf_dir), PIECE_MODEL, digests=True)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the later copies of repeated line runs."""
    return lines.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_deleted", "text")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language in all documents."""
    return phrases.collocations(documents(spark, sf_dir))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts encoded and decoded."""
    return bytepairs.encode_texts(documents(spark, sf_dir), BYTE_RANKS, digests=True)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 50, sought among all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x")).where(F.forall("x", number))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", label.alias("label"), F.transform("x", lambda x: F.floor(x * 256)).alias("vector")), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_warc_segments, op4_media_columns, op5_quality, op6_simhash, op7_packing, op8_language, op9_sentencepiece, op10_line_dedup, op11_collocations, op12_byte_bpe, op13_hard_negatives)}

OP3 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(encode(coalesce(html, ''))) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id IS NOT DISTINCT FROM p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id IS DISTINCT FROM p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""

def _op1() -> str:
    whole = f"floor({{}} * {rules.BINS})::BIGINT"
    shift = f"greatest(length(bin({whole})) - {rules.BINS.bit_length()}, 0)"
    binned = f"((({whole}) >> {shift}) << {shift}) / {rules.BINS}::DOUBLE"
    quartile = ", ".join(f"quantile_disc({binned.replace('{}', m)}, {p}) AS {m}_{k}" for m in rules.SKETCHED for p, k in ((0.25, 1), (0.75, 3)))
    lean = lambda own, n, other: ", ".join(f"({n} * {own}.{m}_{k} + {rules.PRIOR_ROWS} * {other}.{m}_{k}) / ({n} + {rules.PRIOR_ROWS}) AS {m}_{k}" for m in rules.SKETCHED for k in (1, 3))
    # The limits as roots of the quadratic equation n * (q - x)^2 = z^2 * x * (1 - x), or z^2 * x for rates.
    z2, part = rules.ERRORS**2, {"words": "n_words_1", "lines": "n_lines_1", "windows": f"(n_words_1 / {rules.WINDOW})", "chars": "(n_words_1 * chars_per_word_1)"}
    inside = []
    for m, (of, share, low) in rules.MEASURES.items():
        for end, sign in ((3, "+"), *[(1, "-")] * low):
            q, n = f"{m}_{end}", part[of]
            root = f"{rules.ERRORS} * sqrt({z2} + 4 * {n} * {q}{f' * (1 - {q})' if share else ''})"
            limit = f"(2 * {n} * {q} + {z2} {sign} {root}) / (2 * ({n}{f' + {z2}' if share else ''}))"
            inside.append(f"m.{m} {'<=' if end == 3 else '>='} {limit} {sign} {rules.FENCE} * ({m}_3 - {m}_1)")
    inside = " AND ".join(inside)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
grams AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS gram FROM w, unnest(generate_series(1, len(w) - 7)) AS u(i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM grams) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, generate_series(0, 7) AS u(k) GROUP BY rid),
c AS (
  SELECT w.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
    length(regexp_replace(t, '[^!?"''()\\[\\]{{}}=+/\\\\^~_@;:-]+', '', 'g')) AS n_marks, length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_upper
  FROM w LEFT JOIN cov ON cov.rid = w.rid
), m AS (
  SELECT rid, doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbols_per_word,
    CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS chars_per_word,
    CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_share,
    CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_word_share,
    CASE WHEN word_chars > 0 THEN n_marks::DOUBLE / word_chars ELSE 0 END AS mark_share,
    CASE WHEN word_chars > 0 THEN n_upper::DOUBLE / word_chars ELSE 0 END AS upper_share
  FROM c
), p AS (SELECT * FROM m WHERE NOT base_failed),
a AS (SELECT {quartile} FROM p),
g AS (SELECT lang, count(*) AS n, {quartile} FROM p GROUP BY lang),
g2 AS (SELECT lang, {lean("g", "g.n", "a")} FROM g, a),
s AS (SELECT lang, source, count(*) AS n, {quartile} FROM p GROUP BY lang, source),
f AS (SELECT s.lang, s.source, {lean("s", "s.n", "g2")} FROM s JOIN g2 ON s.lang IS NOT DISTINCT FROM g2.lang)
SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, {", ".join("m." + x for x in rules.MEASURES)}, m.n_lines,
  coalesce(NOT m.base_failed AND {inside}, false) AS kept
FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
"""


OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS raw, regexp_replace(ls[i], '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS line FROM d, unnest(generate_series(1, len(ls))) AS u(i)),
v AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS q FROM l WHERE line <> ''),
a AS (SELECT doc_id, list(line ORDER BY q) AS ls, list(w ORDER BY q) AS ws FROM v GROUP BY doc_id),
f AS (SELECT v.doc_id, v.q, min(k) AS n FROM v JOIN a USING (doc_id), generate_series(1, {lines.MIN_WORDS}) AS u(k)
      WHERE v.q + k - 1 <= len(ws) AND list_sum(ws[v.q:v.q + k - 1]) >= {lines.MIN_WORDS} GROUP BY ALL),
b AS (SELECT v.doc_id, v.q - min(k) + 1 AS q, min(k) AS n FROM v JOIN a USING (doc_id), generate_series(1, {lines.MIN_WORDS}) AS u(k)
      WHERE v.q - k + 1 >= 1 AND list_sum(ws[v.q - k + 1:v.q]) >= {lines.MIN_WORDS} GROUP BY v.doc_id, v.q),
x AS (SELECT doc_id, q, n FROM f UNION SELECT doc_id, q, n FROM b),
y AS (SELECT x.*, row_number() OVER (PARTITION BY array_to_string(ls[q:q + n - 1], chr(10)) ORDER BY doc_id, q) AS nth FROM x JOIN a USING (doc_id)),
z AS (SELECT DISTINCT doc_id, q + k AS q FROM y, unnest(generate_series(0, n - 1)) AS u(k) WHERE nth > 1),
r AS (SELECT l.doc_id, count(v.q) AS n_lines, count(z.q) AS n_deleted, string_agg(l.raw, chr(10) ORDER BY l.i) FILTER (WHERE z.q IS NULL) AS kept
      FROM l LEFT JOIN v ON v.doc_id = l.doc_id AND v.i = l.i LEFT JOIN z ON z.doc_id = v.doc_id AND z.q = v.q GROUP BY l.doc_id)
SELECT documents.doc_id, n_lines, n_deleted, CASE WHEN n_deleted = 0 THEN text WHEN n_deleted = n_lines THEN '' ELSE kept END AS text
FROM documents JOIN r USING (doc_id)
"""

OP11 = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS u(piece)),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
      FROM p, generate_series(1, 5) AS s(k), unnest(generate_series(1, len(w) - k + 1)) AS v(i) GROUP BY ALL),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM g WHERE f >= 100 AND k > 1),
x AS (SELECT * FROM c WHERE NOT EXISTS (
  SELECT 1 FROM c AS longer WHERE longer.lang = c.lang AND longer.k > c.k AND 100 * longer.f >= 100 * c.f AND contains(' ' || longer.phrase || ' ', ' ' || c.phrase || ' '))),
y AS (SELECT x.lang, x.phrase, x.f AS a, j, l.f AS l, r.f AS r, n.n, 1000::HUGEINT * x.f * n.n // (l.f::HUGEINT * r.f) AS score
      FROM x, unnest(generate_series(1, x.k - 1)) AS u(j)
      JOIN g AS l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:j], ' ')
      JOIN g AS r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[j + 1:], ' ')
      JOIN n ON n.lang = x.lang),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS cut FROM y),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z WHERE cut = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""

OP13 = """
WITH v AS (
  SELECT vec_id::BIGINT AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v AS a, v AS b WHERE a.id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""

ORACLES: dict[str, str] = {"op1_quality_rules": _op1(), "op3_warc_segments": OP3, "op10_line_dedup": OP10, "op11_collocations": OP11, "op13_hard_negatives": OP13}
