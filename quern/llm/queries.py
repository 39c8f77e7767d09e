"""The registered queries of the pipeline operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm import (
    exact_top_k, importance_resampling, language_id, packing, quality_classifier, repeated_bytes,
    secret_scan, sentence_pieces, simhash_dedup, substring_dedup, token_counts, vector_codes,
    vector_forest,
)
from quern.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


@register
def op1_sentence_pieces(spark, folder):
    return sentence_pieces.encoding_digest(table(spark, folder, "documents"))


@register
def op2_language_id(spark, folder):
    return language_id.language_predictions(table(spark, folder, "documents"))


@register
def op3_secret_scan(spark, folder):
    return secret_scan.secret_digest(table(spark, folder, "documents"))


@register
def op4_token_counts(spark, folder):
    return token_counts.token_counts(table(spark, folder, "documents"))


@register
def op5_quality_classifier(spark, folder):
    docs = table(spark, folder, "documents")
    grades = quality_classifier.label_grades(table(spark, folder, "labels"))
    return quality_classifier.quality(docs, quality_classifier.fit_on(docs, grades))


@register
def op6_exact_top_k(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return exact_top_k.exact_top_k(vectors, F.col("id") % 100 == 0)


@register
def op7_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"))


@register
def op8_substring_dedup(spark, folder):
    return substring_dedup.repeat_digest(table(spark, folder, "documents"))


@register
def op9_nearest_vectors(spark, folder):
    return vector_forest.nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


@register
def op10_simhash_dedup(spark, folder):
    return simhash_dedup.fingerprint_digest(table(spark, folder, "documents"))


@register
def op11_repeated_bytes(spark, folder):
    return repeated_bytes.byte_digest(table(spark, folder, "documents"))


@register
def op12_importance_resampling(spark, folder):
    return importance_resampling.resample(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


@register
def op13_vector_codes(spark, folder):
    return vector_codes.vector_codes(table(spark, folder, "embeddings"))


ORACLES["op6_exact_top_k"] = """
WITH v AS (
    SELECT vec_id AS id, list_transform(embedding, lambda c: floor(CAST(c AS DOUBLE) * 1024)) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
    SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 100 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
    FROM s
)
SELECT * FROM r WHERE "rank" <= 10
"""


def _spans_sql() -> str:
    """All matches of each rule with their places, from the matches and the gaps between them."""
    flat = [
        (place, rule.kind, rule.pattern.replace("(?ai:", "(?i:").replace("'", "''"), rule.group, rule.least)
        for place, rule in enumerate(secret_scan.RULES)
    ]
    return " UNION ALL ".join(
        f"SELECT doc_id, {place} AS place, '{kind}' AS kind, {least} AS least, "
        f"regexp_extract_all(text, '{pattern}') AS found, "
        f"regexp_extract_all(text, '{pattern}', {group}) AS inner_found, "
        f"string_split_regex(text, '{pattern}') AS gaps FROM documents WHERE text IS NOT NULL"
        for place, kind, pattern, group, least in flat
    )


ORACLES["op3_secret_scan"] = f"""
WITH matched AS ({_spans_sql()}),
each_one AS (SELECT *, unnest(range(1, len(found) + 1)) AS j FROM matched WHERE len(found) > 0),
spans AS (
    SELECT doc_id, place, kind, begun, begun + length(found[j]) AS ended
    FROM (SELECT *, CAST(list_sum(list_transform(gaps[1:j], lambda g: length(g)))
        + coalesce(list_sum(list_transform(found[1:j - 1], lambda f: length(f))), 0) AS BIGINT) AS begun
      FROM each_one)
    WHERE length(inner_found[j]) >= least
),
named AS (SELECT *, kind || ':' || begun || ':' || ended AS name FROM spans)
SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access,
  count(*) FILTER (place = 2) AS n_hex,
  sha256(coalesce(string_agg(name, ',' ORDER BY begun, place) FILTER (place < 3), '')) AS base_sha256,
  coalesce(string_agg(name, ',' ORDER BY begun, place), '') AS spans
FROM documents LEFT JOIN named USING (doc_id) GROUP BY doc_id
"""

ORACLES["op8_substring_dedup"] = r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
words AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos, len(words) AS n FROM split
),
windows AS (
    SELECT doc_id, pos, word, CASE WHEN pos + 12 <= n THEN string_agg(word, ' ') OVER (
        PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS win
    FROM words
),
firsts AS (SELECT win, min(doc_id) AS first FROM windows WHERE win IS NOT NULL GROUP BY win),
hits AS (
    SELECT doc_id, pos, word, coalesce(first < doc_id, false) AS hit
    FROM windows LEFT JOIN firsts USING (win)
),
covered AS (
    SELECT *, bool_or(hit) OVER (
        PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
    FROM hits
)
SELECT doc_id, count(pos) AS n_words, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM documents LEFT JOIN covered USING (doc_id) GROUP BY doc_id
"""

# crc32 byte by byte with the usual table, which is worked out from its polynomial.
ORACLES["op12_importance_resampling"] = r"""
WITH crc AS MATERIALIZED (
    SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, b:
        CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) AS v
      FROM (SELECT unnest(range(256)) AS i))
),
texts AS (
    SELECT 's' AS side, doc_id AS id, text FROM documents
    UNION ALL SELECT 't', item_id, text FROM benchmark
),
words AS (
    SELECT side, id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
    FROM (SELECT side, id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts)
),
features AS MATERIALIZED (
    SELECT side, id, word AS f FROM words
    UNION ALL SELECT * FROM (SELECT side, id, word || ' ' || lead(word) OVER (
        PARTITION BY side, id ORDER BY pos) AS f FROM words) WHERE f IS NOT NULL
),
buckets AS MATERIALIZED (
    SELECT f, xor(list_reduce(
        list_transform(range(len(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT),
        lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
    FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)), crc
),
sides AS (
    SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t
    FROM features JOIN buckets USING (f) GROUP BY bucket
),
whole AS (SELECT count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM features),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln(((x.t + 1) * (w.s + 10000))::DOUBLE
        / ((x.s + 1) * (w.t + 10000))::DOUBLE)) AS BIGINT) AS gain
    FROM sides x, whole w
),
weights AS (
    SELECT id AS doc_id, count(*) AS n_features,
      CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
    FROM features JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 's' GROUP BY id
),
scores AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
        (('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))
        AS BIGINT) AS score,
      coalesce(n_features, 0) >= 39 AS able
    FROM documents LEFT JOIN weights USING (doc_id)
),
ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place,
      count(*) OVER () AS n FROM scores WHERE able
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS "rank"
FROM scores LEFT JOIN ranked USING (doc_id)
"""


def _codes_sql(rounds: int = 4) -> str:
    """Lloyd's rounds one after the other; products of whole numbers are exact in doubles."""
    assigned = """a{r} AS MATERIALIZED (
    SELECT id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
      SELECT p.id, p.part, c.entry,
        list_inner_product(x, x) - 2 * list_inner_product(x, e) + list_inner_product(e, e) AS d
      FROM p JOIN c{r} c USING (part)) GROUP BY id, part
)"""
    replaced = """c{n} AS MATERIALIZED (
    SELECT part, entry, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN (
      SELECT part, entry, list(v ORDER BY pos) AS e FROM (
        SELECT part, entry, pos, floor(sum(v) / count(*)) AS v FROM (
          SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS pos
          FROM a{r} JOIN p USING (id, part)) GROUP BY part, entry, pos) GROUP BY part, entry
    ) m USING (part, entry)
)"""
    steps = [f"{assigned.format(r=r)},\n{replaced.format(r=r, n=r + 1)}" for r in range(rounds)]
    return f"""
WITH v AS (
    SELECT vec_id AS id, label, list_transform(embedding, lambda c: floor(CAST(c AS DOUBLE) * 1024)) AS x,
      len(embedding) // 4 AS size
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
p AS MATERIALIZED (
    SELECT id, part, list_slice(x, part * size + 1, part * size + size) AS x
    FROM v, (SELECT unnest(range(4)) AS part)
),
c0 AS MATERIALIZED (
    SELECT part, entry, x AS e FROM p JOIN (
      SELECT id, row_number() OVER (ORDER BY id) - 1 AS entry FROM v ORDER BY id LIMIT 256) USING (id)
),
{','.join(steps)},
{assigned.format(r=rounds)},
codes AS (
    SELECT id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code,
      CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY id
),
books AS (
    SELECT sha256(string_agg(CAST(CAST(w AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h
    FROM (SELECT part, entry, unnest(e) AS w, generate_subscripts(e, 1) AS pos FROM c{rounds})
)
SELECT id AS vec_id, code, error,
  CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM codes JOIN v USING (id), books
"""


ORACLES["op13_vector_codes"] = _codes_sql()

# Strings are cut from stretches of 256 bytes and the 99 that follow, so long texts stay cheap.
ORACLES["op11_repeated_bytes"] = """
WITH raw AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
sized AS (SELECT doc_id, h, len(h) // 2 AS n FROM raw),
chunks AS (
    SELECT doc_id, c * 256 AS base, substr(h, c * 512 + 1, 710) AS piece, n
    FROM (SELECT *, unnest(range((n + 255) // 256)) AS c FROM sized)
),
strings AS MATERIALIZED (
    SELECT doc_id, base + k AS start, md5(substr(piece, 2 * k + 1, 200)) AS s
    FROM (SELECT *, unnest(range(256)) AS k FROM chunks) WHERE base + k + 100 <= n
),
firsts AS (SELECT s, min((doc_id, start)) AS p FROM strings GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, start FROM strings JOIN firsts USING (s) WHERE (doc_id, start) > p),
edges AS (
    SELECT doc_id, start, start + 100 AS stop,
      coalesce(lag(start + 100) OVER (PARTITION BY doc_id ORDER BY start) < start, true) AS fresh
    FROM gone
),
spans AS (
    SELECT doc_id, min(start) AS a, max(stop) AS b FROM (
      SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM edges)
    GROUP BY doc_id, span
),
listed AS (
    SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS gone FROM spans GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(
    range(len(a) + 1), lambda i: substr(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE b[i] END) + 1,
      2 * ((CASE WHEN i = len(a) THEN n ELSE a[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE b[i] END)))), '')
  END)) AS kept_sha256
FROM sized LEFT JOIN listed USING (doc_id)
"""
