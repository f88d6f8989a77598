"""The thin ``opN_<name>`` queries: each applies one operator, with production
parameters, to the whole of its table.  ``ORACLES`` has DuckDB SQL for those
that SQL can express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotwise.llm import (
    byte_bpe,
    collocations,
    exact_dedup,
    hard_negatives,
    hash_forest,
    jaccard_join,
    language_id,
    line_dedup,
    mixing,
    quality,
    substring_dedup,
    suffix_dedup,
    toxicity,
)
from slotwise.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

BPE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def query(oracle: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return deco


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query(
    r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || CAST(doc_id AS VARCHAR)) AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w,
    2.0::DOUBLE * source_size AS cap FROM src),
ranked AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k FROM weighed),
levels AS (
  SELECT k, cap, w,
    (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE FROM src)
      - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
    sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM ranked),
lvl AS (SELECT arg_min(room / open_w, k) AS level FROM levels WHERE w * (room / open_w) <= cap),
targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR w * level > cap THEN cap ELSE w * level END AS target
  FROM weighed CROSS JOIN lvl),
plan AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM targets),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole,
    CAST(round(p.target) AS BIGINT) - p.whole * p.source_size AS extra,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS ahead
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, extra - ahead)) AS BIGINT) AS taken
FROM placed"""
)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query()
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), BPE_VOCABULARY, public_tokenizers.PATTERN)


@query(
    """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id,
  count(*) OVER (PARTITION BY body) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM n"""
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op10_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


@query()
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.place, k.line, s.key IS NOT NULL AND s.top <> k.doc_id AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
)
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.cleaned_texts(table(spark, sf_dir, "documents")))


@query(
    r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
piece AS (SELECT lang, unnest(pieces) AS body FROM texts),
worded AS (SELECT lang, regexp_extract_all(body, '[^\x20\x09]+') AS w FROM piece),
grams AS (
  SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase
  FROM worded CROSS JOIN (VALUES (1), (2), (3), (4), (5)) lengths(m)),
f AS (
  SELECT lang, m, phrase, string_split(phrase, ' ') AS w, count(*) AS a
  FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100),
sizes AS (SELECT lang, count(*) AS n FROM grams WHERE m = 1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, s.n, k,
    CAST((1000::HUGEINT * c.a * s.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM f c JOIN (VALUES (1), (2), (3), (4)) cut_at(k) ON k < c.m JOIN sizes s ON s.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, a, unnest([array_to_string(w[i:i + p - 1], ' ') FOR i IN range(1, m - p + 2)]) AS phrase
  FROM f JOIN (VALUES (2), (3), (4)) part_of(p) ON p < m),
left_over AS (
  SELECT * FROM lowest c
  WHERE NOT EXISTS (SELECT 1 FROM parts x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.a >= 100 * c.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM left_over QUALIFY rank <= 2000"""
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).drop("cut")


@query(
    """
WITH usable AS (
  SELECT vec_id, CAST(label AS BIGINT) AS label, embedding FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v
  FROM usable),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v)]) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS place
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE place <= 10"""
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)
