"""The operators of this subpackage as registered queries, and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from moraine.llm import collocations, exact_dedup, fingerprints, jaccard, line_dedup, mixing, packing, pii, pivots, ranked_search, scoring, toxicity, url_rules
from moraine.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents
), g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g USING (body)
"""


def op3_score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_texts(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), edits=None, least=1)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op11_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_products(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS v, row_number() OVER () AS row
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, q.row AS query_row, x.vec_id, x.row, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM v q JOIN v x ON q.row <> x.row WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, row) AS rank FROM scores)
WHERE rank <= 20
"""


def op12_mine_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), p AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k)
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*)::HUGEINT AS c FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS (
  SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND c >= 10
), cut_parts AS MATERIALIZED (
  SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand)
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.c AS l, r.c AS r, (1000000::HUGEINT * c.a * c.a) // (l.c * r.c) AS score
  FROM cut_parts c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.phrase = c.rp
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer
  FROM cand WHERE k = 3
), widest AS (
  SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN widest i ON i.lang = b.lang AND i.phrase = b.phrase AND b.k = 2
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a
)
SELECT lang, rank::INTEGER AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN totals USING (lang) WHERE rank <= 2000
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT item_id, row_number() OVER () AS item_row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM benchmark WHERE text IS NOT NULL
), totals AS (
  SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0
), asked AS (
  SELECT DISTINCT item_id, item_row, unnest(terms) AS term FROM i
), tf AS (
  SELECT doc_id, row, n, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, row, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, docs
), impact AS (
  SELECT doc_id, row, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length))) AS impact
  FROM tf JOIN w USING (term), totals
), scores AS (
  SELECT item_id, item_row, doc_id, row, sum(impact)::BIGINT AS score FROM asked JOIN impact USING (term) GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id, row) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_mix_sources, op2_exact_dedup, op3_score_texts, op4_line_dedup, op5_pack, op6_toxic_spans, op7_fingerprints,
    op8_jaccard_join, op9_url_rules, op10_personal_data,
    op11_top_products, op12_mine_phrases, op13_ranked_search)}
ORACLES: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op11_top_products": OP11_SQL,
                           "op12_mine_phrases": OP12_SQL, "op13_ranked_search": OP13_SQL}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
