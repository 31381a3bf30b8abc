"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers

from assayframe.llm import bpe, decontaminate, imatch, lexical, licenses, negatives, ngrams, pages, shards, simhash, substrings, toxicity, vectors
from assayframe.llm.common import table


def op1_decontamination(spark, sf_dir):
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash").distinct()


def op2_sharding(spark, sf_dir):
    return shards.digest(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark, sf_dir):
    return pages.extract(table(spark, sf_dir, "pages"))


def op4_embedding_near_dedup(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_lm_scoring(spark, sf_dir):
    return ngrams.scores(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.digest(table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark, sf_dir):
    return substrings.digest(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe(spark, sf_dir):
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_ranked_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark, sf_dir):
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_fingerprints(spark, sf_dir):
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_sharding, op3_html_extraction, op4_embedding_near_dedup, op5_lm_scoring, op6_simhash,
    op7_license_scan, op8_substring_dedup, op9_toxicity, op10_bpe, op11_ranked_search, op12_hard_negatives, op13_fingerprints)}
ORACLE: dict[str, str] = {}
ORACLE["op4_embedding_near_dedup"] = """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x), degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN least ON least.x = vec_id LEFT JOIN degree ON degree.x = vec_id"""


def _grams(table_name: str, key: str) -> str:
    words = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    return (f"SELECT DISTINCT {key}, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), "
            f"lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM (SELECT {key}, {words} AS w FROM {table_name}) WHERE len(w) > 0")


ORACLE["op1_decontamination"] = f"""WITH d AS ({_grams("documents", "doc_id")}), i AS ({_grams("benchmark", "item_id")}), n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_found, CAST(count(*) AS DOUBLE) / n AS containment FROM d JOIN i USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n HAVING 5 * count(*) >= 4 * n"""

ORACLE["op11_ranked_search"] = r"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM t WHERE len(ts) > 0), s AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM d) GROUP BY doc_id, n, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
x AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
  * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
ORACLE["op12_hard_negatives"] = """WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id,
  positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 3"""
