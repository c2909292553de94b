"""The operators over the whole ``documents`` or ``embeddings`` table, and the SQL twins of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loghelm.llm.alignment import align_tokens
from loghelm.llm.common import documents, labels
from loghelm.llm.exact_dedup import find_copies
from loghelm.llm.mixing import mix_sources
from loghelm.llm.nearest import nearest_neighbours
from loghelm.llm.packing import pack_documents
from loghelm.llm.quality_model import score_quality
from loghelm.llm.quality_rules import judge_quality
from loghelm.llm.secret_scan import find_secrets
from loghelm.llm.sharding import shard_rows
from loghelm.llm.simhash import near_copies
from loghelm.llm.substring_dedup import remove_repeats
from loghelm.llm.toxicity import score_toxicity
from loghelm.llm.vectors import embeddings
from loghelm.llm.whitening import whiten

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir)).drop("crc", "hash")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(documents(spark, sf_dir)).drop("crc", "hash")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(embeddings(spark, sf_dir))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(embeddings(spark, sf_dir))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(documents(spark, sf_dir))


QUERIES: dict[str, QueryFn] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_sharding": op3_sharding,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_source_mixing": op6_source_mixing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

ORACLES: dict[str, str] = {
    # longest_repeat: at each level, windows that another row has too
    "op1_substring_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
win AS (SELECT doc_id, p, len(list(word) OVER ahead) AS n, array_to_string(list(word) OVER ahead, ' ') AS s
  FROM w WINDOW ahead AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
named AS (SELECT doc_id, p, s, min(doc_id) OVER (PARTITION BY s) AS first FROM win WHERE n = 13),
hit AS (SELECT w.doc_id, w.p, w.word, max(CASE WHEN named.first < w.doc_id THEN 1 ELSE 0 END) OVER (
  PARTITION BY w.doc_id ORDER BY w.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM w LEFT JOIN named USING (doc_id, p)),
kept AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0), '')) AS kept_sha256 FROM hit GROUP BY doc_id),
level AS (
  SELECT 13 AS size, doc_id, p, hash(s) AS h FROM named
    WHERE s IN (SELECT s FROM named GROUP BY s HAVING count(DISTINCT doc_id) > 1)
  UNION ALL
  SELECT size, doc_id, p, h FROM (
    SELECT 2 * a.size AS size, a.doc_id, a.p, hash(a.h, b.h) AS h,
      min(a.doc_id) OVER same AS lo, max(a.doc_id) OVER same AS hi
    FROM level a JOIN level b ON a.doc_id = b.doc_id AND b.p = a.p + a.size
    WINDOW same AS (PARTITION BY hash(a.h, b.h))) WHERE lo < hi),
longest AS (SELECT doc_id, max(size)::BIGINT AS longest_repeat FROM level GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(kept_sha256, sha256('')) AS kept_sha256, coalesce(longest_repeat, 0)::BIGINT AS longest_repeat
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN longest USING (doc_id)
""",
    "op10_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_points,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256, n_points FROM k
""",
    # all rows; the index lists all entries of a table of up to 4,096 distinct vectors
    "op11_nearest_neighbours": r"""
WITH g AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT * FROM g WHERE len(v) = (SELECT len(embedding) FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v) AS score
  FROM n q JOIN n e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
}
