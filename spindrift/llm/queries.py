"""One query for each operator, with production parameters over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import new_path, table


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .main_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .archives import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"), new_path(spark, "warc")).drop("record_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify, fit

    documents = table(spark, sf_dir, "documents")
    return classify(documents, fit(documents, table(spark, sf_dir, "labels")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, identify

    documents = table(spark, sf_dir, "documents")
    return identify(documents, fit(documents))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passage_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine_hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return mine_hard_negatives(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal_data import digests, find_personal_data, fit

    documents = table(spark, sf_dir, "documents")
    return digests(find_personal_data(documents, fit(documents)))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[CAST(s AS INTEGER):CAST(s + least(13, len(w)) - 1 AS INTEGER)], ' ') AS g
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(s) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM iw), dw AS (
  SELECT doc_id, s, n, array_to_string(w[CAST(s AS INTEGER):CAST(s + n - 1 AS INTEGER)], ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(s) WHERE len(w) >= n
), hits AS (SELECT doc_id, s, n, item_id FROM dw JOIN iw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
i AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP4_SQL = """
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best
  FROM pages
), bits AS (
  SELECT *, list_aggregate(list_transform(range(0, 40), lambda i: format('{:04b}', instr('0123456789abcdef', substr(hex, CAST(i AS INTEGER) + 1, 1)) - 1)), 'string_agg', '') AS b
  FROM p
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(0, 5), lambda j: (ascii(substr(b, CAST(5 * i + j AS INTEGER) + 1, 1)) - 48) * CAST(pow(2, 4 - j) AS BIGINT))) AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to,
       CASE WHEN url IS NULL OR url = '' THEN 'http://page.invalid/' || page_id ELSE regexp_replace(url, '\\s', '%20', 'g') END AS target_uri,
       '2024-01-01T00:00:00Z' AS warc_date
FROM bits
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
  WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), dw AS (SELECT doc_id, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), hexed AS (SELECT word, hex(word) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)), bytes AS (
  SELECT word, list_transform(range(1, len(h), 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', substr(h, i, 1)) - 1) + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1 AS BIGINT)) AS b
  FROM hexed
), hashed AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, tab
), s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT CAST(count(*) AS DOUBLE) FROM dw) + 10000) / ((CAST(s AS DOUBLE) + 1) * ((SELECT CAST(count(*) AS DOUBLE) FROM bw) + 10000)))) AS g
  FROM s LEFT JOIN t USING (bucket)
), summed AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN summed USING (doc_id)
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * 10 // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_main_text, op2_near_dedup, op3_decontamination, op4_warc, op5_packing, op6_licenses, op7_quality, op8_language, op9_topk_search, op10_passage_dedup, op11_hard_negatives, op12_resampling, op13_personal_data)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op4_warc": OP4_SQL, "op9_topk_search": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_resampling": OP12_SQL}
