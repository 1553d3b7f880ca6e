"""The queries of this subpackage over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwake.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), VOCABULARY, keep_ids=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwake.llm.toxicity import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwake.llm.html_extract import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwake.llm.sharding import shard

    placed = shard(_table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwake.llm.jaccard_join import link_classes

    return link_classes(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwake.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("row_key")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwake.llm.token_count import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), VOCABULARY, limit=1024)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwake.llm.fingerprint import edited_fingerprints

    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwake.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwake.llm.embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwake.llm.hard_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwake.llm.pii import digest, sanitise

    return digest(sanitise(_table(spark, sf_dir, "documents"), keep_text=False))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwake.llm.spelling import variants

    return variants(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_packing, op2_toxicity, op3_html_extraction, op4_sharding, op5_jaccard_join, op6_mixing, op7_token_counts, op8_fingerprints, op9_quality, op10_embedding_dedup, op11_hard_negatives, op12_pii, op13_spelling)
    return {f.__name__: f for f in found}


_REACH = """, pair AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach(id, root) AS (SELECT id, id FROM ids UNION SELECT pair.b, root FROM reach JOIN pair ON reach.id = pair.a), low AS (SELECT id, min(root) AS root FROM reach GROUP BY id), links AS (SELECT a AS id, count(*) AS n FROM pair GROUP BY a)"""

OP3 = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<br>', ' '), '</?(?:p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, [trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) FOR x IN parts] AS parts FROM a),
t AS (SELECT page_id, url, array_to_string([x FOR x IN parts IF x <> ''], chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t"""

OP5 = (
    r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE i * 10 >= 8 * (x.n + y.n - i)), ids AS (SELECT doc_id AS id FROM documents)"""
    + _REACH
    + " SELECT low.id AS doc_id, root AS class_id, coalesce(n, 0) AS n_links FROM low LEFT JOIN links USING (id)"
)

OP10 = (
    """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95), ids AS (SELECT vec_id AS id FROM v)"""
    + _REACH
    + " SELECT low.id AS vec_id, coalesce(n, 0) AS n_links, root AS component_id, low.id = root AS kept FROM low LEFT JOIN links USING (id)"
)


OP11 = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS own, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT * FROM (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score) WHERE rank <= 3"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express: the pages' known markup, exact joins with components by recursion, and ranked windows."""
    return {"op3_html_extraction": OP3, "op5_jaccard_join": OP5, "op10_embedding_dedup": OP10, "op11_hard_negatives": OP11}
