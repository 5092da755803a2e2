"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import covertree, decontaminate, jaccard, licenses, packing, quality, secrets, shards, storage, templates, toxicity

#: A score from here on is a prediction of 1.
THRESHOLD = 0.7


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and the group that it belongs to by links."""
    return jaccard.similar_groups(storage.read(spark, sf_dir, "documents")).drop("n_links")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with digests of the base kinds' spans and of all spans."""
    base = secrets.KINDS[:3]
    found = secrets.scan(storage.read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(secrets.joined(F.col("spans"), base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot, shard and record of every sequence of every document, after writing the shards to the shared folder."""
    return shards.materialise(storage.read(spark, sf_dir, "documents"), storage.new_path(spark, "shards"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 4096 tokens."""
    return packing.pack(packing.cut_pieces(storage.read(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels are learnt outside the held-out third."""
    docs, labels = storage.read(spark, sf_dir, "documents"), storage.read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, training=toxicity.fold(F.col("doc_id"), 3) != 1)
    return _scored(toxicity.score(docs, model), 3, 1)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    found = licenses.scan(storage.read(spark, sf_dir, "documents"), "text", "found")
    joined = lambda name: F.array_join(F.col(f"found.{name}"), ",").alias(name)
    return found.select("doc_id", "found.n_words", "found.n_base", "found.first_word", "found.last_word", joined("base_labels"), joined("labels"), "found.score")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return templates.extract(storage.read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    return covertree.top_k(storage.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels are learnt outside the held-out quarter."""
    docs, labels = storage.read(spark, sf_dir, "documents"), storage.read(spark, sf_dir, "labels")
    rows, _ = storage.materialize(quality.features(docs), "statistics")
    known = labels.where((toxicity.fold(F.col("doc_id"), 4) != 2) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return _scored(quality.score(rows, quality.fit(rows.join(known, "doc_id"), "quality")), 4, 2)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with its best window."""
    return decontaminate.contaminated(storage.read(spark, sf_dir, "documents"), storage.read(spark, sf_dir, "benchmark"))


def _scored(scores: DataFrame, n: int, held: int) -> DataFrame:
    return scores.select("doc_id", (toxicity.fold(F.col("doc_id"), n) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline: its last stage's rows."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard": op1_jaccard,
        "op2_secrets": op2_secrets,
        "op3_shards": op3_shards,
        "op4_packing": op4_packing,
        "op5_toxicity": op5_toxicity,
        "op6_licenses": op6_licenses,
        "op7_html": op7_html,
        "op8_topk": op8_topk,
        "op9_quality": op9_quality,
        "op10_decontamination": op10_decontamination,
        "pipeline": pipeline,
    }


#: Shingle sets, all linked pairs and their transitive closure.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), s AS (SELECT doc_id, unnest(sh) AS h FROM sets
), n AS (SELECT doc_id, len(sh) AS n FROM sets
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(least(low.b, n.doc_id), n.doc_id) AS component_id
FROM n LEFT JOIN low ON low.a = n.doc_id
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.r, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.r <> d.r AND len(q.e) = len(d.e)
), ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard": OP1_SQL, "op8_topk": OP8_SQL}
