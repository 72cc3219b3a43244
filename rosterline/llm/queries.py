"""One query per operator, over whole tables with production parameters, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.llm import centroid_clustering, embedding_index, language_id, merkle, ngram_jaccard, packing, quality_cotraining, recompression, sentencepiece_sampling, sharding, token_alignment, url_graph, warc
from rosterline.llm.common import table

#: (verdict, host, path), as the contract gives them.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


#: Pages have no crawl date; records get this one.
WARC_DATE = "2024-01-01T00:00:00Z"


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_from_pages(table(spark, sf_dir, "pages"), WARC_DATE))


def op2_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_sampling.sample_segmentations(table(spark, sf_dir, "documents"), model, k=3, with_ids=False, verify=True)


def op3_lsh_forest_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op4_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_index.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_cotraining.scores(docs, labels).select("doc_id", "_quality.*")


def op6_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )


def op7_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op9_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op10_link_graph_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_elkan_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = centroid_clustering.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=64, scale=1024)
    out, centroids, _ = centroid_clustering.elkan_kmeans(vectors, centroid_clustering.first_by_hash(vectors, k=8, seed=3), rounds=10)
    digest = F.element_at(F.array([F.lit(centroid_clustering.digest(c)) for c in centroids] or [F.lit("")]), F.col("cluster") + 1)
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_recompression_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.without_repeats(table(spark, sf_dir, "documents"), window=13).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.corpus_alignment(table(spark, sf_dir, "documents"), *paths)[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_warc_derivatives, op2_gumbel_segmentations, op3_lsh_forest_jaccard, op4_inverted_multi_index, op5_cotraining_quality, op6_lpt_sharding, op7_kneser_ney_language,
        op8_best_fit_packing, op9_merkle_fingerprints, op10_link_graph_urls, op11_elkan_clustering, op12_recompression_repeats, op13_token_alignment,
    )
    return {f.__name__: f for f in found}


ORACLE_SQL: dict[str, str] = {"op1_warc_derivatives": warc.oracle_sql(WARC_DATE), "op9_merkle_fingerprints": merkle.oracle_sql(), "op11_elkan_clustering": centroid_clustering.oracle_sql(), "op12_recompression_repeats": recompression.ORACLE_SQL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
