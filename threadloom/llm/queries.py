"""The numbered queries over the corpus tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import byte_bpe, fertility, lsh_forest, merkle_manifest, mixing, pivot_index, private_data, rtree_negatives, shard_tree, string_kernel, subspace_join, suffix_dedup, token_files
from threadloom.llm.manifest_sql import MANIFEST
from threadloom.session import read_table, scratch_path

VOCABULARY_FILE = public_tokenizers.path("byte_bpe_50k.json")
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PIECE_MODEL = Path(public_tokenizers.path("piece_bpe_32k.model"))
SHARDS = 40


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    vocabulary = byte_bpe.vocabulary_from_file(VOCABULARY_FILE)
    token_files.write(read_table(spark, folder, "documents"), path, vocabulary, PATTERN, end_id=0)
    rows = token_files.read(spark, path)
    rows = rows.select("doc_id", "position", F.col("n_tokens").cast("long"), token_files.ids_crc32("ids").alias("ids_crc32"))
    return token_files.with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_pivot_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings").select("vec_id", pivot_index.floor_scaled(F.col("embedding")).alias("vector"))
    return pivot_index.search(rows, F.col("vec_id") % 50 == 0, k=5)


def op3_shard_tree(spark: SparkSession, folder: str) -> DataFrame:
    tree = shard_tree.regular_tree(SHARDS)
    out = shard_tree.assign(read_table(spark, folder, "documents"), tree, shard_tree.with_region(tree, SHARDS))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    return lsh_forest.group(read_table(spark, folder, "documents"), width=3, percent=85).drop("text_hash", "component")


def op5_fertility(spark: SparkSession, folder: str) -> DataFrame:
    docs = fertility.rate(read_table(spark, folder, "documents").select("doc_id", "text", "lang"), PIECE_MODEL.read_bytes())
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return docs.select("doc_id", *[F.col(f"measure.{c}") for c in base], "base_failed", "kept")


def op6_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = mixing.mix(read_table(spark, folder, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = byte_bpe.vocabulary_from_ranks(RANK_FILE, PATTERN)
    docs = byte_bpe.encode(read_table(spark, folder, "documents").select("doc_id", "text"), vocabulary, PATTERN)
    docs = byte_bpe.decode(docs.select("doc_id", "ids"), vocabulary, PATTERN)
    return docs.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), byte_bpe.ids_digest_column("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_private_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    found = private_data.find(docs, private_data.fit(docs))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == private_data.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[n(k) for k in ("email", "ip", "card", "phone")], F.sha2(private_data.written(F.col("base")), 256).alias("base_sha256"),
        private_data.written(F.col("spans")).alias("spans"),
    )


def op9_string_kernel(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    model = string_kernel.fit(docs, read_table(spark, folder, "labels"))
    out = string_kernel.score(docs, model)
    return out.select("doc_id", string_kernel.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read_table(spark, folder, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_rtree_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, folder, "embeddings").select("vec_id", label.alias("label"), pivot_index.floor_scaled(F.col("embedding")).alias("vector"))
    return rtree_negatives.mine(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


def op12_subspace_join(spark: SparkSession, folder: str) -> DataFrame:
    return subspace_join.group(read_table(spark, folder, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle_manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed={"text": text})
    folded = merkle_manifest.fold(F.col("other_leaf"), F.col("witness"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("witness")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_pivot_index, op3_shard_tree, op4_lsh_forest, op5_fertility, op6_pareto_mix, op7_byte_bpe, op8_private_data, op9_string_kernel, op10_suffix_dedup, op11_rtree_negatives, op12_subspace_join, op13_merkle_manifest)}
ORACLE_SQL: dict[str, str] = {
    "op11_rtree_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
        positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
            other_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN pairs USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
    "op12_subspace_join": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        good AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v
            WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u)
            AND list_inner_product(a.u, b.u) >= 0.9),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a), m AS (SELECT a, min(b) AS lowest FROM reach GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(lowest, vec_id)) AS component_id,
            vec_id <= coalesce(lowest, vec_id) AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id""",
    "op13_merkle_manifest": MANIFEST,
}
