"""The queries op1 to op10 that __spark_entry__.py registers when this subpackage is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_tree, embed_tiles, html_crf, line_chunks, packing, positional_index, secret_linking, simhash_gray, toxicity, warc
from .common import table
from .oracle import ORACLE_SQL as ORACLE_SQL


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.main_text(table(spark, sf_dir, "pages"))


def op2_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_linking.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == secret_linking.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_linking.as_text("base"), 256).alias("base_sha256"), secret_linking.as_text("spans").alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_chunks.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"), line_chunks.spans)
    return out.select("row.doc_id", "text", "n_lines", "n_removed")


def op4_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_tree.Tree(rows, tokenizer_path("byte_bpe_50k.json")).read_back()


def op5_embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embed_tiles.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), F.size("passages").alias("n_passages"))


def op7_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = positional_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    bad = positional_index.contaminated(F.col("n_words"), F.col("n_hit"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), bad.alias("contaminated"))


def op8_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_gray.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash_gray.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (op1_html_crf, op2_secret_linking, op3_line_dedup, op4_chat_prefix_tree, op5_embedding_tiles, op6_toxicity, op7_positional_decontamination, op8_simhash_gray, op9_warc_derivatives, op10_best_fit_packing)
}
