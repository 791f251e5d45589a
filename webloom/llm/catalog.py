"""Queries of the operators of this subpackage, and SQL that checks them where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import language, merkle, oracles, pieces, quality
from webloom.llm.columns import remainder
from webloom.llm.decontaminate import find_contamination
from webloom.llm.exact_dedup import exact_duplicates
from webloom.llm.filter_audit import audit_filters
from webloom.llm.main_text import extract_main_text
from webloom.llm.mixing import mix_sources
from webloom.llm.ngram_join import count_links
from webloom.llm.private_data import KINDS, find_private_data
from webloom.llm.sharding import shard_documents
from webloom.llm.substring_dedup import remove_repeats
from webloom.plans.tables import table


def op1_join_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_links(table(spark, sf_dir, "documents"), size=3, percent=90)


def op2_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_find_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op6_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op7_find_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private_data(table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(k) for k in (*KINDS, "term")))
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    # a filter's second argument would be the place in the array, so the kind is bound by a function of its own
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate((*KINDS, "terms"))]
    return found.select("doc_id", *counts[:-1], "base_sha256", joined.alias("spans"), counts[-1], "sanitised_sha256")


def op8_extract_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, remainder(F.col("doc_id"), 4) != 2)
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op11_encode_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    vocabulary = pieces.read_vocabulary(model or public_tokenizers.path("piece_bpe_32k.model"))
    both = pieces.encode(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"], decoded="decoded")
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_audit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prove_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first, last = ["doc_id", "source", "lang"], "text"
    tampered = F.when(remainder(F.col("doc_id"), 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    digest = lambda n_chars: merkle.leaf_digest(*map(F.col, first), n_chars, F.col(last))
    rows = docs.select("doc_id", "lang", digest(F.col("n_chars")).alias("leaf"), digest(tampered).alias("changed"))
    proved = merkle.build_manifest(rows, "lang", "doc_id", "leaf").proofs()
    siblings = F.concat_ws("", F.transform("steps", lambda step: F.concat(step["left"], step["right"])))
    folded = proved.withColumn("folded_root", merkle.fold(F.col("changed"), F.col("steps")))
    return folded.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracles.SQL.items() if name in queries()}
