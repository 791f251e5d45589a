"""A corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, sharding.

Every stage reads what its predecessor kept, and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import language
from webloom.llm.columns import remainder
from webloom.llm.decontaminate import find_contamination
from webloom.llm.mixing import mix_sources
from webloom.llm.ngram_join import drop_similar
from webloom.llm.sharding import shard_documents
from webloom.plans.tables import Stash, bounded, spare, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def columns_of(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language model rejects (no letter, or too far from every centroid for their
    length); the others carry the language that the model gives them.

    Null and empty texts have no letter. Every row is judged by its own text, repeats too; an empty table stays so.
    """
    model = language.fit(docs, remainder(F.col("doc_id"), 4) != 2)
    found = language.predict(docs.select(columns_of(docs)), model, keep_text=True).where("not rejected")
    return found.withColumn("lang", F.col("lang_pred")).select(columns_of(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones (five words, 0.8): that with the smallest id.

    A null id stands after all others; of rows that share an id one text stays, of repeated rows one; wordless
    texts are similar to nothing.
    """
    return drop_similar(docs).select(columns_of(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows hit at least one word in twenty.

    Each row is judged by its own text: of rows that share an id, the clean ones stay. Null text has no words and stays.
    """
    stash = Stash(spark, "contaminated")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    gone = bounded(stash.put(found.select("doc_id", "text_hash").distinct(), "rows"))
    same = docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["text_hash"])
    return docs.join(gone, same, "left_anti").select(columns_of(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents as the mix takes them: whole copies, as many as the words taken make up.

    A document taken once and a half is there twice; one not taken, or without words, is gone. Rows that share an id
    are copied alike, as often as the most taken of them; a null source is a source of its own.
    """
    same_id, copies = spare(docs, "same_id", "copies")
    taken = mix_sources(docs).where("taken > 0").groupBy(F.col("doc_id").alias(same_id)).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias(copies))
    joined = docs.join(taken, docs["doc_id"].eqNullSafe(taken[same_id]))
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), copies))).select(columns_of(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every row in a shard and a slot; null ids share a shard, repeated rows have a slot each."""
    return shard_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stash = Stash(spark, "pipeline")
    for name, stage in STAGES:
        docs = stash.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
