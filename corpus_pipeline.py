"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and
reads again as the docs of the next. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.llm import chunk_dedup, language_id, lsh_forest, mixing, packing
from grainline.llm.common import WORD, remainder, stored, table
from grainline.session import ship


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter (null, empty) go, as rejected. Models are learnt
    from these documents, a fifth of them apart; with an empty table none stay."""
    ship(spark)
    models = language_id.fit(docs.where(remainder(5) != 0).select("doc_id", "text", "lang"))
    return language_id.identify(docs, models, "_gl_").where("not _gl_rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id (null after all others); documents
    without words (null, empty, white space) are in no group and all stay. Unrelated documents of one doc_id, or
    without any, are groups of their own; equal rows are one group."""
    found = lsh_forest.near_duplicates(docs).where("component is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")).alias("_gl_first")
    keep = found.groupBy("component").agg(first).select(*[F.col(f"_gl_first.{c}").alias(f"_gl_{c}_kept") for c in ("doc_id", "h1", "h2")])
    h1, h2 = lsh_forest.hashes(F.col("text"))
    d = docs.withColumns({"_gl_h1": h1, "_gl_h2": h2})
    same = F.col("doc_id").eqNullSafe(F.col("_gl_doc_id_kept")) & (F.col("_gl_h1") == F.col("_gl_h1_kept")) & (F.col("_gl_h2") == F.col("_gl_h2_kept"))
    one = d.join(keep, same).dropDuplicates(["doc_id", "_gl_h1", "_gl_h2"]).select(*docs.columns)
    return one.unionAll(docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; one of nothing else goes, null and wordless texts
    stay as they are; n_chars follows the text."""
    d = chunk_dedup.deduplicate(docs)
    return d.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in d.columns else d


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: equal rows share their copies evenly, texts without words have size 0
    and are never taken, a null source is a source of its own."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; a null text counts as empty and holds the end id alone."""
    return packing.pack(docs, packing.default_vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: Models, tries, chunk cuts, balanced sampling and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
