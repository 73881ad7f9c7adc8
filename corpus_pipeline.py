"""A corpus pipeline: toxicity, language, near duplicates, benchmark contamination, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, neardup, packing, toxicity
from tessera.llm.queries import CAPACITY, table, tokenizer_path
from tessera.plans.storage import materialize, release


def wrapped(docs: DataFrame) -> DataFrame:
    """The text, and all other columns within one, so that no name clashes with an operator's own."""
    return docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row"), "text")


def unwrapped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the passages search doesn't call toxic; learned on the labelled documents of the corpus."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return unwrapped(toxicity.score(wrapped(docs), model, ["row", "text"]).filter("predicted = 0"), docs)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the dictionaries tell by a margin."""
    blocks = langid.learn(table(spark, sf_dir, "documents"))
    return unwrapped(langid.identify(wrapped(docs), blocks, ["row", "text"]).filter("not rejected"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets with a similarity of 0.8 or more: the one with the smallest id.

    Rows are judged one by one: where ids are missing or repeated, rows are numbered in the order of ids (missing ones
    last) and texts, so of rows with equal texts one stays. Texts without words are like no other, and all stay.
    """
    keyed = wrapped(docs).withColumn("doc_id", F.col("row.doc_id"))
    if not docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        order = [F.col("doc_id").asc_nulls_last(), F.md5(F.col("text").cast("binary")), F.xxhash64("spread")]
        spread = keyed.withColumn("spread", F.monotonically_increasing_id())
        keyed = spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread")
        keyed = materialize(keyed.withColumn("doc_id", F.monotonically_increasing_id()), "keyed")
    removed = materialize(neardup.near_duplicates(keyed, n=5, threshold=0.8).filter("not kept").select("doc_id"), "removed")
    gone = F.broadcast(removed) if removed.count() <= neardup.BROADCAST_IDS else removed
    return unwrapped(keyed.join(gone, "doc_id", "left_anti"), docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go (hit words are a twentieth of all or more); of others the benchmark's passages are cut out."""
    found = decontam.contamination(wrapped(docs), table(spark, sf_dir, "benchmark"), ["row", "text"])
    out = unwrapped(decontam.remove_spans(found.filter("not contaminated").select("row", "text", "spans")), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in training sequences."""
    return packing.best_fit_pack(docs, tokenizer_path(), CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: Learned scores, similarity joins and tokenizer ids are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            release(before)
        before = docs
    return docs
