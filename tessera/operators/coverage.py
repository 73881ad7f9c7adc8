"""Lexical coverage of demand items by test requirements."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.storage import bound_batches


FEW_KEYWORDS, FEW_OF_SOURCE = 200_000, 2_000  # some 20 bytes each go to every task


def keywords(c: str, k: int = 3) -> F.Column:
    """The first k words of three or more characters."""
    return F.slice(F.filter(T.words(F.lower(c)), lambda w: F.length(w) >= 3), 1, k)


def item_coverage(items: DataFrame, texts: DataFrame) -> DataFrame:
    """items (source_id, ordinal, text) with `covered`: some keyword is part of some text of the source.

    Keywords hold no white space, so a match never spans two texts. Where they are few (`FEW_KEYWORDS` in all and `FEW_OF_SOURCE` of a source, which is
    counted) they go to the tasks, which search texts where they lie for those that they haven't met yet; else the source's distinct words, which
    combine before the shuffle, meet the keywords by their first three letters.
    """
    asked = items.select("source_id", "ordinal", F.explode(keywords("text")).alias("keyword"))
    own = asked.select("source_id", "keyword").distinct().groupBy("source_id").agg(F.collect_set("keyword").alias("keywords"))
    n = own.agg(F.sum(F.size("keywords")).alias("all"), F.max(F.size("keywords")).alias("most")).first()
    if (n["all"] or 0) <= FEW_KEYWORDS and (n["most"] or 0) <= FEW_OF_SOURCE:
        hit = _search(own, texts)
    else:
        hit = _by_parts(asked, texts)
    yes = asked.join(hit, ["source_id", "keyword"], "left_semi").select("source_id", "ordinal").distinct().withColumn("covered", F.lit(True))
    return items.join(yes, ["source_id", "ordinal"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def _search(own: DataFrame, texts: DataFrame) -> DataFrame:
    """source_id, keyword of those that are part of some text of the source. A keyword that a task has met isn't looked for again."""
    asked = {r["source_id"]: r["keywords"] for r in own.filter("source_id is not null").collect()}  # FEW_KEYWORDS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = {source: set(words) for source, words in asked.items()}
        for batch in batches:
            sources, found = [], []
            for source, low in zip(batch.column("source_id").to_pylist(), batch.column("low").to_pylist(), strict=True):
                if (wanted := left.get(source)) and (met := [k for k in wanted if k in low]):
                    wanted.difference_update(met)
                    sources += [source] * len(met)
                    found += met
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(sources, batch.column("source_id").type), pa.array(found, pa.string())], ["source_id", "keyword"])

    bound_batches(texts.sparkSession)
    each = texts.filter(F.col("text").isNotNull()).select("source_id", F.lower("text").alias("low"))
    return each.mapInArrow(run, f"source_id {each.schema['source_id'].dataType.simpleString()}, keyword string").distinct()


def _by_parts(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """source_id, keyword of those that are part of a word of the source's texts."""
    found = texts.select("source_id", F.explode(T.token_set("text")).alias("word")).distinct()
    # a keyword has three letters or more, so a word that holds it holds its first three
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda k: F.substring(F.col("word"), k, F.lit(3))))
    found = found.filter(F.length("word") >= 3).select("source_id", "word", F.explode(parts).alias("part"))
    distinct = asked.select("source_id", "keyword", F.substring("keyword", 1, 3).alias("part")).distinct()
    same = (distinct["source_id"] == found["source_id"]) & (distinct["part"] == found["part"])
    return distinct.join(found, same & F.contains(found["word"], distinct["keyword"]), "left_semi").select("source_id", "keyword")


def coverage_score(items: DataFrame, texts: DataFrame, listed: int = 10) -> DataFrame:
    """source_id, total, covered, score, uncovered (the first `listed`)."""
    c = item_coverage(items, texts)
    missing = F.transform(F.slice(F.sort_array(F.collect_list(F.when(~F.col("covered"), F.struct("ordinal", "text")))), 1, listed), lambda x: x["text"])
    return c.groupBy("source_id").agg(F.count("*").alias("total"), F.count_if("covered").alias("covered"), F.round(F.count_if("covered") / F.count("*"), 6).alias("score"), missing.alias("uncovered"))
