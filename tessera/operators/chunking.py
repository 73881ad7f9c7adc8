"""Sections to chunks within a word budget."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import CHUNK_BUDGETS, DEFAULT_BUDGET
from tessera.functions import text as T
from tessera.plans.storage import bound_batches


_META = "struct(section_id as section_id, {i} as chunk_index, cast({n} as int) as token_count, {o} as overlap) as metadata"
FOLDED = "source_id string, artifact_type string, section_id int, section_ref string, i int, content string, words int, seeded boolean"


def with_budget(sections: DataFrame) -> DataFrame:
    """most, overlap and unit of each section, by the kind of document."""
    kind = F.col("artifact_type")
    out = [F.lit(x) for x in DEFAULT_BUDGET]
    for name, budget in CHUNK_BUDGETS.items():
        out = [F.when(kind == name, F.lit(x)).otherwise(o) for x, o in zip(budget, out, strict=True)]
    return sections.withColumns(dict(zip(("most", "overlap_words", "unit"), out, strict=True)))


def pack_units(units: list[str], most: int, overlap: int) -> list[tuple[str, int, bool]]:
    """(content, words, begins with an overlap): greedy, each chunk after the first seeded with the last one's tail.

    If the tail alone leaves no room for the next unit the tail is dropped, so every chunk takes a unit at least.
    """
    packer, out = Packer(most, overlap), []
    for u in units:
        out += packer.add(u)
    return out + packer.close()


@dataclass
class Packer:
    """The chunk that is open: its units, beginning with the last chunk's tail if it is seeded, and how many units it has taken itself."""

    most: int
    overlap: int
    rows: list = field(default_factory=list)  # (text, words)
    taken: int = 0
    seeded: bool = False

    def add(self, unit: str) -> list[tuple[str, int, bool]]:
        """Takes a unit; the chunk that has no room for it is returned, and its tail opens the next."""
        n, out = len(unit.split()), []
        total = sum(k for _, k in self.rows)
        if self.taken and total + n > self.most:
            out = self.close()
            self.rows, self.taken = self._tail(), 0
            total = sum(k for _, k in self.rows)
        if not self.taken:
            if self.rows and total + n > self.most:
                self.rows = []
            self.seeded = bool(self.rows)
        self.rows.append((unit, n))
        self.taken += 1
        return out

    def close(self) -> list[tuple[str, int, bool]]:
        return [(" ".join(u for u, _ in self.rows), sum(n for _, n in self.rows), self.seeded)] if self.taken else []

    def _tail(self) -> list[tuple[str, int]]:
        tail, words = [], 0
        for u, n in reversed(self.rows):
            if words + n > self.overlap:
                break
            tail.insert(0, u)
            words += n
        return [(" ".join(tail), words)] if tail else []


def chunk(sections: DataFrame) -> DataFrame:
    """Chunks of all sections. Sections within the budget never leave the JVM; the others are folded row by row, without a shuffle."""
    rows = with_budget(sections.filter(F.coalesce("text", F.lit("")) != "")).withColumn("n", T.word_count("text"))
    whole = rows.filter("n <= most").select(
        T.chunk_id("source_id", "section_id", F.lit(1)).alias("chunk_id"), "source_id", "artifact_type", F.col("text").alias("content"), F.col("section_ref").alias("page_ref"),
        F.expr(_META.format(i=1, n="n", o="false")),
    )
    units = rows.filter("n > most").select("source_id", "artifact_type", "section_id", "section_ref", "most", "overlap_words", T.split_units("text", "unit").alias("units"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # bounded in bytes
            out = [(r.source_id, r.artifact_type, r.section_id, r.section_ref, i, *c) for r in pdf.itertuples() for i, c in enumerate(pack_units(list(r.units), r.most, r.overlap_words), 1)]
            yield pd.DataFrame(out, columns=["source_id", "artifact_type", "section_id", "section_ref", "i", "content", "words", "seeded"])

    bound_batches(sections.sparkSession, 4 << 20)
    folded = units.mapInPandas(fold, FOLDED)
    return whole.unionByName(numbered(folded)).to(schema(schemas.CHUNK))


def numbered(folded: DataFrame) -> DataFrame:
    """Chunks with their ids, from source_id, artifact_type, section_id, section_ref, i, content, words, seeded."""
    return folded.select(T.chunk_id("source_id", "section_id", "i").alias("chunk_id"), "source_id", "artifact_type", "content", F.col("section_ref").alias("page_ref"), F.expr(_META.format(i="i", n="words", o="seeded")))


def schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def chunk_stats(chunks: DataFrame, tiny: int = 20, warn_above: float = 0.4) -> DataFrame:
    """Per source: chunks, least, most and mean words, overlapping ones, and whether too many are tiny."""
    n = F.col("metadata.token_count")
    return chunks.groupBy("source_id").agg(
        F.count("*").alias("chunks"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.avg(n).alias("mean_tokens"),
        F.count_if("metadata.overlap").alias("overlapping"), (F.count_if(n < tiny) / F.count("*") > warn_above).alias("too_many_tiny"),
    )
