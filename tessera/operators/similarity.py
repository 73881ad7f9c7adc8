"""Near-duplicate rows by token sets: pairs within a horizon, and the greedy merge."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.positions import ordered


def window_pairs(rows: DataFrame, text: str, keys: list[str], ordinal: str, above: float = 0.75, horizon: int = 19) -> DataFrame:
    """Pairs (i, j are ordinals) at most `horizon` rows apart in the order of a key's rows whose Jaccard similarity exceeds `above`.

    Rows are counted by gapless positions, whatever gaps their ordinals have (of equal ones the row whose text has the lesser md5 comes first); rows without words count too. Positions fall into buckets
    of horizon + 1 places and the right side stands in two of them, so the range becomes an equality join of bounded
    buckets even if one key holds most of the rows. Token sets are written once, as 64-bit hashes; sizes rule out most pairs before
    sets are intersected. The result reads the table of token sets; `release` deletes it once that isn't read any more.
    """
    tokens = F.array_distinct(F.transform(T.words(F.lower(text)), lambda w: F.xxhash64(w)))
    placed = ordered(rows.select(*keys, F.col(ordinal).cast("long").alias("o"), F.md5(F.col(text).cast("binary")).alias("tie"), tokens.alias("t")), [*keys, "o", "tie"], "tokens")
    base = placed.filter(F.size("t") > 0)
    step = F.lit(horizon + 1)
    bucket = F.floor(F.col("place") / step)
    left = base.select(*keys, bucket.alias("b"), F.col("place").alias("at"), F.col("o").alias("i"), F.col("t").alias("x"))
    right = base.select(*keys, F.explode(F.array(bucket, bucket - 1)).alias("b"), F.col("place").alias("to"), F.col("o").alias("j"), F.col("t").alias("y"))
    near = left.join(right, [*keys, "b"]).filter((F.col("to") > F.col("at")) & (F.col("to") <= F.col("at") + horizon))
    near = near.filter(F.least(F.size("x"), F.size("y")) > above * F.greatest(F.size("x"), F.size("y")))
    both = F.size(F.array_intersect("x", "y"))
    pairs = near.withColumn("similarity", both / (F.size("x") + F.size("y") - both))
    out = pairs.filter(F.col("similarity") > above).select(*keys, "i", "j", F.round("similarity", 6).alias("similarity"))
    out.scratch = placed.scratch
    return out


MERGED = "source_id string, ordinal int, item_id string, description string, priority string, source_ids array<string>"


class Heads:
    """The rows that stay, each with what it has grown to, found by the first tokens of their sets."""

    def __init__(self, above: float):
        self.above, self.rows, self.sets = above, [], []
        self.by_token: dict[str, set[int]] = {}

    def prefix(self, tokens: set[str]) -> list[str]:
        """Sets that are alike enough share one of their first tokens; long ones, which are rarer, come first."""
        return sorted(tokens, key=lambda t: (-len(t), t))[: len(tokens) - math.ceil(self.above * len(tokens) - 1e-9) + 1]

    def add(self, ordinal: int, item_id: str, text: str, priority: str, ids: list[str]) -> None:
        """A row goes to the first that it is like, or stays."""
        own = set(text.lower().split())
        near = set().union(*[self.by_token.get(t, ()) for t in self.prefix(own)]) if own else ()
        for k in sorted(near):
            a = self.sets[k]
            if min(len(a), len(own)) > self.above * max(len(a), len(own)) and len(a & own) / len(a | own) > self.above:
                head = self.rows[k]
                head[4] |= set(ids)
                if len(text) > len(head[2]):
                    self._place(k, own)
                    head[2] = text
                return
        self.rows.append([ordinal, item_id, text, priority, set(ids)])
        self.sets.append(set())
        self._place(len(self.rows) - 1, own)

    def _place(self, k: int, tokens: set[str]) -> None:
        for t in self.prefix(self.sets[k]) if self.sets[k] else ():
            self.by_token[t].discard(k)
        self.sets[k] = tokens
        for t in self.prefix(tokens) if tokens else ():
            self.by_token.setdefault(t, set()).add(k)


def greedy_merge(rows: DataFrame, above: float = 0.75) -> DataFrame:
    """source_id, ordinal, item_id, description, priority, source_ids: each row absorbs later ones that are like what it has grown to.

    The longer description wins, id and priority stay the first row's, source ids are united and sorted. A row goes to the first of those
    before it that takes it, so rows stream past in their order and a task keeps those that stay; they are found by prefixes of
    their token sets. What a row becomes depends on all before it, so a source is one stream.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(source: str, heads: Heads) -> Iterator[pd.DataFrame]:
            for lo in range(0, len(heads.rows), 10_000):
                out = [(source, *head[:4], sorted(head[4])) for head in heads.rows[lo : lo + 10_000]]
                yield pd.DataFrame(out, columns=["source_id", "ordinal", "item_id", "description", "priority", "source_ids"])

        source, heads = None, Heads(above)
        for pdf in batches:
            for r in pdf.itertuples():
                if r.source_id != source:
                    yield from told(source, heads)
                    source, heads = r.source_id, Heads(above)
                heads.add(r.ordinal, r.item_id, r.description or "", r.priority, list(r.source_ids) if r.source_ids is not None else [])
        yield from told(source, heads)

    ordered_rows = rows.select("source_id", "ordinal", "item_id", "description", "priority", "source_ids").repartition("source_id").sortWithinPartitions("source_id", "ordinal")
    return ordered_rows.mapInPandas(fold, MERGED)
