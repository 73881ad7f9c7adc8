"""Sharding by balanced label propagation: linked documents move to their neighbours' shards under capacity quotas.

Nodes carry a size and a shard; a link ties a node to a hub, and nodes of one hub are neighbours (a hub
stands for all pairs of its nodes, so links stay linear). Each round joins links with the nodes' shards, finds for every
node the shard that holds most of the bytes of it and its neighbours, and lets nodes move there, largest gain
first, as far as the shard's free capacity goes. What the driver holds is a few counts per shard.

`shard_documents` links equal texts and keeps the law `bytes`: documents of one text are grouped to cells by
a salt of their id, so that a text with a third of all rows is many small nodes, and unlinked documents then
fill the shards to equal sizes: those that are large against a shard one by one, the rest in one stream.

Defined cases: null texts have size 1 and link with nothing; empty texts are equal texts; repeated rows get a slot each; an empty
table gives no rows. Columns other than the id and the text are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.storage import materialize, release

#: Gains are told apart by powers of two and, within one, by this many hash values.
_STEPS = 16
#: Documents over this part of a shard's share are placed one by one.
_LARGE = 64


def propagate(nodes: DataFrame, links: DataFrame, shards: int, capacity: float, rounds: int = 6) -> DataFrame:
    """nodes (id, size, shard) with new shards; links are (id, hub). No shard grows beyond `capacity` by moves."""
    for _ in range(rounds):
        placed = links.join(nodes, "id")
        weight = placed.groupBy("hub", F.col("shard").alias("to")).agg(F.sum("size").alias("w"))
        own = placed.join(weight, "hub").groupBy("id", "size", "shard", "to").agg(F.sum("w").alias("w"))
        best = own.groupBy("id", "size", "shard").agg(
            F.max(F.struct("w", (-F.col("to")).alias("t"))).alias("x"),
            F.max(F.when(F.col("to") == F.col("shard"), F.col("w")).otherwise(0)).alias("here"),
        ).select("id", "size", "shard", (-F.col("x.t")).alias("to"), (F.col("x.w") - F.col("here")).alias("gain"))
        # equal pulls go to the smaller shard, so that two halves of a group don't change places
        wants = (F.col("to") != F.col("shard")) & ((F.col("gain") > 0) | ((F.col("gain") == 0) & (F.col("to") < F.col("shard"))))
        step = (62 - F.floor(F.log2(F.greatest("gain", F.lit(1))))) * _STEPS + F.pmod(F.xxhash64("id"), F.lit(_STEPS))
        moves = materialize(best.filter(wants).select("id", "size", "shard", "to", step.cast("int").alias("step")), "moves")
        loads = {r["shard"]: r["n"] for r in nodes.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
        asked = moves.groupBy("to", "step").agg(F.sum("size").alias("n")).orderBy("to", "step").collect()
        free = {s: capacity - loads.get(s, 0) for s in range(shards)}
        granted = []
        for r in asked:
            if r["n"] <= free[r["to"]]:
                free[r["to"]] -= r["n"]
                granted.append(str(r["to"] * 1024 + r["step"]))
        if not granted:
            release(moves)
            break
        # shards * 63 * _STEPS values at most
        moved = moves.filter(f"to * 1024 + step in ({', '.join(granted)})").select("id", F.col("to").alias("new"))
        before, nodes = nodes, materialize(nodes.join(moved, "id", "left").select("id", "size", F.coalesce("new", "shard").alias("shard")), "nodes")
        release(moves)
        if hasattr(before, "scratch"):
            release(before)
    return nodes


def listed(values: list, index: str, kind: str) -> F.Column:
    """The value at the column `index` of a list that is part of the plan."""
    return F.expr(f"element_at(cast(array({', '.join(map(str, values)) or '0'}) as array<{kind}>), {index} + 1)")


def water_level(loads: list[int], rest: int) -> float:
    """The common level that `rest` fills the lowest loads up to."""
    low = sorted(loads)
    levels = ((rest + sum(low[:n])) / n for n in range(1, len(low) + 1))
    return next(x for n, x in enumerate(levels, 1) if n == len(low) or x <= low[n])


def shard_documents(documents: DataFrame, shards: int = 8, rounds: int = 6, salts: int = 64, buckets: int = 1024, id_column: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    `salts` bounds the share of a repeated text that moves at once; `buckets` * `shards` bounds what the driver holds.
    """
    spark = documents.sparkSession
    raw = F.col("text").cast("binary")
    base = documents.select(
        F.col(id_column).alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.crc32(F.lit("").cast("binary"))).alias("text_crc32"),
        F.unhex(F.md5(raw)).alias("key"),
    )
    base = base.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    base = materialize(base.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(buckets)).cast("int")), "sizes")
    cells = materialize(base.filter("key is not null").groupBy("key", "salt").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "cells")
    linked = cells.groupBy("key").agg(F.sum("n").alias("all")).filter("all > 1").select("key")
    cell = F.concat("key", F.unhex(F.lpad(F.hex("salt"), 4, "0")))
    nodes = materialize(cells.join(linked, "key").select(cell.alias("id"), F.col("key").alias("hub"), "salt", "size"), "nodes")
    total = base.agg(F.sum("size").alias("n")).first()["n"] or 0
    start = nodes.select("id", "size", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    # documents beyond an even share fill shards of their own; the quota is an even share of the rest
    over = base.filter(F.col("size") * shards > total).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    quota = (total - over["size"]) / max(shards - over["n"], 1)
    settled = propagate(start, nodes.select("id", "hub"), shards, quota, rounds)
    settled = materialize(settled.join(nodes.select("id", "hub", "salt"), "id").select(F.col("hub").alias("key"), "salt", "shard", F.col("size").alias("bytes")), "settled")
    loads = {r["shard"]: r["n"] for r in settled.groupBy("shard").agg(F.sum("bytes").alias("n")).collect()}
    joined = materialize(base.join(settled.select("key", "salt", "shard"), ["key", "salt"], "left").select("doc_id", "size", "text_crc32", "bucket", "shard"), "placed")
    # the few that are large against a shard go one by one, largest first, to where least lies: `shards` * _LARGE at most
    kind = joined.schema["doc_id"].dataType
    alone = joined.filter(F.col("shard").isNull() & (F.col("size") * shards * _LARGE > total)).select("doc_id", "size", "text_crc32").collect()
    large = []
    for r in sorted(alone, key=lambda r: -r["size"]):
        to = min(range(shards), key=lambda s: (loads.get(s, 0), s))
        loads[to] = loads.get(to, 0) + r["size"]
        large.append((r["doc_id"], r["size"], r["text_crc32"], to))
    if large:
        schema = T.StructType([T.StructField("id", kind), T.StructField("z", T.LongType()), T.StructField("crc", T.LongType()), T.StructField("to", T.IntegerType())])
        at = F.broadcast(spark.createDataFrame(large, schema))
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("size") == F.col("z")) & (F.col("text_crc32") == F.col("crc"))
        joined = joined.join(at, same, "left").withColumn("shard", F.coalesce("shard", "to")).drop("id", "z", "crc", "to")
    # the other unlinked fill what is free, in the order of buckets and ids
    per = {r["bucket"]: r["n"] for r in joined.filter("shard is null").groupBy("bucket").agg(F.sum("size").alias("n")).collect()}
    rest = sum(per.values())
    level = water_level([loads.get(s, 0) for s in range(shards)], rest)
    room = [max(level - loads.get(s, 0), 0.0) for s in range(shards)]
    before, at = {}, 0
    for b in sorted(per):
        before[b], at = at, at + per[b]
    loose = F.when(F.col("shard").isNull(), F.col("size")).otherwise(0)
    run = joined.withColumn("mass", loose).selectExpr("*", "sum(mass) over (partition by bucket order by doc_id, text_crc32 rows between unbounded preceding and current row) as upto")
    middle = listed([before.get(b, 0) for b in range(buckets)], "bucket", "double") + F.col("upto") - F.col("mass") / 2
    fill = F.lit(shards - 1)
    edge = [sum(room[: s + 1]) for s in range(shards)]
    for s in range(shards - 2, -1, -1):
        fill = F.when(middle < edge[s], F.lit(s)).otherwise(fill)
    dealt = materialize(run.select("doc_id", "size", "text_crc32", "bucket", F.coalesce("shard", fill).cast("int").alias("shard")), "dealt")
    counts = dealt.groupBy("shard", "bucket").count().orderBy("shard", "bucket").collect()
    first: dict[int, int] = {}
    offsets = [0] * (shards * buckets)
    for r in counts:
        offsets[r["shard"] * buckets + r["bucket"]] = first.get(r["shard"], 0)
        first[r["shard"]] = first.get(r["shard"], 0) + r["count"]
    out = dealt.selectExpr("*", "row_number() over (partition by bucket, shard order by doc_id, text_crc32) - 1 as place")
    out = out.withColumn("base", listed(offsets, f"shard * {buckets} + bucket", "long"))
    release(base, cells, nodes, settled)
    return out.select(
        F.col("doc_id").alias(id_column), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
