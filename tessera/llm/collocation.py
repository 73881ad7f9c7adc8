"""Phrases whose words occur together more often than alone, by vertical lists of positions.

Texts are read in blocks of whole texts. In a block each word of a language has a list of the positions where it stands; positions run on within a
piece of text and skip one between pieces, so neighbours are exactly the words that follow one another within a piece. Lists
of a phrase grow by one word a level: the list of a frequent phrase is merged with the postings of the words behind it, which are the frequent
phrases of the same length that begin one place later. A list's length is the phrase's exact frequency in the block,
and lengths summed over blocks are its frequency; phrases below `least` go no further, since what holds them is no more frequent.

Words and phrases have numbers of their own, given by joins on the words themselves, so nothing rests on hashes. A block's lists are one row of a
written table: counting reads only names and lengths, and positions never move by word. The numbers of frequent phrases
reach the blocks in tasks' closures where they are at most `BROADCAST_PHRASES`, otherwise by a join that sends each block those of its own lists.

Each cut of a phrase gives score = floor(1000 * a * n / (l * r)), in decimals of 38 digits (an overflow would raise an error). Prefixes and suffixes of a frequent phrase are
frequent, so all their frequencies are at hand. A phrase is dropped if one that is a word longer holds it often enough: what lies in any longer one lies
in one of these, which is at least as frequent.

Defined cases: null and empty texts have no words; a null language is `und`; repeated rows each count; ties in score and frequency go by the bytes of the
phrase. An empty table gives no rows. Columns other than the text and the language are passed over. One text is never divided: a
task holds some 60 bytes for each word of its block, whose size is that of the longest text if this is above `BLOCK_BYTES`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import bytewords as bw
from tessera.plans.storage import materialize, release

BLOCK_BYTES = 8 << 20
BROADCAST_PHRASES = 200_000  # up to so many numbers of words or phrases go to all tasks
#: Bytes between pieces of a text, and those between words.
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_WORD = ~_BREAK
_WORD[list(SPACES)] = False
#: A row of lists can be large; Parquet is to look at its buffers after each one.
_ROWS = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
_WORDS = "block long, lang array<string>, word array<string>, n array<int>, at binary"
_PHRASES = "block long, p array<long>, w array<long>, n array<int>, at binary"


def packed(at: np.ndarray) -> bytes:
    """Positions as compressed differences, low bytes first."""
    steps = np.diff(at.astype("<i4"), prepend=np.int32(0)).astype("<i4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel(), dtype=np.int32)


def places(w: bw.Words) -> np.ndarray:
    """Positions of a block's words: neighbours within a piece differ by one, others by more."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    broken = np.cumsum(_BREAK[w.data])[w.start]
    gap = (broken[1:] != broken[:-1]) | (w.doc[1:] != w.doc[:-1])
    return np.concatenate(([0], np.cumsum(1 + gap)))


def dictionary(w: bw.Words) -> tuple[np.ndarray, pa.Array]:
    """Number of each word, and the distinct words."""
    raw = w.data[:-8]
    ends = np.concatenate(([0], np.cumsum(w.end - w.start)))
    flat = raw[_WORD[raw]]
    each = pa.LargeStringArray.from_buffers(len(w.start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)).dictionary_encode()
    return each.indices.to_numpy().astype(np.int64), each.dictionary


def grouped(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, how many places each has, and the places key by key, in order (`at` is sorted)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key))), at[order]


def word_lists(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block: lists of its words by language."""

    def whole(held: list[pa.RecordBatch], number: int) -> Iterator[tuple[int, pa.RecordBatch]]:
        table = pa.Table.from_batches(held).combine_chunks()
        langs = table.column("lang").combine_chunks().dictionary_encode()
        code = langs.indices.to_numpy()
        for lo, hi, w in bw.word_slices(table.column("text"), _WORD, block):
            if not len(w.start):
                continue
            word, names = dictionary(w)
            key, n, at = grouped(code[lo:hi][w.doc] * len(names) + word, places(w))
            lists = pa.array([langs.dictionary.take(pa.array(key // len(names))).to_pylist()]), pa.array([names.take(pa.array(key % len(names))).to_pylist()])
            yield number, pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([n.astype(np.int32)]), pa.array([packed(at)])], ["block", "lang", "word", "n", "at"])
            number += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= block:
                for number, row in whole(held, number):
                    yield row
                number, held, size = number + 1, [], 0
        if held:
            for _, row in whole(held, number):
                yield row

    rows = documents.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    return bw.arrow(rows, run, _WORDS)


def longer_lists(row: dict, number: np.ndarray) -> dict:
    """Lists of the phrases one word longer, from a block's lists and the numbers of those that are frequent (-1: not frequent)."""
    n = row["n"]
    keep = np.repeat(number >= 0, n)
    at, phrase = row["at"][keep], np.repeat(number, n)[keep]
    last = np.repeat(row["w"], n)[keep] if row["w"] is not None else phrase
    order = np.argsort(at, kind="stable")
    at, phrase, last = at[order], phrase[order], last[order]
    # merged: one phrase at most begins at a place, so what begins one place later is next to it
    follow = np.flatnonzero(at[1:] == at[:-1] + 1)
    p, p_at = np.unique(phrase[follow], return_inverse=True)
    w, w_at = np.unique(last[follow + 1], return_inverse=True)
    key, n, at = grouped(p_at * max(1, len(w)) + w_at, at[follow])
    return {"p": p[key // max(1, len(w))], "w": w[key % max(1, len(w))], "n": n, "at": at}


def extend(lists: DataFrame, frequent: DataFrame, level: int, most: int) -> DataFrame:
    """Lists of phrases of level + 1 words, from those of `level` words and the frequent ones of them."""
    key = ["lang", "phrase"] if level == 1 else ["p", "w"]
    own = ["lang", "word"] if level == 1 else ["p", "w"]
    known: dict | None = None
    if frequent.count() <= most:
        rows = frequent.select(*key, "id").toArrow()
        known = dict(zip(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True), rows.column(2).to_pylist(), strict=True))
    else:
        each = lists.select("block", F.posexplode(F.arrays_zip(*own)).alias("slot", "x")).select("block", "slot", *[F.col("x")[o].alias(k) for o, k in zip(own, key, strict=True)])
        told = each.join(frequent.select(*key, "id"), key).groupBy("block").agg(F.collect_list(F.struct("slot", "id")).alias("ids"))
        lists = lists.join(told, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].values
                n = get("n").to_numpy()
                if known is not None:
                    number = np.fromiter((known.get(x, -1) for x in zip(get(own[0]).to_pylist(), get(own[1]).to_pylist(), strict=True)), np.int64, len(n))
                else:
                    number = np.full(len(n), -1)
                    number[get("ids").field("slot").to_numpy()] = get("ids").field("id").to_numpy()
                row = {"n": n, "at": unpacked(batch.column("at")[i].as_py()), "w": None if level == 1 else get("w").to_numpy()}
                new = longer_lists(row, number)
                if len(new["n"]):
                    yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), pa.array([new["p"]]), pa.array([new["w"]]), pa.array([new["n"].astype(np.int32)]), pa.array([packed(new["at"])])], ["block", "p", "w", "n", "at"])

    return bw.arrow(lists, run, _PHRASES)


def counted(lists: DataFrame, key: list[str]) -> DataFrame:
    return lists.select(F.explode(F.arrays_zip(*key, "n")).alias("x")).groupBy(*[F.col(f"x.{c}").alias(c) for c in key]).agg(F.sum("x.n").alias("f"))


def named(counts: DataFrame, shorter: DataFrame, words: DataFrame) -> DataFrame:
    """Numbers and words of the frequent phrases (p, w, f), and the frequencies of their beginnings (pre) and ends (suf), shortest first."""
    parent = shorter.select(F.col("id").alias("p"), "lang", F.col("phrase").alias("head"), "pre", F.col("suffix").alias("p_suffix"))
    word = words.select(F.col("id").alias("w"), F.col("phrase").alias("tail"))
    # the end of a phrase is the end of its beginning and the same last word
    end = shorter.select(F.col("id").alias("suffix"), F.col("p").alias("p_suffix"), "w", "suf")
    rows = counts.join(parent, "p").join(word, "w").join(end, ["p_suffix", "w"])
    return rows.select(
        F.monotonically_increasing_id().alias("id"), "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "f", "p", "w", "suffix",
        F.concat("pre", F.array("f")).alias("pre"), F.concat("suf", F.array("f")).alias("suf"),
    )


def score_of(words: int) -> F.Column:
    """(score, k, l, r) of the cut with the lowest score, the shortest beginning at ties."""
    whole = "cast(f as decimal(19,0)) * cast(n as decimal(19,0)) * 1000"
    return F.expr("array_min(array(" + ", ".join(
        f"named_struct('score', ({whole}) div (cast(pre[{k - 1}] as decimal(19,0)) * cast(suf[{words - k - 1}] as decimal(19,0))), 'k', {k}, 'l', pre[{k - 1}], 'r', suf[{words - k - 1}])" for k in range(1, words)
    ) + "))")


def collocations(documents: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, held_percent: int = 100, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK_BYTES, most: int = BROADCAST_PHRASES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words that occur `least` times or more.

    A phrase goes if a longer one, in `held_percent` of its occurrences or more, holds it.
    """
    if least < 1 or longest < 2 or not 0 < held_percent <= 100:
        raise ValueError("least and longest begin at 1 and 2, held_percent lies in 1 to 100")
    lists = materialize(word_lists(documents, text_col, lang_col, block), "words", **_ROWS)
    counts = materialize(counted(lists, ["lang", "word"]), "word-counts")
    total = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = counts.filter(F.col("f") >= least).select(F.monotonically_increasing_id().alias("id"), "lang", F.col("word").alias("phrase"), "f")
    none = F.lit(None).cast("long")
    words = words.select("*", none.alias("p"), none.alias("w"), none.alias("suffix"), F.array("f").alias("pre"), F.array("f").alias("suf"))
    levels = [materialize(words, "frequent")]
    # a word is a phrase without beginning; as the end of a pair it is the pair's last word
    shorter = levels[0].withColumns({"p": F.lit(-1).cast("long"), "w": F.col("id"), "suffix": F.lit(-1).cast("long")})
    for level in range(1, longest):
        above = materialize(extend(lists, levels[-1], level, most), "lists", **_ROWS)
        release(lists)
        lists = above
        frequent = named(counted(lists, ["p", "w"]).filter(F.col("f") >= least), shorter, levels[0])
        shorter = materialize(frequent, "frequent")
        levels.append(shorter)
        if shorter.isEmpty():
            break
    release(lists)
    out = None
    for k in range(1, len(levels)):
        held = levels[k]
        if k + 1 < len(levels):
            inner = levels[k + 1].select(F.explode(F.array_distinct(F.array("p", "suffix"))).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            held = held.join(inner, "id", "left").filter(f"longer is null or 100 * longer < {held_percent} * f").drop("longer")
        kept = held.join(total, "lang").select("lang", "phrase", "f", "n", score_of(k + 1).alias("x"))
        out = kept if out is None else out.unionByName(kept)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = out.select("lang", "phrase", F.col("f").alias("a"), F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))
    best = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    best = materialize(best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    release(counts, *levels)
    return best
