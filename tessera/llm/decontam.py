"""Benchmark decontamination with an FM-index per training shard.

The words of a shard of documents that occur in the benchmark at all form a text over integer symbols; other
words can't lie in any test phrase, so each is only a separator, and runs shorter than the shortest
phrase are left out (no occurrence can lie in them). The shard's suffix array gives its Burrows-Wheeler
transform, kept as a wavelet matrix. All phrases are searched backwards at once by wavelet ranks; occurrences
are located by stepping to sampled suffix positions; their word spans are merged per document.

The benchmark is handled in blocks of bounded size. `together` of them are broadcast at once, and documents stream through
these in one pass; a larger benchmark takes several passes, with what was found written between them. Cost grows with the documents, the occurrences
found, and the passes.

Defined cases: null and empty texts have no words; items without words are passed over; documents with repeated
ids are judged row by row; items with one id count once; an empty benchmark hits nothing. Columns other than those named are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytewords as bw
from tessera.llm.wordbpe import ragged
from tessera.plans.storage import materialize, release

WINDOW = 13
SHARD_BYTES = 4 << 20


@dataclass
class Phrases:
    """Distinct phrases of a block of items, as ranges of the items' words; symbols 1.. number the `alphabet` (0 separates)."""

    alphabet: np.ndarray  # sorted word hashes
    symbols: np.ndarray  # all items' words, one item behind the other
    start: np.ndarray
    length: np.ndarray
    owners: np.ndarray  # item numbers, by phrase
    owner_first: np.ndarray
    items: list[str]

    @property
    def shortest(self) -> int:
        return int(self.length.min()) if len(self.length) else 1 << 30


def phrases(rows: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    ids = [str(i) if i is not None else "" for i, _ in rows]
    names = sorted(set(ids))
    number = {n: k for k, n in enumerate(names)}
    of_row = np.array([number[i] for i in ids], np.int32)
    words, start, length, owner, at = [], [], [], [], 0
    for lo, _, w in bw.word_slices(pa.array([t for _, t in rows], pa.large_string()), bw.ALNUM):
        n = np.diff(w.first)
        many = np.where(n > 0, np.maximum(n - window, 0) + 1, 0)
        each = np.repeat(np.arange(w.texts), many)
        words.append(w.hashes())
        start.append(at + w.first[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many))
        length.append(np.minimum(n, window)[each])
        owner.append(of_row[lo + each])
        at += len(w.start)
    h, start, length, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, start, length, owner))
    # a phrase is told by its length and two hashes of its words
    key = np.zeros((len(start), 3), np.uint64)
    key[:, 0] = length
    for k in np.unique(length):
        own = length == k
        key[own, 1], key[own, 2] = bw.ngrams(h, k)[start[own]], bw.ngrams(bw.mix(~h), k)[start[own]]
    _, some, which = np.unique(key, axis=0, return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), owner], axis=1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
    alphabet, symbols = np.unique(h, return_inverse=True)
    return Phrases(
        alphabet, symbols.astype(np.int32) + 1, start[some].astype(np.int32), length[some].astype(np.int32),
        pairs[:, 1].astype(np.int32), np.searchsorted(pairs[:, 0], np.arange(len(some) + 1)).astype(np.int32), names,
    )


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.zeros(n, np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], np.diff(text[order]) != 0)))
    k = 1
    while n > 1 and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate(([0], np.diff(key[order]) != 0)))
        k *= 2
    return order


class WaveletMatrix:
    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        start, at = np.zeros_like(at), at.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, s = ones[at], ones[start]
            at, start = np.where(bit, zeros + a, at - a), np.where(bit, zeros + s, start - s)
        return at - start

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol, start, at = np.zeros_like(at), np.zeros_like(at), at.copy()
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, s = ones[at], ones[start]
            bit = ones[at + 1] > a
            symbol = symbol * 2 + bit
            at, start = np.where(bit, zeros + a, at - a), np.where(bit, zeros + s, start - s)
        return symbol, at - start


class FmIndex:
    """Over symbols 0.. ; the text must not be empty."""

    def __init__(self, text: np.ndarray, sample: int = 16):
        text = np.append(text + 1, 0)  # an end symbol less than all others
        order = suffix_array(text)
        bwt = text[order - 1]
        self.wavelet = WaveletMatrix(bwt)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.sampled = order % sample == 0
        self.sampled_rank = np.concatenate(([0], np.cumsum(self.sampled)))
        self.position = order[self.sampled]

    def search(self, symbols: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each phrase symbols[first[i]:first[i] + length[i]], all searched backwards together."""
        n = len(first)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.less[-1])
        left = length.copy()
        live = np.flatnonzero(left > 0)
        while len(live):
            left[live] -= 1
            c = symbols[first[live] + left[live]].astype(np.int64) + 1
            known = c < len(self.less) - 1
            lo[live[~known]] = hi[live[~known]] = 0
            live, c = live[known], c[known]
            lo[live] = self.less[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.less[c] + self.wavelet.rank(c, hi[live])
            live = live[(hi[live] > lo[live]) & (left[live] > 0)]
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, rows = np.zeros(len(rows), np.int64), 0, rows.copy()
        live = np.arange(len(rows))
        while len(live):
            hit = self.sampled[rows[live]]
            done = live[hit]
            out[done] = self.position[self.sampled_rank[rows[done]]] + steps
            live = live[~hit]
            symbol, rank = self.wavelet.symbol_and_rank(rows[live])
            rows[live] = self.less[symbol] + rank
            steps += 1
        return out


def occurrences(w: bw.Words, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(word index, phrase) of every occurrence of a phrase within one text of the shard."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(p.alphabet) or not len(w.start):
        return none
    h = w.hashes()
    at = np.minimum(np.searchsorted(p.alphabet, h), len(p.alphabet) - 1)
    symbol = np.where(p.alphabet[at] == h, at + 1, 0)
    head = np.concatenate(([True], (symbol[1:] == 0) | (symbol[:-1] == 0) | (w.doc[1:] != w.doc[:-1])))
    begin = np.flatnonzero(head)
    length = np.diff(np.append(begin, len(symbol)))
    good = (symbol[begin] > 0) & (length >= p.shortest)
    begin, length = begin[good], length[good]
    if not len(begin):
        return none
    place, first = ragged(np.arange(len(symbol)), begin, length)
    gap = np.repeat(np.arange(len(begin)), length)
    text = np.zeros(len(place) + len(begin), np.int64)
    origin = np.zeros(len(text), np.int64)
    text[np.arange(len(place)) + gap] = symbol[place]
    origin[np.arange(len(place)) + gap] = place
    index = FmIndex(text)
    lo, hi = index.search(p.symbols, p.start, p.length)
    count = hi - lo
    phrase = np.repeat(np.arange(len(count)), count)
    rows, _ = ragged(np.arange(len(text) + 1), lo, count)
    return origin[index.locate(rows)], phrase


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[Phrases]:
    """The phrases of the items in blocks of about `block_bytes` of text, each small enough for the driver and a broadcast."""
    size = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = -(-size // block_bytes) or 1
    items = benchmark.select("item_id", "text")
    for k in range(n):
        yield phrases([tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()])


_SPANS = "array<struct<start:int,end:int,start_byte:int,end_byte:int>>"


def contamination(documents: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, block_bytes: int = 4 << 20, together: int = 4) -> DataFrame:
    """The columns asked for (doc_id if none are named), n_words, n_hit, n_items, items_sha256, contaminated and the merged spans (in words and bytes)."""
    keep = columns or ["doc_id"]
    frame = documents.select(*dict.fromkeys([*keep, "text"]))
    spark = documents.sparkSession
    names = list(frame.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    out_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keep).schema)
    struct = pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "end", "start_byte", "end_byte")]))

    def step(shared, last: bool, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = shared.value
            for batch in batches:
                n = batch.num_rows
                spans = [[] for _ in range(n)] if first else batch.column("_spans").to_pylist()
                items = [[] for _ in range(n)] if first else batch.column("_items").to_pylist()
                words = np.zeros(n, np.int64)
                for (lo, _, w), p in ((x, p) for x in bw.word_slices(batch.column("text"), bw.ALNUM, SHARD_BYTES) for p in blocks):
                    words[lo : lo + w.texts] = np.diff(w.first)
                    at, phrase = occurrences(w, p)
                    if not len(at):
                        continue
                    hit = np.zeros(len(w.start) + 1, np.int64)
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + p.length[phrase], -1)
                    # a text's first word always begins a span of its own
                    on = np.cumsum(hit[:-1]) > 0
                    turn = np.concatenate(([True], (on[1:] != on[:-1]) | (w.doc[1:] != w.doc[:-1])))
                    begin = np.flatnonzero(turn)
                    end = np.append(begin[1:], len(on))
                    starts = text_starts(w, batch.column("text"), lo)
                    for a, b in zip(begin[on[begin]].tolist(), end[on[begin]].tolist(), strict=True):
                        d = w.doc[a]
                        base = w.first[d]
                        spans[lo + d].append({"start": int(a - base), "end": int(b - base), "start_byte": int(w.start[a] - starts[d]), "end_byte": int(w.end[b - 1] - starts[d])})
                    owner, _ = ragged(p.owners, p.owner_first[phrase], np.diff(p.owner_first)[phrase])
                    who = np.repeat(w.doc[at], np.diff(p.owner_first)[phrase])
                    for d, k in np.unique(np.stack([who, owner], axis=1), axis=0):
                        items[lo + d].append(p.items[k])
                if not last:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(spans, struct), pa.array(items, pa.list_(pa.string()))], [*names, "_spans", "_items"])
                    continue
                n_hit, n_items, digest = [], [], []
                for k in range(n):
                    if len(blocks) > 1 or not first:
                        at_byte = {}
                        for s in spans[k]:
                            at_byte[s["start"]] = s["start_byte"]
                            at_byte[-s["end"]] = s["end_byte"]
                        spans[k] = [{"start": a, "end": b, "start_byte": at_byte[a], "end_byte": at_byte[-b]} for a, b in merge_spans([(s["start"], s["end"]) for s in spans[k]])]
                    n_hit.append(sum(s["end"] - s["start"] for s in spans[k]))
                    own = sorted(set(items[k]))
                    n_items.append(len(own))
                    digest.append(hashlib.sha256(",".join(own).encode()).hexdigest())
                bad = [h > 0 and 20 * h >= m for h, m in zip(n_hit, words.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array(words), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array(bad, pa.bool_()), pa.array(spans, struct)],
                    [*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
                )

        return run

    blocks = blocks_of(benchmark, block_bytes)
    group, before = list(islice(blocks, together)), None
    while group:
        after = list(islice(blocks, together))
        shared = spark.sparkContext.broadcast(group)
        kind = f"{fields}, _spans {_SPANS}, _items array<string>" if after else f"{out_fields}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans {_SPANS}"
        frame = bw.arrow(frame, step(shared, not after, before is None), kind)
        if after:
            written = materialize(frame, "found")
            shared.unpersist()
            if before is not None and hasattr(before, "scratch"):
                release(before)
            frame = before = written
        group = after
    return frame


def text_starts(w: bw.Words, column: pa.Array, lo: int) -> np.ndarray:
    """Where each text of the slice begins in its bytes."""
    size = column.slice(lo, w.texts).cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + w.texts + 1]
    return off[:-1] - off[0]


def remove_spans(documents: DataFrame, column: str = "spans") -> DataFrame:
    """The texts without the bytes of their spans (a column of `documents`, ordered and apart)."""
    begin, end = f"if(i = 0, 0, `{column}`[i - 1].end_byte)", f"if(i = size(`{column}`), octet_length(text), `{column}`[i].start_byte)"
    left = F.expr(f"array_join(transform(sequence(0, size(`{column}`)), i -> cast(substring(cast(text as binary), {begin} + 1, {end} - {begin}) as string)), '')")
    return documents.withColumn("text", F.when(F.col("text").isNotNull() & (F.size(column) > 0), left).otherwise(F.col("text")))
