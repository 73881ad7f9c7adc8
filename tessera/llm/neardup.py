"""Near duplicates by a chosen-path set similarity join over word shingles.

1. Each text becomes its set of hashed word shingles and a minwise signature. Texts with equal sets are one class.
2. Chosen path: in each of `trees` independent trees a class goes below those of its minwise tokens that a random
   choice selects, 1 / threshold of them on average, so two similar classes share a node with a constant
   chance in each tree.
3. Leaders: every class is held against the least member of its nodes (of each block of them, if they are large) that looks
   most alike. In a group of thousands of copies nearly all members are of one component afterwards.
4. Members are only compared across components, so a node's work is its members times those outside its largest component.
   Small nodes, with `leaf` * `leaf` such pairs or `few` members outside, are compared exhaustively. The others branch
   again by tokens chosen anew, `retries` times; what is still not small after `depth` levels is compared as it is.
5. Large nodes are compared in blocks: the members outside the largest component go, in groups, to each block of members.
6. Signatures only discard pairs far below the threshold. Links are confirmed on the full sets where the
   members of a node meet: a task keeps the components known so far, so it gives at most one link for each member, and pairs that are
   refuted never become rows.
7. Connected components of the links.

Expected recall of a pair just at 0.8, with the defaults: in a first-level node it is found for certain if that node is small; else
with chance 1 - exp(-2 x) where x is that chance one level below, so at least 0.82 at three levels. Trees are
independent, so it is missed with chance exp(-12) to exp(-12 * 0.82) = 5e-5, and falls to the signature filter with
chance about 2e-5.

Defined cases: null texts and texts without words have an empty set and link with nothing; shorter texts than a shingle
are one shingle of all their words; equal texts link; ties go to the smallest id, of any type that has an order; repeated ids are rows of
one document each. Rows with a null id carry links like any other: they get the smallest id they reach, and are not kept then; where only such rows
are linked, their component is null and all are kept. Other columns are passed over. An empty table gives no rows.
Words and shingles are compared by 64-bit hashes: two given texts of n shingles between them are misjudged with chance n^2 / 2^65 at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytewords as bw
from tessera.llm.components import components
from tessera.plans.storage import materialize, release

K = 256  # minwise values of a signature, of which one byte each is kept
FEW = 32  # of them, for a first look
BROADCAST_IDS = 250_000  # up to so many ids (some 40 bytes each) are broadcast
ITEMS = 2_000_000  # shingles of one side of a block
_U = np.uint64
_A = bw.mix(np.arange(1, K + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
_B = bw.mix(np.arange(101, K + 101, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def shingle_sets(column: pa.Array, n: int, letters: np.ndarray = bw.NONSPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct hashes, where each text's begin) of consecutive rows."""
    for lo, _, w in bw.word_slices(column, letters):
        h = w.hashes()
        doc, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if len(h) >= n:
            gram = bw.ngrams(h, n)
            whole = w.doc[: len(gram)] == w.doc[n - 1 :]
            doc, value = w.doc[: len(gram)][whole], gram[whole]
        count = np.diff(w.first)
        for k in range(1, n):  # the whole sequence of shorter texts
            short = np.flatnonzero(count == k)
            if len(short):
                own = h[w.first[short][:, None] + np.arange(k)]
                out = bw.mix(own[:, 0] + _U(k))
                for j in range(1, k):
                    out = bw.mix(out * _U(0xBF58476D1CE4E5B9) + own[:, j])
                doc, value = np.concatenate((doc, short)), np.concatenate((value, out))
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, bool)
        doc, value = doc[new], value[new]
        yield lo, value, np.searchsorted(doc, np.arange(w.texts + 1))


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """K minwise values of each set that isn't empty."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(full), K), np.uint64)
    if len(full):
        at = first[full]
        for lo in range(0, len(full), 64):  # blocks stay within the processor's cache
            a, b = at[lo], first[full[min(lo + 64, len(full)) - 1] + 1]
            part = value[a:b]
            for k in range(K):
                x = part * _A[k] + _B[k]
                x ^= x >> _U(29)
                out[lo : lo + 64, k] = np.minimum.reduceat(x, at[lo : lo + 64] - a)
    return out


def choose(tokens: np.ndarray, path: np.ndarray, tree: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of the tokens that a tree selects at the nodes `path`."""
    token = bw.mix(tokens + bw.mix(np.arange(K, dtype=np.uint64) + _U(1000 * (tree + 1))))
    token = bw.mix(token ^ path[:, None])
    row, _ = at = np.nonzero(bw.mix(token + _U(7)) < _U(int(min(share, 0.999999) * 2.0**64)))
    return row, token[at]


def sketch(documents: DataFrame, n: int, threshold: float, trees: int) -> DataFrame:
    """doc_id, n_shingles, set_key, sig (the low byte of each minwise value), nodes of the first level."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, value, first in shingle_sets(batch.column("text"), n):
                size = np.diff(first)
                full = np.flatnonzero(size)
                key: list = [None] * len(size)
                sig: list = [None] * len(size)
                nodes: list = [None] * len(size)
                values = signatures(value, first)
                low = (values & _U(0xFF)).astype(np.uint8)
                rows, childs = [], []
                for t in range(trees):
                    row, child = choose(values, np.zeros(len(full), np.uint64), t, 1 / (threshold * K))
                    rows.append(row)
                    childs.append(child)
                row, child = np.concatenate(rows), np.concatenate(childs).view(np.int64)
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(len(full) + 1))
                child = child[order]
                for i, d in enumerate(full):
                    key[d] = hashlib.md5(value[first[d] : first[d + 1]].tobytes()).digest()
                    sig[d] = low[i].tobytes()
                    nodes[d] = child[cut[i] : cut[i + 1]]
                ids = batch.column("doc_id").slice(lo, len(size))
                yield pa.RecordBatch.from_arrays([ids, pa.array(size.astype(np.int64)), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "sig", "nodes"])

    return bw.arrow(documents.select("doc_id", "text"), run, f"doc_id {kind}, n_shingles long, set_key binary, sig binary, nodes array<long>")


def _sig(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, K)


def _groups(batches: Iterator[pa.RecordBatch], key: list[str], most: int = 20_000) -> Iterator[pa.Table]:
    """Tables that never cut a group of equal keys; rows come sorted by key."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        k = np.stack([table.column(c).to_numpy() for c in key], axis=1)
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if len(cut):
            yield table.slice(0, cut[-1])
            held = table.slice(cut[-1]).combine_chunks().to_batches()
            rows = table.num_rows - int(cut[-1])
        else:
            held = table.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(table: pa.Table, key: list[str]) -> np.ndarray:
    k = np.stack([table.column(c).to_numpy() for c in key], axis=1)
    return np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1))))


_MEMBER = "node long, i int, j int, copy boolean, id long, comp long, n long, sig binary, mine array<long>"
_KEY = ["node", "i", "j"]
_FIELDS = ["node", "i", "j", "copy", "id", "comp", "n", "sig", "mine"]


def leader_pairs(rows: DataFrame, key: list[str], least_same: int) -> DataFrame:
    """Each member of a group with the group's least id, in one stream: groups may be of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lead, lead_sig = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            k = np.stack([table.column(c).to_numpy() for c in key], axis=1)
            ids, sig = table.column("id").to_numpy(), _sig(table.column("sig"))
            start = _starts(table, key)
            of = np.repeat(start, np.diff(np.append(start, len(ids))))
            leader, leader_sig = ids[of].copy(), sig[of].copy()
            if last is not None and (k[0] == last).all():
                end = start[1] if len(start) > 1 else len(ids)
                leader[:end], leader_sig[:end] = lead, lead_sig
            last, lead, lead_sig = k[-1], leader[-1], leader_sig[-1]
            same = (leader_sig == sig).sum(axis=1)
            good = (same >= least_same) & (leader != ids)
            yield pa.RecordBatch.from_arrays([pa.array(leader[good]), pa.array(ids[good]), pa.array(same[good].astype(np.int32))], ["a", "b", "same"])

    return bw.arrow(rows.repartition(*key).sortWithinPartitions(*key, "id"), run, "a long, b long, same int")


def most_alike(pairs: DataFrame) -> DataFrame:
    """Of the pairs of each b the one with most equal signature values."""
    return pairs.groupBy("b").agg(F.max(F.struct("same", (-F.col("a")).alias("m"))).alias("x")).select((-F.col("x.m")).alias("a"), "b")


def nameless_sets(documents: DataFrame, n: int) -> DataFrame:
    """set_key and items of the sets that rows without an id have, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, value, first in shingle_sets(batch.column("text"), n):
                own = [value[a:b].tobytes() for a, b in zip(first, first[1:], strict=False) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(x).digest() for x in own], pa.binary()), pa.array(own, pa.binary())], ["set_key", "items"])

    texts = documents.filter("doc_id is null").select("text").distinct()
    return bw.arrow(texts, run, "set_key binary, items binary").groupBy("set_key").agg(F.first("items").alias("items"))


def sets_of(wanted: DataFrame, documents: DataFrame, n: int, nameless: DataFrame | None = None) -> DataFrame:
    """id, items (the sorted shingle hashes) of the classes `wanted` (id, set_key, doc), by one text of each; of those without an id from `nameless`."""
    wanted = wanted.select("id", "set_key", "doc")
    if nameless is not None:
        loose = nameless.join(wanted.filter("doc is null"), "set_key").select("id", "items")
        return sets_of(wanted.filter("doc is not null"), documents, n).unionByName(loose)
    if wanted.count() <= BROADCAST_IDS:  # spares a shuffle of all texts
        wanted = F.broadcast(wanted)
    texts = documents.select(F.col("doc_id").alias("doc"), "text").join(wanted, "doc").select("id", "set_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("set_key").to_pylist()
            for lo, value, first in shingle_sets(batch.column("text"), n):
                own = [value[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
                keep = pa.array([hashlib.md5(x).digest() == key[lo + k] for k, x in enumerate(own)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, len(own)).filter(keep), pa.array(own, pa.binary()).filter(keep)], ["id", "items"])

    return bw.arrow(texts, run, "id long, items binary").groupBy("id").agg(F.first("items").alias("items"))


def _alike(items: np.ndarray, other: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets have 100 * intersection >= percent * union with `items`."""
    size = np.array([len(x) for x in other])
    flat = np.concatenate(other)
    at = np.minimum(np.searchsorted(items, flat), len(items) - 1)
    both = np.add.reduceat((items[at] == flat).astype(np.int64), np.cumsum(size) - size)
    return 100 * both >= percent * (len(items) + size - both)


def star_links(pairs: DataFrame, sets: Callable, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the full sets confirm; the members b of each a stream past its set."""
    pairs = materialize(pairs, "pairs")
    rows = pairs.select("a", F.col("b").alias("id"), F.lit(1).alias("member")).unionByName(pairs.select("a", F.col("a").alias("id"), F.lit(0).alias("member")).distinct())
    whole = sets(classes.join(rows.select("id").distinct(), "id", "left_semi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, items = None, None
        for batch in batches:
            a, b, member = (batch.column(c).to_numpy() for c in ("a", "id", "member"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("items")]
            keep = np.zeros(len(a), bool)
            cut = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else []
            for lo, hi in zip(cut, [*cut[1:], len(a)], strict=True):
                if not member[lo]:
                    lead, items, lo = a[lo], sets[lo].copy(), lo + 1
                if lo < hi and a[lo] == lead:
                    keep[lo:hi] = _alike(items, sets[lo:hi], percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    links = bw.arrow(rows.join(whole, "id").repartition("a").sortWithinPartitions("a", "member", "id"), run, "a long, b long")
    links = materialize(links, "links")
    release(pairs)
    return links


def outside(at: DataFrame, block: int) -> DataFrame:
    """Of the nodes of (node, id, n, comp) with more than one component: members, those outside the largest component, and into how many blocks both sides go."""
    each = at.groupBy("node", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("items"))
    node = each.groupBy("node").agg(F.sum("k").alias("cnt"), F.sum("items").alias("items"), F.count("*").alias("comps"), F.max(F.struct("k", "comp", "items")).alias("top")).filter("comps > 1")
    parts = lambda k, items: F.ceil(F.greatest(k / block, items / ITEMS)).cast("int")
    out = node.select("node", "cnt", F.col("top.comp").alias("top"), (F.col("cnt") - F.col("top.k")).alias("out"), parts(F.col("cnt"), F.col("items")).alias("parts"), parts(F.col("cnt") - F.col("top.k"), F.col("items") - F.col("top.items")).alias("groups"))
    return materialize(out, "mixed")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of small nodes in their blocks: a node of one block is one group; of others each group (i, j) has block i of all members, and copies of group j of those outside."""
    whole = rows.filter("parts = 1").select(*_FIELDS)
    large = rows.filter("parts > 1")
    own = large.withColumn("i", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    copies = large.filter("comp <> top").withColumn("copy", F.lit(True)).withColumn("j", F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return whole.unionByName(own.select(*_FIELDS)).unionByName(copies.select(*_FIELDS))


def _near(table: pa.Table, least_same: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers (i, j), and equal signature values, of the pairs within groups that differ in component and that sizes and signatures don't rule out.

    Where a group has copies, a pair is a copy and a member that is none. Of pairs that meet in several small nodes (`mine`,
    those of a member) the least node has them.
    """
    first_look = int(FEW * threshold - 5 * np.sqrt(FEW * threshold * (1 - threshold)))
    comp, size, ids = (table.column(c).to_numpy() for c in ("comp", "n", "id"))
    copy = table.column("copy").to_numpy(zero_copy_only=False)
    sig = _sig(table.column("sig"))
    node, lists = table.column("node").to_numpy(), table.column("mine").combine_chunks()
    at = lists.offsets.to_numpy()
    many = np.diff(at)
    mine = np.full((len(ids), max(1, many.max(initial=0))), np.iinfo(np.int64).max)
    mine[np.repeat(np.arange(len(ids)), many), np.arange(at[0], at[-1]) - np.repeat(at[:-1], many)] = lists.flatten().to_numpy(zero_copy_only=False)
    start = _starts(table, _KEY)
    length = np.diff(np.append(start, len(ids)))
    mixed = np.maximum.reduceat(comp, start) != np.minimum.reduceat(comp, start)
    crossed = np.repeat(np.logical_or.reduceat(copy, start), length)
    end = np.repeat(start + np.where(mixed, length, 0), length)
    left, d = np.arange(len(ids)), 1
    while len(left := left[left + d < end[left]]):
        good = (comp[left] != comp[left + d]) & (~crossed[left] | (copy[left] != copy[left + d]))
        i = left[good]
        if len(i):
            i = i[np.minimum(size[i], size[i + d]) >= threshold * np.maximum(size[i], size[i + d]) - 1e-9]
            i = i[(sig[i, :FEW] == sig[i + d, :FEW]).sum(axis=1) >= first_look]
        for at in range(0, len(i), 50_000):
            j = i[at : at + 50_000]
            same = (sig[j] == sig[j + d]).sum(axis=1)
            good = same >= least_same
            j, same = j[good], same[good]
            first = np.ones(len(j), bool)
            for k in range(mine.shape[1]):  # no lesser node of the one is a node of the other
                lesser = mine[j, k] < node[j]
                first[lesser] &= (mine[j[lesser] + d] != mine[j[lesser], k][:, None]).all(axis=1)
            if first.any():
                yield j[first], j[first] + d, same[first]
        d += 1


def contested(rows: DataFrame, least_same: int, threshold: float) -> DataFrame:
    """The rows of groups that are in a pair which may be a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, _KEY):
            found = np.zeros(table.num_rows, bool)
            for i, j, _ in _near(table, least_same, threshold):
                found[i] = found[j] = True
            if found.any():
                yield from table.select(_FIELDS).filter(pa.array(found)).to_batches()

    return bw.arrow(rows.repartition(*_KEY).sortWithinPartitions(*_KEY, "id"), run, _MEMBER)


def node_links(rows: DataFrame, sets: Callable, classes: DataFrame, threshold: float, least_same: int) -> DataFrame:
    """Links (a, b) between components within groups, confirmed on the full sets; at most one for each member."""
    percent = round(100 * threshold)
    rows = materialize(rows, "contested")
    whole = sets(classes.join(rows.select("id").distinct(), "id", "left_semi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, _KEY, 4_000):
            ids, items = table.column("id").to_numpy(), table.column("items").combine_chunks()
            start = _starts(table, _KEY)
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(ids))))
            # components by number, apart for each group
            label = np.unique(np.stack([group, table.column("comp").to_numpy()], axis=1), axis=0, return_inverse=True)[1].ravel()
            found = list(_near(table, least_same, threshold))
            if not found:
                continue
            i, j, same = (np.concatenate(x) for x in zip(*found, strict=True))
            i, j = np.concatenate((i, j)), np.concatenate((j, i))
            same = np.concatenate((same, same))
            # each pair once, from the member that has fewer
            few = np.bincount(i, minlength=len(ids))
            once = (few[i] < few[j]) | ((few[i] == few[j]) & (i < j))
            i, j, same = i[once], j[once], same[once]
            order = np.lexsort((-same, i))
            i, j = i[order], j[order]
            get = lambda k: np.frombuffer(items[int(k)].as_buffer(), np.uint64)
            a, b = [], []
            cut = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            for lo, hi in zip(cut, [*cut[1:], len(i)], strict=True):
                own, left, take = get(i[lo]), j[lo:hi], 2
                while len(left := left[label[left] != label[i[lo]]]):
                    some, left, take = left[:take], left[take:], min(4 * take, 256)
                    for k in some[_alike(own, [get(k) for k in some], percent)]:
                        if label[k] != label[i[lo]]:
                            label[label == label[k]] = label[i[lo]]
                            a.append(ids[i[lo]])
                            b.append(ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = bw.arrow(rows.join(whole, "id").repartition(*_KEY).sortWithinPartitions(*_KEY, "id"), run, "a long, b long")
    links = materialize(links, "links")
    release(rows)
    return links


def branch(rows: DataFrame, level: int, threshold: float, retries: int) -> DataFrame:
    """(node, id, n) of the children that the members of nodes choose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _sig(batch.column("sig")).astype(np.uint64)
            path = batch.column("node").to_numpy().view(np.uint64)
            for t in range(retries):
                row, child = choose(tokens, path, 100 * level + t, 1 / (threshold * K))
                rest = batch.select(["id", "n"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *rest.columns], ["node", "id", "n"])

    return bw.arrow(rows.select("node", "id", "n", "sig"), run, "node long, id long, n long")


def shared_nodes(places: DataFrame) -> DataFrame:
    """The rows of nodes with more than one member."""
    places = materialize(places, "all-places")
    many = places.groupBy("node").agg(F.count("*").alias("cnt")).filter("cnt > 1")
    out = materialize(places.join(many, "node"), "places")
    release(places)
    return out


def joined(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (id, component) after `links`; those between two components count once, however many members they join."""
    if known is None:
        return components(links)
    of = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")).distinct()
    above = components(ends).select(F.col("id").alias("first"), F.col("component").alias("last"))
    moved = known.withColumnRenamed("component", "first").join(above, "first", "left").select("id", F.coalesce("last", "first").alias("component"))
    fresh = above.select(F.col("first").alias("id"), F.col("last").alias("component")).join(known, "id", "left_anti")
    return materialize(moved.unionByName(fresh), "components")


def near_duplicates(documents: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 12, leaf: int = 2000, few: int = 500, depth: int = 3, retries: int = 2, block: int = 1000) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id linked), kept."""
    percent = round(100 * threshold)
    least_same = int(K * threshold - 4.2 * np.sqrt(K * threshold * (1 - threshold)))
    sketches = materialize(sketch(documents, n, threshold, trees), "sketches")
    named = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "n_shingles", "sig", "nodes")
    classes = sketches.filter("set_key is not null").groupBy("set_key").agg(F.min(named).alias("x"), F.count("*").alias("copies"))
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "set_key", "copies", F.col("x.doc_id").alias("doc"), F.col("x.n_shingles").alias("n"), "x.sig", "x.nodes")
    classes = materialize(classes, "classes")  # which fixes the ids
    nameless = None if classes.filter("doc is null").isEmpty() else materialize(nameless_sets(documents, n), "nameless")
    sets = partial(sets_of, documents=documents, n=n, nameless=nameless)
    marks = classes.select("id", "sig")
    places = shared_nodes(classes.select(F.explode("nodes").alias("node"), "id", "n"))
    # one link for each class, to the least member of the node that looks most alike
    split = places.select("node", "id", "cnt", F.pmod(F.xxhash64("id"), F.ceil(F.col("cnt") / block)).cast("int").alias("block")).join(marks, "id")
    heads = split.filter(F.col("cnt") > block).groupBy("node", "block").agg(F.min(F.struct("id", "sig")).alias("x")).select("node", "x.*")
    pairs = leader_pairs(split, ["node", "block"], least_same).unionByName(leader_pairs(heads, ["node"], least_same))
    known = joined(None, star_links(most_alike(pairs), sets, classes, percent))
    for level in range(1, depth + 1):
        at = places.select("node", "id", "n").join(known, "id", "left").select("node", "id", "n", F.coalesce("component", "id").alias("comp"))
        mixed = outside(at, block)
        if mixed.isEmpty():
            break
        small = F.lit(level == depth) | (F.col("out") <= few) | (F.col("out") * F.col("cnt") <= leaf * leaf)
        # the places of an id meet once, so that its signature moves once
        spot = F.struct("node", "top", "parts", "groups", small.alias("small"))
        by_id = at.join(mixed, "node").groupBy("id", "n", "comp").agg(F.collect_list(spot).alias("spots")).join(marks, "id")
        mine = F.transform(F.filter("spots", lambda s: s["small"]), lambda s: s["node"])
        rows = by_id.select("id", "n", "comp", "sig", mine.alias("mine"), F.explode("spots").alias("s")).select("s.*", "id", "n", "comp", "sig", "mine")
        rows = materialize(rows.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("copy")), "level")
        links = node_links(contested(dealt(rows.filter("small")), least_same, threshold), sets, classes, threshold, least_same)
        if not links.isEmpty():
            known = joined(known, links)
        large = rows.filter("not small")
        if level == depth or large.isEmpty():
            break
        below = shared_nodes(branch(large, level, threshold, retries).dropDuplicates(["node", "id"]))
        release(rows, places, mixed)
        places = below
    # only classes that are linked, or have copies, differ from their document's own id
    least = classes.join(known, "id").groupBy("component").agg(F.min("doc").alias("first"))
    linked = known.join(least, "component").select("id", "first")
    told = classes.select("id", "set_key", "doc", "copies").join(linked, "id", "left").filter("copies > 1 or first is not null").select("set_key", F.coalesce("first", "doc").alias("first"))
    told = materialize(told, "told")
    release(classes, places, *([] if nameless is None else [nameless]))
    out = sketches.select("doc_id", "n_shingles", "set_key").join(told, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"))
    out = materialize(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-duplicates")
    release(sketches, told)
    return out
