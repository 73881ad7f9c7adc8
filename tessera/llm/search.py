"""Exact top-k inner products by dual-tree search over cover trees.

The top of both trees is shared: a bounded sample of vectors are pivots, each vector belongs to the cell of its nearest pivot, and
each query's kth best product with the pivots is a floor under its kth best score. Cells know their centre and covering
radius, so all pairs of a group of queries and a cell are bounded before any vector moves: a pair is left out when no point of the cell can
reach the lowest floor of the group. Cells are cut into blocks. A block's vectors come to one task, which indexes them with a
cover tree (centres apart by more than a node's radius cover all its points); the groups of queries that are left stream past, each
chunk indexed by a tree of its own, and both trees are descended together. There too a pair of nodes is left out when no
point of one can beat the worst kth score of any query in the other: q.c + rq |c| + rd |q| + rq rd bounds all products. Scores are exact
integers.

Vectors with a component so large that sums of products may not be exact in doubles (`wide`) lie in cells of their own; products
with them are taken in Python integers, whatever their size. Their order is exact; a score beyond a long is returned as the nearest long.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; ties go to the smaller
vec_id; rows that share a query's vec_id are its own; vectors of another length than the query's aren't candidates; of query rows
with one vec_id the one with the least vector asks. Columns other than the id and the vector are passed over. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytewords as bw
from tessera.plans.storage import materialize

LEAF = 192
NONE = -(1 << 62)  # the score of no vector
LONG = (1 << 63) - 1
WIDE, STRAY = -2, -1  # cells of wide vectors, and of lengths that no pivot has


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    points: np.ndarray  # rows of a leaf
    children: list[Node]

    @property
    def size(self) -> float:
        return float(np.sqrt(self.centre @ self.centre))


def cover_tree(x: np.ndarray, rows: np.ndarray, centre: int | None = None, leaf: int = LEAF) -> Node:
    """Children cover their points within half the node's radius, or within the median distance where halving would split nothing off."""
    c = x[rows[0] if centre is None else centre]
    far = np.sqrt(np.maximum(((x[rows] - c) ** 2).sum(axis=1), 0))
    radius = float(far.max())
    if len(rows) <= leaf or radius == 0:
        return Node(c, radius, rows, [])
    cover = max(radius / 2, float(np.median(far)))
    inside = far <= cover
    if inside.all():
        cover = radius / 2
        inside = far <= cover
    children, left, at = [], rows, (rows[0] if centre is None else centre)
    while len(left):
        children.append((at, left[inside]))
        left = left[~inside]
        if not len(left):
            break
        at = left[0]
        inside = np.sqrt(np.maximum(((x[left] - x[at]) ** 2).sum(axis=1), 0)) <= cover
    if len(children) == 1:
        return Node(c, radius, rows, [])
    return Node(c, radius, np.zeros(0, np.int64), [cover_tree(x, own, a, leaf) for a, own in children])


def _leaves(node: Node) -> np.ndarray:
    return node.points if not node.children else np.concatenate([_leaves(n) for n in node.children])


def dual_tree(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, tree: Node | None = None, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict]:
    """Scores and ids of each query's k best (missing ones have id -1), and how many node pairs were pruned or compared.

    Components are integers as doubles, small enough for exact sums. `tree` is the data's, if it is there already. Scores below a
    query's `floor` needn't be found.
    """
    worst = NONE
    score, ids = np.full((len(q), k), worst), np.full((len(q), k), -1)
    seen = {"pruned": 0, "compared": 0}
    floor = np.full(len(q), -np.inf) if floor is None else floor

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        seen["compared"] += 1
        s = (q[a] @ x[b].T).astype(np.int64)
        s[q_id[a][:, None] == x_id[b][None]] = worst
        i = np.tile(x_id[b], (len(a), 1))
        i[s == worst] = -1
        if s.shape[1] > 4 * k:  # ties at the edge stay in: all that reach the kth score
            edge = np.partition(s, -k, axis=1)[:, -k]
            keep = (s >= np.maximum(edge, score[a, -1])[:, None]).any(axis=0)
            s, i = s[:, keep], i[:, keep]
        s, i = np.concatenate((score[a], s), axis=1), np.concatenate((ids[a], i), axis=1)
        order = np.lexsort((i, -s), axis=1)[:, :k]
        score[a], ids[a] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def go(a: Node, b: Node, rows: np.ndarray) -> None:
        if bound(a, b) < np.maximum(score[rows, -1], floor[rows]).min():
            seen["pruned"] += 1
            return
        if not a.children and not b.children:
            compare(rows, b.points)
        elif b.children and (not a.children or b.radius >= a.radius):
            for child in sorted(b.children, key=lambda n: -bound(a, n)):
                go(a, child, rows)
        else:
            for child in a.children:
                go(child, b, _leaves(child))

    if len(q) and len(x):
        top = cover_tree(q, np.arange(len(q)))
        go(top, tree or cover_tree(x, np.arange(len(x))), _leaves(top))
    return score, ids, seen


def bound(a: Node, b: Node) -> float:
    top = a.centre @ b.centre + a.radius * b.size + b.radius * a.size + a.radius * b.radius
    return top + 1e-6 * abs(top) + 1e-3


def exact_top(q: list[int], q_id: int, x: list[list[int]], x_id: list[int], k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best, in integers of any size."""
    found = [(-sum(a * b for a, b in zip(q, v, strict=True)), i) for v, i in zip(x, x_id, strict=True) if i != q_id]
    return [(-s, i) for s, i in sorted(found)[:k]]


def integers(v: np.ndarray, scale: float) -> list[int]:
    with np.errstate(over="ignore"):
        y = np.floor(v * scale)
    # what overflows a double is far beyond its fractions
    return [int(a) if np.isfinite(a) else int(b) * int(scale) for a, b in zip(y, v, strict=True)]


def order_key(score: int) -> bytes:
    """Bytes that are ordered like the scores."""
    raw = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    raw = len(raw).to_bytes(4, "big") + raw
    return b"\1" + raw if score >= 0 else b"\0" + bytes(255 - x for x in raw)


def widest(dim: int) -> float:
    """Components up to this give exact sums of products."""
    return float(np.floor(np.sqrt(2.0**53 / dim)))


@dataclass
class Pivots:
    """Pivot vectors (scaled) and their ids, by length of vector."""

    scale: float
    vectors: dict[int, np.ndarray] = field(default_factory=dict)
    ids: dict[int, np.ndarray] = field(default_factory=dict)

    def cells(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and its distance from the cell's centre."""
        with np.errstate(over="ignore", invalid="ignore"):
            wide = ~(np.abs(x).max(axis=1) <= widest(dim))
        cell, far = np.full(len(x), STRAY), np.zeros(len(x))
        narrow = np.flatnonzero(~wide)
        centres = self.vectors.get(dim)
        if centres is None:
            far[narrow] = np.sqrt((x[narrow] ** 2).sum(axis=1))
        else:
            half = (centres**2).sum(axis=1) / 2
            for lo in range(0, len(narrow), 4096):
                some = narrow[lo : lo + 4096]
                cell[some] = np.argmin(half - x[some] @ centres.T, axis=1)
                far[some] = np.sqrt(((x[some] - centres[cell[some]]) ** 2).sum(axis=1))
        cell[wide] = WIDE
        return cell, far

    def floors(self, dim: int, x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """For each query a score that k vectors other than its own reach, as far as the pivots tell."""
        centres = self.vectors.get(dim)
        if centres is None or len(centres) <= k:
            return np.full(len(x), -np.inf)
        out = np.zeros(len(x))
        for lo in range(0, len(x), 4096):
            s = x[lo : lo + 4096] @ centres.T
            s[ids[lo : lo + 4096, None] == self.ids[dim][None]] = -np.inf
            out[lo : lo + 4096] = np.partition(s, -k, axis=1)[:, -k]
        return out

    def centre(self, dim: int, cell: int) -> np.ndarray:
        return self.vectors[dim][cell] if cell >= 0 else np.zeros(dim)


def _matrix(column: pa.Array, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, scaled vectors) for each length in a column of vectors."""
    off = column.offsets.to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    off, size = off - off[0], np.diff(off)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        x = flat[off[rows][:, None] + np.arange(dim)]
        with np.errstate(over="ignore"):
            yield int(dim), rows, np.floor(x * scale)


def clean(df: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return df.filter("vec_id is not null and size(embedding) > 0").filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def choose_pivots(data: DataFrame, scale: float, most: int) -> Pivots:
    """The `most` vectors with the least hashed ids, but for wide ones: a bounded sample of the top of the tree."""
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(most).toArrow().combine_chunks()
    out = Pivots(scale)
    if sample.num_rows:
        ids = sample.column("vec_id").to_numpy()
        for dim, rows, x in _matrix(sample.column("v").combine_chunks(), scale):
            good = np.abs(x).max(axis=1) <= widest(dim)
            if good.any():
                out.vectors[dim], out.ids[dim] = x[good], ids[rows[good]]
    return out


def placed(rows: DataFrame, pivots: Pivots, k: int) -> DataFrame:
    """vec_id, v, dim, cell, far (the distance from its centre), floor."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            n = batch.num_rows
            dims, cell, far, floor = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n), np.full(n, -np.inf)
            ids = batch.column("vec_id").to_numpy()
            for dim, rows, x in _matrix(batch.column("v"), p.scale):
                dims[rows] = dim
                cell[rows], far[rows] = p.cells(dim, x)
                narrow = cell[rows] != WIDE
                floor[rows[narrow]] = p.floors(dim, x[narrow], ids[rows[narrow]], k)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(dims), pa.array(cell), pa.array(far), pa.array(floor)], ["vec_id", "v", "dim", "cell", "far", "floor"])

    return bw.arrow(rows, run, "vec_id long, v array<double>, dim int, cell int, far double, floor double")


def pairs_left(pivots: Pivots, cells: list, groups: list) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Per group of queries (dim, cell) the cells of data, nearest first by bound, that may hold one of its k best.

    `cells` has (dim, cell, radius), `groups` (dim, cell, radius, floor).
    """
    by_dim: dict[int, list] = {}
    for dim, cell, far in cells:
        by_dim.setdefault(dim, []).append((cell, far))
    out = {}
    for dim, cell, far, floor in groups:
        own = by_dim.get(dim, [])
        if cell == WIDE:
            out[dim, cell] = [(dim, c) for c, _ in own]
            continue
        centre = pivots.centre(dim, cell)
        group = Node(centre, far, np.zeros(0), [])
        out[dim, cell] = [(dim, c) for c, r in own if c == WIDE or bound(group, Node(pivots.centre(dim, c), r, np.zeros(0), [])) >= floor]
    return out


_ROW = "block int, side int, vec_id long, v array<double>, floor double, wide boolean"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, block: int = 16_384, chunk: int = 4_096, most_pivots: int = 512, seen: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for queries and vectors given as (vec_id, embedding).

    `block` bounds the vectors in one task, `chunk` the queries beside them, `most_pivots` the sample. `seen` gets how many pairs of
    a group of queries and a cell there are, and how many are left.
    """
    spark = vectors.sparkSession
    data = clean(vectors)
    asked = clean(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    pivots = choose_pivots(data, scale, most_pivots)
    data = materialize(placed(data, pivots, 0).drop("floor"), "vectors")
    asked = materialize(placed(asked, pivots, k), "queries")
    # at most as many rows as there are pivots, and two for each length of vector
    cells = data.groupBy("dim", "cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()
    groups = asked.groupBy("dim", "cell").agg(F.max("far").alias("far"), F.min("floor").alias("floor")).collect()
    left = pairs_left(pivots, [(r["dim"], r["cell"], r["far"]) for r in cells], [tuple(r) for r in groups])
    if seen is not None:
        seen |= {"pairs": sum(len([c for c in cells if c["dim"] == g["dim"]]) for g in groups), "left": sum(map(len, left.values()))}
    # small cells of one length share a block, large ones are cut
    first, blocks, room, open_block = {}, 0, {}, {}
    for r in sorted(cells, key=lambda r: (r["dim"], r["cell"])):
        key = r["dim"], r["cell"]
        if r["cell"] >= 0 and r["n"] <= room.get(r["dim"], 0):
            first[key] = (open_block[r["dim"]], 1)
            room[r["dim"]] -= r["n"]
            continue
        parts = -(-r["n"] // block)
        first[key] = (blocks, parts)
        if r["cell"] >= 0 and parts == 1:
            open_block[r["dim"]], room[r["dim"]] = blocks, block - r["n"]
        blocks += parts
    if not blocks or not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    of_group = {g: sorted({b for c in some for b in range(first[c][0], first[c][0] + first[c][1])}) for g, some in left.items()}
    shared = spark.sparkContext.broadcast((first, of_group))

    def deal_data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, _ = shared.value
        for b in batches:
            where = np.array([first[x] for x in zip(b.column("dim").to_pylist(), b.column("cell").to_pylist(), strict=True)], np.int64).reshape(-1, 2)
            at = where[:, 0] + b.column("salt").to_numpy() % where[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.zeros(len(at), np.int32)), b.column("vec_id"), b.column("v"), pa.array(np.zeros(len(at))), pa.array(b.column("cell").to_numpy() == WIDE)], ["block", "side", "vec_id", "v", "floor", "wide"])

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, of_group = shared.value
        for b in batches:
            own = [of_group[x] for x in zip(b.column("dim").to_pylist(), b.column("cell").to_pylist(), strict=True)]
            row = np.repeat(np.arange(len(own)), [len(x) for x in own])
            to = np.array([x for some in own for x in some], np.int32)
            for lo in range(0, len(row), 10_000):
                take, at = b.take(pa.array(row[lo : lo + 10_000])), to[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.ones(len(at), np.int32)), take.column("vec_id"), take.column("v"), take.column("floor"), pa.array(take.column("cell").to_numpy() == WIDE)], ["block", "side", "vec_id", "v", "floor", "wide"])

    salt = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40))
    both = bw.arrow(data.withColumn("salt", salt), deal_data, _ROW).unionByName(bw.arrow(asked, deal_queries, _ROW))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, x, x_id, wide, tree, large = None, [], None, None, False, None, None
        for batch in batches:
            number, side = batch.column("block").to_numpy(), batch.column("side").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], (np.diff(number) != 0) | (np.diff(side) != 0)))) if len(number) else []
            for lo, hi in zip(cut, [*cut[1:], len(number)], strict=True):
                part = batch.slice(lo, hi - lo)
                if number[lo] != now:
                    now, held, x = number[lo], [], None
                if not side[lo]:
                    held.append(part.select(["vec_id", "v", "wide"]))
                    continue
                if not held:
                    continue
                if x is None:
                    data = pa.Table.from_batches(held).combine_chunks()
                    x_id, wide = data.column("vec_id").to_numpy(), data.column("wide")[0].as_py()
                    (_, _, x), = _matrix(data.column("v").combine_chunks(), scale)
                    large = [integers(v, scale) for v in data.column("v").combine_chunks().flatten().to_numpy().reshape(x.shape)] if wide else None
                    tree = None if wide else cover_tree(x, np.arange(len(x)))
                for at in range(0, hi - lo, chunk):
                    some = part.slice(at, chunk)
                    (_, _, q), = _matrix(some.column("v"), scale)
                    q_id, q_wide = some.column("vec_id").to_numpy(), some.column("wide").to_numpy(zero_copy_only=False)
                    found = []
                    narrow = np.flatnonzero(~q_wide) if not wide else np.zeros(0, np.int64)
                    if len(narrow):
                        score, ids, _ = dual_tree(q[narrow], q_id[narrow], x, x_id, k, tree, some.column("floor").to_numpy()[narrow])
                        r, c = np.nonzero(score > NONE)
                        found = list(zip(q_id[narrow][r].tolist(), ids[r, c].tolist(), score[r, c].tolist(), strict=True))
                    for i in np.flatnonzero(q_wide | wide):
                        large = large or [integers(v, 1.0) for v in x]
                        own = integers(np.array(some.column("v")[int(i)].as_py()), scale)
                        found += [(int(q_id[i]), n, s) for s, n in exact_top(own, int(q_id[i]), large, x_id.tolist(), k)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([max(-LONG - 1, min(LONG, f[2])) for f in found], pa.int64()), pa.array([order_key(f[2]) for f in found], pa.binary())],
                        ["query_id", "vec_id", "score", "key"],
                    )

    near = bw.arrow(both.repartition("block").sortWithinPartitions("block", "side"), search, "query_id long, vec_id long, score long, key binary")
    ranked = near.selectExpr("query_id", "cast(row_number() over (partition by query_id order by key desc, vec_id) as int) as rank", "vec_id", "score")
    return ranked.filter(F.col("rank") <= k)
