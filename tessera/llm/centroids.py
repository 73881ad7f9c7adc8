"""Clusters around integer centroids: float32 screening with rigorous error intervals, exact integers where they overlap.

Components become floor(scale * x). The first centroids are the vectors with the smallest hashed ids; each round assigns every
vector to its nearest centroid and moves each centroid to the exact floored mean of its vectors.

Screening: distances to a vector differ by |c|^2 - 2 x.c. Rows and centroids are brought to a largest component below 1 by powers of two, which
is exact, and x.c is a float32 matrix product. Whatever the order of its sums, it lies within gamma * |x| |c| of the true value, with
gamma = m u / (1 - m u), u = 2^-24 and m the number of components and roundings; rounding in doubles and what falls below the smallest float are
added. Centroids whose interval reaches below the least upper end stay on the shortlist. Where it holds more than one, their
distances are taken again in integers (64 bits if components are below 2^24, else of any size), ties to the smaller number.

Each task sums its vectors per cluster exactly and gives a few rows of 32-bit limbs for each cluster, whatever its rows hold, so the driver
meets as many rows as there are clusters times limbs; vectors are only scanned, never shuffled.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part. A null id hashes as the empty
text; of start vectors with equal ids the lesser vector comes first. Repeated rows each count and get a row each. With fewer vectors than clusters each
is a start; equal centroids leave the later ones empty, and empty ones stay. Distances and sums beyond a long are returned as the largest long. An empty table
gives no rows. Columns other than id and vector are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytewords as bw
from tessera.llm.search import LONG, integers

NARROW = 24  # components of so many bits keep sums of squares within 64 bits
PAIRS = 20_000  # pairs of vector and centroid compared at once


class Centroids:
    """Exact centroids, and what screening needs of them: each as 2^bits * unit, with unit below 1."""

    def __init__(self, exact: list[list[int]]):
        self.exact = exact
        bits = [max((abs(x).bit_length() for x in c), default=0) for c in exact]
        self.bits = np.array(bits, np.int64)
        # quotients of integers are rounded once, whatever their size
        unit = np.array([[x / (1 << b) for x in c] for c, b in zip(exact, bits, strict=True)])
        self.unit = unit.astype(np.float32)
        self.size = np.sqrt((unit**2).sum(axis=1)) * (1 + 2.0**-40)
        self.square = np.array([sum(x * x for x in c) / (1 << 2 * b) for c, b in zip(exact, bits, strict=True)])
        self.narrow = np.array([b <= NARROW for b in bits])
        self.short = np.array([c if b <= NARROW else [0] * len(c) for c, b in zip(exact, bits, strict=True)], np.int64)

    def shortlist(self, v: np.ndarray, scale: int) -> np.ndarray:
        """Which centroids may be nearest to each row of finite v (taken as floor(scale * v); scale is a power of two)."""
        y = np.where(np.abs(v) < 2.0**53, np.floor(np.clip(v, -(2.0**53), 2.0**53) * scale) / scale, v)
        shift = np.frexp(np.abs(y).max(axis=1))[1].astype(np.int64)
        unit = np.ldexp(y, -shift[:, None])
        size = np.sqrt((unit**2).sum(axis=1)) * (1 + 2.0**-40)
        product = (unit.astype(np.float32) @ self.unit.T).astype(float)
        m = (v.shape[1] + 4) * 2.0**-24
        error = m / (1 - m) * size[:, None] * self.size + 2.0**-100
        row = (shift + scale.bit_length() - 1)[:, None]
        top = 2 * np.maximum(row, self.bits.max())
        a, b = np.ldexp(self.square, 2 * self.bits - top), np.ldexp(2.0, row + self.bits - top)
        slack = b * error + 2.0**-48 * (a + b * np.abs(product)) + 2.0**-900
        middle = a - b * product
        return middle - slack <= (middle + slack).min(axis=1)[:, None]

    def distance(self, v: np.ndarray, scale: int, row: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Exact squared distances of pairs; an array of Python integers if any is beyond 64 bits."""
        out = np.zeros(len(row), object)
        y = np.floor(np.clip(v, -(2.0**53), 2.0**53) * scale)
        plain = (np.abs(y).max(axis=1) < 2.0**NARROW)[row] & self.narrow[centre]
        for at in np.split(np.flatnonzero(plain), range(PAIRS, int(plain.sum()), PAIRS)):
            gap = y[row[at]].astype(np.int64) - self.short[centre[at]]
            out[at] = (gap * gap).sum(axis=1)
        for at in np.flatnonzero(~plain):
            out[at] = sum((a - b) ** 2 for a, b in zip(integers(v[row[at]], scale), self.exact[centre[at]], strict=True))
        return out.astype(np.int64) if plain.all() else out

    def nearest(self, v: np.ndarray, scale: int) -> np.ndarray:
        near = self.shortlist(v, scale)
        best = near.argmax(axis=1)
        unsure = np.flatnonzero(near.sum(axis=1) > 1)
        if len(unsure):
            row, centre = np.nonzero(near[unsure])
            d = self.distance(v[unsure], scale, row, centre)
            order = np.lexsort((centre, d, row)) if d.dtype != object else np.array(sorted(range(len(d)), key=lambda i: (row[i], d[i], centre[i])))
            first = np.concatenate(([True], row[order][1:] != row[order][:-1]))
            best[unsure] = centre[order[first]]
        return best


def limbs(value: int) -> list[int]:
    """value = sum of limb * 2^(32 i): all but the last in 0 to 2^32 - 1, the last in 32 bits with a sign."""
    out = []
    while not -(1 << 31) <= value < 1 << 31:
        out.append(value & 0xFFFFFFFF)
        value >>= 32
    return [*out, value]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def vectors_of(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.filter((F.size(vector_col) == dims) & ~odd)
    return kept.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))


def cluster_sums(rows: DataFrame, centroids: Centroids, dims: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact sums of each cluster that isn't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids.exact)
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                v = _matrix(batch.column("embedding").slice(lo, 4096), dims)
                label = centroids.nearest(v, scale)
                count += np.bincount(label, minlength=k)
                y = np.floor(np.clip(v, -(2.0**53), 2.0**53) * scale)
                plain = np.abs(y).max(axis=1) < 2.0**NARROW
                member = (label[None] == np.arange(k)[:, None]) & plain
                sums = sums + (member.astype(float) @ np.where(plain[:, None], y, 0)).astype(np.int64)  # sums below 2^36 are exact
                for i in np.flatnonzero(~plain):
                    sums[label[i]] += np.array(integers(v[i], scale), object)
        for c in np.flatnonzero(count):
            parts = [limbs(int(x)) for x in sums[c]]
            most = max(len(p) for p in parts)
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array([c] * most, pa.int32()), "limb": pa.array(range(most), pa.int32()), "n": pa.array([int(count[c])] + [0] * (most - 1), pa.int64()),
                "v": pa.array([[p[i] if i < len(p) else 0 for p in parts] for i in range(most)], pa.list_(pa.int64())),
            })

    partial = bw.arrow(rows.select("embedding"), run, "cluster int, limb int, n long, v array<long>")
    whole = partial.select("cluster", "limb", "n", F.posexplode("v").alias("place", "v")).groupBy("cluster", "limb", "place").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    count: dict[int, int] = {}
    total: dict[int, list[int]] = {}
    for r in whole.collect():  # clusters times limbs times components
        total.setdefault(r["cluster"], [0] * dims)[r["place"]] += r["v"] << 32 * r["limb"]
        if r["place"] == 0:
            count[r["cluster"]] = count.get(r["cluster"], 0) + r["n"]
    return {c: (count[c], sums) for c, sums in total.items()}


def assigned(rows: DataFrame, centroids: Centroids, dims: int, scale: int) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                v = _matrix(part.column("embedding"), dims)
                label = centroids.nearest(v, scale)
                d = centroids.distance(v, scale, np.arange(len(v)), label)
                far = pa.array(d if d.dtype != object else [min(int(x), LONG) for x in d], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(label.astype(np.int32)), far], ["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return bw.arrow(rows, run, f"vec_id {kind}, cluster int, distance long")


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    `scale` is a power of two. Broadcast to tasks, and held on the driver: k centroids of `dims` components.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale must be a power of two")
    rows = vectors_of(vectors, dims, id_col, vector_col)
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(named, "embedding").limit(k).collect()
    if not first:
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    centroids = Centroids([integers(np.array(r["embedding"]), scale) for r in first])
    for _ in range(rounds):
        sums = cluster_sums(rows, centroids, dims, scale)
        centroids = Centroids([[s // sums[c][0] for s in sums[c][1]] if c in sums else old for c, old in enumerate(centroids.exact)])
    out = assigned(rows, centroids, dims, scale)
    inertia = {r["cluster"]: int(r["x"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    of = lambda values: F.array(*[F.lit(x) for x in values])[F.col("cluster")]
    return out.select(
        "vec_id", "cluster", "distance", of([min(inertia.get(c, 0), LONG) for c in range(len(first))]).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), LONG)).cast("long").alias("inertia"),
        of([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.exact]).alias("centroid_sha256"),
    )
