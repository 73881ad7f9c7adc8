"""Best-fit packing of tokenised documents into sequences, by bin completion.

Documents longer than a sequence are cut into full sequences and a rest. What remains is bin packing over the
histogram of piece lengths, which has at most `capacity` entries whatever the corpus:
bin completion takes the longest piece left, enumerates the undominated ways to fill
the rest of its sequence (fullest first), fixes one for as many sequences as the histogram
allows, and backtracks within a node limit. The best-fit-decreasing solution is the
first incumbent; a branch is cut when its waste exceeds what the incumbent
allows. Pieces are then dealt to the sequences of the solution by their rank within their length, with
no shuffle of texts and no global sort.

Defined cases: null and empty texts are the end id alone; bytes that aren't UTF-8 are read as U+FFFD; repeated rows are packed each; an empty table gives
no rows; other columns are passed over, so names can't clash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import wordbpe
from tessera.llm import bytewords as bw
from tessera.plans.storage import materialize

END_ID = 0


@dataclass
class Run:
    """`times` sequences filled alike: uses of each length."""

    fill: tuple[tuple[int, int], ...]  # (length, uses)
    times: int


@dataclass
class Plan:
    runs: list[Run] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(r.times for r in self.runs)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Each longest piece goes where it leaves the least room; alike sequences are handled together."""
    lengths = sorted((k for k, v in counts.items() if v), reverse=True)
    left = dict(counts)
    rooms: dict[int, list[list]] = defaultdict(list)  # room -> [fill, times]
    open_rooms: list[int] = []
    for k in lengths:
        n = left[k]
        while n:
            i = _first_at_least(open_rooms, k)
            if i < len(open_rooms):
                room = open_rooms[i]
                fill, times = rooms[room].pop()
                use = min(n, times)
                if times > use:
                    rooms[room].append([fill, times - use])
                if not rooms[room]:
                    open_rooms.pop(i)
                n -= use
            else:
                room, fill = capacity, {}
                per = capacity // k
                use = n // per if n >= per else 1
                times_each = min(per, n)
                fill = {k: times_each}
                n -= use * times_each
                _put(rooms, open_rooms, capacity - k * times_each, fill, use)
                continue
            # fill one room at a time with as many of this length as fit
            more = min(room // k, 1 + n // use) if use else 1
            n -= use * (more - 1)
            _put(rooms, open_rooms, room - k * more, fill | {k: fill.get(k, 0) + more}, use)
    return Plan([Run(tuple(sorted(f.items(), reverse=True)), t) for some in rooms.values() for f, t in some])


def _first_at_least(rooms: list[int], k: int) -> int:
    return bisect_right(rooms, k - 1)


def _put(rooms: dict, open_rooms: list[int], room: int, fill: dict, times: int) -> None:
    if not rooms[room]:
        open_rooms.insert(bisect_right(open_rooms, room), room)
    rooms[room].append([fill, times])


def completions(room: int, counts: dict[int, int], lengths: list[int], most: int, steps: int = 400) -> list[dict[int, int]]:
    """Up to `most` undominated fillings of `room`, fullest first, in at most `steps` * `most` search steps.

    A filling is dominated if one piece of it can be exchanged for a longer one that is left and fits.
    """
    found: list[tuple[int, dict[int, int]]] = []
    left = [steps * most]

    def go(i: int, room: int, fill: dict[int, int]) -> None:
        if left[0] <= 0 or (len(found) >= most and found[-1][0] == 0):
            return
        left[0] -= 1
        while i < len(lengths) and (lengths[i] > room or counts[lengths[i]] <= fill.get(lengths[i], 0)):
            i += 1
        if i == len(lengths):
            waste = room
            dominated = any(counts.get(k + d, 0) > fill.get(k + d, 0) for k in fill for d in range(1, min(waste, 64) + 1))
            if not dominated and all(f != fill for _, f in found):
                found.append((waste, dict(fill)))
                found.sort(key=lambda x: x[0])
                del found[most:]
            return
        k = lengths[i]
        for uses in range(min(room // k, counts[k]), -1, -1):
            go(i + 1, room - uses * k, fill | {k: uses} if uses else fill)
            if left[0] <= 0 or (len(found) >= most and found[-1][0] == 0):
                return

    go(0, room, {})
    return [f for _, f in found]


def bin_completion(counts: dict[int, int], capacity: int, branch: int = 3, nodes: int | None = None) -> Plan:
    """The best plan found; it is known to be optimal where it meets the sum bound. Beyond that it is a search: `branch` fillings a node, dominance
    among those of short lengths, and `nodes` bound what is tried.

    A whole plan has at most two runs for each length, so four nodes a length (3000 at least) leave room for whole dives
    and backtracking. The search changes one histogram in place and undoes it on the way back, so its memory is that of one
    plan. Each node completes its branch by best fit, for a better incumbent.
    """
    counts = {k: v for k, v in counts.items() if v}
    nodes = max(3000, 4 * len(counts)) if nodes is None else nodes
    total = sum(k * v for k, v in counts.items())
    bound = -(-total // capacity)
    best = best_fit_decreasing(counts, capacity)
    runs: list[Run] = []
    #: per level: fillings not yet tried, the filling in force, sequences and waste before it
    stack: list[list] = []
    used = waste = spent = 0

    def fillings() -> list[dict[int, int]]:
        k = max(counts)
        rest = counts | {k: counts[k] - 1}
        out = completions(capacity - k, rest, sorted((x for x in rest if x <= capacity - k and rest[x]), reverse=True), branch)
        return [f | {k: f.get(k, 0) + 1} for f in reversed(out)]

    if best.sequences > bound:
        stack.append([fillings(), None, 0, 0])
    while stack and best.sequences > bound:
        level = stack[-1]
        if level[1] is not None:
            run = runs.pop()
            for x, u in run.fill:
                counts[x] = counts.get(x, 0) + u * run.times
            level[1], used, waste = None, level[2], level[3]
        if not level[0] or spent >= nodes:
            stack.pop()
            continue
        whole = level[0].pop()
        times = min(counts[x] // u for x, u in whole.items())
        for x, u in whole.items():
            counts[x] -= u * times
            if not counts[x]:
                del counts[x]
        runs.append(Run(tuple(sorted(whole.items(), reverse=True)), times))
        level[1] = whole
        used, waste, spent = used + times, waste + times * (capacity - sum(x * u for x, u in whole.items())), spent + 1
        if not counts:
            if used < best.sequences:
                best = Plan(list(runs))
            continue
        # to beat the incumbent the whole waste may be this at most
        if waste > (best.sequences - 1) * capacity - total:
            continue
        tail = best_fit_decreasing(counts, capacity)
        if used + tail.sequences < best.sequences:
            best = Plan([*runs, *tail.runs])
        stack.append([fillings(), None, used, waste])
    return best


class Places:
    """For each length, the ranges of ranks that a plan's runs take, to look up a piece's sequence and offset."""

    def __init__(self, plan: Plan):
        rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        taken: dict[int, int] = defaultdict(int)
        first = 0
        for run in plan.runs:
            offset = 0
            for k, uses in run.fill:
                rows[k].append((taken[k], uses, first, offset))
                taken[k] += uses * run.times
                offset += uses * k
            first += run.times
        self.by_length = {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length):
            at = np.flatnonzero(length == k)
            start, uses, first, base = self.by_length[int(k)]
            i = np.searchsorted(start, rank[at], "right") - 1
            q = rank[at] - start[i]
            sequence[at], offset[at] = first[i] + q // uses[i], base[i] + q % uses[i] * k
        return sequence, offset


def tokenized_pieces(documents: DataFrame, tokenizer: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), one row per piece."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(tokenizer)
        for batch in batches:
            texts = bw.texts(batch.column(1))
            for lo, hi in wordbpe.token_groups(texts):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, some in enumerate(bpe.encode_batch(texts[lo:hi]), lo):
                    raw = some.astype("<u4").tobytes() + END_ID.to_bytes(4, "little")
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    return bw.arrow(documents.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit_pack(documents: DataFrame, tokenizer: str, capacity: int = 2048, per_bucket: int = 20_000, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset.

    Pieces of one length are numbered in buckets of about `per_bucket`. What the driver holds: a count per length and bucket, at
    most `capacity` and one for each `per_bucket` pieces, and the plan.
    A plan has at most two runs for each length, as it splits one only when a length is used up, so it is bounded by `capacity` too.
    """
    spark = documents.sparkSession
    pieces = tokenized_pieces(documents, tokenizer, capacity, with_ids)
    spread = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(1 << 30)).cast("int")
    pieces = materialize(pieces.withColumn("spread", spread), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = bin_completion(counts, capacity)
    buckets = [max(1, -(-counts.get(k, 0) // per_bucket)) for k in range(1, capacity + 1)]
    pieces = pieces.withColumn("bucket", F.expr(f"spread % element_at(array({', '.join(map(str, buckets))}), cast(length as int))")).drop("spread")
    first = np.concatenate(([0], np.cumsum(buckets)))
    base = np.zeros(first[-1] + 1, np.int64)
    for r in pieces.groupBy("length", "bucket").count().collect():
        base[first[r["length"] - 1] + r["bucket"] + 1] = r["count"]
    base = np.cumsum(base)
    base -= np.repeat(base[first], [*buckets, 1])  # ranks begin at 0 in each length
    places = Places(plan)
    shared = spark.sparkContext.broadcast((places, base, first))
    order = "row_number() over (partition by length, bucket order by doc_id, piece)"
    ranked = pieces.withColumn("rank", F.expr(order) - 1)
    names = [c for c in pieces.columns if c != "bucket"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "bucket")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, base, first = shared.value
        for batch in batches:
            length, bucket = batch.column("length").to_numpy(), batch.column("bucket").to_numpy()
            sequence, offset = places.find(length, batch.column("rank").to_numpy() + base[first[length - 1] + bucket])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return bw.arrow(ranked, place, f"{fields}, sequence_id long, offset long")
