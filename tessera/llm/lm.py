"""Masked pseudo-likelihood: a window network, trained in numpy, predicts every token from both sides.

Tokens are words. The corpus's most frequent ones are one id each; the id of any other word is its first byte, and a
spelling model (byte trigrams over bigrams) gives the rest of it, so no word is left out and the ids have a fixed number.
The network sums a vector for each of the two ids before and after the masked place, and predicts the id by its class and its
place within the class. Counts of words and of byte trigrams are taken over all documents. Documents are dealt to `rounds` turns by
a hash of their ids; in each turn every partition trains on all places of its documents of that turn, from the same weights, which are then
averaged by places seen. So every place is trained on once. Batches are dealt so that each meets few of the rare classes, and grow in long turns. The weights depend on how rows lie in partitions: the less a partition holds,
the less its network learns in a turn. A document's score is the sum of its words' conditional log-probabilities, and its mean is that
by word. `train_and_score` scores the rows it was trained on; `train` and `score` take any two tables.

Defined cases: null texts and texts without words have 0 tokens, a sum of 0 and a null mean; repeated rows get a row each; on an
empty corpus the weights stay at their start. Columns other than the id and the text are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytewords as bw
from tessera.plans.storage import materialize, release

CLASSES, MEMBERS, WIDTH = 64, 64, 32  # the last of the hidden units is constant, for the biases
VOCABULARY = CLASSES * MEMBERS
NAMED = 257  # ids below are the edge of a text (0) and first bytes
TRIGRAMS = 65_536  # of the spelling model, the most frequent ones
SYMBOLS = 165.0  # bytes that words are made of, and the end of a word (0)
WINDOW = (-2, -1, 1, 2)
SHAPES = {"context": (len(WINDOW), VOCABULARY, WIDTH), "classes": (WIDTH, CLASSES), "members": (CLASSES, WIDTH, MEMBERS)}
CHUNK = 8192
PLACES = 2048  # scored at once
ROUNDS, BATCH, RATE = 4, 512, 0.8
GROWTH = 512  # places seen for each of a larger batch
TOGETHER = 16  # batches that the places of rare classes are gathered in


def start_weights(counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random vectors; biases at the log frequencies."""
    r = np.random.default_rng(seed)
    w = {k: (r.standard_normal(s) * 0.05).astype(np.float32) for k, s in SHAPES.items()}
    share = (counts + 1.0).reshape(CLASSES, MEMBERS)
    w["classes"][-1] = np.log(share.sum(axis=1) / share.sum())
    w["members"][:, -1] = np.log(share / share.sum(axis=1, keepdims=True))
    return w


def hidden(w: dict, context: np.ndarray) -> np.ndarray:
    """Of the places whose neighbours are the columns of `context`."""
    h = w["context"][0].take(context[0], axis=0)
    for p in range(1, len(WINDOW)):
        h += w["context"][p].take(context[p], axis=0)
    np.tanh(h, out=h)
    h[:, -1] = 1
    return h


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of z in place, and its sums by row."""
    np.exp(np.clip(z, -60, 60, out=z), out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def by_class(w: dict, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """The order of the rows by class, each class's range in it, the hidden rows in that order and their members' logits."""
    order = np.argsort(c, kind="stable")
    cut = np.searchsorted(c.take(order), np.arange(CLASSES + 1)).tolist()
    ranges = [(k, a, b) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
    hs = h.take(order, axis=0)
    z = np.empty((len(c), MEMBERS), h.dtype)
    for k, a, b in ranges:
        np.matmul(hs[a:b], w["members"][k], out=z[a:b])
    return order, ranges, hs, z


def log_likelihood(w: dict, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    h = hidden(w, context)
    c, m, row = target // MEMBERS, target % MEMBERS, np.arange(len(target))
    z = h @ w["classes"]
    out = np.clip(z[row, c], -60, 60)
    out -= np.log(exponentials(z)[1])
    order, _, _, z = by_class(w, h, c)
    more = np.clip(z[row, m.take(order)], -60, 60)
    out[order] += more - np.log(exponentials(z)[1])
    return out


def gradients(w: dict, context: np.ndarray, target: np.ndarray) -> tuple[dict, np.ndarray]:
    """Of the mean negative log-likelihood: by the output weights, and by each place's sum of context vectors."""
    n, row = len(target), np.arange(len(target))
    h = hidden(w, context)
    c, m = target // MEMBERS, target % MEMBERS
    p, total = exponentials(h @ w["classes"])
    p *= 1 / (n * total)[:, None]
    p[row, c] -= 1 / n
    g = {"classes": h.T @ p, "members": np.zeros_like(w["members"])}
    back = p @ w["classes"].T
    order, ranges, hs, z = by_class(w, h, c)
    q, total = exponentials(z)
    q *= 1 / (n * total)[:, None]
    q[row, m.take(order)] -= 1 / n
    more = np.empty_like(hs)
    for k, a, b in ranges:
        np.matmul(hs[a:b].T, q[a:b], out=g["members"][k])
        np.matmul(q[a:b], w["members"][k].T, out=more[a:b])
    back[order] += more
    h *= h
    back *= 1 - h
    back[:, -1] = 0
    return g, back


def adagrad(x: np.ndarray, squares: np.ndarray, rate: float) -> np.ndarray:
    """The step against the gradient `x`, in its place."""
    x *= rate
    x /= np.sqrt(squares)
    return x


def descend(x: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """An Adagrad step of some rows, each named once."""
    seen = squares.take(rows, axis=0)
    seen += gradient * gradient
    squares[rows] = seen
    now = x.take(rows, axis=0)
    now -= adagrad(gradient, seen, rate)
    x[rows] = now


def summed(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, those that stand most often first, and the sums of their rows; `x` is repeated over the ids."""
    order = np.argsort(ids, kind="stable")
    ids = ids.take(order)
    order %= len(x)
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    n = np.diff(np.append(first, len(ids)))
    by = np.argsort(-n, kind="stable")
    first, n = first.take(by), n.take(by)
    out = x.take(order.take(first), axis=0)
    more = np.searchsorted(-n, -np.arange(n[0]), side="left").tolist()  # how many ids stand more than k times
    k = 1
    while k < n[0] and more[k] >= 8:  # the k-th of all ids at once
        out[: more[k]] += x.take(order.take(first[: more[k]] + k), axis=0)
        k += 1
    for i in range(more[k] if k < n[0] else 0):
        out[i] += x.take(order[first[i] + k : first[i] + n[i]], axis=0).sum(axis=0)
    return ids.take(first), out


def train_step(w: dict, memory: dict, context: np.ndarray, target: np.ndarray, rate: float = RATE) -> None:
    """One Adagrad step on the mean negative log-likelihood of a batch."""
    g, back = gradients(w, context, target)
    ids = (context + VOCABULARY * np.arange(len(WINDOW))[:, None]).astype(np.int16).ravel()  # rows of all windows' vectors
    descend(w["context"].reshape(-1, WIDTH), memory["context"].reshape(-1, WIDTH), *summed(ids, back), rate)
    memory["classes"] += g["classes"] * g["classes"]
    w["classes"] -= adagrad(g["classes"], memory["classes"], rate)
    k = np.flatnonzero(np.bincount(target // MEMBERS, minlength=CLASSES))  # other classes' members have no gradient
    descend(w["members"], memory["members"], k, g["members"].take(k, axis=0), rate)


def dealt(target: np.ndarray, batch: int, r: np.random.Generator) -> np.ndarray:
    """An order of the places with these targets, in batches of `batch`, whose batches each meet few of the rare classes.

    Places of classes that fill an eighth of them or more are spread over all batches at random; those of the others lie together by class, equally many in
    each batch, as few products by class are then due. The batches come in random order, a short one last.
    """
    c = target // MEMBERS
    whole = len(c) // batch
    if whole < 2:
        return np.arange(len(c))
    c = c[: whole * batch]
    rare = (np.bincount(c, minlength=CLASSES) < whole * batch // 8).take(c)
    often, seldom = np.flatnonzero(~rare), np.flatnonzero(rare)
    seldom = seldom.take(np.argsort(c.take(seldom), kind="stable"))
    turn = r.permutation(whole)
    of = np.empty(len(c), np.int64)
    of[seldom] = turn.take(np.arange(len(seldom)) * whole // max(len(seldom), 1))
    room = batch - np.bincount(of[seldom], minlength=whole)
    of[often] = r.permutation(np.repeat(np.arange(whole), room))
    return np.concatenate((np.argsort(of, kind="stable"), np.arange(len(c), len(target))))


@dataclass
class Spelling:
    """Probabilities of a byte (0 ends a word) behind the two before it (0 stands before the first)."""

    keys: np.ndarray  # sorted trigrams
    count: np.ndarray
    context: np.ndarray  # counts of the two bytes before, over `keys`
    bigram: np.ndarray  # probability of a byte behind one

    def log_probability(self, w: bw.Words, word: np.ndarray) -> np.ndarray:
        """Of the words `word`, given their first bytes."""
        n = w.end[word] - w.start[word]
        key = trigrams(w, word)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = np.where(self.keys[at] == key, self.count[at], 0) if len(self.keys) else np.zeros(len(key))
        # as many observations from the bigrams as there are symbols
        p = (known + SYMBOLS * self.bigram[key & 0xFFFF]) / (self.context[key >> 8] + SYMBOLS)
        return np.add.reduceat(np.log(p), np.cumsum(n) - n) if len(n) else np.zeros(0)


def trigrams(w: bw.Words, word: np.ndarray) -> np.ndarray:
    """Per word as many as it has bytes: those that end on its second byte to its last, and on its end."""
    n = w.end[word] - w.start[word]
    each = np.repeat(np.arange(len(word)), n)
    place = 1 + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    at = w.start[word][each] + place
    last = np.where(place < n[each], w.data[at], 0).astype(np.int64)  # the data end in zero bytes
    before = w.data[at - 1].astype(np.int64)
    return last | before << 8 | np.where(place > 1, w.data[at - 2], 0).astype(np.int64) << 16


@dataclass
class Names:
    """Hashes of named words, sorted, with their ids."""

    word: np.ndarray
    word_id: np.ndarray


def token_ids(w: bw.Words, names: Names) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, and the hashes of those without a name."""
    h = w.hashes()
    ids = 1 + w.data[w.start].astype(np.int16)
    if not len(names.word):
        return ids, h
    at = np.minimum(np.searchsorted(names.word, h), len(names.word) - 1)
    named = names.word[at] == h
    return np.where(named, names.word_id[at].astype(np.int16), ids), h[~named]


def padded(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids with edges between them, and the places of the ids in that."""
    edge = max(abs(d) for d in WINDOW)
    place = np.arange(len(ids)) + edge * (1 + np.repeat(np.arange(len(first) - 1), np.diff(first)))
    flat = np.zeros(len(ids) + edge * (len(first) + 1), np.int16)
    flat[place] = ids
    return flat, place


def contexts(flat: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.stack([flat.take(place + d) for d in WINDOW])


def vocabulary(documents: DataFrame) -> tuple[Names, np.ndarray, Spelling]:
    """The most frequent words, the corpus counts of all ids to start from, and the spelling model."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in bw.word_slices(batch.column("text"), bw.ALNUM):
                key, at, n = np.unique(w.hashes(), return_index=True, return_counts=True)
                tri, inverse = np.unique(trigrams(w, at), return_inverse=True)
                total = np.bincount(inverse, weights=np.repeat(n, w.end[at] - w.start[at]), minlength=len(tri)).astype(np.int64)
                kind = np.repeat(np.array([0, 1], np.int8), [len(key), len(tri)])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate((key.view(np.int64), tri))), pa.array(np.concatenate((n, total)))], ["kind", "key", "n"])

    found = materialize(bw.arrow(documents.select("text"), count, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "words")
    pick = lambda kind, most: found.filter(F.col("kind") == kind).select("key", "n").orderBy(F.desc("n"), "key").limit(most).toArrow()
    top, tri = pick(0, VOCABULARY - NAMED), pick(1, TRIGRAMS)
    words = found.filter("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    pairs = found.filter("kind = 1").groupBy(F.expr("key & 65535").alias("pair")).agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows at most
    release(found)
    bigram = np.zeros(65_536)
    bigram[pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
    bigram = bigram.reshape(256, 256)
    bigram = ((bigram + 1) / (bigram.sum(axis=1, keepdims=True) + SYMBOLS)).ravel()
    key, n = tri.column("key").to_numpy(), tri.column("n").to_numpy()
    order = np.argsort(key)
    spelling = Spelling(key[order], n[order].astype(np.float64), np.bincount(key >> 8, weights=n, minlength=65_536), bigram)
    counts = np.zeros(VOCABULARY)
    begins = key >> 16 == 0
    counts[1:NAMED] = np.bincount(key[begins] >> 8 & 255, weights=n[begins], minlength=256)
    named = top.column("n").to_numpy()
    counts[1:NAMED] *= (words - named.sum()) / max(counts.sum(), 1)
    counts[NAMED : NAMED + len(named)] = named
    word = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(word)
    return Names(word[order], NAMED + order), counts, spelling


def encode(documents: DataFrame, names: Names, spelling: Spelling, id_column: str = "doc_id") -> DataFrame:
    """id, spelled (the log-probability of the spelling of words without a name), ids (16-bit integers)."""
    shared = documents.sparkSession.sparkContext.broadcast((names, spelling))  # a fixed size
    frame = documents.select(id_column, "text")
    kind = frame.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, spelling = shared.value
        for batch in batches:
            for lo, _, w in bw.word_slices(batch.column("text"), bw.ALNUM):
                ids, h = token_ids(w, names)
                rare = np.flatnonzero(ids < NAMED)
                _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
                spelled = np.bincount(w.doc[rare], weights=spelling.log_probability(w, rare[at])[inverse], minlength=w.texts).astype(float)
                raw = ids.astype("<i2").tobytes()
                each = pa.Array.from_buffers(pa.large_binary(), w.texts, [None, pa.py_buffer(2 * w.first.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, w.texts), pa.array(spelled), each], [id_column, "spelled", "ids"])

    return bw.arrow(frame, run, f"`{id_column}` {kind}, spelled double, ids binary")


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, where each text's begin) of consecutive rows."""
    for lo, _, data, off in bw.slices(column):
        yield lo, np.frombuffer(data.tobytes(), "<i2"), off // 2


def fit(encoded: DataFrame, counts: np.ndarray, rounds: int = ROUNDS, batch: int = BATCH) -> dict:
    """Weights, by averaging those that each partition trains.

    Batches begin at 256 places and grow with the places seen, to `batch`, and to eight times that as those are many, for the noise of small steps
    is what a long turn ends in. `TOGETHER` of them are dealt at once.
    """
    spark = encoded.sparkSession
    weights = start_weights(counts)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(weights)  # a fixed size

        def local(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            w = {k: v.copy() for k, v in shared.value.items()}
            memory = {k: np.full_like(v, 0.01) for k, v in w.items()}
            r = np.random.default_rng(turn)
            seen = 0
            for b in batches:
                for _, ids, first in _texts(b.column("ids")):
                    flat, place = padded(ids, first)
                    place = np.random.default_rng(turn).permutation(place)
                    while len(place):
                        size = min(max(256, seen // 8), max(batch, min(seen // GROWTH, 8 * batch)))
                        some, place = np.split(place, [size if size < batch else TOGETHER * size])
                        some = some.take(dealt(flat.take(some), size, r))
                        for at in range(0, len(some), size):
                            now = some[at : at + size]
                            train_step(w, memory, contexts(flat, now), flat.take(now))
                        seen += len(some)
            if seen:
                sums = np.concatenate([w[k].ravel() for k in SHAPES]) * np.float32(seen)
                chunks = [sums[k : k + CHUNK] for k in range(0, len(sums), CHUNK)]
                part = int(np.random.default_rng(seen).integers(64))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.list_(pa.float32())), pa.array([seen] * len(chunks), pa.int64()), pa.array([part] * len(chunks), pa.int32())], ["chunk", "sums", "seen", "part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for b in batches:
                values = b.column("sums")
                for i, (c, n) in enumerate(zip(b.column("chunk").to_pylist(), b.column("seen").to_pylist(), strict=True)):
                    x = values[i].values.to_numpy().astype(np.float64)
                    if c in total:
                        total[c][0] = total[c][0] + x
                        total[c][1] += n
                    else:
                        total[c] = [x, n]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v[0].astype(np.float32) for v in total.values()], pa.list_(pa.float32())), pa.array([v[1] for v in total.values()], pa.int64()), pa.array([0] * len(total), pa.int32())], ["chunk", "sums", "seen", "part"])

        kind = "chunk int, sums array<float>, seen long, part int"
        of_turn = encoded.select("ids").filter(F.pmod(F.xxhash64("ids"), F.lit(rounds)) == turn)
        # two levels of sums, so no task reads more than a share of the partitions' weights
        summed = bw.arrow(bw.arrow(bw.arrow(of_turn, local, kind).repartition("chunk", "part"), add, kind).repartition("chunk"), add, kind)
        got = sorted(((r["chunk"], r["sums"], r["seen"]) for r in summed.collect()), key=lambda r: r[0])  # one model's size
        shared.unpersist()
        if not got:
            continue
        flat, at = np.concatenate([np.array(s) / n for _, s, n in got]), 0
        weights = {}
        for k, shape in SHAPES.items():
            size = int(np.prod(shape))
            weights[k], at = flat[at : at + size].reshape(shape).astype(np.float32), at + size
    return weights


def score_encoded(encoded: DataFrame, weights: dict, id_column: str = "doc_id") -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast(weights)
    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for lo, ids, first in _texts(batch.column("ids")):
                flat, place = padded(ids, first)
                each = np.zeros(len(ids))
                order = np.argsort(ids, kind="stable")  # so that a step meets few classes
                for k in range(0, len(ids), PLACES):
                    at = order[k : k + PLACES]
                    some = place.take(at)
                    each[at] = log_likelihood(w, contexts(flat, some), flat.take(some))
                n = np.diff(first)
                total = np.bincount(np.repeat(np.arange(len(n)), n), weights=each, minlength=len(n)).astype(float)
                total += batch.column("spelled").slice(lo, len(n)).to_numpy()
                mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([batch.column(id_column).slice(lo, len(n)), pa.array(n), pa.array(total), mean], [id_column, "n_tokens", "pll", "mean_pll"])

    return bw.arrow(encoded, run, f"`{id_column}` {kind}, n_tokens long, pll double, mean_pll double")


def train(documents: DataFrame, rounds: int = ROUNDS, batch: int = BATCH) -> tuple[dict, Names, Spelling]:
    """Weights, names and spelling of a corpus."""
    names, counts, spelling = vocabulary(documents)
    encoded = materialize(encode(documents.select(F.lit(0).alias("doc_id"), "text"), names, spelling), "ids")
    weights = fit(encoded, counts, rounds, batch)
    release(encoded)
    return weights, names, spelling


def score(documents: DataFrame, model: tuple[dict, Names, Spelling], id_column: str = "doc_id") -> DataFrame:
    """id, n_tokens, pll (sum of conditional log-probabilities), mean_pll."""
    weights, names, spelling = model
    return score_encoded(encode(documents, names, spelling, id_column), weights, id_column)


def train_and_score(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The scores of a corpus by a model of itself; texts are cut to ids once."""
    names, counts, spelling = vocabulary(documents)
    encoded = materialize(encode(documents, names, spelling), "ids")
    return score_encoded(encoded, fit(encoded, counts, rounds))
