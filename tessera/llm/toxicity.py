"""Toxic passages: every maximum-scoring segment of token log-odds, with extreme-value calibration.

Learning: counts of words and of their first 3 to 6 bytes in labelled documents (once for each
family of texts that share their least hashed run of four words, or all words if they are fewer, by one of them, so that copies don't count again) give log-odds
with an informative Dirichlet prior (the counts of both classes together, scaled). Features whose
log-odds are `min_delta` and `min_z` standard deviations from 0 keep them, so that words of a language
or topic that is merely commoner among toxic texts do not add up over long texts; a word scores as its most
significant feature and any other word as a small negative drift.
Scoring: one linear scan (Ruzzo and Tompa) finds all disjoint maximal segments of a text. As
the scores are log-likelihood ratios, the best segment of a text of m words follows, without
toxicity, P(S >= s) = 1 - exp(-K m exp(-s)); K is estimated on the non-toxic labelled texts. A logistic
fit over -ln of that tail and the summed excess of significant segments gives the score.

Defined cases: null and empty texts have no words and get the score of an empty text; repeated
rows get a row each; rows with a null doc_id are scored too and count as not held out. A doc_id with several labels counts
as toxic if one of them is 1; null labels are left out. Without labels of both classes all scores are 0.
Columns of other names are passed over, so clashes can't occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytewords as bw
from tessera.plans.storage import materialize, release

#: Byte lengths of the word beginnings that are features, besides whole words (0).
PREFIXES = (0, 3, 4, 5, 6)
EULER = 0.5772156649015329


@dataclass
class ToxicityModel:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted feature hashes
    delta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))  # |z|
    drift: float = -0.25
    k: float = 1e-3
    coef: np.ndarray = field(default_factory=lambda: np.array([-50.0, 0.0, 0.0]))
    significance: float = 1e-3

    def probability(self, best: np.ndarray, total: np.ndarray, m: np.ndarray) -> np.ndarray:
        x = design(best, total, m, self.k)
        return 1 / (1 + np.exp(-np.clip(x @ self.coef, -40, 40)))


def design(best: np.ndarray, total: np.ndarray, m: np.ndarray, k: float) -> np.ndarray:
    """1, -ln P(no toxic text of m words has so good a segment), ln(1 + the summed excess)."""
    expected = k * np.maximum(m, 1) * np.exp(-best)
    tail = -np.log(np.maximum(-np.expm1(-expected), 1e-30))
    tail = np.where(best > 0, np.minimum(tail, 30.0), 0.0)
    return np.stack([np.ones(len(best)), tail, np.log1p(total)], axis=1)


def features(w: bw.Words) -> list[np.ndarray]:
    return [bw.mix(w.hashes(p or None) + np.uint64(p)) for p in PREFIXES]


def word_scores(w: bw.Words, model: ToxicityModel) -> np.ndarray:
    n = len(w.start)
    score, rank = np.full(n, model.drift), np.zeros(n)
    if not len(model.keys):
        return score
    for h in features(w):
        at = np.minimum(np.searchsorted(model.keys, h), len(model.keys) - 1)
        better = (model.keys[at] == h) & (model.weight[at] > rank)
        score[better], rank[better] = model.delta[at[better]], model.weight[at[better]]
    return score


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) in one pass over the positive positions."""
    after = np.cumsum(score)
    found: list[list] = []  # first, end, sum before, sum after
    for i in np.flatnonzero(score > 0):
        seg = [int(i), int(i) + 1, float(after[i] - score[i]), float(after[i])]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= seg[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= seg[3]:
                found.append([*seg, j])
                break
            seg = [found[j][0], seg[1], found[j][2], seg[3]]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


def _scan(batches: Iterator[pa.RecordBatch], model: ToxicityModel, carry: list[str], with_passages: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        n = batch.num_rows
        best, total, m = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        passages: list[list] = [[] for _ in range(n)] if with_passages else []
        for lo, _, w in bw.word_slices(text, bw.ALNUM):
            s = word_scores(w, model)
            m[lo : lo + w.texts] = np.diff(w.first)
            for d in np.unique(w.doc[s > 0]):
                a, b = w.first[d], w.first[d + 1]
                segs = maximal_segments(s[a:b])
                best[lo + d] = max(x[2] for x in segs)
                edge = np.log(model.k * (b - a) / model.significance)
                hot = [x for x in segs if x[2] > max(edge, 0)]
                total[lo + d] = sum(x[2] - max(edge, 0) for x in hot)
                if with_passages:
                    base = w.start[a] if a else 0
                    passages[lo + d] = [{"start": int(w.start[a + x] - base), "end": int(w.end[a + y - 1] - base), "score": float(z)} for x, y, z in hot]
        out = {c: batch.column(c) for c in carry}
        out |= {"best": pa.array(best), "total": pa.array(total), "n_words": pa.array(m)}
        if with_passages:
            out["passages"] = pa.array(passages, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
        yield pa.RecordBatch.from_pydict(out)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _family(w: bw.Words) -> np.ndarray:
    """Per text its least hash of four consecutive words: near copies mostly share it. Of shorter texts a hash of all words."""
    out = np.full(w.texts, np.uint64(2**64 - 1))
    h, many = w.hashes(), np.diff(w.first)
    if len(h) >= 4:
        grams = bw.ngrams(h, 4)
        whole = w.doc[: len(grams)] == w.doc[3:]
        np.minimum.at(out, w.doc[: len(grams)][whole], grams[whole])
    for n in range(4):
        short = np.flatnonzero(many == n)
        key = np.full(len(short), np.uint64(n))
        for k in range(n):
            key = bw.mix(key ^ h[w.first[short] + k])
        out[short] = key
    return out


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_features: int = 50_000, min_z: float = 2.8, min_delta: float = 2.0, prior: float = 0.05) -> ToxicityModel:
    """Fit on at most `max_rows` labelled documents that are not held out (those with the smallest hashed ids).

    `max_rows` bounds the broadcast sample of labels and what the fit collects, `max_features` the model's size. The model is the same
    however rows lie in partitions.
    """
    sample = (
        labels.filter(F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    train = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, w in bw.word_slices(batch.column("text"), bw.ALNUM):
                yield pa.RecordBatch.from_arrays([pa.array(_family(w).view(np.int64)), batch.column("text").slice(lo, w.texts), batch.column("toxic").cast(pa.int32()).slice(lo, w.texts)], ["family", "text", "toxic"])

    # a toxic text of each family, if it has one
    one = bw.arrow(train, families, "family long, text string, toxic int").groupBy("family").agg(F.max(F.struct("toxic", "text")).alias("x")).select("x.*")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("toxic").to_numpy(zero_copy_only=False)
            for lo, hi, w in bw.word_slices(batch.column("text"), bw.ALNUM):
                y = label[lo:hi].astype(np.int64)
                for p, h in zip(PREFIXES, features(w), strict=True):
                    at = np.unique(bw.mix(h + w.doc.astype(np.uint64)), return_index=True)[1]  # each feature of a text once
                    key, group = np.unique(h[at], return_inverse=True)
                    toxic = np.bincount(group, weights=y[w.doc[at]], minlength=len(key)).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"p": pa.array(np.full(len(key), p, np.int32)), "key": pa.array(key.view(np.int64)), "toxic": pa.array(toxic), "clean": pa.array(np.bincount(group, minlength=len(key)) - toxic)})

    counts = bw.arrow(one, count, "p int, key long, toxic long, clean long").groupBy("p", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    whole = materialize(counts, "features")
    sums = {r["p"]: r for r in whole.groupBy("p").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).collect()}
    model = ToxicityModel()
    if not sums or min(sum(r["t"] for r in sums.values()), sum(r["c"] for r in sums.values())) == 0:
        release(whole)
        return model
    totals = F.create_map(*[F.lit(x) for p, r in sums.items() for x in (p, float(r["t"]))]), F.create_map(*[F.lit(x) for p, r in sums.items() for x in (p, float(r["c"]))])
    nt, nc = totals[0][F.col("p")], totals[1][F.col("p")]
    a = prior * (F.col("toxic") + F.col("clean"))  # of the prior's whole prior * (nt + nc)
    t, c, whole_prior = F.col("toxic") + a, F.col("clean") + a, prior * (nt + nc)
    delta = F.log(t / (nt + whole_prior - t)) - F.log(c / (nc + whole_prior - c))
    best = (
        whole.select("key", delta.alias("delta"), (F.abs(delta) / F.sqrt(1 / t + 1 / c)).alias("z"))
        .filter((F.col("z") >= min_z) & (F.abs("delta") >= min_delta)).orderBy(F.desc("z"), "key").limit(max_features).toArrow()
    )
    release(whole)
    keys = best.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model.keys, model.delta, model.weight = keys[order], best.column("delta").to_numpy()[order], best.column("z").to_numpy()[order]
    model.k = 1.0
    each = bw.arrow(train, lambda b: _scan(b, model, ["doc_id", "toxic"], False), f"doc_id {train.schema['doc_id'].dataType.simpleString()}, toxic int, best double, total double, n_words long")
    # a row for each labelled id, however many documents have it; in an order that doesn't hang on partitions
    seen = each.groupBy("doc_id").agg(F.max(F.struct("toxic", "best", "n_words")).alias("x")).select("x.*").toArrow()
    columns = [seen.column(c).to_numpy().astype(float) for c in ("toxic", "best", "n_words")]
    order = np.lexsort(columns)
    return calibrate(model, *(x[order] for x in columns))


def calibrate(model: ToxicityModel, y: np.ndarray, best: np.ndarray, m: np.ndarray) -> ToxicityModel:
    """K by the Gumbel mean over non-toxic texts, then the logistic fit (Newton steps with a small ridge)."""
    model.k = float(np.clip(np.exp(np.mean((best - np.log(np.maximum(m, 1)))[y == 0]) - EULER), 1e-6, 1.0))
    excess = np.maximum(best - np.maximum(np.log(model.k * np.maximum(m, 1) / model.significance), 0), 0)
    x = design(best, excess, m, model.k)
    coef = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -40, 40)))
        ridge = np.diag([1e-6, 1e-2, 1e-2]) * len(y) * 1e-2
        coef -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(3), x.T @ (p - y) + ridge @ coef)
    model.coef = coef
    return model


def score(documents: DataFrame, model: ToxicityModel, columns: list[str] | None = None) -> DataFrame:
    """The columns asked for (doc_id if none are named), score, predicted, n_words and the significant passages as byte ranges."""
    keep = columns or ["doc_id"]
    frame = documents.select(*dict.fromkeys([*keep, "text"]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _scan(batches, model, keep, True):
            p = model.probability(*(out.column(c).to_numpy(zero_copy_only=False) for c in ("best", "total", "n_words")))
            cols = {c: out.column(c) for c in keep} | {"score": pa.array(p), "predicted": pa.array((p >= 0.3).astype(np.int32)), "n_words": out.column("n_words"), "passages": out.column("passages")}
            yield pa.RecordBatch.from_pydict(cols)

    return bw.arrow(frame, run, f"{fields}, score double, predicted int, n_words long, passages array<struct<start:long,end:long,score:double>>")
