"""Centroids, collocations and licence notices against slow versions, and their defined cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import centroids, collocation, licenses

# ---- centroids

VECTORS = "vec_id long, embedding array<double>, cluster string, distance string"


def slow_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for turn in range(rounds + 1):
        label = [min(range(len(centres)), key=lambda c: (gap(v, centres[c]), c)) for _, v in kept]
        if turn < rounds:
            for c in range(len(centres)):
                own = [v for (_, v), x in zip(kept, label, strict=True) if x == c]
                if own:
                    centres[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    most = (1 << 63) - 1
    far = [gap(v, centres[c]) for (_, v), c in zip(kept, label, strict=True)]
    inertia = [sum(d for d, x in zip(far, label, strict=True) if x == c) for c in range(len(centres))]
    return Counter((i, c, min(d, most), min(inertia[c], most), min(sum(far), most), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), c, d in zip(kept, label, far, strict=True))


def clustered(spark, rows, parts=4, **args):
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS).repartition(parts)
    return Counter(tuple(r) for r in centroids.centroid_clusters(frame, **args).collect())


@pytest.mark.parametrize("kind", ["plain", "ties", "wide", "mixed"])
def test_clusters_equal_slow_ones(spark, kind):
    rng = random.Random(7)
    dims, n = 6, 300
    draw = {
        "plain": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.choice([-1, 0, 0, 1])) / 4, "wide": lambda: rng.gauss(0, 1) * 10.0 ** rng.choice([0, 5, 12, 30, 300, 306]),
        "mixed": lambda: rng.choice([0.0, -0.0, 5e-324, -5e-324, 1e-30, 1 / 64, -1 / 64, rng.gauss(0, 3), 3e5, -(2.0**18)]),
    }[kind]
    rows = [(i, [draw() for _ in range(dims)]) for i in range(n)]
    rows += [(1, rows[1][1]), (1, rows[2][1]), (None, [0.5] * dims), (None, [0.25] * dims), (900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [None] + [1.0] * (dims - 1))]
    rows += [(904, [float("nan")] + [1.0] * (dims - 1)), (905, [float("-inf")] + [1.0] * (dims - 1)), (906, [1.7e308] * dims), (907, [-1.7e308] * dims)] if kind == "wide" else [(904, [float("nan")] * dims)]
    want = slow_clusters(rows, 8, 3, dims, 64)
    assert clustered(spark, rows, k=8, rounds=3, dims=dims) == want
    assert clustered(spark, rows, parts=1, k=8, rounds=3, dims=dims) == want


def test_few_and_no_vectors(spark):
    assert clustered(spark, []) == Counter()
    assert clustered(spark, [(1, None)]) == Counter()
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [0.5, 1.0])]
    assert clustered(spark, rows, dims=2) == slow_clusters(rows, 16, 3, 2, 64)
    with pytest.raises(ValueError):
        clustered(spark, rows, scale=48)


def test_shortlists_hold_the_nearest_and_are_short(spark):
    rng = np.random.default_rng(3)
    exact = [[int(x) for x in rng.integers(-40, 40, 64)] for _ in range(16)]
    c = centroids.Centroids(exact)
    v = rng.normal(0, 0.2, (4000, 64))
    near = c.shortlist(v, 64)
    y = np.floor(v * 64).astype(np.int64)
    d = ((y[:, None] - np.array(exact)) ** 2).sum(axis=2)
    assert near[d == d.min(axis=1)[:, None]].all()
    assert near.sum() < 1.01 * len(v)  # the product decides nearly all
    assert (c.nearest(v, 64) == d.argmin(axis=1)).all()


def test_limbs_add_up():
    for value in (0, -1, 2**31, -(2**31) - 1, 2**700 + 5, -(2**700)):
        parts = centroids.limbs(value)
        assert sum(x << 32 * i for i, x in enumerate(parts)) == value
        assert all(0 <= x < 2**32 for x in parts[:-1]) and -(2**31) <= parts[-1] < 2**31


# ---- collocations

TEXTS = "text string, lang string, rank long, phrase string, score double, block string"


def slow_collocations(rows, least, longest, top, held=100):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    frequent = {x: a for x, a in f.items() if a >= least}
    contains = lambda q, p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = defaultdict(list)
    for (lang, p), a in frequent.items():
        if len(p) < 2 or any(x == lang and len(q) > len(p) and 100 * b >= held * a and contains(q, p) for (x, q), b in frequent.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


def mined(spark, rows, parts=3, **args):
    frame = spark.createDataFrame([(t, x, 1, "p", 2.0, "b") for t, x in rows], TEXTS).repartition(parts)
    return sorted(tuple(r) for r in collocation.collocations(frame, **args).collect())


def phrases(rng, n):
    words = ["a", "B", "c", "ünï", "Ü", "-", "d'e", "\x00", "東京"]
    return "".join(rng.choice(words) + rng.choice([" "] * 6 + ["  ", "\t", ". ", ",", "\n", " ; ", "!?", "\x0b", "\x0c"]) for _ in range(n))


@pytest.mark.parametrize("most", [0, 200_000])
@pytest.mark.parametrize("held", [100, 60])
def test_collocations_equal_slow_ones(spark, most, held):
    rng = random.Random(11)
    rows = [(phrases(rng, rng.randrange(60)), rng.choice(["en", "de", None, "und", ""])) for _ in range(120)]
    rows += [("new york city hall", "en")] * 40 + [("los angeles. angeles los", "xx")] * 5 + [(None, "en"), ("", None), (" .. ", "en"), ("x " * 3000, "en"), ("one", "zz")]
    for least, top in ((1, 50), (6, 2000), (40, 3)):
        if least == 1:
            some = rows[:12] + rows[-3:-2]
            assert mined(spark, some, least=1, longest=5, top=top, held_percent=held, most=most, block=100) == slow_collocations(some, 1, 5, top, held)
        else:
            assert mined(spark, rows, least=least, longest=5, top=top, held_percent=held, most=most, block=1000) == slow_collocations(rows, least, 5, top, held)


def test_collocations_of_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [("a b", "en")] * 3) == [] and mined(spark, [(None, None)], least=1) == []
    assert mined(spark, [("a b", None)] * 3, least=3, longest=2) == [("und", 1, "a b", 3, 3, 3, 6, 2000)]
    with pytest.raises(ValueError):
        mined(spark, [], least=0)


def test_positions_are_packed_without_loss():
    rng = np.random.default_rng(1)
    for at in (np.zeros(0, np.int64), np.array([0]), np.sort(rng.integers(0, 2**31 - 1, 500)), rng.integers(0, 2**31 - 1, 500), np.array([2**31 - 1, 0, 2**31 - 1])):
        assert (collocation.unpacked(collocation.packed(at)) == at).all()


def test_scores_past_64_bits(spark):
    row = spark.range(1).selectExpr("4000000000000000 as f", "9000000000000000000 as n", "array(5000000000000000L, 1L) as pre", "array(7000000000000000L, 1L) as suf")
    got = row.select(collocation.score_of(2).alias("x")).first()["x"]
    assert got["score"] == 1000 * 4 * 10**15 * 9 * 10**18 // (5 * 10**15 * 7 * 10**15) and got["k"] == 1


# ---- licences


def edit_distance_within(text, notice):
    """The fewest edits between the notice and any part of the text (Sellers)."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(notice, 1):
            new.append(min(row[i - 1] + (c != x), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def scan(spark, texts, **args):
    frame = spark.createDataFrame([(i, t, "x", 1, "l") for i, t in enumerate(texts)], "doc_id long, text string, labels string, score int, notices string")
    return {r["doc_id"]: r for r in licenses.scan_licenses(frame, **args).collect()}


def spoiled(rng, notice, edits):
    x = list(notice)
    for _ in range(edits):
        at, what = rng.randrange(len(x)), rng.randrange(3)
        if what == 0:
            x[at] = rng.choice("qzx")
        elif what == 1:
            x.insert(at, rng.choice("qzx"))
        else:
            del x[at]
    return "".join(x)


def test_fuzzy_notices_equal_dynamic_programming(spark):
    rng = random.Random(2)
    texts, want = [], []
    scanner = licenses.Scanner()
    for _ in range(150):
        i = rng.randrange(len(licenses.NOTICES))
        notice = licenses.NOTICES[i][1]
        text = " ".join(rng.choice(["foo", "bar", "license", "under", "the"]) for _ in range(rng.randrange(8)))
        text += " " + spoiled(rng, notice, rng.randrange(scanner.edits[i] + 3)) + " " + "end of it"
        texts.append(text.upper() if rng.random() < 0.3 else text)
        plain = " ".join(re.findall(r"[a-z0-9]+", text))
        want.append({k: d for k, (_, x) in enumerate(licenses.NOTICES) if (d := edit_distance_within(plain, x)) <= scanner.edits[k]})
    for text, found in zip(texts, want, strict=True):
        plain = " ".join(re.findall(r"[a-z0-9]+", text.lower()))
        got: dict = {}
        for i, a, b, e in scanner.places(plain):
            got[i] = min(e, got.get(i, 99))
            assert edit_distance_within(plain[a:b], licenses.NOTICES[i][1]) <= e
        assert got == found, text
    rows = scan(spark, texts)
    for i, found in enumerate(want):
        if found and not rows[i]["n_base"]:
            best = max(1 - d / (scanner.edits[k] + 1) for k, d in found.items())
            assert rows[i]["score"] == pytest.approx(best) and rows[i]["labels"]
        if not found and not rows[i]["n_base"]:
            assert rows[i]["labels"] == "" and rows[i]["score"] == 0 and rows[i]["notices"] == []


def slow_base(text):
    words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())
    at = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_base_phrases_and_defined_cases(spark):
    rng = random.Random(4)
    parts = ["mit", "MIT", "license", "License", "licenses", "apache", "general", "public", "licensé", "x", "ünï", "mitlicense"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "\n", ", ", "-", "_", "\x00"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += [None, "", "...", "mit", "license", "mit license", "mit license", "MIT-License\x00apache_license general PUBLIC license", "mit license " * 40_000]
    rows = scan(spark, texts)
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == slow_base(t)
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert scan(spark, []) == {}


def test_spans_and_overlaps(spark):
    text = "Ünï. Licensed under:  CC-BY-NC 4.0! Then: Licenced under the Apache License (Version 2.0)."
    r = scan(spark, [text, "licensed under cc by", "nc 4 0"])
    first, second = r[0]["notices"]
    raw = text.encode()
    assert raw[first["start"] : first["end"]].decode() == "Licensed under:  CC-BY-NC 4.0" and (first["label"], first["edits"]) == ("cc-by-nc", 0)
    assert raw[second["start"] : second["end"]].decode() == "Licenced under the Apache License (Version 2.0" and (second["label"], second["edits"]) == ("apache", 1)
    assert (first["first_word"], first["last_word"]) == (1, 7) and r[0]["labels"] == "apache,cc-by-nc"
    assert r[1]["labels"] == r[2]["labels"] == ""  # texts are apart
    with pytest.raises(ValueError):
        licenses.scan_licenses(spark.createDataFrame([(1, "x")], "doc_id long, text string"), notices=(("a", "Not Plain"),))
