"""Brute force, round trips and defined cases of the training-data operators."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import counting, decontam, langid, lm, neardup, packing, search, sharding, toxicity, warc, wordbpe
from tessera.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, spans string"
EDGE = [None, "", " \n", "one", "one two", "repeated words here and there again", "repeated words here and there again", "x " * 30_000, "ünïcode ßtraße 东京 ' it's <|endoftext|> 12.5", "!!! ... ???"]


def frame(spark, texts, first=0):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(first + i, t, "en", "s", 0, 1.0, 7, "x") for i, t in enumerate(texts)], DOCS)


def words_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_bpe_equals_the_library_on_random_strings(library):
    rng = random.Random(5)
    parts = ["'s", "'", "re", "ll", " ", "\n", "a", "é", "é", "1", "½", "!", "İ", "Σ", "the", "東", "<|endoftext|>", "\U0001f600", "՘"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["a" * 5000, "", None]
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    bpe = wordbpe.WordBpe(tokenizer_path())
    assert [x.tolist() for x in bpe.encode_batch(texts)] == want
    assert bpe.count_batch(texts).tolist() == [len(x) for x in want]


def test_token_counts_of_edge_texts(spark, library):
    got = {r["doc_id"]: r for r in counting.token_counts(frame(spark, EDGE), tokenizer_path()).collect()}
    for i, t in enumerate(EDGE):
        assert got[i]["n_tokens"] == len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (got[i]["n_tokens"] > 2048)
    assert counting.token_counts(frame(spark, []), tokenizer_path()).count() == 0


def test_packing_is_a_round_trip(spark, library):
    rows = packing.best_fit_pack(frame(spark, EDGE), tokenizer_path(), 2048).toPandas()
    for i, t in enumerate(EDGE):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and own.piece.tolist() == list(range(len(own)))
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    assert packing.best_fit_pack(frame(spark, []), tokenizer_path()).count() == 0


def test_bin_completion_is_valid_and_no_worse_than_best_fit():
    rng = random.Random(3)
    for _ in range(150):
        counts = {rng.randint(1, 100): rng.randint(1, 20) for _ in range(rng.randint(1, 25))}
        plan, first = packing.bin_completion(counts, 100), packing.best_fit_decreasing(counts, 100)
        got: dict = {}
        for run in plan.runs:
            assert sum(k * u for k, u in run.fill) <= 100
            for k, u in run.fill:
                got[k] = got.get(k, 0) + u * run.times
        assert got == counts and plan.sequences <= first.sequences
    # best fit decreasing needs three here, a completion of the largest piece finds two
    assert packing.bin_completion({44: 1, 24: 2, 22: 2, 32: 2}, 100).sequences == 2


def test_bin_completion_against_the_optimum():
    rng = random.Random(23)

    def optimum(pieces, capacity):
        best = len(pieces)

        def go(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(pieces):
                best = len(rooms)
                return
            for room in sorted({r for r in rooms if r >= pieces[i]}):
                at = rooms.index(room)
                go(i + 1, [*rooms[:at], room - pieces[i], *rooms[at + 1 :]])
            go(i + 1, [*rooms, capacity - pieces[i]])

        go(0, [])
        return best

    gaps = []
    for _ in range(150):
        pieces = sorted((rng.randint(8, 60) for _ in range(rng.randint(1, 11))), reverse=True)
        counts: dict = {}
        for x in pieces:
            counts[x] = counts.get(x, 0) + 1
        want = optimum(pieces, 100)
        assert packing.bin_completion(counts, 100, branch=10_000).sequences == want
        gaps.append(packing.bin_completion(counts, 100).sequences - want)
    assert sum(gaps) == 0


def test_packing_in_many_buckets(spark):
    rng = random.Random(24)
    docs = frame(spark, [words_text(rng, rng.choice((3, 3, 3, 40))) for _ in range(300)])
    rows = packing.best_fit_pack(docs, tokenizer_path(), 128, per_bucket=7).toPandas()
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 128 and g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    assert rows.sequence_id.nunique() == -(-rows.length.sum() // 128)


def test_bin_completion_dives_through_a_large_corpus():
    x = np.maximum(1, np.random.default_rng(2).lognormal(5.6, 1.2, 10**6).astype(int)) + 1
    length, n = np.unique(np.where(x > 2048, (x - 1) % 2048 + 1, x), return_counts=True)
    counts = dict(zip(length.tolist(), n.tolist(), strict=True))
    bound = -(-int((length * n).sum()) // 2048)
    assert packing.best_fit_decreasing(counts, 2048).sequences > bound
    plan = packing.bin_completion(counts, 2048)
    got: dict = {}
    for run in plan.runs:
        assert sum(k * u for k, u in run.fill) <= 2048
        for k, u in run.fill:
            got[k] = got.get(k, 0) + u * run.times
    assert got == counts and plan.sequences == bound


def test_maximal_segments_equal_the_recursive_definition():
    def slow(s, lo=0):
        best = max(((sum(s[a:b]), -(b - a), a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0,))
        if best[0] <= 0:
            return []
        _, _, a, b = best
        return slow(s[:a], lo) + [(lo + a, lo + b)] + slow(s[b:], lo + b)

    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.normal(-0.2, 1, rng.integers(0, 14)).round(6)
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == slow(s.tolist())


def test_learned_log_odds_equal_a_slow_version(spark):
    rng = random.Random(33)
    vocabulary = [f"{a}{b}{c}" for a in ("bad", "Vile", "ko", "Ma", "tu", "re", "wen", "zi", "ol") for b in ("lin", "par", "so", "mu") for c in ("", "x", "tione", "a", "rk")]
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        texts.append(" ".join(rng.choice(vocabulary[:40] if toxic and rng.random() < 0.3 else vocabulary[40:]) for _ in range(rng.randrange(4, 30))))
        labels.append((i, int(toxic)))
    texts += [texts[0] + " more", texts[0]]  # near and exact copies count once with it
    labels += [(400, 0), (401, 1)]
    model = toxicity.learn(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"))

    import pyarrow as pa

    families: dict = {}
    (_, _, w), = toxicity.bw.word_slices(pa.array(texts), toxicity.bw.ALNUM)
    for i, f in enumerate(toxicity._family(w).tolist()):
        if zlib.crc32(str(i).encode()) % 4 != 2:
            families[f] = max(families.get(f, (0, "")), (labels[i][1], texts[i]))
    counts: dict = {}
    for toxic, text in families.values():
        found = set()
        for word in text.lower().split():
            for p in toxicity.PREFIXES:
                n = min(len(word), p) if p else len(word)
                found.add((p, n, word[:n]))
        for f in found:
            counts.setdefault(f, [0, 0])[1 - toxic] += 1
    total = {p: [sum(c[k] for f, c in counts.items() if f[0] == p) for k in (0, 1)] for p in toxicity.PREFIXES}
    want = []
    for (p, _, _), (t, c) in counts.items():
        a = 0.05 * (t + c)
        t, c, prior = t + a, c + a, 0.05 * sum(total[p])
        delta = math.log(t / (total[p][0] + prior - t)) - math.log(c / (total[p][1] + prior - c))
        z = abs(delta) / math.sqrt(1 / t + 1 / c)
        if z >= 2.8 and abs(delta) >= 2.0:
            want.append((round(delta, 9), round(z, 9)))
    got = [(round(d, 9), round(z, 9)) for d, z in zip(model.delta.tolist(), model.weight.tolist(), strict=True)]
    assert len(want) > 5 and sorted(got) == sorted(want)


def test_toxicity_finds_planted_passages(spark):
    rng = random.Random(2)
    bad = ["idiotish", "scumlike", "vilestuff"]
    texts, labels = [], []
    for i in range(600):
        t = words_text(rng, rng.randrange(20, 120)).split()
        toxic = i % 5 == 0
        if toxic:
            t[5:5] = [rng.choice(bad) for _ in range(3)]
        texts.append(" ".join(t))
        labels.append((i, 1 if toxic else 0))
    docs = frame(spark, texts)
    model = toxicity.learn(docs, spark.createDataFrame([*labels, (3, None)], "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert sum(r["predicted"] != labels[r["doc_id"]][1] for r in got) <= 3
    hit = next(r for r in got if r["doc_id"] == 5)
    assert any(b in texts[5].encode()[p["start"] : p["end"]].decode() for p in hit["passages"] for b in bad)
    edge = toxicity.score(frame(spark, EDGE), model).collect()
    assert len(edge) == len(EDGE) and all(0 <= r["score"] < 0.3 for r in edge)
    nothing = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, nothing).agg(F.max("score")).first()[0] < 1e-9


def test_language_sizes_are_those_of_plain_zstandard():
    import zstandard

    rng = random.Random(17)
    blocks = {g: [" ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(400)).encode() for _ in range(3)] for g, s in (("aa", ["tha", "ing"]), ("bb", ["que", "ment"]), ("cc", ["sch", "ung"]))}
    c = langid.Compressors(blocks)
    for text in ["Thaing tha! ingingtha", "que", "ungsch " * 900, "x1y2 Quement, ment"]:
        raw = langid.plain(text)
        options = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=False, write_checksum=False, write_dict_id=False)

        def packed(data, dictionary, options=options):
            return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=options).compress(data))

        size = [packed(raw, blocks[g][0]) for g in sorted(blocks)]
        if sorted(size)[1] - sorted(size)[0] <= langid.NARROW:
            size = [s + sum(packed(d[k : k + 1500] + raw, d) - packed(d[k : k + 1500], d) for d in blocks[g] for k in (0, 8000, 16000)) for s, g in zip(size, sorted(blocks), strict=True)]
        got, n = c.sizes(text)
        assert got.tolist() == size and n == len(raw)
        assert c.classify(text)[0] == sorted(blocks)[int(np.argmin(size))]


def test_dictionaries_come_from_whole_texts_and_distinct_pieces(spark):
    rng = random.Random(18)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    texts = ["first " * 80 + text(900)] + ["copied text " * 40] * 300 + [text(60) for _ in range(40)]
    docs = frame(spark, texts, 4)  # the first is not held out
    got = langid.learn(docs, piece=400, blocks=(4000, 2000))["en"]
    assert [len(x) for x in got] == [4000, 2000] and b"".join(got).count(b"copied text") <= 40
    everything = langid.learn(docs, piece=400, blocks=(400_000,))["en"][0]
    assert everything.count(b"first ") >= 78 and sum(w.encode() in everything for w in texts[0].split()[700:]) > 200
    assert langid.learn(docs.filter("false")) == {}
    many = spark.range(4000).selectExpr("id as doc_id", "'some text in it' as text", "'l' || (id div 4) as lang")
    assert len(langid.learn(many, blocks=(400,))) > 900  # every language that has a row which isn't held out


def test_margins_do_not_shrink_with_length(spark):
    rng = random.Random(19)
    text = lambda s, n: " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(n))
    syllables = {"aa": ["tha", "ing", "ere", "ou", "wh", "st"], "bb": ["que", "ment", "eau", "ier", "le", "de"]}
    c = langid.Compressors({g: [text(s, 9000).encode() for _ in range(3)] for g, s in syllables.items()})
    assert all(c.classify(text(syllables["aa"], n))[1] > 0.6 for n in (50, 500, 5000, 200_000))


def test_language_by_compression(spark):
    rng = random.Random(4)
    syllables = {"aa": ["tha", "ing", "ere", "ou"], "bb": ["que", "ment", "eau", "ier"]}
    texts = {}
    for i in range(400):
        lang = "aa" if i % 2 else "bb"
        texts[i] = (" ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 60))), lang)
    docs = spark.createDataFrame([(i, t, g, "s") for i, (t, g) in texts.items()], "doc_id long, text string, lang string, score string")
    got = langid.identify(docs, langid.learn(docs)).collect()
    assert sum(r["lang_pred"] != texts[r["doc_id"]][1] for r in got) <= 4
    edge = {r["doc_id"]: r for r in langid.identify(frame(spark, EDGE), langid.learn(docs)).collect()}
    assert [edge[i]["lang_pred"] == "und" for i in range(len(EDGE))] == [t is None or not re.search(r"[^\W\d_]", t) for t in EDGE]
    assert langid.identify(docs, {}).filter("lang_pred <> 'und'").isEmpty()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_contamination_equals_brute_force(spark):
    rng = random.Random(6)
    items = [(1, words_text(rng, 30, 50)), (2, words_text(rng, 13, 50)), (3, "short one"), (4, None), (5, "..."), (10, words_text(rng, 14, 50)), (6, "repeated repeated")]
    texts = [*EDGE, "a short one here", "Short ONE", "repeated repeated repeated"] + [words_text(rng, 20, 50) + " " + rng.choice(items[:2])[1].upper()[: rng.randrange(20, 90)] + ", " + words_text(rng, 9, 50) for _ in range(40)] + [items[0][1] + "! " + items[5][1]]
    windows: dict = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 60):
        for r in decontam.contamination(docs, bench, None, block).collect():
            w = WORD.findall(lower(texts[r["doc_id"]]))
            hit, ids = set(), set()
            for p, owners in windows.items():
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k : k + len(p)]) == p:
                        hit |= set(range(k, k + len(p)))
                        ids |= owners
            want = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want
    cut = decontam.remove_spans(decontam.contamination(docs, bench, ["doc_id", "text"]).select("doc_id", "text", "spans"))
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    several = decontam.contamination(docs, bench, ["doc_id", "text"], 60, 2)  # several passes of several blocks
    assert {r["doc_id"]: r["text"] for r in decontam.remove_spans(several.select("doc_id", "text", "spans")).collect()} == left
    assert left[10] == "a  here" and left[0] is None
    assert decontam.contamination(docs, bench.filter("false")).filter("n_hit > 0").isEmpty()


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    texts = list(EDGE)
    for _ in range(12):
        base = words_text(rng, rng.randrange(30, 200), 5000).split()
        for _ in range(rng.randrange(1, 14)):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    for leaf, few in ((2000, 500), (2, 1)):  # the second makes nodes branch, and end in blocks
        for r in neardup.near_duplicates(frame(spark, texts), n=4, leaf=leaf, few=few, depth=3, block=5).collect():
            assert r["component_id"] == find(r["doc_id"]) and r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["component_id"] == r["doc_id"])
    names = frame(spark, texts).withColumn("doc_id", F.format_string("%03d", "doc_id"))
    for r in neardup.near_duplicates(names, n=4).collect():
        assert int(r["component_id"]) == find(int(r["doc_id"]))
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_without_or_with_repeated_ids(spark):
    base = words_text(random.Random(3), 60, 5000)
    rows = [(None, base), (None, "alone in the world today"), (4, base), (4, "another text of the same id"), (4, base), (9, base + " more"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, n=4).collect()), key=str)
    assert got == sorted([(0, 57, 4, False), (0, 2, None, True), (4, 57, 4, True), (4, 3, 4, True), (4, 57, 4, True), (9, 58, 4, False), (0, 0, None, True)], key=str)


def test_rows_without_an_id_carry_links(spark):
    words = [f"c{i}" for i in range(115)]
    chain = [" ".join(words[k : k + 100]) for k in (0, 5, 10, 15)]  # 92 of 102 shingles shared by neighbours, 82 of 112 by the next but one
    rows = [(1, chain[0]), (None, chain[1]), (None, chain[1]), (2, chain[2]), (None, "x y z w v"), (None, "x y z w v"), (3, "a b c d e"), (None, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for n in (1, 2000):
        got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in neardup.near_duplicates(docs, n=4, leaf=n, few=n, block=2 if n == 1 else 1000).collect())
        assert got == sorted([("1", "1", True), ("2", "1", False), ("3", "3", True), *[("None", "1", False)] * 2, *[("None", "None", True)] * 2, ("None", "3", False)])
    alone = spark.createDataFrame([(None, t) for t in chain], "doc_id string, text string")
    assert [(r["component_id"], r["kept"]) for r in neardup.near_duplicates(alone, n=4).collect()] == [(None, True)] * 4


def test_links_of_a_node_span_its_components(spark):
    """A group whose members are alike only along a chain needs every link that is there."""
    rng = random.Random(5)
    words = [f"c{i}" for i in range(130)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, 30, 3)]
    texts += [" ".join(rng.sample(words, 100)) for _ in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, texts), n=4, trees=20, block=3).collect()}
    assert all(got[i] == 0 for i in range(10)) and all(got[i] == i for i in range(10, 30))


def test_shards_are_even_and_keep_equal_texts_together(spark):
    rng = random.Random(9)
    texts = list(EDGE) + [words_text(rng, 40) for _ in range(400)]
    texts += [words_text(rng, 30)] * 5 + ["hot " * 40] * 200
    got = sharding.shard_documents(frame(spark, texts), 8).toPandas()
    assert len(got) == len(texts) and set(got.law) == {"bytes"}
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    for r in got.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert got[got.doc_id.isin(range(410, 415))].shard.nunique() == 1
    load = got.groupby("shard")["size"].sum().sort_values()
    assert len(load) == 8 and got[got["size"] > 50_000].shard.iloc[0] == load.index[-1] and load.iloc[-2] / load.iloc[0] < 1.5
    assert sharding.shard_documents(frame(spark, []), 8).count() == 0


def test_propagation_equals_a_slow_version(spark):
    import xxhash

    def slow(size, shard, links, shards, capacity, rounds):
        shard = dict(shard)
        for _ in range(rounds):
            weight: dict = {}
            for i, h in links:
                weight[h, shard[i]] = weight.get((h, shard[i]), 0) + size[i]
            asked: dict = {}
            for i in size:
                pull: dict = {}
                for j, h in links:
                    if j == i:
                        for (other, s), w in weight.items():
                            if other == h:
                                pull[s] = pull.get(s, 0) + w
                if not pull:
                    continue
                to = min(pull, key=lambda s: (-pull[s], s))
                gain = pull[to] - pull.get(shard[i], 0)
                if to != shard[i] and (gain > 0 or (gain == 0 and to < shard[i])):
                    part = xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42)
                    part -= (part >> 63) << 64
                    asked.setdefault(to, {}).setdefault((62 - (max(gain, 1).bit_length() - 1)) * 16 + part % 16, []).append(i)
            loads = {s: sum(size[i] for i in size if shard[i] == s) for s in range(shards)}
            moved = False
            for to in sorted(asked):
                room = capacity - loads[to]
                for step in sorted(asked[to]):
                    need = sum(size[i] for i in asked[to][step])
                    if need <= room:
                        room, moved = room - need, True
                        for i in asked[to][step]:
                            shard[i] = to
            if not moved:
                break
        return shard

    rng = random.Random(31)
    for shards, capacity in ((3, 40), (4, 1000)):
        size = {i: rng.randint(1, 9) for i in range(40)}
        shard = {i: rng.randrange(shards) for i in size}
        links = sorted({(i, rng.randrange(12)) for i in size for _ in range(rng.randrange(3))})
        nodes = spark.createDataFrame([(i, size[i], shard[i]) for i in size], "id long, size long, shard int")
        got = sharding.propagate(nodes, spark.createDataFrame(links, "id long, hub int"), shards, float(capacity), 4)
        assert {r["id"]: r["shard"] for r in got.collect()} == slow(size, shard, links, shards, capacity, 4)


def test_shards_beside_an_outweighing_text_are_filled_to_one_level(spark):
    rng = random.Random(9)
    texts = ["x " * 30_000] + [words_text(rng, 40) for _ in range(400)] + ["hot " * 40] * 200
    load = sharding.shard_documents(frame(spark, texts), 8).groupBy("shard").agg(F.sum("size").alias("n")).toPandas().n.sort_values()
    assert len(load) == 8 and load.iloc[-1] > 60_000 and load.iloc[-2] / load.iloc[0] < 1.1


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(10)
    rows = [(i, rng.normal(0, 0.3, 8).round(1).tolist()) for i in range(300)]
    rows += [(300, None), (301, [float("nan")] * 8), (302, [0.1] * 7 + [None]), (303, []), (304, [float("inf")] * 8), (305, [0.5] * 3), (350, rows[7][1]), (400, rows[7][1])]
    rows += [(310, [3e5, 1.0] + [0.0] * 6), (311, [1e12] + [-1e12] * 7), (312, [-1e30, 1e-3] + [0.0] * 6), (313, [1.7e308] * 8), (450, [0.0, -1e12] + [0.0] * 6), (500, [2.0, 1e200] + [0.5] * 6), (7, rows[8][1])]
    v = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<double>, score string")
    good = [(i, [math.floor(256 * Fraction(x)) for x in e]) for i, e in rows if e and None not in e and np.isfinite(e).all()]
    want = set()
    for q, e in good:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(e, x, strict=True)), i) for i, x in good if i != q and len(e) == len(x))[:5]
            want |= {(q, k, i, max(-(2**63), min(2**63 - 1, -x))) for k, (x, i) in enumerate(s, 1)}
    for block, pivots in ((16_384, 512), (40, 20), (7, 3)):
        got = {tuple(r) for r in search.top_k(v, v.filter("vec_id % 50 = 0"), 5, block=block, chunk=4, most_pivots=pivots).collect()}
        assert got == want
    assert search.top_k(v.filter("false"), v, 5).count() == 0 and search.top_k(v, v.filter("false"), 5).count() == 0
    twice = spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [2.0, 3.0]), (1, [2.0, 3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in search.top_k(twice, twice.filter("vec_id = 50"), 5).orderBy("rank").collect()] == [(50, 1, 1, 196608), (50, 2, 1, 196608)]


def test_pairs_of_clusters_are_left_out_before_vectors_move(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 6, (12, 6))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.2, 6)).tolist()) for i in range(1200)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen: dict = {}
    got = {tuple(r) for r in search.top_k(v, v.filter("vec_id % 50 = 0"), 5, block=100, most_pivots=48, seen=seen).collect()}
    x = np.floor(256 * np.array([e for _, e in rows])).astype(np.int64)
    full = x @ x.T
    for q in range(0, 1200, 50):
        s = sorted((-int(full[q, i]), i) for i in range(1200) if i != q)[:5]
        assert {(q, k, i, -z) for k, (z, i) in enumerate(s, 1)} <= got
    assert len(got) == 24 * 5 and seen["left"] < seen["pairs"] / 2


def test_trees_prune_clustered_vectors():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 1, (400, 4)) for c in rng.uniform(-900, 900, (6, 4))]).round()
    score, ids, seen = search.dual_tree(x[:50], np.arange(50), x, np.arange(len(x)), 5)
    full = (x[:50] @ x.T).astype(np.int64)
    full[np.arange(50), np.arange(50)] = -(1 << 62)
    assert (score == -np.sort(-full, axis=1)[:, :5]).all() and seen["pruned"] > 0


def test_order_keys_are_ordered_like_scores():
    rng = random.Random(3)
    some = [0, 1, -1, 255, -255, 256, -256] + [rng.choice((1, -1)) * rng.getrandbits(rng.randrange(1, 300)) for _ in range(300)]
    assert sorted(some) == sorted(some, key=search.order_key)


PAGES = "page_id long, url string, html string, length int"


@pytest.mark.parametrize("broadcast", [250_000, 0])
def test_archives_are_a_round_trip(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", broadcast)
    long = "<p>é" + "a" * 1200
    pages = [(1, "http://A.example.com/x", long), (2, "http://b.org/\r\nz", long), (3, None, "short"), (4, "http://b.org", "short"), (5, "http://a.example.com/x", None), (6, "http://b.org", "tail\r\n\r\nWARC/1.1\r\n\r\n"), (7, "u", long), (7, "u", long), (None, "n", "q"), (None, "n", long)]
    df = spark.createDataFrame([(*p, 1) for p in pages], PAGES)
    got = warc.archive(df, path=str(tmp_path / "w")).collect()
    assert len(got) == len(pages)
    html = {(p[0], warc.url_key((p[1] or "").replace("\r", "%0A").replace("\n", "%0A"))): (p[2] or "").encode() for p in pages}
    for r in got:
        raw = html[r["page_id"], r["url_key"]] if r["page_id"] is not None else {1: b"q"}.get(r["payload_bytes"], long.encode())
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 7) if r["page_id"] in (1, 2) else ("response", None))
    got.sort(key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(len(got)))
    order = [(r["url_key"], r["captured"]) for r in got]
    assert order == sorted(order)
    assert warc.archive(df.filter("false")).count() == 0


def test_archives_take_page_ids_and_zones_of_any_kind(spark, tmp_path):
    ids = [2**62, -(2**62), 2**63 - 1, 0, 86_399]
    df = spark.createDataFrame([(i, f"http://h{k}.org/?q={k}", "x", 1) for k, i in enumerate(ids)], PAGES)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        got = {r["page_id"]: r for r in warc.archive(df, path=str(tmp_path / "w")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert set(got) == set(ids) and got[0]["captured"] == "2020-01-01T00:00:00Z" and got[86_399]["captured"] == "2020-01-01T23:59:59Z"
    assert all(re.fullmatch(r"20[2-8]\d-\d\d-\d\dT\d\d:\d\d:\d\dZ", r["captured"]) for r in got.values())
    assert got[0]["url_key"] == "org,h3)/?q=3"


def test_archives_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SIZE_CLASSES", ((2000, 4), (20_000, 2), (None, 1)))
    sizes = [10] * 9 + [8000] * 5 + [50_000] * 2
    df = spark.createDataFrame([(i, "http://h.org", chr(97 + i) * n, 1) for i, n in enumerate(sizes)], PAGES).coalesce(1)
    got = warc.archive(df, path=str(tmp_path / "w")).collect()
    files = {}
    for r in got:
        files.setdefault(r["file"], []).append(r["payload_bytes"])
    assert sorted(len(x) for x in files.values()) == [1, 1, 1, 1, 2, 2, 4, 4] and sorted(x for f in files.values() for x in f) == sorted(sizes)
    assert max((tmp_path / "w" / f).stat().st_size for f, x in files.items() if len(x) > 1) < 40_000


def test_archives_of_large_payloads_and_many_runs(spark, tmp_path):
    big = [(i, f"http://h{i % 7}.org/{i}", chr(97 + i) * 3_000_000, 1) for i in range(9)]
    small = [(100 + i, f"http://h{i % 50}.org/{i * 7919 % 2000}", f"page {i}", 1) for i in range(2000)]
    df = spark.createDataFrame(big, PAGES).coalesce(1).unionByName(spark.createDataFrame(small, PAGES).coalesce(3))
    got = sorted(warc.archive(df, path=str(tmp_path / "w"), run_length=1).collect(), key=lambda r: r["position"])  # a file, and more, is a run
    assert [r["position"] for r in got] == list(range(2009)) and sum(r["payload_bytes"] for r in got) == 27_000_000 + sum(len(p[2]) for p in small)
    assert [r["page_id"] for r in got] == [r["page_id"] for r in sorted(got, key=lambda r: (r["url_key"], r["captured"], r["page_id"]))]
    files = {r["file"] for r in got if r["payload_bytes"] > 10**6}
    assert len(files) == 1  # 16 records of up to 4 MB share a file
    plan = lambda n: len(warc.merge_runs(warc.read_runs(spark, str(tmp_path / "w")), n)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(plan(20) - plan(2000)) < 200  # whatever the number of ranges
    runs = [[{"url_key": f"{k % 40:03d}", "captured": f"{k}", "page_id": k, "payload_digest": "", "record_type": "", "run": str(k)}] for k in range(2000)]
    merged = list(warc.LoserTree(warc.natural_runs(r for x in runs for r in x), warc._order))
    assert [r["page_id"] for r in merged] == [r["page_id"] for r in sorted((x[0] for x in runs), key=warc._order)]


def test_natural_runs_are_never_sorted_again():
    rows = [{"url_key": k, "captured": "", "page_id": 1, "payload_digest": "", "record_type": "", "run": f} for f, k in zip("aabaabb", "bdcaeab", strict=True)]
    assert [[r["url_key"] for r in x] for x in warc.natural_runs(iter(rows))] == [["b", "d"], ["c"], ["a", "e"], ["a", "b"]]


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_pseudo_likelihood_learns_both_sides(spark):
    rng = random.Random(11)
    cycle = [f"t{i}" for i in range(12)]
    texts = [" ".join(cycle[(s + k) % 12] for k in range(60)) for s in (rng.randrange(12) for _ in range(200))]
    docs = frame(spark, texts)
    model = lm.train(docs, batch=64)
    good = lm.score(docs, model).agg(F.avg("mean_pll")).first()[0]
    shuffled = [" ".join(rng.sample(t.split(), 60)) for t in texts]
    bad = lm.score(frame(spark, shuffled), model).agg(F.avg("mean_pll")).first()[0]
    assert good > bad + 0.5 and good > -2.5
    edge = {r["doc_id"]: r for r in lm.score(frame(spark, EDGE), model).collect()}
    assert edge[0]["n_tokens"] == 0 and edge[0]["pll"] == 0.0 and edge[0]["mean_pll"] is None and edge[7]["n_tokens"] == 30_000
    empty = docs.filter("false")
    assert lm.score(empty, lm.train(empty)).count() == lm.train_and_score(empty).count() == 0


def test_every_place_is_trained_on_with_the_parameters_of_the_query(spark):
    def texts(step):  # of four words, the first of which tells nothing
        k = F.col("doc_id") % 12
        return F.concat_ws(" ", F.lit("s"), *[F.concat(F.lit("t"), ((k + i * step) % 12).cast("string")) for i in range(3)], (F.col("doc_id") % 997).cast("string"))

    docs = spark.range(60_000).toDF("doc_id").coalesce(1)
    model = lm.train(docs.withColumn("text", texts(1)))
    good, bad = (lm.score(docs.limit(1200).withColumn("text", texts(step)), model).agg(F.avg("mean_pll")).first()[0] for step in (1, 5))
    assert good > bad + 0.3


def test_scores_hardly_depend_on_partitions(spark):
    rng = random.Random(21)
    texts = [words_text(rng, rng.randrange(20, 60), 3000 if k % 2 else 60) for k in range(400)]
    docs = frame(spark, texts)
    x, y = (np.array([r["mean_pll"] for r in lm.train_and_score(docs.repartition(n, "doc_id")).orderBy("doc_id").collect()]) for n in (1, 7))
    assert np.corrcoef(x, y)[0, 1] > 0.95


def nats(documents, held, partitions):
    """Mean log-probability of an id of held-out texts by frequencies, by a bigram model of the ids and by the network; spelling left out."""
    names, counts, spelling = lm.vocabulary(documents)
    encoded = lm.encode(documents, names, spelling).repartition(partitions, "doc_id").cache()
    unseen = lm.encode(held, names, spelling).withColumn("spelled", F.lit(0.0)).cache()
    ids = lambda frame: [np.frombuffer(r["ids"], "<i2") for r in frame.filter("length(ids) > 0").collect()]
    before, after = (np.concatenate([x[a:b] for x in ids(encoded)]).astype(int) for a, b in ((None, -1), (1, None)))
    pairs = np.zeros((lm.VOCABULARY, lm.VOCABULARY), np.float32)
    np.add.at(pairs, (before, after), 1)
    share = (counts + 1) / (counts + 1).sum()
    logs = []
    for x in ids(unseen):
        p = share[x].copy()
        p[1:] = (pairs[x[:-1], x[1:]] + 50 * p[1:]) / (pairs[x[:-1]].sum(axis=1) + 50)
        logs.append(np.log(p))
    by = lambda w: lm.score_encoded(unseen, w).agg(F.sum("pll") / F.sum("n_tokens")).first()[0]
    return by(lm.start_weights(counts)), float(np.concatenate(logs).mean()), by(lm.fit(encoded, counts))


@pytest.mark.parametrize(("sf", "partitions"), [("sf0.01", 4), ("sf0.1", 4)])
def test_network_predicts_unseen_texts(spark, sf, partitions):
    """Better than frequencies from 2.5 MB on; than bigrams it needs more to learn from."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    unseen = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    frequencies, bigrams, network = nats(docs.filter(~unseen), docs.filter(unseen), partitions)
    assert network > frequencies + (0.3 if sf == "sf0.01" else 0.6)
    assert sf == "sf0.01" or network > bigrams + 0.1


def test_rare_words_are_scored_by_their_spelling(spark):
    rng = random.Random(14)
    known = [f"w{i}" for i in range(3800)]
    texts = [" ".join(rng.choice(known) if rng.random() < 0.8 else "".join(rng.choice(["tha", "ing", "ere", "ous"]) for _ in range(8)) for _ in range(100)) for _ in range(600)]
    model = lm.train(frame(spark, texts).coalesce(1))
    assert len(model[1].word) + lm.NAMED == lm.VOCABULARY
    good, bad = (" ".join(x for _ in range(50)) for x in ("thaingereousthaingerething", "tqxzjkvqxzjwqzxqjkvqxzjqz"))
    score = {r["doc_id"]: r for r in lm.score(frame(spark, [good, bad, "ünï " * 3]), model).collect()}
    assert score[0]["n_tokens"] == score[1]["n_tokens"] == 50 and score[0]["pll"] > score[1]["pll"] + 50 and score[2]["n_tokens"] == 3


def test_spelling_is_a_distribution_and_ids_are_first_bytes(spark):
    texts = ["alpha beta gamma", "beta naïve 12345678", None, "", "a"]
    _, counts, spelling = lm.vocabulary(frame(spark, texts))
    import pyarrow as pa

    (_, _, w), = lm.bw.word_slices(pa.array(texts), lm.bw.ALNUM)
    none = np.zeros(0, np.int64)
    ids, h = lm.token_ids(w, lm.Names(none.astype(np.uint64), none))
    assert [chr(i - 1) for i in ids] == ["a", "b", "g", "b", "n", "1", "a"] and len(h) == 7 and counts.sum() == 7

    def probability(before, b):
        p2 = spelling.bigram[before[1] << 8 | b]
        at = np.flatnonzero(spelling.keys == (before[0] << 16 | before[1] << 8 | b))
        return ((spelling.count[at[0]] if len(at) else 0) + lm.SYMBOLS * p2) / (spelling.context[before[0] << 8 | before[1]] + lm.SYMBOLS)

    letters = [b for b in range(256) if lm.bw.LOWER[b] == b and lm.bw.ALNUM[b]] + [0]
    assert len(letters) == lm.SYMBOLS
    for before in ((0, 97), (97, 108), (200, 201)):
        assert abs(sum(probability(before, b) for b in letters) - 1) < 1e-9
    slow = []
    for i in range(7):
        raw = [*w.data[w.start[i] : w.end[i]].tolist(), 0]
        slow.append(sum(np.log(probability((raw[k - 2] if k > 1 else 0, raw[k - 1]), raw[k])) for k in range(1, len(raw))))
    assert np.allclose(spelling.log_probability(w, np.arange(7)), slow)


def test_likelihood_and_gradient_of_the_window_network():
    rng = np.random.default_rng(2)
    w = {k: (v * 4).astype(np.float64) for k, v in lm.start_weights(np.ones(lm.VOCABULARY)).items()}
    context, target = rng.integers(0, lm.VOCABULARY, (4, 40)), rng.integers(0, lm.VOCABULARY, 40)
    got = lm.log_likelihood(w, context, target)
    for i in range(3):  # against sums over all ids
        h = np.tanh(sum(w["context"][p][context[p, i]] for p in range(4)))
        h[-1] = 1
        c = np.exp([h @ w["classes"][:, k] for k in range(lm.CLASSES)])
        p = np.concatenate([c[k] / c.sum() * np.exp(h @ w["members"][k]) / np.exp(h @ w["members"][k]).sum() for k in range(lm.CLASSES)])
        assert abs(p.sum() - 1) < 1e-9 and abs(np.log(p[target[i]]) - got[i]) < 1e-9
    g, back = lm.gradients(w, context, target)
    loss = lambda: -lm.log_likelihood(w, context, target).mean()
    each = [("classes", (3, 5)), ("classes", (lm.WIDTH - 1, 9)), ("members", (int(target[0]) // lm.MEMBERS, 4, int(target[0]) % lm.MEMBERS)), ("context", (1, int(context[1, 7]), 6))]
    for name, at in each:
        keep, step = w[name][at], 1e-5
        w[name][at] = keep + step
        up = loss()
        w[name][at] = keep - step
        down = loss()
        w[name][at] = keep
        mine = g[name][at] if name in g else back[context[at[0]] == at[1]].sum(axis=0)[at[2]]
        assert abs((up - down) / (2 * step) - mine) < 1e-7
    before = got.mean()
    memory = {k: np.full_like(v, 0.01) for k, v in w.items()}
    for _ in range(20):
        lm.train_step(w, memory, context, target)
    assert lm.log_likelihood(w, context, target).mean() > before + 0.5


def test_batches_are_dealt_so_that_each_meets_few_classes():
    rng = np.random.default_rng(4)
    target = np.minimum(rng.zipf(1.3, 16 * 512 + 100), lm.VOCABULARY - 1).astype(np.int16)
    order = lm.dealt(target, 512, rng)
    assert (np.sort(order) == np.arange(len(target))).all() and (order[-100:] >= 16 * 512).all()
    met = lambda t: [len(np.unique(t[k : k + 512] // lm.MEMBERS)) for k in range(0, 16 * 512, 512)]
    assert np.mean(met(target[order])) < np.mean(met(target)) / 3
    often = [(target[order][k : k + 512] < lm.MEMBERS).mean() for k in range(0, 16 * 512, 512)]
    assert max(often) - min(often) < 0.2  # a class that is met often stays in every batch
    for n in (0, 1, 512, 700, 1024):
        assert (np.sort(lm.dealt(target[:n], 512, rng)) == np.arange(n)).all()


def test_rows_of_equal_ids_are_summed():
    rng = np.random.default_rng(6)
    for most in (1, 3, 40, 4000):
        ids, x = rng.integers(0, most, 4 * 300).astype(np.int16), rng.standard_normal((300, 5))
        ids[:200] = 0
        found, sums = lm.summed(ids, x)
        right = np.zeros((most, 5))
        np.add.at(right, ids, np.tile(x, (4, 1)))
        assert (np.sort(found) == np.unique(ids)).all() and np.allclose(sums, right[found])


def test_pipeline_stages_on_a_small_corpus(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    texts = [words_text(rng, 80, 3000) for _ in range(160)]
    texts += [texts[0], texts[1] + " extra"]
    item = words_text(rng, 20, 3000)
    texts += [item, words_text(rng, 900, 3000) + " " + item]
    for i in range(0, 160, 4):
        texts[i + 2] += " idiotish scumlike idiotish scumlike"
    docs = [(i, t, "en", "s", len(t), 0.5, "x", 3) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, bucket int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 1 if i % 4 == 2 else 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = set(rows.doc_id)
    assert not any(i % 4 == 2 for i in kept if i < 160) and len([i for i in kept if i < 160]) == 120
    assert not {160, 161, 162} & kept and 163 in kept


SCHEMAS = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}


def test_pipeline_on_empty_tables_and_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for kind, rows in (("none", []), ("odd", [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "!!!", None, "s", 3), (3, "x " * 40_000, "en", "s", 80_000), (None, "x " * 40_000, "en", "s", 80_000)])):
        for name, ddl in SCHEMAS.items():
            spark.createDataFrame(rows if name == "documents" else [], ddl).write.parquet(str(tmp_path / kind / f"{name}.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / kind)).toPandas()
        assert set(out.doc_id.dropna()) <= {3} and (kind == "odd") == (len(out) > 0)


def test_language_and_packing_stages_alone(spark, tmp_path, library):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(35)
    text = lambda s: " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(60))
    kinds = {"aa": ["tha", "ing", "ere", "ou"], "bb": ["que", "ment", "eau", "ier"]}
    rows = [(i, text(kinds[g]), g, "s", 0) for i in range(200) for g in [("aa", "bb")[i % 2]]] + [(200, "12 34 !", "aa", "s", 0), (201, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMAS["documents"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.drop_unknown_language(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(200))
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).toPandas()
    size = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, *_ in rows}
    assert packed.groupby("doc_id").length.sum().to_dict() == size and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_pipeline_on_bytes_that_are_not_utf8(spark, tmp_path, library):
    """Spark reads such strings as they are; no stage ends on them, and Python reads them as U+FFFD."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(57)
    raw = [words_text(rng, 60, 5000).encode() for _ in range(40)]
    raw[3], raw[8], raw[9] = raw[3] + b" caf\xc3", b"\xff\xfe " + raw[8], raw[9].replace(b" ", b" \xed\xa0\x80", 1)
    raw += [b"\xc3", b"", None]
    texts = pa.Array.from_buffers(pa.string(), len(raw), pa.array(raw, pa.binary()).buffers())
    n = len(raw)
    pq.write_table(pa.table({"doc_id": range(n), "text": texts, "lang": ["en"] * n, "source": ["s"] * n, "n_chars": [0] * n}), tmp_path / "documents.parquet")
    for name in ("labels", "benchmark"):
        spark.createDataFrame([], SCHEMAS[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    read = [(b or b"").decode("utf-8", "replace") for b in raw]
    size = [len(library.encode(t, add_special_tokens=False).ids) for t in read]
    assert {r["doc_id"] for r in corpus_pipeline.drop_unknown_language(spark, docs, str(tmp_path)).select("doc_id").collect()} == set(range(40))
    got = counting.token_counts(docs, tokenizer_path()).toPandas().set_index("doc_id")
    assert got.n_bytes.to_dict() == {i: len(b or b"") for i, b in enumerate(raw)} and got.n_tokens.to_dict() == dict(enumerate(size))
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).toPandas()
    assert packed.groupby("doc_id").length.sum().to_dict() == {i: k + 1 for i, k in enumerate(size)}
    assert set(corpus_pipeline.run(spark, str(tmp_path)).toPandas().doc_id) == set(range(40))


def test_toxicity_of_short_texts_is_learned_from_any_layout(spark, tmp_path):
    """Short texts are families by their words: equal ones count once, others each, however rows lie in partitions."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(41)
    vile, mild = [f"vile{i}" for i in range(6)], [f"mild{i}" for i in range(60)]
    rows = [(i, f"{rng.choice(vile if i % 5 == 0 else mild)} {rng.choice(mild)}", "en", "s", 9) for i in range(400)]
    rows += [(400 + i, ["", "one", "vile0 mild0", None][i % 4], "en", "s", 9) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMAS["documents"])
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(i, 0) for i in range(400, 440)], "doc_id long, toxic int")
    models = [toxicity.learn(docs.repartition(parts), labels.repartition(parts)) for parts in (1, 16, 97)]
    first = models[0]
    assert len(first.keys) >= 6
    for m in models[1:]:
        assert (m.keys == first.keys).all() and (m.delta == first.delta).all() and (m.k, m.coef.tolist()) == (first.k, first.coef.tolist())
    once = {" ".join(t.split()) for i, t, *_ in rows[:400] if zlib.crc32(str(i).encode()) % 4 != 2}
    import pyarrow as pa

    (_, _, w), = toxicity.bw.word_slices(pa.array([t for _, t, *_ in rows]), toxicity.bw.ALNUM)
    family = toxicity._family(w).tolist()
    assert len({family[i] for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2}) == len(once)
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    kept_ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and not any(i % 5 == 0 for i in kept_ids if i < 400) and all(i in kept_ids for i in range(400) if i % 5)
    assert corpus_pipeline.drop_toxic(spark, docs.filter("false"), str(tmp_path)).count() == 0


def test_toxicity_fit_holds_a_row_for_each_labelled_id(spark):
    docs = spark.createDataFrame([(i % 4 * 4, f"vile word {i}" if i % 2 else f"mild word {i}", "en", "s", 1) for i in range(300)], SCHEMAS["documents"])
    labels = spark.createDataFrame([(i * 4, i % 2) for i in range(4)], "doc_id long, toxic int")
    a, b = (toxicity.learn(docs.repartition(n), labels, min_z=0.1, min_delta=0.1) for n in (1, 9))
    assert a.coef.tolist() == b.coef.tolist() and (a.keys == b.keys).all()


def test_decontamination_stage_alone(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(14)
    item = words_text(rng, 20, 3000)
    long = words_text(rng, 900, 3000)
    spark.createDataFrame([(1, item), (2, None), (3, "")], SCHEMAS["benchmark"]).write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, long, "en", "s", len(long)), (2, item, "en", "s", 1), (3, long + " " + item.upper(), "en", "s", 1), (4, None, None, None, None), (5, "", "en", "s", 0), (None, item, "en", "s", 1), (1, long, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMAS["documents"])
    out = corpus_pipeline.remove_benchmark(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = sorted((r["doc_id"], (r["text"] or "").strip(), r["n_chars"]) for r in out.collect())
    assert [x[0] for x in got] == [1, 1, 3, 4, 5] and got[0][1] == got[1][1] == got[2][1] == long
    assert corpus_pipeline.remove_benchmark(spark, docs.filter("false"), str(tmp_path)).count() == 0


def test_near_duplicate_stage_keeps_rows_without_an_id(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(13)
    a, b, c = (words_text(rng, 60, 5000) for _ in range(3))
    rows = [(5, a), (5, a), (7, a), (None, a), (None, b), (None, b), (None, None), (8, ""), (9, c), (9, b + " more")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    out = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert [x for x in out if x[1] == a] == [(5, a)] and (0, "") in out and (8, "") in out
    assert corpus_pipeline.drop_near_duplicates(spark, docs.filter("false"), "").count() == 0


def test_narrow_languages_are_rejected_without_a_bound_of_the_callers(spark):
    from tessera.llm import langid

    blocks = {"a": [b" alpha beta gamma delta " * 40] * 3, "b": [b" one two three four " * 40] * 3}
    frame = spark.createDataFrame([(1, "alpha beta gamma delta alpha beta gamma"), (2, "x"), (3, "12")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in langid.identify(frame, blocks).collect()}
    assert got[1] == ("a", False) and got[2][0] != "und" and got[2][1] and got[3] == ("und", True)
