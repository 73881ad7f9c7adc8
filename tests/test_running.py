"""Runs that end half way, tables that grow, repairs that review what they change, streams with state."""

import http.server
import json
import random
import sys
import threading
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import PipelineConfig
from tessera.operators import chunking, consistency, feedback, judging, positions, review, similarity, sinks
from tessera.operators import model as M
from tessera.plans import pipeline
from tessera.sources import sections as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


class Mortal:
    """Writes down what it is asked, and dies at one prompt until it is told otherwise."""

    def __init__(self, folder, fatal="", wrong=""):
        self.folder, self.fatal, self.wrong = str(folder), fatal, wrong

    def reply(self, kind, prompt):
        import os
        import uuid

        if self.fatal and self.fatal in prompt and not os.path.exists(f"{self.folder}/well"):
            raise RuntimeError("the client died")
        with open(f"{self.folder}/{uuid.uuid4().hex}.asked", "w") as f:
            f.write(prompt)
        if self.wrong and self.wrong in prompt and not os.path.exists(f"{self.folder}/well"):
            return "ERROR: 503"
        return f"reply to {prompt}"

    def asked(self):
        import glob

        return Counter(open(x).read() for x in glob.glob(f"{self.folder}/*.asked"))


def test_a_run_that_dies_keeps_its_replies(spark, tmp_path):
    prompts = spark.createDataFrame([(i, "k", f"prompt {i % 60:02d}") for i in range(80)], "i int, kind string, prompt string").repartition(5)
    ids = {r["prompt_id"]: r["prompt"] for r in prompts.withColumn("prompt_id", F.sha2(F.concat_ws("\x00", "kind", "prompt"), 256)).collect()}
    order = [ids[k] for k in sorted(ids)]
    client, path = Mortal(tmp_path, fatal=order[34]), str(tmp_path / "replies")
    with pytest.raises(Exception, match="the client died"):
        M.ask(prompts, client, saved_at=path, per_batch=10)
    kept = {r["prompt_id"] for r in M.saved_replies(spark, path).collect()}
    assert {ids[k] for k in kept} == set(order[:30])  # three batches of ten
    first = client.asked()
    (tmp_path / "well").write_text("")
    out = M.ask(prompts, client, saved_at=path, per_batch=10).collect()
    assert len(out) == 80 and all(r["reply"] == f"reply to {r['prompt']}" for r in out)
    again = client.asked() - first
    assert set(again) == set(order[30:]) and not set(again) & set(order[:30])
    before = client.asked()
    assert M.ask(prompts, client, saved_at=path).count() == 80 and client.asked() == before  # nothing is left to ask
    assert M.ask(prompts.filter("false"), client, saved_at=str(tmp_path / "none")).count() == 0


def test_errors_are_asked_again(spark, tmp_path):
    prompts = spark.createDataFrame([("k", f"p{i}") for i in range(6)], "kind string, prompt string")
    client, path = Mortal(tmp_path, wrong="p3"), str(tmp_path / "replies")
    got = {r["prompt"]: r["reply"] for r in M.ask(prompts, client, saved_at=path, per_batch=2).collect()}
    assert got["p3"] == "ERROR: 503" and got["p2"] == "reply to p2"
    (tmp_path / "well").write_text("")
    got = {r["prompt"]: r["reply"] for r in M.ask(prompts, client, saved_at=path, per_batch=2).collect()}
    assert got["p3"] == "reply to p3" and client.asked() == Counter({f"p{i}": 2 if i == 3 else 1 for i in range(6)})


def requirement(i, source="s", tr_h="When asked, the system shall answer within 10 seconds", ids=("R",), gap=1):
    return (source, i * gap, f"T{i}", "functional", f"{tr_h} {i}", (f"T{i}", ["p"], ["s"], ["the answer is on screen"], "c", "medium", list(ids)), list(ids))


def test_verdicts_are_saved_while_running(spark, tmp_path):
    rows = spark.createDataFrame([requirement(i, f"s{i % 3}") for i in range(12)], schemas.REQUIREMENT)
    client, path = Mortal(tmp_path), str(tmp_path / "verdicts")
    first = judging.faithfulness(rows, client, saved_at=path).count()
    before = client.asked()
    assert judging.faithfulness(rows, client, saved_at=path).count() == first == 12 and client.asked() == before and len(before) == 12


def part_files(path):
    return [x for x in path.rglob("part-*") if "_sources" not in x.relative_to(path).parts]


@pytest.mark.parametrize("json_lines", [False, True])
def test_many_sources_in_a_bounded_number_of_files(spark, tmp_path, json_lines):
    ddl = "source_id string, ordinal int, tr_id string"
    path = tmp_path / "t"
    df = spark.range(60_000).selectExpr("concat('source ', id % 20000) as source_id", "cast(id div 20000 as int) as ordinal", "concat('T', id) as tr_id")
    sinks.save(df, str(path), json_lines, buckets=16)
    assert len(part_files(path)) == 16 and len([x for x in path.iterdir() if x.name.startswith("bucket=")]) == 16
    assert sinks.saved_sources(spark, str(path)).count() == 20_000
    new = spark.createDataFrame([("source 7", 1, "new"), ("source 7", 2, "newer"), ("another", 1, "a")], ddl)
    sinks.save(new, str(path), json_lines, buckets=99)  # the first save's number stays
    back = sinks.load(spark, str(path), ddl, json_lines)
    assert back.columns == ["source_id", "ordinal", "tr_id"] and back.count() == 60_000
    assert sorted(r["tr_id"] for r in back.filter("source_id in ('source 7', 'another')").collect()) == ["a", "new", "newer"]
    listed = {r["source_id"]: r["rows"] for r in sinks.saved_sources(spark, str(path)).filter("source_id in ('source 7', 'another', 'source 8')").collect()}
    assert listed == {"source 7": 2, "another": 1, "source 8": 3} and len(part_files(path)) == 16
    assert sinks.pending(spark.createDataFrame([("source 9", 1, "x"), ("nobody", 1, "x")], ddl), sinks.saved_sources(spark, str(path))).collect()[0]["source_id"] == "nobody"


def test_a_large_source_is_spread_over_files(spark, tmp_path):
    df = spark.range(1000).selectExpr("'one' as source_id", "cast(id as int) as ordinal", "concat('T', id) as tr_id")
    sinks.save(df, str(tmp_path / "t"), buckets=4, rows_per_file=150)
    assert 5 <= len(part_files(tmp_path / "t")) <= 8 and sinks.load(spark, str(tmp_path / "t"), "source_id string, ordinal int, tr_id string").count() == 1000
    sinks.save(df.filter("false"), str(tmp_path / "t"))
    assert sinks.saved_sources(spark, str(tmp_path / "none")).count() == 0 and sinks.saved_sources(spark, str(tmp_path / "t")).first()["rows"] == 1000


def test_positions_are_gapless_and_cross_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaaab"), rng.randrange(10**6), i) for i in range(5000)]
    got = positions.ordered(spark.createDataFrame(rows, "k string, o int, i int").repartition(7), ["k", "o", "i"]).collect()
    assert sorted((r["place"], r["k"], r["o"], r["i"]) for r in got) == [(p, *r) for p, r in enumerate(sorted(rows))]
    again = positions.renumbered(spark.createDataFrame(rows, "k string, o int, i int"), ["k"], ["o", "i"], "o").collect()
    for k in "ab":
        assert [r["i"] for r in sorted((r for r in again if r["k"] == k), key=lambda r: r["o"])] == [r[2] for r in sorted(r for r in rows if r[0] == k)]
        assert sorted(r["o"] for r in again if r["k"] == k) == list(range(1, sum(r[0] == k for r in rows) + 1))
    assert positions.ordered(spark.createDataFrame([], "k string"), ["k"]).count() == 0


def test_duplicates_are_neighbours_whatever_their_ordinals(spark):
    """Two equal requirements with 24 rejects between them are neighbours."""
    def pairs(rows):
        return {(r["i"], r["j"]) for r in review.duplicates(spark.createDataFrame(rows, schemas.REQUIREMENT)).collect()}

    assert pairs([requirement(1), (*requirement(26)[:4], requirement(1)[4], *requirement(26)[5:])]) == {(1, 26)}
    texts = ["p q r", *[f"u{i} v{i}" for i in range(18)], "r q p", "P Q R"]
    rows = [("s", 100 * i, f"T{i}", "functional", t, requirement(i)[5], ["R"]) for i, t in enumerate(texts)]
    assert pairs(rows) == {(0, 1900), (1900, 2000)}
    rows.insert(5, ("s", 450, "blank", "functional", " ", requirement(0)[5], ["R"]))  # a row without words counts too
    assert pairs(rows) == {(1900, 2000)}


def slow_merge(rows, above=0.75):
    left = [[o, i, t, p, set(x)] for o, i, t, p, x in sorted(rows)]
    out = []
    while left:
        head, rest = left.pop(0), []
        for other in left:
            a, b = set(head[2].lower().split()), set(other[2].lower().split())
            if a and b and len(a & b) / len(a | b) > above:
                head[2] = other[2] if len(other[2]) > len(head[2]) else head[2]
                head[4] |= other[4]
            else:
                rest.append(other)
        left = rest
        out.append((*head[:4], sorted(head[4])))
    return out


def merged(spark, rows, above=0.75):
    df = spark.createDataFrame([("s", *r) for r in rows], similarity.MERGED).repartition(6)
    return sorted((r["ordinal"], r["item_id"], r["description"], r["priority"], r["source_ids"]) for r in similarity.greedy_merge(df, above).collect())


def test_greedy_merge_equals_the_slow_fold(spark):
    rng = random.Random(9)
    for above in (0.3, 0.75, 0.8):
        rows = [(i, f"F{i}", " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 9))), "low", [f"x{i % 4}"]) for i in range(400)]
        assert merged(spark, rows, above) == slow_merge(rows, above)


def test_greedy_merge_of_a_long_list(spark):
    """20,000 rows of one source: families that grow, copies, and rows that stay alone."""
    rng = random.Random(10)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.randrange(4, 12))] for _ in range(2500)]
    rows = []
    for i in range(20_000):
        words = list(base[rng.randrange(len(base))])
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words)), f"extra{rng.randrange(50)}")
        rows.append((i, f"F{i}", " ".join(words), "low", [f"x{i % 7}"]))
    got = merged(spark, rows)
    quick: list = []  # the slow fold with an index of all tokens, row by row
    where: dict = {}
    for o, i, t, p, x in rows:
        b = set(t.split())
        near = sorted({k for w in b for k in where.get(w, ())})
        k = next((k for k in near if len(quick[k][5] & b) / len(quick[k][5] | b) > 0.75), None)
        if k is None:
            quick.append([o, i, t, p, set(x), b])
            k = len(quick) - 1
        else:
            quick[k][4] |= set(x)
            if len(t) <= len(quick[k][2]):
                continue
            quick[k][2], quick[k][5] = t, b
        for w in b:
            where.setdefault(w, set()).add(k)
    assert got == [(o, i, t, p, sorted(x)) for o, i, t, p, x, _ in quick] and 2000 < len(got) < 15_000
    assert merged(spark, rows[:300]) == slow_merge(rows[:300])


def test_repairs_review_what_they_change(spark, tmp_path):
    good = "When asked, the system shall answer within 10 seconds about"
    words = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heath"]
    rows = [requirement(i, s, f"{good if s == 'fine' else 'get ready for'} {' '.join(words[k] + str(i) for k in range(8))}") for s in ("fine", "bad", "worse") for i in range(4)]
    df = spark.createDataFrame(rows, schemas.REQUIREMENT)
    items = spark.createDataFrame([(s, 0, "answer ready") for s in ("fine", "bad", "worse")], "source_id string, ordinal int, text string")
    sources = items.select("source_id")
    seen = []
    whole = pipeline.judge_with(items, items.limit(0), sources, PipelineConfig())

    def judge(rows, only):
        seen.append(sorted(r["source_id"] for r in rows.select("source_id").distinct().collect()))
        return whole(rows, only)

    def repair(rows, reviewed, turn):
        ready = F.col("source_id") == ("bad" if turn == 0 else "worse")
        return rows.withColumn("tr_h", F.when(ready, F.concat(F.lit(good + " "), F.col("tr_id"), F.lit(" "), F.md5("tr_h"), F.lit(" ready "), F.md5("tr_id"))).otherwise(F.col("tr_h")))

    out, reviews = feedback.loop(df, judge, repair)
    assert seen == [["bad", "fine", "worse"], ["bad"], ["worse"]]
    full = whole(out, None)
    by = lambda x: sorted((json.loads(r) for r in x.toJSON().collect()), key=lambda r: r["source_id"])
    assert by(reviews) == by(full) and all(r["passed"] for r in by(full))
    same, _ = feedback.loop(df, judge, lambda rows, reviewed, turn: rows)
    assert len(seen) == 4 and same.count() == 12  # no change ends it
    assert [r["source_id"] for r in feedback.changed_sources(df, df.filter("source_id <> 'bad'")).collect()] == ["bad"]


def test_stages_skip_what_is_done(spark, tmp_path):
    text = "The user can log in with a password. The system shall lock the account within 15 minutes. Errors are shown when login failed. GET /login returns a token."
    part = lambda *names: spark.createDataFrame([(s, "srs", 1, "r", text + f" It allows export of {s} reports.") for s in names], schemas.SECTION)

    class Counting(M.RuleClient):
        def reply(self, kind, prompt):
            import uuid

            with open(f"{tmp_path}/{uuid.uuid4().hex}.{kind}", "w") as f:
                f.write(prompt)
            return super().reply(kind, prompt)

    asked = lambda kind: len(list(tmp_path.glob(f"*.{kind}")))
    path = str(tmp_path / "out")
    first = pipeline.run_into(path, part("auth_srs", "pay_srs"), Counting())
    assert sorted(r["source_id"] for r in first.reviews.select("source_id").collect()) == ["auth_srs", "pay_srs"] and asked("entities") == 2
    both = pipeline.run_into(path, part("auth_srs", "pay_srs", "mail_srs"), Counting())
    assert both.reviews.count() == 3 and asked("entities") == 3 and both.requirements.select("source_id").distinct().count() == 3
    n = len(list(tmp_path.glob("*.*")))
    assert pipeline.run_into(path, part("pay_srs"), Counting()).chunks.count() == 3 and len(list(tmp_path.glob("*.*"))) == n
    pipeline.run_into(path, part("pay_srs"), Counting(), force=True)
    assert asked("entities") == 4 and sinks.load(spark, f"{path}/chunks", schemas.CHUNK).count() == 3
    whole = pipeline.run(part("auth_srs", "mail_srs", "pay_srs"), M.RuleClient())
    key = lambda df: sorted((r["source_id"], r["tr_id"], r["tr_h"]) for r in df.collect())
    assert [x for x in key(sinks.load(spark, f"{path}/requirements", schemas.REQUIREMENT)) if "CONS" not in x[1]] == [x for x in key(whole.requirements) if "CONS" not in x[1]]


def test_issues_about_all_sources_have_no_limit(spark):
    issues = spark.range(2500).selectExpr("'terminology' as comparison_id", "cast(id as int) as ordinal", "'all_sources' as source_a_id", "'all_sources' as source_b_id", "concat('d', id) as description")
    sources = spark.createDataFrame([("a",), ("b",)], "source_id string")
    got = consistency.relevant_issues(issues, sources)
    assert got.count() == 5000 and got.groupBy("sid").agg(F.count_distinct("ordinal").alias("n")).filter("n = 2500").count() == 2
    assert sorted(r["ordinal"] for r in consistency.relevant_issues(issues, sources, first=3).filter("sid = 'a'").collect()) == [0, 1, 2]
    assert consistency.relevant_issues(issues.filter("false"), sources).count() == 0


def test_sections_by_a_table_function(spark):
    S.register_functions(spark)
    rows = [(1, "INTRO\nsome words\n", "txt"), (2, "{\"k\": 1, \"m\": [2]}", "JSON"), (3, "<m><p><q>leaf</p></m>", "xml"), (4, "x", "bin"), (5, None, "txt")]
    spark.createDataFrame(rows, "id int, body string, ext string").createOrReplaceTempView("files_of_test")
    got = spark.sql("select id, s.section_id, s.section_ref, s.text from files_of_test, lateral document_sections(encode(body, 'UTF-8'), ext) s order by id, section_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, "INTRO", "some words"), (2, 1, "json:k", "1"), (2, 2, "json:m", "[\n  2\n]"), (3, 1, "xml:p", "[q] leaf")]


def test_chunks_of_units_that_arrive_over_time(spark, tmp_path):
    from tessera.streaming import chunks as C

    rng = random.Random(12)
    units = {("d" + str(k), 1 + k % 2): [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 120))) + "." for _ in range(rng.randrange(1, 40))] for k in range(6)}
    rows = [(s, "srs", n, "ref", i, u, i == len(own) - 1) for (s, n), own in units.items() for i, u in enumerate(own)]
    rows += rows[:5]  # repeats
    rng.shuffle(rows)
    keep = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", C.STORE)
    try:
        source = str(tmp_path / "in")
        for k in range(4):
            spark.createDataFrame(rows[k::4], C.UNIT).coalesce(1).write.mode("append").parquet(source)
        stream = C.chunk_stream(spark.readStream.schema(chunking.schema(C.UNIT)).option("maxFilesPerTrigger", 1).parquet(source))
        q = stream.writeStream.format("memory").queryName("chunks_of_units").option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
        got = spark.sql("select * from chunks_of_units").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", keep)
    want = sorted((f"{s}__s{n:04d}__c{i:04d}", c, words, seeded) for (s, n), own in units.items() for i, (c, words, seeded) in enumerate(chunking.pack_units(own, 512, 51), 1))
    assert sorted((r["chunk_id"], r["content"], r["metadata"]["token_count"], r["metadata"]["overlap"]) for r in got) == want
    batch = chunking.chunk(spark.createDataFrame([(s, "srs", n, "ref", " ".join(own)) for (s, n), own in units.items()], schemas.SECTION))
    assert sorted((r["chunk_id"], r["content"]) for r in batch.collect()) == sorted(x[:2] for x in want)


@pytest.fixture
def server():
    """A chat server on this machine: its replies are lines of JSON, some of them partial, and it is busy twice."""
    class Handler(http.server.BaseHTTPRequestHandler):
        calls = Counter()

        def log_message(self, *args):
            pass

        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"models": [{"name": "small:7b"}]}).encode())

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = body["messages"][0]["content"]
            self.calls[said] += 1
            code = 503 if said == "busy" and self.calls[said] <= 2 or said == "always busy" else 404 if said == "absent" else 200
            self.send_response(code)
            self.end_headers()
            if code == 200:
                for part in ("one ", "two"):
                    self.wfile.write(json.dumps({"message": {"content": part}}).encode() + b"\n")
                    self.wfile.write(b'{"message": {"cont\n')  # a partial line
                self.wfile.write(json.dumps({"message": {"content": f" {body['model']} {body['options']['num_predict']}"}, "done": True}).encode() + b"\n")
                self.wfile.write(json.dumps({"message": {"content": "behind the end"}}).encode() + b"\n")

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", Handler.calls
    s.shutdown()


def test_a_chat_server(spark, server, monkeypatch):
    host, calls = server
    monkeypatch.setattr(M.time, "sleep", lambda s: None)
    client = M.HttpClient(host, "small:latest", max_tokens=77)
    client.check()
    with pytest.raises(ConnectionError):
        M.HttpClient(host, "large").check()
    assert client.reply("k", "hello") == "one two small:latest 77"
    assert client.reply("k", "busy") == "one two small:latest 77" and calls["busy"] == 3
    assert client.reply("k", "always busy") == "ERROR: 503" and calls["always busy"] == 3
    assert client.reply("k", "absent") == "ERROR: 404" and calls["absent"] == 1
    assert M.HttpClient("http://127.0.0.1:9", "small").reply("k", "x").startswith("ERROR: ")
    got = M.ask(spark.createDataFrame([("k", "hello"), ("k", "absent")], "kind string, prompt string"), client).collect()
    assert {r["prompt"]: r["reply"] for r in got} == {"hello": "one two small:latest 77", "absent": "ERROR: 404"}
