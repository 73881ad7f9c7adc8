import json
import re
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import PipelineConfig
from tessera.functions import quality as Q
from tessera.functions import replies as R
from tessera.functions import text as T
from tessera.operators import chunking, consistency, coverage, demand, feedback, ranking, reports, requirements, review, similarity, sinks
from tessera.operators import model as M
from tessera.plans import pipeline
from tessera.sources import sections as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


def col(spark, expr, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr.alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_text_functions_follow_plain_python(spark):
    texts = ["", "  ", "a", "A b  a", "x\ny\tz", " lead", "The system shall. Next! Last?", "one. two"]
    assert col(spark, T.word_count("v"), *texts) == [len(t.split()) for t in texts]
    assert col(spark, T.normal_key("v"), *texts) == [" ".join(t.lower().split()) for t in texts]
    assert col(spark, T.split_units("v", F.lit("sentence")), *texts) == [[u.strip() for u in re.split(r"(?<=[.!?])\s+", t) if u.strip()] for t in texts]
    assert col(spark, T.clean("v"), "a  \n\n\n\nb \n") == ["a\n\nb"]


def test_jaccard_is_zero_on_empty_and_not_similar_at_three_quarters(spark):
    df = spark.createDataFrame([("a b c", "a b d"), ("", "a"), ("a b c d", "a b c d e"), ("a b c", "a b c d")], "a string, b string")
    assert [r[0] for r in df.select(F.round(T.jaccard("a", "b"), 6)).collect()] == [0.5, 0.0, 0.8, 0.75]


def test_pairs_keep_to_threshold_and_horizon(spark):
    rows = [("s", i, f"unique{i} text") for i in range(45)]
    rows[0], rows[19], rows[20], rows[39] = ("s", 0, "p q r"), ("s", 19, "r q p"), ("s", 20, "P Q R"), ("s", 39, "p q r s")
    got = similarity.window_pairs(spark.createDataFrame(rows, "source_id string, ordinal int, tr_h string"), "tr_h", ["source_id"], "ordinal").collect()
    assert {(r["i"], r["j"]) for r in got} == {(0, 19), (19, 20)}


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 60), max_size=25), st.integers(20, 50), st.integers(0, 10))
def test_packing_units_loses_nothing_and_ends(sizes, most, overlap):
    units = [" ".join(f"u{i}w{k}" for k in range(n)) for i, n in enumerate(sizes)]
    chunks = chunking.pack_units(units, most, overlap)
    assert all(n == len(c.split()) for c, n, _ in chunks)
    assert all(n <= most or len(c.split()) in sizes for c, n, _ in chunks)
    fresh = [w for c, _, _ in chunks for w in c.split()]
    assert list(dict.fromkeys(fresh)) == [w for u in units for w in u.split()]
    assert not chunks or not chunks[0][2]


def test_a_tail_without_room_is_dropped():
    assert [(n, o) for _, n, o in chunking.pack_units(["a " * 20, "b " * 500], 512, 51)] == [(20, False), (500, False)]
    assert [(n, o) for _, n, o in chunking.pack_units(["a " * 480, "b " * 20, "c " * 480], 512, 51)] == [(500, False), (500, True)]


def test_chunks_of_short_and_long_sections(spark):
    rows = [("d", "runtime", 1, "r", "x " * 10), ("d", "runtime", 2, "r", "\n".join("y " * 100 for _ in range(5))), ("d", "srs", 3, "r", "")]
    got = chunking.chunk(spark.createDataFrame(rows, schemas.SECTION)).collect()
    assert sorted((r["chunk_id"], r["metadata"]["token_count"]) for r in got) == [("d__s0001__c0001", 10), ("d__s0002__c0001", 200), ("d__s0002__c0002", 200), ("d__s0002__c0003", 100)]


def test_ranking_breaks_ties_by_first_appearance_and_keeps_the_first_longest(spark):
    rows = [("s", "srs", "function_point", c, None, p, i) for i, (c, p) in enumerate([("Log in", 0.5), ("log  in", 0.5), ("Pay", 0.5), ("Buy", 0.5), ("LOG IN", 0.5)])]
    got = ranking.rank_by_significance(spark.createDataFrame(rows, schemas.ENTITY)).orderBy("rank").collect()
    assert [(r["content"], r["freq"]) for r in got] == [("log  in", 3), ("Pay", 1), ("Buy", 1)]


def test_objectives_cut_before_repeats_go_and_glossary_takes_the_last_value(spark):
    rows = [("s", "srs", "function_point", c, None, 0.9 - i / 100, i) for i, c in enumerate(["a", "a", "b", "c", "d", "e", "f", "g", "h"])]
    rows += [("s", "srs", "glossary_term", c, None, 0.5, 20 + i) for i, c in enumerate(["K: one", "plain", "K: two"])]
    e = spark.createDataFrame(rows, schemas.ENTITY)
    assert [r["content"] for r in ranking.objectives(e).orderBy("position").collect()] == ["a", "b", "c", "d", "e", "f", "g"]
    assert [(r["term"], r["definition"]) for r in ranking.glossary(e).orderBy("position").collect()] == [("K", "two"), ("plain", "plain")]


def test_greedy_merge_compares_with_what_a_row_has_grown_to(spark):
    rows = [("s", 0, "F1", "a b c d", "high", ["x"]), ("s", 1, "F2", "a b c d e", "low", ["y"]), ("s", 2, "F3", "a b c d e f", "low", ["x"]), ("s", 3, "F4", "z", "low", [])]
    got = similarity.greedy_merge(spark.createDataFrame(rows, "source_id string, ordinal int, item_id string, description string, priority string, source_ids array<string>")).orderBy("ordinal").collect()
    assert [(r["item_id"], r["description"], r["priority"], r["source_ids"]) for r in got] == [("F1", "a b c d e f", "high", ["x", "y"]), ("F4", "z", "low", [])]


def requirement(i, tr_h="When asked, the system shall answer within 10 seconds", pre=("p",), stim=("s",), out=("the answer is on screen",), crit="c", ids=("R",), source="s"):
    return (source, i, f"T{i}", "functional", tr_h, (f"T{i}", list(pre), list(stim), list(out), crit, "medium", list(ids)), list(ids))


def test_structure_flags(spark):
    rows = [requirement(0), requirement(1, tr_h="get ready"), requirement(2, pre=(" ",)), requirement(3, pre=(" ",), out=("ok",)), requirement(4, ids=(" ",)), requirement(5, stim=()), requirement(6, tr_h="It shall be good", crit="")]
    got = review.flags(spark.createDataFrame(rows, schemas.REQUIREMENT)).orderBy("ordinal").collect()
    assert [r["ears_score"] for r in got] == [6, 4, 5, 4, 6, 5, 4]
    assert [r["complete"] for r in got] == [True, True, True, True, True, False, False]
    assert [r["traceable"] for r in got] == [True, True, True, True, False, True, True]
    assert [r["untestable"] for r in got] == [False] * 6 + [True]


def test_review_of_a_source_without_rows_and_of_a_good_one(spark):
    rows = spark.createDataFrame([requirement(i) for i in range(3)], schemas.REQUIREMENT)
    items = spark.createDataFrame([("s", 0, "answer quickly"), ("s", 1, "no of it")], "source_id string, ordinal int, text string")
    sources = spark.createDataFrame([("s",), ("none",)], "source_id string")
    got = {r["source_id"]: r for r in review.review(rows, items, None, sources).collect()}
    assert got["none"]["correction_notes"] == ["No TRs to review."]
    assert not got["none"]["passed"] and got["none"]["q_h"] == 0.0 and got["none"]["total_trs"] == 0
    assert got["s"]["coverage"] == 0.5 and got["s"]["duplicate_count"] == 3 and got["s"]["correction_notes"][0].startswith("Coverage 50% < 95%. Missing: no of it")
    assert got["s"]["flagged_tr_ids"] == ["T1", "T2"]


def test_coverage_is_by_parts_of_words(spark, monkeypatch):
    items = spark.createDataFrame([("s", 0, "go to it"), ("s", 1, "log"), ("s", 2, "absent")], "source_id string, ordinal int, text string")
    texts = spark.createDataFrame([("s", "the Blogger page")], "source_id string, text string")
    for few in (200_000, 0):  # both ways
        monkeypatch.setattr(coverage, "FEW_KEYWORDS", few)
        got = {r["ordinal"]: r["covered"] for r in coverage.item_coverage(items, texts).collect()}
        assert got == {0: False, 1: True, 2: False}


def test_feedback_modes(spark):
    rows = spark.createDataFrame([requirement(i) for i in range(15)], schemas.REQUIREMENT)
    flagged = spark.createDataFrame([("s", f"T{i}") for i in range(9)], "source_id string, tr_id string")
    answers = spark.createDataFrame([("s", f"T{i}", "new") for i in range(9)], "source_id string, tr_id string, tr_h string")
    none = answers.filter("false")
    reference = PipelineConfig(feedback_mode="reference")
    assert feedback.merge(rows, flagged, none).count() == 15 and feedback.merge(rows, flagged, none, reference).count() == 6
    assert feedback.merge(rows, flagged, answers, reference).count() == 14
    assert feedback.merge(rows, flagged, answers).filter("tr_h = 'new'").count() == 8


def test_lenient_replies(spark):
    good = 'Sure:\n```json\n[{"a": "x"}, 5]\n```'
    assert col(spark, F.size(R.reply_items("v")), good, '[{"a": 1}', "none", "", '{"a": [1]}') == [2, 0, 0, 0, 1]
    assert R.salvage('x [{"a": 1}, {"b": 2}, {"c"') == [{"a": 1}, {"b": 2}]
    assert R.salvage("nothing") == []
    assert col(spark, Q.verdict("v"), "supported", "UNSUPPORTED", "partially_supported!", "hm") == ["SUPPORTED", "UNSUPPORTED", "PARTIALLY_SUPPORTED", "UNPARSEABLE:hm"]
    assert col(spark, Q.passes_in("v"), "PASS pass FAIL PASSED x y PASS", "") == [3, 0]


def test_requirements_are_numbered_before_rejects_go(spark):
    a = {"preconditions": ["p"], "stimuli": ["s"], "expected_outputs": ["o"]}
    first = [{"tr_h": "one", "tr_a": a}, {"tr_h": "", "tr_a": a}, 7, {"tr_h": "bad", "tr_a": a, "priority": "High"}, {"tr_h": "null", "tr_a": a, "priority": None}, {"tr_h": "list", "tr_a": a | {"stimuli": "s"}}]
    replies = spark.createDataFrame([("source1", "functional", json.dumps(first)), ("source1", "nfr_constraint", json.dumps([{"tr_h": "two", "tr_a": a, "priority": "low"}]))], "source_id string, category string, reply string")
    got = requirements.build(replies).orderBy("ordinal").collect()
    assert [(r["tr_id"], r["tr_h"]) for r in got] == [("SOURCE-FUNC-001", "one"), ("SOURCE-NFR_-007", "two")]
    assert requirements.build(replies, lenient=True).count() == 3
    assert requirements.rejects(replies, requirements.build(replies)).first()["rejects"] == 5


def test_issues_and_totals(spark):
    reply = json.dumps([{"issue_type": "conflict", "severity": "Major"}, {"description": "d"}, "x", {"issue_type": "omission", "severity": "blocker"}])
    pairs = spark.createDataFrame([("intra_a", "a", "a", reply), ("intra_b", "b", "b", "[]")], "comparison_id string, source_a string, source_b string, reply string")
    issues = consistency.parse_issues(pairs)
    assert sorted((r["issue_id"], r["issue_type"], r["severity"]) for r in issues.collect()) == [("ISS-002", "to_confirm", "minor"), ("ISS-004", "omission", "blocker")]
    totals = {r["comparison_id"]: r for r in consistency.report_totals(pairs.select("comparison_id"), issues).collect()}
    assert totals["intra_b"]["total_conflicts"] == 0 and totals["intra_a"]["total_omissions"] == 1
    everyone = issues.limit(1).withColumn("source_a_id", F.lit("all_sources"))
    assert {r["sid"] for r in consistency.relevant_issues(everyone, spark.createDataFrame([("a",), ("z",)], "source_id string")).collect()} == {"a", "z"}


class Recorder:
    """Answers by kind and writes down what it was asked (in one process)."""

    def __init__(self, path, answers):
        self.path, self.answers = str(path), answers

    def reply(self, kind, prompt):
        with open(self.path, "a") as f:
            f.write(json.dumps([kind, prompt]) + "\n")
        answer = self.answers.get(kind, "[]")
        return answer if isinstance(answer, str) else answer(prompt)

    def asked(self, kind):
        with open(self.path) as f:
            return [p for k, p in map(json.loads, f) if k == kind]


ITEMS = "source_id string, field string, ordinal int, item_id string, text string"


def test_checks_tell_their_sides_apart_and_look_at_terms(spark, tmp_path):
    rows = [("a_srs", "functional", i, f"F{i}", f"srs function {i}") for i in range(14)] + [("a_srs", "nfr", 0, "N", "srs limit"), ("a_manual", "objective", 0, "O", "manual goal"), ("a_manual", "use_case", 0, "U", "manual case")]
    rows += [("a_runtime", f, i, "R", f"rt {f} {i}") for f in ("nfr", "runtime", "exception") for i in range(10)]
    rows += [("a_srs", "glossary", 0, "Token", "x"), ("a_manual", "role", 0, "r", "token"), ("a_manual", "glossary", 0, "Zeal", "y")]
    items = spark.createDataFrame(rows, ITEMS)
    bundle = spark.createDataFrame([(s, "a") for s in ("a_srs", "a_manual", "a_runtime")], "source_id string, bundle_id string")
    client = Recorder(tmp_path / "log", {"check_terminology": json.dumps([{"issue_type": "ambiguity", "description": "token"}]), "check_srs_vs_manual": json.dumps([{"description": "d"}])})
    issues = pipeline.check(items, bundle, client).collect()
    assert sorted((r["comparison_id"], r["source_a"], r["issue_type"]) for r in issues) == [("a:srs_vs_manual", "a_srs", "to_confirm"), ("terminology", "all_sources", "ambiguity")]
    (manual,) = client.asked("check_srs_vs_manual")
    lines = [x for x in manual.splitlines() if x.startswith("- ")]
    assert lines[:2] == ["- [A functional] srs function 0", "- [A functional] srs function 1"] and lines[12:] == ["- [B objective] manual goal", "- [B use_case] manual case"]
    (runtime,) = client.asked("check_runtime_vs_srs")
    assert sum(x.startswith("- [A ") for x in runtime.splitlines()) == 20 and "- [B nfr] srs limit" in runtime
    (terms,) = client.asked("check_terminology")
    assert [x for x in terms.splitlines() if x.startswith("- ")] == ["- zeal (in: a_manual)", "- token (in: a_manual, a_srs)"]
    assert len(client.asked("check_within")) == 1 and not client.asked("check_design_vs_srs")


def test_terms_are_cut_in_the_order_they_are_met(spark):
    g = spark.createDataFrame([("s2", 0, "Alpha"), ("s1", 1, "Mid"), ("s1", 0, "Zeta")], "source_id string, ordinal int, text string")
    r = spark.createDataFrame([("s1", 0, "user"), ("s2", 0, "ZETA")], "source_id string, ordinal int, text string")
    assert [(x["term"], x["sources"]) for x in consistency.terminology(g, r, most=3).orderBy("position").collect()] == [("zeta", ["s1", "s2"]), ("mid", ["s1"]), ("user", ["s1"])]
    order = spark.createDataFrame([("s1", 1), ("s2", 0)], "source_id string, ordinal int")
    assert [x["term"] for x in consistency.terminology(g, r, order, most=2).orderBy("position").collect()] == ["alpha", "zeta"]


def test_issues_concern_sources_by_the_substring_of_the_comparison(spark):
    ddl = "comparison_id string, ordinal int, source_a_id string, source_b_id string"
    issues = spark.createDataFrame([("intra_login2", 0, "login2", "login2"), ("b:srs_vs_manual", 0, "x", "login"), ("terminology", 0, "all_sources", "all_sources"), ("old_intra_x", 0, "q", "q")], ddl)
    sources = spark.createDataFrame([(s,) for s in ("login", "login2", "log", "x", "n2")], "source_id string")
    got = sorted((r["sid"], r["comparison_id"]) for r in consistency.relevant_issues(issues, sources).collect())
    rows = issues.collect()
    want = sorted((s["source_id"], r["comparison_id"]) for s in sources.collect() for r in rows if s["source_id"] in (r["source_a_id"], r["source_b_id"]) or r["source_a_id"] == "all_sources" or "intra_" + s["source_id"] in r["comparison_id"])
    assert got == want
    assert sorted((r["sid"], r["comparison_id"]) for r in consistency.relevant_issues(issues, sources, block=1).collect()) == want


def test_functional_requirements_are_asked_for_again_and_items_may_be_flat(spark, tmp_path):
    flat = {"tr_h": "The system shall x", "preconditions": ["p"], "stimuli": ["s"], "expected_outputs": ["o"], "source_req": "the need", "priority": "high"}
    client = Recorder(tmp_path / "log", {"tr_functional": lambda p: json.dumps([flat]) if "array only" in p else "I can't", "tr_nfr_constraint": json.dumps([flat])})
    items = spark.createDataFrame([("srcone", "functional", 0, "F", "f"), ("srcone", "nfr", 0, "N", "n")], ITEMS)
    issues = spark.createDataFrame([], schemas.ISSUE)
    got = pipeline.generate(items, issues, client).orderBy("ordinal").collect()
    assert [(r["tr_id"], r["source_req_ids"], r["tr_a"]["stimuli"], r["tr_a"]["priority"]) for r in got] == [("SRCONE-FUNC-001", ["the need"], ["s"], "high"), ("SRCONE-NFR_-002", ["the need"], ["s"], "high")]
    assert len(client.asked("tr_functional")) == 2


def test_constraints_are_asked_for_once(spark, tmp_path):
    from tessera.operators import demand

    rows = [("s", "srs", "constraint", c, None, 0.5, i) for i, c in enumerate(["within 5 seconds", "needs a disk"])]
    client = Recorder(tmp_path / "log", {"constraints": json.dumps({"nfr": [{"description": "fast"}], "runtime": [{"description": "disk"}, {"description": ""}]})})
    items = demand.demand_items(spark.createDataFrame(rows, schemas.ENTITY), client)
    assert sorted((r["field"], r["item_id"], r["text"]) for r in items.filter("field in ('nfr', 'runtime')").collect()) == [("nfr", "NFR-001", "fast"), ("runtime", "RT-001", "disk")]
    assert len(client.asked("constraints")) == 1
    assert {r["text"] for r in items.filter("field = 'role'").collect()} == {"User", "System"} and not client.asked("roles")
    assert demand.sizes(items).first().asDict() == {"source_id": "s", "objective": 0, "role": 2, "use_case": 0, "functional": 0, "nfr": 1, "runtime": 1, "exception": 0, "glossary": 0}


def test_repairs_carry_notes_and_fill_gaps(spark, tmp_path):
    answers = {
        "repair": json.dumps([{"tr_id": "T1", "tr_h": "new one", "stimuli": ["n"], "preconditions": ["p"], "expected_outputs": ["o"], "source_req": "R9"}, {"tr_id": "unknown", "tr_h": "x"}, {"tr_h": "by place", "tr_id": None}]),
        "gaps": json.dumps([{"tr_h": ""}, {"tr_h": "fills the gap", "preconditions": ["p"], "stimuli": ["s"], "expected_outputs": ["o"], "source_req": "missing item"}]),
    }
    client = Recorder(tmp_path / "log", answers)
    rows = spark.createDataFrame([requirement(0, tr_h="a"), requirement(1, tr_h="b"), requirement(2, tr_h="c"), requirement(3, tr_h="fine")], schemas.REQUIREMENT)
    reviewed = spark.createDataFrame([("s", ["T0", "T1", "T2"], ["first note", "second", "third", "fourth"], [f"missing item {i}" for i in range(9)])], "source_id string, flagged_tr_ids array<string>, correction_notes array<string>, uncovered array<string>")
    repair = pipeline.repair_with(client, PipelineConfig())
    got = {r["tr_id"]: r for r in repair(rows, reviewed, 0).collect()}
    assert {k: v["tr_h"] for k, v in got.items()} == {"T0": "a", "T1": "new one", "T2": "by place", "T3": "fine", "S-FIXD-1002": "fills the gap"}
    assert got["T1"]["tr_a"]["stimuli"] == ["n"] and got["T1"]["source_req_ids"] == ["R9"] and got["T1"]["category"] == "functional"
    assert got["S-FIXD-1002"]["ordinal"] > 3 and got["S-FIXD-1002"]["category"] == "functional"
    (p,) = client.asked("repair")
    assert "- T1 | functional | b" in p and "Issues to fix: first note; second; third" in p and "fourth" not in p
    (p,) = client.asked("gaps")
    assert p.count("- missing item") == 8
    assert "S-FIXD-1012" in {r["tr_id"] for r in repair(rows, reviewed, 1).collect()}


def test_faithfulness_resumes_and_skips(spark, tmp_path):
    from tessera.operators import judging

    rows = spark.createDataFrame([requirement(i, tr_h=f"statement {i}", ids=(" ",) if i == 3 else (f"need {i}", "")) for i in range(6)], schemas.REQUIREMENT)
    client = Recorder(tmp_path / "log", {"faithful": lambda p: "Unsupported." if "statement 0" in p else "hm" if "statement 1" in p else "ERROR: 500" if "statement 2" in p else "SUPPORTED"})
    done = spark.createDataFrame([("s", "T4", "PARTIALLY_SUPPORTED"), ("s", "T0", "ERROR: 1"), ("s", "T5", "SUPPORTED")], "source_id string, tr_id string, verdict string")
    got = {r["tr_id"]: (r["source"], r["verdict"]) for r in judging.faithfulness(rows, client, done, first=5).collect()}
    assert got == {"T0": ("need 0", "UNSUPPORTED"), "T1": ("need 1", "UNPARSEABLE:hm"), "T2": ("need 2", "ERROR: 500"), "T3": (None, "SKIPPED_NO_SOURCE"), "T4": ("need 4", "PARTIALLY_SUPPORTED")}
    assert len(client.asked("faithful")) == 3
    summary = {r["kind"]: (r["n"], r["share"]) for r in judging.summary(judging.faithfulness(rows, client, done, first=5)).collect()}
    assert summary == {"SUPPORTED": (0, 0.0), "PARTIALLY_SUPPORTED": (1, 0.2), "UNSUPPORTED": (1, 0.2), "UNPARSEABLE": (1, 0.2), "ERROR": (2, 0.4)}


def test_judged_scores_leave_failures_out(spark, tmp_path):
    from tessera.operators import judging

    rows = spark.createDataFrame([requirement(i, tr_h=f"statement {i}") for i in range(4)], schemas.REQUIREMENT)
    client = Recorder(tmp_path / "log", {"judge": lambda p: "ERROR: 500" if "statement 0" in p else "PASS PASS PASS PASS FAIL PASS PASS" if "statement 1" in p else "pass fail"})
    scores = judging.judged(rows, client)
    assert {r["tr_id"]: r["passes"] for r in scores.collect()} == {"T0": None, "T1": 5, "T2": 1, "T3": 1}
    m = judging.judged_metrics(scores, rows).first()
    assert (m["answered"], m["q_h_judge"], m["total_trs"], m["q_a"]) == (3, 0.333333, 4, 1.0)
    assert "preconditions: p" in client.asked("judge")[0]


def test_keywords_are_searched_until_met(spark):
    own = spark.createDataFrame([("a", ["abc", "zzz", "bcd"]), ("b", ["abc"]), (None, ["abc"])], "source_id string, keywords array<string>")
    texts = spark.createDataFrame([("a", "xABCDx"), ("a", None), (None, "abc"), ("c", "abc"), ("b", "ab c")] + [("a", "abcd")] * 500, "source_id string, text string").coalesce(1)
    assert sorted(tuple(r) for r in coverage._search(own, texts).collect()) == [("a", "abc"), ("a", "bcd")]


def test_sections_are_folded_in_bounded_batches(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    chunking.chunk(spark.createDataFrame([("d", "srs", 1, "r", "one two. " * 400)], schemas.SECTION))
    assert int(spark.conf.get(limit)) <= 16 << 20


def test_entities_of_sections_beyond_9999_keep_their_order(spark):
    sections = spark.createDataFrame([("d", "srs", k, "r", f"The system shall do {k}.") for k in (9999, 10000, 2)], schemas.SECTION)
    rows = demand.extract_entities(chunking.chunk(sections), M.RuleClient())
    assert [r["content"].split()[-1] for r in rows.orderBy("ordinal").collect()] == ["2.", "9999.", "10000."]


def test_entities_of_whole_chunks(spark, tmp_path):
    said = [f"The system shall do {k}." for k in range(100)]
    long = "The user " + "very " * 400 + "often shall wait for 5 seconds"  # no part holds it
    kinds = [("lines", "\n".join(said)), ("sentences", "  ".join(said)), ("one", f"{said[0]}\n{long}\n\n{said[1]}"), ("blank", " \n ")]
    sections = spark.createDataFrame([(name, "srs", 1, "r", text) for name, text in kinds], schemas.SECTION)
    rows = demand.extract_entities(chunking.chunk(sections), M.RuleClient()).orderBy("source_id", "ordinal").collect()
    got = {name: [r["content"] for r in rows if r["source_id"] == name] for name, _ in kinds}
    assert got == {"lines": said, "sentences": said, "one": [said[0], " ".join(long.split()[:20]), said[1]], "blank": []}
    assert [r["ordinal"] for r in rows if r["source_id"] == "lines"] == list(range(100))
    client = Recorder(tmp_path / "log", {})
    demand.extract_entities(chunking.chunk(sections), client).collect()
    asked = [p.split("\n\n", 1)[1] for p in client.asked("entities")]
    assert sorted(len(x) > 1200 for x in asked) == [False] * (len(asked) - 1) + [True] and "".join(sorted(asked)).count("shall do 99.") == 2


def test_a_single_prompt_for_a_whole_document(spark, tmp_path):
    from tessera.operators import judging

    item = {"tr_id": "B1", "tr_h": "The system shall stop", "tr_a": {"preconditions": ["p"], "stimuli": ["s"], "expected_outputs": ["o"], "coverage_criterion": "c"}}
    text = json.dumps([item, item | {"tr_id": "B2", "category": "poem"}, {k: v for k, v in item.items() if k != "tr_id"}, item | {"tr_id": "B3", "category": "runtime_environment"}])
    client = Recorder(tmp_path / "log", {"baseline": "```json\n" + text[:-1] + ', {"tr_id": "B4", "tr_'})
    sections = spark.createDataFrame([("d", "srs", 2, "r", "second " * 10), ("d", "srs", 1, "r", "first")], schemas.SECTION)
    rows = judging.baseline(sections, client, most_chars=20)
    assert [(r["tr_id"], r["category"], r["ordinal"]) for r in rows.orderBy("ordinal").collect()] == [("B1", "functional", 1), ("B3", "runtime_environment", 4)]
    assert client.asked("baseline")[0].endswith("\n\nfirst\n\nsecond second")
    m = judging.baseline_metrics(rows).first()
    assert (m["total_trs"], m["q_a"], m["traceability"], m["coverage"], m["duplicate_count"]) == (2, 1.0, 0.0, None, 1)


def test_a_document_longer_than_a_prompt_is_asked_about_whole(spark):
    from tessera.operators import judging

    said = [f"The system shall do {i}" for i in range(2400)]  # section 5 alone is longer than a prompt
    parts = [said[k : k + 100] for k in range(0, 400, 100)] + [said[400:]]
    sections = spark.createDataFrame([("d", "srs", k, "r", "\n".join(x)) for k, x in enumerate(parts, 1)] + [("e", "srs", 1, "r", said[0])], schemas.SECTION)
    sections = sections.unionByName(spark.createDataFrame([("f", "srs", 1, "r", "\n".join(said * 2))], schemas.SECTION))  # more than the whole limit
    for size in (100_000, 1_500):
        rows = judging.baseline(sections, M.RuleClient(), part_chars=size).orderBy("source_id", "ordinal").collect()
        assert [(r["source_id"], r["ordinal"], r["tr_id"], r["tr_h"]) for r in rows] == [("d", i, f"B-{i:03d}", x) for i, x in enumerate(said, 1)] + [("e", 1, "B-001", said[0])] + [("f", i, f"B-{i:03d}", x) for i, x in enumerate(said * 2, 1)]


def test_items_and_replies_of_a_corpus_are_never_broadcast(spark):
    from tessera.operators import judging

    sections = spark.createDataFrame([("d", "srs", 1, "r", "The system shall stop")], schemas.SECTION)
    prompts = spark.createDataFrame([("a", "roles", "- x")], "source_id string, kind string, prompt string")
    for rows in (judging.baseline(sections, M.RuleClient()), M.ask(prompts, M.RuleClient())):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_sections_of_every_format(spark, tmp_path):
    (tmp_path / "a.txt").write_text("INTRO\n" + "word " * 160 + "\n1.2 Scope here\n" + "text " * 10 + "\nLonely Heading\nNext Heading\nbody.\n")
    (tmp_path / "b.puml").write_text("@startuml\n' ---\nclass Account {\n name\n}\npackage Things {\n}\n")
    (tmp_path / "c.json").write_text(json.dumps({"openapi": "3", "info": {"title": "T"}, "paths": {"/x": {"get": {"summary": "s", "responses": {"200": {"description": "ok"}}}, "parameters": []}}, "components": {"schemas": {"P": {"properties": {"id": {"type": "int"}}}}}}))
    (tmp_path / "d.json").write_text("[1, {\"k\": 2}]")
    (tmp_path / "e.json").write_text("{broken")
    (tmp_path / "f.xml").write_text('<m xmlns:x="u"><p name="N" x:type="T"><q x:id="i">leaf</q></p><!-- c --></m>')
    (tmp_path / "g.docx").write_bytes(b"not a zip")
    (tmp_path / "h.bin").write_bytes(b"x")
    registry = S.LoaderRegistry()
    got = registry.load(spark, str(tmp_path), "srs").orderBy("source_id", "section_id").collect()
    by = {}
    for r in got:
        by.setdefault(r["source_id"], []).append((r["section_ref"], r["text"]))
    assert [ref for ref, _ in by["a"]] == ["INTRO", "1.2 Scope here"] and by["a"][1][1].endswith("body.")
    assert [ref for ref, _ in by["b"]] == ["puml:class Account {", "puml:package Things {"]
    assert [ref for ref, _ in by["c"]] == ["openapi:info", "openapi:path:/x", "openapi:schema:P"] and "    - 200: ok" in by["c"][1][1]
    assert [ref for ref, _ in by["d"]] == ["json:item:1", "json:item:2"] and by["e"] == [("json:raw", "{broken")]
    assert by["f"] == [("xml:p", "[p] name=N, kind=T\n[q:i] leaf")]
    (tmp_path / "i.PDF").write_bytes(b"%PDF")
    failed = registry.read(spark, str(tmp_path), "srs").filter("error is not null")
    assert sorted((r["source_id"], r["error"].split(":")[0]) for r in failed.collect()) == [("g", "BadZipFile"), ("i", "ValueError")]
    with pytest.warns(UserWarning, match="2 files"):
        registry.load(spark, str(tmp_path), "srs")
    assert registry.load_file(spark, str(tmp_path / "d.json"), "srs", "mine").select("source_id").distinct().collect()[0][0] == "mine"
    for name, error in (("h.bin", ValueError), ("i.PDF", ValueError), ("g.docx", ValueError), ("absent.txt", FileNotFoundError)):
        with pytest.raises(error):
            registry.load_file(spark, str(tmp_path / name), "srs")
    with pytest.raises(ValueError):
        S.files(spark, str(tmp_path), "poem")


def test_a_word_processor_file(spark, tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda text, style="": f"<w:p><w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    body = para("before") + para("First", "h1") + para("a") + para("") + para("b") + para("Second", "h2") + para("c")
    for name, xml in (("doc", body), ("plain", para("x") + para("") + para("y"))):
        with zipfile.ZipFile(tmp_path / f"{name}.docx", "w") as z:
            z.writestr("word/document.xml", f"<w:document {w}><w:body>{xml}</w:body></w:document>")
            z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="h1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="h2"><w:name w:val="heading 2"/></w:style></w:styles>')
    got = S.LoaderRegistry().load(spark, str(tmp_path), "srs").orderBy("source_id", "section_id").collect()
    assert [(r["section_ref"], r["text"]) for r in got if r["source_id"] == "doc"] == [("Preamble", "before"), ("H1: First", "a\nb"), ("H2: Second", "c")]
    assert [(r["section_id"], r["section_ref"], r["text"]) for r in got if r["source_id"] == "plain"] == [(1, "paragraph 1", "x"), (3, "paragraph 3", "y")]


def test_shrinking_joins_the_smallest_neighbours_first():
    def slow(sections, most):
        sections = [list(x) for x in sections]
        while len(sections) > most:
            size = [len(t.split()) for _, t in sections]
            i = min(range(len(sections) - 1), key=lambda k: size[k] + size[k + 1])
            sections[i : i + 2] = [[sections[i][0], sections[i][1] + "\n\n" + sections[i + 1][1]]]
        return sections

    import random

    rng = random.Random(1)
    for _ in range(60):
        rows = [[f"r{i}", "w " * rng.randrange(1, 6)] for i in range(rng.randrange(0, 25))]
        for most in (1, 4, 12):
            assert S.shrink([list(x) for x in rows], most) == slow(rows, most)


def test_spans_by_headings_or_pages(spark):
    ddl = "source_id string, artifact_type string, page int, pos int, size double, flags int, text string"
    rows = [("d", "srs", p, i, 20.0 if i == 0 else 10.0, 0, f"A heading of page {p}" if i == 0 else f"line {i}") for p in range(1, 5) for i in range(4)]
    rows += [("deck", "srs", p, i, 20.0, 0, "A large line of text") for p in (1, 2) for i in range(2)]
    got = S.span_sections(spark.createDataFrame(rows, ddl)).collect()
    assert sorted(r["section_ref"] for r in got if r["source_id"] == "deck") == ["page 1", "page 2"]
    assert sorted(r["section_ref"] for r in got if r["source_id"] == "d")[0] == "A heading of page 1 (p.1)"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "t1"), ("b", 1, "t2"), ("b", 2, "t3")], "source_id string, ordinal int, tr_id string")
    sinks.save(df, str(tmp_path / "t"))
    back = sinks.load(spark, str(tmp_path / "t"), "source_id string, ordinal int, tr_id string")
    assert back.count() == 3
    assert sinks.pending(df, back.filter("source_id = 'a'")).count() == 2 and sinks.pending(df, back, force=True).count() == 3
    assert sorted(r["tr_id"] for r in sinks.resume(df, df.filter("tr_id = 't2'"), 1).collect()) == ["t1"]
    assert "| a | 1 |" in reports.markdown("T", {"x": df.groupBy("source_id").count()})
    (tmp_path / "j.json").write_text(json.dumps([{"tr_id": "x", "kind": "high"}, {"tr_id": "y", "kind": "High"}, {"kind": "low"}, {"tr_id": "z"}]))
    assert [r["tr_id"] for r in sinks.load(spark, str(tmp_path / "j.json"), "tr_id string, kind string", True, {"kind": schemas.PRIORITIES}, ("tr_id",)).collect()] == ["x"]


def test_all_stages_offline(spark):
    text = "The user can log in with a password. The system shall lock the account within 15 minutes. Errors are shown when login failed. GET /login returns a token. It allows export of all reports. It provides search. The client must be fast."
    rows = [(s, "srs", 1, "r", text) for s in ("auth_srs", "auth_design")]
    bundle = spark.createDataFrame([("auth_srs", "auth"), ("auth_design", "auth")], "source_id string, bundle_id string")
    out = pipeline.run(spark.createDataFrame(rows, schemas.SECTION), M.RuleClient(), bundle)
    assert out.chunks.count() == 2 and out.entities.count() >= 6
    assert {"functional", "role", "objective"} <= {r["field"] for r in out.items.select("field").distinct().collect()}
    reviews = out.reviews.collect()
    assert len(reviews) == 2 and all(r["total_trs"] > 0 for r in reviews)
    assert out.requirements.groupBy("source_id", "tr_id").count().filter("count > 1").isEmpty()
    comparisons = out.issues.select("comparison_id").distinct()
    text = reports.report("Report", entities=out.entities, items=out.items, comparisons=comparisons, issues=out.issues, stage=out.requirements, final=out.requirements.filter("source_id = 'auth_srs'"), reviews=out.reviews)
    for part in ("## Stage 1", "## Stage 2", "## Stage 3", "## Stage 4", "## Stage 5", "## Summary", "## Metrics", "| auth_srs | srs |", "function_point: ", "documents passing all targets"):
        assert part in text
