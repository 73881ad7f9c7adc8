"""Model-backed steps: prompts from capped lists, a replaceable client, a table of replies.

Any object with `reply(kind, prompt) -> str` is a client. `RuleClient` answers from the prompt's own
list by fixed rules, so the pipeline runs offline; `HttpClient` streams from a chat server. Replies are written once
and looked up by the prompt's hash, so a step is never asked twice and never differs between reads.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.positions import ordered
from tessera.plans.storage import bound_batches, delete, exists, materialize, release, scratch_path
from tessera.schemas import ASKED_TYPES


#: Kinds of entity that the offline client tells, by the first pattern that a sentence matches.
ENTITY_RULES = (
    ("constraint", r"\b(must|shall not|within|at most|at least|\d+ ?(?:ms|seconds|minutes))\b"),
    ("exception_condition", r"\b(error|fail\w*|invalid|denied|timeout)\b"),
    ("actor_role", r"\b(user|administrator|operator|client)\b"),
    ("interface_name", r"(?:GET|POST|PUT|DELETE) /\S+"),
    ("function_point", r"\b(shall|can|allows?|provides?)\b"),
)


class ModelClient(Protocol):
    def reply(self, kind: str, prompt: str) -> str: ...


@dataclass(frozen=True)
class RuleClient:
    """Answers each kind of prompt from the lines of its lists."""

    def reply(self, kind: str, prompt: str) -> str:
        items = [re.sub(r"^\[[^\]]*\] ", "", x[2:].strip()) for x in prompt.splitlines() if x.startswith("- ") and x[2:].strip()]
        if kind == "entities":
            text = prompt.split("\n\n", 1)[-1]
            out = []
            for s in re.split(r"(?<=[.!?])\s+|\n", text):
                for name, pattern in ENTITY_RULES:
                    if re.search(pattern, s, re.I):
                        out.append({"entity_type": name, "content": " ".join(s.split()[:20]), "confidence_score": 0.8})
                        break
            return json.dumps(out)
        if kind == "roles":
            return json.dumps(list(dict.fromkeys(items)))
        if kind == "use_cases":
            return json.dumps([{"goal": x, "steps": [x]} for x in items])
        if kind == "functional_reqs":
            return json.dumps([{"description": x if "shall" in x.lower() else f"The system shall {x[:1].lower()}{x[1:]}"} for x in items])
        if kind == "constraints":
            timed = [bool(re.search(r"\d", x)) for x in items]
            return json.dumps({"nfr": [{"description": x, "category": "performance"} for x, t in zip(items, timed, strict=True) if t], "runtime": [{"description": x} for x, t in zip(items, timed, strict=True) if not t]})
        if kind.startswith("check"):
            return json.dumps([{"issue_type": "ambiguity", "description": x} for x in items if re.search(r"\b(appropriate|fast|easy|etc|some)\b", x, re.I)])
        if kind == "repair":
            parts = [x.split(" | ", 2) for x in items]
            return json.dumps([{"tr_id": p[0], "tr_h": f"When requested, the system shall satisfy: {p[-1]}", "preconditions": ["the system is running"], "stimuli": [p[-1]], "expected_outputs": ["observable result within 10 seconds"], "coverage_criterion": "each item once", "source_req": p[0]} for p in parts])
        if kind == "baseline":
            said = [s for s in re.split(r"(?<=[.!?])\s+|\n", prompt.split("\n\n", 1)[-1]) if "shall" in s.lower()]
            return json.dumps([{"tr_id": f"B-{i:03d}", "tr_h": s.strip(), "tr_a": {"preconditions": [], "stimuli": [s.strip()], "expected_outputs": [s.strip()]}} for i, s in enumerate(said, 1)])
        if kind.startswith("tr_") or kind == "gaps":
            return json.dumps([{"tr_h": f"When requested, the system shall satisfy: {x}", "tr_a": {"preconditions": ["the system is running"], "stimuli": [x], "expected_outputs": [f"observable result within 10 seconds for {x[:40]}"]}, "coverage_criterion": "each item once", "priority": "medium", "source_req_ids": [f"REQ-{i:03d}"]} for i, x in enumerate(items, 1)])
        if kind == "judge":
            part = {k: v.strip() for k, v in (x.split(":", 1) for x in prompt.splitlines() if ":" in x)}
            h, out = part.get("TR-H", "").lower(), part.get("expected_outputs", "")
            some = lambda k: part.get(k, "") not in ("", "(none)")
            found = ("shall" in h, h.split(" ")[0] in ("when", "if", "upon", "the"), len(out.split()) > 3, some("preconditions"), some("stimuli"), bool(re.search(r"\d", h + out)))
            return " ".join("PASS" if x else "FAIL" for x in found)
        if kind == "faithful":
            a, b = (set(x.lower().split()) for x in (prompt.split("\n")[:2] + ["", ""])[:2])
            share = len(a & b) / max(1, len(b))
            return "SUPPORTED" if share > 0.6 else "PARTIALLY_SUPPORTED" if share > 0.2 else "UNSUPPORTED"
        return "[]"


@dataclass(frozen=True)
class HttpClient:
    """A chat server that streams one JSON object a line."""

    host: str
    model: str
    temperature: float = 0.0
    max_tokens: int = 800
    timeout: float = 600.0
    attempts: int = 3

    def check(self) -> None:
        """The server must know the model (tags after the colon may differ)."""
        with urllib.request.urlopen(f"{self.host}/api/tags", timeout=10) as r:
            names = [m.get("name", "") for m in json.load(r).get("models", [])]
        if self.model.split(":")[0] not in {n.split(":")[0] for n in names}:
            raise ConnectionError(f"no model {self.model} at {self.host}")

    def reply(self, kind: str, prompt: str) -> str:
        body = json.dumps({"model": self.model, "stream": True, "messages": [{"role": "user", "content": prompt}], "options": {"temperature": self.temperature, "num_predict": self.max_tokens}}).encode()
        for attempt in range(self.attempts):
            try:
                out = []
                with urllib.request.urlopen(urllib.request.Request(f"{self.host}/api/chat", body, {"Content-Type": "application/json"}), timeout=self.timeout) as r:
                    for line in r:
                        try:
                            part = json.loads(line)
                        except ValueError:
                            continue
                        out.append(part.get("message", {}).get("content", ""))
                        if part.get("done"):
                            break
                return "".join(out)
            except urllib.error.HTTPError as e:
                if e.code not in (500, 502, 503) or attempt + 1 == self.attempts:
                    return f"ERROR: {e.code}"
                time.sleep(2 * (attempt + 1))
            except OSError as e:
                return f"ERROR: {e}"
        return "ERROR: no reply"


def _replied(prompts: DataFrame, client: ModelClient) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"prompt_id": pdf["prompt_id"], "reply": [client.reply(k, p) for k, p in zip(pdf["kind"], pdf["prompt"], strict=True)]})

    bound_batches(prompts.sparkSession)
    return prompts.select("prompt_id", "kind", "prompt").mapInPandas(run, "prompt_id string, reply string")


def ask(prompts: DataFrame, client: ModelClient, known: DataFrame | None = None, saved_at: str | None = None, per_batch: int = 1000, most_batches: int = 1000) -> DataFrame:
    """prompts (…, kind, prompt) with reply. Prompts in `known` (prompt_id, reply) aren't sent; equal prompts are sent once.

    With `saved_at`, replies are committed below that path batch by batch, `per_batch` prompts or a thousandth of all at a time: whatever ends the run
    loses the batch it was in at most, and the next run with the same path asks for the rest, and again where the reply was an error.
    """
    keyed = prompts.withColumn("prompt_id", F.sha2(F.concat_ws("\x00", "kind", "prompt"), 256))
    new = keyed.select("prompt_id", "kind", "prompt").dropDuplicates(["prompt_id"])
    if known is not None:
        new = new.join(known, "prompt_id", "left_anti")
    if saved_at is None:
        replies = materialize(_replied(new, client), "replies")
    else:
        _ask_in_batches(new, client, saved_at, per_batch, most_batches)
        replies = saved_replies(prompts.sparkSession, saved_at)
    if known is not None:
        replies = replies.unionByName(known.select("prompt_id", "reply"))
    return keyed.join(replies.hint("merge"), "prompt_id")  # replies that look small as compressed files aren't broadcast


def saved_replies(spark: SparkSession, path: str, with_errors: bool = True) -> DataFrame:
    """prompt_id, reply of what `ask` has saved: of several replies to a prompt the latest that is no error."""
    rows = spark.read.schema("prompt_id string, reply string, at timestamp").parquet(path) if exists(spark, path) else spark.createDataFrame([], "prompt_id string, reply string, at timestamp")
    fine = ~F.startswith("reply", F.lit("ERROR:"))
    return (rows if with_errors else rows.filter(fine)).groupBy("prompt_id").agg(F.max_by("reply", F.struct(fine, "at", "reply")).alias("reply"))


def _ask_in_batches(prompts: DataFrame, client: ModelClient, path: str, per_batch: int, most_batches: int) -> None:
    spark = prompts.sparkSession
    left = prompts.join(saved_replies(spark, path, False).select("prompt_id"), "prompt_id", "left_anti")
    placed = ordered(left, ["prompt_id"], "to-ask")
    last = placed.agg(F.max("place").alias("n")).first()["n"]
    if last is None:
        return release(placed)
    size = max(per_batch, -(-(last + 1) // most_batches))
    cut = scratch_path(spark, "batches")
    placed.withColumn("batch", F.floor(F.col("place") / size)).write.partitionBy("batch").parquet(cut)
    release(placed)
    for k in range(last // size + 1):  # each batch is a job of its own
        part = spark.read.schema("prompt_id string, kind string, prompt string").parquet(f"{cut}/batch={k}")
        spread = part.repartition(min(size, spark.sparkContext.defaultParallelism))
        _replied(spread, client).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
    delete(spark, cut)


def prompts(lists: DataFrame, kind: str, task: str, keys: list[str], text: str = "text", order: str = "ordinal") -> DataFrame:
    """One prompt per group from its list; groups without items get none, so the model isn't called for them."""
    items = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    g = lists.filter(F.trim(text) != "").groupBy(*keys).agg(items.alias("items"))
    return g.select(*keys, F.lit(kind).alias("kind"), F.concat(F.lit(task + "\n"), T.bullets("items")).alias("prompt"))


def entity_prompts(chunks: DataFrame, most_chars: int = 1200) -> DataFrame:
    """Prompts that ask about the whole of each chunk, with the types asked for by kind of document: one for each part of 1200 characters at most.

    Parts end behind a line or a sentence, so none is divided: one that is longer than a part has a prompt of its own.
    """
    types = F.create_map(*[F.lit(x) for k, v in ASKED_TYPES.items() for x in (k, ", ".join(v))])
    task = F.concat(F.lit("List the entities of this text as a JSON array with entity_type, content, confidence_score. Types: "), types[F.col("artifact_type")])
    end = r"(?:(?<=\n|[.!?]\s)|\z)"
    parts = F.regexp_extract_all("content", F.lit(rf"(?s).{{1,{most_chars}}}{end}|.+?{end}"), F.lit(0))
    rows = chunks.select("metadata.section_id", "metadata.chunk_index", "chunk_id", "source_id", "artifact_type", "page_ref", task.alias("task"), F.posexplode(parts).alias("part", "text"))
    return rows.filter(T.trim_all("text") != "").select("*", F.lit("entities").alias("kind"), F.concat("task", F.lit("\n\n"), "text").alias("prompt")).drop("task", "text")


def health(reply: F.Column | str) -> F.Column:
    """What a probe's reply looks like: corrupt, json or text."""
    c = T.col(reply)
    corrupt = c.rlike(r"(.)\1{15,}|\x{FFFD}|<unk>")
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit("empty")).when(corrupt, F.lit("corrupt")).when(F.try_parse_json(F.trim(c)).isNotNull(), F.lit("json")).otherwise(F.lit("text"))
