"""Judged quality: faithfulness to the source, the six criteria by a model, and requirements from a single prompt."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import PipelineConfig
from tessera.functions import quality as Q
from tessera.functions import replies as R
from tessera.functions import text as T
from tessera.operators import model as M
from tessera.operators import reports, requirements, review
from tessera.plans.storage import bound_batches, materialize


def _line(c) -> F.Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")


def faithfulness(rows: DataFrame, client: M.ModelClient, done: DataFrame | None = None, first: int = 30, saved_at: str | None = None) -> DataFrame:
    """source_id, ordinal, tr_id, tr_h, source, verdict of the first rows of each source.

    The window is fixed before anything else. Good verdicts in `done` (source_id, tr_id, verdict) stay; others are asked for again. Rows that
    name no source are skipped. With `saved_at` verdicts are saved while running and resumed from there (see `model.ask`).
    """
    window = rows.withColumn("n", F.row_number().over(W.partitionBy("source_id").orderBy("ordinal"))).filter(F.col("n") <= first)
    window = window.select("source_id", "ordinal", "tr_id", "tr_h", T.joined_source("source_req_ids", "tr_a.source_req_ids").alias("source"))
    kept = None
    if done is not None:
        good = done.filter(Q.verdict_class("verdict").isin("SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED")).select("source_id", "tr_id", "verdict").dropDuplicates(["source_id", "tr_id"])
        kept = window.join(good, ["source_id", "tr_id"])
        window = window.join(good, ["source_id", "tr_id"], "left_anti")
    task = "Does the second text only say what the first one says or implies? Answer SUPPORTED, PARTIALLY_SUPPORTED (it adds a detail) or UNSUPPORTED."
    asked = window.filter("source is not null").withColumns({"kind": F.lit("faithful"), "prompt": F.concat_ws("\n", _line("source"), _line("tr_h"), F.lit(task))})
    columns = ["source_id", "ordinal", "tr_id", "tr_h", "source", "verdict"]
    out = M.ask(asked, client, saved_at=saved_at).withColumn("verdict", Q.verdict("reply")).select(columns)
    out = out.unionByName(window.filter("source is null").withColumn("verdict", F.lit("SKIPPED_NO_SOURCE")).select(columns))
    return out if kept is None else out.unionByName(kept.select(columns))


def judged(rows: DataFrame, client: M.ModelClient, saved_at: str | None = None) -> DataFrame:
    """source_id, ordinal, tr_id, passes: of the six criteria, by the model; null where it failed to answer."""
    part = lambda c: F.coalesce(F.nullif(F.concat_ws(", ", f"tr_a.{c}"), F.lit("")), F.lit("(none)"))
    task = "Answer PASS or FAIL for each: has shall; trigger or subject; expected output of four words; a precondition; a stimulus; something measurable. Six words, nothing else."
    prompt = F.concat_ws("\n", F.lit(task), F.concat(F.lit("TR-H: "), "tr_h"), *[F.concat(F.lit(f"{c}: "), part(c)) for c in ("preconditions", "stimuli", "expected_outputs")])
    asked = rows.select("source_id", "ordinal", "tr_id", F.lit("judge").alias("kind"), prompt.alias("prompt"))
    passes = F.when(~F.startswith("reply", F.lit("ERROR:")), Q.passes_in("reply"))
    return M.ask(asked, client, saved_at=saved_at).select("source_id", "ordinal", "tr_id", passes.alias("passes"))


def judged_metrics(scores: DataFrame, rows: DataFrame) -> DataFrame:
    """Per source: q_h by the model (the share with five passes or more of those answered, 0 if none was), the other metrics by rule."""
    valid = F.count("passes")
    by_model = scores.groupBy("source_id").agg(valid.alias("answered"), F.coalesce(F.round(F.try_divide(F.count_if(F.col("passes") >= Q.PASS_AT), valid), 6), F.lit(0.0)).alias("q_h_judge"))
    by_rule = review.metrics(review.flags(rows), rows).select("source_id", "total_trs", "q_a", "traceability")
    return by_rule.join(by_model, "source_id", "left")


def salvaged(replies: DataFrame, keys: list[str]) -> DataFrame:
    """keys, p, item: the objects of each reply's array, of a truncated one those before the break."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            rows = [(*r[:-1], p, json.dumps(x)) for r in pdf.itertuples(index=False) for p, x in enumerate(R.salvage(r[-1]))]
            yield pd.DataFrame(rows, columns=[*keys, "p", "item"])

    frame = replies.select(*keys, R.without_fences("reply").alias("reply"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.drop("reply").schema)
    bound_batches(frame.sparkSession)
    return frame.mapInPandas(run, f"{fields}, p int, item string").withColumn("item", F.try_parse_json("item"))


def _in_parts(sections: DataFrame, part_chars: int) -> DataFrame:
    """source_id, part, text: a document's sections in order, in parts of at most `part_chars` characters; what fits into one isn't divided.

    Parts end between sections, or at a line end within one that is longer than half of a part.
    """
    half = max(part_chars // 2, 1)
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{half}}}(?:\n|\\z)|.{{1,{half}}}"), F.lit(0))
    cut = F.when(F.length("text") > half, pieces).otherwise(F.array("text"))
    rows = sections.select("source_id", "section_id", F.posexplode(cut).alias("k", "text")).withColumn("n", F.length("text") + 2)
    source, before = W.partitionBy("source_id"), W.partitionBy("source_id").orderBy("section_id", "k", "text").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"start": F.coalesce(F.sum("n").over(before), F.lit(0)), "all": F.sum("n").over(source)})
    rows = rows.withColumn("part", F.when(F.col("all") - 2 <= part_chars, F.lit(0)).otherwise(F.floor(F.col("start") / (half + 2))).cast("int"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("section_id", "k", "text"))), lambda x: x["text"])
    return rows.groupBy("source_id", "part").agg(F.array_join(texts, "\n\n").alias("text"))


def baseline(sections: DataFrame, client: M.ModelClient, most_chars: int | None = None, part_chars: int = 100_000) -> DataFrame:
    """Requirements from one prompt per document, without the stages between. Items without an id or with an unknown category are dropped.

    The whole document is asked about: one longer than `part_chars` in several prompts, whose items are numbered on, as are
    the numbers at the end of their ids. With `most_chars` only so many characters of each document are.
    """
    if most_chars is not None:
        texts = F.transform(F.sort_array(F.collect_list(F.struct("section_id", "text"))), lambda x: x["text"])
        docs = sections.groupBy("source_id").agg(F.substring(F.array_join(texts, "\n\n"), 1, most_chars).alias("text")).withColumn("part", F.lit(0))
    else:
        docs = _in_parts(sections, part_chars)
    task = "Write test requirements for this document as a JSON array (tr_id, category, tr_h, tr_a)."
    asked = docs.select("source_id", "part", F.lit("baseline").alias("kind"), F.concat(F.lit(task + "\n\n"), "text").alias("prompt"))
    found = materialize(salvaged(M.ask(asked, client), ["source_id", "part"]), "baseline")
    # a window over the few parts of a source, not over their items
    parts = found.groupBy("source_id", "part").agg(F.count("*").alias("n"))
    first = parts.select("source_id", "part", F.coalesce(F.sum("n").over(W.partitionBy("source_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    item = F.col("item")
    # sizes are estimated far too low behind a variant, so the items would be broadcast
    each = found.join(first.hint("merge"), ["source_id", "part"])
    own = R.field(item, "tr_id")
    number = F.regexp_extract(own, r"(\d{1,9})$", 1)
    later = (F.col("first") + F.nullif(number, F.lit("")).cast("long")).cast("string")
    own = F.when((F.col("first") > 0) & (number != ""), F.concat(F.substr(own, F.lit(1), F.length(own) - F.length(number)), F.lpad(later, F.greatest(F.length(number), F.length(later)), F.lit("0")))).otherwise(own)
    each = each.withColumns({"tr_id": own, "category": R.in_domain(R.field(item, "category", "functional"), schemas.TR_CATEGORIES), "ordinal": (F.col("first") + F.col("p") + 1).cast("int")})
    each = each.filter("tr_id is not null and category is not null")
    return requirements.shaped(requirements.parsed(each, ["source_id", "ordinal", "tr_id", "category"]))


def baseline_metrics(rows: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """As a review, but for coverage, which needs a demand model."""
    f = review.flags(rows)
    pairs = review.duplicates(rows, config).groupBy("source_id").agg(F.count("*").alias("duplicate_count"))
    bad = f.groupBy("source_id").agg(F.count_if("untestable").alias("untestable_count"))
    out = review.metrics(f, rows).select("source_id", "total_trs", "q_h", "q_a", "traceability", F.lit(None).cast("double").alias("coverage"))
    return out.join(bad, "source_id", "left").join(pairs, "source_id", "left").fillna(0, ["duplicate_count", "untestable_count"])


summary = reports.verdict_summary
