"""Quality predicates of test requirements as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import col, nonblank, word_count

#: Patterns that must be equal for equal results (fixed values).
TRIGGER = r"\b(when|if|while|upon|on)\b"
SUBJECT = r"\bthe\s+\w+\s+shall\b"
SPECIFIC = r"\d+\s*(second|minute|hour|ms|percent|%|attempt|byte|kb|mb|gb)|http\s*[1-5]\d\d|\b(get|post|put|delete|patch|head|options)\b|/[a-z][a-z0-9_/{}-]+|\b\d{2,}\b"
UNTESTABLE = ("shall be good", "shall be nice", "shall be appropriate", "shall work properly", "shall function correctly")
#: What a failed criterion is called, in order (fixed values).
ISSUES = ("missing shall", "no trigger or subject", "vague expected output", "no preconditions", "no stimuli", "no measurable threshold or specific interface")
PASS_AT = 5


def criteria(tr_h: Column | str = "tr_h", tr_a: str = "tr_a") -> list[Column]:
    """The six structural criteria, each true or false."""
    h, a = F.coalesce(col(tr_h), F.lit("")), tr_a
    output = F.coalesce(F.concat_ws(" ", F.col(f"{a}.expected_outputs")), F.lit(""))
    return [
        F.contains(F.lower(h), F.lit("shall")),
        h.rlike(f"(?i){TRIGGER}") | h.rlike(f"(?i){SUBJECT}"),
        word_count(output) >= 4,
        nonblank(f"{a}.preconditions"),
        nonblank(f"{a}.stimuli"),
        F.concat(h, F.lit(" "), output).rlike(f"(?i){SPECIFIC}"),
    ]


def score(flags: list[Column]) -> Column:
    return sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))


def issues(flags: list[Column]) -> Column:
    return F.filter(F.array(*[F.when(~f, F.lit(name)) for f, name in zip(flags, ISSUES, strict=True)]), lambda x: x.isNotNull())


def untestable(tr_h: Column | str = "tr_h") -> Column:
    return F.lower(col(tr_h)).rlike("|".join(UNTESTABLE))


def traceable(tr_a: str = "tr_a") -> Column:
    return nonblank(f"{tr_a}.source_req_ids")


def complete(tr_a: str = "tr_a") -> Column:
    """Three non-empty lists (blank strings count) and a coverage criterion."""
    some = [F.coalesce(F.size(f"{tr_a}.{c}"), F.lit(0)) > 0 for c in ("preconditions", "stimuli", "expected_outputs")]
    return some[0] & some[1] & some[2] & (F.coalesce(F.col(f"{tr_a}.coverage_criterion"), F.lit("")) != "")


def verdict(raw: Column | str) -> Column:
    """The longest label that the reply holds; what holds none is unparseable."""
    up = F.upper(col(raw))
    out = F.concat(F.lit("UNPARSEABLE:"), F.substring(col(raw), 1, 60))
    for label in ("SUPPORTED", "UNSUPPORTED", "PARTIALLY_SUPPORTED"):
        out = F.when(F.contains(up, F.lit(label)), F.lit(label)).otherwise(out)
    return F.when(F.startswith(col(raw), F.lit("ERROR:")), col(raw)).otherwise(out)


def verdict_class(v: Column | str) -> Column:
    v = col(v)
    return F.when(v.isin("SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED"), v).when(v.startswith("UNPARSEABLE"), F.lit("UNPARSEABLE")).otherwise(F.lit("ERROR"))


def passes_in(reply: Column | str) -> Column:
    """How many of a reply's first six words begin with PASS."""
    first = F.slice(F.split(F.trim(F.upper(col(reply))), r"\s+"), 1, 6)
    return F.size(F.filter(first, lambda w: w.startswith("PASS")))
