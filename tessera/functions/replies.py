"""Lenient parsing of model replies."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import col


def without_fences(c: Column | str) -> Column:
    """Without the lines that begin with a code fence."""
    return F.regexp_replace(col(c), r"(?m)^\s*```.*\R?", "")


def bracketed(c: Column | str, kind: str = "[") -> Column:
    """From the first opening to the last closing bracket; empty if there are none."""
    return F.regexp_extract(col(c), r"(?s)(\[.*\])" if kind == "[" else r"(?s)(\{.*\})", 1)


def reply_items(c: Column | str) -> Column:
    """The elements of a reply's array as variants; an empty array if it can't be parsed or isn't an array."""
    raw = bracketed(without_fences(c))
    whole = F.try_parse_json(raw)
    return F.coalesce(F.try_variant_get(whole, "$", "array<variant>"), F.array().cast("array<variant>"))


def field(item: Column, name: str, default: str | None = None) -> Column:
    """A text field of a variant: null if it is of another kind, the default if it is missing."""
    value = F.try_variant_get(item, f"$.{name}", "variant")
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(item, f"$.{name}", "string"))
    return F.when(value.isNull(), F.lit(default)).otherwise(text)


def in_domain(c: Column, domain: tuple[str, ...], lenient: bool = False) -> Column:
    """The value if the domain holds it (in any case if lenient), else null: such rows are dropped."""
    c = F.lower(c) if lenient else c
    return F.when(c.isin(*domain), c)


def salvage(raw: str | None) -> list:
    """The objects of an array; of a truncated one those before the break."""
    text = raw or ""
    start = text.find("[")
    if start < 0:
        return []
    try:
        found = json.loads(text[start : text.rfind("]") + 1])
        return found if isinstance(found, list) else []
    except ValueError:
        pass
    decoder, out, at = json.JSONDecoder(), [], start + 1
    while (at := text.find("{", at)) >= 0:
        try:
            item, at = decoder.raw_decode(text, at)
        except ValueError:
            break
        out.append(item)
    return out
