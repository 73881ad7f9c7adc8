"""Text functions as Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """White-space words; an empty array for blank text."""
    return F.filter(F.split(col(c), SPACE), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def trim_all(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def clean(c: Column | str) -> Column:
    """Runs of three or more line ends become two, lines lose trailing white space, the whole is trimmed."""
    folded = F.regexp_replace(col(c), r"\n{3,}", "\n\n")
    return trim_all(F.regexp_replace(folded, r"[^\S\n]+(?=\n|$)", ""))


def normal_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), SPACE, " "))


def token_set(c: Column | str) -> Column:
    return F.array_distinct(words(F.lower(col(c))))


def jaccard_sets(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of distinct tokens; 0 if either is empty."""
    a, b = col(a), col(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def jaccard(a: Column | str, b: Column | str) -> Column:
    return jaccard_sets(token_set(a), token_set(b))


def split_units(c: Column | str, unit: Column | str) -> Column:
    """Sentences, lines or bracketed elements, trimmed, without blanks."""
    c, unit = col(c), col(unit)
    parts = F.when(unit == "line", F.split(c, r"\R")).when(unit == "element", F.split(c, r"(?=\[)")).otherwise(F.split(c, r"(?<=[.!?])\s+"))
    return F.filter(F.transform(parts, trim_all), lambda x: x != "")


def bullets(items: Column | str, default: str = "(none)") -> Column:
    """A prompt's list: one "- item" a line."""
    items = col(items)
    return F.when(F.coalesce(F.size(items), F.lit(0)) == 0, F.lit(default)).otherwise(F.concat_ws("\n", F.transform(items, lambda x: F.concat(F.lit("- "), x))))


def chunk_id(source: Column | str, section: Column | str, index: Column | str) -> Column:
    return F.format_string("%s__s%04d__c%04d", col(source), col(section), col(index))


def nonblank(items: Column | str) -> Column:
    """Whether some element holds more than white space."""
    return F.coalesce(F.exists(col(items), lambda x: trim_all(x) != ""), F.lit(False))


def joined_source(first: Column | str, other: Column | str) -> Column:
    """Non-blank ids joined by " / ", of the second list if the first has none; else null."""

    def one(c: Column) -> Column:
        return F.nullif(F.concat_ws(" / ", F.filter(c, lambda x: trim_all(x) != "")), F.lit(""))

    return F.coalesce(one(col(first)), one(col(other)))
