"""Column functions of the reference's scalar surface."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-case words; an underscore is part of a word."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def display_keywords(display_id: Column) -> Column:
    return F.coalesce(F.replace(display_id, F.lit("_"), F.lit(" ")), F.lit(""))


def term_id(role: Column) -> Column:
    """The last ten characters of an ontology role with ':' as '_'; null for other roles."""
    return F.when(F.contains(role, F.lit("identifiers.org")), F.translate(F.right(role, F.lit(10)), ":", "_"))


def clean_synonym(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("INSDC")), F.replace(text, F.lit("INSDC_qualifier:"), F.lit(""))).otherwise(text)


def type_suffix(sboltype: Column) -> Column:
    """What follows the first 48 characters; 'Region' goes only where lower-case 'region' occurs."""
    cut = F.substring(sboltype, 49, 1 << 20)
    return F.when(F.contains(cut, F.lit("region")), F.replace(cut, F.lit("Region"), F.lit(""))).otherwise(cut)


def normalise_sequence(text: Column, bases: str = "gatc") -> Column:
    return F.regexp_replace(F.lower(text), f"[^{bases}]+", "")


def kgrams(text: Column, k: int = 3) -> Column:
    """Distinct substrings of k characters; none for shorter or null texts."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a and b| / |a or b|; two empty sets have distance 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def clean_query(text: Column) -> Column:
    return F.trim(F.translate(text, "&'", " "))


def percent(text: Column) -> Column:
    return text.try_cast("double") / 100


def closed_bucket(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Histogram bin from 1 with the last bin closed."""
    return F.least(F.width_bucket(x, low, high, F.lit(bins)), F.lit(bins)).cast("bigint")
