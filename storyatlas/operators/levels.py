"""Nested names: the most specific part outside, broader ones in parentheses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import collapse, once, smart_case

# fixed values: words that together mark a qualifier, which is no level of its own
QUALIFIERS = (r"(?i)\b(?:GATED|PRIVATE)\b", r"(?i)COMM+UNITY")


def is_qualifier(part: Column) -> Column:
    found = part.rlike(QUALIFIERS[0])
    for pattern in QUALIFIERS[1:]:
        found = found & part.rlike(pattern)
    return found


def name_levels(name: Column | str) -> Column:
    """struct(admin_0, admin_1, admin_2), from the broadest to the most specific part of a nested name.

    Parts are ordered by how deep they stand in parentheses, and then as written; qualifiers don't
    count, unless nothing else is there.  Brackets that close nothing are skipped.
    """
    whole = collapse(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    tokens = F.regexp_extract_all(whole, F.lit(r"([()]|[^()]+)"), F.lit(1))

    def step(s: Column, token: Column) -> Column:
        depth = F.when(token == "(", s["depth"] + 1).when(token == ")", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        part = F.array(F.struct(depth.alias("depth"), F.size(s["parts"]).alias("at"), F.trim(token).alias("text")))
        plain = ~token.isin("(", ")") & (F.trim(token) != "")
        return F.struct(depth.alias("depth"), F.when(plain, F.concat(s["parts"], part)).otherwise(s["parts"]).alias("parts"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<struct<depth:int,at:int,text:string>>").alias("parts"))
    sorted_ = F.array_sort(F.aggregate(tokens, start, step)["parts"])
    texts = F.filter(F.transform(sorted_, lambda p: p["text"]), lambda t: ~is_qualifier(t))
    parts = F.transform(once(texts, lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(whole))), smart_case)
    levels = lambda p: F.struct(F.element_at(p, -1).alias("admin_0"), F.get(p, F.least(F.lit(1), F.size(p) - 1)).alias("admin_1"), F.get(p, F.lit(0)).alias("admin_2"))
    return once(parts, levels)
