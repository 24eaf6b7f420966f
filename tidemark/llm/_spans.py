"""Spans of pattern matches by DataFrame functions alone.

Texts are cut at the matches: the lengths of the pieces and matches before it give the place of
each match, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def located(text: Column, pattern: str, *groups: int) -> Column:
    """array<struct<start, end, value, g1, g2 ...>> of all matches, leftmost first, without overlap."""
    pieces = F.split(text, pattern, -1)
    found = F.arrays_zip(pieces.alias("piece"), matches(text, pattern).alias("value"), *[matches(text, pattern, g).alias(f"g{i}") for i, g in enumerate(groups, 1)])
    extra = [f"g{i}" for i in range(1, len(groups) + 1)]
    kind = "array<struct<start:int,end:int,value:string" + "".join(f",{g}:string" for g in extra) + ">>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), *[x[g].alias(g) for g in extra])
        return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

    walked = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: F.filter(acc["out"], lambda x: x["value"].isNotNull()))
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(kind))
