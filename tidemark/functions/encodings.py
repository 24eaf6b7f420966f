"""Values of fitted models as Spark expressions.

A model is a struct<kind, coef array<double>, comps array<struct<f, a, p>>, dc, n>; x runs from 0
at the segment's first time to 1 at its last.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

MODEL = "struct<kind:string,coef:array<double>,comps:array<struct<f:double,a:double,p:double>>,dc:double,n:bigint,raw:array<float>>"


def position(t: Column, start: Column, end: Column) -> Column:
    return F.when(end > start, (t - start) / (end - start)).otherwise(F.lit(0.0))


def value_at(m: Column, x: Column) -> Column:
    """The model's value at x."""
    coef, comps, n = m["coef"], m["comps"], m["n"]
    poly = F.aggregate(F.reverse(coef), F.lit(0.0), lambda acc, c: acc * x + c)
    waves = F.aggregate(comps, m["dc"], lambda acc, c: acc + c["a"] * F.sin(2 * pi * c["f"] * x + c["p"]))
    harmonics = F.aggregate(comps, m["dc"], lambda acc, c: acc + c["a"] * F.cos(2 * pi * c["f"] * (x * (n - 1)) / n + c["p"]))
    place = F.round(x * (n - 1)).cast("int")
    return (
        F.when(m["kind"] == "constant", coef[0])
        .when(m["kind"] == "linear", coef[0] + x * (coef[1] - coef[0]))
        .when(m["kind"] == "polynomial", poly)
        .when(m["kind"].isin("sine", "multisine"), waves)
        .when(m["kind"] == "fourier", harmonics)
        .when(m["kind"] == "raw", F.element_at(m["raw"], place + 1).cast("double"))
    )


def model_bytes(m: Column) -> Column:
    """Estimated size of a stored model."""
    n = F.size(m["comps"])
    return (
        F.when(m["kind"] == "constant", 8)
        .when(m["kind"] == "linear", 16)
        .when(m["kind"] == "polynomial", 8 * F.size(m["coef"]) + 24)
        .when(m["kind"] == "fourier", 12 * n + 16)
        .when(m["kind"] == "multisine", 12 * n + 8)
        .when(m["kind"] == "sine", 16)
        .otherwise(4 * F.size(m["raw"]) + 16)
    )
