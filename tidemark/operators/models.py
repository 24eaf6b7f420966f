"""Model mode: blocks of points as fitted models that are evaluated on reads.

Points are cut into segments of ``capacity`` in arrival order within a series, each segment is
fitted by one task call, and reads evaluate the models with DataFrame functions. With residuals
kept, reads give the stored values back.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import encodings

# What the fits may cost and how far off they may be.
MAX_DEGREE, POLY_ERROR = 9, 1e-3
MAX_HARMONICS, ENERGY = 20, 0.99
MIN_RATIO = 2.0
MAX_WAVE_ERROR = 0.1  # of the variance; worse waves give way to the raw samples


def cut(points: DataFrame, capacity: int) -> DataFrame:
    """Add segment_id: every ``capacity`` points of a series in the order of seq.

    Rows are ranked within bins of seq first: a bin's rank begins where the bins before it end. Where
    numbers run on, as ``Database`` gives them, bins are full and no series is sorted in one task.
    """
    bins = points.withColumn("__bin", F.expr(f"cast(seq as long) div {64 * capacity}L"))
    n = bins.groupBy("series", "__bin").count()
    before = Window.partitionBy("series").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("series", "__bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("series", "__bin").orderBy("seq")
    ranked = bins.join(n, ["series", "__bin"]).withColumn("__rank", F.col("__first") + F.row_number().over(inside) - 1)
    return ranked.withColumn("segment_id", F.expr(f"__rank div {capacity}L")).drop("__bin", "__first", "__rank")


@lru_cache(maxsize=64)
def _basis(n: int) -> np.ndarray:
    """Orthonormal polynomials of degree 0, 1 ... on the grid of n samples, a column each."""
    x = np.linspace(-1.0, 1.0, n)
    return np.linalg.qr(np.polynomial.legendre.legvander(x, min(MAX_DEGREE, n - 1)))[0]


def _candidates(v: np.ndarray) -> list[dict]:
    """Models that describe the samples, each with its size and relative error."""
    n, spread = len(v), float(v.max() - v.min())
    x = np.arange(n) / max(1, n - 1)
    out = []
    if np.abs(v - v[0]).max() < 1e-10:
        return [{"kind": "constant", "coef": [float(v[0])], "size": 8, "error": 0.0}]
    line = v[0] + x * (v[-1] - v[0])
    if spread > 0 and np.abs(v - line).max() / spread < 0.01:
        out.append({"kind": "linear", "coef": [float(v[0]), float(v[-1])], "size": 16, "error": float(np.abs(v - line).max() / spread)})
    var = float(v.var())
    # what each degree leaves over, by an orthonormal basis of the grid; only the first that is good enough is fitted
    part = _basis(n).T @ (v - v.mean())
    left = 1 - np.cumsum(part**2) / (n * var)
    for degree in np.flatnonzero(left <= POLY_ERROR * (1 + 1e-6)).tolist():
        if degree < 2:
            continue
        c = np.polynomial.polynomial.polyfit(x, v, degree)
        error = float(((np.polynomial.polynomial.polyval(x, c) - v) ** 2).mean() / var)
        if error <= POLY_ERROR:
            out.append({"kind": "polynomial", "coef": c.tolist(), "size": 8 * len(c) + 24, "error": error})
            break
    if n >= 4:
        spec = np.fft.rfft(v) / n
        amp, phase = np.abs(spec), np.angle(spec)
        amp[1 : (n + 1) // 2] *= 2
        power = amp[1:] ** 2
        order = np.argsort(-power)[:MAX_HARMONICS]
        few = order[: int(np.searchsorted(np.cumsum(power[order]), ENERGY * power.sum())) + 1] + 1
        i = np.arange(n)
        fit = amp[0] * np.cos(phase[0]) + sum(amp[k] * np.cos(2 * np.pi * k * i / n + phase[k]) for k in few)
        comps = [{"f": float(k), "a": float(amp[k]), "p": float(phase[k])} for k in few]
        error = float(((fit - v) ** 2).mean() / var)
        dc = float(amp[0] * np.cos(phase[0]))
        if error < MAX_WAVE_ERROR:
            out.append({"kind": "fourier", "comps": comps, "dc": dc, "size": 12 * len(comps) + 16, "error": error})
        if n >= 8 and len(power):
            k = int(order[0]) + 1
            # x runs to 1 at the last sample, so a frequency of k per n samples is k (n - 1) / n per segment
            sine = {"f": k * (n - 1) / n, "a": float(amp[k]), "p": float(phase[k] + np.pi / 2)}
            one = dc + sine["a"] * np.sin(2 * np.pi * sine["f"] * x + sine["p"])
            rel = float(((one - v) ** 2).mean() / var)
            if rel < MAX_WAVE_ERROR:
                out.append({"kind": "sine", "comps": [sine], "dc": dc, "size": 16, "error": rel})
    return out


def best_model(v: np.ndarray) -> dict:
    """The candidate of best compression ratio over 1 + 100 * error; the raw samples below a ratio of 2."""
    best, top = None, 0.0
    for c in _candidates(v):
        ratio = 4 * len(v) / c["size"]
        if ratio >= MIN_RATIO and ratio / (1 + 100 * c["error"]) > top:
            best, top = c, ratio / (1 + 100 * c["error"])
    best = best or {"kind": "raw", "raw": v.astype(np.float32).tolist()}
    return {"kind": best["kind"], "coef": best.get("coef", []), "comps": best.get("comps", []), "dc": best.get("dc", 0.0), "n": len(v), "raw": best.get("raw", [])}


def evaluated(m: dict, x: np.ndarray) -> np.ndarray:
    """The model's values, as ``encodings.value_at`` gives them."""
    if m["kind"] == "constant":
        return np.full(len(x), m["coef"][0])
    if m["kind"] == "linear":
        return m["coef"][0] + x * (m["coef"][1] - m["coef"][0])
    if m["kind"] == "polynomial":
        return np.polynomial.polynomial.polyval(x, m["coef"])
    if m["kind"] == "raw":
        return np.array(m["raw"])[np.floor(x * (m["n"] - 1) + 0.5).astype(int)]
    n = m["n"]
    if m["kind"] == "fourier":
        return m["dc"] + sum(c["a"] * np.cos(2 * np.pi * c["f"] * x * (n - 1) / n + c["p"]) for c in m["comps"])
    return m["dc"] + sum(c["a"] * np.sin(2 * np.pi * c["f"] * x + c["p"]) for c in m["comps"])


def fitted(points: DataFrame, capacity: int = 1000, lossless: bool = False) -> DataFrame:
    """Segments of (series, t, v, seq). A segment's samples, ``capacity`` at most, travel as one array.

    With ``lossless`` the residual of each sample is kept in double precision, so that model and
    residual give the stored single back exactly.
    """

    @F.pandas_udf(f"model {encodings.MODEL}, residual array<double>")
    def fit(values: pd.Series) -> pd.DataFrame:
        models, rests = [], []
        for x in values:
            v = np.asarray(x, float)
            models.append(best_model(v))
            rests.append((v - evaluated(models[-1], np.arange(len(v)) / max(1, len(v) - 1))).tolist() if lossless else None)
        return pd.DataFrame({"model": models, "residual": rests})

    rows = cut(points.withColumn("seq", F.col("seq").cast("long")), capacity)
    each = rows.groupBy("series", "segment_id").agg(F.array_sort(F.collect_list(F.struct("t", "seq", "v"))).alias("p"))
    s = each.select("series", "segment_id", "p", fit("p.v").alias("f"))
    n = F.size("p").cast("long")
    s = s.select("series", "segment_id", F.col("p")[0]["t"].alias("start_time"), F.element_at("p", -1)["t"].alias("end_time"), n.alias("point_count"), (4 * n).alias("original_size"), "f.model", "f.residual")
    size = encodings.model_bytes(F.col("model"))
    return s.withColumn("model_size", size.cast("long")).withColumn("compression_ratio", F.col("original_size") / size)


def regenerated(segments: DataFrame) -> DataFrame:
    """All samples of every segment on its uniform grid: series, segment_id, i, t, v."""
    n = F.col("point_count")
    rows = segments.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    x = F.when(n > 1, F.col("i") / (n - 1)).otherwise(F.lit(0.0))
    v = encodings.value_at(F.col("model"), x) + F.coalesce(F.element_at("residual", (F.col("i") + 1).cast("int")), F.lit(0.0))
    t = F.expr("start_time + (i * (end_time - start_time)) div greatest(point_count - 1, 1L)")  # whole numbers: no grid time slips by one
    return rows.select("series", "segment_id", "i", t.alias("t"), v.alias("v"))


def read_range(segments: DataFrame, start: int, end: int) -> DataFrame:
    """Samples of the model at times in [start, end]: only segments that reach into it are evaluated."""
    reach = segments.where((F.col("start_time") <= end) & (F.col("end_time") >= start))
    return regenerated(reach).where(F.col("t").between(start, end))


def value_of(segments: DataFrame, t: int) -> DataFrame:
    """Interpolated value at ``t`` from the first segment that covers it, per series."""
    hit = segments.where((F.col("start_time") <= t) & (F.col("end_time") >= t))
    one = hit.groupBy("series").agg(F.min_by(F.struct("model", "start_time", "end_time"), F.struct("start_time", "segment_id")).alias("s"))
    return one.select("series", encodings.value_at(F.col("s.model"), encodings.position(F.lit(t), F.col("s.start_time"), F.col("s.end_time"))).alias("v"))


def totals(segments: DataFrame) -> DataFrame:
    """Count, sum, min and max of all samples from the models alone where a closed form exists.

    Constant and linear segments need no samples; only the rest are regenerated.
    """
    c, n = F.col("model.coef"), F.col("point_count")
    closed = segments.where("model.kind in ('constant', 'linear') and residual is null")
    last = F.element_at(c, -1)
    easy = closed.select(n.alias("n"), (n * (c[0] + last) / 2).alias("s"), F.least(c[0], last).alias("lo"), F.greatest(c[0], last).alias("hi"))
    hard = regenerated(segments.where("model.kind not in ('constant', 'linear') or residual is not null"))
    each = hard.select(F.lit(1).cast("long").alias("n"), F.col("v").alias("s"), F.col("v").alias("lo"), F.col("v").alias("hi"))
    return easy.unionByName(each).agg(F.sum("n").alias("n"), F.sum("s").alias("sum"), F.min("lo").alias("min"), F.max("hi").alias("max"))


def stats(segments: DataFrame) -> DataFrame:
    """Segments, bytes, mean ratio, and segments by kind."""
    kinds = segments.groupBy("model.kind").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("model_distribution"))
    whole = segments.agg(F.count("*").alias("total_segments"), F.sum("model_size").alias("total_disk_size"), F.avg("compression_ratio").alias("average_compression_ratio"))
    return whole.join(F.broadcast(kinds))
