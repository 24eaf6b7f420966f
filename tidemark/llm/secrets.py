"""Secret scans: fixed formats, and random strings told by character Markov models.

Three formats give the base spans. They also label a sample: strings found by them are random
strings, all other tokens that recur ordinary identifiers. Two first-order Markov models of characters are
counted from this sample, and tokens outside the base spans whose mean log-likelihood ratio per
character is above a threshold are spans of kind markov. The threshold is the larger of a fixed
floor and a high quantile of the ratios of the ordinary tokens of all documents. A token recurs if
it is in two different texts; copies of a text count once.

The sample that the models are counted from is bounded in documents (``LABELLED_DOCS`` for secrets, ``ORDINARY_DOCS`` for ordinary
tokens) and chosen by hash; scanning runs over whole texts. DataFrame functions only.

Edge cases: null texts are empty; texts without spans have counts 0 and the digest of the empty
string; repeated rows are scanned each; without any labelled secret no markov span is found; an
empty table gives an empty result. Extra columns are left out unless named in ``keep``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _common, _spans

LABELLED_DOCS = 40_000
ORDINARY_DOCS = 4_000
FLOOR = 0.5
QUANTILE = 0.99

# The patterns of the base formats.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# The same with the least length where that gives the same spans, so that fewer matches are made.
_ACCESS_LONG = r"AKIA[A-Z0-9]{12,}"
_HEX_LONG = r"[0-9a-f]{32,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
KINDS = ("assign", "access", "hex", "markov")


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"], F.lit(kind).alias("kind"), x["end"]))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind: array<struct<start, end, value, ...>>."""
    assign = F.filter(_spans.located(text, ASSIGN, 2), lambda x: F.length(x["g1"]) >= 8)
    return {"assign": assign, "access": _spans.located(text, _ACCESS_LONG), "hex": _spans.located(text, _HEX_LONG)}


@dataclass
class Model:
    """Log-likelihood ratios of each next character, and the mean from which a token counts as random."""

    ratios: list[float]
    threshold: float

    def score(self, token: Column) -> Column:
        """Mean log-likelihood ratio of the characters after the first; null for shorter tokens."""
        size = len(ALPHABET)
        places = [0] * 128
        for i, c in enumerate(ALPHABET):
            places[ord(c)] = i
        place, ratio = F.lit(places), F.lit(self.ratios)
        codes = F.transform(F.split(token, ""), lambda c: F.element_at(place, F.ascii(c) + 1))

        def mean(code: Column) -> Column:
            n = F.size(code)
            steps = F.zip_with(F.slice(code, F.lit(1), n - 1), F.slice(code, F.lit(2), n - 1), lambda a, b: F.element_at(ratio, a * size + b + 1))
            return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / (n - 1)

        return F.when(F.length(token) > 1, _spans.let(codes, mean))


def _pairs(tokens: DataFrame) -> DataFrame:
    """Counts of neighbouring characters of column ``token``, which stands for ``n`` tokens."""
    place = F.explode(F.sequence(F.lit(1), F.length("token") - 1))
    pair = tokens.where(F.length("token") > 1).select("token", "n", place.alias("i")).select(F.expr("substr(token, i, 2)").alias("pair"), "n")
    return pair.groupBy("pair").agg(F.sum("n").alias("count"))


def _ordinary(docs: DataFrame, least: int = 4) -> DataFrame:
    """Tokens outside the base spans that occur in more than one text, with the number of texts: identifiers recur, random strings do not.

    Copies of a text are one text, so they do not make its random strings recur.
    """
    whole = text = _common.text_of(docs)
    for p in (ASSIGN, _ACCESS_LONG, _HEX_LONG):
        text = F.regexp_replace(text, p, " ")
    tokens = docs.select(F.xxhash64(whole).alias("text_key"), F.explode(_spans.matches(text, f"[A-Za-z0-9+/_=.-]{{{least},}}")).alias("token"))
    return tokens.distinct().groupBy("token").agg(F.count("*").alias("n")).where("n > 1")


def _transitions(counts: dict[str, int], weight: float = 10.0) -> list[float]:
    """Chances of each next character after each character, drawn toward the chances of single characters."""
    single = {b: sum(counts.get(a + b, 0) for a in ALPHABET) + 0.5 for b in ALPHABET}
    total = sum(single.values())
    out = []
    for a in ALPHABET:
        row = [counts.get(a + b, 0) + weight * single[b] / total for b in ALPHABET]
        out += [x / sum(row) for x in row]
    return out


def train(docs: DataFrame, labelled_docs: int = LABELLED_DOCS, ordinary_docs: int = ORDINARY_DOCS) -> Model:
    """Count both models; the counts have at most len(ALPHABET)**2 rows each."""
    many, few = (_common.hash_sample(docs, F.col("doc_id"), n) for n in (labelled_docs, ordinary_docs))
    spans = base_spans(_common.text_of(many))
    values = F.concat(F.transform(spans["assign"], lambda x: x["g1"]), *[F.transform(spans[k], lambda x: x["value"]) for k in ("access", "hex")])
    secret = {r["pair"]: r["count"] for r in _pairs(many.select(F.explode(values).alias("token")).distinct().withColumn("n", F.lit(1))).collect()}
    plain = {r["pair"]: r["count"] for r in _pairs(_ordinary(few)).collect()}
    ratios = [math.log(x / y) for x, y in zip(_transitions(secret), _transitions(plain), strict=True)]
    if not secret:
        return Model(ratios, math.inf)
    model = Model(ratios, FLOOR)
    long = _ordinary(docs, 20).select(model.score(F.col("token")).alias("score"))
    high = long.agg(F.percentile_approx("score", QUANTILE, 10000)).first()[0]
    return Model(ratios, max(FLOOR, high if high is not None else FLOOR))


def scan(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and found: array<struct<start, kind, end>>, by start, then kind as listed in ``KINDS``."""
    text = _common.text_of(docs)
    base = base_spans(text)
    rows = docs.select(*keep, text.alias("__text"), *[base[k].alias(f"__{k}") for k in KINDS[:3]])
    firm = F.concat(*[_tagged(F.col(f"__{k}"), i) for i, k in enumerate(KINDS[:3])])
    rows = rows.withColumn("__base", firm)
    token = F.filter(
        _spans.located(F.col("__text"), TOKEN),
        lambda t: (model.score(t["value"]) >= model.threshold) & ~F.exists(F.col("__base"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
    )
    rows = rows.withColumn("__markov", _tagged(token, 3) if math.isfinite(model.threshold) else F.slice(F.col("__base"), 1, 0))
    return rows.select(*keep, F.array_sort("__base").alias("base"), F.array_sort(F.concat("__base", "__markov")).alias("found"))


def digest(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
