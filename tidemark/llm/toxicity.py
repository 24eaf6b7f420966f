"""Toxicity by multiple-instance learning: noisy-or of sentence scores, trained from document labels.

A document is a bag of sentences; it is toxic if any sentence is. Each sentence has a logistic
score over hashed word and word-beginning features, and the document's score is the noisy-or
1 - prod(1 - p) of its sentences. The weights maximise the likelihood of the document labels, so
sentences get scores though no sentence was ever labelled, and the scores locate what offends.

The model is fitted on the driver from a sample of labelled documents, bounded in rows and
characters by parameters of ``train`` and chosen by hash. Scoring runs over whole texts.

Edge cases: null and empty texts, and texts without letters or digits, have score 0; documents
without a label are scored like others; labels that are null are not used; with no labelled
document of either kind every score is 0; repeated rows are scored each; an empty table gives an
empty result; a text of any length is scored whole, in some 40 times its bytes of memory; a
document that ties with the threshold is toxic; a doc_id with labels of both kinds is toxic. Extra
columns are left out unless named in ``keep``, which may not name an output column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _common, _words

U = _words.U
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 20_000_000
FIT_BYTES = 1 << 19  # text that is cut into tokens at once when fitting
SCORE_BYTES = 1 << 20
FEATURE_BITS = 18
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.3
ROUNDS = 160

#: letters, digits and all bytes of other scripts are inside a word
_SPACE = np.ones(256, bool)
_SPACE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Bag:
    """Sentences of the texts of a slice: the tokens of each, the features of each kind of token."""

    token: np.ndarray  # kind of each token
    sentence: np.ndarray  # sentence of each token
    text: np.ndarray  # text of each sentence
    start: np.ndarray  # first byte of each sentence's first token
    end: np.ndarray
    kind: np.ndarray  # hash of each kind
    features: np.ndarray  # kinds x features
    texts: int

    @classmethod
    def joined(cls, parts: list[Bag]) -> Bag:
        """One bag of several, in order."""
        code, kind = pd.factorize(np.concatenate([p.kind for p in parts]))
        k, s, t = (np.cumsum([0, *n]) for n in zip(*[(len(p.kind), len(p.text), p.texts) for p in parts], strict=True))
        first = np.zeros(len(kind), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        shifted = lambda name, by: np.concatenate([(getattr(p, name) + d).astype(getattr(p, name).dtype) for p, d in zip(parts, by, strict=False)])
        return cls(code.astype(np.int32)[shifted("token", k)], shifted("sentence", s), shifted("text", t), shifted("start", 0 * k), shifted("end", 0 * k), kind, np.concatenate([p.features for p in parts])[first], int(t[-1]))


    def only(self, used: np.ndarray) -> Bag:
        """The bag without tokens none of whose features is ``used``; sentences stay."""
        telling = used[self.features].any(1)
        code = np.cumsum(telling, dtype=np.int32) - np.int32(1)
        keep = telling[self.token]
        return Bag(code[self.token[keep]], self.sentence[keep], self.text, self.start, self.end, self.kind[telling], self.features[telling], self.texts)


def bag(data: np.ndarray, offsets: np.ndarray) -> Bag:
    w = _words.words(data, offsets, _SPACE)
    ranges = _words.Ranges.of(_words.codes(11, lower=True)[data], 0x5851F42D4C957F2D)
    number, kinds = pd.factorize(ranges.hashes(w.start, w.end) + (w.end - w.start).astype(U))
    at = np.zeros(len(kinds), np.int64)
    at[number[::-1]] = np.arange(len(number))[::-1]
    s, e = w.start[at], w.end[at]
    columns = [ranges.hashes(s, e) + U(1 << 40)]
    columns += [np.where(e - s > n, ranges.hashes(s, np.minimum(s + n, e)) + U(n), columns[0]) for n in PREFIXES]
    features = (_words.mixed(np.stack(columns, 1)) >> U(64 - FEATURE_BITS)).astype(np.int64) if len(s) else np.zeros((0, 1 + len(PREFIXES)), np.int64)
    text = w.text_index()
    stops = np.cumsum(_STOP[data])
    before = stops[w.start] if len(w.start) else np.zeros(0, np.int64)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (before[1:] != before[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1 if len(first) else first
    sentence = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return Bag(number.astype(np.int32), sentence, text[first].astype(np.int32), w.start[first], w.end[last], np.asarray(kinds, U), features.astype(np.int32), len(offsets) - 1)


def _chance(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, b: Bag) -> np.ndarray:
        """Log-odds of every sentence."""
        kind = self.weights[b.features].mean(1)
        return self.bias + np.bincount(b.sentence, kind.astype(np.float32)[b.token], len(b.text))

    @staticmethod
    def documents(b: Bag, z: np.ndarray) -> np.ndarray:
        """Noisy-or of the sentences of each text."""
        return 1 - np.exp(-np.bincount(b.text, np.logaddexp(0, z), b.texts))


def _telling(column: pa.Array, y: np.ndarray, least: float = 4.0, documents: int = 3) -> np.ndarray:
    """Features of at least so many documents whose share of toxic ones is so many standard errors off."""
    size = 1 << FEATURE_BITS
    n, bad = np.zeros(size), np.zeros(size)
    for first, last, data, offsets in _words.slices(column, FIT_BYTES):
        b, own_y = bag(data, offsets), y[first:last]
        text, kind = np.divmod(pd.unique(b.text[b.sentence].astype(np.int64) * len(b.features) + b.token), max(1, len(b.features)))
        for i, feature in enumerate(b.features.T):
            own = feature[kind] != b.features[kind, 0] if i else slice(None)  # short words have one feature only
            pair = pd.unique(text[own] * size + feature[kind][own])
            n += np.bincount(pair % size, minlength=size)
            bad += np.bincount(pair % size, own_y[pair // size], size)
    share = y.mean()
    return (n >= documents) & (np.abs(bad - n * share) >= least * np.sqrt(np.maximum(n, 1) * share * (1 - share)))


def fit(texts: list[str] | pa.ChunkedArray, labels: np.ndarray, rounds: int = ROUNDS, rate: float = 0.2, decay: float = 1e-6) -> Model:
    """Adam on the noisy-or log-likelihood of the document labels.

    Texts are cut into tokens slice by slice, twice; only tokens with a telling feature are kept.
    """
    model = Model(np.zeros(1 << FEATURE_BITS), -7.0)
    if not len(texts) or not 0 < labels.mean() < 1:
        return Model(model.weights, -np.inf)
    column = texts if isinstance(texts, pa.ChunkedArray) else pa.array(texts)
    y = labels.astype(float)
    used = _telling(column, y)
    b = Bag.joined([bag(data, offsets).only(used) for _, _, data, offsets in _words.slices(column, FIT_BYTES)])
    del column, texts
    m = v = np.zeros(len(model.weights) + 1)
    for step in range(1, rounds + 1):
        z = model.sentences(b)
        p = np.clip(model.documents(b, z), 1e-9, 1 - 1e-9)
        # d loss / d sum of softplus, spread over each text's sentences
        outer = 1 - y / p
        gz = outer[b.text] * _chance(z) / b.texts
        g_kind = np.bincount(b.token, gz.astype(np.float32)[b.sentence], len(b.features)) / b.features.shape[1]
        g = np.bincount(b.features.ravel(), np.repeat(g_kind, b.features.shape[1]), len(model.weights))
        g = np.append(np.where(used, g + decay * model.weights, 0.0), gz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        model = Model(model.weights - move[:-1], model.bias - move[-1])
    return model


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by the CRC of their id; never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a sample of the labelled documents that are not held out, bounded in rows and characters.

    Rows that are equal in doc_id and text count once, and texts of over a sixteenth of
    ``sample_chars`` are not fitted on (they are scored like others), so that neither a repeated
    doc_id nor a giant text breaks the bounds.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = F.broadcast(_common.hash_sample(known, F.col("doc_id"), sample_rows))  # bounded rows of two numbers
    hashed = docs.select("doc_id", _common.text_of(docs).alias("text")).where(F.length("text") <= sample_chars // 16).join(few, "doc_id")
    rows, chars, ids = hashed.agg(F.count("*"), F.sum(F.length("text")), F.count_distinct("doc_id")).first()
    if not rows:
        return fit([], np.zeros(0))
    if ids < rows:
        hashed = hashed.dropDuplicates(["doc_id", "text"])
    share = min(sample_rows / rows, sample_chars / max(1, chars))
    if share < 1:
        hashed = _common.hash_sample(hashed, F.xxhash64("doc_id", "text", F.lit(7)), max(1, int(rows * share)))
    got = hashed.select("text", (F.col("toxic") > 0).alias("toxic")).toArrow().sort_by([("text", "ascending"), ("toxic", "ascending")])
    return fit(got.column("text"), got.column("toxic").to_numpy())


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score, predicted, and the offending sentences: start, end (code points) and score, in order."""
    spark = docs.sparkSession
    fields = [f.name for f in docs.select(*keep).schema]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    shared = spark.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.bias))  # 1 MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, data, offsets in _words.slices(batch.column("__text"), SCORE_BYTES):
                x = bag(data, offsets)
                z = m.sentences(x)
                p = m.documents(x, z)
                own = _chance(z)
                found: list[list[dict]] = [[] for _ in range(b - a)]
                for i in np.flatnonzero(own >= threshold):
                    t = int(x.text[i])
                    before = data[offsets[t] : x.start[i]]
                    start = int(((before & 0xC0) != 0x80).sum())
                    size = int(((data[x.start[i] : x.end[i]] & 0xC0) != 0x80).sum())
                    found[t].append({"start": start, "end": start + size, "score": float(own[i])})
                kept = batch.select(fields).slice(a, b - a)
                spans = pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32)), spans], names=[*fields, "score", "predicted", "offending"])

    rows = docs.select(*keep, _common.text_of(docs).alias("__text"))
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")
