"""Document fingerprints: one-permutation MinHash with optimal densification, packed low bits.

Every shingle is hashed once; the top bits of the hash choose a bin, the rest is its value, and
each bin keeps its least value. An empty bin borrows from the first full bin of its own hashed
probe sequence, independent of other bins. The low ``BITS`` bits of each bin are stored; the share
of equal bins is corrected for the chance agreement of 2**-BITS.

Edge cases: null texts are empty; a text without words has no shingle and the fingerprint of
zeros; two such texts have likeness 1, one and another 0. Texts of one to four words have one
shingle. Rows of equal doc_id are ordered by their text; a null doc_id comes last. A single row is
its own next document. An empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _common, _words

U = _words.U
BINS, BITS, SIZE = 512, 8, 5
PARTITION_BYTES = 32 << 20
_EMPTY = U(2**64 - 1)
_LAST = 2**63 - 1


@lru_cache(maxsize=2)
def _probes(bins: int, attempt: int) -> np.ndarray:
    """The bins that each bin tries in 64 attempts, a row per attempt."""
    at = np.arange(64 * bins, dtype=U) + U(attempt * 64 * bins)
    return (_words.mixed(at, 77) % U(bins)).astype(np.int64).reshape(64, bins)


def one_permutation(h: np.ndarray, first: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Densified bins, a row for each text; rows of texts without shingles stay empty."""
    rows = len(first) - 1
    out = np.full(rows * bins, _EMPTY, U)
    row = np.repeat(np.arange(rows), np.diff(first))
    top = U(64 - int(bins).bit_length() + 1)
    np.minimum.at(out, row * bins + (h >> top).astype(np.int64), h & ((U(1) << top) - U(1)))
    out = out.reshape(rows, bins)
    full = out != _EMPTY
    r, b = np.nonzero(~full & full.any(1)[:, None])
    dense, attempt = out.copy(), 0
    while len(r):
        for step in _probes(bins, attempt):
            donor = step[b]
            hit = full[r, donor]
            dense[r[hit], b[hit]] = out[r[hit], donor[hit]]
            r, b = r[~hit], b[~hit]
            if not len(r):
                break
        attempt += 1
    return dense


def likeness(x: np.ndarray, y: np.ndarray, empty_x: np.ndarray, empty_y: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of rows of dense bins' low bits, corrected for chance."""
    chance = 2.0**-bits
    est = np.clip(((x == y).mean(1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(empty_x | empty_y, (empty_x & empty_y).astype(float), est)


def _low(texts: pa.Array, bins: int, bits: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of every bin, unpacked, and which texts have no shingle."""
    parts, empty = [np.zeros((0, bins), np.uint16)], [np.zeros(0, bool)]
    for _, _, data, offsets in _words.slices(texts):
        h, first = _words.shingles(_words.words(data, offsets), size)
        none = np.diff(first) == 0
        low = (_words.mixed(one_permutation(h, first, bins), 5) & U((1 << bits) - 1)).astype(np.uint16)
        low[none] = 0
        parts.append(low)
        empty.append(none)
    return np.concatenate(parts), np.concatenate(empty)


def _hex(low: np.ndarray, bits: int) -> list[str]:
    if bits == 8:
        rows = low.astype(np.uint8)
    else:
        spread = (low[:, :, None] >> np.arange(bits, dtype=np.uint16)) & 1
        rows = np.packbits(spread.reshape(len(low), -1).astype(np.uint8), axis=1, bitorder="little")
    return [x.tobytes().hex() for x in rows]


def in_order(docs: DataFrame) -> DataFrame:
    """doc, text, extra: partitions in the order of doc, each closed by the next one's first rows (extra).

    The last partition is closed by the first rows of all, so every row but extras has a next one.
    """
    spark = docs.sparkSession
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    parts = max(1, min(rows, max(_common.shuffle_partitions(spark), -(-(size or 0) // PARTITION_BYTES))))
    cuts = docs.approxQuantile("doc", [i / parts for i in range(1, parts)], 0.05 / parts) if parts > 1 else []
    bounds = np.unique(np.minimum(np.array(cuts), 2.0**62).astype(np.int64))

    @F.pandas_udf("int")
    def part_of(doc: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, doc.to_numpy(), "right").astype(np.int32))

    firsts = docs.select("doc").groupBy(part_of("doc").alias("part")).agg(F.min("doc").alias("doc")).orderBy("part").collect()
    first = np.array([r["doc"] for r in firsts], np.int64)
    back = np.array([firsts[i - 1]["part"] for i in range(len(firsts))], np.int32)

    @F.pandas_udf("array<struct<part:int,extra:boolean>>")
    def places(doc: pd.Series) -> pd.Series:
        d = doc.to_numpy()
        own = np.searchsorted(bounds, d, "right")
        at = np.minimum(np.searchsorted(first, d), len(first) - 1)
        lead = first[at] == d
        return pd.Series([[{"part": int(p), "extra": False}] + ([{"part": int(back[i]), "extra": True}] if x else []) for p, i, x in zip(own, at, lead, strict=True)])

    dealt = docs.withColumn("place", F.explode(places("doc"))).select("doc", "text", "place.part", "place.extra")
    return dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("extra", "doc", "text").select("doc", "text", "extra")


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, size: int = SIZE) -> DataFrame:
    """The fingerprint of each text, of its edited text, and their likenesses.

    The edited text has its last floor(n_chars / 4) characters replaced by the first as many of the
    next document in the order of doc_id; the first document follows the last.
    """
    base = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).alias("doc"), _common.text_of(docs).alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def block(doc: list, text: list[str], after: str) -> pa.RecordBatch:
        follow = [*text[1:], after]
        edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(text, follow, strict=True)]
        raw = [e.encode() for e in edited]
        x, none = _low(pa.array([*text, after]), bins, bits, size)
        y, bare = _low(pa.array(edited), bins, bits, size)
        cols = [
            pa.array([None if d == _LAST else d for d in doc], pa.int64()),
            pa.array([len(t) for t in text], pa.int64()),
            pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
            pa.array(_hex(x[:-1], bits)),
            pa.array(_hex(y, bits)),
            pa.array(likeness(x[:-1], y, none[:-1], bare, bits)),
            pa.array(likeness(x[:-1], x[1:], none[:-1], none[1:], bits)),
        ]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, text, room = [], [], 0
        for batch in batches:
            for d, t, extra in zip(*[batch.column(c).to_pylist() for c in ("doc", "text", "extra")], strict=True):
                if text and (extra or room > _words.SLICE_BYTES):
                    yield block(doc, text, t)
                    doc, text, room = [], [], 0
                if extra:
                    return
                doc.append(d)
                text.append(t)
                room += len(t)

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(base).mapInArrow(run, kinds)
