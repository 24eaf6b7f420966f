"""Removal of repeated passages by Rabin-Karp window hashes.

Every run of ``width`` words of every document is hashed. Windows are dealt into buckets by the
smallest hash of the short word runs (``GRAM`` words) inside them, so equal windows meet in one
bucket while neighbouring windows mostly travel together and share one position. A map task
keeps the first of its own equal windows, marks the others as repeats at once, and sends one
packed row per bucket; a bucket then marks every window that starts earlier elsewhere. Marked
windows merge into maximal intervals per document, and the words outside them are kept.

A word run that is the smallest in very many windows would fill one bucket. Such runs are counted
first, and their windows are dealt by the hash of the whole window into as many buckets as their
number asks for. The count decides only where windows meet, never whether. At most 2**20 runs are
that frequent in a table of any size, so their list is small.

A window travels as 72 bits of hash; its bucket adds the bits of an independent hash.

Order is by doc_id, null last. Edge cases: null texts have no words; texts under ``width`` words
have no window and stay whole; rows with equal doc_id are told apart by their text, those equal
in both are one document and get the same result each; texts of any length are cut whole; windows
that tie in their words go to the smallest doc_id, then the earliest start; an empty table gives an
empty result.
Extra columns are left out unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _common, _words

GRAM = 4
BUCKET_BYTES = 8 << 20  # text for each bucket
BATCH_BYTES = 4 << 20
_LAST = 2**63 - 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of ``width`` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of runs; ``breaks`` is true where a run begins."""
    start = np.flatnonzero(breaks)
    return start, np.diff(np.append(start, len(breaks)))


def _ties(h: np.ndarray, g: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For places sorted by ``order``: true where a place equals the one before it in both hashes."""
    same = np.zeros(len(order), bool)
    same[1:] = (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
    return same


def _starts(count: np.ndarray, first: np.ndarray, width: int, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start in the row and place in all words of every window of the rows ``by``."""
    by = by[count[by] >= width]
    n = count[by] - width + 1
    row = np.repeat(by, n)
    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return row, start, start + first[row]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest hash of a short word run in every window."""
    grams = _words.window_hashes(_words.mixed(h, 3), GRAM)
    return sliding_min(grams, width - GRAM + 1) if len(grams) else grams


class Windows:
    """Windows of some documents in the order (doc_id, tkey, start)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, tkey: np.ndarray, width: int):
        w = _words.words(data, offsets)
        h = w.hashes(5)
        least = _least(h, width)
        hashes = _words.window_hashes(h, width)
        second = _words.window_hashes(_words.mixed(h, 9), width) >> _words.U(56)
        self.row, self.start, at = _starts(w.count, w.first, width, np.lexsort((tkey, doc)))
        self.hash, self.check, self.least = hashes[at], second[at].astype(np.uint8), least[at]
        self.doc, self.tkey = doc[self.row], tkey[self.row]


def _first_of_equal(h: np.ndarray, g: np.ndarray, doc: np.ndarray, tkey: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for windows that start earlier elsewhere; the rows are in the order of (doc, tkey, start)."""
    order = np.argsort(h, kind="stable")
    near = np.zeros(len(h), bool)
    eq = h[order[1:]] == h[order[:-1]]
    near[1:] |= eq
    near[:-1] |= eq
    order = order[near]  # only windows whose hash occurs again
    if not len(order):
        return np.zeros(len(h), bool)
    order = order[np.lexsort((order, g[order], h[order]))]
    same = _ties(h, g, order)
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    other = same & ~((doc[order] == doc[head]) & (tkey[order] == tkey[head]) & (start[order] == start[head]))
    out = np.zeros(len(h), bool)
    out[order[other]] = True
    return out


def _marks(doc: np.ndarray, tkey: np.ndarray, start: np.ndarray) -> dict[str, list]:
    """Sorted single windows as rows (doc, tkey, starts, lengths of runs of windows)."""
    if not len(doc):
        return {"doc": [], "tkey": [], "starts": [], "runs": []}
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (tkey[1:] != tkey[:-1])
    gap = other.copy()
    gap[1:] |= start[1:] != start[:-1] + 1
    again = np.zeros(len(doc), bool)
    again[1:] = ~other[1:] & (start[1:] == start[:-1])
    keep = ~again
    doc, tkey, start, other, gap = doc[keep], tkey[keep], start[keep], other[keep], gap[keep]
    at, length = _runs(gap)
    first, n = _runs(other[at])
    cut = np.cumsum(n)[:-1]
    return {"doc": doc[at[first]], "tkey": tkey[at[first]], "starts": [x.astype(np.int32) for x in np.split(start[at], cut)], "runs": [x.astype(np.int32) for x in np.split(length, cut)]}


_MARK_TYPES = pa.schema([("doc", pa.int64()), ("tkey", pa.int32()), ("starts", pa.list_(pa.int32())), ("runs", pa.list_(pa.int32()))])
_MAP_TYPES = pa.schema([("bucket", pa.int32()), *_MARK_TYPES, ("blob", pa.binary())])


def _mark_batch(m: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(m[f.name], f.type) for f in _MARK_TYPES], schema=_MARK_TYPES)


def _packed(w: Windows, pick: np.ndarray) -> bytes:
    """Windows of one bucket: hashes, then documents and positions of runs, compressed."""
    doc, tkey, start = w.doc[pick], w.tkey[pick], w.start[pick]
    cut = np.ones(len(pick), bool)
    cut[1:] = (w.row[pick][1:] != w.row[pick][:-1]) | (start[1:] != start[:-1] + 1)
    at, length = _runs(cut)
    side = np.concatenate([np.diff(doc[at], prepend=0), tkey[at].astype(np.int64), start[at], length]).astype("<i8")
    side = zstandard.compress(side.view(np.uint8).reshape(-1, 8).T.tobytes(), 3)
    head = np.array([len(pick), len(at)], "<i8").tobytes()
    return head + w.hash[pick].astype("<u8").tobytes() + w.check[pick].tobytes() + side


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    n, m = np.frombuffer(blob, "<i8", 2)
    h = np.frombuffer(blob, "<u8", n, 16)
    g = np.frombuffer(blob, np.uint8, n, 16 + 8 * n)
    side = np.frombuffer(zstandard.decompress(blob[16 + 9 * n :]), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()
    doc, tkey, start, length = side.reshape(4, m)
    within = np.arange(n) - np.repeat(np.cumsum(length) - length, length)
    return h, g, np.repeat(np.cumsum(doc), length), np.repeat(tkey.astype(np.int32), length), np.repeat(start, length) + within


def frequent_runs(docs: DataFrame, width: int, size: int, bucket_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Word runs that are the smallest of more windows than a bucket should hold, and how many buckets each takes."""
    share = max(1, bucket_bytes // 4)  # windows; a text of so many bytes a bucket has fewer
    bound = max(share, size >> 21)  # a window takes two bytes or more, so 2**20 runs at most reach this
    slices = size // BATCH_BYTES + docs.sparkSession.sparkContext.defaultParallelism
    floor = max(1, bound // (4 * slices))  # a run that reaches the bound has most of its windows above it

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in _words.slices(batch.column("text"), BATCH_BYTES):
                w = _words.words(data, offsets)
                at = _starts(w.count, w.first, width, np.arange(len(w.count)))[2]
                if not len(at):
                    continue
                least = _least(w.hashes(5), width)[at]
                head, n = _runs(np.append(True, least[1:] != least[:-1]))
                run, back = np.unique(least[head], return_inverse=True)
                total = np.bincount(back, n).astype(np.int64)
                much = total >= floor
                yield pa.RecordBatch.from_arrays([pa.array(run[much].view(np.int64)), pa.array(total[much])], names=["run", "n"])

    counted = docs.select("text").mapInArrow(count, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    found = sorted((r["run"] & (2**64 - 1), r["n"]) for r in counted.where(F.col("n") >= bound).collect())
    return np.array([x for x, _ in found], _words.U), np.array([-(-n // share) for _, n in found], _words.U)


def repeated_windows(docs: DataFrame, width: int, n_buckets: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Runs of windows that also start earlier: doc, tkey, starts, runs; several rows per document.

    ``docs`` has columns doc (long), tkey (int) and text; ``frequent`` is what ``frequent_runs`` gives.
    """

    def bucket_of(least: np.ndarray, whole: np.ndarray) -> np.ndarray:
        runs, parts = frequent
        out = least % _words.U(n_buckets)
        if len(runs):
            at = np.minimum(np.searchsorted(runs, least), len(runs) - 1)
            hot = runs[at] == least
            part = _words.mixed(whole[hot], 11) % parts[at[hot]]
            out[hot] = _words.mixed(least[hot] + part, 13) % _words.U(n_buckets)
        return out.astype(np.int32)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tkey = batch.column("doc").to_numpy(), batch.column("tkey").to_numpy()
            for a, b, data, offsets in _words.slices(batch.column("text"), BATCH_BYTES):
                w = Windows(data, offsets, doc[a:b], tkey[a:b], width)
                again = _first_of_equal(w.hash, w.check, w.doc, w.tkey, w.start)
                own = _marks(w.doc[again], w.tkey[again], w.start[again])
                firsts = np.flatnonzero(~again)
                bucket = bucket_of(w.least[firsts], w.hash[firsts])
                order = np.argsort(bucket, kind="stable")
                heads, sizes = _runs(np.diff(bucket[order], prepend=-1) != 0)
                blobs = [_packed(w, firsts[order[i : i + n]]) for i, n in zip(heads.tolist(), sizes.tolist(), strict=True)]
                n_own, n_blob = len(own["doc"]), len(blobs)
                spread_own = (np.asarray(own["doc"], np.int64) % n_buckets).astype(np.int32)
                none = [None] * n_blob
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([spread_own, bucket[order[heads]]]), pa.int32()),
                        *[pa.array([*own[f.name], *none], f.type) for f in _MARK_TYPES],
                        pa.array([None] * n_own + blobs, pa.binary()),
                    ],
                    schema=_MAP_TYPES,
                )

    def meet(group: pa.Table) -> pa.Table:
        passed = group.filter(pc.is_null(group.column("blob"))).select(_MARK_TYPES.names).cast(_MARK_TYPES)
        blobs = group.column("blob").drop_null()
        if not len(blobs):
            return passed
        h, g, doc, tkey, start = (np.concatenate(x) for x in zip(*[_unpacked(b.as_py()) for b in blobs], strict=True))
        # only windows whose hash occurs again are put in order
        order = np.argsort(h)
        near = np.zeros(len(h), bool)
        eq = h[order[1:]] == h[order[:-1]]
        near[1:] |= eq
        near[:-1] |= eq
        pick = order[near]
        pick = pick[np.lexsort((start[pick], tkey[pick], doc[pick]))]
        again = pick[_first_of_equal(h[pick], g[pick], doc[pick], tkey[pick], start[pick])]
        found = _mark_batch(_marks(doc[again], tkey[again], start[again]))
        return pa.concat_tables([passed, pa.Table.from_batches([found])])

    fields = "doc long, tkey int, starts array<int>, runs array<int>"
    rows = docs.select("doc", "tkey", "text").mapInArrow(spread, f"bucket int, {fields}, blob binary")
    parts = max(_common.shuffle_partitions(docs.sparkSession), n_buckets // 8)  # tasks grow in number, not in size
    return rows.repartition(parts, "bucket").groupBy("bucket").applyInArrow(meet, fields)


def remove_repeats(docs: DataFrame, width: int = 20, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: ``keep``, n_words, n_removed, kept_sha256, and the kept text if asked for."""
    spark = docs.sparkSession
    fields = [f.name for f in docs.select(*keep).schema]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    base = docs.select(F.struct(*keep).alias("kept"), _common.text_of(docs).alias("text"), docs["doc_id"].cast("long").alias("doc"))
    # rows without an id come last and are told apart by 31 bits more
    base = base.withColumn("doc", F.coalesce("doc", F.lit(_LAST) - F.pmod(F.xxhash64("text", F.lit(3)), F.lit(2**31))))
    base = base.withColumn("tkey", F.hash("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(2 * _common.shuffle_partitions(spark), -(-size // bucket_bytes))
    marks = repeated_windows(base, width, n_buckets, frequent_runs(base, width, size, bucket_bytes))
    marks = marks.groupBy("doc", "tkey").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("runs")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, runs = batch.column("starts").to_pylist(), batch.column("runs").to_pylist()
            for a, b, data, offsets in _words.slices(batch.column("text"), BATCH_BYTES):
                w = _words.words(data, offsets)
                raw = data.tobytes()
                removed, shas, texts = [], [], []
                for i in range(b - a):
                    s, e = w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]]
                    gone = 0
                    if starts[a + i]:
                        edge = np.zeros(len(s) + 1, np.int64)
                        np.add.at(edge, np.array(starts[a + i]), 1)
                        np.add.at(edge, np.array(starts[a + i]) + np.array(runs[a + i]) + width - 1, -1)
                        stays = np.cumsum(edge[:-1]) == 0
                        gone = len(s) - int(stays.sum())
                        s, e = s[stays], e[stays]
                    kept = b" ".join([raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)])
                    removed.append(gone)
                    shas.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode() if with_text else None)
                rows = batch.column("kept").slice(a, b - a)
                cols = [*[pc.struct_field(rows, i) for i in range(len(fields))], pa.array(w.count), pa.array(removed, pa.int64()), pa.array(shas)]
                names = [*fields, "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols, names = [*cols, pa.array(texts, pa.string())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    joined = base.join(marks, ["doc", "tkey"], "left").select("kept", "text", "starts", "runs")
    return joined.mapInArrow(cut, f"{kinds}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
