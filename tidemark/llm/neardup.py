"""Near-duplicate classes by DartMinHash signatures, banded joins and exact verification.

A document is the weighted set of its five-word shingles, weighted by their counts. Darts are
thrown into the region under the weights: the cell of element, unit of weight and unit of rank
holds a hashed number of darts, each with a coordinate, a rank and a weight, so equal elements
get equal darts in every document. The earliest dart of each coordinate is the signature; two
documents agree in a coordinate with the probability of their weighted Jaccard similarity.
Signatures are cut into bands; documents that share a band are candidates.

Documents of equal word sequence are one representative from the start. Each band bucket links
its members to the first of them; every such pair is verified on the shingles, and verified pairs
give classes. Where a bucket still holds several classes, its members, all but the first, are then
compared across classes: a member looks only at those that share one of its rarest shingles, so
many that whoever shares none of them cannot reach the threshold. A group gives at most one link
for each of its classes, so the output never grows with the square of a bucket.

Shingles are most of what is moved. Buckets that hang together by common members are one group,
so each text's shingles go there once and, if its classes are still several, once again. What hangs
together by over ``GROUP_SHINGLES`` shingles is compared bucket by bucket, once for each set of
members; a bucket of over that many is first cut by the rule of the rarest shingles over all members of
such buckets: members meet by the rare shingles that they share, and only what is still too large is
compared in pairs of blocks, or at once if that sends fewer shingles.

No pair of different texts that shares a band is left out; a pair at the threshold shares none
with a probability of (1 - 0.8**6)**40 = 5e-6. Shingles are told apart by 64 bits of hash.

Edge cases: null and empty texts have no shingle and are alike, one class; texts of one to four
words have one shingle; texts of any length are compared whole, their darts thrown and their
shingles compared in parts of bounded size; repeated rows and doc_ids fall in the class of their
text; a null doc_id counts as the last; of classes, the smallest doc_id names them, and of rows
that tie in doc_id the smallest text hash stays. An empty table gives an empty result. Extra
columns are left out, ``deduplicated`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import _common, _words

U = _words.U
SIZE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 6
CELLS = 400_000  # of darts that are thrown at once
GROUP_SHINGLES = 500_000  # of the texts that one task compares at once
BLOCK_BITS, BLOCKS, PROBES = 32_768, 8_192, 3  # of the filter that picks out the texts to look at again
_LAST = 2**63 - 1
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 12.0)])))
_CDF = (_POISSON * 2.0**53).astype(np.uint64)
_NONE = U(2**64 - 1)


def weighted_shingles(w: _words.Words, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in rising order, their counts, and where each text begins."""
    h, first = _words.shingles(w, size)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(text[at], np.arange(len(first)))


def _throw(element: np.ndarray, unit: np.ndarray, weight: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, out: np.ndarray) -> None:
    """Throw the darts of units of elements with rank in [low, high) of each row; ``out`` keeps the earliest by coordinate.

    Dart and rank share a 64-bit value: 40 bits of rank, 24 bits that tell darts apart.
    """
    cell = _words.mixed(element + unit.astype(U) * U(0x9E3779B97F4A7C15), 17)
    begin = np.floor(low).astype(np.int64)[row]
    n = np.ceil(high).astype(np.int64)[row] - begin
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    cell = _words.mixed(np.repeat(cell, n) + step.astype(U) * U(0xD1B54A32D192ED03), 23)
    darts = np.searchsorted(_CDF, cell >> U(11), side="right")
    which = np.arange(int(darts.sum())) - np.repeat(np.cumsum(darts) - darts, darts)
    source = np.repeat(np.arange(len(cell)), darts)
    dart = _words.mixed(cell[source] + which.astype(U) * U(0x8CB92BA72F3D8DD7), 29)
    back = np.repeat(np.arange(len(row)), n)[source]
    r = row[back]
    frac = dart >> U(42)
    rank = step[source].astype(float) + frac * 2.0**-22
    more = _words.mixed(dart, 31)
    held = (rank >= low[r]) & (rank < high[r]) & (unit[back] + (more >> U(40)) * 2.0**-24 < weight[back])
    value = (step[source].astype(U) << U(46)) | (frac << U(24)) | (more & U(0xFFFFFF))
    coordinate = ((more >> U(8)) & U(0xFFFFFFFF)) * U(k) >> U(32)
    np.minimum.at(out, (r[held], coordinate[held].astype(np.int64)), value[held])


def _units(element: np.ndarray, weight: np.ndarray, row: np.ndarray, span: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(element, unit, weight, row) of all units of weight, in parts of about ``CELLS`` cells.

    A unit has ``span`` cells in its row, so neither long texts nor shingles of great weight make a
    part larger.
    """
    units = np.ceil(weight).astype(np.int64)
    cost = units * span[row]
    end = np.cumsum(cost)
    at = 0
    while at < len(units):
        stop = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + CELLS, "right")))
        n = units[at:stop]
        most = max(1, CELLS // max(1, int(span[row[at]]))) if stop == at + 1 else int(n.sum())
        for first in range(0, max(1, int(n.sum())), max(1, most)):
            flat = np.arange(first, min(int(n.sum()), first + most))
            which = at + np.searchsorted(np.cumsum(n), flat, "right")
            unit = flat - (np.cumsum(n) - n)[which - at]
            yield element[which], unit, weight[which], row[which]
        at = stop


def signatures(element: np.ndarray, weight: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """DartMinHash signatures, one row of ``k`` values for each weighted set; empty sets have none."""
    rows = len(begin) - 1
    out = np.full((rows, k), _NONE, U)
    row = np.repeat(np.arange(rows), np.diff(begin))
    total = np.bincount(row, weight, rows) if len(row) else np.zeros(rows)
    element, weight = _words.mixed(element, 13), weight.astype(float)
    darts = k * np.log(k) + 2 * k
    low, high = np.zeros(rows), darts / np.maximum(total, 1e-9)
    todo = total > 0
    while todo.any():
        mine = todo[row]
        span = np.ceil(high).astype(np.int64) - np.floor(low).astype(np.int64)
        for part in _units(element[mine], weight[mine], row[mine], span):
            _throw(*part, low, high, k, out)
        todo &= (out == _NONE).any(1)
        low, high = np.where(todo, high, low), np.where(todo, 2 * high, high)
    return out


def sketches(docs: DataFrame, size: int = SIZE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc, tkey, same (binary, equal for equal word sequences), n (distinct shingles), bands array<long>.

    ``docs`` has columns doc, tkey and text.
    """
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _words.slices(batch.column("text")):
                w = _words.words(data, offsets)
                h, n, begin = weighted_shingles(w, size)
                sig = signatures(h, n, begin, k)
                band = np.tile(np.arange(bands, dtype=U), (b - a, 1))
                for j in range(rows):
                    band = _words.mixed(band + sig[:, j::rows], j)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(band.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(a, b - a), batch.column("tkey").slice(a, b - a), pa.array(_sameness(w), pa.binary()), pa.array(np.diff(begin)), lists],
                    names=["doc", "tkey", "same", "n", "bands"],
                )

    return docs.select("doc", "tkey", "text").mapInArrow(run, "doc long, tkey long, same binary, n long, bands array<long>")


def _sameness(w: _words.Words) -> list[bytes]:
    """16 bytes for each text, equal for equal word sequences."""
    parts = [_words.mixed(_words.Ranges.of(w.hashes(s), _words.WORD_BASE).hashes(w.first[:-1], w.first[1:]) + w.count.astype(U)) for s in (6, 7)]
    return [x.tobytes() for x in np.stack(parts, 1)]


def features(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """same, h (shingle hashes in rising order) and c (their counts) of each text, once in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, _, data, offsets in _words.slices(batch.column("text")):
                w = _words.words(data, offsets)
                h, n, begin = weighted_shingles(w, size)
                at = pa.array(begin.astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (h.view(np.int64), n.astype(np.int32))]
                same = _sameness(w)
                new = [not (x in seen or seen.add(x)) for x in same]
                yield pa.RecordBatch.from_arrays([pa.array(same, pa.binary()), *lists], names=["same", "h", "c"]).filter(pa.array(new, pa.bool_()))

    return docs.select("text").mapInArrow(run, "same binary, h array<long>, c array<int>")


def _sifted(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is in ``wanted`` (column key, longs), and about one in 200 of the others; ``rows`` are not shuffled.

    A Bloom filter of 16 bits for each key is broadcast in blocks, 32 MB at most; past that many keys
    more of the others come along.
    """
    blocks = min(BLOCKS, -(-wanted.count() * 16 // BLOCK_BITS) or 1)
    block = lambda k: F.pmod(F.xxhash64(k, F.lit(0)), F.lit(blocks)).cast("int")
    bits = lambda k: [F.pmod(F.xxhash64(k, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(1, PROBES + 1)]
    held = wanted.select(block(F.col("key")).alias("__block"), F.explode(F.array(*bits(F.col("key")))).alias("bit"))
    held = held.repartition("__block").groupBy("__block").agg(F.bitmap_construct_agg("bit").alias("__held"))
    at = {f"__bit{i}": x for i, x in enumerate(bits(F.col("__key")))}
    full = rows.withColumn("__key", key).withColumns({"__block": block(F.col("__key"))} | at).join(F.broadcast(held), "__block")
    for x in at:
        full = full.where(F.expr(f"shiftright(cast(conv(hex(substring(__held, cast({x} div 8 as int) + 1, 1)), 16, 10) as int), {x} % 8) % 2 = 1"))
    return full.select(*rows.columns)


def _features_of(docs: DataFrame, ends: DataFrame, size: int) -> DataFrame:
    """``ends`` (same, rep, more) with h and c in place of rep; only documents that stand for one are looked at again."""
    chosen = _sifted(docs, F.xxhash64("doc", F.xxhash64("text")), ends.select(F.xxhash64("rep.doc", "rep.tkey").alias("key")))
    # repeated rows, and a few other texts, go here; one shuffle for the join and for leaving out repeats
    return features(chosen, size).join(ends.drop("rep").hint("merge"), "same").dropDuplicates(["same"]).drop("same")


def linked(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) between members of different classes within each group, enough to join all classes that belong together.

    ``rows``: g (group), node, cls, own, n, h, c; members with ``own`` are compared with all of the
    group. Groups are dealt into bins of about ``GROUP_SHINGLES``.
    """
    bins = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // GROUP_SHINGLES))
    full = rows.withColumn("bin", F.pmod(F.xxhash64("g"), F.lit(bins)))

    def run(table: pa.Table) -> pa.Table:
        table = table.select(["g", "node", "cls", "own", "h", "c"]).combine_chunks().sort_by("g")
        g, node, cls, own = (table.column(c).to_numpy() for c in ("g", "node", "cls", "own"))
        h, c = (_chunk(table.column(x)) for x in ("h", "c"))
        at = h.offsets.to_numpy().astype(np.int64)
        h, c = h.values.to_numpy(), c.values.to_numpy().astype(np.int64)
        edge = np.append(np.flatnonzero(np.diff(g, prepend=g[0] - 1)), len(g)) if len(g) else np.zeros(1, np.int64)
        a, b = [], []
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            inner = slice(at[i], at[j])
            for x, y in _links(h[inner], c[inner], at[i : j + 1] - at[i], cls[i:j], own[i:j], threshold):
                a.append(node[i + x])
                b.append(node[i + y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return full.groupBy("bin").applyInArrow(run, "a long, b long")


def _chunk(column: pa.ChunkedArray) -> pa.ListArray:
    out = column.combine_chunks()
    return out.chunk(0) if isinstance(out, pa.ChunkedArray) else out


def _links(h: np.ndarray, c: np.ndarray, at: np.ndarray, cls: np.ndarray, own: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """Pairs of members, at least ``threshold`` alike, that join the classes of one group; ``at`` tells where each one's shingles begin.

    If the shared weight of two members reaches ``threshold`` times the weight of one, they share
    a shingle besides the last ones of less than that weight together. So a member has to look at
    those that share one of its rarest shingles down to there.
    """
    n = len(cls)
    weight = np.add.reduceat(np.append(c, 0), at[:-1]) * (np.diff(at) > 0)
    kind, head = np.unique(cls, return_inverse=True)
    head = head.copy()  # class number of each member; linked classes get one number
    if len(kind) < 2:
        return
    code, kinds = pd.factorize(h)
    member = np.repeat(np.arange(n), np.diff(at))
    df = np.bincount(code, minlength=len(kinds))
    by_code = np.argsort(code, kind="stable")
    first = np.concatenate([[0], np.cumsum(df)])
    mark = np.zeros(len(kinds), np.int64)
    for i in np.flatnonzero(own):
        if not weight[i]:
            continue
        mine = np.arange(at[i], at[i + 1])
        mine = mine[np.argsort(df[code[mine]], kind="stable")]
        before = np.cumsum(c[mine]) - c[mine]
        rare = code[mine[before <= (1 - threshold) * weight[i] + 1e-9]]
        rare = rare[df[rare] > 1]
        if not len(rare):
            continue
        near = np.zeros(n, bool)
        near[member[by_code[_ranges(first[rare], df[rare])]]] = True
        near &= (head != head[i]) & (weight >= threshold * weight[i] - 1e-9) & (threshold * weight <= weight[i] + 1e-9)
        other = np.flatnonzero(near)
        if not len(other):
            continue
        mark[code[mine]] = c[mine]
        size = at[other + 1] - at[other]
        flat = _ranges(at[other], size)
        shared = np.add.reduceat(np.minimum(mark[code[flat]], c[flat]), np.cumsum(size) - size)
        mark[code[mine]] = 0
        alike = other[shared >= threshold * (weight[other] + weight[i] - shared) - 1e-9]
        for j in alike[np.unique(head[alike], return_index=True)[1]]:
            yield int(i), int(j)
            head[head == head[j]] = head[i]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each start, ``size`` numbers of it."""
    end = np.cumsum(size)
    return np.arange(end[-1]) - np.repeat(end - size, size) + np.repeat(start, size)


def _parted(rows: DataFrame, limit: int) -> DataFrame:
    """Groups of over ``limit`` shingles as pairs of blocks: g, node, cls, own, n.

    Members are dealt into blocks by hash; the group of blocks i <= j compares block i with j.
    """
    blocks = rows.groupBy("g").agg(F.ceil(F.sum("n") / (limit / 2)).cast("int").alias("blocks"))
    small = rows.join(blocks.where("blocks <= 2").select("g"), "g", "left_semi").withColumn("own", F.lit(True))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    large = rows.join(blocks.where("blocks > 2"), "g").withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "with"), F.greatest("block", "with")
    large = large.select(F.xxhash64("g", lo, hi).alias("g"), "node", "cls", (F.col("block") == lo).alias("own"), "n")
    return small.select("g", "node", "cls", "own", "n").unionByName(large)


def _several(rows: DataFrame) -> DataFrame:
    """Rows of the groups that hold several classes; of groups with the same members one stays, told apart by 128 bits of hash."""
    of = [F.count("*").alias("members"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"set{i}") for i in (0, 1)]]
    keys = rows.groupBy("g").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), *of).where("lo != hi")
    return rows.join(keys.groupBy("lo", "hi", "members", "set0", "set1").agg(F.min("g").alias("g")).select("g"), "g", "left_semi")


def _by_rare_shingles(members: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """Groups of ``members`` (node, cls, n) that share one of their rare shingles: g, node, cls, n.

    Shingles are put in the order of their number of members; each member counts its own from the
    rarest until the rest weighs less than ``threshold`` of it. Two members that reach the threshold
    share one of these.
    """
    each = _with_shingles(members, shingles).select("node", "cls", "n", F.explode(F.arrays_zip("h", "c")).alias("e")).select("node", "cls", "n", F.col("e.h").alias("h"), F.col("e.c").alias("c"))
    each = each.join(each.groupBy("h").agg(F.count("*").alias("df")), "h")
    order = Window.partitionBy("node").orderBy("df", "h").rowsBetween(Window.unboundedPreceding, 0)
    upto = each.withColumn("upto", F.sum("c").over(order)).withColumn("whole", F.sum("c").over(Window.partitionBy("node")))
    rare = upto.where((F.col("upto") - F.col("c") <= (1 - threshold) * F.col("whole") + 1e-9) & (F.col("df") > 1))
    return rare.select(F.xxhash64("h", F.lit(5)).alias("g"), "node", "cls", "n")


def _with_shingles(rows: DataFrame, shingles: DataFrame) -> DataFrame:
    """``rows`` with h and c of their node; of the shingles only theirs are shuffled."""
    return rows.join(_sifted(shingles.select("node", "h", "c"), F.col("node"), rows.select(F.col("node").alias("key")).distinct()), "node")


def _stars(pairs: DataFrame, ends: DataFrame, limit: int) -> DataFrame:
    """Each member with the first of its bucket, a group for each first, in parts: g, node, cls, own, n."""
    firsts = pairs.groupBy("a").agg(F.ceil(F.sum("n") / limit).cast("int").alias("parts"))
    pairs = pairs.join(firsts, "a").select("a", "node", "n", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    centres = firsts.join(ends.select(F.col("node").alias("a"), "n"), "a").select("a", F.col("a").alias("node"), "n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return pairs.unionByName(centres).select(F.xxhash64("a", "part").alias("g"), "node", F.col("node").alias("cls"), (F.col("node") == F.col("a")).alias("own"), "n")


def _crowded(mixed: DataFrame, shingles: DataFrame, threshold: float, limit: int) -> DataFrame:
    """The buckets ``mixed`` as groups, those of over ``limit`` shingles cut: g, node, cls, own, n."""
    large = mixed.groupBy("g").agg(F.sum("n").alias("all")).where(F.col("all") > limit).select("g")
    groups = mixed.join(large, "g", "left_anti").select("g", "node", "cls", F.lit(True).alias("own"), "n")
    hot = _common.written(mixed.join(large, "g", "left_semi").select("net", "node", "cls", "n").distinct(), "hot")
    if not hot.limit(1).count():
        return groups
    rare = _common.written(_several(_by_rare_shingles(hot, shingles, threshold)), "rare")
    # a text can have hundreds of rare shingles: what hangs together goes whole, in pairs of blocks, if that sends less
    sent = rare.join(hot.select("node", "net"), "node").groupBy("net").agg(F.sum("n").alias("sent"))
    whole = hot.groupBy("net").agg(F.sum("n").alias("all")).join(sent, "net")
    nets = _common.written(whole.where(F.col("all") * F.ceil(F.col("all") / (limit / 2)) < F.col("sent")).select("net"), "nets")
    apart = rare.join(hot.join(F.broadcast(nets), "net", "left_anti").select("node"), "node", "left_semi")
    blocks = hot.join(F.broadcast(nets), "net", "left_semi").select(F.xxhash64("net").alias("g"), "node", "cls", "n")
    return _parted(apart.unionByName(blocks), limit).unionByName(groups)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) as (node, class), class the smallest node: rounds of large stars and small stars.

    Nodes without an edge are left out. Each round is written, so a lost executor costs one round.
    """
    edges = _common.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while not _all_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = _common.written(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether each edge leads from a node with no other edge upward to one that has none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("e"))
    odd = ends.groupBy("e.n").agg(F.sum("e.up").alias("up"), F.count("e.up").alias("all")).where("up > 1 or (up = 1 and all > 1)")
    return not odd.limit(1).count()


def _labelled(rows: DataFrame, classes: DataFrame, name: str = "node", label: str = "class") -> DataFrame:
    c = classes.select(F.col("node").alias(name), F.col("class").alias("__class"))
    return rows.join(c, name, "left").withColumn(label, F.coalesce("__class", F.col(name))).drop("__class")


def classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SIZE, bands: int = BANDS, rows: int = ROWS, group_shingles: int = GROUP_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(sketch, texts): doc, tkey and same of every row; same, rep (doc, tkey), class and head (the first rep of its class) of every text."""
    base = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).alias("doc"), _common.text_of(docs).alias("text"))
    sketch = _common.written(sketches(base.withColumn("tkey", F.xxhash64("text")), size, bands, rows), "sketches")
    texts = sketch.groupBy("same").agg(F.min(F.struct("doc", "tkey")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    whole = _common.written(texts.withColumn("node", F.monotonically_increasing_id()), "texts")  # fixes the node numbers
    texts = whole.select("same", "rep", "node")

    member = whole.select("node", "n", F.explode("bands").alias("g"))
    bucket = Window.partitionBy("g")  # one shuffle; to count first and join then would be two
    crowd = member.withColumn("members", F.count("node").over(bucket)).withColumn("a", F.min("node").over(bucket))
    crowd = _common.written(crowd.where("members > 1").select("g", "node", "n", "a"), "buckets")
    pairs = crowd.where("node != a").select("a", "node", "n").distinct()

    # buckets that hang together, a group where they are small enough
    net = components(pairs.select("a", F.col("node").alias("b")))
    nodes = crowd.groupBy("node").agg(F.first("n").alias("n"), F.max(F.col("node") == F.col("a")).alias("first"))
    ends = _common.written(texts.join(_labelled(nodes, net, label="net"), "node"), "ends")
    shingles = _common.written(_features_of(base, ends, size), "shingles")
    wide = ends.groupBy("net").agg(F.sum("n").alias("all")).where(F.col("all") > group_shingles).select("net")
    wide = _common.written(wide, "wide")  # fewer than shingles / group_shingles
    some = bool(wide.limit(1).count())

    # each member with the first of its bucket
    groups = shingles.join(F.broadcast(wide), "net", "left_anti").select(F.xxhash64("net").alias("g"), "node", F.col("node").alias("cls"), F.col("first").alias("own"), "n", "h", "c")
    if some:
        inner = shingles.join(F.broadcast(wide), "net", "left_semi").select("node", "h", "c")
        groups = groups.unionByName(_stars(pairs.join(inner.select("node"), "node", "left_semi"), ends, group_shingles).join(inner, "node"))
    found = components(linked(groups, threshold))

    # buckets that still hold several classes; all have been compared with the first
    rest = crowd.where("node != a").select("g", "node", "n")
    mixed = _common.written(_labelled(_several(_labelled(rest, found, label="cls")), net, label="net"), "mixed")
    groups = mixed.join(F.broadcast(wide), "net", "left_anti").select(F.xxhash64("net").alias("g"), "node", "cls", F.lit(True).alias("own"), "n").distinct()
    if some:
        groups = groups.unionByName(_crowded(mixed.join(F.broadcast(wide), "net", "left_semi"), shingles, threshold, group_shingles))
    groups = _common.written(groups, "groups")
    links = linked(_with_shingles(groups, shingles), threshold)
    links = _labelled(_labelled(links, found, "a", "ca"), found, "b", "cb")
    found = _merged(found, components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
    texts = _labelled(texts, found)
    return sketch, texts.join(texts.groupBy("class").agg(F.min("rep").alias("head")), "class")


def _merged(found: DataFrame, merged: DataFrame) -> DataFrame:
    """Classes after ``merged`` (old class as node, new class) joined some of them."""
    moved = _labelled(found.withColumnRenamed("class", "old"), merged, "old", "class").select("node", "class")
    alone = merged.join(moved, "node", "left_anti")
    return _common.written(moved.unionByName(alone.select("node", "class")), "classes")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SIZE, bands: int = BANDS, rows: int = ROWS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """One row per row of ``docs``: doc_id and class_id, the smallest doc_id of its class."""
    sketch, texts = classes(docs, threshold, size, bands, rows, group_shingles)
    out = sketch.select("doc", "same").join(texts.select("same", F.col("head.doc").alias("class_id")), "same")
    return out.select(*[F.when(F.col(c) != _LAST, F.col(c)).alias(n) for c, n in (("doc", "doc_id"), ("class_id", "class_id"))])


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, size: int = SIZE, bands: int = BANDS, rows: int = ROWS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id, and of equal ids the smallest text hash."""
    _, texts = classes(docs, threshold, size, bands, rows, group_shingles)
    heads = texts.select("head").distinct().select(F.col("head.doc").alias("__doc"), F.col("head.tkey").alias("__tkey"))
    rows_ = docs.withColumn("__doc", F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST))).withColumn("__tkey", F.xxhash64(_common.text_of(docs)))
    kept = rows_.join(heads, ["__doc", "__tkey"], "left_semi")
    again = Window.partitionBy("__doc", "__tkey").orderBy("__doc")
    return kept.withColumn("__again", F.row_number().over(again)).where("__again = 1").drop("__doc", "__tkey", "__again")
