"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree cuts the space by random directions at the median of a bounded, hashed sample
(``FIT_ROWS``), level by level; every vector is then led down every tree, so all rows are indexed.
A query opens the trees' leaves in the order of a priority queue that all trees share: a node's
priority is the least margin by which the query lies on its side of the cuts above. Priorities
never rise on the way down, so the queue yields leaves by falling priority; they are opened until
they hold ``share`` of the rows of all trees. Candidates of the opened leaves are reranked exactly,
in double precision, on the original vectors.

Unless given, ``share`` is measured: for sampled queries and their true neighbours in the sample
it is what opens a leaf of ``TARGET`` of these. Vectors in clusters need a few leaves; independent
random directions in many dimensions need most of the table, whatever the index.

The largest inner product is the nearest angle once each vector gets one more component that
makes all lengths equal; the trees work on these.

Equal vectors are one candidate with their smallest ids (one more than asked for, as a query's
own id does not count), and equal queries one query, so copies cost nothing. Leaves of more than
``CHUNK`` rows are searched in chunks by several tasks; a vector is sent once to each of its leaves,
and again only for each ``QUERY_BLOCK`` queries that open it.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor
do vectors of another length than most have (no inner product is defined for them), nor rows with
a null id; with fewer candidates than asked for all are returned; rows with one id are one
candidate, at its best; ties in score go to the smaller id; repeated rows count once; an empty table
gives an empty result; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import _common

FIT_ROWS = 20_000
TREES = 8
LEAF_ROWS = 128
LEAST_SAMPLE = 16  # sampled rows that a leaf keeps
TARGET = 0.96  # of the neighbours that the opened leaves are to hold
TRIALS = 300
CHUNK = 4096
QUERY_BLOCK = 16384
PROBED = 1024  # queries that one task leads to leaves


@dataclass
class Forest:
    """Complete trees in heap order: a direction and a cut for each inner node."""

    directions: np.ndarray  # trees x nodes x (dim + 1)
    cuts: np.ndarray  # trees x nodes
    depth: int
    length: float  # that all vectors get

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        size = np.linalg.norm(x, axis=1)
        if query:
            return np.concatenate([x / size[:, None], np.zeros((len(x), 1))], 1)
        rest = np.sqrt(np.maximum(0.0, 1 - (size / self.length) ** 2))
        return np.concatenate([x / self.length, rest[:, None]], 1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        x = self.lifted(x, False)
        out = np.zeros((len(x), len(self.directions)), np.int32)
        for t, (d, c) in enumerate(zip(self.directions, self.cuts, strict=True)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, d[node]) > c[node])
            out[:, t] = node - len(c)
        return out

    def priorities(self, x: np.ndarray) -> np.ndarray:
        """Priority of every leaf for every query: rows x trees x leaves."""
        x = self.lifted(x, True)
        out = []
        for d, c in zip(self.directions, self.cuts, strict=True):
            p = np.full((len(x), 1), np.inf)
            margin = x @ d.T - c if self.depth else None
            for level in range(self.depth):
                m = margin[:, 2**level - 1 : 2 ** (level + 1) - 1]
                p = np.stack([np.minimum(p, -m), np.minimum(p, m)], 2).reshape(len(x), -1)
            out.append(p)
        return np.stack(out, 1)

    def opened(self, x: np.ndarray, sizes: np.ndarray, share: float) -> Iterator[np.ndarray]:
        """For each query the leaves (tree * leaves + leaf) in the order the shared queue yields them."""
        flat = sizes.ravel()
        need = share * flat.sum()
        for p in self.priorities(x).reshape(len(x), -1):
            order = np.argsort(-p, kind="stable")
            held = np.cumsum(flat[order])
            yield order[: int(np.searchsorted(held, need)) + 1]


def grow(sample: np.ndarray, length: float, depth: int, trees: int = TREES, seed: int = 3) -> Forest:
    """Random directions, cut at the median of the sample's rows in each node."""
    rng = np.random.default_rng(seed)
    dim, nodes = sample.shape[1] + 1, 2**depth - 1
    forest = Forest(np.zeros((trees, nodes, dim)), np.zeros((trees, nodes)), depth, length)
    x = forest.lifted(sample, False)
    for t in range(trees):
        d = rng.normal(size=(nodes, dim))
        forest.directions[t] = d / np.linalg.norm(d, axis=1, keepdims=True)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            side = np.einsum("ij,ij->i", x, forest.directions[t][node])
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = side[node == k]
                forest.cuts[t, k] = np.median(mine) if len(mine) else 0.0
            node = 2 * node + 1 + (side > forest.cuts[t][node])
    return forest


def needed_share(forest: Forest, sample: np.ndarray, leaf: np.ndarray, k: int, target: float = TARGET, trials: int = TRIALS) -> float:
    """The share of the rows of all trees to be opened so that ``target`` of the true neighbours are found, by ``trials`` sampled queries.

    ``leaf`` has the leaf (tree * leaves + leaf) of each sampled row in each tree.
    """
    sizes = np.bincount(leaf.ravel(), minlength=forest.directions.shape[0] << forest.depth)
    asked = np.random.default_rng(9).permutation(len(sample))[:trials]
    needs = [np.zeros(0)]
    for q, p in zip(asked, forest.priorities(sample[asked]).reshape(len(asked), -1), strict=True):
        order = np.argsort(-p, kind="stable")
        before = np.zeros(len(order))
        before[order] = (np.cumsum(sizes[order]) - sizes[order]) / leaf.size
        score = sample @ sample[q]
        score[q] = -np.inf
        near = np.argsort(-score)[: min(k, len(sample) - 1)]
        needs.append(before[leaf[near]].min(1))
    needs = np.concatenate(needs)
    return float(np.quantile(needs, target)) + 1e-9 if len(needs) else 1.0


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """id, v (array<double>) of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(good, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == sizes["n"]) if sizes else rows


def _stacked(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _bars(x: np.ndarray, opened: list[np.ndarray], sample: np.ndarray, leaf: np.ndarray, n: int) -> np.ndarray:
    """For each query a score that its n-th best candidate reaches: the n-th best of the sampled rows in its opened leaves.

    What is below cannot be among the n best, so it need not leave the leaf's task.
    """
    out = np.full(len(x), -np.inf)
    scores = x @ sample.T
    for i, o in enumerate(opened):
        inside = np.zeros(int(leaf.max()) + 1 if len(leaf) else 0, bool)
        inside[o[o < len(inside)]] = True
        s = scores[i, inside[leaf].any(1)]
        if len(s) >= n:
            best = np.partition(s, len(s) - n)[len(s) - n]
            out[i] = best - 1e-9 * max(1.0, abs(best))
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_: str = "vec_id", vector: str = "embedding", trees: int = TREES, leaf_rows: int = LEAF_ROWS, share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product for each row where ``is_query`` (of column id) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_, vector)
    alike = Window.partitionBy("v").orderBy("id")
    least = rows.distinct().withColumn("__n", F.row_number().over(alike)).where(F.col("__n") <= k + 1)
    classes = least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("c", F.monotonically_increasing_id())
    classes = _common.written(classes, "vectors")
    asking = rows.where(is_query).distinct()
    count, length = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    kinds = "query_id long, rank int, vec_id long, score double"
    if not count:
        return spark.createDataFrame([], kinds)
    sample = _common.hash_sample(classes, F.col("ids")[0], FIT_ROWS).select("v").toArrow()
    sample = _stacked(sample.column("v"))
    depth = max(0, min(int(np.log2(max(1, count / leaf_rows))), int(np.log2(max(1, len(sample) / LEAST_SAMPLE)))))
    grown = grow(sample, length * (1 + 1e-9), depth, trees)
    leaves = 2**depth
    forest = spark.sparkContext.broadcast(grown)
    home = grown.leaves(sample) + np.arange(trees) * leaves
    share = max(needed_share(grown, sample, home, k) if share is None else share, min(1.0, 4 * (k + 1) / count))
    fitted = spark.sparkContext.broadcast((sample, home))  # FIT_ROWS rows

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                leaf = forest.value.leaves(_stacked(b.column("v"))) + np.arange(trees, dtype=np.int32) * leaves
                yield pa.RecordBatch.from_arrays([b.column("c"), b.column("v"), b.column("ids"), pa.array(list(leaf), pa.list_(pa.int32()))], names=["c", "v", "ids", "leaf"])

    indexed = _common.written(classes.select("c", "v", "ids").mapInArrow(lead, "c long, v array<double>, ids array<long>, leaf array<int>"), "indexed")
    held = indexed.select(F.explode("leaf").alias("leaf")).groupBy("leaf").count().collect()  # trees * leaves rows at most
    sizes = np.zeros(trees * leaves, np.int64)
    for r in held:
        sizes[r["leaf"]] = r["count"]
    chunks = np.maximum(1, -(-sizes // CHUNK))
    shared = spark.sparkContext.broadcast((sizes.reshape(trees, leaves), chunks))

    ask = asking.groupBy("v").agg(F.min("id").alias("q"))
    n_asked = ask.count()
    blocks = max(1, -(-int(n_asked * share) // QUERY_BLOCK))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, chunk = shared.value
        for b in batches:
            for a in range(0, len(b), 256):
                part = b.slice(a, 256)
                x = _stacked(part.column("v"))
                opened = list(forest.value.opened(x, size, share))
                n = [len(o) for o in opened]
                bar = _bars(x, opened, *fitted.value, k + 1)
                row, leaf = np.repeat(np.arange(len(part)), n), np.concatenate(opened)
                times = chunk[leaf]
                row, leaf = np.repeat(row, times), np.repeat(leaf, times)
                piece = np.arange(len(leaf)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([part.column("q").take(pa.array(row)), part.column("v").take(pa.array(row)), pa.array(leaf.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(bar[row])], names=["q", "v", "leaf", "chunk", "bar"])

    asked = ask.select("q", "v").repartition(max(1, -(-n_asked // PROBED)), "q").mapInArrow(probe, "q long, v array<double>, leaf int, chunk int, bar double").withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))

    rows_ = indexed.select("c", "v", "ids", F.explode("leaf").alias("leaf"))
    rows_ = rows_.withColumn("chunk", F.pmod(F.xxhash64("c"), F.element_at(F.lit(chunks.tolist()), F.col("leaf") + 1)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"q": [], "c": [], "ids": [], "score": []}
        if len(left) and len(right):
            x, q = _stacked(right.column("v")), left.column("q").to_numpy()
            c, ids = right.column("c").to_numpy(), right.column("ids").combine_chunks()
            first = np.array([i[0].as_py() for i in ids], np.int64)
            least = left.column("bar").to_numpy()
            for a in range(0, len(left), 256):
                score = _stacked(left.column("v").slice(a, 256)) @ x.T
                n = min(k + 1, score.shape[1])
                bar = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
                r, j = np.nonzero(score >= bar[:, None])
                order = np.lexsort((first[j], -score[r, j], r))
                r, j = r[order], j[order]
                begin = np.searchsorted(r, np.arange(score.shape[0]))
                near = (np.arange(len(r)) - begin[r] < n) & (score[r, j] >= least[a + r])
                r, j = r[near], j[near]
                out["q"].append(q[a + r])
                out["c"].append(c[j])
                out["ids"].append(j)
                out["score"].append(score[r, j])
        flat = {n: np.concatenate(v) if v else np.zeros(0, np.int64) for n, v in out.items()}
        picked = right.column("ids").combine_chunks().take(pa.array(flat["ids"])) if len(flat["q"]) else pa.array([], pa.list_(pa.int64()))
        return pa.table({"q": pa.array(flat["q"], pa.int64()), "ids": picked, "score": pa.array(flat["score"].astype(float), pa.float64())})

    keys = ["leaf", "chunk", "block"]
    found = asked.groupBy(*keys).cogroup(rows_.groupBy(*keys)).applyInArrow(rerank, "q long, ids array<long>, score double")
    best = found.groupBy("q", F.col("ids")[0].alias("c")).agg(F.first("ids").alias("ids"), F.max("score").alias("score"))
    # a class of equal vectors behind k + 1 others has no id among the nearest k
    ahead = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    best = best.withColumn("n", F.row_number().over(ahead)).where(F.col("n") <= k + 1)
    wide = best.select("q", "score", F.explode("ids").alias("vec_id")).groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    near_q = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = wide.withColumn("n", F.row_number().over(near_q)).where(F.col("n") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    each = asking.join(ask.select("v", "q"), "v").select(F.col("id").alias("query_id"), "q").join(top, "q")
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(own).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
