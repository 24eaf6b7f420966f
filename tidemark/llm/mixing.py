"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source gets a share of the total size by its weight, no more than ``most`` times its own
size; what is over is dealt out again by weight. A source is taken as often in whole as its target
allows, and the rest is drawn from its documents in a keyed random order until the
next document would pass it; documents that do not fit are passed over and the draw goes on in
rounds until none fits; one more document, whose size is nearest to what is left, closes
the gap. The draws (document, copy) are the source's blocks.

Output shards are dealt by a binary tree: a node with n blocks in all, of which some of each
source, gives its left half a multivariate-hypergeometric draw of them, seeded by the node. Every
shard thus knows its exact quota of each source by walking from the root, with no state shared,
and takes the next so many blocks of the source's random order. Within a shard, blocks are
shuffled by a keyed order.

Edge cases: null texts and sources count as such (size 0; a source of its own, last); documents
of size 0 are taken as often in whole as their source is; a very long document is taken if it fits
what is left of its source, or closes the gap best; repeated rows are documents of their own; ties
in the random orders go by doc_id and number of the copy; a total of 0 takes nothing; an empty
table gives an empty result. ``mixed_documents`` keeps extra columns, whatever their names but for
those that begin with two underscores; the others leave them out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import _common

SEED = 20
BLOCKS_PER_SHARD = 256
ROWS_PER_BIN = 2000
BROADCAST_SOURCES = 50_000
SALTS = 32
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws from ``good`` + ``bad`` are good; for any counts.

    numpy draws up to 1e9 in all. Beyond, the chances within 12 standard deviations of the mean
    (outside lies less than 1e-30) are summed from the ratios of neighbours and inverted.
    """
    total = good + bad
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    lowest, highest = max(0, n - bad), min(good, n)
    mean = n * (good / total)
    spread = 12 * math.sqrt(max(0.0, mean * (bad / total) * ((total - n) / (total - 1)))) + 50
    x = np.arange(max(lowest, int(mean - spread)), min(highest, int(mean + spread)) + 1)
    y = x[:-1].astype(float)
    log = np.concatenate([[0.0], np.cumsum(np.log((good - y) * (n - y) / ((y + 1) * (bad - n + y + 1))))])
    chance = np.cumsum(np.exp(log - log.max()))
    return int(x[min(len(x) - 1, int(np.searchsorted(chance, rng.random() * chance[-1], "right")))])


def _left_half(have: np.ndarray, draw: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate-hypergeometric draw: of each source given those before it; sources without blocks take no random number."""
    out = np.zeros_like(have)
    there = np.flatnonzero(have)
    total = int(have.sum())
    if total < 1_000_000_000:
        out[there] = rng.multivariate_hypergeometric(have[there], draw, method="marginals") if draw else 0
        return out
    for i in there.tolist():
        total -= int(have[i])
        out[i] = hypergeometric(rng, int(have[i]), total, draw) if draw else 0
        draw -= int(out[i])
    return out


def split_trees(first: int, last: int, shards: int, quota: np.ndarray, seed: int = SEED, sparse: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, sources, blocks of each before this shard, blocks in it) of the shards from ``first`` to before ``last``.

    A node of n shards gives its left half n // 2 shards and as many blocks in proportion. Only
    nodes above the wanted shards are drawn, each once; ``sparse`` leaves out sources without blocks.
    """
    source = np.flatnonzero(quota) if sparse else np.arange(len(quota))
    todo = [(0, shards, source, np.zeros(len(source), np.int64), np.asarray(quota, np.int64)[source])]
    while todo:
        low, high, source, before, have = todo.pop()
        if high <= first or low >= last:
            continue
        if high - low == 1:
            yield low, source, before, have
            continue
        mid = (low + high) // 2
        left = _left_half(have, int(have.sum()) * (mid - low) // (high - low), np.random.default_rng([seed, low, high]))
        for half in ((mid, high, before + left, have - left), (low, mid, before, left)):
            keep = half[3] > 0 if sparse else slice(None)
            todo.append((*half[:2], source[keep], half[2][keep], half[3][keep]))


def split_tree(shard: int, shards: int, quota: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of each source before this shard, blocks in it)."""
    _, _, before, own = next(split_trees(shard, shard + 1, shards, quota, seed, sparse=False))
    return before, own


@dataclass
class Sources:
    """A table of a row per source, by source_no; few of them are broadcast, many are joined with the rows salted."""

    table: DataFrame
    count: int

    def to(self, rows: DataFrame, *columns: str, on: str = "source_no") -> DataFrame:
        table = self.table.select(on, *columns)
        if self.count <= BROADCAST_SOURCES:
            return rows.join(F.broadcast(table), on)
        table = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(table, [on, "__salt"]).drop("__salt")

    def with_(self, more: DataFrame, *columns: Column | str) -> Sources:
        """``columns`` of the table joined with ``more`` (a row for some of the sources), written."""
        joined = self.table.join(more, "source_no", "left") if more is not None else self.table
        return Sources(_common.written(joined.select("source_no", *columns), "sources"), self.count)


def _sources(sized: DataFrame, weights: Sequence[float], most: float) -> Sources:
    """source_no (in the order of code points, null last), __source, source_rows, source_size, target.

    Targets are shares of the total by weight, none above ``most`` times its own size: sources over
    it are capped and the rest shared anew until none is; the driver sees only totals.
    """
    found = sized.groupBy("__source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    found = found.withColumn("name", F.col("__source.source"))
    parts = _common.written(found.repartitionByRange(F.asc_nulls_last("name")).withColumn("part", F.spark_partition_id()), "sources")
    sizes = sorted((r["part"], r["count"]) for r in parts.groupBy("part").count().collect())  # a row per partition
    begin, at = {}, 0
    for part, n in sizes:
        begin[part], at = at, at + n
    inside = Window.partitionBy("part").orderBy(F.asc_nulls_last("name"))
    start = F.element_at(F.create_map(*[F.lit(x) for kv in begin.items() for x in kv]), F.col("part")) if begin else F.lit(0)
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    table = parts.withColumn("source_no", (start + F.row_number().over(inside) - 1).cast("int")).withColumn("weight", weight)
    table = _common.written(table.drop("part", "name"), "sources")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    left, weights_left = total, None
    share, cap = F.lit(0.0), most * F.col("source_size").cast("double")
    while True:
        over = F.lit(False) if weights_left is None else share > cap
        took, free = table.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        now = (total - (took or 0.0), free or 0.0)
        if now == (left, weights_left) or not now[1]:
            break
        left, weights_left = now
        share = F.lit(left) * F.col("weight") / F.lit(weights_left)
    return Sources(_common.written(table.withColumn("target", F.least(share, cap)).drop("weight"), "sources"), at)


def _ranked(rows: DataFrame, order: Column, amount: Column) -> DataFrame:
    """Add rank (from 0) and before (the amount of earlier rows) within each source by ``order`` (a long).

    Rows are cut into bins of the order, so even a source with a third of all rows is spread; the
    bins' totals, a row per source and bin, give where each bin begins.
    """
    bins = F.ceil(F.col("source_rows") / ROWS_PER_BIN)
    rows = rows.withColumn("__order", order).withColumn("__amount", amount).withColumn("__bin", F.floor((F.col("__order") / 2.0**64 + 0.5) * bins))
    bin_ = rows.groupBy("source_no", "__bin").agg(F.count("*").alias("__n"), F.sum("__amount").alias("__sum"))
    past = Window.partitionBy("source_no").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bin_ = bin_.select("source_no", "__bin", F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__sum").over(past), F.lit(0)).alias("__sum0"))
    inside = Window.partitionBy("source_no", "__bin").orderBy("__order", "doc_id", "again")
    rows = rows.join(bin_, ["source_no", "__bin"])
    rows = rows.withColumn("rank", F.col("__n0") + F.row_number().over(inside) - 1)
    rows = rows.withColumn("before", F.col("__sum0") + F.coalesce(F.sum("__amount").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.drop("__order", "__amount", "__bin", "__n0", "__sum0")


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with text_key and again: rows equal in doc_id and text are numbered, so three columns name a row."""
    rows = docs.withColumn("text_key", F.xxhash64("text", F.lit(seed)))
    same = Window.partitionBy("doc_id", "text_key").orderBy("source")
    return rows.withColumn("again", F.row_number().over(same))


def _filled(ids: DataFrame, sources: Sources, order: Column) -> tuple[DataFrame, Sources]:
    """Go on drawing past the documents that did not fit, until no other fits what is ``left`` of its source.

    If the largest document that fits is more than half of what is left, it is picked (by rank);
    else the draw is repeated over those that fit, and ends short of one of them. Either way a round
    leaves less than half, so their number is at most the logarithm of the words.
    """
    fitting = F.expr("not taken and size > 0 and size <= left + 1e-6 and not array_contains(picked, rank)")
    largest = F.max(F.struct("size", (-F.col("rank")).alias("rank"))).alias("top")
    far = F.expr("2 * top.size <= left")
    while True:
        found = sources.to(ids, "left", "picked").where(fitting).groupBy("source_no").agg(largest)
        sources = sources.with_(found, "left", "picked", "top")
        ends = {r["far"] for r in sources.table.where("top is not null").select(far.alias("far")).distinct().collect()}
        if not ends:
            return ids, sources
        sums = None
        if True in ends:
            drawn = Sources(sources.table.withColumn("left", F.when(far, F.col("left")).otherwise(-1.0)), sources.count)
            rows = drawn.to(ids.drop("before"), "left", "picked").withColumn("fitting", fitting).drop("rank", "picked")
            rows = _ranked(rows, order, F.when(F.col("fitting"), F.col("size")).otherwise(0))
            rows = rows.withColumn("new", F.col("fitting") & (F.col("before") + F.col("size") <= F.col("left") + 1e-6))
            rows = _common.written(rows.withColumn("taken", F.col("taken") | F.col("new")).drop("left", "fitting"), "ranked")
            sums = rows.where("new").groupBy("source_no").agg(F.sum("size").alias("drawn"))
            ids = rows.drop("new")
        near = F.coalesce(~far, F.lit(False))
        drawn = F.coalesce(F.col("drawn"), F.lit(0)) if sums is not None else F.lit(0)
        left = (F.col("left") - drawn - F.when(near, F.col("top.size")).otherwise(0)).alias("left")
        picked = F.when(near, F.array_append("picked", -F.col("top.rank"))).otherwise(F.col("picked")).alias("picked")
        sources = sources.with_(sums, left, picked)


def mixed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = SEED) -> DataFrame:
    """doc_id, text_key, again, size, source_no, source_rows, source_size, target, copies for each row of ``docs``.

    What is known of each source is a row of a table; the driver sees totals alone.
    """
    sized = docs.select("doc_id", "source", word_count(docs["text"]).alias("size"), "text")
    sized = _keyed(sized, seed).select("doc_id", "text_key", "again", F.struct("source").alias("__source"), "size")
    sized = _common.written(sized, "sized")
    known = _sources(sized, weights, most)
    rows = known.to(sized, "source_no", "source_rows", "source_size", "target", on="__source").drop("__source")
    order = F.xxhash64("doc_id", "text_key", F.lit(seed))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(int(most)))).otherwise(0)
    rest = F.greatest(F.lit(0.0), F.when(whole < int(most), F.col("target") - whole * F.col("source_size")).otherwise(0.0))
    fits = (F.col("before") + F.col("size") <= rest + 1e-6) & (rest > 0)
    # documents larger than the whole rest can never fit and do not count for the others
    ids = _ranked(rows, order, F.when(F.col("size") <= rest + 1e-6, F.col("size")).otherwise(0))
    ids = _common.written(ids.withColumn("taken", fits), "ranked")
    sums = ids.where("taken").groupBy("source_no").agg(F.sum("size").alias("drawn"))
    known = known.with_(sums, (rest - F.coalesce("drawn", F.lit(0))).alias("left"), F.array().cast("array<long>").alias("picked"))
    ids, known = _filled(ids, known, order)
    short = known.to(ids, "left", "picked").where("not taken and not array_contains(picked, rank)")
    gap = F.abs(F.col("left") - F.col("size"))
    last = short.where(gap < F.col("left")).groupBy("source_no").agg(F.min(F.struct(gap.alias("gap"), "rank"))["rank"].alias("one"))
    known = known.with_(last, F.when(F.col("one").isNotNull(), F.array_append("picked", F.col("one"))).otherwise(F.col("picked")).alias("picked"))
    more = F.col("taken") | F.array_contains("picked", F.col("rank"))
    return known.to(ids, "picked").withColumn("copies", (whole + more.cast("int")).cast("int")).drop("rank", "before", "taken", "picked")


def dealt(rows: DataFrame, blocks_per_shard: int = BLOCKS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """``mixed`` rows as blocks, one per document and copy, each with its output shard and its place there.

    The tree's root, a number for each source, is all that the driver holds.
    """
    spark = rows.sparkSession
    blocks = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).where("copy <= copies")
    quota = rows.groupBy("source_no").agg(F.sum("copies").alias("n")).toPandas()
    have = np.zeros(int(quota["source_no"].max()) + 1 if len(quota) else 0, np.int64)
    have[quota["source_no"]] = quota["n"]
    shards = max(1, -(-int(have.sum()) // blocks_per_shard))
    root = spark.sparkContext.broadcast(have)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, source, before, own in split_trees(int(batch["id"].min()), int(batch["id"].max()) + 1, shards, root.value, seed):
                yield pd.DataFrame({"source_no": source.astype(np.int32), "doc_id": shard, "shard": shard, "low": before, "high": before + own})

    parts = spark.range(shards).mapInPandas(walk, "source_no int, doc_id long, shard long, low long, high long")
    # a block's shard by an equi-join on stretches of ranks, each about as long as a shard's part
    per = rows.groupBy("source_no").agg(F.greatest(F.lit(1).cast("long"), F.floor(F.sum("copies") / shards)).alias("per"))
    per = Sources(per, len(quota))
    parts = per.to(parts, "per").drop("doc_id")
    parts = parts.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("low") / F.col("per")), F.floor((F.col("high") - 1) / F.col("per"))))).drop("per")
    ranked = per.to(_ranked(blocks, F.xxhash64("doc_id", "text_key", "copy", F.lit(seed + 1)), F.lit(0)), "per")
    ranked = ranked.withColumn("stretch", F.floor(F.col("rank") / F.col("per"))).drop("per", "before")
    placed = ranked.join(parts, ["source_no", "stretch"]).where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    inside = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "text_key", "copy", F.lit(seed + 2)), "doc_id", "again", "copy")
    return placed.withColumn("place", F.row_number().over(inside) - 1).drop("rank", "low", "high", "stretch")


def mix_report(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, and places: array<struct<shard, place>> of the copies."""
    rows = _common.written(mixed(docs, weights, most, seed), "mixed")
    key = [F.col(c).alias(f"__{c}") for c in ("doc_id", "text_key", "again")]
    places = dealt(rows, seed=seed).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("shard", "place"))).alias("places"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return rows.join(places, _same_row(), "left").select("doc_id", "size", "source_size", "target", taken, "copies", "places")


def _same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("text_key") == F.col("__text_key")) & (F.col("again") == F.col("__again"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, by output shard and place in it.

    The texts move twice: to their blocks, and with them to the shards.
    """
    blocks = dealt(_common.written(mixed(docs, weights, most, seed), "mixed"), seed=seed)
    blocks = blocks.select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "text_key", "again", "shard", "place")])
    rows = _keyed(docs, seed).join(blocks, _same_row())
    return rows.repartition(F.col("__shard")).sortWithinPartitions("__shard", "__place").select(*docs.columns)
