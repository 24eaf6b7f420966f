"""Snapshot reads, conflicts, locks and replicated logs as relational queries.

versions: key, txn_id, value, commit_ts (NULL until committed), seq
txns: txn_id, status (active, committed, aborted), start_ts
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCAL_EDGES = 1_000_000  # of a graph that one task takes apart alone


def snapshot(versions: DataFrame, start_ts: int, me: int | None = None) -> DataFrame:
    """key, value as a transaction sees them: its own last write, else the newest commit up to its start."""
    own = F.col("txn_id") == F.lit(me) if me is not None else F.lit(False)
    seen = versions.where(own | (F.col("commit_ts") <= start_ts))
    return seen.groupBy("key").agg(F.max_by("value", F.struct(own.alias("own"), "commit_ts", "seq")).alias("value"))


def write_conflicts(versions: DataFrame, txns: DataFrame, writes: DataFrame) -> DataFrame:
    """writes (key, txn_id) that meet an uncommitted version of another active transaction."""
    open_ = versions.where("commit_ts is null").join(txns.where("status = 'active'").select("txn_id"), "txn_id")
    open_ = open_.select("key", F.col("txn_id").alias("holder")).distinct()
    return writes.join(open_, "key").where("holder != txn_id").groupBy("key", "txn_id").agg(F.min("holder").alias("holder"))


def lost_updates(versions: DataFrame, txns: DataFrame) -> DataFrame:
    """First committer wins: commits whose key another transaction committed after they began."""
    mine = versions.where("commit_ts is not null").join(txns.select("txn_id", "start_ts"), "txn_id")
    other = mine.select("key", F.col("txn_id").alias("other"), F.col("commit_ts").alias("other_ts"))
    hit = mine.join(other, "key").where("other != txn_id and other_ts > start_ts and other_ts < commit_ts")
    return hit.select("key", "txn_id").distinct()


def collected(versions: DataFrame, before_ts: int) -> DataFrame:
    """Versions that garbage collection keeps: per key the newest commit up to ``before_ts`` and all later or open ones."""
    old = F.col("commit_ts") <= before_ts
    newest = versions.where(old).groupBy("key").agg(F.max(F.struct("commit_ts", "seq")).alias("__top"))
    kept = versions.join(newest, "key", "left")
    return kept.where(F.coalesce(~old, F.lit(True)) | (F.struct("commit_ts", "seq") == F.col("__top"))).drop("__top")


def stale_reads(read_set: DataFrame, current: DataFrame) -> DataFrame:
    """Optimistic validation: rows of read_set (txn_id, key, version) whose key has another version now."""
    now = current.select("key", F.col("version").alias("now"))
    return read_set.join(now, "key", "left").where("now is null or now != version").select("txn_id", "key")


def waits(locks: DataFrame) -> DataFrame:
    """waiter, holder edges from locks (key, txn_id, granted)."""
    holder = locks.where("granted").select("key", F.col("txn_id").alias("holder"))
    waiter = locks.where("not granted").select("key", F.col("txn_id").alias("waiter"))
    return waiter.join(holder, "key").where("waiter != holder").select("waiter", "holder").distinct()


def begun(txns: DataFrame, starting: DataFrame) -> DataFrame:
    """``txns`` with new active transactions (txn_id, start_ts); an id that is already known is not begun again."""
    new = starting.join(txns.select("txn_id"), "txn_id", "left_anti").select("txn_id", F.lit("active").alias("status"), "start_ts")
    return txns.select("txn_id", "status", "start_ts").unionByName(new)


def settled(versions: DataFrame, txns: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """versions and txns after ``decisions`` (txn_id, commit_ts; a null commit_ts aborts) on active transactions.

    A commit stamps all versions of its transaction at once, an abort takes them away; decisions on
    transactions that are not active change nothing.
    """
    due = decisions.join(txns.where("status = 'active'").select("txn_id"), "txn_id", "left_semi").select("txn_id", F.col("commit_ts").alias("__ts"), F.lit(True).alias("__due"))
    marked = versions.join(due, "txn_id", "left").where("__due is null or __ts is not null or commit_ts is not null")
    stamped = marked.withColumn("commit_ts", F.coalesce("commit_ts", "__ts")).select(*versions.columns)
    status = F.when(F.col("__due") & F.col("__ts").isNotNull(), "committed").when(F.col("__due"), "aborted").otherwise(F.col("status"))
    return stamped, txns.join(due, "txn_id", "left").withColumn("status", status).select(*txns.columns)


def _kept(df: DataFrame, counted: str = "true") -> tuple[DataFrame, int]:
    """``df`` written to the shared folder and read again, and the number of rows where ``counted`` holds, seen while writing.

    Only a local master may use a temporary folder.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-ck-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count_if(F.expr(counted)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def _trimmed(edges: DataFrame, enough: int) -> tuple[DataFrame, int]:
    """``edges`` without those that no cycle can hold: from one that nobody waits for, or to one that waits for nobody; and how many are left.

    Rounds go on while each takes at least a fiftieth and over ``enough`` are left: what remains of
    long chains is left to the labels.
    """
    (left, n), before = _kept(edges), None
    while n > enough and (before is None or n <= 0.98 * before):
        before = n
        waiters, holders = left.select(F.col("waiter").alias("holder")).distinct(), left.select(F.col("holder").alias("waiter")).distinct()
        left, n = _kept(left.join(waiters, "holder", "left_semi").join(holders, "waiter", "left_semi").select("waiter", "holder"))
    return left, n


def _strong(waiter: np.ndarray, holder: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the strongly connected parts of two and more, and the number of each one's part (Tarjan, without recursion)."""
    node, flat = np.unique(np.concatenate([waiter, holder]), return_inverse=True)
    a, b = flat[: len(waiter)], flat[len(waiter) :]
    order = np.argsort(a, kind="stable")
    to, first = b[order].tolist(), np.searchsorted(a[order], np.arange(len(node) + 1)).tolist()
    n = len(node)
    found, low, part, at, stack, seen = [0] * n, [0] * n, [-1] * n, first[:n], [], 0
    for root in range(n):
        if found[root]:
            continue
        path = [root]
        while path:
            v = path[-1]
            if not found[v]:
                seen += 1
                found[v] = low[v] = seen
                stack.append(v)
            deeper = False
            while at[v] < first[v + 1]:
                w = to[at[v]]
                if not found[w]:
                    path.append(w)  # its low is taken over when this edge is looked at again
                    deeper = True
                    break
                if part[w] < 0:
                    low[v] = min(low[v], low[w])
                at[v] += 1
            if deeper:
                continue
            path.pop()
            if low[v] == found[v]:
                w = -1
                while w != v:
                    w = stack.pop()
                    part[w] = v
    head = np.array(part, np.int64)
    many = np.bincount(head, minlength=n)[head] > 1 if n else np.zeros(0, bool)
    return node[many], node[head[many]]


def _local_parts(edges: DataFrame) -> DataFrame:
    """v, part of few edges (waiter, holder: long), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if ends:
            v, part = _strong(*(np.concatenate(x) for x in zip(*ends, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(part)], names=["v", "part"])

    return edges.select("waiter", "holder").repartition(1).mapInArrow(run, "v long, part long")


def _parts(edges: DataFrame, local: int) -> DataFrame:
    """v, part (one of its nodes) of every node in a strongly connected part of two and more of ``edges`` (waiter, holder, any type).

    Edges that no cycle can hold are trimmed. At most ``local`` edges go to one task. More of them
    are labelled: every node learns the largest one that leads to it; where that is itself, it and all
    that lead back to it with the same label are a part. Parts are taken out until few edges are left.
    The loops end when nothing changes, however long the chains; each round is written, so a lost
    executor costs one.
    """
    left, n = _trimmed(edges.where("waiter != holder").select("waiter", "holder").distinct(), local)
    kind = left.schema["waiter"].dataType
    if not isinstance(kind, T.LongType):
        names, _ = _kept(left.select(F.explode(F.array("waiter", "holder")).alias("name")).distinct().withColumn("v", F.monotonically_increasing_id()))
        numbered = left.join(names.withColumnsRenamed({"name": "waiter", "v": "a"}), "waiter").join(names.withColumnsRenamed({"name": "holder", "v": "b"}), "holder")
        parts = _numbered_parts(*_kept(numbered.select(F.col("a").alias("waiter"), F.col("b").alias("holder"))), local)
        return parts.join(names, "v").select(F.col("name").alias("v"), "part").join(names.withColumnsRenamed({"name": "head", "v": "part"}), "part").select("v", F.col("head").alias("part"))
    return _numbered_parts(left, n, local)


def _numbered_parts(left: DataFrame, n: int, local: int) -> DataFrame:
    out = left.select(F.col("waiter").alias("v"), F.col("holder").alias("part")).where("false")
    while n > local:
        label = left.select(F.explode(F.array("waiter", "holder")).alias("v")).distinct().withColumn("label", F.col("v"))
        moved = 1
        while moved:
            told = left.join(label, left["waiter"] == label["v"]).groupBy("holder").agg(F.max("label").alias("told"))
            new, moved = _kept(label.join(told, label["v"] == told["holder"], "left").select("v", F.greatest("label", "told").alias("label"), (F.col("told") > F.col("label")).alias("moved")), "moved")
            label = new.select("v", "label")
        # edges within one label; those to other labels are on no cycle
        inner = left.join(label.withColumnsRenamed({"v": "waiter", "label": "a"}), "waiter").join(label.withColumnsRenamed({"v": "holder", "label": "b"}), "holder").where("a = b").select("waiter", "holder")
        inner, _ = _kept(inner)
        part, grown = _kept(label.where("v = label").select("v"))
        front = part
        while grown:  # backward, within one label
            front, grown = _kept(inner.join(front.withColumnRenamed("v", "holder"), "holder").select(F.col("waiter").alias("v")).distinct().join(part, "v", "left_anti"))
            part = part.unionByName(front)
        part, _ = _kept(part)
        waiter, holder = part.withColumnRenamed("v", "waiter"), part.withColumnRenamed("v", "holder")
        # a part of one has no edge within itself
        on = inner.join(waiter, "waiter", "left_semi").join(holder, "holder", "left_semi")
        on = on.select(F.explode(F.array("waiter", "holder")).alias("v")).distinct().join(label, "v").withColumnRenamed("label", "part")
        out = out.unionByName(_kept(on)[0])
        left, n = _trimmed(inner.join(waiter, "waiter", "left_anti").join(holder, "holder", "left_anti"), local)
    return out.unionByName(_kept(_local_parts(left))[0]) if n else out


def deadlocked(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """Transactions on a cycle of the wait-for graph (txn_id), edges (waiter, holder); those that merely wait for one are not."""
    return _parts(edges, local).select(F.col("v").alias("txn_id"))


def deadlocked_locks(locks: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """``deadlocked`` of ``waits(locks)`` without the edges, which are as many as waiters times holders of each key.

    The graph has the keys as nodes: a transaction leads from a key that it holds to one that it
    waits for; one that does so with several on both sides is a node between them. Edges are at
    most as many as locks. A transaction is on a cycle if the strongly connected part
    that it lies in, which may be one key alone, has another one too.
    """
    lock = locks.where("txn_id is not null and key is not null").groupBy("txn_id", "key").agg(F.bool_or("granted").alias("holds"), F.bool_or(~F.col("granted")).alias("waits"))
    both = lock.groupBy("txn_id").agg(F.count_if("holds").alias("nh"), F.count_if("waits").alias("nw")).where("nh > 0 and nw > 0")
    node = F.struct("key", F.lit(None).cast(locks.schema["txn_id"].dataType).alias("txn_id"))
    through = F.struct(F.lit(None).cast(locks.schema["key"].dataType).alias("key"), "txn_id")
    lock, _ = _kept(lock.join(both, "txn_id").select("txn_id", "holds", "waits", node.alias("node"), through.alias("through"), F.expr("nh > 1 and nw > 1").alias("several")))
    held = lock.where("holds").select("txn_id", F.col("node").alias("waiter"), "through", "several")
    waited = lock.where("waits").select("txn_id", F.col("node").alias("holder"), "through", "several")
    plain = held.where("not several").select("txn_id", "waiter").join(waited.where("not several").select("txn_id", "holder"), "txn_id")
    into = held.where("several").select("txn_id", "waiter", F.col("through").alias("holder"))
    out_of = waited.where("several").select("txn_id", F.col("through").alias("waiter"), "holder")
    steps, _ = _kept(plain.unionByName(into).unionByName(out_of))
    parts, _ = _kept(_parts(steps, local))
    ends = steps.join(parts.withColumnsRenamed({"v": "waiter", "part": "a"}), "waiter", "left").join(parts.withColumnsRenamed({"v": "holder", "part": "b"}), "holder", "left")
    within = ends.select("txn_id", F.coalesce("a", "waiter").alias("part"), F.coalesce("b", "holder").alias("b")).where("part = b").select("txn_id", "part").distinct()
    several = within.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part")
    return within.join(several, "part", "left_semi").select("txn_id")


def commit_index(match: DataFrame, log: DataFrame, term: int, peers: int) -> DataFrame:
    """Highest index of ``term`` that a majority holds: match (node, match_index) of the other nodes, log (index, term)."""
    majority = (peers + 1) // 2 + 1
    place = F.row_number().over(Window.orderBy(F.desc("match_index")))  # one row per node
    held = match.withColumn("place", place).where(F.col("place") == majority - 1).select("match_index")
    mine = log.where(F.col("term") == term)
    return mine.join(F.broadcast(held), F.col("index") <= F.col("match_index")).agg(F.coalesce(F.max("index"), F.lit(0)).alias("commit_index"))


def replayed(log: DataFrame, commit: int) -> DataFrame:
    """State after the entries up to ``commit``: log (index, points array<struct<t, v>>); the newest index wins."""
    return log.where(F.col("index") <= commit).select("index", F.explode("points").alias("p")).groupBy("p.t").agg(F.max_by("p.v", "index").alias("v"))
