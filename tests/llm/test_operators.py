import collections
import hashlib
import os
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import _words, ann, fingerprints, licences, mixing, neardup, packing, pii, secrets, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns that clash with the operators' own."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    made = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (1, "another text of doc one", "s"), (None, "x y z", None), (2, None, "s"), (3, "", "t"), (4, " \t\n", "t"), (5, long, "t"), (6, long + " end", None), (None, None, None)]
    df = frame(spark, made)
    for c in ("doc", "bucket", "group", "rep", "same", "start", "score", "size", "copy", "rank", "spans", "licences", "sequence_id", "shard", "key", "extra"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, []).where("false")


def test_repeats(docs, rows):
    got = {tuple(r) for r in substrings.remove_repeats(docs).collect()}
    assert got == set(brute.repeats(rows))


@pytest.mark.parametrize("seed", range(3))
def test_repeats_small_alphabet(spark, seed):
    rng = random.Random(seed)
    made = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(30)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in substrings.remove_repeats(df, 6).collect()} == set(brute.repeats(made, 6))


def test_repeats_odd(odd, none):
    got = substrings.remove_repeats(odd, with_text=True).collect()
    assert len(got) == 10 and substrings.remove_repeats(none).count() == 0
    by = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in got)
    assert by[(1, 6, 0)] == 2 and by[(5, 60000, 59003)] == 1
    assert [r.n_words - r.n_removed for r in got if r.doc_id == 6] == [1]


def test_substrings_frequent_run(spark):
    """A run of four words that is in most windows: its windows go to many buckets, and the result stays the same."""
    rng = random.Random(8)
    run = lambda c: substrings._least(_words.words(np.frombuffer(c.encode(), np.uint8), np.array([0, len(c)])).hashes(5), 4)[0]
    common = min((f"alpha beta gamma d{k}" for k in range(100)), key=run)  # small, so that it is the smallest where it occurs
    texts = [" ".join(f"{common} w{rng.randrange(3000)} w{rng.randrange(3000)}" for _ in range(60)) for _ in range(60)]
    made = [(i, f"{t} {texts[i // 2]}" if i % 3 else t) for i, t in enumerate(texts)] + [(100 + i, texts[i]) for i in range(5)]
    df = frame(spark, [(d, t, "s") for d, t in made]).repartition(3)
    base = df.select(F.col("doc_id").alias("doc"), "text")
    runs, parts = substrings.frequent_runs(base, 20, sum(len(t) for _, t in made), 4000)
    assert len(runs) >= 1 and parts.max() >= 4
    got = {tuple(r) for r in substrings.remove_repeats(df, bucket_bytes=4000).collect()}
    assert got == set(brute.repeats(made)) == {tuple(r) for r in substrings.remove_repeats(df).collect()}


def test_near_duplicates(docs, rows):
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == brute.classes(rows)


def test_near_duplicates_of_chains(spark):
    """Each text is near only to the next: all are one class, though the ends have little in common."""
    base = [f"t{i}" for i in range(400)]
    made = [(k, " ".join(base[12 * k : 12 * k + 220])) for k in range(12)] + [(50, "quite another text with more than five words"), (51, "quite another text with more than five words")]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    want = brute.classes(made)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()} == want
    assert sorted(r.doc_id for r in neardup.deduplicated(df).collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("limit", [3_000, 500_000])
def test_near_duplicates_in_a_crowded_bucket(spark, limit):
    """Texts that share most of their words: many are a little under the threshold, some chains reach it. Small limits take the way for large buckets."""
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(80)]
    made = [(i, " ".join(shared + [f"own{i}x{j}" for j in range(10 + i % 12)])) for i in range(150)]
    for i in range(150, 200):
        w = made[rng.randrange(i)][1].split()
        w[rng.randrange(len(w))] = f"edit{i}"
        made.append((i, " ".join(w)))
    made += [(200 + i, " ".join(rng.choice(["to", "be", "or", "not"]) for _ in range(12))) for i in range(60)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df, group_shingles=limit).collect()}
    assert got == brute.classes(made)


def test_near_duplicates_are_compared_once(spark, monkeypatch):
    """Pairs and threes a little under the threshold share many bands: the first has been compared, the two others of a three meet once."""
    seen, linked = [], neardup.linked
    monkeypatch.setattr(neardup, "linked", lambda rows, *more: seen.append(rows.groupBy("g").agg(F.collect_set("node").alias("of")).collect()) or linked(rows, *more))
    made = []
    for k in range(30):
        w = [f"w{k}x{i}" for i in range(200)]
        made += [(len(made) + j, " ".join(w[:150] + [f"own{k}x{j}x{i}" for i in range(30)])) for j in range(2 + k % 2)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()} == {i: i for i, _ in made} == brute.classes(made)
    again = [frozenset(r.of) for r in seen[1]]
    assert again and len(again) == len(set(again)) <= 15 and {len(x) for x in again} == {2}


@pytest.mark.parametrize("limit", [600, 500_000])
def test_near_duplicates_move_shingles_once(spark, monkeypatch, limit):
    """Chains of texts meet in buckets of several firsts: shingles of what hangs together go to one group, and again only where classes are still apart."""
    seen, linked = [], neardup.linked
    monkeypatch.setattr(neardup, "linked", lambda rows, *more: seen.append([r.node for r in rows.select("node").collect()]) or linked(rows, *more))
    made = []
    for k in range(8):
        w = [f"w{k}x{i}" for i in range(400)]
        made += [(len(made) + j, " ".join(w[(8 + 7 * (k % 2)) * j :][:200])) for j in range(10)]  # near in each second chain, under the threshold in the others
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df, group_shingles=limit).collect()} == brute.classes(made)
    assert len(seen) == 2 and len(set(seen[0])) > 60
    if limit > 600:  # beyond the limit buckets are groups of their own
        assert len(seen[0]) == len(set(seen[0])) and len(seen[1]) == len(set(seen[1]))


def test_sifted_keeps_all_that_is_wanted(spark):
    """None of the wanted keys is lost, few others come along, and columns and repeated rows stay."""
    rows = spark.range(60_000, numPartitions=3).select(F.col("id").alias("node"), F.lit("x").alias("block")).repartition(4)
    for wanted in (spark.range(0, 60_000, 7), spark.range(3), spark.range(0)):
        want = {r.id for r in wanted.collect()}
        got = neardup._sifted(rows.union(rows), F.col("node"), wanted.select(F.col("id").alias("key"))).collect()
        count = collections.Counter(r.node for r in got)
        assert want <= set(count) and set(count.values()) <= {2} and len(count) <= 1.02 * len(want) + 600 * bool(want)
        assert not got or got[0].asDict().keys() == {"node", "block"}


def test_near_duplicates_of_repeated_rows(spark):
    """Rows repeated in many partitions, with an id and without one, stand for one text each."""
    w = [f"w{i}" for i in range(120)]
    made = [(3, " ".join(w)), (4, " ".join(w[:60] + ["x"] + w[60:])), (5, " ".join(w[5:])), (None, " ".join(w[1:]))]
    df = spark.createDataFrame(made * 6, "doc_id long, text string").repartition(9)
    got = neardup.near_duplicates(df).collect()
    assert collections.Counter((r.doc_id, r.class_id) for r in got) == {(i, 3): 6 for i in (3, 4, 5, None)}
    assert [r.doc_id for r in neardup.deduplicated(df).collect()] == [3]


def test_near_duplicates_of_texts_with_many_rare_shingles(spark, monkeypatch):
    """Large buckets whose members share hundreds of rare shingles: shingles are sent a bounded number of times, not once for each."""
    seen, linked, rng = [], neardup.linked, random.Random(5)
    monkeypatch.setattr(neardup, "linked", lambda rows, *more: seen.append(rows.select("node").count()) or linked(rows, *more))
    shared, phrases = [f"s{i}" for i in range(200)], [[f"p{k}x{i}" for i in range(20)] for k in range(12)]
    made = [(i, " ".join(shared + [w for k in sorted(rng.sample(range(12), 3)) for w in phrases[k]] + [f"own{i}x{j}" for j in range(40)])) for i in range(60)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df, group_shingles=2_000).collect()} == brute.classes(made)
    assert 0 < seen[1] <= 60 * 16


def test_signatures_in_bounded_parts():
    """Long texts, heavy shingles and many short texts give the same darts in small parts as at once."""
    rng = np.random.default_rng(4)
    size = np.array([3, 0, 5000, 40, 1, 8, 8, 8])
    h = rng.integers(0, 2**63, size.sum()).astype(np.uint64)
    w = rng.integers(1, 4, size.sum())
    w[size[:3].sum()] = 70_000
    begin = np.concatenate([[0], np.cumsum(size)])
    whole = neardup.signatures(h, w, begin, 64)
    cells, neardup.CELLS = neardup.CELLS, 5_000
    try:
        assert (neardup.signatures(h, w, begin, 64) == whole).all()
        parts = [len(e) * 100 for e, *_ in neardup._units(h, w.astype(float), np.repeat(np.arange(8), size), np.full(8, 100))]
        assert max(parts) <= 5_000 and sum(parts) == 100 * w.sum()
    finally:
        neardup.CELLS = cells


def test_near_duplicates_odd(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == 10 and neardup.near_duplicates(none).count() == 0
    assert collections.Counter(r.class_id for r in got if r.doc_id in (5, 6)) == {5: 2}
    assert neardup.deduplicated(odd).count() == 5  # two texts of doc 1, x y z, the empty ones, the long ones


def test_signature_estimates_weighted_similarity():
    h = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = np.ones(300), np.ones(300)
    a[:50] = 3
    sig = neardup.signatures(np.concatenate([h[:300], h[100:400]]), np.concatenate([a, b]), np.array([0, 300, 600]), 2000)
    assert abs((sig[0] == sig[1]).mean() - 200 / 500) < 0.05 and not (sig == neardup._NONE).any()
    half = neardup.signatures(np.concatenate([h[:10], h[:10]]), np.concatenate([np.full(10, 0.5), np.full(10, 1.0)]), np.array([0, 10, 20]), 1000)
    assert abs((half[0] == half[1]).mean() - 0.5) < 0.06


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    rows = sorted(rows)
    off = []
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b, c = (set(brute.shingles(x)) for x in (t, e, n))
        off.append((got[d].near_edited - len(a & b) / max(1, len(a | b)), got[d].near_next - len(a & c) / max(1, len(a | c))))
    assert np.abs(off).max() < 0.12 and np.std(off, axis=0).max() < 0.03
    same = collections.defaultdict(set)
    for d, t in rows:
        same[t].add(got[d].fingerprint)
    assert all(len(s) == 1 for s in same.values())


def test_fingerprints_odd(spark, odd, none):
    got = fingerprints.fingerprints(odd).collect()
    assert len(got) == 10 and fingerprints.fingerprints(none).count() == 0
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    one = fingerprints.fingerprints(frame(spark, [(7, "a b c d e f g h", "s")])).first()
    assert one.near_next == 1.0


def test_fingerprint_partitions_join_up(spark):
    made = [(i * 3, f"text number {i} with some words", "s") for i in range(200)]
    df = frame(spark, made).repartition(7)
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.fingerprints(df).collect()}
    for i, (d, t, _) in enumerate(made):
        n, q = made[(i + 1) % 200][1], len(t) // 4
        assert got[d] == hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()


def nearest(ids, v, q, k):
    s = v @ v[q]
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]]
    return [ids[i] for i in order[:k]]


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 16)).astype("f4")
    v[100:400] = v[100]  # copies
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 20 == 0, 20, leaf_rows=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    d = v.astype("f8")
    hits = [len(set(got[q]) & set(nearest(ids, d, q, 20))) / 20 for q in range(0, 3000, 20)]
    assert all(len(x) == 20 for x in got.values()) and len(got) == 150 and np.mean(hits) >= 0.9
    assert got[120] == nearest(ids, d, 120, 20) and 120 not in got[120]


@pytest.mark.parametrize("kind, n", [("random", 4000), ("clusters", 4000), ("random", 500)])
def test_neighbours_recall(spark, kind, n):
    """At least 0.9 of the true neighbours in 64 dimensions; vectors in clusters are found in a small part of the table."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(n, 64))
    if kind == "clusters":
        v = (rng.normal(size=(100, 64)) * 3)[rng.integers(0, 100, n)] + 0.5 * v
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 20 == 0).collect():
        got[r.query_id].append(r.vec_id)
    ids = np.arange(n)
    assert np.mean([len(set(got[q]) & set(nearest(ids, v, q, 20))) / 20 for q in range(0, n, 20)]) >= 0.9
    depth = int(np.log2(n / ann.LEAF_ROWS))
    f = ann.grow(v, np.linalg.norm(v, axis=1).max() * 1.001, depth)
    share = ann.needed_share(f, v, f.leaves(v) + np.arange(ann.TREES) * 2**depth, 20)
    assert depth >= 1 and 0 < share < (0.05 if kind == "clusters" else 0.5)


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (40, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    got = [tuple(r) for r in ann.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [(0, 1, 20), (0, 2, 1), (0, 3, 40), (20, 1, 0), (20, 2, 1), (20, 3, 40), (40, 1, 0), (40, 2, 20), (40, 3, 1)]
    assert ann.nearest(df.where("false"), F.col("id") % 20 == 0).count() == 0


def test_priority_order_is_the_queues():
    """The leaves' order equals that of a heap which all trees share."""
    import heapq

    rng = np.random.default_rng(0)
    f = ann.grow(rng.normal(size=(500, 8)), 10.0, 4, trees=3)
    q = rng.normal(size=(1, 8))
    sizes = np.ones((3, 16), np.int64)
    order = next(iter(f.opened(q, sizes, 1.0)))
    x = f.lifted(q, True)[0]
    heap, popped = [(-np.inf, t, 0) for t in range(3)], []
    while heap:
        p, t, node = heapq.heappop(heap)
        if node >= 15:
            popped.append((-p, t * 16 + node - 15))
            continue
        m = float(x @ f.directions[t][node] - f.cuts[t][node])
        heapq.heappush(heap, (-min(-p, -m), t, 2 * node + 1))
        heapq.heappush(heap, (-min(-p, m), t, 2 * node + 2))
    flat = f.priorities(q).ravel()
    assert np.allclose([p for p, _ in popped], flat[order])


def base_spans(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, t) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    plain = ["the", "connection", "internationalisation", "get_user_by_identifier_name", "configuration-value-of-the-table", "HttpRequestHandlerFactoryBean", "XMLQUERY2Adapter", "größe", "😀"]
    rows = []
    for i in range(300):
        t = " ".join(rng.choice(plain) for _ in range(40))
        if i % 3 == 0:
            t += f" password={''.join(rng.choice(letters) for _ in range(24))} and"
        if i % 5 == 0:
            t = f'"{rng.randbytes(20).hex()}" ' + t + " AKIA" + "".join(rng.choice("ABCDEFGHIJ234567") for _ in range(16))
        rows.append((i, t, "s"))
    rows += [(1000, "look: " + "".join(rng.choice(letters) for _ in range(40)) + " here", "s"), (1001, "Token : secret: abcdefgh12 api_key==abcdefg PASSWD\"= 'x.y-z/12345", "s"), (1002, "password: a.b", "s")]
    df = frame(spark, rows).repartition(3)
    model = secrets.train(df)
    got = {r.doc_id: r for r in secrets.scan(df, model).select("doc_id", secrets.digest(F.col("base")).alias("base"), secrets.digest(F.col("found")).alias("found")).collect()}
    for d, t, _ in rows:
        assert got[d].base == base_spans(t), t
    assert got[1000].found == "markov:6:46"
    assert all("markov" not in got[d].found for d in range(300))


def test_secrets_in_copies(spark):
    """A random string does not become an identifier by a thousand copies of its document."""
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    plain = ["the", "connection", "internationalisation", "get_user_by_identifier_name", "configuration-value-of-the-table"]
    rows = [(i, " ".join(rng.choice(plain) for _ in range(40)) + f" password={''.join(rng.choice(letters) for _ in range(24))} and", "s") for i in range(300)]
    text = "look: " + "".join(rng.choice(letters) for _ in range(40)) + " here"
    df = frame(spark, rows + [(1000 + i, text, "s") for i in range(1000)])
    got = secrets.scan(df, secrets.train(df)).select("doc_id", secrets.digest(F.col("found")).alias("found")).collect()
    assert all((r.found == "markov:6:46") == (r.doc_id >= 1000) for r in got)


def test_secrets_ordinary_tokens_of_all_documents(spark):
    """The threshold covers the long tokens of all documents, also when the models are fitted on few."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    token = "".join(rng.choice(letters) for _ in range(40))
    plain = ["the", "connection", "internationalisation", "get_user_by_identifier_name", "configuration-value-of-the-table"]
    rows = [(i, " ".join(rng.choice(plain) for _ in range(40)) + f" password={''.join(rng.choice(letters) for _ in range(24))} and" + f" {token}" * (i < 2), "s") for i in range(400)]
    model = secrets.train(frame(spark, rows), ordinary_docs=40)
    assert model.threshold >= frame(spark, rows[:1]).select(model.score(F.lit(token))).first()[0] - 1e-9 > secrets.FLOOR


def test_secrets_odd(odd, none):
    model = secrets.train(odd)
    got = secrets.scan(odd, model).collect()
    assert len(got) == 10 and all(r.base == [] and r.found == [] for r in got)
    assert secrets.scan(none, secrets.train(none)).count() == 0


def pseudonymised(df):
    return pii.pseudonymised(df, "a test's key")


def test_pii(spark):
    t = "mail Jo.99@mail8.example.com card 4041894974608795 bad 4041894974608796 ip 42.144.35.254. phone +1 (988) 555-2485 ssn 123-45-6789 on 2024-02-29 not 2023-02-29 nor 999.1.1.1"
    df = frame(spark, [(1, t, "s"), (2, "again 4041894974608795, 4041-8949-7460-8795", "s"), (3, "clean text 12 345", "s"), (4, None, "s"), (5, "", "s")])
    got = {r.doc_id: r for r in pseudonymised(df).collect()}
    a = got[1].text
    assert [got[1][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1, 1, 1]
    for secret in ("Jo.99@", "4041894974608795", "42.144.35.254", "988) 555-2485", "123-45-6789", "2024-02-29"):
        assert secret not in a
    for kept in ("@mail8.example.com", "4041894974608796", "2023-02-29", "999.1.1.1", "+1 ("):
        assert kept in a
    card = re.search(r"card (\d{16})", a)[1]
    assert re.search(r"again (\d{16})", got[2].text)[1] == card and got[2].text.replace("-", "").endswith(card)
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10
    assert luhn(card) == 0 and re.search(r"mail [A-Z][a-z]\.\d\d@", a)
    assert got[3].text == "clean text 12 345" and got[4].text is None and got[5].text == ""


def test_pii_beside_short_numbers(spark):
    """A rejected match does not hide the valid value within it or just behind it."""
    texts = ["call 555-123-4567 123 Main Street", "card 4041894974608795 123", "card 4111 1111 1111 1111 123", "10 20 30 40 50 60 70 4111 1111 1111 1111", "1112 4111 1111 1111 1111 x", "9 9 9 9 9 9 9 9 9 9 9 9 10.20.30.40 ok"]
    secret = ["555-123-4567", "4041894974608795", "4111 1111 1111 1111", "4111 1111 1111 1111", "4111 1111 1111 1111", "10.20.30.40"]
    got = {r.doc_id: r for r in pseudonymised(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, s in enumerate(secret):
        before, after = texts[i].split(s)
        assert s not in got[i].text and got[i].text.startswith(before) and got[i].text.endswith(after), got[i].text
    assert [sum(got[i][f"n_{k}"] for k in pii.KINDS) for i in got] == [1] * 6 and got[0].n_phone == got[1].n_card == got[2].n_card == got[5].n_ip == 1


def test_pii_permutes(spark):
    """Different values keep different pseudonyms over a whole small domain."""
    days = spark.range(0, 3000).select(F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pseudonymised(days).select("text").distinct().count() == 3000
    nums = spark.range(0, 1000).select(F.concat(F.lit("+1 (200) 555-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("text"))
    assert pseudonymised(nums).where("n_phone = 1").select("text").distinct().count() == 1000


def test_pii_odd(odd, none):
    got = pseudonymised(odd)
    assert got.count() == 10 and got.exceptAll(got.where("n_ip = 0 and n_card = 0")).count() == 0 and got.columns[:5] == odd.columns[:5]
    assert pseudonymised(none).count() == 0


def test_licences(spark):
    texts = {
        1: "Some words. Licensed under CC BY-NC 4.0.\nMore.",
        2: "This work is licensed under the GNU General Public License, version 3.",
        3: "Licensed under the Apache License, Version 2.0. Released under the MIT License.",
        4: "Permission is hereby granted, free of charge, to any person obtaining a copy of it.\nThe above copyright notice and this permission notice shall be included in all copies.\nThe software is provided \"as is\", without warranty of any kind.",
        5: "A licence to print money was not released under the MIT License we know.",
        6: "The software is provided as is, without warranty of any kind.",
        7: "nothing",
    }
    got = {r.doc_id: r for r in licences.scan(frame(spark, [(d, t, "s") for d, t in texts.items()])).collect()}
    assert [got[d].licences for d in sorted(texts)] == [["CC-BY-NC-4.0"], ["GPL-3.0"], ["Apache-2.0", "MIT"], ["MIT"], [], [], []]
    assert got[6].unmatched == ["MitAsIs"] and got[4].sentence_ids == ["MitPermission", "MitNotice", "MitAsIs"]


NOTICES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of Foo, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.',
}


def test_licences_as_published(spark):
    """Notices wrapped at 72 columns, plain and behind comment signs."""
    texts, want = [], []
    for name, notice in NOTICES.items():
        lines = "\n\n".join(textwrap.fill(p, 72) for p in notice.split("\n\n"))
        for sign in ("", "# ", " * ", "// "):
            texts.append("import x\n\n" + "\n".join(sign + l for l in lines.split("\n")) + "\n\nmore text")
            want.append([name])
    texts.append(NOTICES["GPL-3.0"].replace("software: you", "software; you"))
    got = {r.doc_id: r for r in licences.scan(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i].licences for i in range(len(texts))] == [*want, ["GPL-3.0"]]


def test_licences_odd(odd, none):
    assert licences.scan(odd).where("size(licences) = 0").count() == 10 and licences.scan(none).count() == 0


@pytest.mark.parametrize("sizes", [[10, 100, 100], [1, 1, 1000, 5, 0, 70, 300, 2], [7], [0, 0]])
def test_targets(spark, sizes):
    """Targets of whole sources against shares in fractions; sources in the order of code points, null last."""
    names = ["B", "a", "ä", "😀", "zz", "z", "Ab", None][: len(sizes)]
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, [ord(c) for c in names[i] or ""]))
    df = frame(spark, [(i, "w " * n, s) for i, (n, s) in enumerate(zip(sizes, names, strict=True))])
    got = {r.doc_id: r.target for r in mixing.mix_report(df).collect()}
    want = brute.targets([sizes[i] for i in order], [k % 3 + 1 for k in range(len(order))])
    assert all(abs(got[i] - w) < 1e-9 * max(1, w) for i, w in zip(order, want, strict=True))


def test_hypergeometric_of_large_counts():
    """Mean and variance beyond numpy's limit, and small draws out of many."""
    rng = np.random.default_rng(1)
    good, bad, n = 3_000_000_000, 2_000_000_000, 1_000_000_000
    x = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(60)])
    p = good / (good + bad)
    sd = (n * p * (1 - p) * (good + bad - n) / (good + bad - 1)) ** 0.5
    assert abs(x.mean() - n * p) < 5 * sd / 60**0.5 and 0.6 < x.std() / sd < 1.4
    few = np.bincount([mixing.hypergeometric(rng, 10**9, 10**9, 3) for _ in range(4000)], minlength=4) / 4000
    assert np.abs(few - [1 / 8, 3 / 8, 3 / 8, 1 / 8]).max() < 0.04
    assert mixing.hypergeometric(rng, 2 * 10**9, 5, 2 * 10**9 + 5) == 2 * 10**9 and mixing.hypergeometric(rng, 0, 2 * 10**9, 7) == 0


def test_split_tree_of_five_thousand_million_blocks():
    quota = np.array([3_000_000_000, 0, 1_999_999_000, 1000])
    shards = 5_000_000_000 // 256
    got = list(mixing.split_trees(shards // 2, shards // 2 + 3, shards, quota))
    assert [g[0] for g in got] == [shards // 2 + i for i in range(3)] and all(255 <= g[3].sum() <= 257 for g in got)
    end = {s: b + o for s, b, o in zip(*got[0][1:], strict=True)}
    assert all(end.get(s, b) == b for s, b in zip(got[1][1], got[1][2], strict=True))
    assert abs(got[0][2][0] - 1.5e9) < 200_000


def test_split_tree():
    quota = np.array([1000, 10, 0, 333])
    parts = [mixing.split_tree(s, 7, quota) for s in range(7)]
    assert (sum(p[1] for p in parts) == quota).all()
    at = np.zeros(4, int)
    for before, own in parts:
        assert (before == at).all() and 191 <= own.sum() <= 192
        at = at + own


def test_mixing(docs, rows, spark):
    got = mixing.mix_report(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    size, target, taken, places = collections.Counter(), {}, collections.Counter(), []
    for r in got:
        assert r.size == len(brute.words(dict(rows)[r.doc_id])) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        assert len(r.places or []) == r.copies
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        places += [tuple(p) for p in r.places or []]
    names = sorted(size)
    want = brute.targets([size[s] for s in names], [i % 3 + 1 for i in range(len(names))])
    assert all(abs(target[s] - w) < 1e-6 for s, w in zip(names, want, strict=True)) and len(places) == len(set(places))
    off = sum(abs(taken[s] - target[s]) for s in names) / sum(size.values())
    assert off < 0.1
    again = {r.doc_id: r.copies for r in mixing.mix_report(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.copies for r in got}


@pytest.mark.parametrize("seed", [20, 21, 22, 23])
def test_mixing_past_a_long_document(spark, seed):
    """Half of the words of a source in one document: the target, 40,000 of 100,000, is met without it."""
    made = [(i, "w " * 5000, "a") for i in range(10)] + [(10, "w " * 50_000, "a"), (11, "w " * 80_000, "b"), (12, "w " * 20_000, "b")]
    got = mixing.mix_report(frame(spark, made), weights=(2, 8), seed=seed).collect()
    assert sum(r.taken for r in got if r.doc_id <= 10) == 40_000


@pytest.mark.parametrize("per_shard", [7, 256])
def test_mixing_shards(docs, per_shard):
    """Each shard holds its quota, no place is given twice, and every copy has one."""
    rows = mixing.mixed(docs).cache()
    got = mixing.dealt(rows, per_shard).select("doc_id", "copy", "source_no", "shard", "place").collect()
    total = rows.agg(F.sum("copies")).first()[0]
    shards = -(-total // per_shard)
    quota = {r.source_no: r.n for r in rows.groupBy("source_no").agg(F.sum("copies").alias("n")).collect()}
    have = np.array([quota.get(i, 0) for i in range(max(quota) + 1)])
    assert len(got) == total == len({(r.doc_id, r.copy) for r in got})
    for s in range(shards):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.place for r in mine) == list(range(len(mine)))
        assert (np.bincount([r.source_no for r in mine], minlength=len(have)) == mixing.split_tree(s, shards, have)[1]).all()


def test_mixing_odd(odd, none):
    got = {(r.doc_id, r.size): r for r in mixing.mix_report(odd).collect()}
    assert mixing.mix_report(odd).count() == 10 and mixing.mix_report(none).count() == 0
    # sources s (17 words), t (60000) and null (60004) have 1, 2 and 3 sixths of 120021 words, s no more than 51
    left = 120021 - 51
    assert got[1, 6].source_size == 17 and abs(got[1, 6].target - 51) < 1e-9
    assert abs(got[5, 60000].target - left * 2 / 5) < 1e-6 and abs(got[6, 60001].target - left * 3 / 5) < 1e-6
    assert all(r.taken == r.copies * r.size and r.copies <= 3 for r in got.values())
    same = mixing.mixed_documents(odd)
    assert same.columns == odd.columns and mixing.mixed_documents(none).count() == 0
    assert same.count() == sum(r.copies for r in mixing.mix_report(odd).collect())


@pytest.fixture(scope="module")
def tokenizer():
    from tidemark.llm import queries

    return queries.tokenizer_path()


def test_packing(docs, rows, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    got = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in packing.packed_documents(docs, tokenizer, 512).collect():
        got[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    total = 0
    for d, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for i, r in enumerate(sorted(got[d], key=lambda r: r.piece)):
            part = ids[at : at + r.length]
            assert (r.piece, r.start, r.ids_crc32) == (i, at, zlib.crc32(part.tobytes()))
            assert r.length == 512 or i == len(got[d]) - 1
            at += r.length
        assert at == len(ids)
        total += at
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 512
    assert len(bins) <= -(-total // 512) + 2


def test_packing_constraints():
    n = np.sort(np.random.default_rng(2).integers(1, 100, 500))[::-1]
    for rule in ("dot", "norm"):
        bins, offset, count = packing.best_fit(n, (100, 5, 4000.0 + 100**2), rule)
        for b in range(count):
            assert n[bins == b].sum() <= 100 and (bins == b).sum() <= 5 and (n[bins == b].astype(float) ** 2).sum() <= 14000


def test_packing_under_limits(docs, tokenizer):
    """Each limit is kept, and each binds somewhere."""
    bins = collections.defaultdict(list)
    got = packing.packed_documents(docs, tokenizer, 1024, max_docs=6, max_cost=1024.0**2 / 2, rule="norm").collect()
    for r in got:
        bins[r.sequence_id].append(r.length)
    assert all(len(x) <= 6 and sum(x) <= 1024 and sum(n * n for n in x) <= 1024**2 / 2 for x in bins.values())
    assert any(len(x) == 6 for x in bins.values()) and any(sum(x) > 1000 for x in bins.values()) and any(sum(n * n for n in x) > 1024**2 / 2 - 5000 for x in bins.values())
    plain = packing.packed_documents(docs, tokenizer, 1024)
    assert sum(r.length for r in got) == plain.agg(F.sum("length")).first()[0] and len(bins) > plain.select("sequence_id").distinct().count()


def test_packing_parts_repeated_rows(spark, tokenizer):
    """Copies of one row, without an id, go to many groups; a long text's full pieces have sequences of their own."""
    df = spark.createDataFrame([(None, "same words again", "clash")] * 4000 + [(1, "word " * 3000, "clash")], "doc_id long, text string, offset string")
    pieces = packing.tokenised(df, tokenizer, 64)
    got = packing.pack(pieces, 8, 64).collect()
    groups = collections.Counter(r.sequence_id >> 32 for r in got if r.doc_id is None)
    assert len(groups) == 8 and max(groups.values()) < 1000 and sum(groups.values()) == 4000
    full = [r.sequence_id for r in got if r.length == 64]
    assert len(full) == 3001 // 64 and len(set(full)) == len(full) and all(r.offset == 0 for r in got if r.length == 64)


def test_packing_memory(tokenizer):
    """A worker needs little memory beside its text, whether that is in short texts or in one long one."""
    import tracemalloc

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 12))) for _ in range(5000)]
    ids_of = packing.word_ids(tokenizer)
    for texts in ([" ".join(rng.choices(words, k=300)) + "." for _ in range(4000)], [" ".join(rng.choices(words, k=500_000))]):
        column = pa.array(texts)
        tracemalloc.start()
        sizes = [len(packing.token_ids(ids_of, data, offsets)[0]) for _, _, data, offsets in _words.slices(column, packing.SLICE_BYTES)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(sizes) > 500_000 and peak < 160e6, peak


def test_packing_blocks(tokenizer, monkeypatch):
    """Words on both sides of a block's border, and longer than a block, have the ids of the tokenizer."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    texts = ["", "One, two. Été ÉTÉ; çA x", " \t", "long" * 300 + ", end.", "日本語 mixed x2 ... , .", "one two One, two."]
    data, offsets = (lambda raw: (np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))([x.encode() for x in texts])
    want = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    for size in (1, 7, 40, 1 << 17):
        monkeypatch.setattr(packing, "BLOCK_BYTES", size)
        ids, begin = packing.token_ids(packing.WordIds(tokenizer), data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == want


def test_packing_odd(odd, none, tokenizer):
    got = packing.packed_documents(odd, tokenizer).collect()
    assert sum(r.length == 1 for r in got if r.doc_id in (2, 3, 4)) == 3
    assert collections.Counter(r.doc_id for r in got)[1] == 3 and packing.packed_documents(none, tokenizer).count() == 0


def test_toxicity(spark):
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        said = [" ".join(rng.choice(plain) for _ in range(8)) + "." for _ in range(6)]
        bad = i % 6 == 0
        if bad:
            said[rng.randrange(6)] = "You are a " + rng.choice(["nastyword", "vileword", "foulword"]) + " " + rng.choice(plain) + "."
        rows.append((i, " ".join(said), "s"))
        labels.append((i, 1, int(bad)))
    df = frame(spark, rows).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab)
    got = {r.doc_id: r for r in toxicity.score(df.withColumn("held", toxicity.held_out(F.col("doc_id"))), model, keep=("doc_id", "held")).collect()}
    held = [d for d, _, _ in rows if got[d].held]
    assert all(got[d].held == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got) and len(held) > 100
    assert np.mean([got[d].predicted == (d % 6 == 0) for d in held]) > 0.97
    hit = [d for d in held if d % 6 == 0 and got[d].offending]
    assert np.mean(["word" in rows[d][1][s.start : s.end] for d in hit for s in got[d].offending]) > 0.9


def test_toxicity_odd(odd, none, spark):
    lab = spark.createDataFrame([(1, 1, 1), (5, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(odd, toxicity.train(odd, lab)).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in got if r.doc_id in (2, 3, 4))
    model = toxicity.train(none, lab)
    assert toxicity.score(none, model).count() == 0 and toxicity.score(odd, model).where("score > 0").count() == 0
