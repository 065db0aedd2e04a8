"""SimHash groups and embedding links against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import types as T

from pagewright.llm import common, components, simhash, vectors
from tests.llm.conftest import sentence


def brute_fingerprint(text):
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if hashes and sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(fps):
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def test_fingerprints(odd_texts):
    for t in [t for t in odd_texts if len(t or "") < 60000] + ["a b", "a b c", "A B C", "É e", "a a a a a"]:
        assert simhash.fingerprint_text((t or "").encode()) == brute_fingerprint(t)


@pytest.mark.parametrize("dense", [False, True])
@pytest.mark.parametrize("sample", [1 << 20, 128])
def test_forest_finds_every_link(spark, monkeypatch, dense, sample):
    """Many shards and small leaves, with deep levels below a small sample; the dense case is a crowd that no vantage point parts."""
    monkeypatch.setattr(simhash, "MOST_SAMPLE", sample)
    monkeypatch.setattr(simhash, "LEAST_SAMPLE", min(sample, 1 << 16))
    monkeypatch.setattr(simhash, "SHARD_ROWS", 32)
    monkeypatch.setattr(simhash, "LEAF", 16)
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(1 if dense else 60)]
    fps = {0}
    while len(fps) < 400:
        x = rng.choice(centre)
        for _ in range(rng.randint(0, 3 if dense else 6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["fp"]: r["root"] for r in simhash.groups_of(spark, df).collect()}
    want = brute_groups(fps)
    got = [roots[x] for x in signed]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_groups_hold_if_a_shard_reports_another_forest_each_time(spark, monkeypatch):
    """On a cluster rows reach a shard in any order, and the spanning forest of its links follows that order."""

    def links(spark, distinct):
        def find(batches):
            full = np.concatenate([b.column("fp").to_numpy() for b in batches]).view(np.uint64)
            np.random.default_rng().shuffle(full)
            pairs = np.array(simhash.near_links(full, 0)).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(full[pairs[:, k]].view(np.int64)) for k in (0, 1)], ["a", "b"])

        return distinct.select("fp").coalesce(1).mapInArrow(find, "a long, b long")

    monkeypatch.setattr(simhash, "links", links)
    rng = random.Random(8)
    fps = set()
    for centre in [rng.getrandbits(62) for _ in range(20)]:
        fps |= {centre ^ 1 << rng.randrange(62) ^ 1 << rng.randrange(62) for _ in range(18)}
    fps = sorted(fps)
    roots = {r["fp"]: r["root"] for r in simhash.groups_of(spark, spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    want, got = brute_groups(fps), [roots[x] for x in fps]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_shards_stay_small_and_keep_close_halves_together():
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 1 << 63, 20000, np.uint64)
    flipped = fps ^ (np.uint64(1) << rng.integers(0, 32, len(fps)).astype(np.uint64))
    for deep, most in ((0, 12000), (6, 2500)):
        tree = simhash.Tree(fps[:256], 0, 2, deep)
        row, shard = tree.route(simhash._half(fps, 0))
        assert np.unique(shard, return_counts=True)[1].max() <= most
        row2, shard2 = tree.route(simhash._half(flipped, 0))
        both = set(zip(row.tolist(), shard.tolist())) & set(zip(row2.tolist(), shard2.tolist()))
        assert {r for r, _ in both} == set(range(len(fps)))


def test_op8_fingerprints_as_hex(spark, documents, odd_texts, tmp_path):
    documents(odd_texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.op8_simhash_near_dedup(spark, str(tmp_path)).collect()}
    fps = [brute_fingerprint(t) if len(t or "") < 60000 else simhash.fingerprint_text(t.encode()) for t in odd_texts]
    assert [got[i]["fingerprint"] for i in range(len(odd_texts))] == [f"{x:016x}" for x in fps]
    assert [got[i]["component_id"] for i in range(len(odd_texts))] == brute_groups(fps)


def test_routing_sample_is_that_of_a_full_sort(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    ranked = [r["k"] for r in df.selectExpr("k", "xxhash64(k) AS h").orderBy("h").collect()]
    for most in (1, 40, 1000, 6000):
        assert [r["k"] for r in common.first_by_hash(df, "k", 5000, most).collect()] == ranked[:most]
    assert common.first_by_hash(df.filter("k < 0"), "k", 0, 10).count() == 0


def test_near_groups(spark, documents, odd_texts):
    texts = odd_texts + [sentence(1).upper(), sentence(3)]
    got = {r["doc_id"]: r for r in simhash.near_groups(spark, documents(texts)).collect()}
    fps = [simhash.fingerprint_text((t or "").encode()) for t in texts]
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_groups(fps)
    assert simhash.near_groups(spark, documents([])).count() == 0


def test_keep_first(spark, documents, odd_texts):
    docs = documents(odd_texts)
    kept = simhash.keep_first(spark, docs)
    assert kept.schema == docs.schema
    fps = [simhash.fingerprint_text((t or "").encode()) for t in odd_texts]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_groups(fps)))
    twice = documents([sentence(1), sentence(1), sentence(2), sentence(2)], [4, 4, None, 9])
    assert sorted(r["doc_id"] for r in simhash.keep_first(spark, twice).collect()) == [4, 9]
    assert simhash.keep_first(spark, documents([sentence(5)] * 2, [None, None])).count() == 1
    assert simhash.keep_first(spark, documents([])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(spark, edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components.components(spark, edges.limit(0)).count() == 0


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("n_links", T.StringType()), T.StructField("class", T.StringType())])


@pytest.mark.parametrize(("routed", "sample", "big"), [(64, 32768, 1 << 14), (16, 256, 1 << 14), (64, 32768, 40)])
def test_vectors(spark, monkeypatch, routed, sample, big):
    """Shards, leaves and copies; deep levels below the sampled tops; large leaves in blocks. Recall against brute force."""
    monkeypatch.setattr(vectors, "ROUTED_ROWS", routed)
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(vectors, "BIG_LEAF", big)
    monkeypatch.setattr(vectors, "LEAF", 24)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 16))
    near = base[rng.integers(0, 60, 300)] + rng.standard_normal((300, 16)) * 0.12
    x = np.concatenate([base, near, base[:20], 2 * base[20:30], near[:5]]).astype(np.float32)
    rows = [(i, v.tolist(), "n", "c") for i, v in enumerate(x)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(1000 + i, v, "n", "c") for i, v in enumerate(bad)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark, spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(got) == len(rows)
    for i in range(len(bad)):
        assert (got[1000 + i]["n_links"], got[1000 + i]["component_id"], got[1000 + i]["kept"]) == (0, 1000 + i, True)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= linked.sum(axis=1)).all() and found.sum() >= 0.95 * linked.sum() > 500
    for i in range(len(x)):
        assert got[i]["kept"] == (got[i]["component_id"] == i) and got[i]["component_id"] <= i
    for i in range(600, 620):  # exact copies
        assert got[i]["component_id"] == got[i - 600]["component_id"] and got[i]["n_links"] == got[i - 600]["n_links"]
    assert vectors.near_vectors(spark, spark.createDataFrame([], VECTORS)).count() == 0


def test_vectors_count_every_link_they_find(spark):
    """Isolated pairs: a pair that shares a component has a link each, in whichever tree it was found."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.standard_normal((1000, 64))
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = rng.uniform(0.952, 0.99, 1000)[:, None]
    rows = [(i, v.tolist(), "n", "c") for i, v in enumerate(np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side]).astype(np.float32))]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark, spark.createDataFrame(rows, VECTORS)).collect()}
    found = sum(got[i + 1000]["component_id"] == i for i in range(1000))
    counted = sum(got[i]["n_links"] for i in range(2000)) / 2
    print("pairs found", found, "counted", counted)
    assert counted == found >= 990


def test_vectors_of_mixed_lengths(spark, monkeypatch):
    """Each vector is compared with all others of its length, whichever comes first in a batch."""
    monkeypatch.setattr(vectors, "ROUTED_ROWS", 64)
    rng = np.random.default_rng(2)
    many = rng.standard_normal((150, 16))
    few = rng.standard_normal((20, 5))
    values = [[1.0] * 7, *(v for a in (many, few) for x in a for v in (x.tolist(), (x * 1.5 + 0.01).tolist())), [2.0] * 6 + [2.5]]
    df = spark.createDataFrame([(i, v, "n", "c") for i, v in enumerate(values)], VECTORS).coalesce(1)
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark, df).collect()}
    assert [got[i]["n_links"] for i in range(len(values))] == [1] * len(values)
    last = len(values) - 1
    assert got[last]["component_id"] == 0 and all(got[i]["component_id"] == (i - 1) // 2 * 2 + 1 for i in range(1, last))


def test_routed_leaves_stay_small():
    """With a sample for two levels only, ten more levels go on halving the leaves; each vector has a leaf."""
    x = np.random.default_rng(3).standard_normal((20000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for deep, most in ((0, 8000), (5, 700)):
        tree = vectors.Tree(x[:128], 2, deep, 1)
        row, leaf = tree.route(x)
        assert set(row.tolist()) == set(range(len(x))) and len(np.unique(np.stack([row, leaf]), axis=1).T) == len(row)
        assert np.unique(leaf, return_counts=True)[1].max() <= most
    crowd = x[:1] + np.random.default_rng(4).standard_normal((3000, 64)) * 1e-4
    row, _ = vectors.Tree(crowd[:100], 2, 12, 1).route(crowd)
    assert len(row) == len(crowd)  # a crowd that nothing parts is not copied at every level


def test_recall_at_production_settings(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((1500, 64))
    x = np.concatenate([base, *(base[rng.integers(0, 700, 1500)] + rng.standard_normal((1500, 64)) * s for s in (0.15, 0.22, 0.3))]).astype(np.float32)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(spark, spark.createDataFrame([(i, v.tolist(), "n", "c") for i, v in enumerate(x)], VECTORS)).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    links = (u @ u.T >= 0.95).sum() - len(u)
    print("recall of links", sum(got.values()) / links, "of", links)
    assert 0.97 * links <= sum(got.values()) <= links
