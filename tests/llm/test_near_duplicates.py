"""SimHash near-duplicates and fingerprints against brute force."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helpers import documents, find, plain_fingerprint, prose, texts
from saccadia.llm import doc_fingerprint, near_dup
from saccadia.llm.components import components
from saccadia.llm.queries import SPARK


def test_fingerprints_and_components(spark):
    got = near_dup.near_duplicate_components(documents(spark)).toPandas()
    fps = [plain_fingerprint(t) for _, t in texts()]
    assert sorted(got.fp) == sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    parent = {k: k for k in range(len(fps))}
    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            parent[find(parent, b)] = find(parent, a)
    smallest = {}
    for k, (i, _) in enumerate(texts()):
        if i is not None:
            smallest[find(parent, k)] = min(i, smallest.get(find(parent, k), i))
    want = Counter((i, smallest.get(find(parent, k))) for k, (i, _) in enumerate(texts()))
    none = lambda x: None if x is None or x != x else int(x)
    assert Counter((none(r.doc_id), none(r.component_id)) for r in got.itertuples()) == want


def test_spark_hash_is_the_shingle_hash(spark):
    row = spark.sql("select xxhash64('one two three four') as h").first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"one two three four", 42)


@pytest.mark.parametrize("radius,bucket", [(4, 4096), (4, 40), (18, 4096)])
def test_bit_sliced_links_equal_all_pairs(spark, monkeypatch, radius, bucket):
    monkeypatch.setattr(near_dup, "BUCKET", bucket)
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = set(rng.integers(0, 1 << 63, 300, dtype=np.uint64).tolist())
    for c in centres.tolist():
        for _ in range(80):
            values.add(c ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 7)), replace=False)))
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    links = near_dup.link_forest(df, 4) if radius == 4 else near_dup.bucket_links(df.select(F.lit(0).alias("t"), F.lit(1).cast("long").alias("key"), "fp"), radius)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    parent = {v: v for v in values}
    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= radius:
            parent[max(find(parent, a), find(parent, b))] = min(find(parent, a), find(parent, b))
    assert all(got.get(v, v) == find(parent, v) for v in values)
    assert links.count() < 30 * len(values)


def test_lanes_within_counts_exactly():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, (2, 1000), dtype=np.uint64)
    b[::3] = a[::3] ^ np.uint64(0b1011)
    for radius in (0 + 1, 3, 4, 7, 20):
        planes = near_dup.planes_of(a ^ b)
        words, lanes = near_dup.lanes_within(lambda k, w: planes[k][w], planes.shape[1], radius)
        found = np.zeros(planes.shape[1] * 64, bool)
        for w, x in zip(words, lanes):
            found[w * 64:w * 64 + 64] = [int(x) >> k & 1 for k in range(64)]
        assert (found[:1000] == (np.bitwise_count(a ^ b) <= radius)).all()


def test_keep_first_against_all_pairs(spark):
    docs = documents(spark)
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns
    rows = texts()
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))
    for a, b in itertools.combinations(parent[:], 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            parent[find(parent, b)] = find(parent, a)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(parent, k)] = min(i, smallest.get(find(parent, k), i))
    want = Counter((i, t) for k, (i, t) in enumerate(rows) if smallest.get(find(parent, k), i) == i)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want
    assert want[10, rows[0][1]] == 2 and not {11, 15, 16} & {i for i, _ in want}
    assert near_dup.keep_first(docs.limit(0)).count() == 0


def test_keep_first_judges_texts_of_one_doc_id_apart(spark):
    a, b = prose(41, 80), prose(42, 80)
    rows = [(1, a), (5, a), (5, b), (6, b), (None, b), (None, prose(43, 80))]
    kept = near_dup.keep_first(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(1, a), (5, b), rows[-1]])


def test_doc_fingerprints_against_brute_force(spark):
    rows = sorted({i: t for i, t in texts() if i is not None}.items())
    got = {r["doc_id"]: r for r in doc_fingerprint.fingerprints(documents(spark, rows)).collect()}
    fps = {i: int(got[i]["fingerprint"], 16) for i, _ in rows}
    for k, (i, t) in enumerate(rows):
        t, (j, following) = t or "", rows[(k + 1) % len(rows)]
        half = len(t) // 2
        new = t[:len(t) - half] + (following or "")[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r["near_next"] == 1 - (fps[i] ^ fps[j]).bit_count() / 64
        assert r["near_edited"] == 1 - (fps[i] ^ int(r["edited_fingerprint"], 16)).bit_count() / 64
        assert r["n_near"] == sum(1 for x in fps if x != i and (fps[x] ^ fps[i]).bit_count() <= 3)
        assert r["class_id"] == min(x for x in fps if fps[x] == fps[i])
    assert got[10]["fingerprint"] == got[11]["fingerprint"]


@pytest.mark.parametrize("bucket", [4096, 30])
def test_permuted_tables_count_all_neighbours(spark, monkeypatch, bucket):
    monkeypatch.setattr(doc_fingerprint, "BUCKET", bucket)
    rng = np.random.default_rng(5)
    values = set()
    for c in rng.integers(0, 1 << 62, 5, dtype=np.int64).tolist():
        values |= {c ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, 4)), replace=False)) for _ in range(70)}
    values = sorted(values)
    n = {v: 1 + v % 3 for v in values}
    got = {r["fp"]: r["near"] for r in doc_fingerprint.neighbour_counts(spark.createDataFrame(list(n.items()), "fp long, n long")).collect()}
    assert got == {v: s for v in values if (s := sum(n[w] for w in values if w != v and (v ^ w).bit_count() <= 3))}


def test_awkward_tables(spark):
    assert doc_fingerprint.fingerprints(documents(spark)).count() == len(texts())
    assert doc_fingerprint.fingerprints(documents(spark, [(1, "only one")])).first()["near_next"] == 1
    for f in (doc_fingerprint.fingerprints, near_dup.near_duplicate_components):
        assert f(documents(spark).limit(0)).count() == 0


def test_registered(spark, sf):
    assert SPARK["op1_simhash_near_dedup"](spark, sf).columns[:3] == ["doc_id", "fingerprint", "component_id"]
