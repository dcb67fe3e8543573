"""Hard negatives, spelling variants and top-k search against brute force and SQL."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import documents, prose, texts
from saccadia.llm import hard_negatives, spelling, topk_search, vectors
from saccadia.llm.queries import SPARK, SQL

SCHEMA = "vec_id long, embedding array<float>, label int, id long, norm double, v string, block int, side int, score long"


def awkward_vectors(spark, n: int = 700, seed: int = 1):
    """Clusters, a third of all rows one vector, other lengths, zeros, ties, NULLs, NaN, infinity, repeated ids."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(n):
        x = centres[i % 6] * rng.choice([0.2, 1.0, 3.0]) + rng.normal(size=12) * 0.3
        if i % 3 == 0:
            x = centres[0]
        if i % 97 == 0:
            x = np.zeros(12)
        x = x[:8] if i % 89 == 0 else x
        rows.append((i - 20, [float(v) for v in x], int(i % 10) if i % 41 else None))
    rows += [(50, None, 1), (None, [1.0] * 12, 2), (1000, [1.0, None, 2.0], 3), (1001, [1.0, math.nan], 3), (1050, [math.inf, 1.0], 3), (1100, [], 4),
             (1150, [9.0] * 12, None), (1200, [1e30] * 12, 5), (100, [0.5] * 12, 9), (100, [0.5] * 12, 9), (200, [-0.25] * 12, 0)]
    return spark.createDataFrame([(*r, 1, 0.5, "v", 2, 3, 4) for r in rows], SCHEMA).repartition(5)


def plain_vectors(df, label) -> dict[int, tuple]:
    found = {}
    for r in df.collect():
        x, lab = r["embedding"], label(r)
        if r["vec_id"] is None or x is None or lab is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [math.floor(256 * c) for c in x]
        if sum(c * c for c in v) < 2 ** 62:
            found[r["vec_id"]] = min(found.get(r["vec_id"], (lab, v)), (lab, v))
    return found


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def best(query, rows, k, keep=lambda i: True):
    """(score, id) of the k best rows: higher scores first, then smaller ids."""
    return [(-s, i) for s, i in sorted((-dot(rows[query][1], v), i) for i, (_, v) in rows.items() if i != query and keep(i))[:k]]


@pytest.mark.parametrize("held,first,most,coordinates", [(2048, 64, 2048, 0.85), (4, 2, 9, 0.3), (2048, 5, 50, 2.0)])
def test_top_k_against_brute_force(spark, monkeypatch, held, first, most, coordinates):
    monkeypatch.setattr(vectors, "QUERIES", held)
    monkeypatch.setattr(vectors, "FIRST_ROWS", first)
    monkeypatch.setattr(vectors, "ROWS", most)
    monkeypatch.setattr(topk_search, "COORDINATES_FROM", coordinates)
    df = awkward_vectors(spark)
    rows = plain_vectors(df, lambda r: 0)
    got = {(r["query_id"], r["rank"]): (r["score"], r["vec_id"]) for r in topk_search.nearest(df, 5, 10).collect()}
    assert got == {(q, k + 1): hit for q in rows if q % 10 == 0 for k, hit in enumerate(best(q, rows, 5))}


def test_every_way_of_pruning_is_used_and_right():
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (8, 16))
    rows = np.concatenate([centres[rng.integers(0, 8, 600)] + rng.integers(-3, 4, (600, 16)), rng.integers(-20, 21, (600, 16)),
                           np.eye(16, dtype=np.int64)[rng.integers(0, 16, 80)] * 900])
    norms = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    import pyarrow as pa
    table = pa.table({"id": np.arange(0, len(rows), 20), "v": pa.array(rows[::20].tolist(), pa.list_(pa.int64())), "norm": norms[::20]})
    block = topk_search.TopK(table, 5)
    for at in range(0, len(order), 100):
        some = order[at:at + 100]
        block.see(some, rows[some], norms[some], None)
    assert min(block.looked_at.values()) > 0, block.looked_at
    got = block.result().to_pandas().groupby("query_id")[["vec_id", "score"]].apply(lambda g: list(zip(g.score, g.vec_id)))
    scores = rows[::20] @ rows.T
    for q in range(0, len(rows), 20):
        want = sorted((-s, i) for i, s in enumerate(scores[q // 20].tolist()) if i != q)[:5]
        assert got[q] == [(-s, i) for s, i in want]


def test_products_are_exact_at_every_size():
    rng = np.random.default_rng(0)
    for size in (100, 1 << 12, 1 << 26):
        a, b = rng.integers(-size, size, (20, 12)), rng.integers(-size, size, (30, 9))
        bound = float(np.sqrt((a.astype(float) ** 2).sum(axis=1)).max() * np.sqrt((b.astype(float) ** 2).sum(axis=1)).max())
        want = [[dot(x, y) for y in b.tolist()] for x in a.tolist()]
        assert vectors.products(a, b, bound).astype(np.int64).tolist() == want


def moved(r):
    return None if r["label"] is None or r["vec_id"] is None else (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]


@pytest.mark.parametrize("held,first,most", [(2048, 64, 2048), (4, 2, 9)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, held, first, most):
    monkeypatch.setattr(vectors, "QUERIES", held)
    monkeypatch.setattr(vectors, "FIRST_ROWS", first)
    monkeypatch.setattr(vectors, "ROWS", most)
    df = awkward_vectors(spark)
    rows = plain_vectors(df, moved)
    want = {}
    for a in rows:
        if a % 10 == 0:
            others = best(a, rows, 10 ** 6, lambda i: rows[i][0] != rows[a][0])
            for p, i in best(a, rows, 5, lambda i: rows[i][0] == rows[a][0]):
                for k, (s, j) in enumerate([x for x in others if 50 * p <= 100 * x[0] <= 95 * p][:3]):
                    want[a, i, k + 1] = (j, p, s)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = {(r["anchor_id"], r["positive_id"], r["rank"]): (r["negative_id"], r["positive_score"], r["negative_score"])
           for r in hard_negatives.mine(df, label, every=10).collect()}
    assert got == want and len(want) > 300


def spelled():
    """Documents with words of every kind of edit around a frequent one, at both ends and in the middle."""
    rng = np.random.default_rng(4)
    base = ["example", "spelling", "straßenbahn", "niñosgrandes", "vocabulary", "aaaaaaa", "aaaaaaaa", "a" * 3000, "abababab"]
    words = []
    for k, w in enumerate(base):
        words += [w] * (400 if k % 2 else 1200)
        for _ in range(40):
            p, c = int(rng.integers(0, len(w) + 1)), str(rng.choice(list("abexyzéß÷×")))
            words += [w[:p] + c + w[p:], w[:p] + c + w[p + 1:], w[:p] + w[p + 1:]] * int(rng.integers(1, 12))
    # a chain: each form more than ten times as frequent
    for w, n in (("chained", 9000), ("chainedx", 600), ("chainedxy", 40), ("chainedxyz", 3)):
        words += [w] * n
    rng.shuffle(words)
    cut = [" ".join(words[a:a + 120]) for a in range(0, len(words), 120)]
    return [(i - 3, t.upper() if i % 9 == 0 else t) for i, t in enumerate(cut)] + texts() + [(None, "nothing nothing example")]


def plain_words(rows) -> Counter:
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda c: c[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= 7
    return Counter({w: c for w, c in n.items() if c >= 2})


def plain_near(n) -> dict[str, list[str]]:
    """Words one edit apart: those that become equal when a code point of either, or the same place of both, is taken out."""
    holes, near = {}, {w: set() for w in n}
    for w in n:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1:]), set()).add(w)
    for same in holes.values():
        for a in same:
            near[a] |= same - {a}
    for w in n:
        for k in range(len(w)):
            short = w[:k] + w[k + 1:]
            if short in n:
                near[w].add(short)
                near[short].add(w)
    return near


def plain_variants(rows) -> dict[str, tuple]:
    n = plain_words(rows)
    forms, near = {}, plain_near(n)
    for w in n:
        b = min(near[w], key=lambda x: (-n[x], x), default=None)
        forms[w] = b if b is not None and n[b] >= 10 * n[w] else None

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return {w: (forms[w], root(w), n[w], len(near[w]), n[forms[w]] if forms[w] else None) for w in n}


@pytest.mark.parametrize("tile,small,cells", [(1024, 16, 1 << 22), (20, 16, 1 << 22), (20, 3, 2000)])
def test_spelling_against_brute_force(spark, monkeypatch, tile, small, cells):
    for name, value in (("TILE", tile), ("SMALL", small), ("CELLS", cells)):
        monkeypatch.setattr(spelling, name, value)
    rows = spelled()
    found = spelling.variants(documents(spark, rows)).collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found}
    want = plain_variants(rows)
    assert got == want and len(found) == len(got)
    assert sum(v[0] is not None for v in want.values()) > 50 and max(v[3] for v in want.values()) > 20
    assert want["chainedxyz"][1] == "chained"


def test_one_edit_counts_each_pair_in_one_part():
    words = ["abcdefg", "abcdefgh", "xbcdefg", "abcxefg", "abcdefx", "aabcdefg", "abcdeffg", "abdcefg", "bcdefgh"]
    for a in words:
        for b in words:
            m = min(len(a), len(b))
            if a != b and max(len(a), len(b)) <= m + 1:
                (la, ra, sa), (lb, rb, sb) = (spelling.code_points([w], m + 1) for w in (a, b))
                parts = sum(bool(spelling.one_edit(la, ra, sa, lb, rb, sb, m, p)[0]) for p in range(spelling.PARTS))
                assert parts == (b in plain_near({a: 2, b: 2})[a])


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_spelling_variants", "op13_exact_topk"])
def test_registered_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("embeddings", "documents"):
        con.execute(f"create view {table} as from '{sf}/{table}.parquet'")
    got = SPARK[name](spark, sf)
    want = con.execute(SQL[name]).df()[got.columns]
    rows = lambda table: sorted(map(tuple, table.astype(object).where(table.notna(), None).values.tolist()), key=repr)
    assert rows(got.toPandas()) == rows(want) and len(want) > 20


def test_empty_tables_and_rows_that_take_no_part(spark):
    df = awkward_vectors(spark).limit(0)
    assert topk_search.nearest(df).count() == 0 and hard_negatives.mine(df, F.col("label")).count() == 0
    none = spark.createDataFrame([(50, None, None)], "vec_id long, embedding array<float>, label int")
    assert topk_search.nearest(none).count() == 0 and hard_negatives.mine(none, F.col("label")).count() == 0
    one = spark.createDataFrame([(50, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert topk_search.nearest(one).count() == 0 and hard_negatives.mine(one, F.col("label")).count() == 0
    assert spelling.variants(documents(spark, [(1, None), (2, ""), (3, "short")])).count() == 0
    assert spelling.variants(documents(spark).limit(0)).count() == 0


def test_long_texts_and_hot_words(spark):
    rows = [(k, prose(k, 2000)) for k in range(3)] + [(9, "letters " * 200_000 + "lettars lettars")]
    got = {r["word"]: r["form"] for r in spelling.variants(documents(spark, rows)).collect()}
    assert got["lettars"] == "letters" and got["letters"] is None
