"""M-tree search and embedding near-duplicates against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemara.llm import embdedup, mtree

BAD = [None, [], [0.0, 0.0, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 0.0], [None, 1.0, 2.0]]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")


def clustered(n, seed=0, dim=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    x = (centres[rng.integers(0, 9, n)] + rng.normal(size=(n, dim)) * 0.2).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[0]  # a hot vector
    return x


def test_dedup_against_brute_force(spark):
    x = clustered(400)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v) for i, v in enumerate(BAD)] + [(2000, [1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embdedup.near_duplicate_vectors(vectors(spark, rows), tile=64).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(near, comp[None, :], len(x)).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    for i in range(len(x)):
        assert got[i] == (near[i].sum(), comp[i], comp[i] == i)
    for i in [*range(1000, 1000 + len(BAD)), 2000]:
        assert got[i] == (0, i, True)
    assert embdedup.near_duplicate_vectors(vectors(spark, [])).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 40), st.floats(0.2, 0.99))
def test_quantised_bound_misses_nothing(seed, dim, threshold):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(30, dim)) * np.exp(rng.normal(size=(30, 1)) * 5)
    b = np.concatenate([a[:15] + rng.normal(size=(15, dim)) * 0.3 * np.abs(a[:15]), rng.normal(size=(15, dim))])
    i, j, sure = embdedup.possible(*embdedup.quantise(a), *embdedup.quantise(b), threshold)
    u, v = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    links = set(zip(*np.nonzero(u @ v.T >= threshold), strict=True))
    assert set(zip(i[sure], j[sure], strict=True)) <= links <= set(zip(i, j, strict=True))


def test_dense_and_hot_groups(spark, monkeypatch):
    """A ball where all link, across tiles, and a vector that a third of all rows have."""
    monkeypatch.setattr(embdedup, "HOT", 100)
    rng = np.random.default_rng(8)
    x = (np.ones((900, 8)) + rng.normal(size=(900, 8)) * 0.02).astype(np.float32)
    x[300:750] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, rng.normal(size=8).tolist()) for i in range(40)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.near_duplicate_vectors(vectors(spark, rows), tile=128).collect()}
    u = np.array([v for _, v in rows], np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert len(got) == 940 and near[:900, :900].all()
    assert all(got[i][0] == near[k].sum() - 1 for k, (i, _) in enumerate(rows)) and {got[i][1] for i in range(900)} == {0}


def plain_top(x, ids, queries, k):
    out = {}
    for q in queries:
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[ids[q]] = [(int(ids[i]), int(s[i])) for i in order]
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_search_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(mtree, "TREE", 50)
    x = np.floor(64 * clustered(500, seed, 5).astype(float)).astype(np.int64)
    ids = np.random.default_rng(seed).permutation(5000)[:500]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(9000, [1, 2]), (9001, [5, 5])], "id long, v array<long>")
    queries = [int(i) for i in range(500) if ids[i] % 20 == 0]
    got = {}
    for r in mtree.search(df, df.where("id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.pop(9000) == [(9001, 15)]
    assert got == plain_top(x, ids, queries, 20)


def test_bounds_save_work():
    x = np.floor(64 * clustered(3000, 4, 3).astype(float)).astype(np.int64)
    top = float((x.astype(float) ** 2).sum(axis=1).max())
    tree = mtree.Tree.unpack(mtree.Tree(np.arange(len(x)), x, top).pack())
    search = mtree.BlockSearch(np.arange(10) * 20, x[:200:20], top, 20)
    search.visit(tree)
    assert search.computed < 0.7 * 10 * len(x)
    for row, q in enumerate(range(0, 200, 20)):
        want = plain_top(x, np.arange(len(x)), [q], 20)[q]
        assert list(zip(search.found[row].tolist(), search.scores[row].tolist(), strict=True)) == want


def test_search_of_odd_rows(spark):
    rows = [(20 * i, v) for i, v in enumerate(BAD)] + [(200, [1.0, 0.5, -0.25]), (201, [1.0, 0.5, -0.25]), (202, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    df = vectors(spark, rows).select(mtree.F.col("vec_id").alias("id"), mtree.integer_vector(mtree.F.col("embedding")).alias("v")).where("v is not null and id is not null")
    out = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in mtree.search(df, df.where("id % 20 = 0")).collect()}
    own = 64 * 64 + 32 * 32 + 16 * 16
    assert out == {(200, 1): (201, own), (200, 2): (40, 0), (200, 3): (202, 0), (40, 1): (200, 0), (40, 2): (201, 0), (40, 3): (202, 0)}
    assert mtree.search(df.limit(0), df.limit(0)).count() == 0
    assert mtree.search(df, df.limit(0)).count() == 0


def test_integers_keep_their_values():
    for most in (0, 127, 128, 40_000, 2**31, 2**63 - 1):
        x = np.array([[most, -most - 1], [0, 1]], np.int64)
        assert (mtree.widen(mtree.narrow(x).tobytes(), 2, 2) == x).all()
