import numpy as np
import pytest
import xxhash
from compare import DATA

from mnemara.llm import golay, graph, simhash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def closure(fps, bits=4):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(parent)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[root(b)] = root(a)
    return {f: root(f) for f in fps}


def expected(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    group = closure({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    return sorted(((i, f"{f:016x}", least.get(group[f])) for i, f in fps), key=str)


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 300)
    k = golay.indices(v)
    for e in [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]:
        k2 = golay.indices(v ^ e)
        assert ((k[:, :, None] == k2[:, None, :]) & (k[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.op6_simhash(spark, f"{DATA}/sf0.001").collect()), key=str) == expected(rows)


@pytest.mark.parametrize("block", [3, 2048])
def test_dense_groups_against_brute_force(spark, monkeypatch, block):
    """Chains and dense balls of fingerprints; small blocks take the path of hot keys."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 12)
    fps = {int(b) for b in base}
    for b in base:
        x = int(b)
        for _ in range(40):  # a walk in small steps
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            x = (x + (1 << 63)) % (1 << 64) - (1 << 63)
            fps.add(x)
    monkeypatch.setattr(simhash, "BLOCK", block)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    if block == 3:  # in this process, as a worker has its own module
        import pyarrow as pa

        keyed = simhash.golay_keys(df).orderBy("key").toPandas()
        batch = pa.RecordBatch.from_arrays([pa.array(keyed.key), pa.array(keyed.fp)], ["key", "fp"])
        monkeypatch.setattr(simhash, "GATHER", 50)
        out = [r for b in simhash._link_runs(batch.slice(i, 17) for i in range(0, batch.num_rows, 17)) for r in b.to_pylist()]
        edges = [(r["a"], r["b"]) for r in out if r["a"] is not None]
        blocks = [(r["key"], r["place"], r["root"], r["block"]) for r in out if r["block"] is not None]
        assert blocks
        pairs = [(x[3], y[3]) for x in blocks for y in blocks if x[0] == y[0] and x[1] <= y[1] and (x[2] is None or x[2] != y[2])]
        cross = pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])], ["block", "right"])
        edges += [(r["a"], r["b"]) for b in simhash._link_blocks([cross]) for r in b.to_pylist()]
    else:
        edges = [tuple(r) for r in simhash.links(df).collect()]
    assert all((a ^ b) % (1 << 64) < 1 << 64 and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in edges)
    comp = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = closure({f & (1 << 64) - 1 for f in fps})
    groups = lambda d: {frozenset(k & (1 << 64) - 1 for k in d if d[k] == v) for v in set(d.values())}
    assert groups({f: comp.get(f, f) for f in fps}) == groups(want)


def test_ball_of_near_copies_stays_cheap():
    """20 000 fingerprints around one, a third of all rows: linked by a forest, in bounded time and memory."""
    import resource
    import time

    import pyarrow as pa

    rng = np.random.default_rng(5)
    ball = np.full(20_000, 0x0123456789ABCDEF, np.uint64)
    for _ in range(3):
        ball ^= np.uint64(1) << rng.integers(0, 64, len(ball), np.uint64)
    rest = rng.integers(0, 1 << 63, 40_000).astype(np.uint64)
    fps = np.unique(np.concatenate([ball, rest])).view(np.int64)
    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    keys = pa.Table.from_batches(simhash._golay_key_batches([pa.RecordBatch.from_arrays([pa.array(fps)], ["fp"])])).sort_by("key")
    sorted_at = time.time()
    out = pa.Table.from_batches(simhash._link_runs(iter(keys.to_batches(10_000))))
    blocks = [r for r in out.filter(pa.compute.is_valid(out["block"])).to_pylist()]
    pairs = [(x, y) for x in blocks for y in blocks if x["key"] == y["key"] and x["place"] <= y["place"] and (x["root"] is None or x["root"] != y["root"])]
    edges = [(r["a"], r["b"]) for r in out.filter(pa.compute.is_valid(out["a"])).to_pylist()]
    for x, y in pairs:
        cross = pa.RecordBatch.from_arrays([pa.array([x["block"]]), pa.array([y["block"]])], ["block", "right"])
        edges += [(r["a"], r["b"]) for b in simhash._link_blocks(iter([cross])) for r in b.to_pylist()]
    assert time.time() - sorted_at < 60 and time.time() - began < 120
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000
    assert len(edges) < 2 * len(fps)
    up = {int(f): int(f) for f in fps}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    small = np.unique(ball)[:300].view(np.int64).tolist()
    for i, a in enumerate(small):
        assert all(root(a) == root(b) for b in small[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    assert len({root(int(f)) for f in np.unique(ball).view(np.int64)}) == 1


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert graph.components(edges.limit(0)).count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    out = simhash.near_duplicates(odd_docs).select("doc_id", simhash.hex16(simhash.F.col("fp")), "component_id").collect()
    assert sorted(map(tuple, out), key=str) == expected([tuple(r) for r in odd_docs.select("doc_id", "text").collect()])
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one_of_each(odd_docs)
    assert kept.schema == odd_docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 in ids and not {3, 4, 5, 8} & set(ids)
    assert simhash.keep_one_of_each(no_docs).count() == 0


def test_rows_without_or_with_one_id_are_decided_each_by_its_group(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(7, a), (None, a), (None, b), (None, c), (None, c), (9, d), (9, a), (9, b), (3, d), (3, c), (3, c)]
    kept = [tuple(r) for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == [(3, c), (3, d), (7, a), (9, b)]
    kept = simhash.keep_one_of_each(spark.createDataFrame([(None, a), (None, b), (None, a), (None, c)], "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in kept) == [a, b, c]
