import json

import numpy as np
from pyspark.sql import functions as F

from mnemara.functions import embed
from mnemara.sources import matrix


def saved(path, **tensors):
    at, head, raw = 0, {"__metadata__": {"x": "y"}}, b""
    for name, x in tensors.items():
        head[name] = {"dtype": {"f2": "F16", "f4": "F32", "f8": "F64"}[x.dtype.str[1:]], "shape": list(x.shape), "data_offsets": [at, at + x.nbytes]}
        at, raw = at + x.nbytes, raw + x.tobytes()
    text = json.dumps(head).encode()
    path.write_bytes(len(text).to_bytes(8, "little") + text + raw)
    return str(path)


def test_rows_are_read_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((23, 4)).astype(np.float32), rng.standard_normal((5, 3)).astype(np.float16)
    path = saved(tmp_path / "m.safetensors", a=a, b=b)
    for name, x in (("a", a), ("b", b)):
        df = matrix.matrix(spark, path, name, rows=4)
        assert df.rdd.getNumPartitions() == -(-len(x) // 4)
        got = {r["row"]: r["v"] for r in df.collect()}
        assert sorted(got) == list(range(len(x))) and all(np.array_equal(np.float32(got[i]), x[i].astype(np.float32)) for i in got)


def test_pooling_by_join_equals_the_broadcast_matrix(spark, tmp_path):
    rng = np.random.default_rng(2)
    m = (rng.integers(-8, 8, (30, 6)) / 4).astype(np.float32)  # exact in half precision
    path = saved(tmp_path / "m.safetensors", m=m)
    tokens = spark.createDataFrame([(1, [1, 3, 3, 99, -1]), (2, []), (3, None), (4, [7]), (5, [0, 29, 12, 12, 12])], "id long, ids array<int>")
    got = {r["id"]: r["v"] for r in matrix.pooled_tokens(tokens, matrix.matrix(spark, path, rows=7)).collect()}
    want = {r["id"]: r["v"] for r in tokens.select("id", embed.static_embedder(spark, embed.read_matrix(spark, path))("ids").alias("v")).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[2] is None and got[3] is None
    assert all(np.allclose(got[i], want[i], atol=1e-6) for i in (1, 4, 5))


def test_owners_prune_folders(spark, tmp_path):
    rows = spark.range(200).select("id", F.concat(F.lit("org"), F.col("id") % 5).alias("org"), F.lit("text").alias("text"))
    store = matrix.stored_by(rows, str(tmp_path / "store"), "org")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one = store.where("org = 'org3'")
    assert "PartitionFilters: [isnotnull(org" in plan(one) and one.count() == 40
    spaces = spark.createDataFrame([("s1", "org1"), ("s2", "org2")], "space string, org string").where("space = 's2'")
    joined = store.join(F.broadcast(spaces), "org")
    assert "dynamicpruning" in plan(joined) and joined.count() == 40
