"""The keyword index and the approximate vector index against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemara.operators import ann, postings, retrieval


def plain_keywords(rows, query, n):
    """Every text against every set of a query."""
    sets, wanted = [[]], set()
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if bare.lower() == "or" and not minus:
            sets.append([])
        elif words := re.findall(r"[^\W_]+", (quoted or bare).lower()):
            sets[-1].append((words, not minus))
            wanted |= set() if minus else set(words)
    out = []
    for i, text in rows:
        if text is None:
            continue
        t = re.findall(r"[^\W_]+", text.lower())
        has = lambda w: any(t[k : k + len(w)] == w for k in range(len(t)))
        if any(s and all(has(w) == yes for w, yes in s) for s in sets):
            out.append((-round(sum(x in wanted for x in t) / max(1, len(t)), 6), i))
    return [(i, -s, r) for r, (s, i) in enumerate(sorted(out)[:n], 1)]


QUERIES = [
    "alpha", "-alpha", '-"alpha beta"', 'alpha -beta', '"alpha beta" gamma', "alpha beta or gamma -delta", "-alpha or beta", "zeta -zeta", "", "&&&", "missing", "-missing",
    "missing or delta", '"beta alpha beta"', "alpha-beta", "or", "- alpha", "ALPHA ALPHA", '"alpha" -"gamma delta" -beta', "delta or delta or alpha gamma",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["alpha"] * 6 + ["beta"] * 4 + ["gamma", "delta", "zeta", "eta", "theta"]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(150)] + [(900, None), (901, ""), (902, "--- ...")]


@pytest.mark.parametrize("limit", [3, 1000])
def test_scan_and_index_equal_brute_force(spark, texts, limit, monkeypatch):
    data = spark.createDataFrame(texts, "id long, text string")
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string")
    want = {(k, *row) for k, q in enumerate(QUERIES) for row in plain_keywords(texts, q, limit)}
    rows = lambda df: {(r["query_id"], r["id"], r["score"], r["rank"]) for r in df.collect()}
    assert rows(retrieval.keyword_hits(data, queries, limit)) == want
    index = postings.Index.build(data)
    assert rows(index.search(queries, limit)) == want
    if limit > 3:
        return
    some = [r for r in texts if r[0] % 3]
    seen = data.where("id % 3 <> 0").select("id")
    assert rows(index.search(queries, limit, seen)) == {(k, *row) for k, q in enumerate(QUERIES) for row in plain_keywords(some, q, limit)}
    for name, value in (("MAX_BROADCAST_SETS", 3), ("FEW_KEYS", 0)):
        monkeypatch.setattr(retrieval, name, value)
        assert rows(retrieval.keyword_hits(data, queries, limit)) == want
    monkeypatch.setattr(postings, "MAX_BROADCAST_WORDS", 1)
    assert rows(index.search(queries, limit)) == want


def test_index_reads_the_buckets_of_its_words_only(spark, texts):
    index = postings.Index.build(spark.createDataFrame(texts, "id long, text string"))
    words = spark.createDataFrame([("alpha",)], "term string")
    plan = index._of(words, True)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_lists_find_nearly_all_and_fill_filtered_limits(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((12, 16)) * 3
    x = centre[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, 16))
    rows = [(i, v.tolist(), i % 50) for i, v in enumerate(x)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [1.0] * 3, 0), (2004, [float("nan")] * 16, 0), *[(3000 + i, rows[0][1], 0) for i in range(700)]]
    data = spark.createDataFrame(rows, "id long, v array<double>, kind int")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 1500, 25)], "query_id long, q array<double>")
    lists = ann.Lists.build(data)
    exact = retrieval.nearest(data.where("size(v) = 16 and id <> 2002 and id <> 2004"), queries, 10)
    assert ann.recalled(lists.search(queries, 10), exact).agg(F.avg("recall")).first()[0] >= 0.9
    whole = lists.search(queries, 10, probes=len(lists.centres))
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["similarity"]) for r in df.collect())
    assert key(whole) == key(exact)
    narrow = lists.search(queries, 10, F.col("kind") == 7, probes=1)
    assert {r["n"] for r in narrow.groupBy("query_id").agg(F.count("id").alias("n")).collect()} == {10} and narrow.where("id % 50 <> 7").count() == 0
    assert lists.search(queries, 10, F.lit(False)).count() == 0
    plan = lists.table.where(F.col("list").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert ann.Lists.build(data.where("id < 0")).search(queries, 5).count() == 0
