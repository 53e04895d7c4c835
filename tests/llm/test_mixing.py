import pytest
from pyspark.sql import functions as F

from mnemara.llm import mixing


def sainte_lague(votes, seats, limits):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max((i for i in range(len(votes)) if won[i] < limits[i]), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


@pytest.mark.parametrize("votes", [[10.0, 7, 3], [1, 1, 1, 1, 1], [1000, 1, 1, 1, 1, 1, 1], [0.5, 333.3, 21, 8, 8]])
def test_apportionment_by_highest_quotients(spark, votes):
    votes = [float(v) for v in votes]
    for seats in (0, 1, 7, 50):
        limits = [40] * len(votes)
        df = spark.createDataFrame([(0, i, v, 40, seats) for i, v in enumerate(votes)], "g int, i int, v double, lim long, seats long")
        got = [r["quota"] for r in mixing.apportion(df, ["g"], ["i"], "v", "lim", "seats").orderBy("i").collect()]
        assert got == sainte_lague(votes, seats, limits)


def test_targets_stop_and_share_again(spark):
    sized = spark.createDataFrame([(1, "a", 10), (2, "b", 1000), (3, "c", 500), (4, None, 90)], "doc_id long, source string, size long")
    t = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    # Plain water filling: 2400 words by weights 5, 2, 1, 5.
    caps, weights, target, capped = {"a": 20, "b": 2000, "c": 1000, None: 180}, {"a": 5, "b": 2, "c": 1, None: 5}, {}, set()
    while True:
        left = 2400 - sum(caps[s] for s in capped)
        total = sum(weights[s] for s in caps if s not in capped)
        target = {s: caps[s] if s in capped else left * weights[s] / total for s in caps}
        over = {s for s in caps if s not in capped and target[s] > caps[s]}
        if not over:
            break
        capped |= over
    assert t == pytest.approx(target)


def test_sources_come_near_and_no_document_exceeds_twice(spark):
    rows = [(i, f"s{i % 5}" if i % 7 else None, 50 + i * 37 % 400) for i in range(3000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix(sized, docs_per_shard=100)
    assert out.count() == 3000 and out.where("taken > 2 * size or taken < 0").count() == 0
    for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 2 * mixing.BLOCK_WORDS + 0.01 * r["target"]
    again = mixing.mix(sized.repartition(7), docs_per_shard=100)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_odd_rows(spark, odd_docs, no_docs):
    out = mixing.mix_documents(odd_docs)
    assert out.count() == odd_docs.count() and out.where("size = 0 and taken > 0").count() == 0
    assert {r["size"] for r in out.where("doc_id in (2, 3, 4)").collect()} == {0}
    assert mixing.mix_documents(no_docs).count() == 0


def test_kept_documents(spark, odd_docs, no_docs):
    kept = mixing.keep_mixed(odd_docs)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    assert kept.where("doc_id = 3").count() == 1 and mixing.keep_mixed(no_docs).count() == 0
    assert all(r["count"] <= 4 for r in kept.groupBy("doc_id").count().collect())
