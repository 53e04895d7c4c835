"""Retention of the trace log and budgets of tool rounds, by hand."""

from pyspark.sql import functions as F

from mnemara.operators import logs, rounds
from mnemara.operators.snapshots import Snapshots
from mnemara.streaming.scratch import shared_folder


def test_pruning_is_batched_and_bounds_the_log(spark):
    log = Snapshots(spark, shared_folder(spark, "log"), logs.TRACE, buckets=2)

    def write(first, n):
        q = spark.range(first, first + n).select(F.col("id").alias("query_id"), F.format_string("q%03d", "id").alias("id"), F.lit("x" * 2000).alias("text"))
        empty = spark.createDataFrame([], "query_id long, rank int, id long, text string, version int, similarity double")
        logs.record_traces(log, logs.traces(q, empty, "search", "memory", F.lit(-3.0), F.timestamp_seconds(F.col("query_id"))), keep=5)
        return log.read().count()

    assert write(0, 24) == 24  # none cut yet
    assert write(24, 1) == 5  # the 25th write cuts the log
    assert write(25, 3) == 8
    rows = log.read().collect()
    assert sorted(r["id"] for r in rows) == [f"q{i:03d}" for i in range(20, 28)]
    assert all(len(r["query"]) == 1203 and r["retrieved"] == "[]" and r["latency_ms"] == 0 and r["result_count"] == 0 for r in rows)


def test_tool_rounds_share_a_budget(spark):
    calls = [(1, 1, ["a", "b"]), (1, 2, ["c", "a", "b", "a"]), (1, 3, ["d"]), (2, 1, None), (2, 2, ["a", "bad"]), (2, 3, ["b"])]
    found = {"a": [(1, 0.9, 1), (2, 0.8, 2)], "b": [(2, 0.95, 1), (3, 0.1, 2)], "c": []}
    asked = []

    def search(queries):
        q = queries.collect()
        asked.extend(r["text"] for r in q)
        return spark.createDataFrame([(r["query_id"], *row) for r in q for row in found.get(r["text"], [])], "query_id long, id long, score double, rank int")

    out = rounds.tool_round(spark.createDataFrame(calls, "round_id int, call_no int, queries array<string>"), search, spark.createDataFrame([("bad",)], "text string"))
    got = {(r["round_id"], r["call_no"]): (r["used"], r["error"], [(x["id"], x["score"]) for x in r["results"]]) for r in out.collect()}
    assert got[1, 1] == (["a", "b"], None, [(2, 0.95), (1, 0.9), (3, 0.1)])
    assert got[1, 2] == (["c", "a", "b"], None, [(2, 0.95), (1, 0.9), (3, 0.1)]) and got[1, 3] == ([], None, [])
    assert got[2, 1] == ([], None, []) and got[2, 2] == (["a", "bad"], rounds.UNAVAILABLE, []) and got[2, 3] == (["b"], None, [(2, 0.95), (3, 0.1)])
    assert sorted(asked) == ["a", "b", "bad", "c"]
